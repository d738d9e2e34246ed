"""Hand cases of the record rules, the sources and the streams."""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from strandwise.functions import records as R
from strandwise.operators import annotation, duplicates, intervals, pileup, qc, variants
from strandwise.operators import records as X
from strandwise.plans import catalog
from strandwise.sources import bam, text
from strandwise.streaming import events

from .conftest import SMALL

READS = "idx long, name string, flags int, contig int, pos int, mapq int, cigar string, tlen int, bases string, quals array<int>, library string, rg string, sample string, mate_contig int, mate_pos int, umi string, tile int, x int, y int, nm int"


def read(idx, name="q", flags=0, pos=100, cigar="10M", bases="ACGTACGTAC", q=30, x=0, umi="ATCC", mate_pos=1):
    return (idx, name, flags, 0, pos, 60, cigar, 0, bases, [q] * len(bases), "lib", "rg", "s", 0, mate_pos, umi, 1, x, 0, 0)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), READS)


def test_cigar_expressions(spark):
    df = frame(spark, read(1, cigar="5H3S7M2D4M1I2M4S", flags=16), read(2, cigar="*")).withColumn("ops", R.cigar_ops())
    a, b = df.select(R.reference_length(), R.read_length(), R.unclipped_start(), R.unclipped_end(), R.five_prime(), R.blocks()).orderBy(F.lit(1)).collect()
    got = {tuple(x)[:5]: [tuple(y) for y in x[5]] for x in (a, b)}
    assert got == {(15, 21, 92, 118, 118): [(3, 100, 7), (10, 109, 4), (15, 113, 2)], (0, 0, 100, 99, 100): []}


def test_locations_and_trimming(spark):
    names = [("a:b:c", None), ("a:b:1101:20:30", (1101, 20, 30)), ("a:b:c:d:e:f", None), ("a:b:c:d:7:8x:9#1", (7, 8, 9))]
    df = spark.createDataFrame([(n,) for n, _ in names], "name string").select("name", R.location().alias("l"))
    assert {r.name: r.l and tuple(r.l) for r in df.collect()} == dict(names)
    t = spark.createDataFrame([([30, 30, 2, 2],), ([2, 2],), ([30],), ([],)], "quals array<int>")
    assert [r[0] for r in t.select(R.quality_trim_point("quals", 20)).collect()] == [2, 0, 1, 0]


def test_clipped_duplicate_and_pair_over_fragment(spark):
    df = frame(spark, read(1, "a"), read(2, "b", pos=103, cigar="3S7M", q=20))
    assert {r.idx: r.is_duplicate for r in duplicates.mark_duplicates(df).collect()} == {1: False, 2: True}
    pair = frame(spark, read(1, "f", q=40), read(2, "p", flags=1 + 64, q=10), read(3, "p", flags=1 + 128 + 16, pos=300, q=10))
    assert {r.idx: r.is_duplicate for r in duplicates.mark_duplicates(pair).collect()} == {1: True, 2: False, 3: False}
    tie = frame(spark, read(5, "a"), read(4, "b"))
    assert {r.idx: r.is_duplicate for r in duplicates.mark_duplicates(tie.repartition(3)).collect()} == {4: False, 5: True}


def test_optical_links_chain(spark):
    rows = []
    for i, x in enumerate((0, 90, 180)):
        rows += [read(2 * i, f"t{i}", flags=65, x=x), read(2 * i + 1, f"t{i}", flags=145, pos=300, x=x)]
    assert sorted(map(tuple, duplicates.optical_links(frame(spark, *rows), 100).collect())) == [(0, 2), (2, 4)]


def test_umi_chain_is_one_cluster(spark):
    df = frame(spark, *(read(i, f"q{i}", umi=u) for i, u in enumerate(("ATCC", "AACC", "AACG", "GGGG"))))
    assert {r.umi: r.cluster for r in duplicates.umi_clusters(df).collect()} == {"ATCC": "AACC", "AACC": "AACC", "AACG": "AACC", "GGGG": "GGGG"}


def slow_sets(pairs, max_diff=0.03):
    out, left = [], list(pairs)
    while left:
        lead = left.pop(0)
        cut = lambda p: [(x[:n], y[:n]) for x, y in zip(lead, p, strict=True) for n in [min(len(x), len(y))]]
        match = lambda p: p[0][:5] == lead[0][:5] and p[1][:5] == lead[1][:5] and sum(a != b for x, y in cut(p) for a, b in zip(x, y, strict=True)) <= math.floor(sum(len(x) for x, _ in cut(p)) * max_diff)
        mine = [p for p in left if match(p)]
        left = [p for p in left if not match(p)]
        out.append(1 + len(mine))
    return Counter(out)


def test_library_complexity_compares_whole_pairs(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    one, two = text(60), text(60)
    flip = lambda s, *at: "".join("ACGT"[("ACGT".index(c) + 1) % 4] if i in at else c for i, c in enumerate(s))
    pairs = [(one, two), (flip(one, 10, 40), flip(two, 59)), (flip(one, 10, 40), flip(two, 58, 59)), (one, flip(two, *range(30, 60))), (one[:18], two), (one, flip(two, 3)), (one[:12], two[:10]), (text(60), two)]
    rows = []
    for i, (x, y) in enumerate(pairs):
        rows += [read(2 * i, f"p{i}", flags=65, bases=x), read(2 * i + 1, f"p{i}", flags=145, bases=y[::-1].translate(str.maketrans("ACGT", "TGCA")))]
    rows += [read(90, "single", bases=one), read(91, "half", flags=65, bases=one), read(92, "poor", flags=65, bases=one, q=19), read(93, "poor", flags=129, bases=two)]
    got = {r.set_size: r.sets for r in duplicates.library_complexity(frame(spark, *rows)).collect()}
    assert got == slow_sets(pairs) == {4: 1, 1: 4}


def test_claims_of_a_large_group():
    rng = random.Random(7)
    roots = [tuple("ACGTA" + "".join(rng.choice("ACGT") for _ in range(70)) for _ in range(2)) for _ in range(6)]
    near = lambda s: "".join(rng.choice("ACGTN") if i > 4 and rng.random() < 0.02 else c for i, c in enumerate(s))[: rng.choice((75, 75, 50, 20, 9))]
    pairs = [tuple(map(near, rng.choice(roots))) for _ in range(400)]
    for max_diff in (0.03, 0.0, 0.3):
        assert Counter(duplicates.claimed_sizes([x for x, _ in pairs], [y for _, y in pairs], [1] * len(pairs), 5, max_diff)) == slow_sets(pairs, max_diff)


def test_library_size(spark):
    t = spark.createDataFrame([(1000, 200), (10, 0)], "read_pairs long, duplicate_pairs long")
    assert [r.estimated_library_size for r in duplicates.estimate_library_size(t).orderBy("read_pairs").collect()] == [None, 2154]


def test_intervals_by_hand(spark):
    iv = spark.createDataFrame([(0, 1, 10, "+", "a"), (0, 11, 20, "+", "b"), (0, 30, 40, "-", "c"), (1, 5, 6, "+", "d")], "contig int, start int, stop int, strand string, name string")
    contigs = spark.createDataFrame([(0, "x", 50), (1, "y", 6)], "contig int, contig_name string, length int")
    rows = lambda df: sorted(tuple(r)[:3] for r in df.select("contig", "start", "stop").collect())
    assert rows(intervals.merged(iv)) == rows(intervals.merged_in_bins(iv, 7)) == [(0, 1, 20), (0, 30, 40), (1, 5, 6)]
    assert rows(intervals.invert(iv, contigs)) == [(0, 21, 29), (0, 41, 50), (1, 1, 4)]
    assert {r.name for r in intervals.bands(iv, 10).collect()} == {"a.1", "a.2", "b.1", "b.2", "c.1", "c.2", "d"}
    assert rows(intervals.padded(iv, contigs, -6, -6)) == []


def test_gc_windows(spark):
    seq = "GCGCGCGCGCGNNNNNNNGCGCGCGCGCGCATATATATAT"
    ref = spark.createDataFrame([(0, 0, 1, seq[:20]), (0, 1, 21, seq[20:])], "contig int, chunk int, start int, bases string")
    got = {r.pos: r.gc for r in pileup.gc_windows(ref, 10, 20).collect()}
    want = {i + 1: -1 if w.count("N") > 4 else (w.count("G") + w.count("C")) * 100 // (10 - w.count("N")) for i in range(len(seq) - 9) if (w := seq[i : i + 10])}
    assert got == want


def test_contexts_cross_chunk_borders(spark):
    seq = "CGTCAGCCGATTGCAACGTGGCTAC"
    chunks = [(0, k, 10 * k + 1, seq[10 * k : 10 * k + 10]) for k in range(3)]
    ref = spark.createDataFrame(chunks, "contig int, chunk int, start int, bases string")
    df = frame(spark, read(1, flags=65, pos=1, cigar="25M", bases=seq), read(2, flags=65, pos=8, cigar="6M", bases=seq[7:13]))
    x = pileup.aligned_to_reference(df.withColumn("ops", R.cigar_ops()), ref, chunk=10, context=True)
    want = {i + 1: seq[i - 1 : i + 2] if 0 < i < len(seq) - 1 else None for i in range(len(seq))}
    assert sorted((r.idx, r.pos, r.context or "") for r in x.collect()) == sorted([(1, p, c or "") for p, c in want.items()] + [(2, p, want[p]) for p in range(8, 14)])
    wide = seq * 40  # the operators' own chunks of 500
    ref = spark.createDataFrame([(0, 0, 1, wide[:500]), (0, 1, 501, wide[500:])], "contig int, chunk int, start int, bases string")
    df = frame(spark, read(1, flags=65, pos=491, cigar="20M", bases=wide[490:510]))
    inside = range(490, 510)
    assert pileup.artifacts(df, ref).agg(F.sum("bases")).first()[0] == 20
    assert pileup.oxidation(df, ref).agg(F.sum("total_bases")).first()[0] == sum(wide[i] in "CG" for i in inside)
    m = pileup.methylation(df, ref).first()
    cpg = sum(wide[i : i + 2] == "CG" for i in inside)
    assert (m.cpg_bases_seen, m.non_cpg_bases) == (cpg, sum(wide[i] == "C" for i in inside) - cpg) and cpg


def test_variant_types(spark):
    cases = [("A", "G", "SNP"), ("A", "G,T", "SNP"), ("AC", "GT", "MNP"), ("A", "AT", "INDEL"), ("AT", "A", "INDEL"), ("A", "G,AT", "MIXED"), ("A", "<DEL>", "SYMBOLIC"), ("A", "*", "NO_VARIATION"), ("ACG", "T", "INDEL"), ("A", "ATT,ATTT", "INDEL")]
    df = spark.createDataFrame([(r, a) for r, a, _ in cases], "ref string, alts string").select("ref", "alts", variants.variant_type().alias("t"))
    assert [tuple(r) for r in df.collect()] == cases


def test_repartitioning_changes_nothing(spark):
    from strandwise.plans.adapt import Tables

    r = Tables(spark, "/root/testdata/sf0.001").reads
    for op in (qc.alignment_summary, duplicates.duplication_metrics, X.fixed_mates, duplicates.mark_duplicates):
        assert sorted(map(tuple, op(r).collect())) == sorted(map(tuple, op(r.repartition(13, "mapq")).collect()))


SAM = "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:1000\n@RG\tID:r1\tSM:s1\nq1\t0\tc1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tRG:Z:r1\tNM:i:0\nq2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"


def test_sam_round_trip(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    df = text.read_sam(spark, str(tmp_path / "a.sam"))
    a, b = df.orderBy("idx").collect()
    assert (a.idx, a["name"], a.pos, a.quals, a.tags, a.rg, b.contig_name, b.quals, b.bases) == (3, "q1", 5, [40] * 4, {"RG": "r1", "NM": "0"}, "r1", None, [], "")
    assert [r.fields["SN"] for r in text.read_header(spark, str(tmp_path / "a.sam"), "SQ").collect()] == ["c1"]
    text.write_lines(text.sam_lines(df), str(tmp_path / "out"), ["@HD\tVN:1.6"])
    again = text.read_sam(spark, str(tmp_path / "out"))
    assert sorted((r["name"], r.pos, r.cigar, tuple(r.quals)) for r in again.collect()) == sorted((r["name"], r.pos, r.cigar, tuple(r.quals)) for r in (a, b))


def test_fastq_in_small_splits(spark, tmp_path):
    (tmp_path / "a.fq").write_text("".join(f"@r{i} x\n{'ACGT'[: i % 4 + 1]}\n+\n{'I' * (i % 4 + 1)}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = text.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("idx").collect()
        (tmp_path / "a.fa").write_text("".join(f">c{i} d\n" + "ACGTN" * 30 + "\n" + "ac" * i + "\n" for i in range(1, 12)))
        fasta = text.read_fasta(spark, str(tmp_path / "a.fa"))
        names = spark.createDataFrame([(i, f"c{i}") for i in range(1, 12)], "contig int, contig_name string")
        chunks = text.chunked(fasta, names, 50).orderBy("contig", "chunk").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.idx, r.read_name, r.bases) for r in rows] == [(i, f"r{i}", "ACGT"[: i % 4 + 1]) for i in range(500)]
    for i in range(1, 12):
        assert "".join(r.bases for r in chunks if r.contig == i) == "ACGTN" * 30 + "ac" * i


def test_other_text_sources(spark, tmp_path):
    p = lambda n, s: ((tmp_path / n).write_text(s), str(tmp_path / n))[1]
    assert [tuple(r) for r in text.read_bed(spark, p("a.bed", "track x\nc1\t0\t10\tn\t5\t-\nc2\t4\t5\n")).collect()] == [("c1", 1, 10, "n", "-"), ("c2", 5, 5, None, "+")]
    assert [tuple(r) for r in text.read_interval_list(spark, p("a.il", "@HD\tVN:1\nc1\t1\t2\t+\tn\n")).collect()] == [("c1", 1, 2, "+", "n")]
    r = text.read_refflat(spark, p("a.rf", "g\tt\tc1\t+\t0\t100\t10\t90\t2\t0,50,\t20,100,\n")).first()
    assert (r.tx_start, r.cds_start, [tuple(e) for e in r.exons]) == (1, 11, [(1, 20), (51, 100)])
    c = text.read_chain(spark, p("a.chain", "chain 9 c1 1000 + 10 60 d1 900 + 5 58 1\n20 5 8\n25\n")).orderBy("start").collect()
    assert [(x.start, x.stop, x.to_contig, x.offset) for x in c] == [(11, 30, "d1", -5), (36, 60, "d1", -2)]
    v = text.read_vcf(spark, p("a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\nc1\t7\t.\tA\tG,T\t.\tq10\tDP=3;DB\tGT:GQ\t0/1:9\n"))
    x = v.first()
    assert (x.pos, x.alts, x.qual, x.filters, x.info, x.genotypes[0].sample, x.genotypes[0].fields) == (7, "G,T", None, ["q10"], {"DP": "3", "DB": "true"}, "s1", {"GT": "0/1", "GQ": "9"})
    assert text.vcf_lines(v).first().value == "c1\t7\t.\tA\tG,T\t.\tq10\tDB;DP=3"
    m = text.read_metrics(spark, p("a.m", "# c\n## METRICS CLASS\tX\nA\tB\n1\t?\n2\t3\n\n## HISTOGRAM\nk\n")).collect()
    assert sorted(map(tuple, m)) == [(0, "A", "1"), (0, "B", "NaN"), (1, "A", "2"), (1, "B", "3")]


def test_bam_source(spark, tmp_path):
    rows = [dict(name=f"q{i}", flags=0 if i % 3 else 4, contig=0 if i % 3 else -1, pos=i + 1, mapq=60, cigar="4M2I3M" if i % 3 else "*", mate_contig=-1, mate_pos=0, tlen=-i, bases="ACGTNACGT"[: 9 - i % 2], quals=list(range(9 - i % 2)), tags={"RG": f"r{i}"}) for i in range(3000)]
    (tmp_path / "a.bam").write_bytes(bam.encode(rows, [("c1", 5000)]))
    got = bam.read_bam(spark, str(tmp_path)).orderBy("idx").collect()
    assert [{k: r[k] for k in rows[0]} for r in got] == rows and got[1].contig_name == "c1"


def test_streams_agree_with_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, op in (("tumbling", events.tumbling), ("sliding", events.sliding), ("sessions", events.sessions)):
        q = op(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        key = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
        assert key(spark.table(name)) == key(op(e))
    q = events.first_of_each(stream, ["user_id", "event_type"], "3650 days").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == events.first_of_each(e, ["user_id", "event_type"]).count()


def slow_clusters(edges):
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return label


def test_clusters_of_all_customers(spark):
    path = [(i, i + 1) for i in range(20, 0, -1)] + [(30, 30), (40, 41), (41, 40)]
    got = {r.node: r.label for r in annotation.clusters(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == slow_clusters(path)
    keys = [r.c_custkey for r in spark.read.parquet(f"{SMALL}/customer.parquet").collect()]
    edges = [(k, (k * 7 + 3) % 1500) for k in keys]
    assert {r.node: r.label for r in catalog.QUERIES["cluster_crosscheck"](spark, SMALL).collect()} == slow_clusters(edges)


def test_demultiplex_takes_any_sheet(spark):
    rng = random.Random(3)
    sheet = sorted({"".join(rng.choice("ACGT") for _ in range(14)) for _ in range(6000)})
    picked = rng.sample(sheet, 60)
    seen = [(b, True) for b in picked] + [("T" + picked[0][1:] if picked[0][0] != "T" else "A" + picked[0][1:], False), ("N" * 14, True)]
    got = {r.assigned: (r.reads, r.pf_reads, r.perfect_matches) for r in annotation.demultiplex(spark.createDataFrame(seen, "barcode string, pf boolean"), spark.createDataFrame([(b,) for b in sheet], "barcode string")).collect()}
    assert got == {b: (1, 1, 1) for b in picked} | {picked[0]: (2, 1, 1), "NNNN": (1, 1, 0)}
    one = annotation.demultiplex(spark.createDataFrame([("ACGT", True), ("ACGA", True)], "barcode string, pf boolean"), spark.createDataFrame([("ACGT",)], "barcode string")).collect()
    assert [tuple(r) for r in one] == [("ACGT", 2, 2, 1)]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 50)], "a long, b long")
    assert {r.node: r.label for r in annotation.clusters(e).collect()} == {i: 0 for i in range(21)} | {100: 50, 50: 50}
