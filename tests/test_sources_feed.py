"""Files go through the sources into the operators, as the README shows."""

from __future__ import annotations

from strandwise.operators import annotation, duplicates, qc, variants
from strandwise.sources import bam, text

SAM = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:chr2\tLN:1000
@SQ\tSN:chr1\tLN:2000
@RG\tID:A\tLB:lib1\tSM:s1
@RG\tID:B\tLB:lib2\tSM:s1
m:7:1101:10:20\t99\tchr1\t100\t60\t10M\t=\t200\t110\tACGTACGTAC\tIIIIIIIIII\tRG:Z:A\tNM:i:1
m:7:1101:10:20\t147\tchr1\t200\t60\t10M\t=\t100\t-110\tACGTACGTAC\tIIIIIIIIII\tRG:Z:A
m:7:1101:15:25\t99\tchr1\t103\t60\t3S7M\t=\t200\t107\tACGTACGTAC\t5555555555\tRG:Z:A
m:7:1101:15:25\t147\tchr1\t200\t60\t10M\t=\t103\t-107\tACGTACGTAC\t5555555555\tRG:Z:A
q5\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII\tRG:Z:B
"""
VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tdad\tmom\tkid
chr1\t10\trs1\tA\tG\t50\tPASS\tDP=40;FS=1.5;QD=9\tGT:GQ:DP:AD\t0/0:50:20:20,0\t0/0:50:20:20,0\t0/1:50:20:10,10
chr1\t20\t.\tC\tT\t50\tLow\tDP=40\tGT:GQ:DP:AD\t0/1:50:20:9,9\t./.:.:.:.\t1|0:50:20:9,9
chr1\t30\t.\tC\tA\t50\t.\tDP=40\tGT:GQ:DP:AD\t0/1:50:20:9,9\t0/1:50:20:9,9\t1/1:50:20:0,18
"""


def test_records_from_files(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    reads = text.read_sam(spark, str(tmp_path / "a.sam"))
    rows = {(r.name, r.flags): r for r in reads.collect()}
    first = rows["m:7:1101:10:20", 99]
    assert (first.contig, first.mate_contig, first.rg, first.library, first.sample, first.nm, first.len, first.tile, first.x, first.y) == (1, 1, "A", "lib1", "s1", 1, 10, 1101, 10, 20)
    assert (rows["q5", 4].contig, rows["q5", 4].library, rows["q5", 4].tile) == (-1, "lib2", None)
    got = {r.rg: (r.total_reads, r.total_bases) for r in qc.quality_yield(reads, ["rg"]).collect()}
    assert got == {"A": (4, 40), "B": (1, 4)}
    marks = {r.idx for r in duplicates.mark_duplicates(reads).filter("is_duplicate").collect()}
    assert marks == {r.idx for r in rows.values() if r.name.endswith("15:25")}
    assert {r.category: r.total_reads for r in qc.alignment_summary(reads).collect()} == {"FIRST_OF_PAIR": 2, "SECOND_OF_PAIR": 2, "PAIR": 4, "UNPAIRED": 1}
    assert qc.insert_size_stats(reads).collect()[0].n == 2
    records = [r.asDict() | {"tags": dict(r.tags)} for r in reads.filter("contig >= 0").collect()]
    (tmp_path / "a.bam").write_bytes(bam.encode(records, [("chr2", 1000), ("chr1", 2000)]))
    again = bam.read_bam(spark, str(tmp_path / "a.bam"), text.read_groups(spark, str(tmp_path / "a.sam")))
    assert {r.library for r in again.collect()} == {"lib1"} and duplicates.mark_duplicates(again).filter("is_duplicate").count() == 2


def test_wide_header_lines(spark, tmp_path):
    (tmp_path / "w.sam").write_text("@RG\tID:x\t" + "\t".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}:{i}" for i in range(676)) + "\tLB:deep\tSM:s\n")
    assert text.read_groups(spark, str(tmp_path / "w.sam")).collect()[0].library == "deep"
    (tmp_path / "v.sam").write_text("@CO\tx\n@RG\tID:x" + "\tLB:l\tSM:s\n")
    assert text.read_groups(spark, str(tmp_path / "v.sam")).count() == 1


def test_variants_from_files(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    contigs = spark.createDataFrame([(0, "chr2"), (1, "chr1")], "contig int, contig_name string")
    v = text.canonical_variants(text.read_vcf(spark, str(tmp_path / "a.vcf")), contigs)
    rows = {r.pos: r for r in v.collect()}
    assert (rows[10].contig, rows[10].filtered, rows[10].in_dbsnp, rows[10].dp, rows[10].fs, rows[10].qd) == (1, False, True, 40, 1.5, 9.0)
    assert rows[20].filtered and not rows[30].filtered
    g = {(r.pos, r.sample): (r.a, r.b, r.gq, r.ad) for r in variants.genotypes(v).collect()}
    assert g[10, "kid"] == (0, 1, 50, 10) and g[20, "mom"] == (None, None, None, None) and g[20, "kid"] == (0, 1, 50, 9) and len(g) == 9
    found = {r.kind: r.sites for r in variants.mendelian(variants.trio(v, "dad", "mom", "kid")).collect()}
    assert found == {"DIPLOID_DENOVO": 1, "NONE": 1}
    assert variants.calling_summary(v).collect()[0].total_snps == 2
    assert {r.sample: r.variants for r in variants.calling_detail(v).collect()} == {"dad": 1, "mom": 1, "kid": 2}


def test_genes_of_any_number_of_exons(spark, tmp_path):
    (tmp_path / "r.txt").write_text("g1\tt1\tchr1\t+\t99\t500\t149\t420\t3\t99,199,399,\t150,300,500,\n")
    genes = text.read_refflat(spark, str(tmp_path / "r.txt")).join(spark.createDataFrame([(1, "chr1")], "contig int, contig_name string"), "contig_name")
    got = sorted((r.start, r.stop, r.rank) for r in annotation.features(genes).collect())
    assert got == [(100, 150, 2), (100, 500, 1), (150, 150, 3), (200, 300, 2), (200, 300, 3), (400, 420, 3), (400, 500, 2)]


def test_bad_cycles_by_block_offset(spark):
    """Mismatches at read places 3 and 13 of 10M5D10M share a block offset and are one bad cycle; at 3 and 15 they are two."""
    reference = spark.createDataFrame([(0, 0, 1, "A" * 60)], "contig int, chunk long, start int, bases string")
    row = lambda bad: [(1, "q", 0, 0, 1, 60, "10M5D10M", "".join("C" if i in bad else "A" for i in range(20)), [30] * 20)]
    schema = "idx long, name string, flags int, contig int, pos int, mapq int, cigar string, bases string, quals array<int>"
    for bad, cycles in (((3, 13), 1), ((3, 15), 2)):
        got = qc.alignment_errors(spark.createDataFrame(row(bad), schema), reference).collect()
        assert [(r.category, r.bad_cycles, r.pf_hq_median_mismatches, r.pf_mismatch_rate, r.pf_hq_aligned_q20_bases) for r in got] == [("UNPAIRED", cycles, 2.0, 0.1, 20)]


def test_a_repeated_adapter_is_found_at_its_last_place(spark):
    from strandwise.operators import records

    rows = [(1, "ACGTAGATCGGAACGTAGATCGGA"), (2, "AGATCGGAACCC"), (3, "CCCCCCCCCC"), (4, "AG"), (5, "CCCCCCAGATCGTA")]
    got = {r.idx: r.adapter_start for r in records.adapter_start(spark.createDataFrame(rows, "idx long, bases string"), "AGATCGGAAG", least=6).collect()}
    assert got == {1: 16, 2: 0, 3: None, 4: None, 5: None}
    assert records.adapter_start(spark.createDataFrame([(1, "CCAGATCGTAAGCC")], "idx long, bases string"), "AGATCGNAAG", least=6, max_error=0.0).collect()[0].adapter_start == 2


def test_terminators(tmp_path):
    whole = bam.encode([], [("c", 10)])
    for name, data, want in (("a", whole, "HAS_TERMINATOR_BLOCK"), ("b", whole[:-28], "HAS_HEALTHY_LAST_BLOCK"), ("c", whole[:-40], "DEFECTIVE"), ("d", b"", "DEFECTIVE")):
        (tmp_path / name).write_bytes(data)
        assert bam.terminator(str(tmp_path / name)) == want


def test_sample_map(spark, tmp_path):
    import pytest

    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    for name in ("s1", "s2"):
        (tmp_path / f"{name}.vcf").write_text(head + name + "\n")
    assert {r.sample: r.file.rsplit("/", 1)[1] for r in text.vcf_sample_map(spark, str(tmp_path)).collect()} == {"s1": "s1.vcf", "s2": "s2.vcf"}
    (tmp_path / "again.vcf").write_text(head + "s1\n")
    with pytest.raises(Exception, match="several files of s1"):
        text.vcf_sample_map(spark, str(tmp_path)).collect()


def test_several_programs(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    got = qc.multiple_metrics(text.read_sam(spark, str(tmp_path / "a.sam")).cache())
    assert {k: v.count() for k, v in got.items()} == {"alignment_summary": 4, "insert_size_stats": 1, "base_distribution_by_cycle": 20, "quality_distribution": 2, "mean_quality_by_cycle": 20, "quality_yield": 1}


def test_duplicates_of_a_stream(spark, tmp_path):
    from strandwise.streaming import events

    rows = [(i, "l", 0, 100 + i // 3, 16 * (i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "idx long, library string, contig int, pos int, flags int")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = events.stream_duplicates(stream, "3650 days").writeStream.format("memory").queryName("marks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("marks").select("library", "contig", "pos", "flags")
    assert sorted(map(tuple, got.collect())) == sorted({r[1:] for r in rows})


def test_gathered_variants_in_order(spark):
    import pytest

    from strandwise.operators import rewrite

    v = spark.createDataFrame([(0, 5, 1), (0, 9, 2), (1, 2, 3)], "contig int, pos int, k int")
    assert rewrite.gathered_variants([v.filter("contig = 0"), v.limit(0), v.filter("contig = 1")]).count() == 3
    with pytest.raises(ValueError):
        rewrite.gathered_variants([v.filter("contig = 1"), v.filter("contig = 0")])
    assert [r.k for r in rewrite.merged_variants([v.filter("k = 3"), v.filter("k < 3")]).collect()] == [1, 2, 3]
    f = spark.createDataFrame([(1, "b", 5), (2, "a", 9), (3, "a", 2), (4, "zz", 1)], "idx int, contig_name string, start int")
    assert [r.idx for r in rewrite.sorted_features(f).collect()] == [3, 2, 1, 4]
    d = spark.createDataFrame([(0, "b"), (1, "a")], "contig int, contig_name string")
    assert [r.idx for r in rewrite.sorted_features(f, d).collect()] == [4, 1, 3, 2]


def test_records_in_coordinate_order(spark):
    from strandwise.operators import records

    rows = [(1, "a", 0, 1, 50), (2, "b", 4, 0, 7), (3, "c", 16, 0, 9), (4, "c", 0, 0, 9), (5, "d", 0, 0, 3)]
    r = spark.createDataFrame(rows, "idx long, name string, flags int, contig int, pos int")
    assert [x.idx for x in records.sorted_records(r, records.coordinate_order(r)).collect()] == [5, 4, 3, 1, 2]
