"""Queries of operators.annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation as A
from ..operators import variants as V
from .q_variants import G
from .registry import BLOCKS, n, query, r

FEAT = """feat AS (SELECT contig, gene, transcript, tx_start AS s, tx_end AS e, 1 AS rank FROM genes UNION ALL SELECT contig, gene, transcript, e1_start, e1_end, 2 FROM genes UNION ALL SELECT contig, gene, transcript, e2_start, e2_end, 2 FROM genes
 UNION ALL SELECT contig, gene, transcript, greatest(e1_start, cds_start), least(e1_end, cds_end), 3 FROM genes UNION ALL SELECT contig, gene, transcript, greatest(e2_start, cds_start), least(e2_end, cds_end), 3 FROM genes)"""
USABLE = "flags & 2820 = 0"


@query("rnaseq_functions", f"""WITH {BLOCKS}, {FEAT}, p AS (SELECT contig, unnest(range(ref_start, ref_start + blen)) AS pos FROM blocks JOIN reads USING (idx) WHERE {USABLE}), d AS (SELECT contig, pos, count(*) AS c FROM p GROUP BY ALL),
 fp AS (SELECT contig, pos, max(rank) AS rank FROM (SELECT contig, rank, unnest(range(s, e + 1)) AS pos FROM feat WHERE s <= e) x GROUP BY ALL)
 SELECT ['INTERGENIC', 'INTRONIC', 'UTR', 'CODING', 'RIBOSOMAL'][coalesce(rank, 0) + 1] AS locus_function, {n('sum(c)')} AS bases FROM d LEFT JOIN fp USING (contig, pos) GROUP BY 1""", "reads", "genes")
def _(t):
    return A.base_functions(t.reads, t.genes)


COVER = f"""WITH {BLOCKS}, {FEAT}, ex AS (SELECT * FROM feat WHERE rank = 2), kb AS (SELECT contig, ref_start AS bs, ref_start + blen - 1 AS be FROM blocks JOIN reads USING (idx) WHERE {USABLE}),
 o AS (SELECT transcript, sum(least(e, be) - greatest(s, bs) + 1) AS bases FROM ex JOIN kb ON ex.contig = kb.contig AND s <= be AND bs <= e GROUP BY 1), l AS (SELECT gene, transcript, {n('sum(e - s + 1)')} AS length FROM ex GROUP BY ALL),
 cov AS (SELECT gene, transcript, length, {n('coalesce(bases, 0)')} AS bases, {r('coalesce(bases, 0) / length')} AS coverage FROM l LEFT JOIN o USING (transcript))"""


@query("transcript_coverage", f"{COVER} SELECT * FROM cov", "reads", "genes")
def _(t):
    return A.transcript_coverage(t.reads, t.genes)


@query("top_transcripts", f"{COVER}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY coverage DESC, transcript) AS rn FROM cov) x WHERE rn = 1) SELECT gene, transcript, length, bases, coverage FROM (SELECT *, rank() OVER (ORDER BY coverage DESC) AS k FROM b) y WHERE k <= 10", "reads", "genes")
def _(t):
    return A.top_transcripts(A.transcript_coverage(t.reads, t.genes), 10)


@query("rnaseq_strand", f"""WITH h AS (SELECT idx, ((flags & 16 <> 0) <> (flags & 1 = 1 AND flags & 128 <> 0)) = (strand = '-') AS same FROM reads r JOIN genes g ON r.contig = g.contig AND pos BETWEEN tx_start AND tx_end WHERE {USABLE}), o AS (SELECT idx, bool_or(same) AS s, bool_or(NOT same) AS x FROM h GROUP BY idx)
 SELECT {n('count(*) FILTER (s AND NOT x)')} AS correct_strand_reads, {n('count(*) FILTER (x AND NOT s)')} AS incorrect_strand_reads, {n('count(*) FILTER (s AND x)')} AS ambiguous_reads FROM o""", "reads", "genes")
def _(t):
    return A.strand_specificity(t.reads, t.genes)


@query("reference_dictionary_md5", "WITH w AS (SELECT contig, string_agg(bases, '' ORDER BY chunk) AS b FROM reference GROUP BY contig) SELECT contig, CAST(length(b) AS INT) AS length, md5(b) AS md5, contig_name FROM w JOIN contigs USING (contig)", "reference", "contigs")
def _(t):
    return A.sequence_dictionary(t.reference, t.contigs)


@query("extract_sequences", "WITH w AS (SELECT contig, string_agg(bases, '' ORDER BY chunk) AS b FROM reference GROUP BY contig) SELECT name, CASE WHEN strand = '-' THEN translate(reverse(substr(b, start, stop - start + 1)), 'ACGT', 'TGCA') ELSE substr(b, start, stop - start + 1) END AS bases FROM intervals JOIN w USING (contig)", "reference", "intervals")
def _(t):
    return A.extract_sequences(t.reference, t.intervals)


@query("non_n_size", f"SELECT contig, {n("sum(length(replace(bases, 'N', '')))")} AS non_n_bases FROM reference GROUP BY contig", "reference")
def _(t):
    return A.non_n(t.reference)


@query("tile_baits", """WITH t AS (SELECT *, stop - start + 1 AS len FROM intervals), b AS (SELECT *, CAST(unnest(range(1, CASE WHEN len <= 120 THEN 1 ELSE CAST(ceil((len - 120) / 80.0) AS INT) + 1 END + 1)) AS INT) AS i FROM t)
 SELECT contig, CAST(CASE WHEN len <= 120 THEN start - (120 - len) // 2 ELSE least(start + (i - 1) * 80, stop - 119) END AS INT) AS start, CAST(CASE WHEN len <= 120 THEN start - (120 - len) // 2 ELSE least(start + (i - 1) * 80, stop - 119) END + 119 AS INT) AS stop, name || '_' || i AS name FROM b""", "intervals")
def _(t):
    return A.tiled_baits(t.intervals)


SHEET = ("ACGA", "TTCC", "GGAT", "CATG")
NEAR = "list_sort(list_transform(['ACGA', 'TTCC', 'GGAT', 'CATG'], lambda b: {'d': hamming(umi, b), 'b': b}))"


@query("barcode_demux", f"""WITH s AS (SELECT umi, count(*) AS c, count(*) FILTER (flags & 512 = 0) AS pf FROM reads GROUP BY umi), k AS (SELECT *, {NEAR} AS l FROM s), a AS (SELECT *, CASE WHEN l[1].d <= 1 AND l[2].d - l[1].d >= 1 THEN l[1].b ELSE 'NNNN' END AS assigned FROM k)
 SELECT assigned, {n('sum(c)')} AS reads, {n('sum(pf)')} AS pf_reads, {n("coalesce(sum(c) FILTER (l[1].d = 0 AND assigned <> 'NNNN'), 0)")} AS perfect_matches FROM a GROUP BY assigned""", "reads")
def _(t):
    c = t.reads.select(F.col("umi").alias("barcode"), (F.col("flags").bitwiseAND(F.lit(512)) == 0).alias("pf"))
    sheet = t.reads.sparkSession.createDataFrame([(b,) for b in SHEET], "barcode string")
    return A.demultiplex(c, sheet)


@query("lane_metrics", f"WITH t AS (SELECT contig % 8 AS lane, tile, count(*) AS c, count(*) FILTER (flags & 512 = 0) AS pf FROM reads GROUP BY ALL) SELECT lane, {n('count(*)')} AS tiles, {n('sum(c)')} AS total_clusters, {n('sum(pf)')} AS pf_clusters, {r('avg(c)', 4)} AS mean_clusters_per_tile, {r('stddev_samp(c)', 4)} AS sd_clusters_per_tile FROM t GROUP BY lane", "reads")
def _(t):
    return A.lane_metrics(t.reads.select((F.col("contig") % 8).alias("lane"), "tile", (F.col("flags").bitwiseAND(F.lit(512)) == 0).alias("pf")))


@query("basecalling_metrics", f"""WITH t AS (SELECT contig % 8 AS lane, umi AS barcode, tile, count(*) AS c, count(*) FILTER (flags & 512 = 0) AS pf, sum(len) AS b, coalesce(sum(len) FILTER (flags & 512 = 0), 0) AS pb FROM reads GROUP BY ALL)
 SELECT lane, barcode, {n('sum(c)')} AS total_clusters, {n('sum(pf)')} AS pf_clusters, {n('sum(b)')} AS total_bases, {n('sum(pb)')} AS pf_bases, {r('avg(c)', 4)} AS mean_clusters_per_tile, {r('stddev_samp(c)', 4)} AS sd_clusters_per_tile, {r('avg(100.0::DOUBLE * pf / c)', 4)} AS mean_pct_pf_clusters_per_tile, {r('avg(pf)', 4)} AS mean_pf_clusters_per_tile FROM t GROUP BY lane, barcode""", "reads")
def _(t):
    return A.basecalling_metrics(t.reads.select((F.col("contig") % 8).alias("lane"), "tile", F.col("umi").alias("barcode"), (F.col("flags").bitwiseAND(F.lit(512)) == 0).alias("pf"), F.col("len").alias("bases")))


@query("basecall_bytes", f"SELECT CASE WHEN b = 0 THEN '.' ELSE substr('ACGT', b & 3 + 1, 1) END AS base, CASE WHEN b = 0 THEN 2 ELSE b >> 2 END AS quality, {n('count(*)')} AS calls FROM (SELECT CAST((l_partkey * 7 + l_linenumber) % 160 AS INT) AS b FROM lineitem) x GROUP BY ALL".replace("b & 3 + 1", "(b & 3) + 1"))
def _(t):
    calls = t.lineitem.select(((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 160).cast("int").alias("byte"))
    return A.unpack_basecalls(calls).groupBy("base", "quality").agg(F.count(F.lit(1)).alias("calls"))


@query("array_normalize", f"""WITH a AS (SELECT s_suppkey AS id, s_acctbal AS x, s_suppkey * 3.5 AS y FROM supplier), q AS (SELECT id, cos(0.1) * (x - 50.0) + sin(0.1) * (y - 40.0) AS xr, -sin(0.1) * (x - 50.0) + cos(0.1) * (y - 40.0) AS yr FROM a), s AS (SELECT id, (xr - 0.02 * yr) / 1.2 AS xs, yr / 1.2 AS ys FROM q)
 SELECT id, {r('xs + ys', 4)} AS r, {r('CASE WHEN xs = 0 THEN 1.0 ELSE atan(ys / xs) * 2 / pi() END', 4)} AS theta FROM s""")
def _(t):
    raw = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 3.5).alias("y"))
    return A.normalized_intensity(raw).select("id", "r", "theta")


@query("array_call_rate", f"""WITH {G}, c AS (SELECT sample, {r('count(*) FILTER (gq >= 20) / count(*)')} AS call_rate, {r('count(*) FILTER (gq >= 20 AND a <> b) / count(*) FILTER (gq >= 20)')} AS het_rate, {r('count(*) FILTER (gq >= 20 AND contig = 23 AND a <> b) / count(*) FILTER (gq >= 20 AND contig = 23)')} AS x_het_rate FROM g GROUP BY sample)
 SELECT *, CASE WHEN x_het_rate > 0.2 THEN 'Female' ELSE 'Male' END AS reported_sex FROM c""", "variants")
def _(t):
    return A.call_rates(V.genotypes(t.variants.drop("dp")))


@query("zcall_merge", "SELECT s_suppkey AS id, CASE WHEN s_acctbal > 3000 AND s_suppkey % 100 > 40 THEN 'AB' WHEN s_acctbal > 3000 THEN 'AA' WHEN s_suppkey % 100 > 40 THEN 'BB' ELSE 'NC' END AS call FROM supplier")
def _(t):
    raw = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 100).alias("y"))
    return A.thresholded_calls(raw, F.lit(3000), F.lit(40)).select("id", "call")


@query("compare_metrics", f"""WITH a AS (SELECT rg, {n('count(*)')} AS reads, {n('sum(len)')} AS bases FROM reads GROUP BY rg), b AS (SELECT rg, {n('count(*) FILTER (mapq > 1)')} AS reads, {n('sum(len) FILTER (mapq > 1)')} AS bases FROM reads WHERE rg <> 'rg1' GROUP BY rg),
 x AS (SELECT rg, 'reads' AS metric, CAST(reads AS DOUBLE) AS v FROM a UNION ALL SELECT rg, 'bases', bases FROM a), y AS (SELECT rg, 'reads' AS metric, CAST(reads AS DOUBLE) AS v FROM b UNION ALL SELECT rg, 'bases', bases FROM b)
 SELECT coalesce(x.rg, y.rg) AS rg, coalesce(x.metric, y.metric) AS metric, x.v AS value1, y.v AS value2 FROM x FULL JOIN y ON x.rg = y.rg AND x.metric = y.metric WHERE x.v IS NULL OR y.v IS NULL OR abs(x.v - y.v) > 0.015 * abs(x.v)""", "reads")
def _(t):
    s = lambda df: df.groupBy("rg").agg(F.count(F.lit(1)).alias("reads"), F.sum("len").cast("long").alias("bases"))
    return A.compare_metrics(s(t.reads), s(t.reads.filter("mapq > 1 and rg <> 'rg1'")), ["rg"], ["reads", "bases"], 0.015)


@query("cluster_crosscheck", f"""WITH RECURSIVE e AS (SELECT c_custkey AS a, (c_custkey * 7 + 3) % 1500 AS b FROM customer UNION SELECT (c_custkey * 7 + 3) % 1500, c_custkey FROM customer), d AS (SELECT * FROM e WHERE a <> b),
 reach(a, b) AS (SELECT a, b FROM d UNION SELECT reach.a, d.b FROM reach JOIN d ON reach.b = d.a) SELECT a AS node, least(a, min(b)) AS label FROM reach GROUP BY a""")
def _(t):
    e = t.customer.select(F.col("c_custkey").alias("a"), ((F.col("c_custkey") * 7 + 3) % 1500).alias("b"))
    return A.clusters(e)
