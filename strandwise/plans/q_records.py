"""Queries of operators.records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as X
from .registry import ENDS, n, query

NAMES = "names AS (SELECT DISTINCT name FROM reads WHERE mapq = 7)"
RC = lambda c: f"CASE WHEN flags & 16 <> 0 THEN translate(reverse({c}), 'ACGT', 'TGCA') ELSE {c} END"


def _names(t):
    return t.reads.filter("mapq = 7").select("name")


@query("filter_read_list_in", f"WITH {NAMES} SELECT idx FROM reads WHERE name IN (SELECT name FROM names)", "reads")
def _(t):
    return X.in_list(t.reads, _names(t)).select("idx")


@query("filter_read_list_out", f"WITH {NAMES} SELECT idx FROM reads WHERE name NOT IN (SELECT name FROM names)", "reads")
def _(t):
    return X.in_list(t.reads, _names(t), keep=False).select("idx")


@query("filter_aligned_template", "SELECT idx FROM (SELECT idx, bool_or(flags & 4 = 0) OVER (PARTITION BY name) AS a FROM reads) x WHERE a", "reads")
def _(t):
    return X.by_template_alignment(t.reads).select("idx")


@query("filter_aligned_both", "SELECT idx FROM (SELECT idx, bool_and(flags & 4 = 0) OVER (PARTITION BY name) AS a FROM reads) x WHERE a", "reads")
def _(t):
    return X.by_template_alignment(t.reads, every=True).select("idx")


@query("filter_unaligned_template", "SELECT idx FROM (SELECT idx, bool_or(flags & 4 = 0) OVER (PARTITION BY name) AS a FROM reads) x WHERE NOT a", "reads")
def _(t):
    return X.by_template_alignment(t.reads, aligned=False).select("idx")


@query("filter_paired_intervals", f"WITH {ENDS} SELECT DISTINCT r.idx FROM ends r JOIN targets t ON (flags & 4 = 0 AND r.contig = t.contig AND r.pos <= t.stop AND t.start <= r.stop) OR (flags & 1 = 1 AND flags & 8 = 0 AND mate_contig = t.contig AND mate_pos BETWEEN t.start AND t.stop)", "reads", "targets")
def _(t):
    return X.by_intervals(t.reads, t.targets).select("idx")


@query("filter_tag", "SELECT idx FROM reads WHERE umi IN ('ACGT', 'CCGA', 'TTTT', 'AAAA')", "reads")
def _(t):
    return t.reads.filter(F.col("umi").isin("ACGT", "CCGA", "TTTT", "AAAA")).select("idx")


@query("view_filters", "SELECT idx FROM reads WHERE flags & 4 = 0 AND flags & 512 = 0", "reads")
def _(t):
    return X.view(t.reads, aligned=True, pf=True).select("idx")


@query("stop_after", "SELECT idx, name FROM reads ORDER BY idx LIMIT 100", "reads")
def _(t):
    return X.first_records(t.reads.select("idx", "name"), 100)


@query("sort_coordinate_rank", f"SELECT idx, {n('row_number() OVER (PARTITION BY contig ORDER BY CASE WHEN flags & 4 <> 0 THEN 2147483647 ELSE contig END, pos, flags & 16 <> 0, name, flags, idx)')} AS rank FROM reads", "reads")
def _(t):
    return X.ranked(t.reads, X.coordinate_order(t.reads), "contig", X.coordinate_bucket()).select("idx", "rank")


@query("sort_queryname_rank", f"SELECT idx, {n('row_number() OVER (PARTITION BY rg ORDER BY name, flags & 1 <> 0, flags & 128 <> 0, flags & 2304 <> 0, idx)')} AS rank FROM reads", "reads")
def _(t):
    return X.ranked(t.reads, X.queryname_order(t.reads), "rg").select("idx", "rank")


@query("order_violations", "SELECT idx, pos, before FROM (SELECT idx, pos, lag(pos) OVER (PARTITION BY contig ORDER BY idx) AS before FROM reads) x WHERE pos < before", "reads")
def _(t):
    return X.order_violations(t.reads, "contig", "pos").select("idx", "pos", "before")


MATES = f"""WITH {ENDS}, q AS (SELECT *, CASE WHEN flags & 16 <> 0 THEN stop ELSE pos END AS five, row_number() OVER (PARTITION BY name, flags & 64 ORDER BY idx) AS rn FROM ends WHERE flags & 1 = 1 AND flags & 2304 = 0),
 m AS (SELECT a.idx AS ai, b.idx AS bi, a.contig AS ac, b.contig AS bc, a.pos AS ap, b.pos AS bp, a.flags AS af, b.flags AS bf, a.cigar AS ag, b.cigar AS bg, a.mapq AS aq, b.mapq AS bq, a.five AS a5, b.five AS b5, a.mate_pos AS amp, a.mate_contig AS amc FROM q a JOIN q b ON a.name = b.name AND a.rn = 1 AND b.rn = 1 AND a.flags & 64 <> 0 AND b.flags & 64 = 0),
 s AS (SELECT *, CASE WHEN ac = bc THEN b5 - a5 + CASE WHEN b5 >= a5 THEN 1 ELSE -1 END ELSE 0 END AS size FROM m)"""


@query("fix_mate", f"{MATES} SELECT ai AS idx, bc AS mate_contig, bp AS mate_pos, bf & 16 <> 0 AS mate_reverse, bg AS mc, bq AS mq, CAST(size AS INT) AS tlen FROM s UNION ALL SELECT bi, ac, ap, af & 16 <> 0, ag, aq, CAST(-size AS INT) FROM s", "reads")
def _(t):
    return X.fixed_mates(t.reads)


@query("validate_mates", f"""{MATES}, e AS (SELECT 'MISMATCH_MATE_ALIGNMENT_START' AS error FROM m WHERE amp <> bp UNION ALL SELECT 'MISMATCH_MATE_REF_INDEX' FROM m WHERE amc <> bc UNION ALL SELECT 'MISMATCH_FLAG_MATE_NEG_STRAND' FROM m WHERE (af & 32 <> 0) <> (bf & 16 <> 0)
 UNION ALL SELECT 'MISMATCH_FLAG_MATE_UNMAPPED' FROM m WHERE (af & 8 <> 0) <> (bf & 4 <> 0)) SELECT error, {n('count(*)')} AS pairs FROM e GROUP BY error""", "reads")
def _(t):
    return X.mate_errors(t.reads)


@query("validate_summary", f"""WITH e AS (SELECT 'INVALID_FLAG_NOT_PRIM_ALIGNMENT' AS error FROM reads WHERE flags & 4 <> 0 AND flags & 256 <> 0 UNION ALL SELECT 'INVALID_FLAG_SUPPLEMENTARY_ALIGNMENT' FROM reads WHERE flags & 4 <> 0 AND flags & 2048 <> 0 UNION ALL SELECT 'INVALID_MAPPING_QUALITY' FROM reads WHERE flags & 4 <> 0 AND mapq <> 0
 UNION ALL SELECT 'INVALID_FLAG_PROPER_PAIR' FROM reads WHERE flags & 1 = 0 AND flags & 2 <> 0 UNION ALL SELECT 'INVALID_FLAG_FIRST_OF_PAIR' FROM reads WHERE flags & 1 = 0 AND flags & 64 <> 0) SELECT error, {n('count(*)')} AS records FROM e GROUP BY error""", "reads")
def _(t):
    return X.validate(t.reads)


@query("clean_clip", f"WITH {ENDS} SELECT idx, CASE WHEN flags & 4 <> 0 THEN 0 ELSE mapq END AS mapq, CASE WHEN flags & 4 <> 0 THEN 0 ELSE greatest(stop - length, 0) END AS clip FROM ends JOIN contigs USING (contig)", "reads", "contigs")
def _(t):
    return X.cleaned(t.reads, t.contigs)


@query("revert_sam", f"SELECT idx, name, CAST((flags & 705) | 4 | CASE WHEN flags & 1 = 1 THEN 8 ELSE 0 END AS INT) AS flags, {RC('bases')} AS bases, array_to_string(CASE WHEN flags & 16 <> 0 THEN list_reverse(quals) ELSE quals END, ',') AS quals FROM reads WHERE flags & 2304 = 0", "reads")
def _(t):
    return X.reverted(t.reads).withColumn("quals", F.array_join(F.transform("quals", lambda q: q.cast("string")), ","))


@query("add_oa", "SELECT idx, CASE WHEN flags & 4 = 0 THEN concat_ws(',', contig_name, pos, CASE WHEN flags & 16 <> 0 THEN '-' ELSE '+' END, cigar, mapq, nm || ';') END AS oa FROM reads JOIN contigs USING (contig)", "reads", "contigs")
def _(t):
    return X.original_alignment(t.reads, t.contigs)


FASTQ = f"SELECT idx, name || CASE WHEN flags & 1 = 1 THEN CASE WHEN flags & 64 <> 0 THEN '/1' ELSE '/2' END ELSE '' END AS read_name, {RC('bases')} AS bases, array_to_string(list_transform(CASE WHEN flags & 16 <> 0 THEN list_reverse(quals) ELSE quals END, lambda q: chr(q + 33)), '') AS qualities FROM reads WHERE flags & 2304 = 0"


@query("sam_to_fastq", FASTQ, "reads")
def _(t):
    return X.fastq(t.reads)


@query("fastq_to_sam", f"SELECT idx, name, CAST(CASE WHEN flags & 1 = 0 THEN 4 WHEN flags & 64 <> 0 THEN 77 ELSE 141 END AS INT) AS flags, {RC('bases')} AS bases, array_to_string(CASE WHEN flags & 16 <> 0 THEN list_reverse(quals) ELSE quals END, ',') AS quals FROM reads WHERE flags & 2304 = 0", "reads")
def _(t):
    return X.from_fastq(X.fastq(t.reads)).withColumn("quals", F.array_join(F.transform("quals", lambda q: q.cast("string")), ","))


@query("quality_trim", """WITH p AS (SELECT idx, len, CAST(unnest(range(1, len + 1)) AS INT) AS i, quals FROM reads), c AS (SELECT idx, len, i, sum(20 - quals[i]) OVER (PARTITION BY idx ORDER BY i DESC) AS s FROM p),
 d AS (SELECT *, min(s) OVER (PARTITION BY idx ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM c), g AS (SELECT idx, arg_max(i, s * 1000 + i) AS i, max(s) AS s FROM d WHERE low IS NULL OR low >= 0 GROUP BY idx)
 SELECT r.idx, len AS length, CAST(CASE WHEN s > 0 THEN i - 1 ELSE len END AS INT) AS kept FROM reads r LEFT JOIN g USING (idx)""", "reads")
def _(t):
    return X.trimmed(t.reads, 20)


@query("adapter_mark", "WITH o AS (SELECT idx, bases, CAST(unnest(range(0, length(bases) - 3)) AS INT) AS i FROM reads), e AS (SELECT idx, i, least(8, length(bases) - i) AS k, substr(bases, i + 1, least(8, length(bases) - i)) AS w FROM o), m AS (SELECT idx, i FROM e WHERE hamming(w, substr('TGGCATGG', 1, k)) <= floor(0.1 * k)) SELECT idx, coalesce(max(i), -1) AS adapter_start FROM reads LEFT JOIN m USING (idx) GROUP BY idx", "reads")
def _(t):
    return X.adapter_start(t.reads, "TGGCATGG").fillna(-1)


@query("read_group_checksum", f"SELECT rg, {n('count(*)')} AS records, bit_xor(CAST('0x' || substr(md5(name || '|' || flags || '|' || bases), 1, 15) AS BIGINT)) AS checksum FROM reads GROUP BY rg", "reads")
def _(t):
    return X.checksum(t.reads)


@query("downsample_hash", "SELECT idx FROM reads WHERE CAST('0x' || substr(md5(name), 1, 8) AS BIGINT) < 1288490188", "reads")
def _(t):
    return X.downsample_hash(t.reads, 0.3).select("idx")


@query("downsample_exact", "WITH k AS (SELECT DISTINCT rg, name FROM reads), r AS (SELECT *, row_number() OVER (PARTITION BY rg ORDER BY md5(name), name) AS rank, count(*) OVER (PARTITION BY rg) AS c FROM k) SELECT rg, name FROM r WHERE rank <= floor(c * 0.4)", "reads")
def _(t):
    return X.downsample_exact(t.reads, 0.4)


@query("downsample_mask", "SELECT idx FROM reads WHERE (x - 200.0) * (x - 200.0) + (y - 150.0) * (y - 150.0) <= 0.3 * 400 * 300 / 3.141592653589793", "reads")
def _(t):
    return X.downsample_circle(t.reads, 400, 300, 0.3).select("idx")


CMP = lambda s, w: f"(SELECT name, flags & 64 <> 0 AS f, arg_min(flags & 4 <> 0, idx) AS u, arg_min(contig, idx) AS c, arg_min(pos, idx) AS p, arg_min(flags & 16 <> 0, idx) AS r, arg_min(flags & 1024 <> 0, idx) AS d FROM {s} WHERE flags & 2304 = 0 AND {w} GROUP BY 1, 2)"


@query("compare_records", f"""WITH j AS (SELECT a.f IS NOT NULL AS ia, b.f IS NOT NULL AS ib, a.u AS au, b.u AS bu, a.c = b.c AND a.p = b.p AND a.r = b.r AS same, a.d AS ad, b.d AS bd FROM {CMP('reads', 'mapq > 10')} a FULL JOIN {CMP('reads', 'mapq < 40')} b ON a.name = b.name AND a.f = b.f)
 SELECT {n('count(*) FILTER (NOT au AND NOT bu AND same)')} AS mappings_match, {n('count(*) FILTER (NOT au AND NOT bu AND NOT same)')} AS mappings_differ, {n('count(*) FILTER (au AND bu)')} AS unmapped_both, {n('count(*) FILTER (au AND NOT bu)')} AS unmapped_left, {n('count(*) FILTER (NOT au AND bu)')} AS unmapped_right,
 {n('count(*) FILTER (NOT ia)')} AS missing_left, {n('count(*) FILTER (NOT ib)')} AS missing_right, {n('count(*) FILTER (ad <> bd)')} AS duplicate_markings_differ FROM j""", "reads")
def _(t):
    return X.compare(t.reads.filter("mapq > 10"), t.reads.filter("mapq < 40"))


def _hit(strategy: str, order: str) -> None:
    @query(f"merge_alignment_{strategy.lower()}", f"WITH k AS (SELECT idx, name, row_number() OVER (PARTITION BY name ORDER BY {order}, idx) AS rn FROM reads WHERE flags & 4 = 0) SELECT idx, name FROM k WHERE rn = 1", "reads")
    def _(t):
        return X.primary_hit(t.reads, strategy).select("idx", "name")


_hit("BestMapq", "mapq DESC")
_hit("EarliestFragment", "CASE ck WHEN 3 THEN 4 WHEN 5 THEN 5 ELSE 0 END")
_hit("MostDistant", "abs(tlen) DESC")
