"""Queries of operators.pileup."""

from __future__ import annotations

from ..operators import pileup as P
from .adapt import DUCK
from .registry import BLOCKS, ENDS, n, query, r

USABLE = "flags & 2820 = 0"
KEPT = f"{USABLE} AND mapq >= 20 AND flags & 1024 = 0 AND flags & 1 = 1 AND flags & 8 = 0"
LEN = "CASE ck WHEN 0 THEN len WHEN 5 THEN len WHEN 3 THEN len - 4 WHEN 4 THEN len - 4 WHEN 2 THEN len - 3 ELSE len END"
BASES = f"WITH {BLOCKS}, ab AS (SELECT r.*, read_start + CAST(o AS INT) AS off, ref_start + CAST(o AS INT) AS p FROM (SELECT *, unnest(range(0, blen)) AS o FROM blocks) b JOIN reads r USING (idx)), b AS (SELECT *, substr(bases, off + 1, 1) AS base, quals[off + 1] AS quality FROM ab)"
LENGTH = "(101000 + contig * 100)"
NRUN = lambda p: f"((({p}) - 1) // 500 + contig) % 50 = 7 AND (({p}) - 1) % 500 < 300"
REF = lambda p: f"CASE WHEN {NRUN(p)} THEN 'N' ELSE {DUCK.base('contig', p)} END"
WITH_REF = f"{BASES}, x AS (SELECT *, {REF('p')} AS ref, CASE WHEN p > 1 AND p < {LENGTH} THEN {REF('p - 1')} || {REF('p')} || {REF('p + 1')} END AS context FROM b WHERE p <= {LENGTH} AND {USABLE})"


@query("wgs_fate_partition", f"SELECT CASE WHEN mapq < 20 THEN 'MAPQ' WHEN flags & 1024 <> 0 THEN 'DUPE' WHEN flags & 1 = 0 OR flags & 8 <> 0 THEN 'UNPAIRED' ELSE 'KEPT' END AS fate, {n('count(*)')} AS reads, {n(f'sum({LEN})')} AS bases FROM reads WHERE {USABLE} GROUP BY 1", "reads")
def _(t):
    return P.read_fates(t.reads)


DEPTH = f"""{BASES}, k AS (SELECT *, quality < 20 OR base = 'N' AS bad FROM b WHERE {KEPT}), f AS (SELECT contig, p, bad, row_number() OVER (PARTITION BY contig, p, name, bad ORDER BY idx, off) AS rn FROM k),
 d AS (SELECT contig, p AS pos, {n('count(*) FILTER (bad)')} AS baseq, {n('count(*) FILTER (NOT bad AND rn > 1)')} AS overlap, {n('count(*) FILTER (NOT bad AND rn = 1)')} AS raw_depth FROM f GROUP BY contig, p),
 dd AS (SELECT *, least(raw_depth, 250) AS depth, raw_depth - least(raw_depth, 250) AS capped FROM d),
 h AS (SELECT depth, {n('count(*)')} AS positions FROM dd WHERE depth > 0 GROUP BY depth), hist AS (SELECT * FROM h UNION ALL SELECT 0, {n('2555000 - coalesce(sum(positions), 0)')} FROM h)"""


@query("wgs_base_fates", f"{DEPTH} SELECT {', '.join(f'{n(f'sum({c})')} AS {c}' for c in ('baseq', 'overlap', 'depth', 'capped'))} FROM dd", "reads")
def _(t):
    d = P.base_fates(t.reads)
    return d.agg(*(P.F.sum(c).cast("long").alias(c) for c in ("baseq", "overlap", "depth", "capped")))


TERRITORY = sum(101_000 + 100 * i for i in range(25))


@query("wgs_depth_hist", f"{DEPTH} SELECT * FROM hist", "reads")
def _(t):
    return P.depth_histogram(P.base_fates(t.reads), TERRITORY)


@query("wgs_metrics", f"""{DEPTH}, e AS (SELECT CAST(unnest(range(0, positions)) AS BIGINT) AS i, depth FROM hist) SELECT {n('count(*)')} AS territory, {r('avg(depth)')} AS mean_coverage, {r('stddev_samp(depth)', 4)} AS sd_coverage, CAST(quantile_cont(depth, 0.5) AS DOUBLE) AS median_coverage,
 CASE WHEN quantile_cont(depth, 0.2) = 0 THEN NULL ELSE {r('avg(depth) / quantile_cont(depth, 0.2)', 4)} END AS fold_80_base_penalty, {', '.join(r(f'count(*) FILTER (depth >= {t}) / count(*)') + f' AS pct_{t}x' for t in (1, 5, 10, 15, 20, 25, 30))} FROM e""", "reads")
def _(t):
    return P.coverage_metrics(P.depth_histogram(P.base_fates(t.reads), TERRITORY))


@query("per_target_coverage", f"""WITH {BLOCKS}, kb AS (SELECT b.*, r.contig FROM blocks b JOIN reads r USING (idx) WHERE {KEPT}), h AS (SELECT t.name, unnest(range(greatest(t.start, ref_start), least(t.stop, ref_start + blen - 1) + 1)) AS pos FROM targets t JOIN kb ON t.contig = kb.contig AND t.start <= ref_start + blen - 1 AND ref_start <= t.stop),
 d AS (SELECT name, pos, count(*) AS depth FROM h GROUP BY ALL), g AS (SELECT name, sum(depth) AS bases, max(depth) AS max_depth, count(*) AS covered FROM d GROUP BY name)
 SELECT name, {n('stop - start + 1')} AS length, {n('coalesce(bases, 0)')} AS bases, {n('coalesce(max_depth, 0)')} AS max_depth, {n('coalesce(covered, 0)')} AS covered, {r('coalesce(bases, 0) / (stop - start + 1)')} AS mean_coverage FROM targets LEFT JOIN g USING (name)""", "reads", "targets")
def _(t):
    return P.target_coverage(t.reads, t.targets)


@query("panel_metrics", f"""WITH {BLOCKS}, kb AS (SELECT row_number() OVER () AS id, contig, ref_start AS s, ref_start + blen - 1 AS e FROM blocks b JOIN reads r USING (idx) WHERE {KEPT}), tp AS (SELECT DISTINCT contig, unnest(range(start, stop + 1)) AS p FROM targets),
 o AS (SELECT id, count(*) AS on_ FROM (SELECT id, contig, unnest(range(s, e + 1)) AS p FROM kb) x JOIN tp USING (contig, p) GROUP BY id),
 nr AS (SELECT DISTINCT id FROM kb JOIN targets t ON t.contig = kb.contig AND t.start - 250 <= e AND s <= t.stop + 250),
 j AS (SELECT e - s + 1 AS k, coalesce(on_, 0) AS on_, nr.id IS NOT NULL AS near FROM kb LEFT JOIN o USING (id) LEFT JOIN nr ON nr.id = kb.id)
 SELECT {n('sum(on_)')} AS on_bait_bases, {n('sum(CASE WHEN near THEN k - on_ ELSE 0 END)')} AS near_bait_bases, {n('sum(CASE WHEN near THEN 0 ELSE k END)')} AS off_bait_bases, {r('sum(CASE WHEN near THEN k ELSE 0 END) / sum(k)')} AS pct_selected_bases FROM j""", "reads", "targets")
def _(t):
    return P.panel_metrics(t.reads, t.targets)


COMP = lambda c: f"CASE WHEN flags & 16 <> 0 THEN translate({c}, 'ACGT', 'TGCA') ELSE {c} END"
CYC = "CASE WHEN flags & 16 <> 0 THEN len - off ELSE off + 1 END"
NEXT = lambda s: f"CASE WHEN off + CASE WHEN flags & 16 <> 0 THEN {-s} ELSE {s} END BETWEEN 0 AND len - 1 THEN {COMP(f'substr(bases, off + 1 + CASE WHEN flags & 16 <> 0 THEN {-s} ELSE {s} END, 1)')} END"
RUN = "CASE WHEN flags & 16 <> 0 THEN len - off - 1 - length(ltrim(substr(bases, off + 2), base)) ELSE off - length(rtrim(substr(bases, 1, off), base)) END"
STRATA = {
    "all": "'all'", "base_quality": "quality", "cycle": CYC, "gc_content": "floor(100 * (length(regexp_replace(bases, '[^GC]', '', 'g')) / len) + 0.5) / 100.0::DOUBLE", "read_ordinality": "CASE WHEN flags & 1 = 1 THEN CASE WHEN flags & 64 <> 0 THEN 'FIRST' ELSE 'SECOND' END END",
    "read_base": COMP("base"), "pre_dinuc": f"({NEXT(-1)}) || {COMP('ref')}", "homopolymer_length": RUN, "read_direction": "CASE WHEN flags & 16 <> 0 THEN '-' ELSE '+' END",
    "pair_orientation": "CASE WHEN flags & 1 = 1 AND flags & 8 = 0 THEN CASE WHEN (flags & 16 <> 0) = (flags & 32 <> 0) THEN CASE WHEN flags & 16 <> 0 THEN 'R1R2' ELSE 'F1F2' END ELSE CASE WHEN (flags & 64 <> 0) <> (flags & 16 <> 0) THEN 'F1R2' ELSE 'F2R1' END END END",
    "reference_base": COMP("ref"), "post_dinuc": f"{COMP('ref')} || ({NEXT(1)})", "homopolymer": f"CAST({RUN} AS STRING) || ',' || ({NEXT(-1)}) || ',' || {COMP('ref')}", "binned_homopolymer": f"CASE WHEN {RUN} >= 6 THEN 'LONG_HOMOPOLYMER' ELSE 'SHORT_HOMOPOLYMER' END",
    "flowcell_tile": "tile", "insert_length": "least(10 * len, abs(tlen))", "soft_clips": "CASE WHEN ck IN (3, 4) THEN 4 ELSE 0 END", "mismatches_in_read": "nm - CASE WHEN base <> ref THEN 1 ELSE 0 END", "one_base_padded_context": f"({NEXT(-1)}) || {COMP('ref')} || ({NEXT(1)})",
    "read_group": "rg", "mapping_quality": "mapq", "binned_cycle": f"CAST(least(floor(5.0::DOUBLE * (({CYC}) - 1) / len) + 1, 5) AS INT)", "ns_in_read": "length(regexp_replace(bases, '[^N]', '', 'g'))",
    "insertions_in_read": "CASE WHEN ck = 2 THEN 3 ELSE 0 END", "deletions_in_read": "CASE ck WHEN 1 THEN 5 WHEN 7 THEN 2 ELSE 0 END", "indels_in_read": "CASE ck WHEN 2 THEN 3 WHEN 1 THEN 5 WHEN 7 THEN 2 ELSE 0 END", "flowcell_x": "CAST(trunc(x / 2500) AS INT)", "flowcell_y": "CAST(trunc(y / 2500) AS INT)", "two_base_padded_context": f"({NEXT(-2)}) || ({NEXT(-1)}) || {COMP('ref')} || ({NEXT(1)}) || ({NEXT(2)})", "indel_length": "0", "pair_properness": "CASE WHEN flags & 1 = 1 THEN CASE WHEN flags & 2 <> 0 THEN 'PROPER' ELSE 'IMPROPER' END END",
}


def _register(stratum: str) -> None:
    sql = f"""{WITH_REF}, s AS (SELECT {STRATA[stratum]} AS {stratum if stratum != 'all' else '"all"'}, base <> ref AS err FROM x WHERE base <> 'N' AND ref <> 'N') SELECT {stratum if stratum != 'all' else '"all"'}, {n('count(*)')} AS total_bases, {n('count(*) FILTER (err)')} AS error_bases,
 CAST(floor(-10 * log10((count(*) FILTER (err) + 0.001::DOUBLE) / (count(*) + 1)) + 0.5) AS INT) AS q_score FROM s WHERE {stratum if stratum != 'all' else '"all"'} IS NOT NULL GROUP BY 1"""

    @query(f"error_by_{stratum}", sql, "reads")
    def _(t):
        return P.error_counts(t.solid_reads, t.reference, {stratum: P.strata()[stratum]})


for _stratum in STRATA:
    _register(_stratum)


@query("error_by_read_group_and_direction", f"{WITH_REF} SELECT rg AS read_group, {STRATA['read_direction']} AS read_direction, {n('count(*)')} AS total_bases, {n('count(*) FILTER (base <> ref)')} AS error_bases, CAST(floor(-10 * log10((count(*) FILTER (base <> ref) + 0.001::DOUBLE) / (count(*) + 1)) + 0.5) AS INT) AS q_score FROM x WHERE base <> 'N' AND ref <> 'N' GROUP BY 1, 2", "reads")
def _(t):
    s = P.strata()
    return P.error_counts(t.solid_reads, t.reference, {k: s[k] for k in ("read_group", "read_direction")})


@query("indel_error", f"SELECT rg, {n('count(*) FILTER (ck = 2)')} AS num_insertions, {n('3 * count(*) FILTER (ck = 2)')} AS num_inserted_bases, {n('count(*) FILTER (ck IN (1, 7))')} AS num_deletions, {n('sum(CASE ck WHEN 1 THEN 5 WHEN 7 THEN 2 ELSE 0 END)')} AS num_deleted_bases, {n(f'sum({LEN})')} AS aligned_bases FROM reads WHERE {USABLE} GROUP BY rg", "reads")
def _(t):
    return P.indel_errors(t.reads)


@query("overlapping_error", f"""{WITH_REF}, g AS (SELECT contig, p, name, ref, arg_min(base, idx) FILTER (flags & 64 <> 0) AS b1, arg_min(base, idx) FILTER (flags & 64 = 0) AS b2 FROM x WHERE flags & 1 = 1 AND base <> 'N' AND ref <> 'N' GROUP BY ALL)
 SELECT {n('count(*)')} AS positions, {n('count(*) FILTER (b1 <> ref AND b1 = b2)')} AS both_differ_from_reference, {n('count(*) FILTER (b1 <> b2 AND (b1 = ref OR b2 = ref))')} AS one_differs, {n('count(*) FILTER (b1 <> ref AND b2 <> ref AND b1 <> b2)')} AS three_ways FROM g WHERE b1 IS NOT NULL AND b2 IS NOT NULL""", "reads")
def _(t):
    return P.overlapping_errors(t.reads, t.reference)


REV3 = "translate(reverse(context), 'ACGT', 'TGCA')"
OXO = f"(({COMP('ref')}) = 'G') <> (flags & 128 <> 0)"
ALT = "((ref = 'C' AND base = 'A') OR (ref = 'G' AND base = 'T'))"


@query("oxog", f"""{WITH_REF} SELECT library, CASE WHEN ref = 'C' THEN context ELSE {REV3} END AS context, {n('count(*)')} AS total_bases, {n(f'count(*) FILTER (base = ref AND NOT ({OXO}))')} AS ref_nonoxo_bases, {n(f'count(*) FILTER (base = ref AND ({OXO}))')} AS ref_oxo_bases,
 {n(f'count(*) FILTER ({ALT} AND NOT ({OXO}))')} AS alt_nonoxo_bases, {n(f'count(*) FILTER ({ALT} AND ({OXO}))')} AS alt_oxo_bases FROM x WHERE mapq >= 20 AND flags & 1 = 1 AND flags & 1024 = 0 AND ref IN ('C', 'G') AND context IS NOT NULL AND context NOT LIKE '%N%' AND quality >= 20 GROUP BY 1, 2""", "reads")
def _(t):
    return P.oxidation(t.solid_reads, t.reference)


@query("artifact_counts", f"{WITH_REF} SELECT ref AS ref_base, base AS called, context, {n('count(*)')} AS bases, {n('count(*) FILTER (flags & 16 = 0)')} AS forward, {n('count(*) FILTER (flags & 64 <> 0)')} AS first_end FROM x WHERE quality >= 20 AND base <> 'N' AND context IS NOT NULL AND context NOT LIKE '%N%' GROUP BY ALL", "reads")
def _(t):
    return P.artifacts(t.solid_reads, t.reference)


@query("nm_uq_tags", f"""{WITH_REF}, m AS (SELECT idx, count(*) AS k, sum(quality) AS uq FROM x WHERE base <> ref GROUP BY idx) SELECT reads.idx, {n('coalesce(k, 0) + CASE ck WHEN 2 THEN 3 WHEN 1 THEN 5 WHEN 7 THEN 2 ELSE 0 END')} AS nm_new, {n('coalesce(uq, 0)')} AS uq FROM reads LEFT JOIN m USING (idx) WHERE {USABLE}""", "reads")
def _(t):
    return P.nm_uq(t.solid_reads, t.reference)


@query("rrbs_cpg", f"{WITH_REF} SELECT library, {n("count(*) FILTER (context[3] = 'G')")} AS cpg_bases_seen, {n("count(*) FILTER (context[3] = 'G' AND base = 'T')")} AS cpg_bases_converted, {n("count(*) FILTER (context[3] <> 'G')")} AS non_cpg_bases, {n("count(*) FILTER (context[3] <> 'G' AND base = 'T')")} AS non_cpg_converted_bases FROM x WHERE flags & 16 = 0 AND ref = 'C' AND context IS NOT NULL GROUP BY library", "reads")
def _(t):
    return P.methylation(t.solid_reads, t.reference)


GC = f"""WITH {ENDS}, w0 AS (SELECT contig, start + CAST(o AS INT) AS pos, substr(bases, CAST(o AS INT) + 1, 1) AS c FROM (SELECT *, unnest(range(0, length(bases))) AS o FROM reference) x),
 w1 AS (SELECT contig, pos, sum(CASE WHEN c = 'N' THEN 1 ELSE 0 END) OVER w AS nn, sum(CASE WHEN c IN ('G', 'C') THEN 1 ELSE 0 END) OVER w AS k, count(*) OVER w AS size FROM w0 WINDOW w AS (PARTITION BY contig ORDER BY pos ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING)),
 win AS (SELECT contig, pos, CASE WHEN nn <= 4 THEN CAST(k * 100 // (100 - nn) AS INT) ELSE -1 END AS gc FROM w1 WHERE size = 100)"""
BIAS = f"""{GC}, st AS (SELECT contig, CASE WHEN flags & 16 <> 0 THEN stop - 99 ELSE pos END AS pos FROM ends WHERE {USABLE}), sc AS (SELECT contig, pos, count(*) AS s FROM st GROUP BY ALL),
 bias AS (SELECT gc, {n('count(*)')} AS windows, {n('coalesce(sum(s), 0)')} AS read_starts FROM win LEFT JOIN sc USING (contig, pos) WHERE gc >= 0 GROUP BY gc)"""


@query("gc_windows", f"{GC} SELECT gc, {n('count(*)')} AS windows FROM win GROUP BY gc", "reads", "reference")
def _(t):
    return P.gc_windows(t.reference).groupBy("gc").agg(P.F.count(P.F.lit(1)).alias("windows"))


@query("gc_bias", f"{BIAS} SELECT *, {r('(read_starts / windows) / ((SELECT sum(read_starts) FROM bias) / (SELECT sum(windows) FROM bias))')} AS normalized_coverage FROM bias", "reads", "reference")
def _(t):
    return P.gc_bias(t.reads, t.reference)


@query("gc_dropout", f"{BIAS}, d AS (SELECT gc, greatest(100.0::DOUBLE * windows / (SELECT sum(windows) FROM bias) - 100.0::DOUBLE * read_starts / (SELECT sum(read_starts) FROM bias), 0) AS d FROM bias) SELECT {r('coalesce(sum(d) FILTER (gc <= 50), 0)', 4)} AS at_dropout, {r('coalesce(sum(d) FILTER (gc > 50), 0)', 4)} AS gc_dropout FROM d", "reads", "reference")
def _(t):
    return P.gc_dropout(P.gc_bias(t.reads, t.reference))


def _directive(text: str, covariate: str) -> str:
    return f"""SELECT '{text}' AS directive, covariate, {n('count(*)')} AS total_bases, {n('count(*) FILTER (err)')} AS error_bases, CAST(floor(-10 * log10((count(*) FILTER (err) + 0.001::DOUBLE) / (count(*) + 1)) + 0.5) AS INT) AS q_score
 FROM (SELECT {covariate} AS covariate, base <> ref AS err FROM x WHERE base <> 'N' AND ref <> 'N') WHERE covariate IS NOT NULL GROUP BY covariate"""


DIRECTIVES = {"ERROR": "'all'", "ERROR:READ_GROUP": "rg", "ERROR:BASE_QUALITY:READ_DIRECTION": f"CAST(quality AS STRING) || ',' || {STRATA['read_direction']}", "ERROR:ONE_BASE_PADDED_CONTEXT": STRATA["one_base_padded_context"], "ERROR:CYCLE": f"CAST({CYC} AS STRING)"}


@query("error_directives", f"{WITH_REF} {' UNION ALL '.join(_directive(k, v) for k, v in DIRECTIVES.items())}", "reads")
def _(t):
    return P.error_directives(t.solid_reads, t.reference, list(DIRECTIVES))


FLOOR = lambda a, b: f"greatest(CASE WHEN ({b}) = 0 THEN 1e-10 ELSE CAST({a} AS DOUBLE) / ({b}) END, 1e-10)"
CAT = "CASE WHEN flags & 1 = 0 THEN 'UNPAIRED' WHEN flags & 64 <> 0 THEN 'FIRST_OF_PAIR' ELSE 'SECOND_OF_PAIR' END"
EACH = "unnest(CASE WHEN category = 'UNPAIRED' THEN [category] ELSE [category, 'PAIR'] END)"


@query("alignment_errors", f"""WITH {BLOCKS}, ab AS (SELECT r.*, CAST(o AS INT) AS o, read_start + CAST(o AS INT) AS off, ref_start + CAST(o AS INT) AS p FROM (SELECT *, unnest(range(0, blen)) AS o FROM blocks) b JOIN reads r USING (idx) WHERE flags & 2820 = 0),
 x AS (SELECT idx, {CAT} AS category, mapq >= 20 AS hq, quals[off + 1] >= 20 AS q20, substr(bases, off + 1, 1) <> {REF('p')} AS wrong, substr(bases, off + 1, 1) = 'N' AS nocall, CASE WHEN flags & 16 <> 0 THEN len - o ELSE o + 1 END AS cycle FROM ab WHERE p <= {LENGTH}),
 br AS (SELECT category, idx, count(*) AS bases, count(*) FILTER (hq) AS hqb, count(*) FILTER (wrong) AS wrong, count(*) FILTER (wrong AND hq) AS hqw, count(*) FILTER (hq AND q20) AS q20 FROM x GROUP BY ALL), b2 AS (SELECT {EACH} AS category, bases, hqb, wrong, hqw, q20 FROM br),
 rates AS (SELECT category, {r('sum(wrong) / sum(bases)')} AS pf_mismatch_rate, {r('sum(hqw) / sum(hqb)')} AS pf_hq_error_rate, {n('sum(q20)')} AS pf_hq_aligned_q20_bases, CAST(quantile_cont(hqw, 0.5) AS DOUBLE) AS pf_hq_median_mismatches FROM b2 GROUP BY category),
 rr AS (SELECT *, {CAT} AS category FROM reads WHERE flags & 2304 = 0), total AS (SELECT category, count(*) AS total FROM rr GROUP BY category),
 un AS (SELECT category, CASE WHEN flags & 16 <> 0 THEN len - i ELSE i + 1 END AS cycle FROM (SELECT *, CAST(unnest(range(0, len)) AS INT) AS i FROM rr WHERE flags & 516 <> 0) z WHERE substr(bases, i + 1, 1) = 'N'),
 cyc AS (SELECT category, cycle, count(*) AS c FROM (SELECT category, cycle FROM x WHERE wrong OR nocall UNION ALL SELECT * FROM un) GROUP BY ALL), bad AS (SELECT category FROM cyc JOIN total USING (category) WHERE c >= total * 0.8), bad2 AS (SELECT {EACH} AS category FROM bad), bc AS (SELECT category, {n('count(*)')} AS bad_cycles FROM bad2 GROUP BY 1)
 SELECT rates.*, coalesce(bad_cycles, 0) AS bad_cycles FROM rates LEFT JOIN bc USING (category)""", "reads")
def _(t):
    from ..operators import qc

    return qc.alignment_errors(t.reads, t.reference)


RATES = f"""{WITH_REF}, c AS (SELECT context, base, (flags & 128 = 0) = (flags & 16 = 0) AS fits, count(*) AS n FROM x WHERE quality >= 20 AND base <> 'N' AND context IS NOT NULL AND context NOT LIKE '%N%' GROUP BY ALL),
 o AS (SELECT context, base AS called, fits AS pro, true AS fwd, n FROM c UNION ALL SELECT translate(reverse(context), 'ACGT', 'TGCA'), translate(base, 'ACGT', 'TGCA'), NOT fits, false, n FROM c),
 s AS (SELECT context, called, coalesce(sum(n) FILTER (pro), 0) AS pro, coalesce(sum(n) FILTER (NOT pro), 0) AS con, coalesce(sum(n) FILTER (fwd), 0) AS f, coalesce(sum(n) FILTER (NOT fwd), 0) AS r FROM o GROUP BY ALL),
 j AS (SELECT a.context, substr(a.context, 2, 1) AS ref_base, alt_base, coalesce(x.pro, 0) AS pr, coalesce(x.con, 0) AS cr, coalesce(x.f, 0) AS fr, coalesce(x.r, 0) AS rr, coalesce(y.pro, 0) AS pa, coalesce(y.con, 0) AS ca, coalesce(y.f, 0) AS fa, coalesce(y.r, 0) AS ra
   FROM (SELECT DISTINCT context FROM s) a CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) b(alt_base) LEFT JOIN s x ON x.context = a.context AND x.called = substr(a.context, 2, 1) LEFT JOIN s y ON y.context = a.context AND y.called = alt_base WHERE alt_base <> substr(a.context, 2, 1)),
 e AS (SELECT *, {FLOOR('pa - ca', 'pr + cr + pa + ca')} AS pre, greatest({FLOOR('fa', 'fr + fa')} - {FLOOR('ra', 'rr + ra')}, 1e-10) AS bias FROM j)"""
Q10 = lambda p: f"CAST(floor(-10 * log10({p}) + 0.5) AS INT)"


@query("artifact_rates", f"""{RATES} SELECT ref_base, alt_base, context, {n('pr')} AS pro_ref_bases, {n('pa')} AS pro_alt_bases, {n('cr')} AS con_ref_bases, {n('ca')} AS con_alt_bases, {r('pre', 9)} AS error_rate, {Q10('pre')} AS qscore,
 {n('fr')} AS fwd_cxt_ref_bases, {n('fa')} AS fwd_cxt_alt_bases, {n('rr')} AS rev_cxt_ref_bases, {n('ra')} AS rev_cxt_alt_bases, {r('bias', 9)} AS bait_error_rate, {Q10('bias')} AS bait_qscore FROM e""", "reads")
def _(t):
    return P.artifact_rates(t.solid_reads, t.reference)


@query("artifact_worst_contexts", f"""{RATES}, w AS (SELECT *, {r('pre', 9)} AS rate, row_number() OVER (PARTITION BY ref_base, alt_base ORDER BY {r('pre', 9)} DESC, context) AS k FROM e),
 t AS (SELECT ref_base, alt_base, {Q10("greatest(CAST(sum(pa - ca) AS DOUBLE) / sum(pr + pa + cr + ca), 1e-10)")} AS total_qscore FROM e GROUP BY ALL)
 SELECT ref_base, alt_base, context AS worst_cxt, {Q10('pre')} AS worst_cxt_qscore, total_qscore FROM w JOIN t USING (ref_base, alt_base) WHERE k = 1""", "reads")
def _(t):
    return P.worst_contexts(P.artifact_rates(t.solid_reads, t.reference))


COVERAGE = lambda where, hist: f"""SELECT {n('count(*)')} AS territory, {r('avg(depth)')} AS mean_coverage, {r('stddev_samp(depth)', 4)} AS sd_coverage, CAST(quantile_cont(depth, 0.5) AS DOUBLE) AS median_coverage,
 CASE WHEN quantile_cont(depth, 0.2) = 0 THEN NULL ELSE {r('avg(depth) / quantile_cont(depth, 0.2)', 4)} END AS fold_80_base_penalty, {', '.join(r(f'count(*) FILTER (depth >= {t}) / count(*)') + f' AS pct_{t}x' for t in (1, 5, 10, 15, 20, 25, 30))} FROM (SELECT CAST(unnest(range(0, positions)) AS BIGINT) AS i, depth FROM {hist}) {where}"""  # noqa: E731


@query("raw_wgs_metrics", f"{DEPTH.replace('quality < 20', 'quality < 3').replace('mapq >= 20 AND ', '').replace('250', '100000')} {COVERAGE('', 'hist')}", "reads")
def _(t):
    return P.coverage_metrics(P.depth_histogram(P.base_fates(t.reads, min_mapq=0, min_quality=3, cap=100_000), TERRITORY))


@query("wgs_metrics_nonzero", f"{DEPTH} {COVERAGE('WHERE depth > 0', 'hist')}", "reads")
def _(t):
    return P.coverage_metrics(P.depth_histogram(P.base_fates(t.reads), TERRITORY).filter("depth > 0"))
