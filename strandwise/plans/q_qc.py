"""Queries of operators.qc."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import qc
from .registry import ENDS, n, query, r

P = "WHERE flags & 2304 = 0"
Q = lambda t: f"len(list_filter(quals, lambda q: q >= {t}))"
YIELD = lambda *q: f"""{n('count(*)')} AS total_reads, {n('count(*) FILTER (flags & 512 = 0)')} AS pf_reads, {n('sum(len)')} AS total_bases, {n('coalesce(sum(len) FILTER (flags & 512 = 0), 0)')} AS pf_bases,
  {', '.join(f"{n(f'sum({Q(t)})')} AS q{t}_bases, {n(f'coalesce(sum({Q(t)}) FILTER (flags & 512 = 0), 0)')} AS pf_q{t}_bases" for t in q)},
  {n('sum(list_sum(quals)) // 20')} AS q20_equivalent_yield, {n('coalesce(sum(list_sum(quals)) FILTER (flags & 512 = 0), 0) // 20')} AS pf_q20_equivalent_yield, {n('sum(len) // count(*)')} AS read_length"""  # noqa: E731


@query("quality_yield", f"SELECT rg, {YIELD(20, 30)} FROM reads {P} GROUP BY rg", "reads")
def _(t):
    return qc.quality_yield(t.reads, ["rg"])


@query("quality_yield_q40", f"SELECT {YIELD(20, 30, 40)} FROM reads {P}", "reads")
def _(t):
    return qc.quality_yield(t.reads, thresholds=(20, 30, 40))


SUMS = "total_reads pf_reads total_bases pf_bases q20_bases pf_q20_bases q30_bases pf_q30_bases q20_equivalent_yield pf_q20_equivalent_yield".split()


@query("accumulate_yield", f"WITH y AS (SELECT rg, {YIELD(20, 30)} FROM reads {P} GROUP BY rg) SELECT {', '.join(f'{n(f'sum({c})')} AS {c}' for c in SUMS)}, {n('sum(total_bases) // sum(total_reads)')} AS read_length FROM y", "reads")
def _(t):
    return qc.accumulate_yield(qc.quality_yield(t.reads, ["rg"]))


@query("quality_score_distribution", f"SELECT quality, {n('count(*)')} AS bases FROM (SELECT unnest(quals) AS quality FROM reads {P}) GROUP BY quality", "reads")
def _(t):
    return qc.quality_distribution(t.reads)


CYCLES = lambda more: f"""WITH cyc AS (SELECT flags, CASE WHEN flags & 1 <> 0 AND flags & 128 <> 0 THEN 2 ELSE 1 END AS read_end, CASE WHEN flags & 16 <> 0 THEN len - o ELSE o + 1 END + CASE WHEN flags & 1 <> 0 AND flags & 128 <> 0 THEN (SELECT max(len) FROM reads {P} AND flags & 129 <> 129 {more}) ELSE 0 END AS cycle,
  CASE WHEN flags & 16 <> 0 THEN translate(substr(bases, o + 1, 1), 'ACGT', 'TGCA') ELSE substr(bases, o + 1, 1) END AS base, quals[o + 1] AS quality FROM (SELECT *, CAST(unnest(range(0, len)) AS INT) AS o FROM reads {P} {more}) x)"""  # noqa: E731


@query("mean_quality_by_cycle", f"{CYCLES('')} SELECT read_end, cycle, {r('sum(quality) / count(*)')} AS mean_quality FROM cyc GROUP BY ALL", "reads")
def _(t):
    return qc.mean_quality_by_cycle(t.reads)


@query("base_distribution_by_cycle", f"{CYCLES('AND flags & 512 = 0')} SELECT read_end, cycle, {', '.join(r(f'100.0::DOUBLE * count(*) FILTER (base = {chr(39)}{b}{chr(39)}) / count(*)') + f' AS pct_{b.lower()}' for b in 'ACGTN')} FROM cyc GROUP BY read_end, cycle", "reads")
def _(t):
    return qc.base_distribution_by_cycle(t.reads)


INS = f"""WITH {ENDS}, ins AS (SELECT *, abs(tlen) AS insert_size, CASE WHEN (flags & 16 <> 0) = (flags & 32 <> 0) THEN 'TANDEM'
  WHEN (CASE WHEN flags & 16 <> 0 THEN mate_pos ELSE pos END) < (CASE WHEN flags & 16 <> 0 THEN stop ELSE pos + tlen END) THEN 'FR' ELSE 'RF' END AS orientation
  FROM ends WHERE flags & 1 <> 0 AND flags & 12 = 0 AND flags & 64 = 0 AND flags & 2304 = 0 AND flags & 1024 = 0 AND tlen <> 0 AND contig = mate_contig)"""


def _stats(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""{INS}, med AS (SELECT {k}orientation, quantile_cont(insert_size, 0.5) AS median FROM ins GROUP BY ALL),
 modes AS (SELECT {k}orientation, insert_size AS mode, row_number() OVER (PARTITION BY {k}orientation ORDER BY count(*) DESC, insert_size) AS rn FROM ins GROUP BY {k}orientation, insert_size)
SELECT {', '.join(f'ins.{x.strip()}' for x in keys.split(',')) + ',' if keys else ''} ins.orientation, {n('count(*)')} AS n, min(insert_size) AS min, max(insert_size) AS max, {r('avg(insert_size)', 4)} AS mean, {r('stddev_samp(insert_size)', 4)} AS sd,
 CAST(quantile_cont(insert_size, 0.5) AS DOUBLE) AS median, any_value(mode) AS mode, CAST(quantile_cont(abs(insert_size - med.median), 0.5) AS DOUBLE) AS mad
FROM (SELECT *, count(*) OVER (PARTITION BY {k}orientation) AS mine, count(*) OVER ({f'PARTITION BY {keys}' if keys else ''}) AS every FROM ins) ins JOIN med USING ({k}orientation) JOIN (SELECT * FROM modes WHERE rn = 1) USING ({k}orientation) WHERE mine >= every * 0.05 GROUP BY {', '.join(f'ins.{x.strip()}' for x in keys.split(',')) + ',' if keys else ''} ins.orientation"""


@query("insert_size_stats", _stats(""), "reads")
def _(t):
    return qc.insert_size_stats(t.reads)


@query("insert_size_by_library", _stats("library"), "reads")
def _(t):
    return qc.insert_size_stats(t.reads, ["library"])


@query("insert_size_widths", f"""{INS}, med AS (SELECT orientation, CAST(trunc(quantile_cont(insert_size, 0.5)) AS INT) AS m, count(*) AS total FROM ins GROUP BY 1),
 d AS (SELECT orientation, total, abs(insert_size - m) AS d FROM ins JOIN med USING (orientation)), c AS (SELECT orientation, total, d, count(*) OVER (PARTITION BY orientation ORDER BY d) AS cum FROM d)
 SELECT orientation, {', '.join(f"{n(f'2 * min(d) FILTER (cum * 100 >= total * {s}) + 1')} AS width_{s}" for s in (10, 50, 90, 99))} FROM c GROUP BY orientation""", "reads")
def _(t):
    return qc.insert_size_widths(t.reads)


@query("reads_by_level", f"""SELECT sample, library, rg, CASE WHEN grouping(sample) = 1 THEN 'ALL_READS' WHEN grouping(library) = 1 THEN 'SAMPLE' WHEN grouping(rg) = 1 THEN 'LIBRARY' ELSE 'READ_GROUP' END AS level,
 {n('count(*)')} AS reads, {n('sum(len)')} AS bases FROM reads GROUP BY GROUPING SETS ((), (sample), (sample, library), (sample, library, rg))""", "reads")
def _(t):
    return qc.by_level(t.reads, qc.LEVELS, F.count(F.lit(1)).alias("reads"), F.sum("len").cast("long").alias("bases"))


def _summary(keys: str) -> str:
    g = lambda a, b: r(f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / ({b}) END")
    s = lambda c, v: f"coalesce(sum({v}) FILTER ({c}), 0)"
    return f"""WITH {ENDS}, s AS (SELECT *, unnest(CASE WHEN flags & 1 = 0 THEN ['UNPAIRED'] WHEN flags & 64 <> 0 THEN ['FIRST_OF_PAIR', 'PAIR'] ELSE ['SECOND_OF_PAIR', 'PAIR'] END) AS category,
  flags & 512 = 0 AS pf, flags & 516 = 0 AS al, flags & 516 = 0 AND mapq >= 20 AS hq, flags & 516 = 0 AND flags & 1 = 1 AND flags & 8 = 0 AS ip,
  CASE WHEN ck IN (3, 4) THEN 4 ELSE 0 END AS soft, CASE WHEN ck = 5 THEN 5 ELSE 0 END AS hard, CASE WHEN ck IN (1, 2, 7) THEN 1 ELSE 0 END AS indels FROM ends {P})
SELECT {keys} category, {n('count(*)')} AS total_reads, {n('count(*) FILTER (pf)')} AS pf_reads, {n('count(*) FILTER (al)')} AS pf_reads_aligned, {n(s('al', 'aligned'))} AS pf_aligned_bases, {n('count(*) FILTER (hq)')} AS pf_hq_aligned_reads, {n(s('hq', 'aligned'))} AS pf_hq_aligned_bases,
 {n('count(*) FILTER (ip)')} AS reads_aligned_in_pairs, {n('count(*) FILTER (ip AND flags & 2 = 0)')} AS pf_reads_improper_pairs, {g('count(*) FILTER (al)', 'count(*) FILTER (pf)')} AS pct_pf_reads_aligned, {g(s('al', 'indels'), s('al', 'aligned'))} AS pf_indel_rate,
 {r('sum(len) / count(*)', 4)} AS mean_read_length, max(len) AS max_read_length, {g('count(*) FILTER (al AND flags & 16 = 0)', 'count(*) FILTER (al)')} AS strand_balance, {g('count(*) FILTER (ip AND (contig <> mate_contig OR abs(tlen) > 100000))', 'count(*) FILTER (ip)')} AS pct_chimeras,
 {g(s('al', 'soft'), s('pf', 'len'))} AS pct_softclip, {g(s('al', 'hard'), s('pf', 'len'))} AS pct_hardclip FROM s GROUP BY {keys} category"""


@query("alignment_summary", _summary(""), "reads")
def _(t):
    return qc.alignment_summary(t.reads)


@query("alignment_summary_read_group", _summary("rg,"), "reads")
def _(t):
    return qc.alignment_summary(t.reads, ["rg"])


@query("read_length_hist", f"SELECT len AS length, flags & 4 <> 0 AS unmapped, {n('count(*)')} AS reads FROM reads {P} GROUP BY ALL", "reads")
def _(t):
    return qc.read_length_histogram(t.reads)


@query("flow_yield", f"""WITH b AS (SELECT idx, o, substr(bases, o + 1, 1) AS c, CASE WHEN o = 0 THEN '' ELSE substr(bases, o, 1) END AS p FROM (SELECT *, CAST(unnest(range(0, len)) AS INT) AS o FROM reads {P}) x),
 runs AS (SELECT idx, o, instr('TGCA', c) AS f FROM b WHERE c <> p AND c <> 'N'), st AS (SELECT idx, f, lag(f) OVER (PARTITION BY idx ORDER BY o) AS pf FROM runs)
 SELECT (SELECT {n('count(*)')} FROM reads {P}) AS total_reads, {n('count(*)')} AS called_flows, {n('sum(CASE WHEN pf IS NULL THEN f ELSE ((f - pf - 1) % 4 + 4) % 4 + 1 END)')} AS flows FROM st""", "reads")
def _(t):
    return qc.flow_yield(t.reads)
