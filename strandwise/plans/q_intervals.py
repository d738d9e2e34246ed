"""Queries of operators.intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from .registry import n, query

ISLANDS = lambda src, keys="contig": f"(SELECT {keys}, min(start) AS start, max(stop) AS stop, array_to_string(list_sort(list_distinct(list(name))), '|') AS name, {n('count(*)')} AS members FROM (SELECT *, sum(CASE WHEN b IS NULL OR start > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start, stop, name ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(stop) OVER (PARTITION BY {keys} ORDER BY start, stop, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {src}) x) y GROUP BY {keys}, g)"
MA, MB = f"ma AS {ISLANDS('intervals')}", f"mb AS {ISLANDS('targets')}"
INV = lambda m, out: f"{out} AS (SELECT contig, coalesce(lag(stop) OVER (PARTITION BY contig ORDER BY start), 0) + 1 AS start, start - 1 AS stop FROM {m} UNION ALL SELECT c.contig, coalesce(max(stop), 0) + 1, any_value(c.length) FROM contigs c LEFT JOIN {m} m USING (contig) GROUP BY c.contig), {out}_ AS (SELECT *, '' AS name FROM {out} WHERE start <= stop)"
MEET = lambda a, b, out: f"{out} AS (SELECT a.contig, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop, '' AS name FROM {a} a JOIN {b} b ON a.contig = b.contig AND a.start <= b.stop AND b.start <= a.stop)"
OUT = "contig, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop"


def _out(df):
    return df.select("contig", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query("intervals_merged", f"WITH {MA} SELECT * FROM ma", "intervals")
def _(t):
    return I.merged(t.intervals)


@query("intervals_merged_in_bins", f"WITH {MA} SELECT {OUT} FROM ma", "intervals")
def _(t):
    return _out(I.merged_in_bins(t.intervals, 5000))


@query("intervals_concat", "SELECT contig, start, stop, name FROM intervals UNION ALL SELECT contig, start, stop, name FROM targets", "intervals", "targets")
def _(t):
    return t.intervals.select("contig", "start", "stop", "name").unionByName(t.targets.select("contig", "start", "stop", "name"))


@query("intervals_union", f"WITH u AS (SELECT contig, start, stop, name FROM intervals UNION ALL SELECT contig, start, stop, name FROM targets), m AS {ISLANDS('u')} SELECT {OUT} FROM m", "intervals", "targets")
def _(t):
    return _out(I.union(t.intervals, t.targets))


@query("intervals_intersect", f"WITH {MA}, {MB}, {MEET('ma', 'mb', 'x')}, m AS {ISLANDS('x')} SELECT {OUT} FROM m", "intervals", "targets")
def _(t):
    return _out(I.intersect(t.intervals, t.targets))


@query("intervals_overlaps", "SELECT DISTINCT a.* FROM targets a JOIN intervals b ON a.contig = b.contig AND a.start <= b.stop AND b.start <= a.stop", "intervals", "targets")
def _(t):
    return I.overlapping(t.targets, t.intervals)


@query("intervals_without_overlap", "SELECT * FROM targets a WHERE NOT EXISTS (SELECT 1 FROM intervals b WHERE a.contig = b.contig AND a.start <= b.stop AND b.start <= a.stop)", "intervals", "targets")
def _(t):
    return I.overlapping(t.targets, t.intervals, anti=True)


@query("intervals_overlap_pairs", f"SELECT a.name AS a_name, b.name AS b_name, {n('least(a.stop, b.stop) - greatest(a.start, b.start) + 1')} AS bases FROM targets a JOIN intervals b ON a.contig = b.contig AND a.start <= b.stop AND b.start <= a.stop", "intervals", "targets")
def _(t):
    return I.overlaps(t.targets, t.intervals).select(F.col("a.name").alias("a_name"), F.col("b.name").alias("b_name"), (F.least("a.stop", "b.stop") - F.greatest("a.start", "b.start") + 1).cast("long").alias("bases"))


@query("intervals_invert", f"WITH {MA}, {INV('ma', 'iv')} SELECT {OUT} FROM iv_", "intervals", "contigs")
def _(t):
    return _out(I.invert(t.intervals, t.contigs))


@query("intervals_subtract", f"WITH {MA}, {MB}, {INV('mb', 'iv')}, {MEET('ma', 'iv_', 'x')}, m AS {ISLANDS('x')} SELECT {OUT} FROM m", "intervals", "targets", "contigs")
def _(t):
    return _out(I.subtract(t.intervals, t.targets, t.contigs))


@query("intervals_symdiff", f"WITH {MA}, {MB}, {INV('mb', 'ib')}, {INV('ma', 'ia')}, {MEET('ma', 'ib_', 'x1')}, {MEET('mb', 'ia_', 'x2')}, x AS (SELECT * FROM x1 UNION ALL SELECT * FROM x2), m AS {ISLANDS('x')} SELECT {OUT} FROM m", "intervals", "targets", "contigs")
def _(t):
    return _out(I.symmetric_difference(t.intervals, t.targets, t.contigs))


@query("intervals_pad", "SELECT contig, greatest(start - 100, 1) AS start, least(stop + 50, length) AS stop, strand, name, idx FROM intervals JOIN contigs USING (contig)", "intervals", "contigs")
def _(t):
    return I.padded(t.intervals, t.contigs, 100, 50)


@query("intervals_bands", "SELECT contig, CAST(greatest(start, k * 50) AS INT) AS start, CAST(least(stop, k * 50 + 49) AS INT) AS stop, CASE WHEN stop // 50 > start // 50 THEN name || '.' || (k - start // 50 + 1) ELSE name END AS name FROM (SELECT *, unnest(range(start // 50, stop // 50 + 1)) AS k FROM intervals) x", "intervals")
def _(t):
    return I.bands(t.intervals, 50)


ORDINAL = "WITH o AS (SELECT *, row_number() OVER (ORDER BY contig, start, stop, name) - 1 AS o, count(*) OVER () AS c FROM intervals)"


@query("intervals_scatter_count", f"{ORDINAL} SELECT contig, start, stop, name, strand, idx, CAST(least(o // (c // 7), 6) AS INT) AS part FROM o", "intervals")
def _(t):
    return I.scatter_by_count(t.intervals, 7)


@query("intervals_scatter_spread", f"{ORDINAL} SELECT contig, start, stop, name, strand, idx, CAST(CASE WHEN o < (c % 7) * (c // 7 + 1) THEN o // (c // 7 + 1) ELSE c % 7 + (o - (c % 7) * (c // 7 + 1)) // (c // 7) END AS INT) AS part FROM o", "intervals")
def _(t):
    return I.scatter_by_count(t.intervals, 7, spread=True)


@query("intervals_scatter_subdivided", """WITH p AS (SELECT DISTINCT contig, CAST(unnest(range(start, stop + 1)) AS INT) AS p FROM intervals), q AS (SELECT *, row_number() OVER (ORDER BY contig, p) - 1 AS o, count(*) OVER () AS c FROM p), r AS (SELECT contig, p, least(o // (c // 7), 6) AS part FROM q),
 g AS (SELECT *, p - row_number() OVER (PARTITION BY contig, part ORDER BY p) AS run FROM r) SELECT contig, min(p) AS start, max(p) AS stop, CAST(part AS INT) AS part FROM g GROUP BY contig, part, run""", "intervals")
def _(t):
    return I.scatter_subdivided(t.intervals, 7)


@query("intervals_scatter", "SELECT contig, start, stop, name, CAST(least((sum(stop - start + 1) OVER (ORDER BY contig, start, stop, name ROWS UNBOUNDED PRECEDING) - (stop - start + 1)) * 10 // (SELECT sum(stop - start + 1) FROM intervals), 9) AS INT) AS part FROM intervals", "intervals")
def _(t):
    return I.scatter(t.intervals, 10)


@query("n_runs", f"""WITH b AS (SELECT contig, start + CAST(o AS INT) AS p, substr(bases, CAST(o AS INT) + 1, 1) = 'N' AS is_n FROM (SELECT *, unnest(range(0, length(bases))) AS o FROM reference) x),
 g AS (SELECT *, p - row_number() OVER (PARTITION BY contig, is_n ORDER BY p) AS g FROM b) SELECT contig, is_n, CAST(min(p) AS INT) AS start, CAST(max(p) AS INT) AS stop FROM g GROUP BY contig, is_n, g""", "reference")
def _(t):
    return I.n_runs(t.reference)


@query("intervals_lift", f"""WITH chain AS (SELECT contig, 1 + k * 10000 AS start, k * 10000 + 9900 AS stop, contig * 100 + k AS chain, (contig + 1) % 25 AS to_contig, 500 - k * 3 AS "offset" FROM contigs, range(0, 10) r(k)),
 p AS (SELECT a.name, a.start AS s0, a.stop AS e0, c.chain, c.to_contig, greatest(a.start, c.start) AS s, least(a.stop, c.stop) AS e, c."offset" AS o FROM intervals a JOIN chain c ON a.contig = c.contig AND a.start <= c.stop AND c.start <= a.stop),
 g AS (SELECT name, chain, to_contig, min(s + o) AS to_start, max(e + o) AS to_stop FROM p GROUP BY name, chain, to_contig, s0, e0 HAVING sum(e - s + 1) >= 0.95 * (e0 - s0 + 1))
 SELECT name, CAST(any_value(to_contig) AS BIGINT) AS to_contig, CAST(any_value(to_start) AS BIGINT) AS to_start, CAST(any_value(to_stop) AS BIGINT) AS to_stop FROM g GROUP BY name HAVING count(*) = 1""", "intervals", "contigs")
def _(t):
    k = F.explode(F.expr("sequence(0L, 9L)"))
    chain = t.contigs.select("contig", k.alias("k")).select("contig", (1 + F.col("k") * 10000).alias("start"), (F.col("k") * 10000 + 9900).alias("stop"), (F.col("contig") * 100 + F.col("k")).alias("chain"), ((F.col("contig") + 1) % 25).cast("long").alias("to_contig"), (500 - F.col("k") * 3).alias("offset"))
    return I.lift(t.intervals, chain)


@query("intervals_to_bed", "SELECT contig, start - 1 AS start0, stop AS stop0, name, 500 AS score, strand FROM intervals", "intervals")
def _(t):
    return I.to_bed(t.intervals)


@query("bed_to_intervals", "SELECT contig, start, stop, name, strand FROM intervals", "intervals")
def _(t):
    return I.from_bed(I.to_bed(t.intervals))


