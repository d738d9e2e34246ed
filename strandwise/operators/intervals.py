"""Interval algebra: merging, complement, overlap joins, set operations, padding, bands, scatter, lifting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("contig", "start", "stop")


def merged(intervals: DataFrame, keys: tuple[str, ...] = ("contig",), gap: int = 1) -> DataFrame:
    """Overlapping and abutting intervals joined: running ends find where an island begins, a running count numbers islands.

    Adds name: the members' distinct names, sorted, by ``|``. A group (contig) is sorted in one task; see ``merged_in_bins`` for data where that is too much.
    """
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = intervals.withColumn("_new", F.when(F.col("start") > before + gap, 1).when(before.isNull(), 1).otherwise(0))
    island = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("name"), F.count(F.lit(1)).alias("members")).drop("_island")


def merged_in_bins(intervals: DataFrame, width: int = 1_000_000) -> DataFrame:
    """``merged`` without names in two steps: islands of the pieces of each bin, then of the far fewer pieces of a contig."""
    cut = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    cut = cut.withColumn("start", F.greatest("start", F.col("_bin") * width)).withColumn("stop", F.least("stop", F.col("_bin") * width + width - 1)).withColumn("name", F.lit(""))
    return merged(merged(cut, ("contig", "_bin"))).select(*KEYS)


def overlaps(a: DataFrame, b: DataFrame, width: int = 1000) -> DataFrame:
    """Pairs of overlapping intervals as structs a and b: both sides meet in bins of ``width``; a pair is kept in the bin of its later start alone, so none repeats."""
    left = a.select(F.struct(*a.columns).alias("a"), F.col("contig"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))).alias("bin"))
    right = b.select(F.struct(*b.columns).alias("b"), F.col("contig"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))).alias("bin"))
    joined = left.join(right, ["contig", "bin"])
    first = F.greatest("a.start", "b.start")
    return joined.filter((F.col("a.start") <= F.col("b.stop")) & (F.col("b.start") <= F.col("a.stop")) & (F.col("bin") == F.floor(first / width))).select("contig", "a", "b")


def overlapping(a: DataFrame, b: DataFrame, width: int = 1000, anti: bool = False) -> DataFrame:
    """The intervals of ``a`` that overlap any of ``b`` (or none, with ``anti``). ``b`` is merged first, which bounds what meets in a bin."""
    hit = overlaps(a, merged_in_bins(b), width).select("a.*").distinct()
    return a.join(hit.select(*KEYS, "name"), [*KEYS, "name"], "left_anti") if anti else hit


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merged common stretches of two lists."""
    common = overlaps(merged_in_bins(a), merged_in_bins(b)).select("contig", F.greatest("a.start", "b.start").alias("start"), F.least("a.stop", "b.stop").alias("stop"))
    return merged_in_bins(common)


def union(*lists: DataFrame) -> DataFrame:
    every = lists[0].select(*KEYS)
    for x in lists[1:]:
        every = every.unionByName(x.select(*KEYS))
    return merged_in_bins(every)


def invert(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """What of each contig no interval covers. Whole contigs without intervals included."""
    m = merged_in_bins(intervals)
    w = Window.partitionBy("contig").orderBy("start")
    gaps = m.select("contig", (F.coalesce(F.lag("stop").over(w), F.lit(0)) + 1).alias("start"), (F.col("start") - 1).alias("stop"))
    tails = contigs.join(m.groupBy("contig").agg(F.max("stop").alias("last")), "contig", "left").select("contig", (F.coalesce("last", F.lit(0)) + 1).alias("start"), F.col("length").alias("stop"))
    return gaps.unionByName(tails).filter("start <= stop").select("contig", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))


def subtract(a: DataFrame, b: DataFrame, contigs: DataFrame) -> DataFrame:
    return intersect(a, invert(b, contigs))


def symmetric_difference(a: DataFrame, b: DataFrame, contigs: DataFrame) -> DataFrame:
    return union(subtract(a, b, contigs), subtract(b, a, contigs))


def padded(intervals: DataFrame, contigs: DataFrame, before: int, after: int) -> DataFrame:
    """Both ends moved out (or in, if negative), clamped to the contig; empty ones dropped. Contigs are a small dictionary."""
    j = intervals.join(F.broadcast(contigs.select("contig", "length")), "contig")
    return j.withColumn("start", F.greatest(F.col("start") - before, F.lit(1))).withColumn("stop", F.least(F.col("stop") + after, F.col("length"))).filter("start <= stop").drop("length")


def bands(intervals: DataFrame, width: int) -> DataFrame:
    """Broken at multiples of ``width``; pieces of a broken interval are named name.1, name.2 and so on."""
    first = F.floor(F.col("start") / width)
    x = intervals.withColumn("_k", F.explode(F.sequence(first, F.floor(F.col("stop") / width)))).withColumn("_first", first)
    many = F.floor(F.col("stop") / width) > F.col("_first")
    name = F.when(many, F.concat_ws(".", "name", (F.col("_k") - F.col("_first") + 1).cast("string"))).otherwise(F.col("name"))
    return x.select("contig", F.greatest(F.col("start"), (F.col("_k") * width).cast("int")).alias("start"), F.least(F.col("stop"), (F.col("_k") * width + width - 1).cast("int")).alias("stop"), name.alias("name"))


def scatter(intervals: DataFrame, parts: int) -> DataFrame:
    """Whole intervals dealt in order into ``parts`` lists of near equal bases: by the bases before an interval, summed per contig first."""
    size = F.col("stop") - F.col("start") + 1
    inside = Window.partitionBy("contig").orderBy("start", "stop", "name").rowsBetween(Window.unboundedPreceding, -1)
    totals = intervals.groupBy("contig").agg(F.sum(size).alias("n"))
    heads = totals.withColumn("head", F.coalesce(F.sum("n").over(Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    x = intervals.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(F.broadcast(heads), "contig")
    return x.select("contig", "start", "stop", "name", F.least(F.floor((F.col("head") + F.col("_in")) * parts / F.col("all")), F.lit(parts - 1)).cast("int").alias("part"))


def scatter_by_count(intervals: DataFrame, parts: int, spread: bool = False) -> DataFrame:
    """Whole intervals dealt in order into ``parts`` lists of equal counts: what is left over goes to the last list, or with ``spread`` one each to the first ones."""
    from .rewrite import numbered_records

    n = intervals.count()
    x = numbered_records(intervals.withColumn("_at", F.col("contig").cast("long") * (1 << 32) + F.col("start")), "_at", ties=["stop", "name"])
    each, over = n // parts, n % parts
    o = F.col("ordinal")
    if spread:
        part = F.when(o < over * (each + 1), F.floor(o / (each + 1))).otherwise(over + F.floor((o - over * (each + 1)) / max(each, 1)))
    else:
        part = F.least(F.floor(o / max(each, 1)), F.lit(parts - 1))
    return x.withColumn("part", part.cast("int")).drop("_at", "ordinal")


def scatter_subdivided(intervals: DataFrame, parts: int) -> DataFrame:
    """Merged intervals cut into ``parts`` lists of equal bases, the rest in the last: each is cut wherever a list is full. Bases before an interval are summed up by contig first."""
    m = merged(intervals).select("contig", "start", "stop").withColumn("_size", (F.col("stop") - F.col("start") + 1).cast("long"))
    totals = m.groupBy("contig").agg(F.sum("_size").alias("n"))
    heads = totals.select("contig", F.coalesce(F.sum("n").over(Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_head"), F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    inside = Window.partitionBy("contig").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    x = m.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(heads, "contig").withColumn("_from", F.col("_head") + F.col("_in")).withColumn("_ideal", F.greatest(F.expr(f"_all div {parts}"), F.lit(1)))
    last = F.lit(parts - 1).cast("long")
    x = x.withColumn("part", F.explode(F.sequence(F.least(F.expr("_from div _ideal"), last), F.least(F.expr("(_from + _size - 1) div _ideal"), last))))
    begin = F.greatest(F.col("part") * F.col("_ideal") - F.col("_from"), F.lit(0))
    end = F.when(F.col("part") == last, F.col("_size")).otherwise(F.least((F.col("part") + 1) * F.col("_ideal") - F.col("_from"), F.col("_size")))
    return x.select("contig", (F.col("start") + begin).cast("int").alias("start"), (F.col("start") + end - 1).cast("int").alias("stop"), F.col("part").cast("int").alias("part"))


def n_runs(reference: DataFrame, shortest: int = 1) -> DataFrame:
    """Runs of N and of other bases in a chunked reference: runs of each chunk, joined over chunk borders."""
    found = F.expr(
        "aggregate(regexp_extract_all(bases, '(N+|[^N]+)', 0), named_struct('at', start, 'runs', cast(array() as array<struct<start:int,stop:int,is_n:boolean>>)), "
        "(s, x) -> named_struct('at', s.at + length(x), 'runs', concat(s.runs, array(named_struct('start', s.at, 'stop', s.at + length(x) - 1, 'is_n', startswith(x, 'N'))))), s -> s.runs)"
    )
    runs = reference.select("contig", F.inline(found))
    return merged(runs.withColumn("name", F.lit("")), ("contig", "is_n")).filter(F.col("stop") - F.col("start") + 1 >= shortest).select("contig", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "is_n")


def lift(intervals: DataFrame, chain: DataFrame, min_match: float = 0.95) -> DataFrame:
    """Lift intervals over chain blocks (contig, start, stop, chain, to_contig, offset): covered by exactly one chain to at least ``min_match``, else not at all."""
    hit = overlaps(intervals.select("contig", "start", "stop", "name"), chain)
    part = hit.select(F.col("a.*"), "b.chain", "b.to_contig", F.greatest("a.start", "b.start").alias("s"), F.least("a.stop", "b.stop").alias("e"), "b.offset")
    per = part.groupBy("contig", "start", "stop", "name", "chain", "to_contig").agg(F.sum(F.col("e") - F.col("s") + 1).alias("covered"), F.min(F.col("s") + F.col("offset")).alias("to_start"), F.max(F.col("e") + F.col("offset")).alias("to_stop"))
    good = per.filter(F.col("covered") >= F.lit(min_match) * (F.col("stop") - F.col("start") + 1))
    one = good.groupBy("contig", "start", "stop", "name").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("to_contig", "to_start", "to_stop")).alias("to")).filter("n = 1")
    return one.select("name", "to.to_contig", "to.to_start", "to.to_stop")


def to_bed(intervals: DataFrame) -> DataFrame:
    return intervals.select("contig", (F.col("start") - 1).alias("start0"), F.col("stop").alias("stop0"), "name", F.lit(500).alias("score"), "strand")


def from_bed(bed: DataFrame) -> DataFrame:
    return bed.select("contig", (F.col("start0") + 1).alias("start"), F.col("stop0").alias("stop"), "name", F.coalesce("strand", F.lit("+")).alias("strand"))
