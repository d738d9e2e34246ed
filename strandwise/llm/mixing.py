"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import materialize, numbered

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source's weight falls or rises linearly over training by this share of it, by its place in WEIGHTS: heavy ones start strong, light ones end strong.
SLOPES = (-0.5, 0.0, 0.5)


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(*cols: Column) -> Column:
    """A fixed pseudo-random order: the first 60 bits of the MD5 of the columns' texts, as a long of 0 or more. SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(source, place, source_size, target): shares of all words by weight; no target above ``cap`` times its source, the excess reshared by weight.

    ``sizes`` has a row per source (source, source_size), so the windows here are over sources, never over documents. The sources at their cap are those
    with the least cap-to-weight ratios: in that order, a source is capped as long as its ratio is below what is left per weight left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.col("place") % len(weights)) + 1).cast("int"))
    s = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    ahead = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(ahead), F.lit(0.0)))
    s = s.withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.col("weights")).withColumn("open", F.col("limit") > F.col("level") * F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), F.col("place"), F.col("level")))).over(everything)["level"]
    return s.select("source", "place", "source_size", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit"))).alias("target"))


def position(share: Column, slope: Column) -> Column:
    """When in training (0 to 1) a source has been asked for this share of its words.

    The schedule 1 + slope * (2t - 1) has mean 1; its integral t + slope * (t^2 - t) is inverted in closed form.
    """
    a = -slope
    root = F.sqrt(F.greatest((1 + a) * (1 + a) - 4 * a * share, F.lit(0.0)))
    return F.when(F.abs(a) < 1e-12, share).otherwise(F.abs((1 + a - root) / (2 * a)))


def _dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, cap: int = 3, whole_rows: bool = False) -> DataFrame:
    """``mix`` without its order; with ``whole_rows`` also _doc, a struct of the row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order_key(F.col(id_col), F.col(text_col)).alias("_h"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")] if whole_rows else []))
    extra = ["_doc"] if whole_rows else []
    sizes = materialize(rows.drop("_doc"), "mix-sizes")
    rows = rows if whole_rows else sizes
    table = materialize(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets")
    narrow = rows.select("id", "source", "size", "_h", *extra)
    t = table.withColumnRenamed("source", "_source")
    narrow = narrow.join(t, narrow["source"].eqNullSafe(t["_source"])).drop("_source", "source")
    if whole_rows:
        counted = numbered(narrow, ["place"], "_h", ["id", "size"], weight="size", max_bucket=4_000, rows=sizes.count(), key_bits=60)
    else:  # equal rows are one until they are numbered, so that a row repeated very often is no task's burden
        equal = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("_equal")).withColumn("_words", F.col("size") * F.col("_equal"))
        counted = numbered(equal, ["place"], "_h", ["id", "size"], weight="_words", rows=sizes.count(), key_bits=60)
        counted = counted.withColumn("_k", F.explode(F.expr("sequence(0L, _equal - 1)"))).withColumn("before", F.col("before") + F.col("_k") * F.col("size"))
    goal, whole = F.round("target").cast("long"), F.col("source_size")
    passes = [goal - whole * k - F.col("before") for k in range(cap)]
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), p)) for p in passes[1:]), F.greatest(F.lit(0), F.least(F.col("size"), passes[0])))
    copies = sum((F.when(2 * p > F.col("size"), 1).otherwise(0) for p in passes[1:]), F.when(2 * passes[0] > F.col("size"), 1).otherwise(0))
    slope = F.element_at(F.array(*(F.lit(float(x)) for x in slopes)), ((F.col("place") % len(slopes)) + 1).cast("int"))
    due = [position(F.least(F.lit(1.0), (F.col("before") + whole * k) / F.col("target")), slope) for k in range(cap)]
    positions = F.array_compact(F.array(*(F.when((F.col("target") > 0) & (F.least(F.col("size"), p) > 0), d) for p, d in zip(passes, due, strict=True))))
    out = counted.withColumn("taken", taken.cast("long")).withColumn("copies", copies.cast("int")).withColumn("positions", positions)
    out = out.withColumn("position", F.get("positions", F.lit(0)))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "copies", "position", "positions", *extra)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, cap: int = 3) -> DataFrame:
    """Deal every document its part of the mix. Columns: id, size, source_size, target, taken, copies, position, positions.

    A source's documents, in a fixed hash order, form a stream of its words that is read from the start again up to ``cap`` times until its
    target is met: ``taken`` is how many words that takes of the document, repeats counted, so a source's words come to its target, rounded, and
    no document gives more than ``cap`` times its size. ``copies`` is the same in whole documents (a pass counts if it reaches the document's middle). ``positions`` is when in training
    each pass that takes words of the document comes due: the source's share of demand up to there, passes before counted in full, through the inverse of its integrated weight schedule; ``position`` is the first. Rows come range-sorted by position, untaken ones (null) last.
    A null text has size 0; null sources are one source, last in order; sources of no words have target 0. Repeated rows count each. The same table gives the same mix.
    """
    out = materialize(_dealt(docs, id_col, text_col, source_col, weights, slopes, cap), "mix")
    return out.orderBy(F.col("position").asc_nulls_last(), F.col(id_col))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it in whole documents (0 to 3 times), every copy at the position of its own pass, range-sorted by training position."""
    rows = _dealt(docs, id_col, text_col, source_col, whole_rows=True).filter("copies > 0")
    rows = rows.withColumn("_pass", F.explode(F.expr("sequence(0, copies - 1)"))).withColumn("_at", F.get("positions", F.col("_pass")))
    return rows.orderBy(F.col("_at").asc_nulls_last(), F.col(id_col), "_pass").select("_doc.*")
