"""Gene annotation, reference sequences, instrument and array data, tables of metrics, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.shared import checkpoint_dir

# Locus functions in order of rank; the highest wins where several hold.
FUNCTIONS = ("INTERGENIC", "INTRONIC", "UTR", "CODING", "RIBOSOMAL")


def features(genes: DataFrame) -> DataFrame:
    """Stretches of each transcript with their function's rank: all of it intronic, its exons UTR, exons within the coding range coding. Exons are an array (start, stop), of any number, or two pairs of columns."""
    f = F.col
    exons = f("exons") if "exons" in genes.columns else F.array(*(F.struct(f(f"e{i}_start").alias("start"), f(f"e{i}_end").alias("stop")) for i in (1, 2)))
    part = lambda a, b, rank: F.struct(a.alias("start"), b.alias("stop"), F.lit(rank).alias("rank"))
    rows = F.concat(F.array(part(f("tx_start"), f("tx_end"), 1)), F.transform(exons, lambda e: part(e["start"], e["stop"], 2)), F.transform(exons, lambda e: part(F.greatest(e["start"], f("cds_start")), F.least(e["stop"], f("cds_end")), 3)))
    return genes.select("contig", "gene", "transcript", F.explode(rows).alias("x")).select("contig", "gene", "transcript", "x.*").filter("start <= stop")


def base_functions(reads: DataFrame, genes: DataFrame, width: int = 1000) -> DataFrame:
    """Aligned bases of usable records by the highest function at their position.

    Positions get their depth first, so each covered position is judged once, whatever its depth.
    """
    from .intervals import overlaps
    from .pileup import usable

    b = usable(reads).select("contig", F.explode(R.blocks()).alias("b")).select("contig", F.explode(F.sequence(F.col("b.ref_start"), F.col("b.ref_start") + F.col("b.len") - 1)).alias("pos"))
    depth = b.groupBy("contig", "pos").agg(F.count(F.lit(1)).alias("n"))
    at = depth.select("contig", F.col("pos").alias("start"), F.col("pos").alias("stop"), "n")
    hit = overlaps(at, features(genes), width).groupBy("contig", F.col("a.start").alias("pos")).agg(F.max("b.rank").alias("rank"))
    ranked = depth.join(hit, ["contig", "pos"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    return ranked.groupBy("rank").agg(F.sum("n").cast("long").alias("bases")).select(F.element_at(F.array(*(F.lit(x) for x in FUNCTIONS)), F.col("rank") + 1).alias("locus_function"), "bases")


def transcript_coverage(reads: DataFrame, genes: DataFrame, width: int = 1000) -> DataFrame:
    """Per transcript: exonic length, bases on exons, mean coverage."""
    from .intervals import overlaps
    from .pileup import usable

    exons = features(genes).filter("rank = 2")
    b = usable(reads).select("idx", "contig", F.explode(R.blocks()).alias("b")).select("idx", "contig", F.col("b.ref_start").alias("start"), (F.col("b.ref_start") + F.col("b.len") - 1).alias("stop"))
    on = overlaps(exons, b, width).groupBy(F.col("a.transcript").alias("transcript")).agg(F.sum(F.least("a.stop", "b.stop") - F.greatest("a.start", "b.start") + 1).cast("long").alias("bases"))
    length = exons.groupBy("gene", "transcript").agg(F.sum(F.col("stop") - F.col("start") + 1).cast("long").alias("length"))
    return length.join(on, "transcript", "left").fillna(0, ["bases"]).withColumn("coverage", R.rounded(F.col("bases") / F.col("length")))


def top_transcripts(coverage: DataFrame, k: int) -> DataFrame:
    """The best transcript of each gene, then those whose coverage is at least the k-th best: ties at the end stay. The k-th value is one number, by a top-k of values."""
    best = coverage.withColumn("_n", F.row_number().over(Window.partitionBy("gene").orderBy(F.col("coverage").desc(), "transcript"))).filter("_n = 1").drop("_n")
    floor = best.select("coverage").orderBy(F.col("coverage").desc()).limit(k).agg(F.min("coverage").alias("_floor"))
    return best.join(F.broadcast(floor), F.col("coverage") >= F.col("_floor")).drop("_floor")


def strand_specificity(reads: DataFrame, genes: DataFrame, width: int = 1000) -> DataFrame:
    """Records that begin in a gene, by whether their strand (turned for second ends) is its own."""
    from .intervals import overlaps
    from .pileup import usable

    r = usable(reads).select("idx", "contig", F.col("pos").alias("start"), F.col("pos").alias("stop"), (R.has(R.REVERSE) != (R.has(R.PAIRED) & R.has(R.SECOND))).alias("minus"))
    g = genes.select("contig", F.col("tx_start").alias("start"), F.col("tx_end").alias("stop"), (F.col("strand") == "-").alias("minus"))
    one = overlaps(r, g, width).groupBy("a.idx").agg(F.max(F.col("a.minus") == F.col("b.minus")).alias("same"), F.max(F.col("a.minus") != F.col("b.minus")).alias("other"))
    return one.agg(R.count_true(F.col("same") & ~F.col("other")).alias("correct_strand_reads"), R.count_true(F.col("other") & ~F.col("same")).alias("incorrect_strand_reads"), R.count_true(F.col("same") & F.col("other")).alias("ambiguous_reads"))


def sequence_dictionary(reference: DataFrame, contigs: DataFrame) -> DataFrame:
    """Length and MD5 of each contig's upper-case bases. A contig is put together from its chunks in one task: a digest is sequential."""
    whole = reference.groupBy("contig").agg(F.array_sort(F.collect_list(F.struct("chunk", F.upper("bases").alias("bases")))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: x["bases"]), "")
    return whole.select("contig", F.length(text).alias("length"), F.md5(text).alias("md5")).join(F.broadcast(contigs.select("contig", "contig_name")), "contig")


def extract_sequences(reference: DataFrame, intervals: DataFrame, chunk: int = 500) -> DataFrame:
    """The bases of each interval, reverse-complemented on the minus strand: chunks meet intervals, their pieces are joined in order."""
    x = intervals.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("start") - 1) / chunk), F.floor((F.col("stop") - 1) / chunk))))
    j = x.join(reference.select("contig", F.col("chunk").cast("long").alias("chunk"), F.col("start").alias("_s"), "bases"), ["contig", "chunk"])
    piece = F.expr("substr(bases, greatest(start - _s, 0) + 1, least(stop, _s + length(bases) - 1) - greatest(start, _s) + 1)")
    g = j.select("contig", "name", "strand", "chunk", piece.alias("p")).groupBy("contig", "name", "strand").agg(F.array_sort(F.collect_list(F.struct("chunk", "p"))).alias("c"))
    text = F.array_join(F.transform("c", lambda e: e["p"]), "")
    return g.select("name", F.when(F.col("strand") == "-", R.reverse_complement(text)).otherwise(text).alias("bases"))


def non_n(reference: DataFrame) -> DataFrame:
    return reference.groupBy("contig").agg(F.sum(F.length(F.regexp_replace("bases", "[Nn]", ""))).cast("long").alias("non_n_bases"))


def tiled_baits(targets: DataFrame, size: int = 120, offset: int = 80) -> DataFrame:
    """Baits of one size along each target, ``offset`` apart, the last one moved to end with it; a short target has one, centred."""
    length = F.col("stop") - F.col("start") + 1
    n = F.when(length <= size, 1).otherwise(F.ceil((length - size) / offset) + 1)
    x = targets.withColumn("_n", n.cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    start = F.when(length <= size, F.col("start") - F.floor((F.lit(size) - length) / 2)).otherwise(F.least(F.col("start") + (F.col("_i") - 1) * offset, F.col("stop") - size + 1))
    return x.select("contig", start.cast("int").alias("start"), (start + size - 1).cast("int").alias("stop"), F.concat(F.col("name"), F.lit("_"), F.col("_i").cast("string")).alias("name"))


def places_apart(a: Column, b: Column) -> Column:
    """Places at which two strings differ, those that only one has included."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.length(b), F.lit(1))), F.lit(0), lambda n, i: n + F.when(F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)), 1).otherwise(0))


def demultiplex(clusters: DataFrame, barcodes: DataFrame, max_mismatches: int = 1, min_delta: int = 1, distance: str = "hamming") -> DataFrame:
    """Assign each distinct observed barcode to the sheet's nearest one, if near enough and clearly nearer than the next; counts by barcode.

    ``distance`` counts differing places (``hamming``, a place that one lacks differs) or edits (``levenshtein``).

    The sheet, of any size, is one row with an array of its barcodes, sent to the observed ones; each keeps the two nearest, so no pairs of clusters and barcodes are made.
    """
    sheet = barcodes.agg(F.collect_set("barcode").alias("sheet"))
    seen = clusters.groupBy("barcode").agg(F.count(F.lit(1)).alias("reads"), R.count_true(F.col("pf")).alias("pf_reads"))
    x = seen.crossJoin(F.broadcast(sheet)).withColumn("s", F.transform("sheet", lambda b: F.struct((F.levenshtein("barcode", b) if distance == "levenshtein" else places_apart(F.col("barcode"), b)).alias("d"), b.alias("b")))).drop("sheet")
    x = x.withColumn("s", F.sort_array("s")).withColumn("s", F.array(F.get("s", F.lit(0)), F.get("s", F.lit(1)))).withColumn("next", F.expr("coalesce(s[1].d, 99)"))
    hit = F.when((F.expr("s[0].d") <= max_mismatches) & (F.col("next") - F.expr("s[0].d") >= min_delta), F.expr("s[0].b"))
    x = x.withColumn("assigned", F.coalesce(hit, F.lit("NNNN"))).withColumn("perfect", F.expr("s[0].d") == 0)
    return x.groupBy("assigned").agg(F.sum("reads").cast("long").alias("reads"), F.sum("pf_reads").cast("long").alias("pf_reads"), R.sum_if(F.col("perfect") & (F.col("assigned") != "NNNN"), F.col("reads")).alias("perfect_matches"))


def basecalling_metrics(clusters: DataFrame) -> DataFrame:
    """By lane and barcode: clusters and bases, all and passing, and mean and spread over tiles. Clusters are (lane, tile, barcode, pf, bases); tiles are totalled first."""
    f, c = F.col, R.count_true
    tile = clusters.groupBy("lane", "barcode", "tile").agg(F.count(F.lit(1)).alias("n"), c(f("pf")).alias("pf"), F.sum("bases").alias("b"), R.sum_if(f("pf"), f("bases")).alias("pb"))
    return tile.groupBy("lane", "barcode").agg(
        F.sum("n").cast("long").alias("total_clusters"), F.sum("pf").cast("long").alias("pf_clusters"), F.sum("b").cast("long").alias("total_bases"), F.sum("pb").cast("long").alias("pf_bases"), R.rounded(F.avg("n"), 4).alias("mean_clusters_per_tile"),
        R.rounded(F.stddev_samp("n"), 4).alias("sd_clusters_per_tile"), R.rounded(F.avg(100.0 * f("pf") / f("n")), 4).alias("mean_pct_pf_clusters_per_tile"), R.rounded(F.avg("pf"), 4).alias("mean_pf_clusters_per_tile"),
    )


def lane_metrics(clusters: DataFrame) -> DataFrame:
    """Clusters and passing ones by tile, then by lane: totals, mean and spread over tiles."""
    tile = clusters.groupBy("lane", "tile").agg(F.count(F.lit(1)).alias("n"), R.count_true(F.col("pf")).alias("pf"))
    return tile.groupBy("lane").agg(F.count(F.lit(1)).alias("tiles"), F.sum("n").cast("long").alias("total_clusters"), F.sum("pf").cast("long").alias("pf_clusters"), R.rounded(F.avg("n"), 4).alias("mean_clusters_per_tile"), R.rounded(F.stddev_samp("n"), 4).alias("sd_clusters_per_tile"))


def unpack_basecalls(calls: DataFrame, column: str = "byte") -> DataFrame:
    """A basecall byte as base and quality: two low bits and six high ones; 0 is a no-call of quality 2."""
    b = F.col(column)
    base = F.when(b == 0, ".").otherwise(F.substring(F.lit("ACGT"), b.bitwiseAND(F.lit(3)) + 1, F.lit(1)))
    return calls.withColumn("base", base).withColumn("quality", F.when(b == 0, 2).otherwise(F.shiftright(b, 2)))


def normalized_intensity(raw: DataFrame, theta: float = 0.1, scale: float = 1.2, shear: float = 0.02, dx: float = 50.0, dy: float = 40.0) -> DataFrame:
    """Raw two-colour intensities translated, rotated, sheared and scaled, as R and theta."""
    x0, y0 = F.col("x") - dx, F.col("y") - dy
    c, s = F.cos(F.lit(theta)), F.sin(F.lit(theta))
    xr, yr = c * x0 + s * y0, -s * x0 + c * y0
    xs = (xr - shear * yr) / scale
    ys = yr / scale
    return raw.withColumn("r", R.rounded(xs + ys, 4)).withColumn("theta", R.rounded(F.when(xs == 0, 1.0).otherwise(F.atan(ys / xs) * 2 / F.pi()), 4))


def call_rates(calls: DataFrame) -> DataFrame:
    """By sample: call rate, heterozygous rate, and the sex that calls on the last contig suggest."""
    f, c = F.col, R.count_true
    called = f("gq") >= 20
    x = calls.groupBy("sample").agg(R.rounded(R.ratio(c(called), F.count(F.lit(1)))).alias("call_rate"), R.rounded(R.ratio(c(called & (f("a") != f("b"))), c(called))).alias("het_rate"), R.rounded(R.ratio(c(called & (f("contig") == 23) & (f("a") != f("b"))), c(called & (f("contig") == 23)))).alias("x_het_rate"))
    return x.withColumn("reported_sex", F.when(f("x_het_rate") > 0.2, "Female").otherwise("Male"))


def thresholded_calls(raw: DataFrame, tx: Column, ty: Column) -> DataFrame:
    """Genotypes of uncalled points by intensity thresholds: both low none, x or y alone one homozygote, both high heterozygous."""
    x, y = F.col("x") > tx, F.col("y") > ty
    return raw.withColumn("call", F.when(x & y, "AB").when(x, "AA").when(y, "BB").otherwise("NC"))


def compare_metrics(a: DataFrame, b: DataFrame, key: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """Values that differ between two tables by more than ``tolerance`` of the left one, or that one table alone has."""
    pack = lambda df, n: df.select(*key, F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("v")) for v in values))).alias("x")).select(*key, "x.metric", F.col("x.v").alias(n))
    j = pack(a, "value1").join(pack(b, "value2"), [*key, "metric"], "full_outer")
    same = F.abs(F.col("value1") - F.col("value2")) <= tolerance * F.abs("value1")
    return j.filter(~F.coalesce(same, F.col("value1").isNull() & F.col("value2").isNull()))


def clusters(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of an undirected graph (a, b): each node with the least node it reaches. Labels spread along edges and jump to their label's label; each round is checkpointed."""
    two = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    checkpoint_dir(edges.sparkSession)
    two = two.checkpoint()
    label = two.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")).checkpoint()
    for _ in range(rounds):
        near = two.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")).checkpoint()
        moved = step.filter("old <> label").limit(1).count()
        label = step.select("node", "label")
        if not moved:
            return label
    raise RuntimeError("components did not settle")
