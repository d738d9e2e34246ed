"""Duplicate marking and what follows from it: sets, optical clusters, library size, molecular identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.shared import checkpoint_dir


def ends(reads: DataFrame) -> DataFrame:
    """Mapped primary records with their unclipped 5' coordinate and score (sum of qualities of at least 15)."""
    r = reads.filter(~R.has(R.UNMAPPED) & R.primary()).withColumn("ops", R.cigar_ops())
    return r.withColumn("five", R.five_prime()).withColumn("score", F.least(F.expr("aggregate(quals, 0, (n, q) -> n + if(q >= 15, q, 0))"), F.lit(16383))).drop("ops")


def pairs(reads: DataFrame) -> DataFrame:
    """Templates of a library whose first and second end are both mapped: the earlier end, the later end, and the sum of their scores.

    A name with several first or second ends counts with those of the least ordinal.
    """
    e = ends(reads).filter(R.has(R.PAIRED) & ~R.has(R.MATE_UNMAPPED))
    side = F.struct("contig", "five", R.has(R.REVERSE).alias("reverse"), "idx", "score", "tile", "x", "y", "rg")
    end = lambda which: F.min_by(side, F.when(which, F.col("idx")))
    t = e.groupBy("library", "name").agg(end(R.has(R.FIRST)).alias("f"), end(~R.has(R.FIRST)).alias("s")).filter("f is not null and s is not null")
    t = t.select("library", "name", F.least("f", "s").alias("a"), F.greatest("f", "s").alias("b"))
    return t.select(
        "library", "name", F.col("a.contig").alias("c1"), F.col("a.five").alias("p1"), F.col("a.reverse").alias("r1"), F.col("b.contig").alias("c2"), F.col("b.five").alias("p2"), F.col("b.reverse").alias("r2"),
        (F.col("a.score") + F.col("b.score")).alias("score"), F.least("a.idx", "b.idx").alias("idx"), F.col("a.idx").alias("i1"), F.col("b.idx").alias("i2"), F.col("a.tile").alias("tile"), F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("a.rg").alias("rg"),
    )


PAIR_KEY = ["library", "c1", "p1", "r1", "c2", "p2", "r2"]


def pair_sets(reads: DataFrame) -> DataFrame:
    """Templates with their set's size, the ordinal of its best member (highest score, then first), and whether they are duplicates."""
    w = Window.partitionBy(*PAIR_KEY)
    best = Window.partitionBy(*PAIR_KEY).orderBy(F.col("score").desc(), "idx")
    return pairs(reads).withColumn("set_size", F.count(F.lit(1)).over(w)).withColumn("representative", F.first("idx").over(best)).withColumn("is_duplicate", F.col("representative") != F.col("idx"))


def fragment_sets(reads: DataFrame) -> DataFrame:
    """Mapped ends by library and 5' coordinate. A fragment that meets an end of a pair is a duplicate; of fragments alone, all but the best."""
    f = ends(reads).withColumn("in_pair", R.has(R.PAIRED) & ~R.has(R.MATE_UNMAPPED)).withColumn("reverse", R.has(R.REVERSE))
    key = Window.partitionBy("library", "contig", "five", "reverse")
    best = Window.partitionBy("library", "contig", "five", "reverse", "in_pair").orderBy(F.col("score").desc(), "idx")
    f = f.withColumn("any_pair", F.max("in_pair").over(key)).withColumn("_n", F.row_number().over(best))
    return f.withColumn("is_duplicate", ~F.col("in_pair") & (F.col("any_pair") | (F.col("_n") > 1))).drop("_n", "any_pair")


def mark_duplicates(reads: DataFrame) -> DataFrame:
    """(idx, is_duplicate) for each record: pairs by both ends, other mapped records by their one; unmapped and secondary ones never."""
    p = pair_sets(reads).filter("is_duplicate").select(F.explode(F.array("i1", "i2")).alias("idx"))
    f = fragment_sets(reads).filter("is_duplicate").select("idx")
    marked = p.unionByName(f).distinct().withColumn("is_duplicate", F.lit(True))
    return reads.select("idx").join(marked, "idx", "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))


def duplication_metrics(reads: DataFrame) -> DataFrame:
    """Counts by library from the duplicate flags that the records carry; a pair counts half for each of its records."""
    mapped_pair = R.has(R.PAIRED) & ~R.has(R.UNMAPPED) & ~R.has(R.MATE_UNMAPPED)
    plain, lone = R.primary() & ~R.has(R.UNMAPPED), ~R.has(R.PAIRED) | R.has(R.MATE_UNMAPPED)
    c = R.count_true
    rows = reads.groupBy("library").agg(
        c(plain & lone).alias("unpaired_reads_examined"), F.floor(c(R.primary() & mapped_pair) / 2).cast("long").alias("read_pairs_examined"), c(~R.primary()).alias("secondary_or_supplementary_rds"), c(R.primary() & R.has(R.UNMAPPED)).alias("unmapped_reads"),
        c(plain & lone & R.has(R.DUPLICATE)).alias("unpaired_read_duplicates"), F.floor(c(R.primary() & mapped_pair & R.has(R.DUPLICATE)) / 2).cast("long").alias("read_pair_duplicates"),
    )
    share = R.guarded(F.col("unpaired_read_duplicates") + 2 * F.col("read_pair_duplicates"), F.col("unpaired_reads_examined") + 2 * F.col("read_pairs_examined"))
    return rows.withColumn("percent_duplication", R.rounded(share))


def set_sizes(reads: DataFrame) -> DataFrame:
    """How many sets of pairs have each size."""
    return pairs(reads).groupBy(*PAIR_KEY).agg(F.count(F.lit(1)).alias("set_size")).groupBy("set_size").agg(F.count(F.lit(1)).alias("sets"))


def check_marking(reads: DataFrame) -> DataFrame:
    """Names whose records disagree about the duplicate flag with the first of them."""
    r = reads.filter(R.primary())
    first = r.groupBy("name").agg(F.min_by(R.has(R.DUPLICATE), "idx").alias("mark"), F.min(R.has(R.DUPLICATE)).alias("least"), F.max(R.has(R.DUPLICATE)).alias("most"), F.count(F.lit(1)).alias("records"))
    return first.select("name", "mark", "records", (F.col("least") == F.col("most")).alias("consistent"))


def optical_links(reads: DataFrame, distance: int = 100, cell: int | None = None) -> DataFrame:
    """Links (a, b) between templates of one duplicate set, read group and tile at most ``distance`` apart in x and in y.

    Templates meet by cells of that width, each in its own and its neighbours, so a set costs by its density, not by its square.
    """
    cell = cell or max(1, distance)
    keys = [*PAIR_KEY, "rg", "tile"]
    p = pairs(reads).select(*keys, F.col("idx"), "x", "y").withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    near = F.explode(F.expr("flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> struct(i, j))))"))
    spread = p.withColumn("_d", near).withColumn("cx", F.col("cx") + F.col("_d.i")).withColumn("cy", F.col("cy") + F.col("_d.j")).drop("_d")
    other = p.select(*keys, "cx", "cy", F.col("idx").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    joined = spread.join(other, [*keys, "cx", "cy"]).filter((F.col("idx") < F.col("b")) & (F.abs(F.col("x") - F.col("xb")) <= distance) & (F.abs(F.col("y") - F.col("yb")) <= distance))
    return joined.select(F.col("idx").alias("a"), "b")


def cell_links(cells: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Links (a, b) between neighbouring cells of a grid, of width ``distance`` + 1, that have points in reach of each other; points (keys, cx, cy, cell, x, y) are whole numbers.

    All points of a cell are in reach of each other. Of each cell the least and greatest y at each x decide, at most ``distance`` + 1 of them, whatever the number of points.
    """
    f = F.col
    columns = cells.groupBy(*keys, "cx", "cy", "x").agg(F.min("cell").alias("cell"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    grid = columns.groupBy(*keys, "cx", "cy").agg(F.min("cell").alias("cell"), F.collect_list(F.struct("x", "lo", "hi")).alias("front"))
    near = F.explode(F.expr("array(struct(0 as i, 1 as j), struct(1 as i, -1 as j), struct(1 as i, 0 as j), struct(1 as i, 1 as j))"))
    moved = grid.select(*keys, "cx", "cy", f("cell").alias("a"), f("front").alias("fa"), near.alias("_d")).select(*keys, (f("cx") + f("_d.i")).alias("cx"), (f("cy") + f("_d.j")).alias("cy"), "a", "fa")
    both = moved.join(grid.select(*keys, "cx", "cy", f("cell").alias("b"), "front"), [*keys, "cx", "cy"])
    return both.filter(f"exists(fa, p -> exists(front, q -> abs(q.x - p.x) <= {distance} and q.lo - p.hi <= {distance} and p.lo - q.hi <= {distance}))").select("a", "b")


def optical_flags(reads: DataFrame, distance: int = 100) -> DataFrame:
    """(library, idx): the templates that are optical duplicates. Links within a duplicate set, read group and tile make clusters, also over others; of a cluster the set's representative stays, or where it isn't
    there the template of least x, then y, then ordinal; all others are optical.

    Templates aren't linked in pairs: those of a cell are one cluster, and only cells are linked, so the work grows with the templates, not with the square of a set's size. x and y are whole numbers.
    """
    from .annotation import clusters

    checkpoint_dir(reads.sparkSession)
    side, f = distance + 1, F.col
    p = pair_sets(reads).filter("set_size > 1 and library is not null and rg is not null and tile is not null and x is not null and y is not null")
    p = p.withColumn("cx", F.floor(f("x") / side)).withColumn("cy", F.floor(f("y") / side)).withColumn("cell", F.min("idx").over(Window.partitionBy(*PAIR_KEY, "rg", "tile", "cx", "cy")))
    p = p.select("library", "idx", f("representative").alias("set"), "rg", "tile", "x", "y", "cx", "cy", "cell").checkpoint()
    label = clusters(cell_links(p, ["set", "rg", "tile"], distance)).select(f("node").alias("cell"), "label")
    p = p.join(label, "cell", "left").withColumn("label", F.coalesce("label", "cell"))
    w = Window.partitionBy("label").orderBy((f("idx") == f("set")).desc(), "x", "y", "idx")
    return p.withColumn("_n", F.row_number().over(w)).filter("_n > 1").select("library", "idx")


def optical_counts(reads: DataFrame, distance: int = 100) -> DataFrame:
    """By library: linked pairs of templates, and templates with an earlier one within reach."""
    links = optical_links(reads, distance)
    p = pairs(reads).select("library", F.col("idx").alias("b"))
    rows = links.join(p, "b").groupBy("library", "b").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("library").agg(F.sum("n").cast("long").alias("links"), F.count(F.lit(1)).alias("templates_behind_another"))


def estimate_library_size(table: DataFrame, seen: str = "read_pairs", duplicates: str = "duplicate_pairs", halvings: int = 40) -> DataFrame:
    """Add estimated_library_size to a table of pairs and duplicate pairs: null without duplicates or with nothing else."""
    t = table.withColumn("_n", F.col(seen).cast("double")).withColumn("_c", (F.col(seen) - F.col(duplicates)).cast("double"))
    f = lambda x: f"(1 / ({x}) - 1 + exp(-_n / (({x}) * _c)))"
    t = t.withColumn("_hi", F.expr(f"aggregate(sequence(1, 20), 100.0D, (m, i) -> if({f('m')} > 0, m * 10, m))"))
    root = F.expr(f"aggregate(sequence(1, {halvings}), named_struct('lo', 1.0D, 'hi', _hi), (s, i) -> if({f('(s.lo + s.hi) / 2')} > 0, named_struct('lo', (s.lo + s.hi) / 2, 'hi', s.hi), named_struct('lo', s.lo, 'hi', (s.lo + s.hi) / 2)), s -> (s.lo + s.hi) / 2)")
    ok = (F.col(duplicates) > 0) & (F.col("_c") > 0)
    return t.withColumn("estimated_library_size", F.when(ok, F.floor(F.col("_c") * root).cast("long"))).drop("_n", "_c", "_hi")


def library_sizes(reads: DataFrame) -> DataFrame:
    p = pair_sets(reads).groupBy("library").agg(F.count(F.lit(1)).alias("read_pairs"), R.count_true(F.col("is_duplicate")).alias("duplicate_pairs"))
    return estimate_library_size(p)


def return_on_investment(sizes: DataFrame, most: int = 10) -> DataFrame:
    """By library and coverage multiple 1 .. most: how many times the distinct molecules of the whole library are seen."""
    x = sizes.filter("estimated_library_size is not null").withColumn("multiple", F.explode(F.sequence(F.lit(1), F.lit(most))))
    size = F.col("estimated_library_size").cast("double")
    unique = (F.col("read_pairs") - F.col("duplicate_pairs")).cast("double")
    return x.select("library", "multiple", R.rounded(size * (1 - F.exp(-F.col("multiple") * F.col("read_pairs") / size)) / unique, 4).alias("yield"))


UMI_SITE = ["library", "contig", "five", "reverse"]


def umi_sets(reads: DataFrame) -> DataFrame:
    """Mapped ends with an identifier free of N, by site: (site, umi, reads)."""
    e = ends(reads).withColumn("reverse", R.has(R.REVERSE)).filter(~F.col("umi").contains("N"))
    return e.groupBy(*UMI_SITE, "umi").agg(F.count(F.lit(1)).alias("reads"), F.min("idx").alias("idx"))


def umi_clusters(reads: DataFrame, distance: int = 1) -> DataFrame:
    """Identifiers of a site joined, also over others, at Hamming distance up to ``distance``: each with its cluster's least identifier.

    Labels are passed on along links until none changes; a site has few identifiers, so links are found by a join within the site.
    """
    u = umi_sets(reads)
    other = u.select(*UMI_SITE, F.col("umi").alias("umi2"))
    links = u.join(other, UMI_SITE).filter((F.col("umi") != F.col("umi2")) & (R.hamming("umi", "umi2") <= distance)).select(*UMI_SITE, "umi", "umi2")
    grouped = u.groupBy(*UMI_SITE).agg(F.collect_list(F.struct("umi", "reads")).alias("all"))
    edges = links.groupBy(*UMI_SITE).agg(F.collect_list(F.struct("umi", "umi2")).alias("edges"))
    # min-label rounds on the site's own map of identifiers, as many as it has identifiers at most
    spread = "aggregate(sequence(1, size(all)), map_from_arrays(all.umi, all.umi), (m, i) -> map_from_arrays(map_keys(m), transform(map_keys(m), k -> array_min(concat(array(m[k]), transform(filter(edges, e -> e.umi = k), e -> m[e.umi2]))))))"
    lab = grouped.join(edges, UMI_SITE, "left").withColumn("labels", F.expr(f"if(edges is null, map_from_arrays(all.umi, all.umi), {spread})"))
    return lab.select(*UMI_SITE, F.explode("all").alias("a"), "labels").select(*UMI_SITE, F.col("a.umi").alias("umi"), F.col("a.reads").alias("reads"), F.expr("labels[a.umi]").alias("cluster"))


def umi_entropy(reads: DataFrame) -> DataFrame:
    """By library: distinct identifiers and their entropy, base 4."""
    n = umi_sets(reads).groupBy("library", "umi").agg(F.sum("reads").alias("n"))
    total = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("library")))
    return total.groupBy("library").agg(F.count(F.lit(1)).alias("observed_unique_umis"), R.rounded(-F.sum(F.col("p") * F.log("p")) / F.log(F.lit(4.0))).alias("observed_umi_entropy"))


def umi_prevalence(reads: DataFrame) -> DataFrame:
    """How many sites have each number of distinct identifiers."""
    return umi_sets(reads).groupBy(*UMI_SITE).agg(F.count(F.lit(1)).alias("distinct_umis")).groupBy("distinct_umis").agg(F.count(F.lit(1)).alias("sites"))


def sequenced_pairs(reads: DataFrame, prefix: int = 5, min_mean_quality: int = 20) -> DataFrame:
    """Templates of a library with a primary first and second end, mapped or not: both ends' whole bases in the order of sequencing, and when the pair is complete (the greater ordinal).

    Each end needs ``prefix`` bases without N and a mean quality, rounded down, of at least ``min_mean_quality``, as recorded. A name with several first or second ends counts with those of the least ordinal.
    """
    first, second = R.has(R.FIRST), ~R.has(R.FIRST) & R.has(R.SECOND)
    good = (F.length("bases") >= prefix) & ~F.upper(F.substring("bases", 1, prefix)).contains("N") & (F.floor(F.expr("aggregate(quals, 0L, (n, q) -> n + q)") / F.length("bases")) >= min_mean_quality)
    r = reads.filter(R.primary() & R.has(R.PAIRED) & (first | second))
    end = F.struct(F.when(R.has(R.REVERSE), R.reverse_complement("bases")).otherwise(F.col("bases")).alias("bases"), good.alias("good"), "idx")
    t = r.groupBy("library", "name").agg(F.min_by(F.when(first, end), F.when(first, F.col("idx"))).alias("a"), F.min_by(F.when(second, end), F.when(second, F.col("idx"))).alias("b"))
    return t.filter("a.good and b.good").select("library", F.col("a.bases").alias("one"), F.col("b.bases").alias("two"), F.greatest("a.idx", "b.idx").alias("idx"))


def claimed_sizes(ones: list[str], twos: list[str], counts: list[int], prefix: int, max_diff: float, scan: int = 64, width: int = 8) -> list[int]:
    """Sizes of the sets that pairs of one prefix group make by greedy claims in the given order: each pair that is left takes all later ones that match it.

    Ends are compared over the shorter of the two, from the prefix on; a pair matches with at most floor((len1 + len2) * max_diff) differences in both ends together.
    A group of over ``scan`` pairs is not scanned for each claim: two pairs that share more whole blocks of ``width`` bases than they may differ in agree in one of them, so such pairs
    are found by their blocks, and only shorter ones are compared with all. The sets are the same.
    """
    import numpy as np

    n = len(ones)

    def matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(t) for t in texts])
        wide = int(size.max())
        return np.frombuffer("".join(t.ljust(wide, "\0") for t in texts).encode("ascii", "replace"), np.uint8).reshape(n, wide)[:, prefix:], size

    (a, la), (b, lb) = matrix(ones), matrix(twos)
    weight, open_ = np.array(counts), np.ones(n, bool)

    def matching(lead: int, others: np.ndarray) -> np.ndarray:
        errors = sum(((m[others] != m[lead]) & (m[others] != 0) & (m[lead] != 0)).sum(axis=1) for m in (a, b))
        most = np.floor((np.minimum(la[others], la[lead]) + np.minimum(lb[others], lb[lead])) * max_diff)
        return others[errors <= most]

    blocks: dict[tuple, list[int]] = {}
    shapes: dict[tuple[int, int], list[int]] = {}

    def keys(i: int) -> list[tuple]:
        return [(e, k, t[k : k + width]) for e, t in ((0, ones[i]), (1, twos[i])) for k in range(prefix, len(t) - width + 1, width)]

    if n > scan:
        for i in range(n):
            shapes.setdefault((int(la[i]), int(lb[i])), []).append(i)
            for key in keys(i):
                blocks.setdefault(key, []).append(i)
    out = []
    for lead in range(n):
        if not open_[lead]:
            continue
        open_[lead] = False
        if n <= scan:
            others = np.flatnonzero(open_)
        else:
            near: set[int] = set()
            for key in keys(lead):
                blocks[key] = [i for i in blocks[key] if open_[i]]
                near.update(blocks[key])
            for (x, y), members in shapes.items():
                x, y = min(x, int(la[lead])), min(y, int(lb[lead]))
                if (x - prefix) // width + (y - prefix) // width <= np.floor((x + y) * max_diff):
                    near.update(i for i in members if open_[i])
            others = np.array(sorted(near), dtype=int)
        mine = matching(lead, others) if len(others) else others
        open_[mine] = False
        out.append(int(weight[lead] + weight[mine].sum()))
    return out


def library_complexity(reads: DataFrame, prefix: int = 5, max_diff: float = 0.03, min_mean_quality: int = 20) -> DataFrame:
    """Sets of read pairs of a library by size: pairs whose ends both start with the same ``prefix`` bases and differ in at most ``max_diff`` of their whole ends, by greedy claims in the order in which pairs are complete.

    Exact copies, which are always claimed together, are aggregated first; then a group of two prefixes is claimed inside a task, by an index where it is large.
    """
    import pandas as pd

    from ..functions.shared import ship

    ship(reads.sparkSession)
    p = sequenced_pairs(reads, prefix, min_mean_quality).groupBy("library", "one", "two").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx"))

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        return pd.DataFrame({"library": pdf["library"].iloc[0], "set_size": claimed_sizes(list(pdf["one"]), list(pdf["two"]), list(pdf["n"]), prefix, max_diff)})

    groups = p.withColumn("p1", F.substring("one", 1, prefix)).withColumn("p2", F.substring("two", 1, prefix)).groupBy("library", "p1", "p2")
    sets = groups.applyInPandas(claim, "library string, set_size long")
    return sets.groupBy("library", "set_size").agg(F.count(F.lit(1)).alias("sets"))
