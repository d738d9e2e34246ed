"""Sharding by a hierarchical weighted hash tree: region, rack and shard are chosen by weighted hash draws."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import materialize, numbered, order_hash


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, regions: int = 2, racks: int = 2, base: int = 16) -> list[Leaf]:
    """A tree for ``shards`` shards: the first ``base`` ones are dealt evenly over the racks of the regions, each later one opens a
    region of its own. So one more shard changes no weight but that of its own new subtree, and takes rows only into itself. Fewer than ``base`` shards can't grow so and are refused: pass a smaller base."""
    if shards < base:
        raise ValueError(f"{shards} shards are fewer than the {base} that the tree starts from")
    first = base
    per = -(-first // (regions * racks))
    leaves = [Leaf(f"r{i // per // racks}", f"k{i // per % racks}", i) for i in range(first)]
    return leaves + [Leaf(f"grown{i}", "k0", i) for i in range(first, shards)]


def _draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw of rate ``weight`` from the hash of key and node; the smallest wins, with odds by weight. A draw depends on nothing else."""
    u = (F.shiftright(F.xxhash64(F.lit(node), key), 11).cast("double") + F.lit(2.0**52 + 0.5)) / F.lit(2.0**53)
    return -F.log(u) / F.lit(float(weight))


def _choose(key: Column, options: list[tuple[str, float, Column]]) -> Column:
    if len(options) == 1:
        return options[0][2]
    return F.array_min(F.array(*(F.struct(_draw(key, node, w).alias("draw"), then.alias("then")) for node, w, then in options)))["then"]


def place(key: Column, tree: list[Leaf]) -> Column:
    """The shard of ``key``: descend from the root, at each level to the child that wins the weighted draw. A subtree's weight is the sum of its leaves'.

    If weights change below one node, draws change only there and above it, so rows move only into or out of subtrees whose weights changed.
    Leaves of weight 0 or less get nothing.
    """
    live = [x for x in tree if x.weight > 0]
    if not live:
        raise ValueError("no shard has a weight above 0")

    def level(leaves: list[Leaf], path: str, depth: int) -> Column:
        names = [lambda x: x.region, lambda x: x.rack, lambda x: str(x.shard)]
        groups: dict[str, list[Leaf]] = {}
        for leaf in leaves:
            groups.setdefault(names[depth](leaf), []).append(leaf)
        options = []
        for name, members in groups.items():
            node = f"{path}/{name}"
            then = F.lit(members[0].shard) if depth == 2 else level(members, node, depth + 1)
            options.append((node, sum(m.weight for m in members), then))
        return _choose(key, options)

    return level(live, "", 0)


def shard_rows(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False, order: Column | None = None) -> DataFrame:
    """Per row: id, size (UTF-8 bytes plus 1), text_crc32, law ("key"), shard, slot (gapless from 0 in its shard), grown_shard; with ``whole_rows`` also _doc, a struct of the row.

    The shard depends on the id and the tree alone; all rows of one id, and all of null id, share a shard. A null text has size 1 and the
    checksum of no bytes. Repeated rows each get a slot of their own. Slots follow ``order``, a long column of which few rows share one, or a hash order; no task holds a whole shard.
    """
    key = F.col("id")
    extra = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")] if whole_rows else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *extra, *([order.alias("_order")] if order is not None else []))
    extra = ["_doc"] if whole_rows else []
    rows = rows.select("id", *extra, *(["_order"] if order is not None else []), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), place(key, tree).alias("shard"), (place(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    rows = rows.withColumn("_h", order_hash(F.col("id"), F.col("text_crc32")))
    rows = rows if whole_rows else materialize(rows, "shards")
    if order is None and whole_rows:
        out = numbered(rows, ["shard"], "_h", ["id", "text_crc32", "size"], max_bucket=4_000)
    elif order is None:  # equal rows are one until they are numbered
        equal = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_equal"))
        out = numbered(equal, ["shard"], "_h", ["id", "text_crc32", "size"], weight="_equal", rows=rows.count())
        out = out.withColumn("_k", F.explode(F.expr("sequence(0L, _equal - 1)"))).withColumn("slot", F.col("before") + F.col("_k"))
    else:
        out = numbered(rows, ["shard"], "_order", ["_h"], bucket=F.shiftright("_order", 12))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", *extra)


def file_order(docs: DataFrame) -> Column | None:
    """Where each row stands in the files that ``docs`` was read from, by number of the part file, then row: the order in which a sorted table was written. None if ``docs`` comes from no files."""
    try:
        name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
        docs.select(name, row)
    except AnalysisException:
        return None
    part, piece = (F.coalesce(F.regexp_extract(name, p, 1).try_cast("long"), F.lit(0)) for p in (r"^part-(\d+)", r"-c(\d+)\."))
    return F.shiftleft(part * 4096 + F.pmod(piece, F.lit(4096)), 31) + row


def sharded(docs: DataFrame, tree: list[Leaf], id_col: str = "doc_id", text_col: str = "text", order: Column | None = None) -> DataFrame:
    """The rows of ``docs`` with the columns shard and slot (which replace columns of those names); slots follow ``order`` as in ``shard_rows``. An empty table stays empty, repeated rows stay."""
    placed = shard_rows(docs, tree, None, id_col, text_col, whole_rows=True, order=order)
    kept = [F.col("_doc").getField(c).alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*kept, "shard", "slot")
