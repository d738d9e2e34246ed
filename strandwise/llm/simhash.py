"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join within a Hamming budget."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .work import join_counted, materialize, ship

SEED = 42
_FLIP = np.uint64(1 << 63)


def fingerprint(text: str | None, size: int = 4) -> int:
    """64-bit SimHash: lower-case A-Z, words between ASCII white space, shingles of ``size`` words with repeats,
    each hashed with XXH64 (seed 42); a bit is set if it is set in over half the hashes. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - size + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        rows = np.ascontiguousarray(hashes[at : at + 65536]).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, carry: tuple[Column, ...] = ()) -> DataFrame:
    """(id, fp, h0, h1, ...): one row for each row of ``docs``; fp is the fingerprint as a signed long, ``carry`` long columns to keep. Null and empty texts get 0."""
    ship(docs.sparkSession)
    names = ["id", "fp", *(f"h{i}" for i in range(len(carry)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", "fp long", *(f"{n} long" for n in names[2:])])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(c.alias(n) for c, n in zip(carry, names[2:], strict=True))).mapInArrow(run, schema)


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the links (a, b) into ``labels``, which name each row's smallest known member."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def trie_links(fps: np.ndarray, groups: np.ndarray, budget: int, pair_batch: int = 1 << 19) -> np.ndarray:
    """Binary trie self-join within each group; returns for each row the smallest row it is linked to, over paths.

    ``fps`` (uint64) is sorted within each run of equal ``groups``. A trie node at depth d is a range of rows that
    share d leading bits; a level halves both nodes of every pair, adds one differing bit to crossed halves,
    and drops pairs beyond ``budget``, as well as pairs whose rows are already one component. Pairs are taken depth first in
    batches, so memory stays bounded; small node pairs are compared directly.
    """
    n = len(fps)
    labels = np.arange(n)
    if n < 2:
        return labels
    edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    lo, hi = edges, np.r_[edges[1:], n]
    many = hi - lo > 1
    stack = [(0, lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int8))]
    ones: dict[int, np.ndarray] = {}
    runs, stale = labels, True
    while stack:
        d, al, ah, bl, bh, acc = stack.pop()
        if len(al) > pair_batch:
            stack.append((d, *(x[pair_batch:] for x in (al, ah, bl, bh, acc))))
            al, ah, bl, bh, acc = (x[:pair_batch] for x in (al, ah, bl, bh, acc))
        if stale:
            runs = np.cumsum(np.r_[0, labels[1:] != labels[:-1]])
            stale = False
        open_ = ~((runs[al] == runs[ah - 1]) & (runs[bl] == runs[bh - 1]) & (labels[al] == labels[bl]))
        al, ah, bl, bh, acc = (x[open_] for x in (al, ah, bl, bh, acc))
        if not len(al):
            continue
        small = ((ah - al) * (bh - bl) <= 16) | (d == 64)
        if small.any():
            sal, sah, sbl, sbh = (x[small] for x in (al, ah, bl, bh))
            width = sbh - sbl
            each = (sah - sal) * width
            owner = np.repeat(np.arange(len(each)), each)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
            i, j = sal[owner] + k // width[owner], sbl[owner] + k % width[owner]
            near = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
            if near.any():
                labels, stale = _merge(labels, i[near], j[near]), True
            al, ah, bl, bh, acc = (x[~small] for x in (al, ah, bl, bh, acc))
            if not len(al):
                continue
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((fps >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int32)])
        c = ones[d]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        crossed, own = acc + 1, al == bl
        kids = [(al, am, bl, bm, acc), (am, ah, bm, bh, acc), (al, am, bm, bh, crossed), (am[~own], ah[~own], bl[~own], bm[~own], crossed[~own])]
        out = []
        for kal, kah, kbl, kbh, kacc in kids:
            keep = (kal < kah) & (kbl < kbh) & (kacc <= budget) & ~((kal == kbl) & (kah - kal == 1))
            out.append([x[keep] for x in (kal, kah, kbl, kbh, kacc)])
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*out, strict=True))))
    return labels


def _block_masks(rows: int, budget: int, bucket: int) -> list[int]:
    """Masks of leading trie blocks: of m blocks, any m - budget stay equal in a pair within the budget. m grows with
    the rows until a bucket of equal blocks has about ``bucket`` rows."""
    for m in range(budget + 1, budget + 5):
        cuts = [round(64 * i / m) for i in range(m + 1)]
        blocks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(m)]
        if rows <= bucket << (64 * (m - budget) // m):
            break
    return [sum(x) for x in itertools.combinations(blocks, m - budget)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _finer_masks(mask: int, budget: int) -> list[int]:
    """Masks of further blocks within the bits that ``mask`` leaves open: of budget + 2 blocks any two stay equal in a pair within the budget."""
    free = [i for i in range(63, -1, -1) if not mask >> i & 1]
    m = budget + 2
    if len(free) < 2 * m:
        return [0]
    blocks = [sum(1 << i for i in free[len(free) * x // m : len(free) * (x + 1) // m]) for x in range(m)]
    return [sum(x) for x in itertools.combinations(blocks, m - budget)]


def links(fps: DataFrame, budget: int = 4, bucket: int = 512, hot: int = 16_384, flush: int = 200_000) -> DataFrame:
    """A spanning set of links (a, b) over distinct fingerprints (column fp): joined by paths exactly as by all pairs within ``budget``.

    Rows meet by equal blocks (pigeonhole), each bucket is one trie. A bucket of over ``hot`` rows is split by further blocks of the bits that it leaves open, by the same argument; one still
    over it is dealt into chunks by hash, and every pair of chunks becomes a task of at most two chunks. At most one link a row leaves a task, never all pairs.
    """
    spark = fps.sparkSession
    ship(spark)
    masks = _block_masks(fps.count(), budget, bucket)
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("b"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)))).alias("at")).select("fp", "at.b", "at.k")
    large = keyed.groupBy("b", "k").count().filter(F.col("count") > hot).select("b", "k", F.lit(True).alias("large"))
    keyed = keyed.join(large, ["b", "k"], "left")
    finer = F.element_at(F.array(*(F.array(*(F.lit(_signed(x)) for x in _finer_masks(m, budget))) for m in masks)), F.col("b") + 1)
    keyed = keyed.select("fp", "b", "k", F.posexplode(F.when(F.col("large"), finer).otherwise(F.array(F.lit(0).cast("long")))).alias("q", "m")).select("fp", (F.col("b") * 1024 + F.col("q")).alias("b"), "k", F.col("fp").bitwiseAND(F.col("m")).alias("s"))
    still = keyed.groupBy("b", "k", "s").count().filter(F.col("count") > hot).select("b", "k", "s", F.ceil(F.col("count") / hot).cast("int").alias("chunks"))
    dealt = keyed.join(still, ["b", "k", "s"], "left").withColumn("c", F.expr("cast(pmod(xxhash64(fp, 7), coalesce(chunks, 1)) as int)"))
    tasks = dealt.withColumn("j", F.explode(F.expr("if(chunks is null, array(0), filter(sequence(0, chunks - 1), x -> x <> c))")))
    tasks = tasks.select("b", "k", "s", F.least("c", "j").alias("i"), F.greatest("c", "j").alias("j"), "fp")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    tasks = tasks.repartition(parts, "b", "k", "s", "i", "j").sortWithinPartitions("b", "k", "s", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> pa.RecordBatch:
            cols = [t.column(x).to_numpy() for x in ("b", "k", "s", "i", "j")]
            fp = t.column("fp").to_numpy().view(np.uint64) ^ _FLIP
            change = np.zeros(len(fp), bool)
            for x in cols:
                change[1:] |= x[1:] != x[:-1]
            root = trie_links(fp, np.cumsum(change), budget)
            away = np.flatnonzero(root != np.arange(len(root)))
            back = (fp ^ _FLIP).view(np.int64)
            return pa.record_batch([pa.array(back[away]), pa.array(back[root[away]])], names=["a", "b"])

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(x.num_rows for x in kept) < flush:
                continue
            t = pa.Table.from_batches(kept)
            tail = [t.column(x).to_numpy() for x in ("b", "k", "s", "i", "j")]
            same = np.logical_and.reduce([x == x[-1] for x in tail])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield solve(t.slice(0, cut))
                kept = t.slice(cut).to_batches()
        if kept and sum(x.num_rows for x in kept):
            yield solve(pa.Table.from_batches(kept))

    return tasks.mapInArrow(run, "a long, b long")


def _classes(distinct: DataFrame, budget: int) -> DataFrame:
    """``distinct`` (fp, first_id, ...), a row for each fingerprint, with the columns root and component_id."""
    roots = materialize(components(links(distinct.select("fp"), budget)), "roots").withColumnRenamed("node", "fp")
    firsts = distinct.join(roots, "fp").groupBy("root").agg(F.min("first_id").alias("group_id"))
    grouped = roots.join(firsts, "root").select("fp", "root", "group_id")
    return distinct.join(grouped, "fp", "left").withColumn("root", F.coalesce("root", "fp")).withColumn("component_id", F.coalesce("group_id", "first_id")).drop("group_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, budget: int = 4) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id it reaches over links).

    Null, empty and blank texts have fingerprint zero and are linked to each other like any equal
    fingerprints. Rows with a null id are linked too; component_id ignores null ids and is null only where a component has no other.
    Repeated rows stay repeated. Other columns are not read. An empty table gives an empty result. Rows get their class by a join on the fingerprint; the fingerprints of over
    a ten-thousandth of all rows each, at most 10,000 of them, are sent to the rows instead.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    classes = materialize(_classes(distinct, budget).select("fp", "component_id", "n"), "classes")
    every = join_counted(prints, classes, "fp", "n", prints.count())
    return every.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, budget: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest id (null ids last); of rows with that id, one by hash.

    Rows are told apart by two 64-bit hashes of all columns; of wholly equal rows one stays. Columns of any name are kept. An empty table stays empty. Rows are pre-aggregated by fingerprint
    before they are joined to their class, and equal rows before they are shuffled.
    """
    every = [F.col(f"`{c}`").cast("string") for c in docs.columns]
    h = (F.xxhash64(F.lit(1), *(F.coalesce(c, F.lit("\0null")) for c in every)), F.xxhash64(F.lit(2), *(F.coalesce(c, F.lit("\0null")) for c in every)))
    prints = materialize(fingerprints(docs, id_col, text_col, size, carry=h), "fingerprints")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h0", "h1")).alias("best")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("first_id"), best), "distinct-fingerprints")
    kept = _classes(distinct, budget).groupBy("root").agg(F.min("best").alias("best")).select("best.h0", "best.h1")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), h[0].alias("h0"), h[1].alias("h1"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("h0", "h1").orderBy("h0"))).filter("n = 1")
    return first.join(kept, ["h0", "h1"], "left_semi").select("doc.*")
