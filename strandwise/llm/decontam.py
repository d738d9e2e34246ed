"""Benchmark decontamination: token windows of the corpus looked up in a hash set of normalised benchmark n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import materialize, numbered, ship

WINDOW = 13
#: UTF-8 bytes: digits, a-z and all bytes of code points from 0x80 stay, A-Z become a-z, the rest separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class NgramSet:
    """Distinct windows of the items: per window length a sorted array of 64-bit hashes, the place of each window in the items' stream of word ids, to verify a hit with, and the items it belongs to. All in flat arrays, about 30 bytes a window, besides the vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        vocabulary, parts, spans, at = self.vocabulary, [], {}, 0
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words(text)), np.int32)
            if len(ids):
                size = min(window, len(ids))
                spans.setdefault(size, []).append((at, len(ids) - size + 1, number[name]))
                parts.append(ids)
                at += len(ids)
        self.stream = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, found in sorted(spans.items()):
            where = np.concatenate([np.arange(a, a + n) for a, n, _ in found])
            owner = np.concatenate([np.full(n, i, np.int32) for _, n, i in found])
            for seed in range(1, 1000):
                base = np.random.default_rng(seed).integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
                hashes = self._hash(self.stream, where, base)
                by = np.lexsort((owner, hashes))
                hashes, start, item = hashes[by], where[by], owner[by]
                again = np.flatnonzero(hashes[1:] == hashes[:-1])
                if all((self.stream[start[again] + j] == self.stream[start[again + 1] + j]).all() for j in range(size)):
                    break
            first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            self.lengths[size] = (base, hashes[first], start[first], np.r_[first, len(hashes)], item)

    @staticmethod
    def _hash(ids: np.ndarray, at: np.ndarray, base: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(at), np.uint64)
        for j, b in enumerate(base):
            sums += ids[at + j].astype(np.uint64) * b
        return sums

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, positions, windows) of the verified occurrences in ``ids``; -1 is a word no item has."""
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for size, (base, hashes, start, _, _) in self.lengths.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            sums = self._hash(ids, at, base)
            k = np.minimum(np.searchsorted(hashes, sums), len(hashes) - 1)
            same = hashes[k] == sums
            at, k = at[same], k[same]
            true = (ids[at[:, None] + np.arange(size)] == self.stream[start[k][:, None] + np.arange(size)]).all(axis=1)
            yield size, at[true], k[true]

    def scan(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """For each text: its number of words, the hit word ranges [from, to), the items with a window in it, sorted as strings."""
        known, n = self.vocabulary.get, len(texts)
        parts, counts = [], []
        gap = np.full(1, -1, np.int64)
        for t in texts:
            w = words(t)
            counts.append(len(w))
            parts += [np.fromiter(map(known, w, [-1] * len(w)), np.int64, len(w)), gap]
        ids = np.concatenate(parts) if parts else gap
        starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
        steps = np.zeros(len(ids) + 1, np.int32)
        items: list[set[str]] = [set() for _ in range(n)]
        for size, at, k in self.occurrences(ids):
            np.add.at(steps, at, 1)
            np.add.at(steps, at + size, -1)
            edge, item = self.lengths[size][3:]
            docs = np.searchsorted(starts, at, "right") - 1
            for d, g in set(zip(docs.tolist(), k.tolist(), strict=True)):
                items[d].update(self.names[i] for i in item[edge[g] : edge[g + 1]])
        hit = np.diff(np.concatenate([[0], (np.cumsum(steps[:-1]) > 0).astype(np.int8), [0]]))
        begins, ends = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for d, a, b in zip((np.searchsorted(starts, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist(), strict=True):
            spans[d].append((a - int(starts[d]), b - int(starts[d])))
        return counts, spans, [sorted(x) for x in items]


#: What separates words, and the letters to fold, as in _FOLD.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _slices(benchmark: DataFrame, window: int, max_windows: int) -> list[DataFrame]:
    """The benchmark as tables (item, text) of at most ``max_windows`` windows each, or as much again by one piece.

    Windows are counted in Spark before anything is collected. An item of more windows is cut into pieces that overlap by a window less a word, so that they have its windows, each once.
    """
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    named = named.withColumn("w", F.filter(F.split(F.translate("text", _UPPER, _LOWER), _BETWEEN), lambda x: x != "")).filter("size(w) > 0")
    named = named.withColumn("n", F.greatest(F.lit(1), F.size("w") - (window - 1)))
    pieces = named.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / max_windows).cast("int"))))
    pieces = pieces.withColumn("n", F.least(F.lit(max_windows), F.col("n") - F.col("k") * max_windows)).withColumn("text", F.array_join(F.slice("w", F.col("k") * max_windows + 1, F.lit(max_windows + window - 1)), " "))
    pieces = materialize(pieces.select("item", "k", "n", "text", F.lit(0).alias("g"), F.xxhash64("item", "k", "text").alias("h")), "benchmark-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    if total <= max_windows:
        return [pieces.select("item", "text")]
    placed = materialize(numbered(pieces, ["g"], "h", ["item", "k", "text"], weight="n").withColumn("s", F.floor(F.col("before") / max_windows)).select("item", "text", "s"), "benchmark-slices")
    return [placed.filter(F.col("s") == s).select("item", "text") for s in range(total // max_windows + 1)]


def _ngrams(part: DataFrame, window: int) -> NgramSet:
    return NgramSet([(r["item"], r["text"]) for r in part.toLocalIterator()], window)


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_windows: int = 1_000_000) -> DataFrame:
    """Per row of ``docs``: id, n_words, spans (hit word ranges, end exclusive), items (ids as strings, sorted).

    A window is ``window`` consecutive words of an item, or all words of a shorter one. The set of windows is sent to the executors only after its
    windows were counted: above ``max_windows`` the benchmark is dealt into slices of so many, each scanned in its
    own pass, and a document's spans and items are put together again, so nothing is left out. Null and empty texts have no words; a null item id counts as
    the item "null"; item ids that occur twice are one item. Equal windows of several items count for each. No shuffle in the common case.
    """
    spark = docs.sparkSession
    ship(spark)
    slices = _slices(benchmark, window, max_windows)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if len(slices) > 1:
        source = materialize(source.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
    else:
        source = source.withColumn("row", F.lit(0).cast("long"))

    def scan_with(part: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(_ngrams(part, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for at in range(0, big.num_rows, 1000):
                    batch = big.slice(at, 1000)
                    counts, spans, names = shared.value.scan(batch.column(1).to_pylist())
                    ranges = [[{"from": a, "to": b} for a, b in s] for s in spans]
                    yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array(names, pa.list_(pa.string()))], names=["id", "row", "n_words", "spans", "items"])

        return source.mapInArrow(run, f"id {kind}, row long, n_words long, spans array<struct<from:int,to:int>>, items array<string>")

    if len(slices) == 1:
        return scan_with(slices[0]).drop("row")
    every = None
    for part in slices:  # a slice at a time is in memory, its hits are written
        hits = materialize(scan_with(part), "benchmark-hits")
        every = hits if every is None else every.unionByName(hits)
    merged = every.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    union = "aggregate(array_sort(spans), cast(array() as array<struct<from:int,to:int>>), (done, s) -> if(size(done) > 0 and element_at(done, -1).to >= s.from, concat(slice(done, 1, size(done) - 1), array(named_struct('from', element_at(done, -1).from, 'to', greatest(element_at(done, -1).to, s.to)))), concat(done, array(s))))"
    return merged.select("id", "n_words", F.expr(union).alias("spans"), "items")


def judge(hits: DataFrame, share: int = 20) -> DataFrame:
    """Add n_hit, n_items and contaminated: some word is hit, and at least one word in ``share``."""
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.to - s.from)")
    return hits.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's digest of ``find_hits`` and ``judge``."""
    judged = judge(find_hits(docs, benchmark, id_col, text_col))
    return judged.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, share: int = 20, max_windows: int = 1_000_000) -> DataFrame:
    """``docs`` without the contaminated rows; the rest unchanged, null texts and repeated rows included. Columns of any name are kept: rows are carried whole. An empty benchmark removes none, an empty table stays so."""
    spark = docs.sparkSession
    ship(spark)
    slices = _slices(benchmark, window, max_windows)
    if len(slices) > 1:
        marked = materialize(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "numbered-docs")
        bad = judge(find_hits(marked, benchmark, "row", "text", window, max_windows), share).filter("contaminated").select(F.col("id").alias("row"))
        return marked.join(bad, "row", "left_anti").select("doc.*")
    grams = spark.sparkContext.broadcast(_ngrams(slices[0], window))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 1000):
                batch = big.slice(i, 1000)
                counts, spans, _ = grams.value.scan(batch.column(at).to_pylist())
                hit = [sum(b - a for a, b in s) for s in spans]
                yield batch.filter(pa.array([not (h > 0 and share * h >= n) for h, n in zip(hit, counts, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` with the hit word ranges cut out of it, separators after the words included; null stays null."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    folded, begins, at = raw.translate(_FOLD), [], 0
    for w in folded.split():
        at = folded.index(w, at)
        begins.append(at)
        at += len(w)
    begins.append(len(raw))
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : begins[a]])
        last = begins[b]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
