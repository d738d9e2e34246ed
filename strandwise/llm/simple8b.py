"""Token ids in Simple-8b: word-aligned packing with escapes, in self-describing segments with per-block offsets."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import materialize, ship

# Fixed values of the coding: selector -> (ids in a word, bits of each). Selector 0 is a run of 240 zeros; 1 is an escape: the next word is one id of over 60 bits.
SELECTORS = ((240, 0), (1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 1
COUNTS = np.array([c for c, _ in SELECTORS])
BLOCK = 256
MAGIC = b"S8BSEG01"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths; exact by the exponent of a double up to 2^53, by the upper half beyond."""
    out = np.frexp(x.astype(np.float64))[1].astype(np.uint8)
    big = x >= np.uint64(1 << 53)
    if big.any():
        out[big] = 32 + np.frexp((x[big] >> np.uint64(32)).astype(np.float64))[1]
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, whether a block has escapes) for blocks of 256 ids.

    Greedy: each word takes the selector of the most ids that fit from its place. All blocks advance together, a word each step.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    grid = np.zeros((blocks, BLOCK + 240), np.uint64)  # padded, so that a word may reach past the block's end
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    width = _bits(grid[:, :BLOCK])
    best = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    unset = np.ones((blocks, BLOCK), bool)
    over = np.zeros((blocks, BLOCK + 1), np.int16)
    for s, (count, bits) in sorted(enumerate(SELECTORS), key=lambda x: -x[1][0]):
        if s == ESCAPE:
            continue
        np.cumsum(width > bits, axis=1, out=over[:, 1:])
        fits = np.empty((blocks, BLOCK), bool)
        fits[:, : BLOCK - count] = over[:, count:BLOCK] == over[:, : BLOCK - count]
        fits[:, BLOCK - count :] = over[:, BLOCK:] == over[:, BLOCK - count : BLOCK]
        fits &= unset
        best[fits] = s
        unset &= ~fits
        if not unset.any():
            break
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = n - (blocks - 1) * BLOCK
    rows, at = np.arange(blocks), np.zeros(blocks, np.int64)
    steps = []
    while len(rows):
        s = best[rows, at]
        steps.append((rows, at, s))
        at = at + COUNTS[s]
        more = at < sizes[rows]
        rows, at = rows[more], at[more]
    row, pos, sel = (np.concatenate(x) for x in zip(*steps, strict=True))
    by = np.argsort(row, kind="stable")
    row, pos, sel = row[by], pos[by], sel[by]
    place = np.cumsum(1 + (sel == ESCAPE)) - 1 - (sel == ESCAPE)
    words = np.zeros(int(len(sel) + (sel == ESCAPE).sum()), np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        k = np.flatnonzero(sel == s)
        if not len(k):
            continue
        word = np.full(len(k), np.uint64(s) << np.uint64(60), np.uint64)
        if s == ESCAPE:
            words[place[k] + 1] = grid[row[k], pos[k]]
        elif bits:
            for j in range(count):
                word |= grid[row[k], pos[k] + j] << np.uint64(j * bits)
        words[place[k]] = word
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    escaped = np.zeros(blocks, bool)
    escaped[row[sel == ESCAPE]] = True
    return words, place[first], escaped


def unpack(words: np.ndarray, first: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The ids of ``pack``. Blocks without escapes are decoded together, one selector at a time; the others word by word."""
    blocks = len(first)
    sizes = np.full(blocks, BLOCK)
    if blocks:
        sizes[-1] = n - (blocks - 1) * BLOCK
    out = np.zeros((blocks, BLOCK + 240), np.uint64)
    ends = np.append(first[1:], len(words))
    plain = np.flatnonzero(~escaped)
    if len(plain):
        each = ends[plain] - first[plain]
        row = np.repeat(plain, each)
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[plain], each)
        w = words[at]
        sel = (w >> np.uint64(60)).astype(np.int64)
        counts = COUNTS[sel]
        before = np.cumsum(counts) - counts
        starts = np.cumsum(each) - each
        pos = before - np.repeat(before[starts], each)
        for s, (count, bits) in enumerate(SELECTORS):
            k = np.flatnonzero(sel == s)
            if len(k) and bits and s != ESCAPE:
                mask = np.uint64((1 << bits) - 1)
                for j in range(count):
                    out[row[k], pos[k] + j] = (w[k] >> np.uint64(j * bits)) & mask
    for b in np.flatnonzero(escaped):
        p, i = 0, int(first[b])
        while p < sizes[b]:
            s = int(words[i] >> np.uint64(60))
            count, bits = SELECTORS[s]
            if s == ESCAPE:
                i += 1
                out[b, p] = words[i]
            else:
                for j in range(count if bits else 0):
                    out[b, p + j] = (words[i] >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
            i += 1
            p += count
    return out[:, :BLOCK].reshape(-1)[:n]


def write_segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """One file of the format: header (magic, documents, ids, blocks, words), document table (id or none, number of ids),
    block table (first word, escape flag) and the words, all little-endian."""
    words, first, escaped = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [MAGIC, struct.pack("<4Q", len(doc_ids), len(ids), len(first), len(words)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array(counts, "<u4").tobytes(), first.astype("<u8").tobytes(), escaped.astype(np.uint8).tobytes(), words.astype("<u8").tobytes()]
    return b"".join(parts)


def read_segment(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, number of ids of each, all ids) of a segment."""
    if blob[:8] != MAGIC:
        raise ValueError("no segment")
    docs, n, blocks, n_words = struct.unpack("<4Q", blob[8:40])
    at = 40

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(blob, kind, count, at)
        at += x.nbytes
        return x

    names, known, counts = take("<i8", docs), take("u1", docs), take("<u4", docs)
    first, escaped, words = take("<u8", blocks), take("u1", blocks), take("<u8", n_words)
    ids = unpack(words.astype(np.uint64), first.astype(np.int64), escaped.astype(bool), n)
    return [d if k else None for d, k in zip(names.tolist(), known, strict=True)], counts.astype(np.int64), ids


#: White space but the line end, which only begins pieces (and a few controls, for which the whole text is encoded without need).
_SPACE = r"[\t\f\r\v\p{Z}\x{85}\x{1c}-\x{1f}]"
_MARKS = ".,;:!?"


class Encoder:
    """The tokenizers library with a memory of the pieces between single blanks and line ends.

    A blank or line end between two characters that are no white space always begins a new piece of byte-level pre-tokenization, and closing
    marks after a letter or digit are one of their own, so such a text is its pieces' ids in a row, and each distinct piece is encoded once. Other texts (white space in a
    row, special strings) go to the library whole. Splitting and finding distinct pieces are Arrow's, putting ids together is numpy's.
    """

    def __init__(self, json: str, entries: int = 1_200_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t[0] in "\u0120\u010a"]] = True  # ids that open with a blank or a line end
        self.entries = entries
        self.memory: dict[str, bytes] = {}
        self.alone: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, pieces: list[str]) -> None:
        """Many pieces in one call: each is led by its one blank or line end, so its ids begin where an id opens with one."""
        for at in range(0, len(pieces), 10_000):
            some = pieces[at : at + 10_000]
            led = [p if p[0] == "\n" else " " + p for p in some]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(led)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(some):
                raw, ends = ids.tobytes(), (np.append(cuts, len(ids)) * 4).tolist()
                self.memory.update(zip(some, map(raw.__getitem__, map(slice, ends[:-1], ends[1:])), strict=True))
            else:
                self.memory.update((p, self._ids(t).tobytes()) for p, t in zip(some, led, strict=True))

    def _by_itself(self, pieces: list[str]) -> list[bytes]:
        for p in pieces:
            if p not in self.alone:
                self.alone[p] = self._ids(p).tobytes()
        return [self.alone[p] for p in pieces]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        n = len(texts)
        if not n:
            return []
        if len(self.memory) + len(self.alone) > self.entries:
            self.memory, self.alone = {}, {}
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        codes = split.flatten().dictionary_encode()
        names, at = codes.dictionary, codes.indices.to_numpy().astype(np.int64)
        odd = pc.match_substring_regex(names, rf"^\n?$|^\n?{_SPACE}|{_SPACE}$").to_numpy(zero_copy_only=False)
        stems = pc.utf8_rtrim(names, _MARKS)
        closed = pc.match_substring_regex(stems, r"[\p{L}\p{N}]$")
        stems = pc.if_else(closed, stems, names)
        marked = np.flatnonzero((pc.binary_length(names).to_numpy() > pc.binary_length(stems).to_numpy()) & ~odd)
        ends_in = pc.replace_substring_regex(names.take(pa.array(marked)), rf"(?s)^.*[^{_MARKS}]", "").dictionary_encode()

        first = split.flatten().take(pa.array(offsets[:-1]))
        later = np.ones(len(at), bool)
        later[offsets[:-1]] = False
        needed = np.zeros(len(names), bool)
        needed[at[later]] = True
        kinds = pc.if_else(pa.array(needed & ~odd), stems, pa.scalar(" ")).dictionary_encode()
        stem_names, stem_of = kinds.dictionary.to_numpy(zero_copy_only=False).tolist(), kinds.indices.to_numpy().astype(np.int64)
        self.memory[" "] = b""
        known = list(map(self.memory.get, stem_names))
        missing = [i for i, k in enumerate(known) if k is None]
        if missing:
            self._learn([stem_names[i] for i in missing])
            for i in missing:
                known[i] = self.memory[stem_names[i]]

        first_odd = odd[at[offsets[:-1]]]
        mark_of = np.full(len(names), -1)
        mark_of[marked] = len(known) + ends_in.indices.to_numpy()
        known += self._by_itself(ends_in.dictionary.to_pylist())
        none = len(known)
        known.append(b"")
        known += self._by_itself(["x" if o else f for f, o in zip(first.to_pylist(), first_odd.tolist(), strict=True)])
        mark_of[mark_of < 0] = none
        pairs = np.empty((len(at), 2), np.int64)
        pairs[:, 0], pairs[:, 1] = stem_of[at], mark_of[at]
        pairs[offsets[:-1], 0] = none + 1 + np.arange(n)
        pairs[offsets[:-1], 1] = none

        sizes = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        flat = np.frombuffer(b"".join(known), "<u4")
        seq = pairs.ravel()
        counts = sizes[seq]
        ends = np.cumsum(counts)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[seq] - (ends - counts), counts) + np.arange(ends[-1])]
        whole = np.zeros(n, bool)
        whole[np.searchsorted(offsets, np.flatnonzero(odd[at]), "right") - 1] = True
        whole |= pc.match_substring(first, "\n").to_numpy(zero_copy_only=False)
        for x in self.special:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        cuts = np.append((ends - counts)[2 * offsets[:-1]], ends[-1])
        return [self._ids(texts[i].as_py()) if w else ids[a:b] for i, (w, a, b) in enumerate(zip(whole.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(json: str) -> Encoder:
    """One encoder for each worker process, whose memory outlives a task."""
    key = zlib.crc32(json.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(json)
    return _ENCODERS[key]


def write(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = 1 << 18) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids in ascending document order as segments: (part, seq, ahead, n_ids, segment), ahead being the ids before it in its part.

    Texts are dealt into ranges of the id (then of a hash of the text, so one id with many rows spreads), each range is sorted and written in segments of about
    ``segment_ids`` ids. Null texts are empty; null ids come first. The tokenizer's file goes to the executors by broadcast: a file of
    fixed size, read on the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        json = spark.sparkContext.broadcast(f.read())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = _encoder(json.value)
        names: list[int | None] = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        size = ahead = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size, ahead, names, counts, held
            blob = write_segment(names, counts, np.concatenate(held) if held else np.zeros(0, np.uint64))
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ahead], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "ahead", "n_ids", "segment"])
            seq, ahead, size, names, counts, held = seq + 1, ahead + size, 0, [], [], []
            return row

        end = np.array([] if end_id is None else [end_id], "<u4")
        for big in batches:
            for at in range(0, big.num_rows, 3000):
                batch = big.slice(at, 3000)
                for name, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                    names.append(name)
                    held += [ids, end]
                    counts.append(len(ids) + len(end))
                    size += counts[-1]
                    if size >= segment_ids:
                        yield flush()
        if names:
            yield flush()

    return materialize(rows.mapInArrow(run, "part int, seq int, ahead long, n_ids long, segment binary"), "segments")


def read(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of the segments: id, start (ids of all documents before it), n_tokens, ids_crc32, and part and seq of its segment.

    A document's start is the ids of the parts before, those ahead of its segment in its part, and those before it in the segment. Only the
    parts' sums are sent to all tasks: one number for each partition of the writing shuffle, whose count is a setting.
    """
    spark = segments.sparkSession
    ship(spark)
    totals = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    heads, total = {}, 0
    for part in sorted(totals):
        heads[part], total = total, total + totals[part]
    rows = segments.select("part", "seq", "ahead", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, ahead, blob in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                names, counts, ids = read_segment(blob.as_py())
                ids, start = ids.astype("<u4"), heads[part] + ahead
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(ids[e - c : e].tobytes()) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array([part] * len(names), pa.int32()), pa.array([seq] * len(names), pa.int32())], names=[id_col, "start", "n_tokens", "ids_crc32", "part", "seq"])

    return rows.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long, part int, seq int")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the segments, then report each document from what was read back.

    Null and empty texts have the end id alone. Rows that repeat an id follow each other; wholly equal rows are interchangeable. No documents: no rows.
    """
    return read(write(docs, tokenizer_path, end_id, id_col, text_col), id_col)
