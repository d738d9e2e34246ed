"""Media columns: 8-bit PNG images written and read chunk by chunk, and cosine-transform hashes of their samples."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import materialize, ship

MAGIC = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
SIDE = 32


class PngError(ValueError):
    """A damaged or unsupported PNG."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: np.ndarray, level: int = 3) -> bytes:
    """A grey or RGB (height, width[, 3]) uint8 array as PNG. Each row takes the filter None, Sub or Up of the least sum of signed sizes."""
    height, width = samples.shape[:2]
    channels = samples.shape[2] if samples.ndim == 3 else 1
    rows = np.ascontiguousarray(samples).reshape(height, -1)
    left = np.zeros_like(rows)
    left[:, channels:] = rows[:, :-channels]
    up = np.vstack([np.zeros_like(rows[:1]), rows[:-1]])
    options = np.stack([rows, rows - left, rows - up])
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    pick = cost.argmin(axis=0)
    lines = np.empty((height, rows.shape[1] + 1), np.uint8)
    lines[:, 0] = pick
    lines[:, 1:] = options[pick, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    kinds, data = lines[:, 0], lines[:, 1:]
    out = np.zeros_like(data)
    height, width = data.shape
    if kinds.max(initial=0) > 4:
        raise PngError(f"filter {kinds.max()}")
    at = 0
    while at < height:
        end = at + 1
        while end < height and kinds[end] == kinds[at]:
            end += 1
        kind = kinds[at]
        if kind == 0:
            out[at:end] = data[at:end]
        elif kind == 1:
            out[at:end] = np.add.accumulate(data[at:end].reshape(end - at, -1, step), axis=1, dtype=np.uint8).reshape(end - at, -1)
        elif kind == 2:
            first = out[at - 1 : at] if at else np.zeros_like(data[:1])
            out[at:end] = np.add.accumulate(np.vstack([first, data[at:end]]), axis=0, dtype=np.uint8)[1:]
        else:
            for y in range(at, end):
                above = out[y - 1].astype(int) if y else np.zeros(width, int)
                row = np.zeros(width + step, int)
                for x in range(width):
                    a, b = row[x], above[x]
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        c = above[x - step] if x >= step else 0
                        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                    row[x + step] = (data[y, x] + guess) & 255
                out[y] = row[step:]
        at = end
    return out


def decode_png(blob: bytes) -> np.ndarray:
    """The samples of a non-interlaced 8-bit grey or RGB PNG; chunk checksums, order and sizes are tested. Raises PngError."""
    if blob[:8] != MAGIC:
        raise PngError("no PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(blob) and not ended:
        if at + 12 > len(blob):
            raise PngError("cut off")
        size, kind = struct.unpack(">I4s", blob[at : at + 8])
        body = blob[at + 8 : at + 8 + size]
        if len(body) != size or blob[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise PngError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise PngError(f"unknown chunk {kind!r}")
        at += 12 + size
    if not head or not ended:
        raise PngError("no header or no end")
    width, height, depth, colour, method, filters, interlace = head
    if depth != 8 or colour not in (0, 2) or method or filters or interlace or not width or not height:
        raise PngError(f"unsupported header {head}")
    step = 3 if colour == 2 else 1
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise PngError(str(e)) from e
    if len(raw) != height * (width * step + 1):
        raise PngError("wrong number of samples")
    out = _unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), step)
    return out.reshape(height, width, 3) if step == 3 else out


_K = np.arange(SIDE)
_COSINE = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:8, None] / (2 * SIDE))


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: means over a 32 x 32 grid, the 8 x 8 lowest cosine terms, a bit for each term above their median without the constant term."""
    grey = samples if samples.ndim == 2 else samples.mean(axis=2)

    def cells(x: np.ndarray) -> np.ndarray:
        n = len(x)
        if n < SIDE:
            return x[_K * n // SIDE].astype(float)
        cuts = _K * n // SIDE
        return np.add.reduceat(x.astype(float), cuts, axis=0) / np.diff(np.append(cuts, n))[:, None]

    grid = cells(cells(grey).T).T
    low = np.round(_COSINE @ grid @ _COSINE.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload(text: str | None, unit: int = WIDTH) -> tuple[int, bytes]:
    """The UTF-8 bytes of a text (null: none), and those with zeros up to a positive multiple of ``unit``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a grey PNG of 64 samples a row in a binary column, written to the shared folder and reread."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 500):
                batch = big.slice(i, 500)
                sizes, media = [], []
                for t in batch.column(1):
                    n, raw = payload(t.as_py())
                    sizes.append(n)
                    media.append(encode_png(np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)))
                yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary"), "media")


def features(media: DataFrame) -> DataFrame:
    """Decode a media table (id, n_bytes, media): payload size, digests of the payload and of the stored form, and the cosine hash, binary and as hex."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sha, tails, stored, stored_sha, hashes = [], [], [], [], [], []
            for m in batch.column(2):
                blob = m.as_py()
                samples = decode_png(blob)
                raw = samples.tobytes()
                sizes.append(len(raw))
                sha.append(hashlib.sha256(raw).hexdigest())
                tails.append(zlib.crc32(raw[-64:]))
                stored.append(len(blob))
                stored_sha.append(hashlib.sha256(blob).hexdigest())
                hashes.append(cosine_hash(samples))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sha, pa.string()), pa.array(tails, pa.int64()), pa.array(stored, pa.int64()), pa.array(stored_sha, pa.string()), pa.array([h.hex() for h in hashes], pa.string()), pa.array(hashes, pa.binary())], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "cosine_hash"])

    kind = media.schema["id"].dataType.simpleString()
    return media.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, cosine_hash binary")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an image and compute its features from what was stored.

    Null and empty texts are one row of zeros. Equal texts give equal values. Repeated rows and ids stay; other columns are not read. Neither step shuffles.
    """
    return features(store(docs, id_col, text_col)).withColumnRenamed("id", id_col)
