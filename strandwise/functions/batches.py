"""Columns of Arrow batches as flat numpy arrays: strings, lists, aligned blocks. A row's elements stand one after the other, and rows do."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row's begin; one more for the end of the last."""
    a = column.cast(pa.large_binary())
    edges = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    return np.frombuffer(a.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each row's begin; one more for the end of the last."""
    edges = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), edges - edges[0]


def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ``sizes`` elements each element's row, and its place within the row."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def row_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


@lru_cache(1 << 16)
def aligned_runs(cigar: str | None) -> tuple[tuple[int, int, int], ...]:
    """As ``functions.records.blocks``: (read_start, place after the alignment's start, len) of the aligned runs."""
    read = place = 0
    out = []
    for n, op in re.findall("([0-9]+)([MIDNSHP=X])", cigar or ""):
        if op in "M=X":
            out.append((read, place, int(n)))
        read += int(n) if op in "M=XIS" else 0
        place += int(n) if op in "M=XDN" else 0
    return tuple(out)


def aligned_blocks(cigars: pa.Array, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, read_start, ref_start, len) of all aligned runs, in order; each distinct CIGAR string is parsed once."""
    coded = cigars.dictionary_encode()
    runs = [aligned_runs(c) for c in coded.dictionary.to_pylist()] + [()]
    codes = coded.indices.fill_null(len(runs) - 1).to_numpy().astype(np.int64)
    sizes = np.array([len(x) for x in runs])
    flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
    row, k = spread(sizes[codes])
    found = flat[(np.cumsum(sizes) - sizes)[codes[row]] + k]
    return row, found[:, 0], found[:, 1] + pos[row], found[:, 2]


def binary_column(data: np.ndarray, edges: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary (or string) column of bytes and the places where rows begin."""
    return pa.Array.from_buffers(kind or pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data, np.uint8))])
