"""BAM files as a Spark data source: ``spark.dataSource.register(BamSource)``, then ``spark.read.format("bam").load(path)``."""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, idx long, name string, flags int, contig int, contig_name string, pos int, mapq int, cigar string, mate_contig int, mate_pos int, tlen int, bases string, quals array<int>, tags map<string,string>"
_OPS = "MIDNSHP=X"
_BASES = "=ACMGRSVTWYHKDBN"
_SIZES = {"c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_CODES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def inflate(path: str) -> Iterator[bytes]:
    """The inflated blocks of a BGZF file; each block's checksum and length are tested."""
    with open(path, "rb") as f:
        while head := f.read(18):
            if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
                raise ValueError(f"{path}: no BGZF block")
            size = struct.unpack("<H", head[16:18])[0] + 1
            body = f.read(size - 18)
            data = zlib.decompress(body[:-8], -15)
            if struct.unpack("<II", body[-8:]) != (zlib.crc32(data), len(data)):
                raise ValueError(f"{path}: damaged BGZF block")
            yield data


def terminator(path: str) -> str:
    """Whether a BGZF file ends with the empty block that says it is whole: HAS_TERMINATOR_BLOCK; if not, whether its last block is: HAS_HEALTHY_LAST_BLOCK, else DEFECTIVE."""
    with open(path, "rb") as f:
        f.seek(0, os.SEEK_END)
        size = f.tell()
        f.seek(max(0, size - len(_EOF)))
        if f.read() == _EOF:
            return "HAS_TERMINATOR_BLOCK"
        f.seek(max(0, size - 65536))
        tail = f.read()
    start = tail.rfind(b"\x1f\x8b\x08\x04")
    while start >= 0:
        if len(tail) >= start + 18 and struct.unpack("<H", tail[start + 16 : start + 18])[0] + 1 == len(tail) - start:
            return "HAS_HEALTHY_LAST_BLOCK"
        start = tail.rfind(b"\x1f\x8b\x08\x04", 0, start + 3)
    return "DEFECTIVE"


def _records(path: str) -> Iterator[tuple]:
    blocks, held, used = inflate(path), b"", 0

    def take(n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end of the file; what is left of a block is copied only where a field crosses its end."""
        nonlocal held, used
        while len(held) - used < n and (piece := next(blocks, None)) is not None:
            held, used = held[used:] + piece, 0
        out = held[used : used + n]
        used += len(out)
        return out

    if take(4) != b"BAM\1":
        raise ValueError(f"{path}: no BAM file")
    take(struct.unpack("<i", take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", take(4))[0]):
        names.append(take(struct.unpack("<i", take(4))[0])[:-1].decode())
        take(4)
    idx = 0
    while size := take(4):
        r = take(struct.unpack("<i", size)[0])
        if len(r) != struct.unpack("<i", size)[0]:
            raise ValueError(f"{path}: truncated at record {idx}")
        ref, pos, l_name, mapq, _, n_ops, flags, l_seq, mate, mate_pos, tlen = struct.unpack("<iiBBHHHiiii", r[:32])
        at = 32 + l_name
        ops = struct.unpack(f"<{n_ops}I", r[at : at + 4 * n_ops])
        at += 4 * n_ops
        packed = r[at : at + (l_seq + 1) // 2]
        at += len(packed)
        bases = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
        quals = list(r[at : at + l_seq])
        at += l_seq
        yield path, idx, r[32 : 31 + l_name].decode(), flags, ref, names[ref] if ref >= 0 else None, pos + 1, mapq, "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*", mate, mate_pos + 1, tlen, bases, [] if quals and quals[0] == 255 else quals, _tags(r[at:])
        idx += 1


def _tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(raw):
        key, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            out[key] = raw[at:end].decode()
            at = end + 1
        elif kind == "A":
            out[key] = chr(raw[at])
            at += 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack("<I", raw[at + 1 : at + 5])[0]
            out[key] = ",".join([sub, *map(str, struct.unpack(f"<{n}{_CODES[sub]}", raw[at + 5 : at + 5 + n * _SIZES[sub]]))])
            at += 5 + n * _SIZES[sub]
        else:
            out[key] = str(struct.unpack(f"<{_CODES[kind]}", raw[at : at + _SIZES[kind]])[0])
            at += _SIZES[kind]
    return out


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*.bam")) if os.path.isdir(self.path) else glob.glob(self.path))
        if not found:
            raise FileNotFoundError(self.path)
        return [_File(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _records(partition.value)


class BamSource(DataSource):
    """A path, glob or folder of BAM files on storage that every executor mounts; a partition is a file, read a block at a time. CRAM is not read."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file://"))


def encode(rows: list[dict], contigs: list[tuple[str, int]], header: str = "@HD\tVN:1.6\n") -> bytes:
    """A BAM file of some records (canonical columns), for export of bounded results and for tests."""
    text = header.encode()
    out = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(contigs))]
    for name, length in contigs:
        out += [struct.pack("<i", len(name) + 1), name.encode() + b"\0", struct.pack("<i", length)]
    import re

    for r in rows:
        name = r["name"].encode() + b"\0"
        ops = [int(n) << 4 | _OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"])]
        codes = [_BASES.index(b) for b in r["bases"]] + [0] * (len(r["bases"]) % 2)
        seq = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        quals = bytes(r["quals"]) if r["quals"] else b"\xff" * len(r["bases"])
        tags = b"".join(k.encode() + b"Z" + v.encode() + b"\0" for k, v in sorted((r.get("tags") or {}).items()))
        body = struct.pack("<iiBBHHHiiii", r["contig"], r["pos"] - 1, len(name), r["mapq"], 0, len(ops), r["flags"], len(r["bases"]), r["mate_contig"], r["mate_pos"] - 1, r["tlen"]) + name + struct.pack(f"<{len(ops)}I", *ops) + seq + quals + tags
        out += [struct.pack("<i", len(body)), body]
    data, blocks = b"".join(out), []
    for at in range(0, len(data), 60_000):
        piece = data[at : at + 60_000]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(piece) + packer.flush()
        blocks.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(piece), len(piece)))
    return b"".join([*blocks, _EOF])


def read_bam(spark, path: str, groups: DataFrame | None = None) -> DataFrame:
    """Records of BAM files in canonical columns; ``groups`` (rg, library, sample) names the libraries of read groups."""
    from .text import canonical

    spark.dataSource.register(BamSource)
    return canonical(spark.read.format("bam").load(path), groups=groups)
