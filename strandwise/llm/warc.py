"""WARC archives of pages with revisit records, and a two-level capture index to read them back by."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import materialize, qualified, shared_dir, ship

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:strandwise:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed and joined by commas, port if not the scheme's own, ``)``, path and query; lower case, no fragment. Null: ``-``."""
    if url is None:
        return "-"
    m = re.match(r"(?:([a-z][a-z0-9+.-]*)://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", url.strip().lower(), re.S)
    host = ",".join(reversed(m[2].split(".")))
    port = f":{m[3]}" if m[3] and m[3] != {"http": "80", "https": "443"}.get(m[1] or "http") else ""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02x}", f"{host}{port}){m[4] or '/'}")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record, compressed as a gzip member of its own; with ``refers_to`` a revisit."""
    sha = hashlib.sha1(payload).digest()
    return revisit(page_id, url, sha, len(payload), refers_to) if refers_to is not None else _member(page_id, url, sha, len(payload), payload, [])


def revisit(page_id: int | None, url: str | None, sha: bytes, size: int, refers_to: int) -> bytes:
    """A revisit record: the HTTP head alone, and the digest of the payload it stands for."""
    return _member(page_id, url, sha, size, b"", [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"])


def _member(page_id: int | None, url: str | None, sha: bytes, size: int, payload: bytes, more: list[str]) -> bytes:
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if more else 'response'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}"]
    head += [*more, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """Headers (lower-case names) of a record, its HTTP head and payload; the payload of a response is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *fields = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record")
    out = {k.lower(): v for k, _, v in (f.partition(": ") for f in fields)}
    size = int(out["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("wrong record length")
    out["http"], _, out["payload"] = rest[:size].partition(b"\r\n\r\n")
    if out["warc-type"] == "response" and out["warc-payload-digest"] != f"sha1:{digest(out['payload'])}":
        raise ValueError("payload digest")
    return out


def _number(urn: str) -> int | None:
    text = urn.strip("<>").removeprefix(ID)
    return int(text) if text else None


def files(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified folder, and the folder's path in it; for executors, which open archives at an offset."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def packed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, max_broadcast: int = 300_000) -> DataFrame:
    """(id, url, sha, size, member, refers_to): each page with what it refers to: of pages with equal payloads of at least ``least_bytes``, all but those with the largest id do. ``member`` is the response record of the others, null for these.

    Groups are found by SHA-1 and length, pre-aggregated, only those of several pages are kept and counted: up to ``max_broadcast`` of them (some 30 MB) are sent to the pages, which then aren't shuffled; more are joined by
    sorted partitions, for which pages are compressed first, and which can be split where a payload is common. Rows that share the largest id are all responses; null ids refer to the largest id, or to none if all are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packs = [None if refers_to is not None else record(name, url, page.as_py().encode("utf-8", "surrogatepass")) for name, url, page, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(5).to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns[:2], *batch.columns[3:], pa.array(packs, pa.binary())], names=["id", "url", "sha", "size", "refers_to", "member"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").cast("long").alias("size"))
    groups = rows.groupBy("sha", "size").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).filter(F.col("size") >= least_bytes).select("sha", "size", "last")
    groups = materialize(groups, "payload-groups")
    refers = F.when(F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("id")), F.col("last")).alias("refers_to")
    schema = "id long, url string, sha string, size long, refers_to long, member binary"
    if groups.count() <= max_broadcast:
        return rows.join(F.broadcast(groups), ["sha", "size"], "left").select("id", "url", "html", "sha", "size", refers).mapInArrow(run, schema)
    members = rows.withColumn("refers_to", F.lit(None).cast("long")).mapInArrow(run, schema).drop("refers_to")
    joined = members.join(groups.hint("merge"), ["sha", "size"], "left").withColumn("refers_to", refers)
    return joined.select("id", "url", "sha", "size", "refers_to", F.expr("if(refers_to is null, member, null)").alias("member"))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = 4 << 20) -> DataFrame:
    """Write one record for each page into .warc.gz files of about ``archive_bytes`` in the shared folder; returns their captures: (key, archive, offset, length, kind), archive being a file's path.

    Tasks write files of their own, under names that are never used again, and a file counts by its captures alone: what a lost or repeated task leaves is read by none.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = qualified(spark, f"{shared_dir(spark).rstrip('/')}/strandwise/archives-{uuid.uuid4().hex}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, top = files(folder)
        part, held, lines, size = TaskContext.get().partitionId(), [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, lines, size
            name = f"{part:06d}-{uuid.uuid4().hex}.warc.gz"
            path = f"{folder}/{name}"
            fs.create_dir(top)
            with fs.open_output_stream(f"{top}/{name}", compression=None) as out:
                out.write(b"".join(held))
            keys, offsets, lengths, kinds = (list(x) for x in zip(*lines, strict=True))
            held, lines, size = [], [], 0
            return pa.record_batch([pa.array(keys, pa.string()), pa.array([path] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(kinds, pa.string())], names=["key", "archive", "offset", "length", "kind"])

        for batch in batches:
            for name, url, sha, n, refers_to, member in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5), strict=True):
                held.append(member.as_py() if refers_to is None else revisit(name, url, bytes.fromhex(sha), n, refers_to))
                lines.append((url_key(url), size, len(held[-1]), "response" if refers_to is None else "revisit"))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return materialize(packed(pages, id_col, url_col, html_col, least_bytes).mapInArrow(run, "key string, archive string, offset long, length long, kind string"), "captures")


def members(data: bytes) -> Iterator[tuple[int, int]]:
    """(offset, length) of each gzip member."""
    at = 0
    while at < len(data):
        unpacker = zlib.decompressobj(31)
        rest = memoryview(data)[at:]
        step, used = 1 << 16, 0
        while not unpacker.eof:
            piece = rest[used : used + step]
            if not len(piece):
                raise ValueError("cut off member")
            unpacker.decompress(piece)
            used += len(piece)
        used -= len(unpacker.unused_data)
        yield at, used
        at += used


def captures_of(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(key, offset, length, kind) of each record of an archive, for archives without a list of captures."""
    for offset, length in members(data):
        got = parse(data[offset : offset + length])
        yield url_key(got["warc-target-uri"] or None), offset, length, got["warc-type"]


def index(captures: DataFrame, lines_per_block: int = 3000, max_blocks: int = 1_000_000) -> DataFrame:
    """The capture index: (part, block, first_key, lines, data). Each block is up to ``lines_per_block`` lines ``key date archive offset length kind`` in order of their keys, zlib-compressed; more lines where there would be over ``max_blocks`` blocks.

    Captures are dealt into ranges of (key, archive, offset), so one common key spreads too, and sorted within; part and block follow the order of keys.
    """
    spark = captures.sparkSession
    ship(spark)
    lines_per_block = max(lines_per_block, -(-captures.count() // max_blocks))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = captures.select("key", "archive", "offset", "length", "kind").repartitionByRange(parts, "key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, first = TaskContext.get().partitionId(), 0, [], ""

        def flush() -> pa.RecordBatch:
            nonlocal n, held
            data = zlib.compress("\n".join(held).encode(), 6)
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([first]), pa.array([len(held)], pa.int32()), pa.array([data], pa.binary())], names=["part", "block", "first_key", "lines", "data"])
            n, held = n + 1, []
            return row

        for batch in batches:
            for key, archive, offset, length, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not held:
                    first = key
                held.append(f"{key} {DATE} {archive} {offset} {length} {kind}")
                if len(held) == lines_per_block:
                    yield flush()
        if held:
            yield flush()

    return materialize(rows.mapInArrow(blocks, "part int, block int, first_key string, lines int, data binary"), "capture-index")


class Directory:
    """The sparse level of the index, one entry a block, in key order: finds the blocks that can hold a key by binary search."""

    def __init__(self, blocks: DataFrame) -> None:
        rows = sorted((r["part"], r["block"], r["first_key"]) for r in blocks.select("part", "block", "first_key").toLocalIterator())
        self.entries, self.keys = [r[:2] for r in rows], [r[2] for r in rows]

    def blocks_of(self, key: str) -> list[tuple[int, int]]:
        low = max(0, bisect.bisect_left(self.keys, key) - 1)
        return self.entries[low : bisect.bisect_right(self.keys, key)]


def find(data: bytes, keys: list[str]) -> list[tuple[str, int, int]]:
    """(archive, offset, length) of the lines of a block that have one of the keys, each key found by binary search."""
    lines = [line.split(" ") for line in zlib.decompress(data).decode().split("\n")]
    sorted_keys, out = [x[0] for x in lines], []
    for key in keys:
        for x in lines[bisect.bisect_left(sorted_keys, key) : bisect.bisect_right(sorted_keys, key)]:
            out.append((x[2], int(x[3]), int(x[4])))
    return out


def lookup(blocks: DataFrame, urls: DataFrame, url_col: str = "url", payload: bool = True) -> DataFrame:
    """The records of the URLs in a column of ``urls``, any number of them: id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null of a revisit).

    The distinct keys are looked up in the directory (at most ``max_blocks`` entries of ``index``, sent to the tasks), met with their blocks, looked up there, and the byte ranges found are read from the archives, in order of
    archive and offset. No archive is shuffled or read beyond those ranges. A revisit tells its payload's size by its HTTP head. Unknown URLs have no records; null URLs are one key.
    """
    spark = blocks.sparkSession
    ship(spark)
    directory = spark.sparkContext.broadcast(Directory(blocks))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(key, *at) for key in batch.column(0).to_pylist() for at in directory.value.blocks_of(key)]
            yield pa.record_batch([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], names=["key", "part", "block"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, keys in zip(batch.column(0), batch.column(1), strict=True):
                got = find(data.as_py(), keys.as_py())
                yield pa.record_batch([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], names=["archive", "offset", "length"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != path:
                    if source:
                        source.close()
                    (fs, where), path = files(archive), archive
                    source = fs.open_input_file(where)
                got = parse(source.read_at(length, offset))
                response = got["warc-type"] == "response"
                size = len(got["payload"]) if response else int(re.search(rb"\r\nContent-Length: (\d+)", got["http"])[1])
                rows.append((_number(got["warc-record-id"]), got["warc-target-uri"] or None, size, got["warc-payload-digest"].removeprefix("sha1:"), got["warc-type"], None if response else _number(got["warc-refers-to"]), got["payload"] if payload and response else None))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if source:
            source.close()

    keys = urls.select(F.col(url_col).cast("string").alias("url")).distinct().mapInArrow(keyed, "key string").distinct()
    wanted = keys.mapInArrow(route, "key string, part int, block int").groupBy("part", "block").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    ranges = blocks.select("part", "block", "data").join(wanted.hint("merge"), ["part", "block"]).select("data", "keys").mapInArrow(search, "archive string, offset long, length long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranges = ranges.repartition(parts, "archive").sortWithinPartitions("archive", "offset")
    return ranges.mapInArrow(fetch, "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives and index, then report every page from what looking up its URL in the index reads back from them.

    Null pages are empty payloads; null ids and URLs are written as such. Repeated rows stay, columns of other names are not read. No pages: no rows.
    """
    blocks = index(write(pages, id_col, url_col, html_col))
    found = lookup(blocks, pages, url_col, payload=False)
    return found.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
