"""WARC archives: writing with deduplication and segments, reading with segment reassembly.

Each row becomes a record. Of rows with equal payloads the one with the smallest id is a response, all
others revisit it. A response's block is an HTTP message with chunked transfer framing; a block longer
than `segment_bytes` is cut into segments: the first is the response with WARC-Segment-Number 1, the
others are continuation records that name it by WARC-Segment-Origin-ID; the last holds the total length.
Records are gzip members; a task writes one file after another into the shared folder, each under a name
of its own attempt, and renames it when complete, so a task that is run again leaves no half files. It
returns ranges of whole records, as an index of the archive, so that many tasks can read one file.

Reading takes whole records from these ranges, once. Those in one piece are decoded at once; the segments of
an origin are grouped, ordered by number and joined, when none is missing and the lengths sum to the total.
Chunked framing is decoded and digests are verified. A broken record stops the job.

Only (id, digest) pairs are shuffled for deduplication, and only segments for reassembly: a group is one
record, not one payload's copies.

Defined cases: a null payload is empty; empty payloads are equal to each other; payloads under `least`
bytes are all responses; rows that share the smallest id of a payload are all responses; a row without an
id revisits a row with an id, if one has its payload, and is a response otherwise; very long payloads have as
many segments as they need; an empty table gives no files; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, read_table, slices, stage

SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES, RANGE_BYTES = 32_768, 8_192, 32 << 20, 2 << 20
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | str, segment: int = 1) -> str:
    """page: its id, or where that is missing or repeated a name of its own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{segment}')}>"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body behind chunked transfer framing, trailers left out; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        out.append(framed[at : at + size])
        if len(out[-1]) != size or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += size + 2


def record(kind: str, rid: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": DATE, **fields, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def records(page_id: int | None, name: int | str, url: str, payload: bytes, refers_to: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page; name is what its record ids are made of."""
    digest = "sha1:" + base32_sha1(payload)
    fields = {"WARC-Target-URI": " ".join(url.split()), "WARC-Payload-Digest": digest} | ({} if page_id is None else {"X-Page-ID": str(page_id)})
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        more = {"WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": str(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Content-Type": "application/http; msgtype=response"}
        yield record("revisit", record_id(name), fields | more, block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields |= {"Content-Type": "application/http; msgtype=response"}
    if len(block) <= segment_bytes:
        yield record("response", record_id(name), fields, block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record("response", record_id(name), fields | {"WARC-Segment-Number": "1"}, parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = {"WARC-Segment-Total-Length": str(len(block))} if k == len(parts) else {}
        yield record("continuation", record_id(name, k), {"WARC-Segment-Origin-ID": record_id(name), "WARC-Segment-Number": str(k), **total}, part)


_RANGES = "path string, start long, stop long, n_records long"


def write(pages: DataFrame, folder: str | None = None, least: int = 0, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes (page_id, url, html) as archives; the table of their ranges (path, start, stop, n_records, folder), which holds once written."""
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least
    # payloads and ids that stand more than once: where they are few, Spark broadcasts them and pages stay in place
    copies = stage(rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"), "copies")
    repeats = stage(rows.where("page_id is not null").groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select("page_id", F.lit(True).alias("again")), "repeats")
    refers = F.when(large & (F.coalesce("page_id", F.col("first") - 1) != F.col("first")), F.col("first"))
    marked = rows.join(copies, "digest", "left").join(repeats, "page_id", "left").select("page_id", "url", "html", refers.alias("refers_to"), (F.col("page_id").isNull() | F.col("again").isNotNull()).alias("renamed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, files, rows = f"part-{task.partitionId():06d}", 0, 0
        done, out, start, n, size = [], None, 0, 0, 0

        def close() -> None:
            if n:
                done.append((final, start, size, n))
            out.close()
            fs.move(temp, final)

        for batch in batches:
            for page, url, html, refers, renamed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    final = f"{root}/{part}-{files:04d}.warc.gz"
                    temp = f"{final}.{task.taskAttemptId()}.tmp"
                    out, start, n, size, files = fs.open_output_stream(temp, compression=None), 0, 0, 0, files + 1
                name = f"{page}/{part}/{rows}" if renamed else page
                rows += 1
                for r in records(page, name, url, html.encode(), refers, segment_bytes):
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = z.compress(r) + z.flush()
                    out.write(data)
                    n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    close()
                    out = None
                elif size - start >= range_bytes:
                    done.append((final, start, size, n))
                    start, n = size, 0
        if out is not None:
            close()
        columns = list(zip(*done, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in _RANGES.split(", ")])

    return stage(marked.mapInArrow(run, _RANGES).withColumn("folder", F.lit(folder)), "files")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a stream of gzip members, one at a time."""
    z, data, raw = zlib.decompressobj(31), bytearray(), b""
    while True:
        raw = raw or stream.read(1 << 20)
        if not raw:
            if data or z.unconsumed_tail:
                raise ValueError("the last record is cut off")
            return
        data += z.decompress(raw)
        raw = b""
        if z.eof:
            raw, z = z.unused_data, zlib.decompressobj(31)
            end = data.index(b"\r\n\r\n")
            lines = bytes(data[:end]).decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            block = bytes(data[end + 4 : end + 4 + int(fields["Content-Length"])])
            if len(block) != int(fields["Content-Length"]) or data[end + 4 + len(block) :] != b"\r\n\r\n":
                raise ValueError("wrong record length")
            yield fields, block
            data.clear()


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_SEGMENT = "origin string, segment int, total long, block binary"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, named, strict=True)], [n for n, _ in named])


def page_of(fields: tuple, block: bytes, payloads: bool) -> tuple:
    """A row of PAGES from (page_id, kind, digest, refers_to) of a record and its whole block."""
    page, kind, digest, refers = fields
    head, body = block.split(b"\r\n\r\n", 1)
    http = {k.lower(): v for k, v in (x.split(b": ", 1) for x in head.split(b"\r\n")[1:])}
    if kind == "revisit":
        return page, int(http[b"content-length"]), digest, kind, refers, None
    payload = unchunked(body) if http.get(b"transfer-encoding") == b"chunked" else body
    if (found := base32_sha1(payload)) != digest:
        raise ValueError(f"page {page}: the payload's digest is {found}, not {digest}")
    return page, len(payload), digest, kind, None, payload if payloads else None


def joined(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a record from its segments (number, total or null, bytes) in any order; ValueError where one is missing or repeated."""
    parts = sorted(parts, key=lambda x: x[0])
    block = b"".join(x[2] for x in parts)
    if [x[0] for x in parts] != list(range(1, len(parts) + 1)) or len(block) != parts[-1][1]:
        raise ValueError("segments missing")
    return block


def read_records(ranges: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the ranges (path, start, stop, folder), which are read once: rows of PAGES, null but for the id fields where it is a segment."""
    schema = f"{PAGES}, {_SEGMENT}"
    n = ranges.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for path, start, stop, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs = FileSystem.from_uri(folder)[0]
                rows, size = [], 0
                with fs.open_input_file(path) as file:
                    file.seek(start)
                    for f, block in parse(_Range(file, stop - start)):
                        own = number(f.get("X-Page-ID")), f["WARC-Type"], f.get("WARC-Payload-Digest", "").removeprefix("sha1:"), number(f.get("X-Refers-To-Page-ID"))
                        if "WARC-Segment-Number" in f:
                            rows.append((own[0], None, own[2], own[1], None, None, f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), int(f["WARC-Segment-Number"]), number(f.get("WARC-Segment-Total-Length")), block))
                            size += len(block)
                        else:
                            rows.append((*page_of(own, block, payloads), None, None, None, None))
                            size += len(rows[-1][5] or b"") + 200
                        if size >= 4 << 20:
                            yield _table(rows, schema)
                            rows, size = [], 0
                yield _table(rows, schema)

    # a number of its own: ranges are few rows, which Spark would gather into one task
    return ranges.select("path", "start", "stop", "folder").repartition(max(1, min(n, 10_000)), "path", "start").mapInArrow(run, schema)


class _Range:
    """The next `left` bytes of a file."""

    def __init__(self, file, left: int):
        self.file, self.left = file, left

    def read(self, n: int) -> bytes:
        data = self.file.read(min(n, self.left))
        self.left -= len(data)
        return data


def assembled(found: DataFrame, payloads: bool = False) -> DataFrame:
    """PAGES from the rows of read_records (a table), whose segments are grouped by origin and joined."""
    one = found.where("segment is not null").groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "block")).alias("parts"), *(F.max_by(c, F.col("segment") == 1).alias(c) for c in ("page_id", "payload_digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = []
            for origin, parts, page, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    block = joined([(p["segment"], p["total"], p["block"]) for p in parts])
                except ValueError as e:
                    raise ValueError(f"{e} for {origin}") from e
                rows.append(page_of((page, "response", digest, None), block, payloads))
            yield _table(rows, PAGES)

    whole = one.select("origin", "parts", "page_id", "payload_digest").mapInArrow(run, PAGES)
    return found.where("segment is null").select(*whole.columns).unionByName(whole)


def read(ranges: DataFrame, payloads: bool = False) -> DataFrame:
    """PAGES of what the archives hold; the payload is null for revisits, and for all without `payloads`."""
    return assembled(stage(read_records(ranges, payloads), "records"), payloads)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return read(write(read_table(spark, sf_dir, "pages"))).drop("payload")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as n, sha1(html) as h from p),
b as (
  select page_id, n, (select string_agg(
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i + 1, 5))::bigint >> s) & 31)::int + 1, 1), '' order by i, s desc)
    from range(8) r(i), (values (15), (10), (5), (0)) v(s)) as digest
  from d)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
  case when page_id is distinct from m and m is not null then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from m then m end as refers_to
from (select *, min(page_id) over (partition by digest) as m from b)
"""
