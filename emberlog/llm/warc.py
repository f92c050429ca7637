"""Operator 6, WARC archives: write with an index, read back by coalesced byte ranges.

Every record is a gzip member of its own. Each task writes the records of its partition to archive files
below a shared folder and returns one index row per record: file, offset, length, URL and payload digest.
Only the index (committed as a table) says which files count, so an attempt lost with its executor
leaves a file nobody refers to. A reader selects index rows, sorts them by place, joins neighbouring
ranges into one read, and parses the records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import materialize, require, shared_path

# The hexadecimal-style base 32 of ``conv`` and the alphabet of RFC 4648.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES = 256 << 20
GAP, MOST = 64 << 10, 8 << 20
# Archive bytes of a reading task, and of the stretches that are dealt to the tasks.
TASK_BYTES, STRETCH_BYTES, LEAST_STRETCH = 64 << 20, 16 << 20, 256 << 10
# Pages that are Python rows at a time.
ROWS = 64
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four of base 32."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32)


def with_record_types(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to of every row."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    # Digests of several rows and the smallest id of each; minima combine before the shuffle.
    names = rows.where(F.length("payload") >= min_bytes).select("digest", F.length("payload").alias("n"), "page_id")
    first = names.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    first = materialize(first.select("digest", "n", "first"), "payloads")
    # Narrow rows carry the digest to its table; what comes back is one row per revisit.
    later = names.join(first, ["digest", "n"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    later = later.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "first").distinct()
    later = materialize(later, "revisits")
    rows = rows.join(later, rows["page_id"].eqNullSafe(later["__id"]) & (rows["digest"] == later["__digest"]), "left")
    return rows.select("page_id", "url", "payload", "digest",
                       F.when(F.col("__digest").isNull(), "response").otherwise("revisit").alias("record_type"),
                       F.col("first").alias("refers_to"))


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def one_line(text: str | None) -> str:
    """A header value: line breaks would end it."""
    return (text or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def http_head(length: int) -> bytes:
    """What a response's block has before the payload."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def build_record(page_id, url: str | None, payload: bytes, digest: str, record_type: str, refers_to, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A response's block is an HTTP response, its digest that of the payload; a revisit has no
    block, its payload is that of the record it refers to."""
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    block = http_head(len(payload)) + payload
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
        block = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return headers, rest[:n]


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write all rows to archive files below ``folder`` (a URI that all executors share) and return the index:
    page_id, url, digest, record_type, file, offset, length.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with the smallest id is the response and
    the others revisit it; a null payload is an empty one. A null id comes after all others. Rows that repeat the
    smallest id are responses each. Null URLs are written empty. A very long page is one record, whole. ``date`` is the
    WARC-Date of the records. Empty tables write no file; other columns are not read.
    """
    require(pages, id_col, url_col, html_col)
    rows = with_record_types(pages, id_col, url_col, html_col, min_bytes)
    id_type = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = out = None
        name, offset = "", 0
        for batch in batches:
            found = []
            for row in (row for lo in range(0, batch.num_rows, ROWS) for row in batch.slice(lo, ROWS).to_pylist()):
                if out is None or offset >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    system, path = file_system(folder)
                    system.create_dir(path, recursive=True)
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(build_record(row["page_id"], row["url"], row["payload"], row["digest"],
                                                      row["record_type"], row["refers_to"], date)) + packer.flush()
                out.write(member)
                found.append((name, offset, len(member)))
                offset += len(member)
            cols = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "digest", "record_type")]
                + [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                names=["page_id", "url", "digest", "record_type", "file", "offset", "length"])
        if out is not None:
            out.close()

    index = rows.mapInArrow(run, f"page_id {id_type}, url string, digest string, record_type string, file string, offset bigint, length bigint")
    return materialize(index, "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> Iterator[tuple[int, int, int, int]]:
    """(first, last + 1, start, end) of runs of sorted (offset, length) ranges that one read may cover."""
    first, start, end = 0, None, 0
    for i, (offset, length) in enumerate(ranges):
        if start is not None and (offset - end > gap or offset + length - start > most):
            yield first, i, start, end
            first, start = i, None
        if start is None:
            start, end = offset, offset
        end = max(end, offset + length)
    if start is not None:
        yield first, len(ranges), start, end


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the records of the selected index rows: page_id, url, record_type, payload_bytes, payload_digest,
    refers_to and payload (null for a revisit, whose payload is that of the record it refers to).

    The digest of a response is computed from the bytes read and must equal its header.
    """
    id_type = index.schema["page_id"].dataType.simpleString()
    # A task for so many bytes of archives (those of the index rows are few and say nothing), at least one for each core.
    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    stretch = min(STRETCH_BYTES, max(LEAST_STRETCH, total // (4 * tasks)))
    # Places of one file and stretch meet in a task, in order: neighbours become one read.
    placed = index.select("page_id", "file", "offset", "length", F.floor(F.col("offset") / stretch).alias("stretch"))
    placed = placed.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            lo = 0
            while lo < len(rows):
                hi = lo
                while hi < len(rows) and rows[hi]["file"] == rows[lo]["file"]:
                    hi += 1
                system, path = file_system(folder)
                with system.open_input_file(f"{path}/{rows[lo]['file']}") as f:
                    for a, b, start, end in coalesced([(r["offset"], r["length"]) for r in rows[lo:hi]]):
                        data = f.read_at(end - start, start)
                        yield _read_back(rows[lo + a:lo + b], data, start, batch.schema.field("page_id").type)
                lo = hi

    return placed.mapInArrow(run, f"page_id {id_type}, url string, record_type string, payload_bytes bigint, payload_digest string, "
                                  f"refers_to {id_type}, payload binary")


def _read_back(rows: list[dict], data: bytes, start: int, kind: pa.DataType) -> pa.RecordBatch:
    out = []
    for row in rows:
        at = row["offset"] - start
        h, block = parse_record(data[at:at + row["length"]])
        revisit = h["WARC-Type"] == "revisit"
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit:
            block = block.partition(b"\r\n\r\n")[2]
        if not revisit and (base64.b32encode(hashlib.sha1(block).digest()).decode() != digest or len(block) != int(h["X-Payload-Length"])):
            raise ValueError(f"record at {row['file']}:{row['offset']} does not have its digest")
        url = h["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        out.append((h["X-Page-ID"] or None, url, h["WARC-Type"], int(h["X-Payload-Length"]), digest,
                    (h["X-Refers-To-Page-ID"] or None) if revisit else None, None if revisit else block))
    cols = list(zip(*out, strict=True))
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
    arrays[0], arrays[5] = arrays[0].cast(kind), arrays[5].cast(kind)
    return pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])


def archive(pages: DataFrame, folder: str | None = None, **columns) -> tuple[DataFrame, str]:
    """Write ``pages`` and return (index, folder); without a folder, one below spark.checkpoint.dir."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    return write_archives(pages, folder, **columns), folder
