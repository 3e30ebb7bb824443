"""WARC archives: writing records as gzip members, and reading the files in byte ranges.

A reading task gets a range of one file. It looks for the gzip magic, takes a candidate for a member only if
its decompressed start is a WARC header, and owns the records that start inside its range; the last of them may
end beyond it. So a file is read by any number of tasks, and each record by exactly one.
"""

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payloads below this size are never stored as revisits.
LEAST_REVISIT = 100
RANGE_BYTES = 16 << 20
_READ = 1 << 16
_BATCH_BYTES = 8 << 20
_MAGIC = b"\x1f\x8b\x08"
_RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    digits = (urn or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def plan_records(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least ``LEAST_REVISIT`` bytes the smallest page_id is the response and all others revisit it;
    rows that share that id are all responses. Null ids come last: without any other id all are responses.
    A null html is an empty payload. Digests are grouped before the join, so many copies of one page
    send one row per task, and the join's side with the copies can be split.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    copies = (
        rows.where(F.col("payload_bytes") >= LEAST_REVISIT)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first_id IS NOT NULL")
        .drop("n")
    )
    rows = rows.join(copies, "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _member(r: dict) -> bytes:
    """A record as one gzip member."""
    revisit = r["record_type"] == "revisit"
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + r["payload"]
    url = " ".join((r["url"] or "").split())
    head = [
        "WARC/1.1",
        f"WARC-Type: {r['record_type']}",
        f"WARC-Record-ID: {_id(r['page_id'])}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{r['payload_digest']}",
        f"X-Payload-Length: {r['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head.append(f"WARC-Refers-To: {_id(r['refers_to'])}")
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of ``plan_records`` as one archive per task and returns (file, n_records, n_bytes).

    A task writes under a name of its own and moves the whole file into place, so that a repeated task replaces
    its file and a broken one leaves none. ``folder`` is a URI that every executor reaches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        partial, n, size = f"{path}/.{name}.{uuid.uuid4().hex}", 0, 0
        out = None
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(partial)
                member = _member(r)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            store.move(partial, f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [n], "n_bytes": [size]})

    return records.mapInArrow(run, "file string, n_records long, n_bytes long")


class _Window:
    """Bytes of a file from a position on, read as they are needed."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(_READ)
        self.held += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n

    def back_to(self, at: int) -> None:
        self.file.seek(at)
        self.held, self.at = self.file.read(_READ), at


def _head(data: bytes) -> dict[str, str] | None:
    """The header fields of a record, or None if this is no whole WARC header."""
    if not data.startswith(b"WARC/") or b"\r\n\r\n" not in data:
        return None
    lines = data.split(b"\r\n\r\n", 1)[0].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _is_member(window: _Window) -> bool:
    """Whether a member with a WARC header starts at the window's first byte."""
    size, most = 4096, 1 << 16
    while True:
        while len(window.held) < size and window.more():
            pass
        probe = zlib.decompressobj(31)
        try:
            start = probe.decompress(window.held[:size], most)
        except zlib.error:
            return False
        if start[:5] != b"WARC/"[: len(start[:5])]:
            return False
        if _head(start) is not None:
            return True
        # A header may be of any length: go on to its end, or to the end of the member or file.
        if probe.eof:
            return False
        if len(start) >= most:
            most *= 4
        elif len(window.held) < size:
            return False
        else:
            size *= 4


def _member_at(window: _Window) -> bytes | None:
    """The content of the member at the window's start, which moves past it; None, and no move, if it is broken."""
    packed, parts, start = zlib.decompressobj(31), [], window.at
    while not packed.eof:
        try:
            parts.append(packed.decompress(window.held))
        except zlib.error:
            break
        window.drop(len(window.held) - len(packed.unused_data))
        if not packed.eof and not window.more():
            break
    if packed.eof:
        return b"".join(parts)
    window.back_to(start)
    return None


def read_range(file, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the records whose first byte lies in [start, end)."""
    window = _Window(file, start)
    while window.at < end:
        while len(window.held) < len(_MAGIC):
            if not window.more():
                return
        content = None
        if window.held.startswith(_MAGIC) and _is_member(window):
            content = _member_at(window)
        if content is None:
            i = window.held.find(_MAGIC, 1)
            window.drop(i if i > 0 else len(window.held) - len(_MAGIC) + 1)
            continue
        head = _head(content)
        body = content.split(b"\r\n\r\n", 1)[1]
        yield head, body[: int(head.get("content-length", len(body)))]


def _row(head: dict[str, str], block: bytes) -> dict:
    payload = block.split(b"\r\n\r\n", 1)[1] if b"\r\n\r\n" in block else b""
    kind = head.get("warc-type")
    stored = kind != "revisit"
    digest = hashlib.sha256(payload).hexdigest() if stored else head["warc-payload-digest"].partition(":")[2]
    return {
        "page_id": _page(head.get("warc-record-id")),
        "url": head.get("warc-target-uri") or None,
        "record_type": kind,
        "refers_to": _page(head.get("warc-refers-to")),
        "payload_bytes": len(payload) if stored else int(head["x-payload-length"]),
        "payload_digest": digest,
        "payload": payload if stored else None,
    }


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record of the ``.warc.gz`` files in ``folder``; a revisit has no payload of its own.

    Bytes between members are skipped. An empty or missing folder gives no rows.
    """
    store, path = fs.FileSystem.from_uri(folder)
    files = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    ranges = [
        (f.path, start, min(start + range_bytes, f.size))
        for f in files
        if f.is_file and f.base_name.endswith(".warc.gz") and not f.base_name.startswith(".")
        for start in range(0, f.size, range_bytes)
    ]
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
         ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                rows, size = [], 0
                with own.open_input_file(r["path"]) as file:
                    for head, block in read_range(file, r["start"], r["end"]):
                        rows.append(_row(head, block))
                        size += len(block)
                        if size >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    plan = spark.createDataFrame(ranges, "path string, start long, end long")
    spread = plan.repartition(max(1, len(ranges)), F.col("path"), F.col("start")) if ranges else plan
    return spread.mapInArrow(run, _RECORD)
