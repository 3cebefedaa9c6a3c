"""WARC archives: a writer, and a reader that splits gzip files by byte ranges.

``write_archives`` writes one gzip member per record into files of a shared
folder, a file per task; ``read_archives`` lists the files, cuts them into
byte ranges, and lets every task scan its range for gzip magic.  A candidate
counts as a record's start only if its first bytes decode to a WARC header;
records belong to the range they start in and are read to their end beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.store import Scratch

#: bytes of a reading task's range
RANGE_BYTES = 4 << 20
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1.1"
_BLOCK = 1 << 16
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    """Base32 of the SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), refers_to: the smallest page_id with an equal
    payload of at least ``least_bytes`` bytes, null for that page itself and for smaller payloads.

    Null html is an empty payload.  Pages without page_id are never referred
    to and refer to none; repeated page_ids are records of their own.
    """
    scratch = Scratch(pages.sparkSession, "revisits")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    sized = keyed.where(F.length("payload") >= least_bytes).select("page_id", "sha1").where("page_id is not null")
    first = scratch.write(sized.groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
                          .where("first <> last").select("sha1", "first"), "first")
    refers = F.when((F.length("payload") >= least_bytes) & (F.col("first") != F.col("page_id")), F.col("first"))
    return keyed.join(first, "sha1", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def _record_id(page_id) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A gzip member with a response or revisit record."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    header = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", _DATE),
        # a header is one line: control characters of a url are percent-encoded
        ("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if refers_to is not None:
        header.append(("WARC-Refers-To", _record_id(refers_to)))
        header.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in header)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"%s\r\n%s\r\n%s\r\n\r\n" % (_VERSION, head, block)) + pack.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write page_id, url, payload, refers_to as archives in ``folder`` (shared, a
    path or URI); returns path and records of each file.

    A task writes under a name of its own attempt and then renames, so a
    repeated task replaces its file by an equal one.
    """
    folder = qualified(pages.sparkSession, folder)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():06d}.warc.gz"
        attempt, records = f"{name}.{task.taskAttemptId()}.writing", 0
        with fs.open_output_stream(attempt, compression=None) as out:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    refers_to = None if pd.isna(row.refers_to) else int(row.refers_to)
                    out.write(record(None if pd.isna(row.page_id) else int(row.page_id), row.url, bytes(row.payload), refers_to))
                    records += 1
        fs.move(attempt, name)
        yield pd.DataFrame({"path": [name], "records": [records]})

    # nullable integers: pandas would read a column with nulls as doubles
    text = pages.select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))
    return text.mapInPandas(write, "path string, records long")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's full URI: a path without scheme lies in the cluster's default file system, not on a task's own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()


def _filesystem(uri: str):
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, expected: int | None = None) -> DataFrame:
    """record_id, record_type, target_uri, payload_digest, payload_length, refers_to, payload, and the
    place of every record (path, place) in the archives (*.warc.gz) of ``folder``.

    WARC/1.0 and 1.1, header fields in any order and spelled in any case, one
    record a gzip member.  A revisit has no payload of its own (null); its
    digest and length are those that its header gives.  A length or digest that
    a response's header lacks is taken from its payload, one that is wrong is an
    error, and so is an archive that ends within a record or has a damaged one.
    A folder without archives gives no rows; with ``expected``, another number
    of archives than that is an error.
    """
    import pyarrow as pa

    folder = qualified(spark, folder)
    fs, root = _filesystem(folder)
    listed = [(f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".warc.gz")]
    if expected is not None and len(listed) != expected:
        raise FileNotFoundError(f"{len(listed)} archives in {folder}, {expected} were written")
    files = spark.createDataFrame(listed, "path string, size long")
    ranges = files.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, sum(-(-size // range_bytes) for _, size in listed)), "path", "start")
    schema = ("record_id string, record_type string, target_uri string, payload_digest string, payload_length long, "
              "refers_to string, payload binary, path string, place long")
    columns = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c_type])
                           for c, c_type in (x.split() for x in schema.split(", "))])
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                for found in records_from(_filesystem(folder)[0], row["path"], row["start"], row["start"] + range_bytes):
                    rows.append(found)
                    held += len(found["payload"] or b"")
                    if held > _BLOCK * 64:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return ranges.mapInArrow(read, schema).select(*columns)


def records_from(fs, path: str, start: int, stop: int) -> Iterator[dict]:
    """The records that start at ``start`` or later and before ``stop``."""
    with fs.open_input_file(path) as file:
        place = _next_start(file, start, stop)
        while place is not None:
            body, end = _member(file, place)
            yield _parsed(body) | {"path": path, "place": place}
            # the next record follows directly, unless something else lies between
            place = end if end < stop and _is_start(file, end) else _next_start(file, end, stop)


def _next_start(file, place: int, stop: int) -> int | None:
    """The first member from ``place`` on, before ``stop``, that holds a WARC record."""
    while place < stop:
        file.seek(place)
        block = file.read(min(_BLOCK, stop - place) + len(_MAGIC) - 1)
        at = block.find(_MAGIC)
        while at >= 0:
            if _is_start(file, place + at):
                return place + at
            at = block.find(_MAGIC, at + 1)
        if len(block) < _BLOCK:
            return None
        place += _BLOCK
    return None


def _is_start(file, place: int) -> bool:
    """Whether the bytes at ``place`` decode to the first header lines of a record."""
    file.seek(place)
    head = file.read(4096)
    if not head.startswith(_MAGIC):
        return False
    try:
        text = zlib.decompressobj(31).decompress(head, 512)
    except zlib.error:
        return False
    return re.match(rb"WARC/1\.[01]\r\n(?i:WARC-|Content-)[a-z-]+:", text, re.IGNORECASE) is not None


def _member(file, place: int) -> tuple[bytes, int]:
    """A member's content and the place after it; a file that ends within it is an error."""
    file.seek(place)
    unpack, out, read = zlib.decompressobj(31), [], 0
    while not unpack.eof:
        block = file.read(_BLOCK)
        if not block:
            raise EOFError(f"archive ends within the record at {place}")
        read += len(block)
        out.append(unpack.decompress(block))
    return b"".join(out), place + read - len(unpack.unused_data)


def _parsed(body: bytes) -> dict:
    head, _, rest = body.partition(b"\r\n\r\n")
    field = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[:int(field["content-length"])]
    kind = field["warc-type"]
    payload = block
    if "msgtype" in field.get("content-type", "") or field.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]  # after the HTTP header
    digest = field.get("warc-payload-digest", "").removeprefix("sha1:") or None
    length = int(field["x-payload-length"]) if "x-payload-length" in field else None
    if kind == "revisit":
        payload = None
    else:
        found = payload_digest(payload)
        if digest not in (None, found) or length not in (None, len(payload)):
            raise ValueError(f"payload of {field['warc-record-id']} does not have its digest or length")
        digest, length = found, len(payload)
    return {"record_id": field["warc-record-id"], "record_type": kind, "target_uri": field.get("warc-target-uri"),
            "payload_digest": digest, "payload_length": length, "refers_to": field.get("warc-refers-to"), "payload": payload}
