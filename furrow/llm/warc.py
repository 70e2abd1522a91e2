"""WARC archives with an index that comes first, and range reads of selected records.

Writing: each task streams its rows into one archive, one gzip member for each record, and returns the index rows (file, offset,
length, page, URL, digest). A row counts once its index row is in the index table, which Spark commits; the archive of a lost or
repeated task has a name of its own and is never referred to. Of records with equal payloads of at least ``least`` bytes the one
with the largest page id is a *response*, the others are *revisits* that name it.

Reading: index rows are dealt by archive and stretch of bytes, sorted by offset, and neighbouring records are fetched by one
range read. Digests are verified.

Archives are written and read through the file system of their URI (local or mounted, hdfs, s3, gs, abfs), which every executor
must reach; the page tables are only read by Spark.

Edge cases: null html is an empty payload; a null page id is smaller than all others; rows that share the largest page id of a
payload are all responses; a null URL leaves the target field out; control characters and blanks in a URL are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import cut_lineage, ensure_checkpoint_dir

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload string"
_UNSAFE = re.compile("[\x00-\x20\x7f]")


def _name(page: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page is None else page}:sha1:{digest}>"


def build_record(page: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One uncompressed record; a revisit has the HTTP header of the payload but not the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    fields.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is None:
        block += payload
    else:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to, digest)}"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(fields) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple:
    """The columns of RECORD."""
    head, rest = record.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    http, payload = rest[:size].split(b"\r\n\r\n", 1)
    full = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]

    def page(field: str) -> int | None:
        text = fields[field].split(":")[2]
        return None if text == "none" else int(text)

    if kind == "response" and (len(payload) != full or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return (page("WARC-Record-ID"), fields.get("WARC-Target-URI"), kind, digest, full,
            page("WARC-Refers-To") if kind == "revisit" else None, payload.decode() if kind == "response" else None)


def _store(folder: str, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        path, out, at = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                rows = []
                for page, url, digest, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "digest", "payload", "refers_to")), strict=True):
                    if out is None:
                        out = system.open_output_stream(path, compression=None)
                    page, url, digest, refers = page.as_py(), url.as_py(), digest.as_py(), refers.as_py()
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = squeeze.compress(build_record(page, url, digest, payload.as_buffer().to_pybytes(), refers, date)) + squeeze.flush()
                    out.write(data)
                    rows.append((path, at, len(data), page, url, digest, "response" if refers is None else "revisit"))
                    at += len(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, (
                        pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)],
                    ["file", "offset", "length", "page_id", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()
    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least: int = 1000, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write the archives under ``folder`` (a URI all executors reach) and return the committed index."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("large", F.octet_length("payload") >= least)
    shared = cut_lineage(rows.where("large").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
                         .where("n > 1").select(F.col("digest").alias("same"), "last"))
    # short payloads may repeat without bound and are never revisits: their keys are spread and match nothing
    key = F.when(F.col("large"), F.col("digest")).otherwise(F.concat(F.lit("short-"), F.xxhash64("page_id", "url")))
    marked = rows.withColumn("same", key).join(shared, "same", "left").withColumn(
        "refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last")))
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    return cut_lineage(marked.select("page_id", "url", "digest", "payload", "refers_to").mapInArrow(_store(folder, date, level), INDEX))


def _fetch(folder: str, gap: int, most: int, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

        def ranges():
            held: list[tuple[int, int]] = []
            name = None
            for batch in batches:
                for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                    if held and (file != name or at - sum(held[-1]) > gap or at + size - held[0][0] > most):
                        yield name, held
                        held = []
                    name = file
                    held.append((at, size))
            if held:
                yield name, held

        opened = stream = None
        for name, held in ranges():
            if name != opened:
                if stream:
                    stream.close()
                stream, opened = system.open_input_file(name), name
            first = held[0][0]
            data = stream.read_at(sum(held[-1]) - first, first)
            rows = [parse_record(zlib.decompress(data[a - first:a - first + n], 31)) for a, n in held]
            if not payloads:
                rows = [(*r[:-1], None) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])
        if stream:
            stream.close()
    return run


def read_records(index: DataFrame, folder: str, payloads: bool = True, stretch: int = 32 << 20, gap: int = 64 << 10,
                 most: int = 4 << 20) -> DataFrame:
    """The records of the given index rows (any selection), read by coalesced ranges of at most ``most`` bytes.

    Rows of one archive and ``stretch`` of bytes go to one task; ``gap`` bytes between two wanted records are read over.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // stretch))
    part = F.floor(F.col("offset") / stretch)
    wanted = index.select("file", "offset", "length").withColumn("part", part).repartition(parts, "file", "part")
    return wanted.sortWithinPartitions("file", "offset").mapInArrow(_fetch(folder, gap, most, payloads), RECORD)


def archive_folder(spark) -> str:
    """A new folder for archives beside the checkpoints, as a URI."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    scheme, _, path = base.rpartition(":") if base.startswith("file:") else ("", "", base)
    if scheme == "file" or ":" not in base:
        base = "file:///" + path.lstrip("/")
    return f"{base}/warc-{uuid.uuid4().hex}"
