"""WARC archives as chunked record tables: payloads are streamed as (record, chunk) rows in both directions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.llm.common import shared_folder, written

CHUNK_BYTES = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROW_HEADER = "X-Row-Id"
HELD_BYTES = 8 << 20  # chunk rows handed over at once


def _record_id(id_, digest: str) -> str:
    return f"<{uuid.UUID(bytes=hashlib.md5(f'{id_}|{digest}'.encode()).digest()).urn}>"


def chunked_records(df: DataFrame, id_col: str, url_col: str, payload: Column, *, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows ``(id, url, bytes, sha1, first, chunk, last, data)``: the payloads cut into chunks, in order and side by side.

    ``first`` is the smallest id with an equal payload where that is another row and the payload has ``min_bytes`` or more; such rows carry
    no data. Copies are found by a grouped minimum of digests; payloads move once, to be joined with what was found.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(payload, F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    known = rows.select("id", "sha1", "bytes").where(F.col("bytes") >= min_bytes)
    firsts = known.groupBy("sha1", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    copies = written(known.join(firsts, "sha1").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", F.col("sha1").alias("same"), "first").distinct(), "copies")
    copies = copies.withColumnRenamed("id", "copy").hint("merge")
    rows = rows.join(copies, F.col("id").eqNullSafe(F.col("copy")) & (F.col("sha1") == F.col("same")), "left")
    sent = F.when(F.col("first").isNull(), F.col("payload")).otherwise(F.lit(b""))
    number = F.greatest(F.ceil(F.octet_length("sent") / chunk_bytes).cast("int"), F.lit(1))
    chunks = F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.struct(
        i.alias("chunk"), (i == number - 1).alias("last"), F.substring("sent", i * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data")))
    rows = rows.withColumn("sent", sent).select("id", "url", "bytes", "sha1", "first", chunks.alias("chunks"))
    return rows.select("id", "url", "bytes", "sha1", "first", F.inline("chunks"))


def _headers(row: dict, date: str) -> bytes:
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    revisit = row["first"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    url = quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~") if row["url"] else f"urn:row:{row['id']}"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(row['id'], digest)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if row["id"] is not None:
        lines.append(f"{ROW_HEADER}: {row['id']}")
    if revisit:
        lines += [f"WARC-Refers-To: {_record_id(row['first'], digest)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else row['bytes'])}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _written_archive(folder: str, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, records, sent = TaskContext.get(), None, 0, 0
        system, root = FileSystem.from_uri(folder)
        path = f"{root}/part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        packer = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names) if name != "data"}
                if out is None:
                    out = system.open_output_stream(path, compression=None)
                if row["chunk"] == 0:
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)  # a gzip member per record
                    out.write(packer.compress(_headers(row, date)))
                    records += 1
                data = batch.column(batch.schema.get_field_index("data"))[k].as_buffer()
                out.write(packer.compress(data))
                sent += data.size
                if row["last"]:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records]), pa.array([sent])], ["path", "records", "bytes"])
    return run


def write_archives(chunks: DataFrame, folder: str, *, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes chunk rows as ``.warc.gz`` files, one for each task, and returns their list ``(path, records, bytes)``.

    A file is named by its task attempt and counts only if the list names it, so lost and repeated attempts leave no record twice. The list, a
    row for each file, is one Parquet file.
    """
    system, root = FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    return written(chunks.mapInArrow(_written_archive(folder, date, level), "path string, records bigint, bytes bigint").repartition(1), "archives")


CHUNK_ROWS = pa.schema([("path", pa.string()), ("record", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("row_id", pa.string()),
                        ("target_uri", pa.string()), ("refers_to", pa.string()), ("chunk", pa.int64()), ("offset", pa.int64()), ("data", pa.binary()),
                        ("digest", pa.string()), ("last", pa.bool_())])


def _chunks_of(stream, path: str, chunk_bytes: int) -> Iterator[tuple]:
    """Chunk rows of one archive; each has the digest of the payload up to its end."""
    number = 0
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path}: no record begins at record {number}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            head[name.decode().lower()] = value.strip().decode()
        left = int(head["content-length"])
        if head["content-type"].startswith("application/http"):
            while True:
                line = stream.readline()
                left -= len(line)
                if not line.strip():
                    break
        digest, offset, chunk = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk_bytes, left))
            if left and not data:
                raise ValueError(f"{path}: record {number} ends early")
            left -= len(data)
            digest.update(data)
            so_far = base64.b32encode(digest.digest()).decode()
            if not left and head["warc-type"] == "response" and head["warc-payload-digest"] != f"sha1:{so_far}":
                raise ValueError(f"{path}: record {number} does not have its digest")
            if head["warc-type"] == "revisit":
                so_far = head["warc-payload-digest"].removeprefix("sha1:")
            yield (path, number, head["warc-record-id"], head["warc-type"], head.get(ROW_HEADER.lower()), head.get("warc-target-uri"),
                   head.get("warc-refers-to"), chunk, offset, data, so_far, not left)
            chunk, offset = chunk + 1, offset + len(data)
            if not left:
                break
        number += 1


def _read_archive(folder: str, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = FileSystem.from_uri(folder)
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw)) as stream:
                    for row in _chunks_of(stream, path, chunk_bytes):
                        held.append(row)
                        size += len(row[9]) + 500
                        if size >= HELD_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), CHUNK_ROWS.types)], schema=CHUNK_ROWS)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), CHUNK_ROWS.types)], schema=CHUNK_ROWS)
    return run


def read_archives(archives: DataFrame, folder: str, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of listed archives, a file after another in each task: record number and id, chunk number, offset, bytes.

    ``digest`` is the payload's base32 SHA-1 up to the end of the chunk (of a revisit: that of the payload it stands for), ``last`` marks
    the chunk that ends the record. Records whose digest does not fit raise an error.
    """
    schema = ("path string, record bigint, record_id string, record_type string, row_id string, target_uri string, refers_to string, chunk bigint, "
              "offset bigint, data binary, digest string, last boolean")
    spread = archives.select("path").repartition(max(1, archives.count()), "path")
    return spread.mapInArrow(_read_archive(folder, chunk_bytes), schema)


def archived(df: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", *, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes a record per row, reads the archives back, and returns what they hold of each row.

    Columns: ``(id_col, payload_bytes, payload_digest, record_type, refers_to)``. Of rows with equal payloads of at least ``min_bytes`` that
    with the smallest id is a response, the others are revisits of it. A NULL text is an empty payload, a NULL url stands as ``urn:row:``
    and the id. Rows with a NULL id are written and read without one; they revisit a row with an id where one has their payload. Repeated
    rows repeat their record. An empty table makes no archive. Reading back holds a chunk per record; writing holds
    a whole payload two or three times (digest, join, chunks of one row), so the longest payload has to fit an executor.
    """
    kind = dict(df.dtypes)[id_col]
    folder = folder or f"{shared_folder(df.sparkSession)}/warc-{uuid.uuid4().hex}"
    chunks = chunked_records(df, id_col, url_col, F.encode(F.col(text_col), "UTF-8"), min_bytes=min_bytes)
    table = read_archives(write_archives(chunks, folder), folder)
    ends = written(table.where("last").select("record_id", "record_type", "row_id", "refers_to", "digest", (F.col("offset") + F.octet_length("data")).alias("bytes")), "records")
    originals = ends.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("row_id").alias("original"), F.col("bytes").alias("full"))
    revisits = ends.where(F.col("refers_to").isNotNull()).join(originals.distinct(), "refers_to", "left")  # the others would all have one key
    out = ends.where(F.col("refers_to").isNull()).withColumns({"original": F.lit(None).cast("string"), "full": F.lit(None).cast("long")}).unionByName(revisits)
    return out.select(F.col("row_id").cast(kind).alias(id_col), F.coalesce("full", "bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                      "record_type", F.col("original").cast(kind).alias("refers_to"))
