import base64
import gzip
import glob
import hashlib

import pytest
from pyspark.sql import functions as F

from tabloom.llm.warc import archived, chunked_records, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, id string, chunk long, digest string, path string"


def pages(spark):
    rows = [(1, "http://a.b/c", "<p>one</p>"), (2, "http://a.b/d", "<p>one</p>"), (3, None, None), (4, "http://x/é\r\nInjected: 1", ""), (5, "u", "ü" * 200_000),
            (6, "u", "ü" * 200_000), (7, "", "WARC/1.1\r\n\r\n\r\n"), (8, "u", "p"), (8, "u", "p"), (None, "u", "<p>one</p>"), (None, "u", "q")]
    return spark.createDataFrame([(*r, "c", 1, "c", "c") for r in rows], SCHEMA)


def expected(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        origin = first.get(html or "", i) if len(raw) >= least else i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if origin == i else "revisit", None if origin == i else origin))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = pages(spark)
    rows = [tuple(r)[:3] for r in df.collect()]
    assert sorted((tuple(r) for r in archived(df, min_bytes=least).collect()), key=str) == expected(rows, least)


def test_empty_table(spark):
    assert archived(pages(spark).where("1 = 0")).collect() == []


def test_records_without_a_reference_are_not_one_key(spark, tmp_path):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame([(i, "u", f"page {i % 300}") for i in range(310)], "page_id long, url string, html string")
        out = archived(df, folder=f"file://{tmp_path}/archives")
        assert sorted(tuple(r) for r in out.collect()) == sorted(expected([tuple(r) for r in df.collect()]))
        found = out.where("record_type = 'response'").groupBy(F.spark_partition_id()).count().collect()
        assert len(found) > 1 and max(r["count"] for r in found) < 300
        listed = write_archives(chunked_records(df.repartition(8), "page_id", "url", F.encode("html", "UTF-8")), f"file://{tmp_path}/more")
        assert listed.count() > 1 and len(listed.inputFiles()) == 1  # a list of one Parquet file
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_chunks_and_files(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    chunks = chunked_records(pages(spark), "page_id", "url", F.encode("html", "UTF-8"), chunk_bytes=1000)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] == 1000
    table = read_archives(write_archives(chunks, folder), folder, chunk_bytes=4096).where("row_id = '5'").orderBy("chunk").collect()
    whole = ("ü" * 200_000).encode()
    assert b"".join(r.data for r in table) == whole and [r.offset for r in table] == list(range(0, len(whole), 4096))
    for r in table[:3] + table[-1:]:
        assert r.digest == base64.b32encode(hashlib.sha1(whole[:r.offset + len(r.data)]).digest()).decode()
    assert [r.last for r in table] == [False] * (len(table) - 1) + [True]
    raw = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/archives/*.warc.gz"))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == 11 and b"\r\nInjected" not in raw


def test_a_broken_archive_is_an_error(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    listed = write_archives(chunked_records(pages(spark).where("page_id = 1"), "page_id", "url", F.encode("html", "UTF-8")), folder)
    path = listed.first().path
    with gzip.open(path) as f:
        raw = f.read()
    with gzip.open(path, "wb") as f:
        f.write(raw.replace(b"<p>one", b"<p>two"))
    with pytest.raises(Exception, match="does not have its digest"):
        read_archives(listed, folder).collect()
