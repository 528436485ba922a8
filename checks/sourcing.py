"""Sources and sinks: a driver table goes out in a format and comes back."""

import os
import sqlite3
import tempfile
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from checks.registry import query, rounded, table
from tabloom import sources


def scratch(spark, kind):
    """Fresh folder in the shared checkpoint folder; only a local master may do with a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="tabloom-files-")
    return f"{root}/{kind}-{uuid.uuid4().hex[:8]}"


@query("read_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def read_csv(spark, sf):
    path = scratch(spark, "csv")
    table(spark, sf, "orders").drop("o_orderdate").write.option("header", "true").csv(path)
    out = sources.read_csv(spark, path)
    return out.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("read_json", """SELECT event_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events""")
def read_json(spark, sf):
    path = scratch(spark, "json")
    df = table(spark, sf, "events").select("event_id", "event_type", "value", F.from_json("props", "k long").alias("props"))
    df.write.json(path)
    return sources.read_json(spark, path, multi_line=False)


@query("read_parquet", "SELECT * FROM supplier")
def read_parquet(spark, sf):
    return sources.read_parquet(spark, f"{sf}/supplier.parquet")


def sqlite_files(df, path, name):
    """One database file per partition, written by its task."""
    os.makedirs(path, exist_ok=True)
    columns = df.columns

    def write(batches):
        target = f"{path}/part-{uuid.uuid4().hex}.db"
        with sqlite3.connect(target) as db:
            count = 0
            for batch in batches:
                batch.to_sql(name, db, if_exists="append", index=False)
                count += len(batch)
        if count == 0:
            os.replace(target, f"{path}/.empty-{uuid.uuid4().hex}")
        yield pd.DataFrame({"rows": [count]})

    return df.select(*columns).mapInPandas(write, "rows long").agg(F.sum("rows")).first()[0]


@query("read_sqlite", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")
def read_sqlite(spark, sf):
    path = scratch(spark, "sqlite")
    sqlite_files(table(spark, sf, "customer").repartition(3), path, "customers")
    return sources.read_sqlite(spark, path, rows_per_partition=200).where("c_acctbal > 0")


@query("list_sqlite_tables", """SELECT 'suppliers' AS "table", count(*) AS rows FROM supplier UNION ALL SELECT 'customers', count(*) FROM customer""")
def list_sqlite_tables(spark, sf):
    """Rows of two tables that lie in several files."""
    path = scratch(spark, "sqlite")
    sqlite_files(table(spark, sf, "supplier").repartition(2), path, "suppliers")
    sqlite_files(table(spark, sf, "customer").repartition(3), path, "customers")
    return sources.list_sqlite_tables(spark, path).groupBy("table").agg(F.sum("rows").alias("rows"))


@query("read_sqlite_mixed_files", """SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS size, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def read_sqlite_mixed_files(spark, sf):
    """Files of one table with other columns and types: the schema is that of all of them."""
    path = scratch(spark, "sqlite")
    sqlite_files(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("size"), F.col("c_mktsegment").alias("segment")).repartition(2), path, "parties")
    sqlite_files(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("size")).repartition(2), path, "parties")
    return sources.read_sqlite(spark, path, rows_per_partition=300)


def workbook(frame):
    """Bytes of a minimal workbook holding one sheet."""
    def cell(value):
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f"<c><v>{value}</v></c>"
    rows = [list(frame.columns)] + frame.values.tolist()
    body = "".join("<row>" + "".join(cell(v) for v in r) + "</row>" for r in rows)
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {"xl/workbook.xml": f'<workbook {space} {link}><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>',
             "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                           '<Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>',
             "xl/worksheets/sheet1.xml": f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>"}
    import io
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


@query("read_excel", "SELECT p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size, round(p_retailprice, 2) + 0.0 AS p_retailprice FROM part")
def read_excel(spark, sf):
    path = scratch(spark, "xlsx")
    os.makedirs(path, exist_ok=True)

    def write(batches):
        for batch in batches:
            with open(f"{path}/book-{uuid.uuid4().hex}.xlsx", "wb") as f:
                f.write(workbook(batch))
            yield pd.DataFrame({"rows": [len(batch)]})

    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").repartition(4)
    parts.mapInPandas(write, "rows long").agg(F.sum("rows")).first()
    return rounded(sources.read_excel(spark, f"{path}/*.xlsx"), 2)


@query("write_dataset", """SELECT 'priorities' AS name, 'groupby_aggregate' AS operation, count(*) AS row_count, 2::INT AS column_count FROM (SELECT DISTINCT o_orderpriority FROM orders)
UNION ALL SELECT 'orders', '', count(*), 6 FROM orders""")
def write_dataset(spark, sf):
    root = scratch(spark, "datasets")
    orders = table(spark, sf, "orders")
    parent = sources.write_dataset(orders, root, "orders")
    derived = orders.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("total"))
    sources.write_dataset(derived, root, "priorities", "groupby_aggregate", parent["dataset_id"])
    return sources.list_datasets(spark, root).select("name", "operation", "row_count", "column_count")


@query("write_splits", """SELECT CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS side, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders GROUP BY 1""")
def write_splits(spark, sf):
    orders = table(spark, sf, "orders")
    paths = sources.write_splits(orders.where("o_orderdate < '2000-01-01'"), orders.where("o_orderdate >= '2000-01-01'"), scratch(spark, "runs"), "run_1")
    both = spark.read.parquet(paths["train"]).withColumn("side", F.lit("train")).unionByName(spark.read.parquet(paths["test"]).withColumn("side", F.lit("test")))
    return rounded(both.groupBy("side").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("coerce_dtypes", """SELECT o_orderkey, CASE WHEN o_orderkey % 30 <> 0 THEN date_trunc('day', o_orderdate) END AS order_date, o_totalprice AS price,
  CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS mostly, o_custkey AS cust FROM orders""")
def coerce_dtypes(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 30 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("mostly"),
        F.col("o_custkey").cast("string").alias("cust"))
    return sources.coerce_dtypes(df)[0]
