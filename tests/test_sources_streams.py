"""Files, coercion, recipes, logs and streams."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from checks.sourcing import workbook
from tabloom import sources, streaming
from tabloom.models import catalogue, train as training
from tabloom.operators import drift
from tabloom.plans import recipes
from tabloom.streaming.drift import DriftBaseline, binned


def test_csv_json_sqlite_excel(spark, tmp_path):
    import pandas as pd

    (tmp_path / "a.csv").write_text("age,churn\n31,0\n45,1\n")
    assert sorted(map(tuple, sources.read_csv(spark, str(tmp_path / "a.csv")).collect())) == [(31, 0), (45, 1)]
    (tmp_path / "empty.csv").write_text("age,churn\n")
    with pytest.raises(ValueError):
        sources.read_csv(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "a.json").write_text(json.dumps([{"s": "x", "n": {"k": 1, "m": {"z": 2}}}, {"s": "y", "n": {"k": 3, "m": {"z": 4}}}]))
    assert sources.read_json(spark, str(tmp_path / "a.json")).columns == ["n.k", "n.m.z", "s"]
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("create table customers (age integer, churn integer)")
        db.executemany("insert into customers values (?, ?)", [(i, i % 2) for i in range(100)])
        db.execute("create table zeta (x real)")
    path = str(tmp_path / "d.db")
    df = sources.read_sqlite(spark, path, rows_per_partition=30)
    assert df.rdd.getNumPartitions() == 4 and df.where("age >= 90").count() == 10
    assert [r.table for r in sources.list_sqlite_tables(spark, path).collect()] == ["customers", "zeta"]
    with pytest.raises(Exception, match="there are"):
        sources.read_sqlite(spark, path, "nope")
    (tmp_path / "w.xlsx").write_bytes(workbook(pd.DataFrame({"segment": ["a & b", "c"], "revenue": [10, 20]})))
    assert sorted(map(tuple, sources.read_excel(spark, str(tmp_path / "w.xlsx")).collect())) == [("a & b", 10), ("c", 20)]


def test_coercion_thresholds(spark):
    rows = [(f"2020-01-{i % 28 + 1:02d}" if i % 100 >= 4 else "x", str(i) if i % 100 >= 2 else "bad", str(i) if i % 100 >= 3 else "bad", str(i / 2)) for i in range(100)]
    out, changes = sources.coerce_dtypes(spark.createDataFrame(rows, "day string, two string, three string, half string"))
    assert changes == {"day": "string -> timestamp", "two": "string -> double", "half": "string -> double"}
    assert dict(out.dtypes)["three"] == "string"


def test_recipe_order_and_errors(spark):
    plan = recipes.Recipe([("standard_scale", {}), ("drop_duplicates", {}), ("one_hot_encode", {"columns": ["s"]})])
    assert [n for n, _ in plan.in_stage_order().steps] == ["drop_duplicates", "one_hot_encode", "standard_scale"]
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (2.0, "b")], "x double, s string")
    assert plan.run(df, ordered=True).count() == 2
    with pytest.raises(ValueError):
        recipes.apply_operation(df, "no_such_operation")


def test_last_patch_wins(spark):
    log = spark.createDataFrame([(1, 0, False, None), (2, 1, False, "old"), (1, 2, True, "first"), (1, 3, True, None), (9, 4, True, "lost")],
                                "i int, seq int, patch boolean, answers string")
    got = {r.i: r.answers for r in recipes.merge_patches(log, "i", "patch", "answers", ["seq"]).collect()}
    assert got == {1: None, 2: "old"}


def test_streamed_drift_equals_batch(spark, tmp_path):
    base = spark.range(2000).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id"))).alias("ts"),
                                    (F.col("id") % 97).cast("double").alias("v"))
    for i in range(3):
        base.where(f"minute(ts) % 3 = {i}").coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in/*"))
    got = []
    reference = base.where("v < 60")
    streaming.drift_stream(reference, stream, "ts", "6 hours", "0 minutes", ["v"], 5,
                           lambda df, _: got.extend(df.collect()), str(tmp_path / "state")).awaitTermination()
    baseline = DriftBaseline(reference, ["v"], 5)
    batch = {r.window_start: (r.n, r.psi, r.js) for r in streaming.window_drift(binned(base, baseline, "ts", "6 hours"), baseline).collect()}
    assert len(got) >= len(batch) - 1 and all(batch[r.window_start] == (r.n, r.psi, r.js) for r in got)


def test_stream_scores_equal_batch(spark, tmp_path):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), ((F.col("id") % 7) * 2.0 + 1).alias("y"))
    df.write.parquet(str(tmp_path / "in"))
    model = training.fit_one(df, "Linear Regression", catalogue.REGRESSORS["Linear Regression"], "regression", "y", ["x"], ["id"], None)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (streaming.score_stream(model, stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    query.awaitTermination()
    a = {r.id: r.prediction for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert a == {r.id: r.prediction for r in model.score(df).collect()}
    with pytest.raises(ValueError):
        streaming.score_stream(model, df)
