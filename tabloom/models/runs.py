"""The runs table: one row per training run, its leaderboard as an array of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

RUNS = ("run_id string, trained_at timestamp, task_type string, target_column string, row_count long, "
        "feature_columns array<string>, best_model_name string, best_metrics map<string,double>, "
        "leaderboard array<struct<model:string,status:string,metrics:map<string,double>,error:string>>, settings map<string,string>")

# fixed values: metrics above these are suspicious, and the other review limits
SUSPICIOUS = {"roc_auc": 0.99, "f1_weighted": 0.97, "r2": 0.98}
DOMINANT_IMPORTANCE = 0.70
UNSTABLE_STD = 0.05
RUNAWAY_GAP = 0.15


def write_run(result, root: str) -> None:
    """Appends a training result to the runs table, and writes the test rows' labels and predictions beside it."""
    spark = result.train.sparkSession
    clean = lambda m: {k: float(v) for k, v in m.items() if v is not None}
    row = (result.run_id, result.trained_at, result.task_type, result.target_column, result.row_count, result.feature_columns,
           result.best_model_name, clean(result.best_metrics),
           [(e["model"], e["status"], clean(e["metrics"]), e["error"]) for e in result.leaderboard],
           {k: str(v) for k, v in result.settings.items() if v is not None})
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(f"{root}/runs_table")
    result.points().write.mode("overwrite").parquet(f"{root}/points/{result.run_id}")


def read_points(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Key, time, ``y_test`` and ``y_pred`` of a run's test rows."""
    return spark.read.parquet(f"{root}/points/{run_id}")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(f"{root}/runs_table")


def latest_first(table: DataFrame, time_column: str, tiebreak: str) -> DataFrame:
    """Metadata listing, newest first."""
    return table.orderBy(F.desc(time_column), tiebreak)


def primary_metric() -> Column:
    return F.when(F.col("task_type") == "classification", "f1_weighted").otherwise("r2")


def _entries(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "task_type", F.explode("leaderboard").alias("e"))


def rank_entries(runs: DataFrame) -> DataFrame:
    """(run_id, model, status, rank): successes by (f1_weighted, accuracy) or (r2, -rmse); failures unranked."""
    m = F.col("e.metrics")
    low = F.lit(float("-inf"))
    classify = F.col("task_type") == "classification"
    first = F.when(classify, F.coalesce(m["f1_weighted"], low)).otherwise(F.coalesce(m["r2"], low))
    second = F.when(classify, F.coalesce(m["accuracy"], low)).otherwise(-F.coalesce(m["rmse"], F.lit(float("inf"))))
    entries = _entries(runs).select("run_id", F.col("e.model").alias("model"), F.col("e.status").alias("status"), first.alias("_a"), second.alias("_b"))
    good = F.col("status") == "success"
    # a run's leaderboard is as long as the model catalogue
    order = Window.partitionBy("run_id", good).orderBy(F.desc("_a"), F.desc("_b"), "model")
    return entries.select("run_id", "model", "status", F.when(good, F.row_number().over(order)).alias("rank"))


def leaderboard_view(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """Successful models with the primary metric, best first."""
    rows = _entries(runs if run_id is None else runs.where(F.col("run_id") == run_id)).where(F.col("e.status") == "success")
    return (rows.select("run_id", F.col("e.model").alias("model"), primary_metric().alias("metric"), F.col("e.metrics")[primary_metric()].alias("value"))
            .orderBy("run_id", F.desc("value"), "model"))


def compare_runs(runs: DataFrame, run_ids: list[str], metric: str | None = None) -> tuple[DataFrame, list[str]]:
    """(table, missing ids): one metric of the best model across runs."""
    picked = runs.where(F.col("run_id").isin(run_ids))
    name = F.lit(metric) if metric else primary_metric()
    table = picked.select("run_id", "best_model_name", "task_type", name.alias("metric"), F.col("best_metrics")[name].alias("value"))
    found = {r["run_id"] for r in picked.select("run_id").collect()}
    return table.orderBy(F.desc("value"), "run_id"), [i for i in run_ids if i not in found]


def inspect_run(runs: DataFrame, run_id: str) -> DataFrame:
    """Facts, metrics, settings and the names of the models that were trained."""
    good = F.filter("leaderboard", lambda e: e["status"] == "success")
    return runs.where(F.col("run_id") == run_id).select(
        "run_id", "trained_at", "task_type", "target_column", "row_count", F.size("feature_columns").alias("feature_count"),
        "best_model_name", "best_metrics", "settings", F.transform(good, lambda e: e["model"]).alias("successful_models"))


def review_runs(runs: DataFrame, importances: DataFrame | None = None, cross_validation: DataFrame | None = None,
                temporal: bool | None = None) -> DataFrame:
    """(run_id, rule, evidence) where a review rule fires.

    ``importances``: (run_id, feature, importance); ``cross_validation``: (run_id, std_score).
    ``temporal`` says the data has a time axis, so a split without a time column is suspect.
    """
    found = None
    for metric, limit in SUSPICIOUS.items():
        hit = runs.where(F.col("best_metrics")[metric] > limit).select(
            "run_id", F.lit("suspicious score").alias("rule"), F.format_string(f"{metric}=%.4f", F.col("best_metrics")[metric]).alias("evidence"))
        found = hit if found is None else found.unionByName(hit)
    ranked = rank_entries(runs).where("rank <= 2").join(leaderboard_view(runs), ["run_id", "model"])
    gap = ranked.groupBy("run_id").agg(F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("b"))
    found = found.unionByName(gap.where((F.col("a") - F.col("b")) > RUNAWAY_GAP * F.abs("b")).select(
        "run_id", F.lit("runaway winner").alias("rule"), F.format_string("%.4f against %.4f", "a", "b").alias("evidence")))
    if importances is not None:
        found = found.unionByName(importances.where(F.col("importance") > DOMINANT_IMPORTANCE).select(
            "run_id", F.lit("dominant feature").alias("rule"), F.col("feature").alias("evidence")))
    if cross_validation is not None:
        found = found.unionByName(cross_validation.where(F.col("std_score") > UNSTABLE_STD).select(
            "run_id", F.lit("unstable folds").alias("rule"), F.format_string("std=%.4f", "std_score").alias("evidence")))
    if temporal:
        found = found.unionByName(runs.where(F.col("settings")["time_column"].isNull()).select(
            "run_id", F.lit("random split on temporal data").alias("rule"), F.lit("no time_column").alias("evidence")))
    return found
