"""Constant columns, closed forms and invariants of operators whose rows SQL cannot give one by one."""

from pyspark.sql import functions as F

from checks.cleaning import lines
from checks.composing import event_stream
from checks.neighbouring import document_features
from checks.panels import BRAND_MONTHS, brand_months
from checks.registry import query, r, rounded, table
from checks.sourcing import scratch
from tabloom import streaming
from tabloom.models import train as training
from tabloom.models.catalogue import REGRESSORS
from tabloom.operators import clean, describe, isolation, resample, selection
from tabloom.plans.recipes import forecast_recipe


def with_constant(spark, sf):
    return lines(spark, sf).select("l_quantity", "l_extendedprice", "l_discount", F.lit(3.5).alias("same"), F.lit(None).cast("double").alias("nothing"))


@query("drop_correlated_constant", "SELECT l_quantity, l_discount, 3.5::DOUBLE AS same, NULL::DOUBLE AS nothing FROM lineitem")
def drop_correlated_constant(spark, sf):
    df = with_constant(spark, sf).withColumn("twice", F.col("l_quantity") * 2)
    return clean.drop_correlated(df.drop("l_extendedprice"), 0.95)


@query("correlation_matrix_constant", f"""SELECT 'l_quantity' AS col_a, 'l_discount' AS col_b, {r("corr(l_quantity, l_discount)")} AS r FROM lineitem
UNION ALL SELECT 'l_discount', 'l_quantity', {r("corr(l_quantity, l_discount)")} FROM lineitem
UNION ALL SELECT a, b, CASE WHEN a = b THEN 1.0 END FROM unnest(['l_quantity', 'l_discount', 'same']) t(a), unnest(['l_quantity', 'l_discount', 'same']) s(b)
WHERE a = b OR a = 'same' OR b = 'same'""")
def correlation_matrix_constant(spark, sf):
    return rounded(describe.correlation_matrix(with_constant(spark, sf).select("l_quantity", "l_discount", "same")))


@query("vif_constant", """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT c AS "column", CASE c WHEN 'same' THEN 1.0 ELSE round(1 / (1 - r * r), 2) END AS vif, CASE c WHEN 'same' THEN false ELSE 1 / (1 - r * r) > 10 END AS high
FROM r, unnest(['l_quantity', 'l_extendedprice', 'same']) t(c)""")
def vif_constant(spark, sf):
    return describe.vif(with_constant(spark, sf), ["l_quantity", "l_extendedprice", "same"])


@query("leakage_scan_constant", """SELECT 'thrice' AS "column", 'target_proxy' AS rule""")
def leakage_scan_constant(spark, sf):
    df = with_constant(spark, sf).select("l_quantity", "same", (F.col("l_quantity") * 3).alias("thrice"))
    return describe.leakage_scan(df, "l_quantity").select("column", "rule")


@query("pca_two_columns", f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, 2000 * l_quantity + l_extendedprice AS b FROM lineitem),
z AS (SELECT l_orderkey, l_linenumber, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM b)
SELECT l_orderkey, l_linenumber, {r("abs(a + b) / sqrt(2)", 5)} AS first, {r("abs(a - b) / sqrt(2)", 5)} AS second FROM z""")
def pca_two_columns(spark, sf):
    """Two standardised columns, the second largely made of the first: the components are their sum and difference at every scale."""
    df = lines(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_quantity") * 2000 + F.col("l_extendedprice")).alias("mixed"))
    out = selection.pca(df, 2, key=["l_orderkey", "l_linenumber"])
    made = [n for n in out.columns if n not in df.columns]
    return rounded(out.select("l_orderkey", "l_linenumber", F.abs(F.col(made[0])).alias("first"), F.abs(F.col(made[1])).alias("second")), 5)


@query("qq_sample_points", f"""SELECT {r("q", 2)} AS sample FROM (
  SELECT unnest(quantile_cont(l_extendedprice, {[round((i - 0.5) / 100, 3) for i in range(1, 101)]})) AS q FROM lineitem)""")
def qq_sample_points(spark, sf):
    return rounded(describe.qq_points(lines(spark, sf), "l_extendedprice").select("sample"), 2)


@query("score_stream_linear", f"""WITH f AS (SELECT regr_slope(value, user_id) AS s, regr_intercept(value, user_id) AS i FROM events)
SELECT event_id, {r("s * user_id + i", 4)} AS prediction FROM events, f""")
def score_stream_linear(spark, sf):
    """A line fitted to all events scores the stream of them."""
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    model = training.fit_one(events, "Linear Regression", REGRESSORS["Linear Regression"], "regression", "value", ["user_id"], ["event_id"], None)
    path = scratch(spark, "line")
    started = (streaming.score_stream(model, event_stream(spark, sf).select("event_id", "user_id")).writeStream.format("parquet").option("path", path)
               .option("checkpointLocation", scratch(spark, "line-state")).trigger(availableNow=True).start())
    started.awaitTermination()
    return rounded(spark.read.parquet(path).select("event_id", "prediction"), 4)


CLASS_ROWS = "SELECT toxic, count(*) AS originals, true AS inside, true AS whole FROM labels JOIN documents USING (doc_id) GROUP BY 1"


def balanced_facts(spark, sf, make):
    """Per class: original rows left, whether new rows lie in the class's box, and whether none of the originals changed."""
    df = document_features(spark, sf).drop("lang")
    numbers = [n for n in df.columns if n not in ("doc_id", "toxic")]
    made = make(df, "toxic", ["doc_id"])
    box = df.groupBy("toxic").agg(*[f(n).alias(f"{k}_{n}") for n in numbers for k, f in (("lo", F.min), ("hi", F.max))])
    inside = F.lit(True)
    for n in numbers:
        inside = inside & F.col(n).between(F.col(f"lo_{n}") - 1e-9, F.col(f"hi_{n}") + 1e-9)
    same = df.select("doc_id", F.struct(*[F.col(n).cast("double").alias(n) for n in numbers]).alias("_was"))
    joined = made.join(F.broadcast(box), "toxic").join(same, "doc_id", "left")
    kept = F.struct(*[F.col(n).cast("double").alias(n) for n in numbers])
    return joined.groupBy("toxic").agg(F.count("doc_id").alias("originals"), F.bool_and(inside).alias("inside"),
                                       F.bool_and(F.col("doc_id").isNull() | (kept == F.col("_was"))).alias("whole"))


@query("smote_facts", CLASS_ROWS)
def smote_facts(spark, sf):
    return balanced_facts(spark, sf, resample.smote)


@query("borderline_smote_facts", CLASS_ROWS)
def borderline_smote_facts(spark, sf):
    return balanced_facts(spark, sf, resample.borderline_smote)


@query("adasyn_facts", CLASS_ROWS)
def adasyn_facts(spark, sf):
    return balanced_facts(spark, sf, resample.adasyn)


@query("smote_tomek_facts", "SELECT toxic, true AS fewer, true AS inside, true AS whole FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def smote_tomek_facts(spark, sf):
    return cleaned_facts(spark, sf, resample.smote_tomek)


@query("smote_enn_facts", "SELECT toxic, true AS fewer, true AS inside, true AS whole FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def smote_enn_facts(spark, sf):
    return cleaned_facts(spark, sf, resample.smote_enn)


def cleaned_facts(spark, sf, make):
    sizes = document_features(spark, sf).groupBy("toxic").agg(F.count("*").alias("n"))
    found = balanced_facts(spark, sf, make).join(sizes, "toxic")
    return found.select("toxic", (F.col("originals") <= F.col("n")).alias("fewer"), "inside", "whole")


@query("isolation_forest_share", "SELECT count(*) AS rows, true AS share_kept, true AS subset FROM events")
def isolation_forest_share(spark, sf):
    """With a contamination of 0.05 at most a twentieth of the rows go, and the rest are rows of the table."""
    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    kept = isolation.isolation_forest_outliers(df, 0.05, exclude=["event_id"])
    both = df.withColumn("all", F.lit(1)).join(kept.select("event_id", F.lit(1).alias("kept")), "event_id", "full")
    return both.agg(F.count("all").alias("rows"), (F.count("kept") / F.count("all")).between(0.93, 0.96).alias("share_kept"),
                    (F.count_if(F.col("all").isNull()) == 0).alias("subset"))


@query("forecast_recipe_tail", f"""WITH {BRAND_MONTHS}, feat AS (SELECT month, p_brand, l_quantity, max(l_quantity) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS top,
  lead(l_quantity, 1) OVER w AS ahead FROM dense WINDOW w AS (PARTITION BY p_brand ORDER BY month)), known AS (SELECT * FROM feat WHERE ahead IS NOT NULL)
SELECT month, {r("(sum(l_quantity) OVER (PARTITION BY p_brand) + 10 * avg(l_quantity) OVER ()) / (count(*) OVER (PARTITION BY p_brand) + 10)", 5)} AS p_brand,
  {r("top")} AS l_quantity_roll_3_max, {r("ahead")} AS l_quantity_lead_1 FROM known""")
def forecast_recipe_tail(spark, sf):
    """Rolling maxima, leads, then the groups encoded by the value."""
    steps = forecast_recipe("month", ["p_brand"], "l_quantity", lags=[1], windows=[3], leads=[1], rolling=("mean", "max"), encode=["p_brand"])
    out = steps.run(brand_months(spark, sf))
    return rounded(out.select("month", F.round("p_brand", 5).alias("p_brand"), "l_quantity_roll_3_max", "l_quantity_lead_1"))
