"""Aggregation, profile and summary queries."""

from pyspark.sql import functions as F

from checks.cleaning import GAPPY, gappy, lines
from checks.registry import query, r, rounded, table
from tabloom.operators import aggregate


@query("groupby_aggregate", f"""WITH {GAPPY} SELECT l_returnflag, l_linestatus, count(l_quantity) AS l_quantity_count, {r("avg(l_quantity)")} AS l_quantity_mean,
  coalesce(sum(l_quantity), 0) AS l_quantity_sum, count(DISTINCT l_partkey) AS l_partkey_nunique, min(l_extendedprice) AS l_extendedprice_min,
  max(l_extendedprice) AS l_extendedprice_max,
  arg_min(l_discount, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) FILTER (l_discount IS NOT NULL) AS l_discount_first,
  arg_max(l_discount, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) FILTER (l_discount IS NOT NULL) AS l_discount_last
FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 1, 2""")
def groupby_aggregate(spark, sf):
    return rounded(aggregate.groupby_aggregate(
        gappy(spark, sf), ["l_returnflag", "l_linestatus"],
        {"l_quantity": ["count", "mean", "sum"], "l_partkey": ["nunique"], "l_extendedprice": ["min", "max"],
         "l_discount": ["first", "last"], "absent": "sum"}, order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]))


@query("profile_table", f"""WITH {GAPPY}, slim AS (SELECT l_returnflag, l_linestatus, l_discount, l_quantity FROM gappy)
SELECT count(*) AS row_count, 4::INT AS column_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM slim)) AS duplicate_rows,
  CAST(sum((l_returnflag IS NULL)::INT + (l_linestatus IS NULL)::INT + (l_discount IS NULL)::INT + (l_quantity IS NULL)::INT) AS BIGINT) AS missing_cells,
  {r("sum((l_returnflag IS NULL)::INT + (l_linestatus IS NULL)::INT + (l_discount IS NULL)::INT + (l_quantity IS NULL)::INT) / (count(*) * 4) * 100")} AS missing_pct FROM slim""")
def profile_table(spark, sf):
    return rounded(aggregate.profile(gappy(spark, sf).select("l_returnflag", "l_linestatus", "l_discount", "l_quantity")))


def _column(i, name, dtype, role):
    return (f"SELECT {i}::INT AS position, '{name}' AS name, '{dtype}' AS dtype, {role} AS role, count(*) - count({name}) AS missing_count, "
            f"{r(f'(count(*) - count({name})) / count(*) * 100')} AS missing_pct, count(DISTINCT {name}) AS unique_count FROM customer")


@query("profile_columns", " UNION ALL ".join([
    _column(0, "c_custkey", "bigint", "'numeric'"),
    _column(1, "c_name", "string", "CASE WHEN count(DISTINCT c_name) / count(*) > 0.8 THEN 'identifier/text' ELSE 'categorical' END"),
    _column(2, "c_nationkey", "int", "'numeric'"), _column(3, "c_acctbal", "double", "'numeric'"),
    _column(4, "c_mktsegment", "string", "CASE WHEN count(DISTINCT c_mktsegment) / count(*) > 0.8 THEN 'identifier/text' ELSE 'categorical' END")]))
def profile_columns(spark, sf):
    return rounded(aggregate.profile_columns(table(spark, sf, "customer")).drop("sample_values"))


def _line_column(i, name, dtype, role):
    return _column(i, name, dtype, role).replace("FROM customer", "FROM gappy")


@query("profile_columns_lines", f"WITH {GAPPY} " + " UNION ALL ".join(_line_column(i, n, t, role) for i, (n, t, role) in enumerate((
    ("l_orderkey", "bigint", "'numeric'"), ("l_linenumber", "int", "'numeric'"), ("l_partkey", "bigint", "'numeric'"), ("l_suppkey", "bigint", "'numeric'"),
    ("l_quantity", "double", "'numeric'"), ("l_extendedprice", "double", "'numeric'"), ("l_discount", "double", "'numeric'"), ("l_returnflag", "string", "'categorical'"),
    ("l_linestatus", "string", "'categorical'")))))
def profile_columns_lines(spark, sf):
    return rounded(aggregate.profile_columns(gappy(spark, sf)).drop("sample_values"))


@query("profile_samples", """WITH v AS (SELECT DISTINCT c_mktsegment AS v FROM customer) SELECT 'c_mktsegment' AS name, list(v ORDER BY v) AS samples FROM v
UNION ALL SELECT 'c_nationkey', NULL""")
def profile_samples(spark, sf):
    """Five values at most: all of a column with so few, five distinct ones of another."""
    found = aggregate.profile_columns(table(spark, sf, "customer").select("c_mktsegment", "c_nationkey"))
    few = F.when(F.col("unique_count") <= 5, F.array_sort("sample_values"))
    return found.where((F.size("sample_values") == F.least(F.col("unique_count"), F.lit(5))) & (F.size(F.array_distinct("sample_values")) == F.size("sample_values"))).select(
        "name", few.alias("samples"))


@query("infer_roles", """SELECT 'o_orderkey' AS name, 'numeric' AS role UNION ALL SELECT 'o_custkey', 'numeric' UNION ALL
SELECT 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) / count(*) > 0.8 THEN 'identifier/text' ELSE 'categorical' END FROM orders UNION ALL
SELECT 'o_totalprice', 'numeric' UNION ALL SELECT 'o_orderdate', 'datetime' UNION ALL
SELECT 'o_orderpriority', CASE WHEN count(DISTINCT o_orderpriority) / count(*) > 0.8 THEN 'identifier/text' ELSE 'categorical' END FROM orders""")
def infer_roles(spark, sf):
    return aggregate.infer_roles(table(spark, sf, "orders"))


def _summary(n):
    parts = {"mean": f"avg({n})", "std": f"stddev_samp({n})", "min": f"min({n})", "q25": f"quantile_cont({n}, 0.25)",
             "q50": f"quantile_cont({n}, 0.5)", "q75": f"quantile_cont({n}, 0.75)", "max": f"max({n})"}
    cols = ", ".join(f"{r(f'CAST({v} AS DOUBLE)', 4)} AS {k}" for k, v in parts.items())
    return f"SELECT '{n}' AS \"column\", count({n}) AS count, {cols} FROM gappy"


@query("numeric_summary", f"WITH {GAPPY} " + " UNION ALL ".join(
    _summary(n) for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")))
def numeric_summary(spark, sf):
    return rounded(aggregate.numeric_summary(gappy(spark, sf)), 4)


@query("class_balance", """SELECT 'toxic' AS "column", count(*) AS n_classes, round(max(k) / min(k), 3) AS imbalance_ratio, max(k) / min(k) > 3 AS is_imbalanced,
  CASE WHEN max(k) / min(k) > 3 THEN 'One class is rare: balance the rows before a fit.' ELSE 'The classes are of similar size.' END AS recommendation
FROM (SELECT toxic, count(*) AS k FROM labels GROUP BY 1)""")
def class_balance(spark, sf):
    return aggregate.class_balance(table(spark, sf, "labels"), "toxic")


@query("class_counts", "SELECT l_returnflag AS class, count(*) AS class_count FROM lineitem GROUP BY 1")
def class_counts(spark, sf):
    return aggregate.class_counts(lines(spark, sf), "l_returnflag")


def _outliers(n):
    return f"""SELECT '{n}' AS "column", count(*) FILTER ({n} < q1 - 1.5 * (q3 - q1) OR {n} > q3 + 1.5 * (q3 - q1)) AS iqr_outliers,
  count(*) FILTER (abs(({n} - m) / (s + 1e-12)) > 3) AS zscore_outliers, count({n}) AS total,
  round(100 * count(*) FILTER ({n} < q1 - 1.5 * (q3 - q1) OR {n} > q3 + 1.5 * (q3 - q1)) / count({n}), 1) AS iqr_pct
FROM base, (SELECT quantile_cont({n}, 0.25) q1, quantile_cont({n}, 0.75) q3, avg({n}) m, stddev_samp({n}) s FROM base)"""


@query("outlier_summary", "WITH base AS (SELECT value, value * value * value AS cube, user_id FROM events) "
       + " UNION ALL ".join(_outliers(n) for n in ("value", "cube", "user_id")))
def outlier_summary(spark, sf):
    v = F.col("value")
    return aggregate.outlier_summary(table(spark, sf, "events").select("value", (v * v * v).alias("cube"), "user_id"))


TASKS = [("lineitem", "l_returnflag"), ("lineitem", "l_linenumber"), ("lineitem", "l_extendedprice"), ("lineitem", "l_discount"),
         ("orders", "o_custkey"), ("labels", "toxic"), ("customer", "c_acctbal")]


@query("infer_task_type", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{n}' AS target, CASE WHEN count(DISTINCT {n}) <= 1 OR any_value(typeof({n})) = 'VARCHAR' THEN 'classification'
  WHEN any_value(typeof({n})) IN ('INTEGER', 'BIGINT') AND count(DISTINCT {n}) <= 20 THEN 'classification'
  WHEN count(DISTINCT {n}) <= 10 AND count(DISTINCT {n}) / count({n}) <= 0.2 THEN 'classification' ELSE 'regression' END AS task FROM {t}""" for t, n in TASKS))
def infer_task_type(spark, sf):
    found = [(t, n, aggregate.infer_task_type(table(spark, sf, t), n)) for t, n in TASKS]
    return spark.createDataFrame(found, "table string, target string, task string")


@query("inspect_dataset", "SELECT count(*) AS row_count, 5::INT AS column_count, ['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'] AS columns FROM customer")
def inspect_dataset(spark, sf):
    return aggregate.inspect_dataset(table(spark, sf, "customer"))
