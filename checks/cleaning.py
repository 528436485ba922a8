"""Projection, filter, cleaning and imputation queries."""

from pyspark.sql import functions as F

from checks.registry import query, r, rounded, table
from tabloom.functions.columns import numeric_columns
from tabloom.operators import clean, dates, impute

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# line items with gaps: the same expressions on both sides
GAPPY = """gappy AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
  CASE WHEN l_suppkey % 3 <> 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
  l_linestatus FROM lineitem)"""


def lines(spark, sf):
    return table(spark, sf, "lineitem")


def gappy(spark, sf):
    null = F.lit(None)
    return lines(spark, sf).select(
        *KEYS,
        F.when(F.col("l_orderkey") % 7 == 0, null).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_partkey") % 11 == 0, null).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(F.col("l_suppkey") % 3 != 0, null).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_orderkey") % 5 == 0, null).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus")


@query("select_columns", "SELECT l_orderkey, l_quantity FROM lineitem")
def select_columns(spark, sf):
    return clean.select_columns(lines(spark, sf), ["l_orderkey", "no_such_column", "l_quantity"])


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_columns(spark, sf):
    return clean.drop_columns(table(spark, sf, "orders"), ["o_orderdate", "o_orderpriority", "absent"])


@query("rename_columns", "SELECT c_custkey AS customer, c_name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer")
def rename_columns(spark, sf):
    return clean.rename_columns(table(spark, sf, "customer"), {"c_custkey": "customer", "c_acctbal": "balance", "x": "y"})


@query("drop_duplicates", """SELECT DISTINCT l_returnflag, l_linestatus, l_discount, l_tax,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS l_linenumber FROM lineitem""")
def drop_duplicates(spark, sf):
    df = lines(spark, sf).select("l_returnflag", "l_linestatus", "l_discount", "l_tax",
                                 F.when(F.col("l_linenumber") != 1, F.col("l_linenumber")).alias("l_linenumber"))
    return clean.drop_duplicates(df)


@query("drop_high_missing", f"WITH {GAPPY} SELECT * EXCLUDE (l_discount) FROM gappy")
def drop_high_missing(spark, sf):
    return clean.drop_high_missing(gappy(spark, sf), 0.5)


@query("drop_constant", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS part FROM orders")
def drop_constant(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("one"),
                                           F.when(F.col("o_orderkey") % 2 == 0, "x").alias("part"),
                                           F.lit(None).cast("string").alias("nothing"))
    return clean.drop_constant(df)


@query("drop_correlated", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem")
def drop_correlated(spark, sf):
    df = lines(spark, sf).select("l_orderkey", "l_quantity", "l_discount", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("nearly"))
    return clean.drop_correlated(df, 0.95)


_SEQ = """
a AS (SELECT quantile_cont(c_acctbal, 0.25) q1, quantile_cont(c_acctbal, 0.75) q3 FROM base),
s1 AS (SELECT base.* FROM base, a WHERE q3 - q1 <= 0 OR c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
b AS (SELECT quantile_cont(cube, 0.25) q1, quantile_cont(cube, 0.75) q3 FROM s1)
SELECT c_name, c_acctbal, cube FROM s1, b WHERE q3 - q1 <= 0 OR cube BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""


@query("filter_outliers", f"""WITH base AS (SELECT c_name, c_acctbal, c_acctbal * c_acctbal * c_acctbal AS cube FROM customer), {_SEQ}""")
def filter_outliers(spark, sf):
    cube = F.col("c_acctbal") * F.col("c_acctbal") * F.col("c_acctbal")
    return clean.filter_outliers(table(spark, sf, "customer").select("c_name", "c_acctbal", cube.alias("cube")))


@query("filter_outliers_simultaneous", """
WITH base AS (SELECT event_id, value, value * value AS square FROM events),
f AS (SELECT quantile_cont(event_id, 0.25) e1, quantile_cont(event_id, 0.75) e3, quantile_cont(value, 0.25) v1, quantile_cont(value, 0.75) v3,
  quantile_cont(square, 0.25) s1, quantile_cont(square, 0.75) s3 FROM base)
SELECT base.* FROM base, f WHERE event_id BETWEEN e1 - 1.5 * (e3 - e1) AND e3 + 1.5 * (e3 - e1)
AND value BETWEEN v1 - 1.5 * (v3 - v1) AND v3 + 1.5 * (v3 - v1) AND square BETWEEN s1 - 1.5 * (s3 - s1) AND s3 + 1.5 * (s3 - s1)""")
def filter_outliers_simultaneous(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", (F.col("value") * F.col("value")).alias("square"))
    return clean.filter_outliers(df, mode="simultaneous")


@query("zscore_outlier_removal", f"""WITH {GAPPY}, m AS (SELECT avg(l_quantity) qm, stddev_pop(l_quantity) qs,
  avg(l_extendedprice) pm, stddev_pop(l_extendedprice) ps FROM gappy)
SELECT gappy.* FROM gappy, m WHERE coalesce(abs((l_quantity - qm) / qs) <= 1.5, true) AND coalesce(abs((l_extendedprice - pm) / ps) <= 1.5, true)""")
def zscore_outlier_removal(spark, sf):
    return clean.zscore_outlier_removal(gappy(spark, sf), 1.5, ["l_quantity", "l_extendedprice"])


@query("clip_values", f"WITH {GAPPY} SELECT * REPLACE (CASE WHEN l_quantity < 10 THEN 10.0 WHEN l_quantity > 40 THEN 40.0 ELSE l_quantity END AS l_quantity) FROM gappy")
def clip_values(spark, sf):
    return clean.clip_values(gappy(spark, sf), "l_quantity", 10.0, 40.0)


@query("winsorize", f"""WITH {GAPPY}, q AS (SELECT quantile_cont(l_quantity, 0.05) q1, quantile_cont(l_quantity, 0.95) q2,
  quantile_cont(l_extendedprice, 0.05) p1, quantile_cont(l_extendedprice, 0.95) p2 FROM gappy)
SELECT gappy.* REPLACE ({r("CASE WHEN l_quantity < q1 THEN q1 WHEN l_quantity > q2 THEN q2 ELSE l_quantity END")} AS l_quantity,
 {r("CASE WHEN l_extendedprice < p1 THEN p1 WHEN l_extendedprice > p2 THEN p2 ELSE l_extendedprice END")} AS l_extendedprice) FROM gappy, q""")
def winsorize(spark, sf):
    return rounded(clean.winsorize(gappy(spark, sf), 0.05, 0.95, ["l_quantity", "l_extendedprice"]))


@query("winsorize_narrowed_quantiles", f"""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) lo, quantile_cont(l_extendedprice, 0.5) mid,
  quantile_cont(l_extendedprice, 0.99) hi, quantile_cont(l_quantity, 0.01) qlo, quantile_cont(l_quantity, 0.5) qmid, quantile_cont(l_quantity, 0.99) qhi FROM lineitem)
SELECT 'l_extendedprice' AS "column", {r("lo")} AS low, {r("mid")} AS middle, {r("hi")} AS high FROM q
UNION ALL SELECT 'l_quantity', {r("qlo")}, {r("qmid")}, {r("qhi")} FROM q""")
def winsorize_narrowed_quantiles(spark, sf):
    """The narrowing plan for columns too large for one percentile buffer, forced by small limits."""
    from tabloom.operators.quantiles import exact_quantiles

    df = lines(spark, sf)
    found = exact_quantiles(df, ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.99], direct_rows=1000, final_values=50)
    return rounded(spark.createDataFrame([(n, *q) for n, q in found.items()], "column string, low double, middle double, high double"))


@query("datetime_parse", """
SELECT o_orderkey, coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%m/%d/%Y')) AS d FROM (SELECT o_orderkey,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE '12x' END AS d FROM orders)""")
def datetime_parse(spark, sf):
    mixed = (F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
             .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("12x"))
    return dates.datetime_parse(table(spark, sf, "orders").select("o_orderkey", mixed.alias("d")), ["d"])


@query("filter_target_not_null", f"WITH {GAPPY} SELECT * FROM gappy WHERE l_returnflag IS NOT NULL")
def filter_target_not_null(spark, sf):
    return clean.filter_target_not_null(gappy(spark, sf), "l_returnflag")


@query("numeric_column_resolution", "SELECT l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax FROM lineitem")
def numeric_column_resolution(spark, sf):
    df = lines(spark, sf)
    return df.select(*numeric_columns(df, None, exclude=["l_orderkey"], exclude_columns=["l_quantity"]))


@query("impute_missing", f"""WITH {GAPPY},
s AS (SELECT quantile_cont(l_quantity, 0.5) q, quantile_cont(l_extendedprice, 0.5) p, quantile_cont(l_discount, 0.5) d FROM gappy),
m AS (SELECT l_returnflag AS mode FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT gappy.* REPLACE (coalesce(l_quantity, q) AS l_quantity, {r("coalesce(l_extendedprice, p)")} AS l_extendedprice,
  coalesce(l_discount, d) AS l_discount, coalesce(l_returnflag, mode) AS l_returnflag) FROM gappy, s, m""")
def impute_missing(spark, sf):
    return rounded(impute.impute_missing(gappy(spark, sf)))


@query("constant_impute", f"""WITH {GAPPY} SELECT gappy.* REPLACE (coalesce(l_quantity, 0) AS l_quantity, coalesce(l_extendedprice, 0) AS l_extendedprice,
  coalesce(l_discount, 0) AS l_discount, coalesce(l_returnflag, '0') AS l_returnflag) FROM gappy""")
def constant_impute(spark, sf):
    return impute.constant_impute(gappy(spark, sf))


@query("missing_indicators", f"""WITH {GAPPY} SELECT *, CAST(l_quantity IS NULL AS INT) AS l_quantity_was_missing,
  CAST(l_extendedprice IS NULL AS INT) AS l_extendedprice_was_missing, CAST(l_discount IS NULL AS INT) AS l_discount_was_missing,
  CAST(l_returnflag IS NULL AS INT) AS l_returnflag_was_missing FROM gappy""")
def missing_indicators(spark, sf):
    return impute.add_missing_indicators(gappy(spark, sf))


def _rounds_sql(rounds: int) -> str:
    """Rounds of two ridge regressions on each other, a first; known values are kept."""
    steps = ["s0 AS MATERIALIZED (SELECT *, coalesce(a0, 0) AS a, coalesce(b0, 0) AS b FROM z)"]
    for k in range(rounds):
        for mine, other, source, to in (("a", "b", f"s{k}", f"h{k}"), ("b", "a", f"h{k}", f"s{k + 1}")):
            steps.append(f"""w{to} AS MATERIALIZED (SELECT slope, ma - slope * mb AS base FROM (SELECT avg({mine}) AS ma, avg({other}) AS mb,
  covar_pop({mine}, {other}) * count(*) / (var_pop({other}) * count(*) + 0.001) AS slope FROM {source} WHERE {mine}0 IS NOT NULL))""")
            steps.append(f"{to} AS MATERIALIZED (SELECT {source}.* REPLACE (coalesce({mine}0, slope * {other} + base) AS {mine}) FROM {source}, w{to})")
    return ",\n".join(steps)


@query("iterative_impute", f"""WITH {GAPPY}, g AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_extendedprice AS price,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity * 2000 + l_partkey END AS volume FROM gappy),
m AS (SELECT avg(price) AS ma, stddev_pop(price) AS sa, avg(volume) AS mb, stddev_pop(volume) AS sb FROM g),
z AS MATERIALIZED (SELECT l_orderkey, l_linenumber, price, volume, (price - ma) / sa AS a0, (volume - mb) / sb AS b0 FROM g, m),
{_rounds_sql(10)}
SELECT l_orderkey, l_linenumber, {r("coalesce(price, a * sa + ma)", 4)} AS price, {r("coalesce(volume, b * sb + mb)", 4)} AS volume FROM s10, m""")
def iterative_impute(spark, sf):
    df = gappy(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"),
                                 (F.col("l_quantity") * 2000 + F.col("l_partkey")).alias("volume"))
    return rounded(impute.iterative_impute(df, 10, ["price", "volume"], tol=0.0), 4)


@query("iterative_impute_three")
def iterative_impute_three(spark, sf):
    df = gappy(spark, sf).withColumn("total", F.col("l_quantity") * 3 + F.col("l_linenumber"))
    return impute.iterative_impute(df, 10, ["l_quantity", "l_extendedprice", "total"])
