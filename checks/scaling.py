"""Scaling and numeric transform queries."""

from pyspark.sql import functions as F

from checks.cleaning import GAPPY, gappy, lines
from checks.registry import query, r, rounded, table
from tabloom.operators import scale

BASE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
FLAT = """flat AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, 5.0 AS flat FROM gappy)"""
WHAT = ["l_quantity", "l_extendedprice", "flat"]


def flat(spark, sf):
    return gappy(spark, sf).select(*BASE, F.lit(5.0).alias("flat"))


def _scaled(shift: str, width: str) -> str:
    """Scaling SQL with per-column statistics; NULLIF guards the constant column."""
    stats = ", ".join(f"{shift.format(n)} AS {n}_a, {width.format(n)} AS {n}_b" for n in WHAT)
    cols = ", ".join(f"{r(f'(flat.{n} - {n}_a) / CASE WHEN {n}_b = 0 THEN 1 ELSE {n}_b END')} AS {n}" for n in WHAT)
    return f"WITH {GAPPY}, {FLAT}, s AS (SELECT {stats} FROM flat) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {cols} FROM flat, s"


@query("standard_scale", _scaled("avg({0})", "stddev_pop({0})"))
def standard_scale(spark, sf):
    return rounded(scale.standard_scale(flat(spark, sf), WHAT))


@query("minmax_scale", _scaled("min({0})", "(max({0}) - min({0}))"))
def minmax_scale(spark, sf):
    return rounded(scale.minmax_scale(flat(spark, sf), WHAT))


@query("robust_scale", _scaled("quantile_cont({0}, 0.5)", "(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))"))
def robust_scale(spark, sf):
    return rounded(scale.robust_scale(flat(spark, sf), WHAT))


@query("max_abs_scale", _scaled("0 * min({0})", "max(abs({0}))"))
def max_abs_scale(spark, sf):
    return rounded(scale.max_abs_scale(flat(spark, sf), WHAT))


@query("power_transform")
def power_transform(spark, sf):
    return rounded(scale.power_transform(gappy(spark, sf).select(*BASE), "yeo-johnson", ["l_quantity", "l_extendedprice"]))


@query("power_transform_box_cox")
def power_transform_box_cox(spark, sf):
    return rounded(scale.power_transform(lines(spark, sf).select(*BASE), "box-cox", ["l_quantity", "l_extendedprice"]))


@query("quantile_transform")
def quantile_transform(spark, sf):
    return rounded(scale.quantile_transform(gappy(spark, sf).select(*BASE), "normal", columns=["l_quantity", "l_extendedprice"]))


@query("quantile_transform_uniform")
def quantile_transform_uniform(spark, sf):
    return rounded(scale.quantile_transform(gappy(spark, sf).select(*BASE), "uniform", columns=["l_quantity", "l_extendedprice"]))


@query("log_transform", f"""SELECT c_custkey, c_acctbal, {r("ln(1 + greatest(c_acctbal, 0))")} AS c_acctbal_log1p FROM customer""")
def log_transform(spark, sf):
    return rounded(scale.log_transform(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query("target_log_transform", f"""SELECT c_custkey, {r("ln(1 + greatest(c_acctbal, 0))")} AS c_acctbal FROM customer""")
def target_log_transform(spark, sf):
    return rounded(scale.target_log_transform(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal"))


@query("bin_numeric", f"""WITH {GAPPY},
q AS (SELECT quantile_cont(l_quantity, 0.2) a, quantile_cont(l_quantity, 0.4) b, quantile_cont(l_quantity, 0.6) c, quantile_cont(l_quantity, 0.8) d FROM gappy)
SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity IS NOT NULL THEN CAST(l_quantity > a AS INT) + CAST(l_quantity > b AS INT)
  + CAST(l_quantity > c AS INT) + CAST(l_quantity > d AS INT) END AS l_quantity_bin FROM gappy, q""")
def bin_numeric(spark, sf):
    return scale.bin_numeric(gappy(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 5)


_EDGES = " UNION ".join(f"SELECT quantile_cont(l_linenumber, {i / 20}) AS edge FROM lineitem" for i in range(21))


@query("bin_numeric_merged_edges", f"""WITH e AS ({_EDGES})
SELECT l_orderkey, l_linenumber, l_tax, CAST((SELECT count(*) FROM e WHERE edge < l_linenumber AND edge > (SELECT min(edge) FROM e)) AS INT) AS l_linenumber_bin FROM lineitem""")
def bin_numeric_merged_edges(spark, sf):
    return scale.bin_numeric(lines(spark, sf).select("l_orderkey", "l_linenumber", "l_tax"), "l_linenumber", 20)


@query("interaction_features", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_quantity * l_extendedprice AS l_quantity_x_l_extendedprice, "
       "l_discount * l_linenumber AS l_discount_x_l_linenumber FROM lineitem")
def interaction_features(spark, sf):
    df = lines(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return scale.interaction_features(df, [["l_quantity", "l_extendedprice"], ["l_discount", "l_linenumber"], ["l_quantity", "none"]])


@query("polynomial_features", f"SELECT l_orderkey, l_quantity, l_discount, {r('l_quantity ** 2')} AS l_quantity_pow2, {r('l_quantity ** 3')} AS l_quantity_pow3, "
       f"{r('l_discount ** 2')} AS l_discount_pow2, {r('l_discount ** 3')} AS l_discount_pow3 FROM lineitem")
def polynomial_features(spark, sf):
    return rounded(scale.polynomial_features(lines(spark, sf).select("l_orderkey", "l_quantity", "l_discount"), ["l_quantity", "l_discount"], 3))


@query("cyclical_encode", f"""SELECT o_orderkey, month(o_orderdate)::INT AS month, {r("sin(2 * pi() * month(o_orderdate) / 12)")} AS month_sin,
  {r("cos(2 * pi() * month(o_orderdate) / 12)")} AS month_cos FROM orders""")
def cyclical_encode(spark, sf):
    return rounded(scale.cyclical_encode(table(spark, sf, "orders").select("o_orderkey", F.month("o_orderdate").alias("month")), "month", 12))


_FOURIER = ", ".join(f"{r(f'{f}(2 * pi() * {k} * days / 365.25)')} AS fourier_o_orderdate_{f}{k}" for k in (1, 2) for f in ("sin", "cos"))


@query("fourier_features", f"""SELECT o_orderkey, o_orderdate, {_FOURIER} FROM (
  SELECT o_orderkey, o_orderdate, date_diff('day', (SELECT min(o_orderdate) FROM orders), o_orderdate) AS days FROM orders)""")
def fourier_features(spark, sf):
    return rounded(scale.fourier_features(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 365.25, 2))
