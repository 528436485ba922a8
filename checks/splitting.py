"""Split, sample and time-series queries."""

from pyspark.sql import functions as F

from checks.registry import query, r, rounded, table
from tabloom.operators import ordered, series, splits


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")


def sides(train, test):
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query("chronological_split", """SELECT o_orderkey, o_totalprice, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= CAST(floor((SELECT count(*) FROM orders) * 0.8) AS BIGINT)
  THEN 'train' ELSE 'test' END AS side FROM orders""")
def chronological_split(spark, sf):
    train, test = splits.chronological_split(orders(spark, sf), "o_orderdate", 0.2, ["o_orderkey"])
    return sides(train, test).select("o_orderkey", "o_totalprice", "side")


@query("random_split", """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) <= round((SELECT count(*) FROM orders) * 0.2) THEN 'test' ELSE 'train' END AS side FROM orders""")
def random_split(spark, sf):
    return sides(*splits.random_split(orders(spark, sf), ["o_orderkey"], 0.2)).select("o_orderkey", "side")


@query("stratified_split", """SELECT doc_id, toxic, CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY md5('42|' || doc_id), doc_id)
  <= greatest(1, round_even(count(*) OVER (PARTITION BY toxic) * 0.2, 0)) THEN 'test' ELSE 'train' END AS side FROM labels""")
def stratified_split(spark, sf):
    return sides(*splits.random_split(table(spark, sf, "labels"), ["doc_id"], 0.2, stratify="toxic")).select("doc_id", "toxic", "side")


@query("sample_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500")
def sample_rows(spark, sf):
    return splits.sample_rows(orders(spark, sf), 500, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("shuffled_folds", "SELECT o_orderkey, CAST(CAST('0x' || substr(md5('42|' || o_orderkey), 1, 8) AS BIGINT) % 5 AS INT) AS _fold FROM orders")
def shuffled_folds(spark, sf):
    return splits.with_fold(orders(spark, sf), ["o_orderkey"], 5).select("o_orderkey", "_fold")


@query("global_position", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS _pos FROM orders")
def global_position(spark, sf):
    """Positions over many buckets, forced by a small bucket size."""
    df = orders(spark, sf).select("o_orderkey", "o_totalprice")
    return ordered.with_position(df, ["o_totalprice", "o_orderkey"], rows_per_bucket=1000).select("o_orderkey", F.col("_pos").cast("long"))


def monthly(spark, sf):
    return (orders(spark, sf).groupBy("o_orderpriority", F.last_day("o_orderdate").alias("month"))
            .agg(F.sum("o_totalprice").alias("total")))


MONTHLY = "m AS (SELECT o_orderpriority, last_day(o_orderdate) AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)"


@query("autocorrelation", f"""WITH {MONTHLY}, p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY month) AS t FROM m),
s AS (SELECT o_orderpriority, avg(total) AS mean, sum(pow(total - (SELECT avg(total) FROM p q WHERE q.o_orderpriority = p.o_orderpriority), 2)) AS c0, count(*) AS n FROM p GROUP BY 1)
SELECT a.o_orderpriority, CAST(g.lag AS INT) AS lag, {r("any_value(CASE WHEN g.lag = 0 THEN 1.0 END)", 6).replace("any_value(CASE WHEN g.lag = 0 THEN 1.0 END)", "coalesce(sum((a.total - s.mean) * (b.total - s.mean)), 0) / any_value(s.c0)")} AS acf,
  {r("1.96 / sqrt(any_value(s.n))")} AS band
FROM p a JOIN s ON a.o_orderpriority = s.o_orderpriority CROSS JOIN range(0, 13) g(lag) LEFT JOIN p b ON a.o_orderpriority = b.o_orderpriority AND b.t = a.t - g.lag GROUP BY 1, 2""")
def autocorrelation(spark, sf):
    found = series.acf_pacf(monthly(spark, sf), "total", ["month"], ["o_orderpriority"], 12)
    return rounded(found.select("o_orderpriority", "lag", "acf", "band"))


@query("partial_autocorrelation")
def partial_autocorrelation(spark, sf):
    return rounded(series.acf_pacf(monthly(spark, sf), "total", ["month"], ["o_orderpriority"], 12))


LAGGED = f"""WITH {MONTHLY}, p AS (SELECT o_orderpriority, month, total AS x, lag(total) OVER w AS x1, lag(total, 2) OVER w AS x2 FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month))"""


@query("partial_autocorrelation_two_lags", f"""{LAGGED}, k AS (SELECT o_orderpriority, covar_pop(x, x1) AS c01, covar_pop(x, x2) AS c02, covar_pop(x1, x2) AS c12, var_pop(x1) AS v1, var_pop(x2) AS v2 FROM p
  WHERE x2 IS NOT NULL GROUP BY 1)
SELECT o_orderpriority, 1 AS lag, {r("regr_slope(x, x1)")} AS pacf FROM p WHERE x1 IS NOT NULL GROUP BY 1
UNION ALL SELECT o_orderpriority, 2, {r("(c02 * v1 - c01 * c12) / (v1 * v2 - c12 * c12)")} FROM k""")
def partial_autocorrelation_two_lags(spark, sf):
    found = series.acf_pacf(monthly(spark, sf), "total", ["month"], ["o_orderpriority"], 12)
    return rounded(found.where("lag IN (1, 2)").select("o_orderpriority", "lag", "pacf"))


@query("adf_fixed_lag", f"""{LAGGED}, d AS (SELECT o_orderpriority, x - x1 AS y, x1 AS l, x1 - x2 AS e FROM p WHERE x2 IS NOT NULL),
k AS (SELECT o_orderpriority, count(*) AS n, covar_pop(y, l) AS yl, covar_pop(y, e) AS ye, covar_pop(l, e) AS le, var_pop(l) AS ll, var_pop(e) AS ee, var_pop(y) AS yy FROM d GROUP BY 1),
b AS (SELECT *, (yl * ee - ye * le) / (ll * ee - le * le) AS b1, (ye * ll - yl * le) / (ll * ee - le * le) AS b2 FROM k)
SELECT o_orderpriority, n + 2 AS n, {r("b1 / sqrt((yy - b1 * yl - b2 * ye) / (n - 3) * ee / (ll * ee - le * le))", 5)} AS adf_stat FROM b""")
def adf_fixed_lag(spark, sf):
    """The ADF statistic with one lagged difference, from two regressors in closed form."""
    found = series.adf_test(monthly(spark, sf), "total", ["month"], ["o_orderpriority"], lags=1)
    return rounded(found.select("o_orderpriority", "n", "adf_stat"), 5)


KPSS_P = """CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 - (stat - 0.347) / 0.116 * 0.05 WHEN stat <= 0.574 THEN 0.05 - (stat - 0.463) / 0.111 * 0.025
  WHEN stat <= 0.739 THEN 0.025 - (stat - 0.574) / 0.165 * 0.015 ELSE 0.01 END"""


@query("kpss_statistic", f"""WITH {MONTHLY}, e AS MATERIALIZED (SELECT o_orderpriority AS g, row_number() OVER (PARTITION BY o_orderpriority ORDER BY month) AS t, total - avg(total) OVER (PARTITION BY o_orderpriority) AS e,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM m),
c AS MATERIALIZED (SELECT a.g, any_value(a.n) AS n, a.t - b.t AS k, sum(a.e * b.e) AS s FROM e a JOIN e b ON a.g = b.g AND a.t >= b.t GROUP BY 1, 3),
w AS (SELECT g, any_value(n) AS n, sum(CASE WHEN k = 0 THEN s WHEN k <= floor(pow(n, 2.0 / 9)) THEN 2 * s END) AS s0, sum(CASE WHEN k > 0 AND k <= floor(pow(n, 2.0 / 9)) THEN 2 * k * s END) AS s1 FROM c GROUP BY 1),
l AS (SELECT g, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1) AS bw FROM w),
v AS (SELECT c.g, any_value(c.n) AS n, sum(CASE WHEN k = 0 THEN s WHEN k <= bw THEN 2 * (1 - k / (bw + 1)) * s END) / any_value(c.n) AS longrun FROM c JOIN l USING (g) GROUP BY 1),
q AS (SELECT g, sum(p * p) AS q FROM (SELECT g, sum(e) OVER (PARTITION BY g ORDER BY t) AS p FROM e) GROUP BY 1),
k AS (SELECT g, n, q / n / n / longrun AS stat FROM v JOIN q USING (g))
SELECT g AS o_orderpriority, n, {r("stat", 5)} AS kpss_stat, {r(KPSS_P, 4)} AS kpss_p FROM k""")
def kpss_statistic(spark, sf):
    found = series.kpss_test(monthly(spark, sf), "total", ["month"], ["o_orderpriority"])
    return found.select("o_orderpriority", "n", (F.round("kpss_stat", 5) + 0.0).alias("kpss_stat"), (F.round("kpss_p", 4) + 0.0).alias("kpss_p"))


@query("seasonal_decompose_trend", f"""WITH {MONTHLY}, p AS (SELECT *, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month))
SELECT * FROM (SELECT o_orderpriority, position, {r("total", 2)} AS observed, {r('''(sum(total) OVER (PARTITION BY o_orderpriority ORDER BY position ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
  - 0.5 * (lag(total, 6) OVER (PARTITION BY o_orderpriority ORDER BY position) + lead(total, 6) OVER (PARTITION BY o_orderpriority ORDER BY position))) / 12''', 5)} AS trend, n FROM p)
WHERE position >= 6 AND position < n - 6""")
def seasonal_decompose_trend(spark, sf):
    found = series.seasonal_decompose(monthly(spark, sf), "total", ["month"], ["o_orderpriority"], 12)
    sizes = monthly(spark, sf).groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    inner = found.join(sizes, "o_orderpriority").where("position >= 6 AND position < n - 6")
    return inner.select("o_orderpriority", F.col("position").cast("long"), F.round("observed", 2).alias("observed"), F.round("trend", 5).alias("trend"), "n")


@query("seasonal_strength")
def seasonal_strength(spark, sf):
    found = series.seasonal_decompose(monthly(spark, sf), "total", ["month"], ["o_orderpriority"], 12)
    return rounded(series.seasonal_strength(found, ["o_orderpriority"]))


@query("stationarity_test")
def stationarity_test(spark, sf):
    return rounded(series.stationarity_test(monthly(spark, sf), "total", ["month"], ["o_orderpriority"]))


@query("forecast_ar")
def forecast_ar(spark, sf):
    return rounded(series.forecast_ar(monthly(spark, sf), "total", ["month"], ["o_orderpriority"], 6), 2)
