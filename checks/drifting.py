"""Drift queries: the first half of the event month against the second."""

from pyspark.sql import functions as F

from checks.registry import query, r, rounded, table
from tabloom.operators import drift

SIDES = """s AS (SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, value, event_type,
  CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 0 ELSE 1 END AS side FROM events)"""


def halves(spark, sf):
    df = table(spark, sf, "events")
    return df.where("ts < '2024-01-15'").drop("ts"), df.where("ts >= '2024-01-15'").drop("ts")


def _psi(n, tag, bins=10):
    edges = " UNION ".join(f"SELECT quantile_cont({n}, {i / bins}) AS e FROM s" for i in range(bins + 1))
    return f"""{tag}_e AS ({edges}),
{tag}_x AS (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi, max(e) OVER () AS top FROM {tag}_e),
{tag}_b AS (SELECT lo, count({n}) FILTER (side = 0) AS a, count({n}) FILTER (side = 1) AS b
  FROM {tag}_x JOIN s ON {n} >= lo AND ({n} < hi OR (hi = top AND {n} = top)) WHERE hi IS NOT NULL GROUP BY lo),
{tag}_all AS (SELECT lo, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT lo FROM {tag}_x WHERE hi IS NOT NULL) LEFT JOIN {tag}_b USING (lo)),
{tag}_p AS (SELECT (a + 1e-6) / ((SELECT count({n}) FROM s WHERE side = 0) + 1e-6 * {bins}) AS p,
  (b + 1e-6) / ((SELECT count({n}) FROM s WHERE side = 1) + 1e-6 * {bins}) AS q FROM {tag}_all),
{tag}_psi AS (SELECT {r("sum((q - p) * ln(q / p))")} AS psi FROM {tag}_p)"""


def _js(n, tag, bins=10):
    return f"""{tag}_r AS (SELECT min({n}) AS lo, max({n}) AS hi FROM s),
{tag}_i AS (SELECT side, CASE WHEN {n} = hi THEN {bins} - 1 ELSE CAST(floor(({n} - lo) / (hi - lo) * {bins}) AS INT) END AS bin FROM s, {tag}_r WHERE {n} IS NOT NULL),
{tag}_c AS (SELECT g.bin, count(i.side) FILTER (i.side = 0) AS a, count(i.side) FILTER (i.side = 1) AS b FROM range({bins}) g(bin) LEFT JOIN {tag}_i i ON i.bin = g.bin GROUP BY 1),
{tag}_d AS (SELECT a / (sum(a) OVER () * (hi - lo) / {bins}) + 1e-10 AS a, b / (sum(b) OVER () * (hi - lo) / {bins}) + 1e-10 AS b FROM {tag}_c, {tag}_r),
{tag}_n AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM {tag}_d),
{tag}_js AS (SELECT {r("greatest(0, 0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2))))")} AS js FROM {tag}_n)"""


def _ks(n, tag):
    return f"""{tag}_k AS (SELECT {n} AS v, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM s WHERE {n} IS NOT NULL GROUP BY 1),
{tag}_ks AS (SELECT {r("max(abs(ca - cb))")} AS ks, max(abs(ca - cb)) AS d, max(na) AS na, max(nb) AS nb FROM (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS ca, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM {tag}_k)),
{tag}_p2 AS (SELECT {r(_ks_p("d", "na", "nb"))} AS p FROM {tag}_ks)"""


def _ks_p(d, n, m):
    """The alternating series of the asymptotic distribution; below 0.2 it is 1 to six digits."""
    x = f"({d} * sqrt({n}::DOUBLE * {m} / ({n} + {m})))"
    series = f"(SELECT sum((CASE WHEN t % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0 * t * t * {x} * {x})) FROM range(1, 100) g(t))"
    return f"CASE WHEN {x} < 0.2 THEN 1.0 ELSE greatest(0, least(1, {series})) END"


def _severity(psi, p):
    return f"CASE WHEN {psi} > 0.2 OR {p} < 0.05 THEN 'HIGH' WHEN {psi} > 0.1 OR {p} < 0.1 THEN 'MODERATE' ELSE 'LOW' END"


CAT = """k AS (SELECT event_type, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM s GROUP BY 1),
t AS (SELECT sum(a) AS na, sum(b) AS nb, count(*) AS cats FROM k)"""
CAT_PSI = r("sum((b / nb + 1e-6 - (a / na + 1e-6)) * ln((b / nb + 1e-6) / (a / na + 1e-6)))")
CAT_CHI = r("sum(pow(a - (a + b) * na / (na + nb), 2) / ((a + b) * na / (na + nb)) + pow(b - (a + b) * nb / (na + nb), 2) / ((a + b) * nb / (na + nb)))")


@query("psi", f"WITH {SIDES}, {_psi('value', 'v')} SELECT 'value' AS \"column\", psi FROM v_psi")
def psi(spark, sf):
    return spark.createDataFrame([("value", drift.psi(*halves(spark, sf), "value"))], "column string, psi double")


@query("psi_merged_edges", f"WITH s AS (SELECT CAST(l_linenumber AS DOUBLE) AS v, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS side FROM lineitem), {_psi('v', 'v', 20)} SELECT psi FROM v_psi")
def psi_merged_edges(spark, sf):
    df = table(spark, sf, "lineitem")
    return spark.createDataFrame([(drift.psi(df.where("l_returnflag = 'A'"), df.where("l_returnflag <> 'A'"), "l_linenumber", 20),)], "psi double")


@query("js_divergence", f"WITH {SIDES}, {_js('value', 'v')} SELECT 'value' AS \"column\", js FROM v_js")
def js_divergence(spark, sf):
    return spark.createDataFrame([("value", drift.js_divergence(*halves(spark, sf), "value"))], "column string, js double")


@query("categorical_psi", f"WITH {SIDES}, {CAT} SELECT {CAT_PSI} AS psi FROM k, t")
def categorical_psi(spark, sf):
    return spark.createDataFrame([(drift.categorical_psi(*halves(spark, sf), "event_type"),)], "psi double")


@query("ks_two_sample", f"WITH {SIDES}, {_ks('value', 'v')} SELECT ks FROM v_ks")
def ks_two_sample(spark, sf):
    return spark.createDataFrame([(drift.ks_two_sample(*halves(spark, sf), "value")[0],)], "ks double")


@query("ks_two_sample_bucketed", f"WITH s AS (SELECT l_extendedprice AS v, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS side FROM lineitem), {_ks('v', 'v')} SELECT ks FROM v_ks")
def ks_two_sample_bucketed(spark, sf):
    """Prefix sums over many buckets, forced by a small bucket size."""
    df = table(spark, sf, "lineitem")
    found = drift.ks_statistics(df.where("l_linestatus = 'O'"), df.where("l_linestatus <> 'O'"), ["l_extendedprice"], rows_per_bucket=2000)
    return spark.createDataFrame([(found["l_extendedprice"][0],)], "ks double")


@query("chi2_two_sample", f"WITH {SIDES}, {CAT} SELECT {CAT_CHI} AS chi2 FROM k, t")
def chi2_two_sample(spark, sf):
    return spark.createDataFrame([(drift.chi2_two_sample(*halves(spark, sf), "event_type")[0],)], "chi2 double")


@query("chi2_two_sample_yates", """
WITH k AS (SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag <> 'A') AS b FROM lineitem GROUP BY 1),
t AS (SELECT sum(a) AS na, sum(b) AS nb FROM k),
g AS (SELECT abs(a - (a + b) * na / (na + nb)) AS gap, (a + b) * na / (na + nb) AS ea, (a + b) * nb / (na + nb) AS eb FROM k, t)
SELECT """ + r("sum(pow(gap - least(gap, 0.5), 2) / ea + pow(gap - least(gap, 0.5), 2) / eb)") + " AS chi2 FROM g")
def chi2_two_sample_yates(spark, sf):
    df = table(spark, sf, "lineitem")
    return spark.createDataFrame([(drift.chi2_two_sample(df.where("l_returnflag = 'A'"), df.where("l_returnflag <> 'A'"), "l_linestatus")[0],)], "chi2 double")


@query("drift_severity", """SELECT l_orderkey, l_linenumber, l_discount, l_tax, CASE WHEN l_discount * 3 > 0.2 OR l_tax + 0.03 < 0.05 THEN 'HIGH'
  WHEN l_discount * 3 > 0.1 OR l_tax + 0.03 < 0.1 THEN 'MODERATE' ELSE 'LOW' END AS severity FROM lineitem""")
def drift_severity(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return df.withColumn("severity", drift.drift_severity(F.col("l_discount") * 3, F.col("l_tax") + F.lit(0.03)))


_NUMERIC = ("event_id", "user_id", "value")
_COMPARE = ", ".join(f"{_psi(n, n)}, {_js(n, n)}, {_ks(n, n)}" for n in _NUMERIC)


def _moments(n):
    parts = ", ".join(f"{r(f'{fn}({n}) FILTER (side = {i})', 4)} AS {s}_{k}" for i, s in ((0, "ref"), (1, "cur")) for k, fn in (("mean", "avg"), ("std", "stddev_pop")))
    return (f"SELECT '{n}' AS \"column\", (SELECT psi FROM {n}_psi) AS psi, (SELECT js FROM {n}_js) AS js_divergence, (SELECT ks FROM {n}_ks) AS ks_statistic, (SELECT p FROM {n}_p2) AS ks_p_value, "
            f"(SELECT {_severity('psi', 'p')} FROM {n}_psi, {n}_p2) AS severity, "
            f"{parts}, count({n}) FILTER (side = 0) AS ref_n, count({n}) FILTER (side = 1) AS cur_n FROM s")


@query("compare_distributions", f"WITH {SIDES}, {_COMPARE} " + " UNION ALL ".join(_moments(n) for n in _NUMERIC))
def compare_distributions(spark, sf):
    return rounded(drift.compare_distributions(*halves(spark, sf)).drop("error"))


@query("drift_report_features", f"""WITH {SIDES}, {_COMPARE}, {CAT}
""" + " UNION ALL ".join(f"""SELECT '{n}' AS "column", 'numeric' AS type, (SELECT psi FROM {n}_psi) AS psi, (SELECT ks FROM {n}_ks) AS statistic, (SELECT js FROM {n}_js) AS js_divergence, (SELECT p FROM {n}_p2) AS p_value,
  (SELECT {_severity('psi', 'p')} FROM {n}_psi, {n}_p2) AS severity,
  {r(f"abs(avg({n}) FILTER (side = 1) - avg({n}) FILTER (side = 0)) / (abs(avg({n}) FILTER (side = 0)) + 1e-9) * 100", 2)} AS mean_shift_pct,
  CAST(NULL AS BIGINT) AS ref_unique FROM s""" for n in ("event_id", "user_id"))
       + f" UNION ALL SELECT 'event_type', 'categorical', {CAT_PSI}, {CAT_CHI}, NULL, NULL, NULL, NULL, count(*) FILTER (a > 0) FROM k, t")
def drift_report_features(spark, sf):
    ref, cur = (df.drop("props") for df in halves(spark, sf))
    features, _ = drift.run_drift_report(ref, cur, "value")
    numbers = F.col("type") == "numeric"  # SQL has no chi-square tail
    return rounded(features.select("column", "type", "psi", "statistic", "js_divergence", F.when(numbers, F.col("p_value")).alias("p_value"),
                                   F.when(numbers, F.col("severity")).alias("severity"), "mean_shift_pct", "ref_unique"))


@query("drift_report_summary")
def drift_report_summary(spark, sf):
    ref, cur = (df.drop("props") for df in halves(spark, sf))
    return drift.run_drift_report(ref, cur, "value")[1]


@query("null_rate_drift", """
WITH s AS (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END AS user_id,
  ts < TIMESTAMP '2024-01-15' AS ref FROM events),
p AS (SELECT 'value' AS "column", avg(CASE WHEN ref THEN (value IS NULL)::INT END) AS a, avg(CASE WHEN NOT ref THEN (value IS NULL)::INT END) AS b FROM s
  UNION ALL SELECT 'user_id', avg(CASE WHEN ref THEN (user_id IS NULL)::INT END), avg(CASE WHEN NOT ref THEN (user_id IS NULL)::INT END) FROM s)
SELECT "column", """ + f"{r('a')} AS ref_null_rate, {r('b')} AS cur_null_rate, {r('b - a')} AS change FROM p")
def null_rate_drift(spark, sf):
    df = table(spark, sf, "events").select(F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
                                           F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("user_id"), "ts")
    return rounded(drift.null_rate_drift(df.where("ts < '2024-01-15'").drop("ts"), df.where("ts >= '2024-01-15'").drop("ts")))
