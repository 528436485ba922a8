"""Exploratory statistics, chart data and hypothesis tests."""

from pyspark.sql import Window, functions as F

from checks.cleaning import GAPPY, gappy, lines
from checks.registry import query, r, rounded, table
from tabloom.operators import describe, hypothesis, text

NUMS = ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")


def gappy_numbers(spark, sf):
    return gappy(spark, sf).select(*NUMS)


@query("correlation_matrix", f"WITH {GAPPY} " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f'corr({a}, {b})') if a != b else '1.0'} AS r FROM {'gappy' if a != b else '(SELECT 1)'}" for a in NUMS for b in NUMS))
def correlation_matrix(spark, sf):
    return rounded(describe.correlation_matrix(gappy_numbers(spark, sf)))


@query("target_correlation", f"WITH {GAPPY}, c AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", corr({n}, l_extendedprice) AS r FROM gappy" for n in NUMS if n != "l_extendedprice") + f""")
SELECT CAST(row_number() OVER (ORDER BY abs(r) DESC) AS INT) AS rank, "column", {r("r")} AS r, r > 0 AS top_positive, r < 0 AS top_negative FROM c""")
def target_correlation(spark, sf):
    return rounded(describe.target_correlation(gappy_numbers(spark, sf), "l_extendedprice"))


@query("correlation_significance", f"WITH {GAPPY} " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f'corr({a}, {b})')} AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM gappy"
    for i, a in enumerate(NUMS) for b in NUMS[i + 1:]))
def correlation_significance(spark, sf):
    return rounded(describe.correlation_significance(gappy_numbers(spark, sf)).drop("p"))


def _mi(n):
    edges = " UNION ".join(f"SELECT quantile_cont({n}, {i / 10}) AS e FROM lineitem" for i in range(11))
    return f"""(WITH e AS ({edges}), b AS (SELECT l_returnflag AS y, (SELECT count(*) FROM e WHERE e < {n} AND e > (SELECT min(e) FROM e)) AS x FROM lineitem),
  k AS (SELECT x, y, count(*) AS n FROM b GROUP BY 1, 2),
  p AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM k)
  SELECT '{n}' AS feature, {r("greatest(0, sum(n / t * ln(n * t / (nx * ny))))")} AS mutual_information FROM p)"""


@query("mutual_information", " UNION ALL ".join(_mi(n) for n in ("l_quantity", "l_discount", "l_linenumber")))
def mutual_information(spark, sf):
    df = lines(spark, sf).select("l_quantity", "l_discount", "l_linenumber", "l_returnflag")
    return rounded(describe.mutual_information(df, "l_returnflag"))


@query("normality_test", f"""WITH v AS (SELECT l_quantity AS x FROM lineitem), m AS (SELECT avg(x) AS m FROM v),
c AS (SELECT count(*) AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4 FROM v, m)
SELECT 'l_quantity' AS "column", n, {r("(SELECT avg(x) FROM v)")} AS mean, {r("(SELECT stddev_samp(x) FROM v)")} AS std,
  {r("m3 / pow(m2, 1.5)")} AS skewness, {r("m4 / (m2 * m2) - 3")} AS kurtosis FROM c""")
def normality_test(spark, sf):
    out = describe.normality_test(lines(spark, sf), "l_quantity", key=["l_orderkey", "l_linenumber", "l_partkey"])
    return rounded(out.select("column", "n", "mean", "std", "skewness", "kurtosis"))


@query("vif", """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT 'l_quantity' AS "column", round(1 / (1 - r * r), 2) AS vif, 1 / (1 - r * r) > 10 AS high FROM r
UNION ALL SELECT 'l_extendedprice', round(1 / (1 - r * r), 2), 1 / (1 - r * r) > 10 FROM r""")
def vif(spark, sf):
    return describe.vif(lines(spark, sf), ["l_quantity", "l_extendedprice"])


@query("value_counts", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def value_counts(spark, sf):
    return describe.value_counts(table(spark, sf, "part"), "p_brand")


@query("histogram", f"""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
k AS (SELECT least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 30) AS INT) + 1, 30) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
SELECT CAST(g.bin AS INT) AS bin, {r("lo + (g.bin - 1) * (hi - lo) / 30", 4)} AS low, {r("lo + g.bin * (hi - lo) / 30", 4)} AS high, coalesce(n, 0) AS count
FROM range(1, 31) g(bin) CROSS JOIN s LEFT JOIN k ON k.bin = g.bin""")
def histogram(spark, sf):
    return rounded(describe.histogram(lines(spark, sf), "l_extendedprice", 30), 4)


@query("scatter_sample", """SELECT o_custkey, o_totalprice, o_orderpriority FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 2000""")
def scatter_sample(spark, sf):
    return describe.scatter_sample(table(spark, sf, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"], 2_000, "o_orderpriority")


@query("pairplot_sample", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 2000""")
def pairplot_sample(spark, sf):
    return describe.pairplot_sample(table(spark, sf, "orders"), ["o_orderkey"], ["o_orderkey", "o_custkey", "o_totalprice"], 2_000)


_BOX = f"""WITH q AS (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.5) q2, quantile_cont(l_extendedprice, 0.75) q3 FROM lineitem GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT l_returnflag, count(*) AS n, {r("any_value(q1)")} AS q1, {r("any_value(q2)")} AS median, {r("any_value(q3)")} AS q3, {r("any_value(lo)")} AS lower_fence,
  {r("any_value(hi)")} AS upper_fence, min(l_extendedprice) FILTER (l_extendedprice BETWEEN lo AND hi) AS whisker_low,
  max(l_extendedprice) FILTER (l_extendedprice BETWEEN lo AND hi) AS whisker_high, count(*) FILTER (NOT l_extendedprice BETWEEN lo AND hi) AS outliers
FROM lineitem JOIN f ON l_returnflag = g GROUP BY 1"""


@query("box_stats", _BOX)
def box_stats(spark, sf):
    return rounded(describe.box_stats(lines(spark, sf), "l_extendedprice", "l_returnflag"))


@query("grouped_quantiles_bucketed", f"""SELECT l_returnflag, count(*) AS n, {r("quantile_cont(l_extendedprice, 0.1)", 4)} AS q10, {r("quantile_cont(l_extendedprice, 0.5)", 4)} AS q50,
  {r("quantile_cont(l_extendedprice, 0.9)", 4)} AS q90 FROM lineitem GROUP BY 1""")
def grouped_quantiles_bucketed(spark, sf):
    """Grouped quantiles by prefix sums, the plan for groups too large for one buffer."""
    from tabloom.operators.quantiles import grouped_quantiles

    found = grouped_quantiles(lines(spark, sf), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9], direct_rows=100)
    return rounded(found.select("l_returnflag", "n", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((10, 50, 90))]), 4)


@query("violin_density", f"""WITH e AS (SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high, (max(l_extendedprice) - min(l_extendedprice)) / 64 AS width FROM lineitem),
m AS (SELECT l_returnflag, count(l_extendedprice) AS total, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1),
k AS (SELECT l_returnflag, least(floor((l_extendedprice - low) / (high - low) * 64), 63) AS b, count(*) AS n FROM lineitem, e GROUP BY 1, 2),
w AS (SELECT l_returnflag, total, greatest(coalesce(sd, 0) * pow(total, -0.2), width / 2) AS band FROM m, e)
SELECT k.l_returnflag, {r("any_value(low) + (g.spot + 0.5) * any_value(width)", 4)} AS x, {r("sum(n * exp(-0.5 * pow((g.spot - b) * width / band, 2)) / (band * sqrt(2 * pi()) * total))", 9)} AS density
FROM k JOIN w ON k.l_returnflag = w.l_returnflag, e, range(64) g(spot) GROUP BY k.l_returnflag, g.spot""")
def violin_density(spark, sf):
    out = describe.violin_density(lines(spark, sf), "l_extendedprice", "l_returnflag")
    return out.select("l_returnflag", (F.round("x", 4) + 0.0).alias("x"), (F.round("density", 9) + 0.0).alias("density"))


@query("missing_pattern", f"""WITH {GAPPY} SELECT '0000' || (l_quantity IS NULL)::INT || (l_extendedprice IS NULL)::INT || (l_discount IS NULL)::INT || (l_returnflag IS NULL)::INT || '0' AS pattern,
  count(*) AS rows FROM gappy GROUP BY 1""")
def missing_pattern(spark, sf):
    return describe.missing_pattern(gappy(spark, sf))


@query("missing_mask", f"""WITH {GAPPY} SELECT l_orderkey IS NULL AS l_orderkey, l_quantity IS NULL AS l_quantity, l_returnflag IS NULL AS l_returnflag
  FROM gappy ORDER BY gappy.l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100""")
def missing_mask(spark, sf):
    out = describe.missing_mask(gappy(spark, sf), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 100)
    return out.select("l_orderkey", "l_quantity", "l_returnflag")


@query("line_series", f"""WITH t AS (SELECT o_orderdate, {r("sum(o_totalprice)", 2)} AS total FROM orders GROUP BY 1) SELECT * FROM t""")
def line_series(spark, sf):
    daily = table(spark, sf, "orders").groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("total"))
    return rounded(describe.line_series(daily, "o_orderdate", ["total"]), 2)


@query("line_series_sliced", f"""WITH e AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)
SELECT min(ts) AS ts, {r("avg(value)")} AS value FROM events, e GROUP BY least(floor((epoch_us(ts) - lo) / ((hi - lo) / 500)), 499)""")
def line_series_sliced(spark, sf):
    return rounded(describe.line_series(table(spark, sf, "events"), "ts", ["value"], slices=500))


@query("qq_points")
def qq_points(spark, sf):
    return rounded(describe.qq_points(lines(spark, sf), "l_extendedprice"))


@query("leakage_scan", """SELECT 'o_totalprice_score' AS "column", 'target_proxy' AS rule UNION ALL SELECT 'o_totalprice_score', 'semantic_name' UNION ALL
SELECT 'o_orderkey', 'identifier' FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderkey) / count(*) > 0.95 UNION ALL
SELECT 'o_custkey', 'identifier' FROM orders GROUP BY ALL HAVING count(DISTINCT o_custkey) / count(*) > 0.95 UNION ALL
SELECT 'final_status', 'future_name'""")
def leakage_scan(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (F.col("o_totalprice") * 2 + 1).alias("o_totalprice_score"),
                                           F.col("o_orderstatus").alias("final_status"))
    return describe.leakage_scan(df, "o_totalprice").select("column", "rule")


@query("leakage_identifiers", """WITH b AS MATERIALIZED (SELECT o_orderkey AS ascending, -o_orderkey AS descending, CAST((o_orderkey * 7919) % 1000003 AS BIGINT) AS shuffled,
  regexp_replace(md5(CAST(o_orderkey AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS ref, o_totalprice + o_orderkey * 20 AS amount FROM orders),
u AS (SELECT k, count(DISTINCT v) AS d, count(v) AS n FROM (UNPIVOT (SELECT CAST(ascending AS VARCHAR) AS ascending, CAST(descending AS VARCHAR) AS descending, CAST(shuffled AS VARCHAR) AS shuffled, ref FROM b)
  ON COLUMNS(*) INTO NAME k VALUE v) GROUP BY k),
s AS (SELECT ascending > lag(ascending) OVER w AS a, descending < lag(descending) OVER w AS d, shuffled > lag(shuffled) OVER w AS u, shuffled < lag(shuffled) OVER w AS v, ref > lag(ref) OVER w AS x, ref < lag(ref) OVER w AS y FROM b WINDOW w AS (ORDER BY ascending)),
t AS (SELECT sum(a::INT) AS a, sum(d::INT) AS d, sum(u::INT) AS u, sum(v::INT) AS v, sum(x::INT) AS x, sum(y::INT) AS y, count(*) - 1 AS n FROM s),
q AS (SELECT list_transform(quantile_cont(ascending::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda z: z) AS qa, quantile_cont(shuffled::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS qs FROM b),
m AS (SELECT 'ascending' AS k, len(list_filter(qa, lambda z: z < ascending)) AS g, avg(amount) AS m FROM b, q GROUP BY ALL UNION ALL SELECT 'shuffled', len(list_filter(qs, lambda z: z < shuffled)), avg(amount) FROM b, q GROUP BY ALL),
w AS (SELECT k, sum((m > p)::INT) AS up, sum((m < p)::INT) AS down FROM (SELECT k, m, lag(m) OVER (PARTITION BY k ORDER BY g) AS p FROM m) GROUP BY k),
c AS (SELECT 'ascending' AS k, corr(ascending, amount) AS r FROM b UNION ALL SELECT 'descending', corr(descending, amount) FROM b UNION ALL SELECT 'shuffled', corr(shuffled, amount) FROM b)
SELECT k AS "column", 'identifier' AS rule, format('{} of {} distinct', d, n) AS evidence FROM u WHERE d / n > 0.95
UNION ALL SELECT k, 'target_proxy', 'r=' || format('{:.4f}', r) FROM c WHERE abs(r) > 0.95
UNION ALL SELECT 'ref', 'uuid_identifier', format('{} of {} like a UUID', count_if(regexp_full_match(ref, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}')), count(*)) FROM b
UNION ALL SELECT k, 'identifier_trend', 'mean of the target rises over 10 stretches' FROM w WHERE up = 9 UNION ALL SELECT k, 'identifier_trend', 'mean of the target falls over 10 stretches' FROM w WHERE down = 9
UNION ALL SELECT 'descending', 'identifier_trend', 'mean of the target falls over 10 stretches' FROM w WHERE k = 'ascending' AND up = 9
UNION ALL SELECT 'ascending', 'monotone_identifier', format('rises in {} of {} steps', a, n) FROM t WHERE a / n >= 0.99 UNION ALL SELECT 'descending', 'monotone_identifier', format('falls in {} of {} steps', d, n) FROM t WHERE d / n >= 0.99
UNION ALL SELECT 'shuffled', 'monotone_identifier', format('rises in {} of {} steps', u, n) FROM t WHERE u / n >= 0.99 UNION ALL SELECT 'shuffled', 'monotone_identifier', format('falls in {} of {} steps', v, n) FROM t WHERE v / n >= 0.99
UNION ALL SELECT 'ref', 'monotone_identifier', format('rises in {} of {} steps', x, n) FROM t WHERE x / n >= 0.99 UNION ALL SELECT 'ref', 'monotone_identifier', format('falls in {} of {} steps', y, n) FROM t WHERE y / n >= 0.99""")
def leakage_identifiers(spark, sf):
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(k.alias("ascending"), (-k).alias("descending"), ((k * 7919) % 1000003).alias("shuffled"),
                                           F.regexp_replace(F.md5(k.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5").alias("ref"),
                                           (F.col("o_totalprice") + k * 20).alias("amount"))
    return describe.leakage_scan(df, "amount", order_by=["ascending"])


@query("quality_recommendations", f"""WITH {GAPPY}, b AS (SELECT l_discount, l_returnflag, l_quantity, pow(l_quantity, 4) AS steep, 1 AS one FROM gappy),
m AS (SELECT avg(steep) AS m FROM b), s AS (SELECT avg(pow(steep - m, 3)) / pow(avg(pow(steep - m, 2)), 1.5) AS skew FROM b, m),
miss AS (SELECT 'l_discount' AS "column", avg((l_discount IS NULL)::INT) AS share FROM b UNION ALL SELECT 'l_returnflag', avg((l_returnflag IS NULL)::INT) FROM b
  UNION ALL SELECT 'l_quantity', avg((l_quantity IS NULL)::INT) FROM b UNION ALL SELECT 'steep', avg((steep IS NULL)::INT) FROM b)
SELECT "column", CASE WHEN share > 0.5 THEN 'missing > 50 %' WHEN share >= 0.05 THEN 'missing 5-50 %' ELSE 'missing < 5 %' END AS finding,
  CASE WHEN share > 0.5 THEN 'drop_high_missing' WHEN share >= 0.05 THEN 'knn_impute + add_missing_indicators' ELSE 'impute_missing' END AS operator FROM miss WHERE share > 0
UNION ALL SELECT 'one', 'constant', 'drop_constant'
UNION ALL SELECT 'steep', 'skewness > 1.5', 'log_transform' FROM s WHERE skew > 1.5
UNION ALL SELECT 'l_returnflag', 'cardinality < 5', 'one_hot_encode'""")
def quality_recommendations(spark, sf):
    q = F.col("l_quantity")
    df = gappy(spark, sf).select("l_discount", "l_returnflag", "l_quantity", (q * q * q * q).alias("steep"), F.lit(1).alias("one"))
    return describe.quality_recommendations(df)


@query("quality_recommendations_series", """SELECT 'running' AS "column", 'ADF p > 0.05' AS finding, 'differencing, forecast_ar with d = 1' AS operator""")
def quality_recommendations_series(spark, sf):
    """A running total of random steps has a unit root, the amounts of the days have none."""
    daily = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("amount"))
    step = F.conv(F.substring(F.md5(F.col("day").cast("string")), 1, 8), 16, 10).cast("double") / 2.0 ** 32 - 0.5
    df = daily.select("day", "amount", F.sum(step).over(Window.orderBy("day")).alias("running"))  # a row per day
    found = describe.quality_recommendations(df, order_by=["day"])
    return found.where(F.col("finding").startswith("ADF"))


@query("ttest", f"""WITH g AS (SELECT l_linestatus, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1),
a AS (SELECT * FROM g ORDER BY l_linestatus LIMIT 1), b AS (SELECT * FROM g ORDER BY l_linestatus DESC LIMIT 1)
SELECT 'independent' AS test, {r("(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n))")} AS statistic, CAST(a.n + b.n - 2 AS DOUBLE) AS dof FROM a, b""")
def ttest(spark, sf):
    return rounded(hypothesis.ttest(lines(spark, sf), "l_quantity", "l_linestatus").select("test", "statistic", "dof"))


@query("ttest_paired", f"""SELECT 'paired' AS test, {r("avg(d) / (stddev_samp(d) / sqrt(count(d)))")} AS statistic, CAST(count(d) - 1 AS DOUBLE) AS dof FROM (SELECT l_discount - l_tax AS d FROM lineitem)""")
def ttest_paired(spark, sf):
    return rounded(hypothesis.ttest(lines(spark, sf), "l_discount", paired="l_tax").select("test", "statistic", "dof"))


@query("anova", f"""WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m, var_samp(p_retailprice) AS v FROM part GROUP BY 1),
t AS (SELECT avg(p_retailprice) AS gm, count(*) AS n FROM part)
SELECT 'p_retailprice' AS "column", {r("(sum(g.n * pow(m - gm, 2)) / (count(*) - 1)) / (sum((g.n - 1) * v) / (any_value(t.n) - count(*)))")} AS statistic FROM g, t""")
def anova(spark, sf):
    return rounded(hypothesis.anova(table(spark, sf, "part"), "p_retailprice", "p_brand").select("column", "statistic"))


RANKS = """rk AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS mr, count(*) OVER (PARTITION BY v) AS t FROM src)"""


@query("mannwhitney", f"""WITH src AS (SELECT l_linestatus AS g, l_quantity AS v FROM lineitem), {RANKS}
SELECT {r("sum(mr) FILTER (g = 'F') - count(*) FILTER (g = 'F') * (count(*) FILTER (g = 'F') + 1) / 2", 1)} AS statistic, count(*) FILTER (g = 'F') AS n1, count(*) FILTER (g <> 'F') AS n2 FROM rk""")
def mannwhitney(spark, sf):
    return rounded(hypothesis.mannwhitney(lines(spark, sf), "l_quantity", "l_linestatus").select("statistic", "n1", "n2"), 1)


@query("kruskal_wallis", f"""WITH src AS (SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem), {RANKS},
s AS (SELECT g, sum(mr) AS rs, count(*) AS k FROM rk GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM rk)
SELECT {r("(12 / (any_value(n) * (any_value(n) + 1)) * sum(rs * rs / k) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (pow(any_value(n), 3) - any_value(n)))")} AS statistic, count(*) - 1 AS dof FROM s, n""")
def kruskal_wallis(spark, sf):
    return rounded(hypothesis.kruskal_wallis(lines(spark, sf), "l_extendedprice", "l_returnflag", rows_per_bucket=5000).select("statistic", "dof"))


_CHI = """k AS (SELECT a, b, count(*) AS k FROM src GROUP BY 1, 2), ra AS (SELECT a, sum(k) AS ra FROM k GROUP BY 1), cb AS (SELECT b, sum(k) AS cb FROM k GROUP BY 1),
e AS (SELECT coalesce(k, 0) AS o, ra * cb / (SELECT sum(k) FROM k) AS e FROM ra CROSS JOIN cb LEFT JOIN k USING (a, b))"""


@query("chi2_test", f"""WITH src AS (SELECT p_brand AS a, p_type AS b FROM part), {_CHI}
SELECT {r("sum(pow(o - e, 2) / e)", 4)} AS statistic, (SELECT count(*) - 1 FROM ra) * (SELECT count(*) - 1 FROM cb) AS dof FROM e""")
def chi2_test(spark, sf):
    return rounded(hypothesis.chi2_test(table(spark, sf, "part"), "p_brand", "p_type").select("statistic", "dof"), 4)


@query("chi2_test_yates", f"""WITH src AS (SELECT quality AS a, toxic AS b FROM labels), {_CHI}
SELECT {r("sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e)", 4)} AS statistic FROM e""")
def chi2_test_yates(spark, sf):
    return rounded(hypothesis.chi2_test(table(spark, sf, "labels"), "quality", "toxic").select("statistic"), 4)


@query("text_clean", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[\p{P}\p{N}]+', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM documents""")
def text_clean(spark, sf):
    return text.text_clean(table(spark, sf, "documents").select("doc_id", "text"), ["text"])


@query("text_length_features", rf"""WITH d AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, text, t, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n FROM d)
SELECT doc_id, CAST(length(text) AS INT) AS text_char_count, CAST(n AS INT) AS text_word_count,
  {r("CASE WHEN n > 0 THEN (length(t) - greatest(n - 1, 0)) / n ELSE 0 END")} AS text_mean_word_length FROM w""")
def text_length_features(spark, sf):
    return rounded(text.text_length_features(table(spark, sf, "documents").select("doc_id", "text"), ["text"]).drop("text"))
