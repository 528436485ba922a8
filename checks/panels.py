"""Panel, window and split queries."""

from pyspark.sql import functions as F

from checks.registry import query, r, rounded, table
from tabloom.operators import aggregate, panel


def brand_months(spark, sf):
    """Quantity per brand and month: lineitem x orders x part."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", F.last_day("o_orderdate").alias("month"))
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    joined = (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
              .join(parts, lines.l_partkey == parts.p_partkey))
    return aggregate.groupby_aggregate(joined, ["month", "p_brand"], {"l_quantity": "sum"})


BRAND_MONTHS = """
months AS (
  SELECT last_day(o_orderdate) AS month, p_brand, sum(l_quantity) AS l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2),
span AS (
  SELECT last_day(CAST(m AS DATE)) AS month FROM (SELECT unnest(generate_series(
    date_trunc('month', (SELECT min(month) FROM months)), date_trunc('month', (SELECT max(month) FROM months)), INTERVAL 1 MONTH)) AS m)),
dense AS (
  SELECT span.month, b.p_brand, coalesce(l_quantity, 0.0) AS l_quantity
  FROM (SELECT DISTINCT p_brand FROM months) b CROSS JOIN span
  LEFT JOIN months ON months.month = span.month AND months.p_brand = b.p_brand)
"""


@query("forecast_panel", f"""WITH {BRAND_MONTHS},
feat AS (SELECT month, p_brand, l_quantity,
  lag(l_quantity, 1) OVER w AS l_quantity_lag_1, lag(l_quantity, 3) OVER w AS l_quantity_lag_3,
  {r("avg(l_quantity) OVER (PARTITION BY p_brand ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")} AS l_quantity_roll_3_mean,
  lead(l_quantity, 1) OVER w AS l_quantity_lead_1
  FROM dense WINDOW w AS (PARTITION BY p_brand ORDER BY month))
SELECT * FROM feat WHERE l_quantity_lead_1 IS NOT NULL""")
def forecast_panel(spark, sf):
    from tabloom.plans.recipes import forecast_recipe

    steps = forecast_recipe("month", ["p_brand"], "l_quantity", lags=[1, 3], windows=[3], leads=[1])
    return rounded(steps.run(brand_months(spark, sf)))


@query("dense_panel", f"WITH {BRAND_MONTHS} SELECT month, p_brand, l_quantity FROM dense")
def dense_panel(spark, sf):
    return panel.dense_panel(brand_months(spark, sf), "month", ["p_brand"], "M", 0)


def order_days(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")


@query("dense_panel_weeks", """
WITH weekly AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS o_orderdate, o_orderpriority, sum(o_totalprice) AS total
  FROM orders GROUP BY 1, 2),
span AS (SELECT CAST(unnest(generate_series((SELECT min(o_orderdate) FROM weekly), (SELECT max(o_orderdate) FROM weekly), INTERVAL 7 DAY)) AS DATE) AS o_orderdate)
SELECT span.o_orderdate, g.o_orderpriority, round(coalesce(total, 0.0), 2) AS total
FROM (SELECT DISTINCT o_orderpriority FROM weekly) g CROSS JOIN span LEFT JOIN weekly USING (o_orderdate, o_orderpriority)""")
def dense_panel_weeks(spark, sf):
    weekly = (order_days(spark, sf).withColumn("o_orderdate", panel.period_end(F.col("o_orderdate"), "W"))
              .groupBy("o_orderdate", "o_orderpriority").agg(F.sum("o_totalprice").alias("total")))
    return rounded(panel.dense_panel(weekly, "o_orderdate", ["o_orderpriority"], "W", 0), 2)


@query("dense_panel_labels", """
WITH sums AS (SELECT l_linenumber, l_returnflag, l_linestatus, l_discount, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT t.l_linenumber, g.l_returnflag, g.l_linestatus, g.l_discount, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM sums) g
CROSS JOIN (SELECT DISTINCT l_linenumber FROM sums) t LEFT JOIN sums USING (l_linenumber, l_returnflag, l_linestatus, l_discount)""")
def dense_panel_labels(spark, sf):
    sums = (table(spark, sf, "lineitem").groupBy("l_linenumber", "l_returnflag", "l_linestatus", "l_discount")
            .agg(F.count("*").alias("n")))
    return panel.dense_panel(sums, "l_linenumber", ["l_returnflag", "l_linestatus", "l_discount"], fill_value=0)


@query("lag_features", """
SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate,
  lag(o_totalprice, 1) OVER w AS o_totalprice_lag_1, lag(o_totalprice, 12) OVER w AS o_totalprice_lag_12
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)""")
def lag_features(spark, sf):
    return panel.create_lag_features(order_days(spark, sf), "o_totalprice", [1, 12], ["o_orderpriority"], "o_orderdate", ["o_orderkey"])


@query("lag_features_long_series", """
SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate,
  lag(o_totalprice, 1) OVER w AS o_totalprice_lag_1, lag(o_totalprice, 12) OVER w AS o_totalprice_lag_12
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)""")
def lag_features_long_series(spark, sf):
    """The chunked plan for series too long for one task, forced by a small task size."""
    return panel.create_lag_features(order_days(spark, sf), "o_totalprice", [1, 12], ["o_orderpriority"], "o_orderdate",
                                     ["o_orderkey"], max_rows=500)


_ROLL = ", ".join(
    f"""{r(f"{fn}(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)", 4)}
    AS o_totalprice_roll_{n}_{name}""" for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max")) for n in (3, 6))


@query("rolling_features", f"SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate, {_ROLL} FROM orders")
def rolling_features(spark, sf):
    df = order_days(spark, sf)
    for agg in ("mean", "std", "max"):
        df = panel.create_rolling_features(df, "o_totalprice", [3, 6], ["o_orderpriority"], "o_orderdate", agg, ["o_orderkey"])
    return rounded(df, 4)


@query("lead_target", """
SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate,
  lead(o_totalprice, 1) OVER w AS o_totalprice_lead_1, lead(o_totalprice, 3) OVER w AS o_totalprice_lead_3
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
WHERE o_totalprice_lead_1 IS NOT NULL OR o_totalprice_lead_3 IS NOT NULL""")
def lead_target(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return panel.create_lead_target(orders, "o_totalprice", [1, 3], ["o_custkey"], "o_orderdate", ["o_orderkey"])
