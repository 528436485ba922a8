"""Date, categorical and text-cleaning encodings."""

from pyspark.sql import functions as F

from checks.cleaning import GAPPY, gappy, lines
from checks.registry import query, r, rounded, table
from tabloom.operators import dates, encode, joins, text


@query("encode_dates", """SELECT o_orderkey, o_totalprice, year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month,
  day(o_orderdate)::INT AS o_orderdate_day, (isodow(o_orderdate) - 1)::INT AS o_orderdate_dayofweek, quarter(o_orderdate)::INT AS o_orderdate_quarter,
  year(o_orderdate)::INT AS d_year, month(o_orderdate)::INT AS d_month, day(o_orderdate)::INT AS d_day,
  (isodow(o_orderdate) - 1)::INT AS d_dayofweek, quarter(o_orderdate)::INT AS d_quarter FROM orders""")
def encode_dates(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", F.date_format("o_orderdate", "M/d/yyyy").alias("d"))
    return dates.encode_dates(df)


@query("one_hot_encode", f"""WITH {GAPPY} SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_returnflag = 'A', false) AS "l_returnflag_A",
  coalesce(l_returnflag = 'N', false) AS "l_returnflag_N", coalesce(l_returnflag = 'R', false) AS "l_returnflag_R",
  coalesce(l_linestatus = 'F', false) AS "l_linestatus_F", coalesce(l_linestatus = 'O', false) AS "l_linestatus_O" FROM gappy""")
def one_hot_encode(spark, sf):
    return encode.one_hot_encode(gappy(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"))


@query("ordinal_encode", f"""WITH {GAPPY},
f AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS code FROM (SELECT DISTINCT coalesce(l_returnflag, '__nan__') AS v FROM gappy)),
s AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS code FROM (SELECT DISTINCT l_linestatus AS v FROM gappy))
SELECT l_orderkey, l_linenumber, l_partkey, f.code AS l_returnflag, s.code AS l_linestatus FROM gappy JOIN f ON coalesce(l_returnflag, '__nan__') = f.v JOIN s ON l_linestatus = s.v""")
def ordinal_encode(spark, sf):
    return encode.ordinal_encode(gappy(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"))


@query("label_encode", """
WITH f AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS INT) AS code FROM part GROUP BY 1)
SELECT p_partkey, f.code AS p_brand FROM part JOIN f USING (p_brand)""")
def label_encode(spark, sf):
    return encode.label_encode(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"])


@query("frequency_encode", f"""WITH {GAPPY}, n AS (SELECT count(l_returnflag) AS n FROM gappy),
f AS (SELECT l_returnflag, count(*) AS k FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 1)
SELECT l_orderkey, l_linenumber, gappy.l_returnflag, {r("coalesce(k / n, 0)")} AS l_returnflag_freq FROM gappy CROSS JOIN n LEFT JOIN f ON gappy.l_returnflag = f.l_returnflag""")
def frequency_encode(spark, sf):
    return rounded(encode.frequency_encode(gappy(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_returnflag"]))


@query("frequency_encode_counts", """WITH f AS (SELECT l_partkey, count(*) AS k FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, k AS l_partkey_freq FROM lineitem JOIN f USING (l_partkey)""")
def frequency_encode_counts(spark, sf):
    return encode.frequency_encode(lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey"), ["l_partkey"], normalize=False)


_TARGET = """g AS (SELECT avg(y) AS g FROM base),
f AS (SELECT k, count(y) AS n, sum(y) AS s FROM base WHERE k IS NOT NULL GROUP BY 1)"""


@query("target_encode", f"""WITH {GAPPY}, base AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS k, l_quantity AS y FROM gappy), {_TARGET}
SELECT l_orderkey, l_linenumber, l_partkey, y AS l_quantity, {r("coalesce((s + 10.0 * g) / (n + 10.0), g)")} AS l_returnflag
FROM base CROSS JOIN g LEFT JOIN f ON base.k = f.k""")
def target_encode(spark, sf):
    df = gappy(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    return rounded(encode.target_encode(df, ["l_returnflag"], "l_quantity", 10.0))


@query("target_encode_binary", f"""WITH fst AS (SELECT min_by(l_linestatus, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS v FROM lineitem),
base AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_partkey AS k, CASE WHEN l_linestatus = v THEN 0.0 ELSE 1.0 END AS y FROM lineitem, fst), {_TARGET}
SELECT l_orderkey, l_linenumber, l_linestatus, {r("coalesce((s + 5.0 * g) / (n + 5.0), g)")} AS l_partkey FROM base CROSS JOIN g LEFT JOIN f ON base.k = f.k""")
def target_encode_binary(spark, sf):
    df = lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    return rounded(encode.target_encode(df, ["l_partkey"], "l_linestatus", 5.0,
                                        order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey"))


@query("target_encode_out_of_fold", f"""
WITH base AS (SELECT o_orderkey, o_orderpriority AS k, o_totalprice AS y,
  CAST(floor(CAST('0x' || substr(md5('42|' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 * 5) AS INT) AS fold FROM orders),
g AS (SELECT avg(y) AS g FROM base), f AS (SELECT k, fold, count(y) AS n, sum(y) AS s FROM base GROUP BY 1, 2),
o AS (SELECT a.k, a.fold, (sum(b.s) - any_value(a.s) + 10.0 * any_value(g)) / (sum(b.n) - any_value(a.n) + 10.0) AS enc FROM f a JOIN f b ON a.k = b.k CROSS JOIN g GROUP BY 1, 2)
SELECT o_orderkey, y AS o_totalprice, {r("enc", 4)} AS o_orderpriority FROM base JOIN o ON base.k = o.k AND base.fold = o.fold""")
def target_encode_out_of_fold(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(encode.target_encode(df, ["o_orderpriority"], "o_totalprice", 10.0, folds=5, key=["o_orderkey"]), 4)


@query("hash_encode")
def hash_encode(spark, sf):
    return encode.hash_encode(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name"], 16, expand=True)


@query("lookup_join_skewed_keys", """WITH f AS (SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) + 0.0 AS mean_qty FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_suppkey, mean_qty FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey FROM lineitem) LEFT JOIN f USING (l_suppkey)""")
def lookup_join_skewed_keys(spark, sf):
    """The shuffled plan with hot keys broadcast, forced by a broadcast limit of 10 rows."""
    stats = lines(spark, sf).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean_qty"))
    df = lines(spark, sf).select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_suppkey")).alias("l_suppkey"))
    return rounded(joins.lookup_join(df, stats, ["l_suppkey"], "n", broadcast_rows=10))


@query("left_join", "SELECT c_custkey, c_name, c_nationkey AS nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2")
def left_join(spark, sf):
    nations = table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("nationkey"))
    return joins.left_join(customers, nations, ["nationkey"])


@query("pooled_union", """SELECT event_id, value, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'reference' ELSE 'current' END AS side FROM events""")
def pooled_union(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", "ts")
    return joins.pooled_union(df.where("ts < '2024-01-15'").drop("ts"), df.where("ts >= '2024-01-15'").drop("ts"))


@query("category_union", """SELECT event_type AS category, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS ref_count,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS cur_count FROM events GROUP BY 1""")
def category_union(spark, sf):
    df = table(spark, sf, "events")
    return joins.category_union(df.where("ts < '2024-01-15'"), df.where("ts >= '2024-01-15'"), "event_type")


@query("shared_columns", "SELECT s_suppkey AS key, s_nationkey AS nation FROM supplier")
def shared_columns(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), "s_name", F.col("s_nationkey").alias("nation"))
    b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("key"))
    return a.select(*joins.shared_columns(a, b))


@query("slugify", "SELECT url, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM pages")
def slugify(spark, sf):
    return table(spark, sf, "pages").select("url", text.slugify(F.col("url")).alias("slug"))


_TEXT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gsi'), '<[^>]+>', ' ', 'g'), '&#?[\p{L}\p{M}\p{N}_]+;', ' ', 'g'),
 '\s+', ' ', 'g'))"""


@query("html_to_text", f"""SELECT page_id, t AS content, false AS truncated, CAST(length(t) AS INT) AS chars_returned
FROM (SELECT page_id, {_TEXT} AS t FROM pages)""")
def html_to_text(spark, sf):
    return text.html_to_text(table(spark, sf, "pages").select("page_id", "html"), "html").drop("html")
