"""Neighbour join, resampling, isolation forest and selection queries."""

from pyspark.sql import functions as F

from checks.registry import query, r, rounded, table
from tabloom.operators import impute, neighbours, resample


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


_DIST = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("knn_join", f"""SELECT left_id, right_id, rank::INT AS rank, {r("d")} AS distance FROM (
  SELECT a.vec_id AS left_id, b.vec_id AS right_id, {_DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5""")
def knn_join(spark, sf):
    v = vectors(spark, sf)
    return rounded(neighbours.knn_join(v, v, 5, "embedding", "vec_id", "vec_id", exclude_same=True))


@query("knn_join_within_class", f"""SELECT left_id, right_id, rank::INT AS rank, {r("d")} AS distance FROM (
  SELECT a.vec_id AS left_id, b.vec_id AS right_id, {_DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label) WHERE rank <= 3""")
def knn_join_within_class(spark, sf):
    v = vectors(spark, sf)
    return rounded(neighbours.knn_join(v, v, 3, "embedding", "vec_id", "vec_id", within="label", exclude_same=True, block=50))


@query("knn_join_many_groups", f"""SELECT left_id, right_id, rank::INT AS rank, {r("d", 4)} AS distance FROM (
  SELECT a.o_orderkey AS left_id, b.o_orderkey AS right_id, abs(a.o_totalprice - b.o_totalprice) AS d, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(a.o_totalprice - b.o_totalprice), b.o_orderkey) AS rank
  FROM orders a JOIN orders b ON a.o_orderkey <> b.o_orderkey AND a.o_custkey = b.o_custkey) WHERE rank <= 3""")
def knn_join_many_groups(spark, sf):
    """A group per customer."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rounded(neighbours.knn_join(o, o, 3, ["o_totalprice"], "o_orderkey", "o_orderkey", within="o_custkey", exclude_same=True), 4)


@query("knn_join_customers", f"""WITH p AS (SELECT c_custkey, c_acctbal / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer),
q AS (SELECT s_suppkey, s_acctbal / 1000 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier)
SELECT left_id, right_id, rank::INT AS rank, {r("d")} AS distance FROM (
  SELECT q.s_suppkey AS left_id, p.c_custkey AS right_id, sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) AS d,
    row_number() OVER (PARTITION BY q.s_suppkey ORDER BY pow(q.x - p.x, 2) + pow(q.y - p.y, 2), p.c_custkey) AS rank FROM q CROSS JOIN p) WHERE rank <= 5""")
def knn_join_customers(spark, sf):
    p = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    q = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return rounded(neighbours.knn_join(q, p, 5, ["x", "y"], "s_suppkey", "c_custkey", block=100))


@query("lsh_knn_join")
def lsh_knn_join(spark, sf):
    v = vectors(spark, sf)
    return rounded(neighbours.lsh_knn_join(v, v, 6, "embedding", "vec_id", "vec_id", 3.0, 0.5))


GAPS = """g AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal / 1000 END AS a, CASE WHEN c_custkey % 12 = 1 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS b,
  CAST(c_custkey % 101 AS DOUBLE) AS c FROM customer)"""


@query("knn_impute", f"""WITH {GAPS},
d AS (SELECT x.c_custkey AS k, y.c_custkey AS o, y.a, y.b, sqrt(3.0 / (((x.a IS NOT NULL AND y.a IS NOT NULL)::INT + (x.b IS NOT NULL AND y.b IS NOT NULL)::INT + 1))
   * (coalesce(pow(x.a - y.a, 2), 0) + coalesce(pow(x.b - y.b, 2), 0) + pow(x.c - y.c, 2))) AS dist FROM g x CROSS JOIN g y WHERE x.a IS NULL OR x.b IS NULL),
fa AS (SELECT k, avg(a) AS v FROM (SELECT k, a, row_number() OVER (PARTITION BY k ORDER BY dist, o) AS rn FROM d WHERE a IS NOT NULL) WHERE rn <= 5 GROUP BY 1),
fb AS (SELECT k, avg(b) AS v FROM (SELECT k, b, row_number() OVER (PARTITION BY k ORDER BY dist, o) AS rn FROM d WHERE b IS NOT NULL) WHERE rn <= 5 GROUP BY 1)
SELECT c_custkey, {r("coalesce(a, fa.v)")} AS a, {r("coalesce(b, fb.v)")} AS b, c FROM g LEFT JOIN fa ON fa.k = c_custkey LEFT JOIN fb ON fb.k = c_custkey""")
def knn_impute(spark, sf):
    k = F.col("c_custkey")
    df = table(spark, sf, "customer").select(k, F.when(k % 9 != 0, F.col("c_acctbal") / 1000).alias("a"),
                                             F.when(k % 12 != 1, F.col("c_nationkey").cast("double")).alias("b"), (k % 101).cast("double").alias("c"))
    return rounded(impute.knn_impute(df, 5, ["a", "b", "c"], key="c_custkey"))


EIGHT = """g AS (SELECT c_custkey, CASE WHEN c_custkey % 2 <> 0 THEN c_acctbal / 1000 END AS a, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey::DOUBLE END AS b,
CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 37 % 101)::DOUBLE END AS c FROM customer),
s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM g),
d AS (SELECT x.c_custkey AS k, y.c_custkey AS o, y.a, y.b, y.c, (coalesce(pow(x.a - y.a, 2), 0) + coalesce(pow(x.b - y.b, 2), 0) + coalesce(pow(x.c - y.c, 2), 0))
  * 3.0 / ((x.a IS NOT NULL AND y.a IS NOT NULL)::INT + (x.b IS NOT NULL AND y.b IS NOT NULL)::INT + (x.c IS NOT NULL AND y.c IS NOT NULL)::INT) AS dist FROM g x CROSS JOIN g y
  WHERE (x.a IS NULL OR x.b IS NULL OR x.c IS NULL) AND (x.a IS NOT NULL AND y.a IS NOT NULL OR x.b IS NOT NULL AND y.b IS NOT NULL OR x.c IS NOT NULL AND y.c IS NOT NULL))"""
EIGHT_FILLS = ", ".join(f"f{n} AS (SELECT k, avg({n}) AS v FROM (SELECT k, {n}, row_number() OVER (PARTITION BY k ORDER BY dist, o) AS rn FROM d WHERE {n} IS NOT NULL) WHERE rn <= 5 GROUP BY 1)" for n in "abc")


@query("knn_impute_patterns", f"""WITH {EIGHT}, {EIGHT_FILLS}
SELECT c_custkey, {r("coalesce(a, fa.v, ma)")} AS a, {r("coalesce(b, fb.v, mb)")} AS b, {r("coalesce(c, fc.v, mc)")} AS c FROM g CROSS JOIN s LEFT JOIN fa ON fa.k = c_custkey
LEFT JOIN fb ON fb.k = c_custkey LEFT JOIN fc ON fc.k = c_custkey""")
def knn_impute_patterns(spark, sf):
    """Three columns with all eight patterns of gaps, rows without any value included."""
    k = F.col("c_custkey")
    df = table(spark, sf, "customer").select(k, F.when(k % 2 != 0, F.col("c_acctbal") / 1000).alias("a"), F.when(k % 3 != 0, F.col("c_nationkey").cast("double")).alias("b"),
                                             F.when(k % 5 != 0, (k * 37 % 101).cast("double")).alias("c"))
    return rounded(impute.knn_impute(df, 5, ["a", "b", "c"], key="c_custkey"))


@query("random_undersample", """SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('42|' || doc_id), doc_id) AS rn FROM labels)
WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))""")
def random_undersample(spark, sf):
    return resample.random_undersample(table(spark, sf, "labels"), "toxic", ["doc_id"])


@query("random_oversample", """WITH n AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), m AS (SELECT max(n) AS m FROM n),
k AS (SELECT l.*, row_number() OVER (PARTITION BY l.toxic ORDER BY md5('42|' || doc_id), doc_id) AS rn, n, m FROM labels l JOIN n USING (toxic), m)
SELECT doc_id, quality, toxic FROM (SELECT *, unnest(range(CAST(m // n + CASE WHEN rn <= m % n THEN 1 ELSE 0 END AS BIGINT))) FROM k)""")
def random_oversample(spark, sf):
    return resample.random_oversample(table(spark, sf, "labels"), "toxic", ["doc_id"])


def document_features(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                                                F.size(F.split("text", " ")).cast("double").alias("words"), "lang")
    return table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", "n_chars", "words", "lang", "toxic")


BALANCED = """WITH l AS (SELECT toxic FROM labels JOIN documents USING (doc_id)), n AS (SELECT toxic, count(*) AS n FROM l GROUP BY 1)
SELECT toxic, (SELECT max(n) FROM n) AS n FROM n"""


@query("smote_class_counts", BALANCED)
def smote_class_counts(spark, sf):
    return resample.smote(document_features(spark, sf), "toxic", ["doc_id"]).groupBy("toxic").agg(F.count("*").alias("n"))


@query("smote")
def smote(spark, sf):
    return rounded(resample.smote(document_features(spark, sf).drop("lang"), "toxic", ["doc_id"]))


@query("borderline_smote")
def borderline_smote(spark, sf):
    return rounded(resample.borderline_smote(document_features(spark, sf).drop("lang"), "toxic", ["doc_id"]))


@query("adasyn")
def adasyn(spark, sf):
    return rounded(resample.adasyn(document_features(spark, sf).drop("lang"), "toxic", ["doc_id"]))


@query("smote_tomek")
def smote_tomek(spark, sf):
    return rounded(resample.smote_tomek(document_features(spark, sf).drop("lang"), "toxic", ["doc_id"]))


@query("smote_enn")
def smote_enn(spark, sf):
    return rounded(resample.smote_enn(document_features(spark, sf).drop("lang"), "toxic", ["doc_id"]))
