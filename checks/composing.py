"""Text vectors, recipes, step logs, user functions and streaming queries."""

import uuid

from pyspark.sql import functions as F

from checks.modelling import sales
from checks.neighbouring import document_features
from checks.registry import query, r, rounded, table
from checks.sourcing import scratch
from tabloom import streaming
from tabloom.models import train as training
from tabloom.operators import text
from tabloom.plans import recipes


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


TERMS = r"""w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
v AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS documents FROM tf GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)"""


@query("top_terms", f"WITH {TERMS} SELECT * FROM v")
def top_terms(spark, sf):
    return text.top_terms(docs(spark, sf), "text", "doc_id", 50)


@query("count_vectorize", f"WITH {TERMS} SELECT doc_id, term, CAST(tf AS INT) AS n FROM tf WHERE term IN (SELECT term FROM v)")
def count_vectorize(spark, sf):
    from pyspark.ml.functions import vector_to_array

    fitted = text.fit_count_vectorize(docs(spark, sf), "text", "doc_id", 50)
    terms = F.array(*[F.lit(t) for t in fitted.state["vocabulary"]])
    out = fitted.transform(docs(spark, sf)).select("doc_id", F.posexplode(vector_to_array("text_counts")).alias("i", "n"))
    return out.where("n > 0").select("doc_id", terms[F.col("i")].alias("term"), F.col("n").cast("int"))


@query("tfidf_terms", f"""WITH {TERMS}, j AS (SELECT doc_id, term, tf, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + documents)) + 1) AS w FROM tf JOIN v USING (term))
SELECT doc_id AS key, term, tf, {r("w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))")} AS tfidf FROM j""")
def tfidf_terms(spark, sf):
    return rounded(text.tfidf_terms(docs(spark, sf), "text", "doc_id", 50, (1, 1)))


@query("tfidf_vectorize")
def tfidf_vectorize(spark, sf):
    from pyspark.ml.functions import vector_to_array

    out = text.tfidf_vectorize(docs(spark, sf), "text", "doc_id", 30, (1, 2))
    return out.select("doc_id", F.transform(vector_to_array("text_tfidf"), lambda v: F.round(v, 6)).alias("tfidf"))


@query("lsa_text")
def lsa_text(spark, sf):
    return rounded(text.lsa_text(docs(spark, sf), "text", "doc_id").drop("text"))


@query("lsa_text_shares", """SELECT true AS falling, true AS within, 20 AS components""")
def lsa_text_shares(spark, sf):
    """Facts of the default components: their energies fall, and together they hold no more than all rows do."""
    out = text.lsa_text(docs(spark, sf), "text", "doc_id")
    made = [n for n in out.columns if n.startswith("lsa_")]
    energy = out.agg(*[F.sum(F.col(n) * F.col(n)).alias(n) for n in made], F.count("*").alias("rows"))
    falling, total = F.lit(True), F.lit(0.0)
    for a, b in zip(made, made[1:]):
        falling = falling & (F.col(a) >= F.col(b) * (1 - 1e-6))
    for n in made:
        total = total + F.col(n)
    return energy.select(falling.alias("falling"), ((total > 0) & (total <= F.col("rows"))).alias("within"), F.lit(len(made)).alias("components"))


@query("lsa_text_topics", """SELECT o_orderkey, (o_custkey % 10 < 5)::INT::DOUBLE AS lsa_1, (o_custkey % 10 IN (5, 6, 7))::INT::DOUBLE AS lsa_2, (o_custkey % 10 = 8)::INT::DOUBLE AS lsa_3 FROM orders
WHERE o_custkey % 10 < 9""")
def lsa_text_topics(spark, sf):
    """A planted corpus: every text holds the two words of its topic, so the components are the topics, the largest first."""
    k = F.col("o_custkey") % 10
    words = F.when(k < 5, "north wind").when(k < 8, "south sea").otherwise("east hill")
    df = table(spark, sf, "orders").where(k < 9).select("o_orderkey", words.alias("words"))
    return rounded(text.lsa_text(df, "words", "o_orderkey", 3).drop("words"), 5)


@query("recipe_steps", """SELECT l_orderkey, l_linenumber, l_quantity AS qty, l_extendedprice, l_extendedprice * l_quantity AS total, l_quantity * l_discount AS qty_x_l_discount, l_discount
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem)""")
def recipe_steps(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    plan = recipes.Recipe([("drop_columns", {"columns": ["l_tax"]}), ("drop_duplicates", {}), ("rename_columns", {"rename": {"l_quantity": "qty"}}),
                           ("interaction_features", {"pairs": [["qty", "l_discount"]]}),
                           ("select_expressions", {"expressions": ["*", "l_extendedprice * qty AS total"]})])
    out, lineage = plan.run_with_lineage(df)
    return recipes.Recipe.replay(lineage).run(df).select(*out.columns)


@query("classification_recipe")
def classification_recipe(spark, sf):
    df = document_features(spark, sf)
    return rounded(recipes.recipe("classification", df, "toxic", ["doc_id"]).run(df))


@query("regression_recipe")
def regression_recipe(spark, sf):
    df = sales(spark, sf).drop("o_orderdate")
    return rounded(recipes.recipe("regression", df, "price", ["o_orderkey"]).run(df))


@query("text_recipe")
def text_recipe(spark, sf):
    df = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", "toxic")
    return rounded(recipes.recipe("text", df, "toxic", ["doc_id"], "text").run(df).drop("text"))


@query("merge_patches", """WITH log AS (SELECT conv_id, turn // 2 AS step, turn, turn % 2 = 1 AS patch, CASE WHEN turn % 2 = 1 THEN length(text) ELSE NULL END AS answers FROM conversations),
p AS (SELECT step, conv_id, arg_max(answers, turn) AS answers FROM log WHERE patch GROUP BY 1, 2)
SELECT conv_id * 1000 + l.step AS step, turn, CAST(p.answers AS INT) AS answers FROM log l LEFT JOIN p USING (conv_id, step) WHERE NOT patch""")
def merge_patches(spark, sf):
    log = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("step"), "turn", (F.col("turn") % 2 == 1).alias("patch"),
        F.when(F.col("turn") % 2 == 1, F.length("text")).alias("answers"))
    return recipes.merge_patches(log, "step", "patch", "answers", ["turn"])


@query("user_function_step", "SELECT c_custkey, c_acctbal, c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey) > 0 AS above FROM customer")
def user_function_step(spark, sf):
    def above_mean(df, value, group):
        means = df.groupBy(group).agg(F.avg(value).alias("_m"))
        return df.join(means, group).select("c_custkey", value, (F.col(value) - F.col("_m") > 0).alias("above"))

    recipes._functions.pop("above_mean", None)
    recipes.register_function("above_mean", above_mean)
    return recipes.Recipe([("above_mean", {"value": "c_acctbal", "group": "c_nationkey"})]).run(table(spark, sf, "customer"))


@query("user_pandas_function_step", f"SELECT event_id, {r('value * 2 + 1')} AS doubled FROM events")
def user_pandas_function_step(spark, sf):
    def doubled(df):
        def run(batches):
            for b in batches:
                yield b.assign(doubled=b["value"] * 2 + 1)[["event_id", "doubled"]]
        return df.select("event_id", "value").mapInPandas(run, "event_id long, doubled double")

    recipes._functions.pop("doubled", None)
    recipes.register_function("doubled", doubled)
    return rounded(recipes.Recipe([("doubled", {})]).run(table(spark, sf, "events")))


def event_stream(spark, sf):
    """The events file as a stream."""
    batch = table(spark, sf, "events")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def gather(spark, name):
    path = scratch(spark, name)

    def sink(df, batch_id):
        df.write.mode("append").parquet(path)

    return path, sink


_BINS = 5
_EDGES = " UNION ".join(f"SELECT quantile_cont(value, {i / _BINS}) AS e FROM ref" for i in range(_BINS + 1))


@query("drift_stream", f"""WITH ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-08'), e AS ({_EDGES}), i AS (SELECT e, row_number() OVER (ORDER BY e) AS rn, count(*) OVER () AS k FROM e),
edge AS (SELECT e FROM i WHERE rn > 1 AND rn < k), b AS (SELECT DISTINCT rn - 1 AS bin FROM i WHERE rn < k),
rc AS (SELECT (SELECT count(*) FROM edge WHERE e <= value) AS bin, count(*) AS n FROM ref GROUP BY 1),
cc AS (SELECT date_trunc('day', ts) AS d, (SELECT count(*) FROM edge WHERE e <= value) AS bin, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY 1, 2),
g AS (SELECT d, b.bin, coalesce(rc.n, 0) AS a, coalesce(cc.n, 0) AS c FROM (SELECT DISTINCT d FROM cc) CROSS JOIN b LEFT JOIN rc USING (bin) LEFT JOIN cc USING (d, bin)),
p AS (SELECT d, c, (a + 1e-6) / (sum(a) OVER w + 1e-6 * {_BINS}) AS p, (c + 1e-6) / (sum(c) OVER w + 1e-6 * {_BINS}) AS q FROM g WINDOW w AS (PARTITION BY d)),
o AS (SELECT d, CAST(sum(c) AS BIGINT) AS n, {r("sum((q - p) * ln(q / p))")} AS psi FROM p GROUP BY 1)
SELECT d AS window_start, 'value' AS "column", n, psi FROM o WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def drift_stream(spark, sf):
    """A file stream of later events against the first week; windows past the watermark are closed."""
    reference = table(spark, sf, "events").where("ts < '2024-01-08'")
    path, sink = gather(spark, "drift")
    started = streaming.drift_stream(reference, event_stream(spark, sf).where("ts >= '2024-01-08'"), "ts", "1 day", "1 hour", ["value"], _BINS, sink,
                                     scratch(spark, "drift-state"))
    started.awaitTermination()
    out = spark.read.parquet(path)
    return out.select("window_start", "column", "n", "psi")


@query("score_stream")
def score_stream(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    features = ["user_id", "event_type"]
    from tabloom.models.catalogue import REGRESSORS

    model = training.fit_one(events, "Linear Regression", REGRESSORS["Linear Regression"], "regression", "value", features, ["event_id"], None)
    path = scratch(spark, "scores")
    stream = event_stream(spark, sf).select("event_id", "user_id", "event_type")
    started = (streaming.score_stream(model, stream).writeStream.format("parquet").option("path", path)
               .option("checkpointLocation", scratch(spark, "scores-state")).trigger(availableNow=True).start())
    started.awaitTermination()
    return rounded(spark.read.parquet(path))
