"""Models, selections and transforms on columns planted so that SQL knows the answer."""

from pyspark.sql import functions as F

from checks.cleaning import gappy, lines
from checks.modelling import fit_all
from checks.registry import query, r, rounded, table
from checks.sourcing import scratch
from checks.splitting import MONTHLY, monthly
from tabloom.models import evaluate, runs, train as training
from tabloom.operators import encode, scale, selection, series

CLASSIFIERS = ("Logistic Regression", "SGD Classifier", "Linear SVC", "Gaussian Naive Bayes", "Linear Discriminant Analysis", "Quadratic Discriminant Analysis",
               "Decision Tree", "Extra Trees", "Random Forest", "AdaBoost", "Gradient Boosting", "Hist Gradient Boosting", "K-Nearest Neighbors", "SVC (RBF)", "MLP", "Bagging")
STEPPED = ("Decision Tree", "Extra Trees", "Random Forest", "AdaBoost", "Gradient Boosting", "Hist Gradient Boosting", "K-Nearest Neighbors", "Bagging")
STRAIGHT = ("Linear Regression", "Ridge", "Bayesian Ridge", "Huber Regressor")


def customers(spark, sf):
    """A column that parts two classes with a wide gap, and one that does not."""
    far = F.when(F.col("c_nationkey") < 12, 0).otherwise(60)
    return table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000 + far).alias("x"), (F.col("c_custkey") % 17).cast("double").alias("noise"),
                                               F.when(F.col("c_nationkey") < 12, "near").otherwise("far").alias("y"))


TRUE_CLASSES = "SELECT CASE WHEN c_nationkey < 12 THEN 'near' ELSE 'far' END AS y, count(*) AS n FROM customer GROUP BY 1"


@query("planted_classes", f"SELECT m.model, t.y, t.y AS prediction, t.n FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in CLASSIFIERS)}) m(model), ({TRUE_CLASSES}) t")
def planted_classes(spark, sf):
    """Every classifier, at its own settings, finds every row's class where one column tells it."""
    df = customers(spark, sf).cache()
    classes = training.class_names(df, "y")
    out = None
    for name in CLASSIFIERS:
        model = fit_all(df, "y", name, ["c_custkey"], "classification", classes)
        named = model.raw(df).select("y", F.array(*map(F.lit, classes))[F.col("prediction").cast("int")].alias("prediction"))
        found = named.groupBy("y", "prediction").agg(F.count("*").alias("n")).select(F.lit(name).alias("model"), "y", "prediction", "n")
        out = found if out is None else out.unionByName(found)
    return out


@query("planted_steps", f"""SELECT m.model, t.y, t.n, t.n AS near FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in STEPPED)}) m(model),
(SELECT CASE WHEN c_nationkey < 12 THEN 10.0 ELSE 25.0 END::DOUBLE AS y, count(*) AS n FROM customer GROUP BY 1) t""")
def planted_steps(spark, sf):
    """Trees and neighbours give every row a value near the one of two that a column tells."""
    df = customers(spark, sf).withColumn("value", F.when(F.col("y") == "near", 10.0).otherwise(25.0)).drop("y").cache()
    out = None
    for name in STEPPED:
        near = F.abs(F.col("prediction") - F.col("value")) < F.abs(F.col("prediction") - (35 - F.col("value")))
        found = fit_all(df, "value", name, ["c_custkey"], "regression").raw(df).groupBy(F.col("value").alias("y")).agg(F.count("*").alias("n"), F.count_if(near).alias("near"))
        found = found.select(F.lit(name).alias("model"), "y", "n", "near")
        out = found if out is None else out.unionByName(found)
    return out


@query("planted_line", f"SELECT m.model, count(*) AS n, count(*) AS near FROM customer, (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in STRAIGHT)}) m(model) GROUP BY 1")
def planted_line(spark, sf):
    """Linear models meet a line without noise to a hundredth of its spread."""
    df = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 17).cast("double").alias("z"))
    df = df.withColumn("value", F.col("x") * 3 - F.col("z") * 2 + 7).cache()
    out = None
    for name in STRAIGHT:
        close = F.abs(F.col("prediction") - F.col("value")) < 0.5
        found = fit_all(df, "value", name, ["c_custkey"], "regression").raw(df).agg(F.count("*").alias("n"), F.count_if(close).alias("near"))
        found = found.select(F.lit(name).alias("model"), "n", "near")
        out = found if out is None else out.unionByName(found)
    return out


@query("planted_ensembles", f"SELECT m.kind, t.y, t.y AS prediction, t.n FROM (VALUES ('voting'), ('stacking')) m(kind), ({TRUE_CLASSES}) t")
def planted_ensembles(spark, sf):
    df = customers(spark, sf).cache()
    out = None
    for kind in ("voting", "stacking"):
        model, _ = training.build_ensemble(df, "y", ["Logistic Regression", "Decision Tree"], ["c_custkey"], kind)
        found = model.score(df.withColumn("actual", F.col("y"))).groupBy(F.col("actual").alias("y"), "prediction").agg(F.count("*").alias("n"))
        found = found.select(F.lit(kind).alias("kind"), "y", "prediction", "n")
        out = found if out is None else out.unionByName(found)
    return out


@query("saved_models_score_alike", "SELECT m.model, count(*) AS n, count(*) AS same FROM customer, (VALUES ('Decision Tree'), ('AdaBoost'), ('Gaussian Naive Bayes')) m(model) GROUP BY 1")
def saved_models_score_alike(spark, sf):
    """Scores of a model, and of the same one saved and loaded, row by row."""
    df = customers(spark, sf).cache()
    classes, out = training.class_names(df, "y"), None
    for name in ("Decision Tree", "AdaBoost", "Gaussian Naive Bayes"):
        model = fit_all(df, "y", name, ["c_custkey"], "classification", classes)
        where = f"{scratch(spark, 'models')}/{name.split()[0].lower()}"
        training.save_model(model, spark, where)
        again = training.load_model(spark, where).score(df).select("c_custkey", F.col("prediction").alias("later"))
        found = model.score(df).join(again, "c_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("later")).alias("same"))
        found = found.select(F.lit(name).alias("model"), "n", "same")
        out = found if out is None else out.unionByName(found)
    return out


@query("planted_importance", "SELECT * FROM (VALUES ('x', 1.0::DOUBLE), ('noise', 0.0::DOUBLE)) v(feature, importance)")
def planted_importance(spark, sf):
    df = customers(spark, sf)
    model = fit_all(df, "y", "Decision Tree", ["c_custkey"], "classification", training.class_names(df, "y"))
    return rounded(training.feature_importance(model, df).select("feature", "importance"))


@query("planted_selection", f"SELECT c_custkey, {r('c_acctbal / 1000 + CASE WHEN c_nationkey < 12 THEN 0 ELSE 60 END')} AS x, CASE WHEN c_nationkey < 12 THEN 'near' ELSE 'far' END AS y FROM customer")
def planted_selection(spark, sf):
    """By a forest of the usual size, the column that tells the class stays."""
    return rounded(selection.select_from_model(customers(spark, sf), "y", key=["c_custkey"]))


@query("planted_elimination", f"SELECT c_custkey, {r('c_acctbal / 1000 + CASE WHEN c_nationkey < 12 THEN 0 ELSE 60 END')} AS x, CASE WHEN c_nationkey < 12 THEN 'near' ELSE 'far' END AS y FROM customer")
def planted_elimination(spark, sf):
    return rounded(selection.rfe_select(customers(spark, sf), "y", 1, key=["c_custkey"]))


@query("run_points", f"""WITH f AS (SELECT o_orderkey, o_orderdate, o_custkey::DOUBLE AS x, o_totalprice / 1000 + o_custkey * 3 AS y, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders),
g AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i, any_value(n) AS n, any_value(n) - CAST(ceil(any_value(n) * 0.2) AS BIGINT) AS cut FROM f WHERE place < n - CAST(ceil(n * 0.2) AS BIGINT))
SELECT o_orderkey, o_orderdate, place - cut AS position, {r("y", 7)} AS y_test, {r("s * x + i", 4)} AS y_pred FROM f, g WHERE place >= cut""")
def run_points(spark, sf):
    """A run's test labels and predictions, written with the run and read back as a series along time."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").cast("double").alias("x"), (F.col("o_totalprice") / 1000 + F.col("o_custkey") * 3).alias("y"))
    result = training.train_candidates(df, training.TrainingSettings("y", ["o_orderkey"], time_column="o_orderdate"), include_models=["Linear Regression"])
    root = scratch(spark, "runs")
    runs.write_run(result, root)
    series_ = evaluate.diagnostics_series(runs.read_points(spark, root, result.run_id), ["o_orderkey"])
    return series_.select("o_orderkey", "o_orderdate", F.col("position").cast("long").alias("position"), (F.round("y_test", 7) + 0.0).alias("y_test"), (F.round("y_pred", 4) + 0.0).alias("y_pred"))


@query("power_transform_facts", "SELECT true AS centred, true AS scaled, true AS ordered, count(l_extendedprice) AS n FROM lineitem WHERE l_partkey % 11 <> 0")
def power_transform_facts(spark, sf):
    """Mean 0, deviation 1, and the order of the values kept."""
    df = gappy(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice")
    both = scale.power_transform(df.withColumn("p", F.col("l_extendedprice")), "yeo-johnson", ["p"])
    facts = both.agg((F.abs(F.avg("p")) < 1e-6).alias("centred"), (F.abs(F.stddev_pop("p") - 1) < 1e-6).alias("scaled"), F.count("p").alias("n"), F.corr("l_extendedprice", "p").alias("r"))
    return facts.select("centred", "scaled", (F.col("r") > 0.9).alias("ordered"), "n")


@query("hash_encode_facts", "SELECT count(*) AS n, count(DISTINCT p_name) AS names, count(DISTINCT p_name) AS pairs, true AS one_each FROM part")
def hash_encode_facts(spark, sf):
    """One signed slot per row, and the same one for equal names."""
    df = table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_name").alias("name"))
    out = encode.hash_encode(df, ["p_name"], 16)
    size = F.aggregate(F.transform("p_name_hash", lambda v: F.abs(v)), F.lit(0.0), lambda a, b: a + b)
    return out.agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.count_distinct("name", "p_name_hash").alias("pairs"), F.every(size == 1.0).alias("one_each"))


@query("forecast_ar_line", f"""WITH {MONTHLY}, p AS (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY month) AS t FROM m)
SELECT o_orderpriority, h::INT AS step, (3.0 * (max(t) + h) + 5)::DOUBLE AS forecast FROM p, range(1, 7) g(h) GROUP BY 1, h""")
def forecast_ar_line(spark, sf):
    """A straight series goes on straight."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("month"))
    df = monthly(spark, sf).select("o_orderpriority", "month", (place * 3.0 + 5).alias("x"))
    return rounded(series.forecast_ar(df, "x", ["month"], ["o_orderpriority"], 6).select("o_orderpriority", "step", "forecast"), 4)
