"""Training, evaluation, scoring and run-table queries."""

from pyspark.sql import functions as F

from checks.neighbouring import document_features
from checks.registry import query, r, rounded, table
from checks.sourcing import scratch
from tabloom.models import catalogue, custom, evaluate, runs, train as training
from tabloom.operators import isolation, selection


def lines(spark, sf):
    return table(spark, sf, "lineitem")


def sales(spark, sf):
    """Orders with a few features for regression on the total price."""
    o = table(spark, sf, "orders")
    per = lines(spark, sf).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("gross"), F.avg("l_discount").alias("discount"), F.count("*").alias("items"))
    return o.join(per, "o_orderkey").select("o_orderkey", "o_orderdate", "o_orderpriority", "discount", "items",
                                            (F.col("o_totalprice") / 1000).alias("price"), (F.col("gross") / 1000).alias("gross"))


SMALL = {"Random Forest": {"n_estimators": 10, "max_depth": 5}, "Extra Trees": {"n_estimators": 10, "max_depth": 5},
         "Bagging": {"n_estimators": 5, "max_depth": 5}, "AdaBoost": {"n_estimators": 5}, "Gradient Boosting": {"n_estimators": 5},
         "Hist Gradient Boosting": {"n_estimators": 5}, "MLP": {"hidden_layer_sizes": (8,), "max_iter": 20}, "SGD Classifier": {"max_iter": 10},
         "Linear SVC": {"max_iter": 10}, "SVC (RBF)": {"max_iter": 10, "n_components": 64}}


def board(spark, result):
    out = result.leaderboard_frame(spark)
    return out.select("rank", "model", "status", F.to_json("metrics").alias("metrics"), "error")


@query("train_classifiers")
def train_classifiers(spark, sf):
    """Every classifier of the catalogue on document features, small settings."""
    s = training.TrainingSettings("toxic", ["doc_id"], class_weight="balanced", params=SMALL, parallelism=4)
    return board(spark, training.train_candidates(document_features(spark, sf), s))


@query("train_regressors")
def train_regressors(spark, sf):
    """Every regressor of the catalogue, split by time, small settings."""
    s = training.TrainingSettings("price", ["o_orderkey"], time_column="o_orderdate", params=SMALL, parallelism=4)
    return board(spark, training.train_candidates(sales(spark, sf), s))


@query("train_custom_model")
def train_custom_model(spark, sf):
    s = training.TrainingSettings("toxic", ["doc_id"])
    extra = [{"name": "Shallow Tree", "class": "pyspark.ml.classification.DecisionTreeClassifier", "params": {"maxDepth": 2}},
             {"name": "Broken", "class": "pyspark.ml.classification.FMClassifier", "params": {"maxIter": -1}}]
    return board(spark, training.train_candidates(document_features(spark, sf), s, extra, ["Baseline (Majority)"]))


def fit_all(df, target, name, key, task, classes=None):
    features = [n for n in df.columns if n not in (target, *key)]
    return training.fit_one(df, name, catalogue.candidate_models(task)[name], task, target, features, key, classes)


@query("baseline_majority", """WITH k AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT l_returnflag AS top FROM k ORDER BY n DESC, 1 LIMIT 1)
SELECT l_returnflag, top AS prediction, n FROM k, m""")
def baseline_majority(spark, sf):
    df = lines(spark, sf).select("l_orderkey", "l_quantity", "l_returnflag")
    model = fit_all(df, "l_returnflag", "Baseline (Majority)", ["l_orderkey"], "classification", training.class_names(df, "l_returnflag"))
    named = model.raw(df).select("l_returnflag", F.array(*[F.lit(v) for v in model.classes])[F.col("prediction").cast("int")].alias("prediction"))
    return named.groupBy("l_returnflag", "prediction").agg(F.count("*").alias("n"))


@query("baseline_mean", f"SELECT {r('avg(l_extendedprice)', 4)} AS prediction, count(*) AS n FROM lineitem")
def baseline_mean(spark, sf):
    df = lines(spark, sf).select("l_orderkey", "l_quantity", "l_extendedprice")
    scored = fit_all(df, "l_extendedprice", "Baseline (Mean)", ["l_orderkey"], "regression").score(df)
    return rounded(scored.groupBy("prediction").agg(F.count("*").alias("n")), 4)


@query("linear_regression_one_feature", f"""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)
SELECT l_quantity, {r("any_value(i + s * l_quantity)", 3)} AS prediction, count(*) AS n FROM lineitem, m GROUP BY 1""")
def linear_regression_one_feature(spark, sf):
    df = lines(spark, sf).select("l_orderkey", "l_quantity", "l_extendedprice")
    scored = fit_all(df, "l_extendedprice", "Linear Regression", ["l_orderkey"], "regression").score(df)
    return rounded(scored.groupBy("l_quantity").agg(F.max("prediction").alias("prediction"), F.count("*").alias("n")), 3)


@query("explain_linear", f"""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, avg(l_quantity) AS q FROM lineitem)
SELECT 'l_quantity' AS feature, {r("avg(abs(s * (l_quantity - q)))", 3)} AS mean_abs_contribution FROM lineitem, m""")
def explain_linear(spark, sf):
    df = lines(spark, sf).select("l_orderkey", "l_quantity", "l_extendedprice")
    model = fit_all(df, "l_extendedprice", "Linear Regression", ["l_orderkey"], "regression")
    return rounded(training.explain_linear(model, df).select("feature", "mean_abs_contribution"), 3)


@query("class_moments", f"""SELECT l_returnflag, count(*) AS n, {r("avg(l_quantity)")} AS mean_quantity, {r("avg(l_discount)")} AS mean_discount,
  {r("covar_pop(l_quantity, l_discount)")} AS covariance FROM lineitem GROUP BY 1""")
def class_moments(spark, sf):
    """The per-class counts, means and covariances behind the discriminant and Gaussian models."""
    from pyspark.ml.feature import VectorAssembler

    from tabloom.models.gram import cross_products

    names = ["A", "N", "R"]
    df = lines(spark, sf).withColumn("k", (F.array_position(F.array(*[F.lit(v) for v in names]), F.col("l_returnflag")) - 1))
    ready = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="x").transform(df)
    rows = [(names[int(k)], int(n), float(s[0] / n), float(s[1] / n), float(g[0, 1] / n - s[0] / n * s[1] / n))
            for k, (n, s, g) in cross_products(ready, "x", by="k").items()]
    return rounded(spark.createDataFrame(rows, "l_returnflag string, n long, mean_quantity double, mean_discount double, covariance double"))


@query("class_weights", f"""WITH n AS (SELECT toxic, count(*) AS k FROM labels GROUP BY 1)
SELECT doc_id, quality, toxic, {r("(SELECT sum(k) FROM n) / ((SELECT count(*) FROM n) * k)")} AS weight FROM labels JOIN n USING (toxic)""")
def class_weights(spark, sf):
    return rounded(training.class_weights(table(spark, sf, "labels"), "toxic"))


PREDICTED = "p AS (SELECT l_returnflag AS label, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS prediction FROM lineitem)"


def predicted(spark, sf):
    guess = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") > 25, "A").otherwise("R")
    return lines(spark, sf).select(F.col("l_returnflag").alias("label"), guess.alias("prediction"))


@query("classification_metrics", f"""WITH {PREDICTED}, k AS (SELECT DISTINCT label AS k FROM p UNION SELECT DISTINCT prediction FROM p),
c AS (SELECT k, count(*) FILTER (label = k) AS a, count(*) FILTER (prediction = k) AS b, count(*) FILTER (label = k AND prediction = k) AS h FROM k, p GROUP BY 1)
SELECT {r("sum(h) / sum(a)")} AS accuracy, {r("sum(CASE WHEN h > 0 THEN 2 * h / (a + b) ELSE 0 END * a) / sum(a)")} AS f1_weighted,
  {r("sum(CASE WHEN b > 0 THEN h / b ELSE 0 END * a) / sum(a)")} AS precision_weighted, {r("sum(CASE WHEN a > 0 THEN h / a ELSE 0 END * a) / sum(a)")} AS recall_weighted FROM c""")
def classification_metrics(spark, sf):
    return rounded(evaluate.classification_metrics(predicted(spark, sf), "label", "prediction"))


@query("confusion_matrix", f"WITH {PREDICTED} SELECT label AS actual, prediction AS predicted, count(*) AS count FROM p GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(predicted(spark, sf), "label", "prediction")


@query("roc_auc", f"""WITH s AS (SELECT l_returnflag = 'A' AS y, l_quantity AS v FROM lineitem),
k AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS mr FROM s)
SELECT {r("(sum(mr) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y))")} AS auc FROM k""")
def roc_auc(spark, sf):
    return rounded(spark.createDataFrame([(evaluate.roc_auc(lines(spark, sf), "l_returnflag", "l_quantity", "A"),)], "auc double"))


@query("regression_metrics", f"""WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
SELECT {r("1 - sum(pow(p - y, 2)) / (var_pop(y) * count(*))")} AS r2, {r("sqrt(avg(pow(p - y, 2)))", 4)} AS rmse, {r("avg(abs(p - y))", 4)} AS mae,
  {r("quantile_cont(abs(p - y), 0.5)", 4)} AS median_ae FROM p""")
def regression_metrics(spark, sf):
    df = lines(spark, sf).select("l_extendedprice", (F.col("l_quantity") * 1500).alias("p"))
    out = evaluate.regression_metrics(df, "l_extendedprice", "p", median=True)
    return out.select(F.round("r2", 6).alias("r2"), *[F.round(n, 4).alias(n) for n in ("rmse", "mae", "median_ae")])


def forecasts(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_orderdate", F.col("o_totalprice").alias("y_test"), (F.col("o_custkey") * 100.0).alias("y_pred"))


PLACED = """p AS (SELECT o_orderkey, o_orderdate, o_totalprice AS y_test, CAST(o_custkey * 100.0 AS DOUBLE) AS y_pred, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders)"""
THINNED = "position % greatest(1, (SELECT count(*) FROM orders) // 500) = 0"


@query("diagnostics_series", f"WITH {PLACED} SELECT * FROM p")
def diagnostics_series(spark, sf):
    out = evaluate.diagnostics_series(forecasts(spark, sf), ["o_orderkey"])
    return out.withColumn("position", F.col("position").cast("long"))


@query("diagnostics_series_thinned", f"WITH {PLACED} SELECT * FROM p WHERE {THINNED}")
def diagnostics_series_thinned(spark, sf):
    out = evaluate.diagnostics_series(forecasts(spark, sf), ["o_orderkey"], max_points=500)
    return out.withColumn("position", F.col("position").cast("long"))


@query("residuals", f"SELECT o_orderkey, o_orderdate, o_totalprice AS y_test, CAST(o_custkey * 100.0 AS DOUBLE) AS y_pred, {r('o_custkey * 100.0 - o_totalprice', 2)} AS residual FROM orders")
def residuals(spark, sf):
    return rounded(evaluate.residuals(forecasts(spark, sf), "y_test", "y_pred"), 2)


@query("predicted_vs_actual", """WITH e AS (SELECT least(min(o_totalprice), min(o_custkey * 100.0)) AS line_min, greatest(max(o_totalprice), max(o_custkey * 100.0)) AS line_max FROM orders)
SELECT o_totalprice AS actual, CAST(o_custkey * 100.0 AS DOUBLE) AS predicted, CAST(line_min AS DOUBLE) AS line_min, CAST(line_max AS DOUBLE) AS line_max FROM orders, e""")
def predicted_vs_actual(spark, sf):
    return evaluate.predicted_vs_actual(forecasts(spark, sf), "y_test", "y_pred")


@query("forecast_chart_series", f"""WITH {PLACED} SELECT position, 'actual' AS series, y_test AS value FROM p UNION ALL SELECT position, 'predicted', y_pred FROM p""")
def forecast_chart_series(spark, sf):
    out = evaluate.forecast_series(forecasts(spark, sf), "y_test", "y_pred", ["o_orderkey"])
    return out.withColumn("position", F.col("position").cast("long"))


def run_table(spark, sf):
    """A runs table out of the line items: a run per ship mode month, a 'model' per line number with its metrics."""
    parts = lines(spark, sf).withColumn("run_id", F.date_format("l_shipdate", "'run_'yyyyMM"))
    entry = parts.groupBy("run_id", "l_linenumber").agg(F.avg("l_discount").alias("f1"), F.round(F.avg("l_tax"), 9).alias("acc"), F.max("l_shipdate").alias("at"))
    status = F.when(F.col("l_linenumber") == 7, "failed").otherwise("success")
    model = F.concat(F.lit("model "), F.col("l_linenumber").cast("string"))
    metrics = F.when(status == "success", F.create_map(F.lit("f1_weighted"), F.round("f1", 9), F.lit("accuracy"), F.col("acc"))).otherwise(
        F.create_map().cast("map<string,double>"))
    each = F.struct(model.alias("model"), status.alias("status"), metrics.alias("metrics"), F.lit("").alias("error"))
    out = entry.groupBy("run_id").agg(F.max("at").alias("trained_at"), F.collect_list(each).alias("leaderboard"))
    best = F.aggregate("leaderboard", F.lit(None).cast("double"), lambda a, e: F.greatest(a, e["metrics"]["f1_weighted"]))
    return out.select("run_id", "trained_at", F.lit("classification").alias("task_type"), F.lit("l_returnflag").alias("target_column"),
                      F.size("leaderboard").cast("long").alias("row_count"), F.array(F.lit("a"), F.lit("b")).alias("feature_columns"),
                      F.lit("best").alias("best_model_name"), F.create_map(F.lit("f1_weighted"), best).alias("best_metrics"), "leaderboard",
                      F.create_map(F.lit("test_size"), F.lit("0.2")).alias("settings"))


RUN_TABLE = """e AS (SELECT strftime(l_shipdate, 'run_%Y%m') AS run_id, 'model ' || l_linenumber AS model, CASE WHEN l_linenumber = 7 THEN 'failed' ELSE 'success' END AS status,
  round(avg(l_discount), 9) AS f1, round(avg(l_tax), 9) AS acc, max(l_shipdate) AS seen FROM lineitem GROUP BY 1, 2, 3)"""


@query("rank_leaderboard", f"""WITH {RUN_TABLE} SELECT run_id, model, status, CASE WHEN status = 'success' THEN CAST(row_number() OVER (PARTITION BY run_id, status ORDER BY f1 DESC, acc DESC, model) AS INT) END AS rank FROM e""")
def rank_leaderboard(spark, sf):
    return runs.rank_entries(run_table(spark, sf))


@query("leaderboard_view", f"WITH {RUN_TABLE} SELECT run_id, model, 'f1_weighted' AS metric, f1 AS value FROM e WHERE status = 'success'")
def leaderboard_view(spark, sf):
    return runs.leaderboard_view(run_table(spark, sf))


@query("latest_runs_first", f"WITH {RUN_TABLE} SELECT run_id, max(seen) AS trained_at FROM e GROUP BY 1 ORDER BY 2 DESC, 1")
def latest_runs_first(spark, sf):
    return runs.latest_first(run_table(spark, sf), "trained_at", "run_id").select("run_id", "trained_at")


@query("compare_runs", f"""WITH {RUN_TABLE} SELECT run_id, 'best' AS best_model_name, 'classification' AS task_type, 'f1_weighted' AS metric, max(f1) FILTER (status = 'success') AS value
FROM e WHERE run_id IN ('run_199601', 'run_199702') GROUP BY 1""")
def compare_runs(spark, sf):
    return runs.compare_runs(run_table(spark, sf), ["run_199601", "run_199702", "run_nowhere"])[0]


@query("inspect_run", f"""WITH {RUN_TABLE} SELECT run_id, max(seen) AS trained_at, 'l_returnflag' AS target_column, count(*) AS row_count, 2::INT AS feature_count,
  list_sort(list(model) FILTER (status = 'success')) AS successful_models FROM e WHERE run_id = 'run_199601' GROUP BY 1""")
def inspect_run(spark, sf):
    return runs.inspect_run(run_table(spark, sf), "run_199601").select(
        "run_id", "trained_at", "target_column", "row_count", "feature_count", F.array_sort("successful_models").alias("successful_models"))


@query("review_runs", f"""WITH {RUN_TABLE}, g AS (SELECT run_id, f1, row_number() OVER (PARTITION BY run_id ORDER BY f1 DESC, acc DESC, model) AS rk FROM e WHERE status = 'success')
SELECT a.run_id, 'runaway winner' AS rule FROM g a JOIN g b ON a.run_id = b.run_id AND a.rk = 1 AND b.rk = 2 WHERE a.f1 - b.f1 > 0.15 * abs(b.f1)
UNION ALL SELECT DISTINCT run_id, 'random split on temporal data' FROM e""")
def review_runs(spark, sf):
    return runs.review_runs(run_table(spark, sf), temporal=True).select("run_id", "rule")


@query("feature_f_scores", f"""WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) mq, var_pop(l_quantity) vq, avg(l_discount) md, var_pop(l_discount) vd, avg(l_tax) mt, var_pop(l_tax) vt FROM lineitem GROUP BY 1),
t AS (SELECT count(*) AS n, avg(l_quantity) gq, avg(l_discount) gd, avg(l_tax) gt FROM lineitem)
SELECT 'l_quantity' AS feature, {r("sum(g.n * pow(mq - gq, 2)) / (count(*) - 1) / (sum(g.n * vq) / (any_value(t.n) - count(*)))")} AS f FROM g, t
UNION ALL SELECT 'l_discount', {r("sum(g.n * pow(md - gd, 2)) / (count(*) - 1) / (sum(g.n * vd) / (any_value(t.n) - count(*)))")} FROM g, t
UNION ALL SELECT 'l_tax', {r("sum(g.n * pow(mt - gt, 2)) / (count(*) - 1) / (sum(g.n * vt) / (any_value(t.n) - count(*)))")} FROM g, t""")
def feature_f_scores(spark, sf):
    return rounded(selection.f_scores(lines(spark, sf).select("l_quantity", "l_discount", "l_tax", "l_returnflag"), "l_returnflag"))


@query("select_k_best", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_quantity * 100 + l_discount AS cost FROM lineitem")
def select_k_best(spark, sf):
    df = lines(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag",
                                 (F.col("l_quantity") * 100 + F.col("l_discount")).alias("cost"))
    return selection.select_k_best(df, "cost", 1, key=["l_orderkey", "l_linenumber"])


@query("select_k_best_mutual_information", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_quantity * 100 + l_discount AS cost FROM lineitem")
def select_k_best_mutual_information(spark, sf):
    df = lines(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag",
                                 (F.col("l_quantity") * 100 + F.col("l_discount")).alias("cost"))
    return selection.select_k_best(df, "cost", 1, True, key=["l_orderkey", "l_linenumber"])


@query("select_from_model")
def select_from_model(spark, sf):
    df = lines(spark, sf).select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return selection.select_from_model(df, "l_extendedprice", key=["l_orderkey"])


@query("rfe_select")
def rfe_select(spark, sf):
    df = lines(spark, sf).select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return selection.rfe_select(df, "l_extendedprice", 1, key=["l_orderkey"])


@query("pca")
def pca(spark, sf):
    df = lines(spark, sf).select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag")
    return rounded(selection.pca(df, 2, key=["l_orderkey"]))


@query("isolation_forest_outliers")
def isolation_forest_outliers(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    return isolation.isolation_forest_outliers(df, 0.05, exclude=["event_id"])


@query("cross_validate_model")
def cross_validate_model(spark, sf):
    return training.cross_validate_model(document_features(spark, sf), "toxic", "Logistic Regression", ["doc_id"], parallelism=3)


@query("cross_validate_over_time")
def cross_validate_over_time(spark, sf):
    return training.cross_validate_model(sales(spark, sf), "price", "Ridge", ["o_orderkey"], time_column="o_orderdate", parallelism=3)


LINE = """f AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_quantity AS quantity, CAST('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber), 1, 8) AS BIGINT) % 5 AS fold FROM lineitem)"""


def _line_scores(order):
    return f"""s AS (SELECT g.fold, 1 - sum(pow(price - (slope * quantity + base), 2)) / sum(pow(price - mean, 2)) AS r2 FROM g JOIN held USING (fold) GROUP BY 1)
SELECT 'Linear Regression' AS model, 'regression' AS task_type, '{order}' AS cv_type, 5::INT AS n_splits, 'r2' AS scoring, round(avg(r2), 4) + 0.0 AS mean_score, round(stddev_pop(r2), 4) + 0.0 AS std_score FROM s"""


@query("cross_validate_line", f"""WITH {LINE},
g AS (SELECT k.fold, regr_slope(price, quantity) AS slope, regr_intercept(price, quantity) AS base FROM f, range(5) k(fold) WHERE f.fold <> k.fold GROUP BY 1),
held AS (SELECT *, avg(price) OVER (PARTITION BY fold) AS mean FROM f), {_line_scores('KFold')}""")
def cross_validate_line(spark, sf):
    """One feature: every fold's score in closed form."""
    df = lines(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return training.cross_validate_model(df, "price", "Linear Regression", ["l_orderkey", "l_linenumber"], parallelism=3).drop("scores")


@query("cross_validate_line_over_time", f"""WITH f AS MATERIALIZED (SELECT l_extendedprice AS price, l_quantity AS quantity, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS spot,
  count(*) OVER () AS n, count(*) OVER () // 6 AS block FROM lineitem),
g AS (SELECT k.fold, regr_slope(price, quantity) AS slope, regr_intercept(price, quantity) AS base FROM f, range(5) k(fold) WHERE spot < n - block * (5 - k.fold) GROUP BY 1),
held AS (SELECT k.fold, price, quantity, avg(price) OVER (PARTITION BY k.fold) AS mean FROM f, range(5) k(fold) WHERE spot >= n - block * (5 - k.fold) AND spot < n - block * (4 - k.fold)),
{_line_scores('TimeSeriesSplit')}""")
def cross_validate_line_over_time(spark, sf):
    df = lines(spark, sf).select("l_orderkey", "l_linenumber", "l_shipdate", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return training.cross_validate_model(df, "price", "Linear Regression", ["l_orderkey", "l_linenumber"], time_column="l_shipdate", parallelism=3).drop("scores")


@query("tune_hyperparameters")
def tune_hyperparameters(spark, sf):
    return training.tune_hyperparameters(sales(spark, sf).drop("o_orderdate"), "price", "Ridge", ["o_orderkey"], parallelism=4)


@query("tuned_point_is_refitted", "SELECT 5 AS points, true AS best_first, true AS as_listed, count(*) AS scored FROM lineitem")
def tuned_point_is_refitted(spark, sf):
    """All five points of the grid are listed, best first, and the first of them is what the returned model was fitted with."""
    import json

    df = lines(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), "l_discount")
    found = training.search_hyperparameters(df, "price", "Ridge", ["l_orderkey", "l_linenumber"], parallelism=4)
    table = found.points.agg(F.count("*").cast("int").alias("points"), F.max_by("params", -F.col("rank")).alias("best"), F.max("mean_score").alias("top"),
                             F.max_by("mean_score", -F.col("rank")).alias("first"))
    scored = found.model.score(df).where(F.col("prediction").isNotNull()).agg(F.count("*").alias("scored"))
    return table.crossJoin(scored).select("points", (F.col("top") == F.col("first")).alias("best_first"),
                                          (F.col("best") == F.lit(json.dumps(found.best_params))).alias("as_listed"), "scored")


def metrics_row(spark, metrics):
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(metrics.items())], "metric string, value double")


@query("voting_ensemble")
def voting_ensemble(spark, sf):
    return metrics_row(spark, training.build_ensemble(document_features(spark, sf), "toxic", ["Logistic Regression", "Decision Tree"], ["doc_id"])[1])


@query("stacking_ensemble")
def stacking_ensemble(spark, sf):
    return metrics_row(spark, training.build_ensemble(sales(spark, sf).drop("o_orderdate"), "price", ["Linear Regression", "Decision Tree"], ["o_orderkey"],
                                                      "stacking")[1])


@query("score_new_rows")
def score_new_rows(spark, sf):
    df = document_features(spark, sf)
    result = training.train_candidates(df, training.TrainingSettings("toxic", ["doc_id"]), include_models=["Logistic Regression"])
    return training.score(result.model, df).select("doc_id", "prediction", F.to_json("probabilities").alias("probabilities"))


@query("test_saved_runs")
def test_saved_runs(spark, sf):
    """Train, save model and splits, then re-evaluate from disk."""
    from tabloom import sources

    result = training.train_candidates(sales(spark, sf), training.TrainingSettings("price", ["o_orderkey"], time_column="o_orderdate"), include_models=["Linear Regression", "Baseline (Mean)"])
    root = scratch(spark, "runs")
    paths = sources.write_splits(result.train, result.test, root, result.run_id)
    found = []
    for name, model in result.models.items():
        where = f"{root}/runs/{result.run_id}/{name.split()[0].lower()}"
        training.save_model(model, spark, where)
        found.append((name, where, paths["test"]))
    return training.test_runs(spark, found).select("run_id", "status", F.to_json("metrics").alias("metrics"), "error")


@query("feature_importance")
def feature_importance(spark, sf):
    df = sales(spark, sf).drop("o_orderdate")
    return rounded(training.feature_importance(fit_all(df, "price", "Decision Tree", ["o_orderkey"], "regression"), df))
