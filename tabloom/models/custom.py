"""Models Spark ML lacks, fitted from aggregates and applied as expressions or Arrow batches."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.functions.columns import c
from tabloom.models.gram import cross_products
from tabloom.session import cut_lineage

CHECKPOINT_ROUNDS = 10
FOURIER_TERMS = 256


def _probabilities(df: DataFrame, probs: Column) -> DataFrame:
    """Adds ``probability`` (vector) and ``prediction`` (index of the largest, first on ties)."""
    best = F.array_position(F.col("_p"), F.array_max("_p")).cast("double") - 1
    return (df.withColumn("_p", probs).withColumn("prediction", best)
            .withColumn("probability", array_to_vector("_p")).drop("_p"))


def _softmax(scores: np.ndarray) -> np.ndarray:
    z = np.exp(scores - scores.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _batch_probabilities(compute):
    """Arrow function over feature arrays giving one probability array per row."""
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(compute(np.stack(x.to_numpy()).astype(float))))
    return run


class CustomModel:
    """Parameters as JSON plus nested Spark models and tables, saved side by side."""

    kind = ""
    nested_class: type | None = None

    def __init__(self, params: dict, nested: list | None = None):
        self.params, self.nested = params, nested or []

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"kind": self.kind, "params": self.params, "nested": len(self.nested)})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")
        for i, model in enumerate(self.nested):
            model.write().overwrite().save(f"{path}/nested_{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CustomModel":
        state = json.loads(spark.read.text(f"{path}/params").first()[0])
        kind = KINDS[state["kind"]]
        model = kind(state["params"], [kind.nested_class.load(f"{path}/nested_{i}") for i in range(state["nested"])])
        model.restore(spark, path)
        return model

    def restore(self, spark: SparkSession, path: str) -> None:
        pass


class ConstantModel(CustomModel):
    """The majority class or the mean."""

    kind = "constant"

    @staticmethod
    def fit(train: DataFrame, classes: int | None, weight: str | None = None) -> "ConstantModel":
        if classes is None:
            return ConstantModel({"value": train.agg(F.avg("label")).first()[0], "classes": None})
        top = train.groupBy("label").count().orderBy(F.desc("count"), "label").first()
        return ConstantModel({"value": top["label"], "classes": classes})

    def transform(self, df: DataFrame) -> DataFrame:
        value, classes = self.params["value"], self.params["classes"]
        out = df.withColumn("prediction", F.lit(float(value)))
        if classes:
            out = out.withColumn("probability", array_to_vector(F.array(*[F.lit(1.0 if k == int(value) else 0.0) for k in range(classes)])))
        return out


class DiscriminantModel(CustomModel):
    """Linear (pooled covariance) or quadratic discriminant analysis."""

    kind = "discriminant"

    @staticmethod
    def fit(train: DataFrame, classes: int, quadratic: bool, ridge: float = 1e-6) -> "DiscriminantModel":
        parts = cross_products(train, "features", by="label")
        total = sum(n for n, _, _ in parts.values())
        labels = sorted(parts)
        means = {k: parts[k][1] / parts[k][0] for k in labels}
        scatter = {k: parts[k][2] - parts[k][0] * np.outer(means[k], means[k]) for k in labels}
        size = len(next(iter(means.values())))
        eye = ridge * np.eye(size)
        pooled = sum(scatter.values()) / max(total - len(labels), 1) + eye
        entries = []
        for k in labels:
            covariance = scatter[k] / max(parts[k][0] - 1, 1) + eye if quadratic else pooled
            precision = np.linalg.pinv(covariance, hermitian=True)
            values = np.linalg.eigvalsh(covariance)
            logdet = float(np.sum(np.log(np.maximum(values, ridge))))
            entries.append({"label": int(k), "mean": means[k].tolist(), "precision": precision.tolist(),
                            "offset": math.log(parts[k][0] / total) - (0.5 * logdet if quadratic else 0.0)})
        return DiscriminantModel({"classes": classes, "entries": entries})

    def transform(self, df: DataFrame) -> DataFrame:
        entries, classes = self.params["entries"], self.params["classes"]

        def compute(x: np.ndarray) -> np.ndarray:
            scores = np.full((len(x), classes), -np.inf)
            for e in entries:
                d = x - np.array(e["mean"])
                scores[:, e["label"]] = e["offset"] - 0.5 * np.einsum("ij,jk,ik->i", d, np.array(e["precision"]), d)
            return _softmax(scores)

        return _probabilities(df, _batch_probabilities(compute)(vector_to_array("features")))


class SvcModel(CustomModel):
    """One linear SVC per class (one in all for two classes) with Platt-scaled margins."""

    kind = "svc"
    nested_class = LinearSVCModel

    @staticmethod
    def fit(train: DataFrame, classes: int, max_iter: int = 100, reg: float = 1e-4, calibrate: bool = True, folds: int = 3,
            weight: str | None = None, seed: int = 42) -> "SvcModel":
        targets = [1] if classes == 2 else list(range(classes))
        svc = LinearSVC(maxIter=max_iter, regParam=reg, featuresCol="features", labelCol="_y", standardization=False, tol=1e-4)
        if weight:
            svc = svc.setWeightCol(weight)
        models, scale = [], []
        for k in targets:
            marked = train.withColumn("_y", (F.col("label") == float(k)).cast("double"))
            a, b = 2.0, 0.0
            if calibrate:
                held = None
                folded = marked.withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(folds)))
                for f in range(folds):
                    part = svc.fit(folded.where(F.col("_fold") != f)).transform(folded.where(F.col("_fold") == f))
                    part = part.select("_y", vector_to_array("rawPrediction")[1].alias("m"))
                    held = part if held is None else held.unionByName(part)
                platt = LogisticRegression(featuresCol="_m", labelCol="_y", maxIter=50).fit(
                    held.select("_y", array_to_vector(F.array("m")).alias("_m")))
                a, b = float(platt.coefficients[0]), float(platt.intercept)
            models.append(svc.fit(marked))
            scale.append([a, b])
        return SvcModel({"classes": classes, "scale": scale}, models)

    def transform(self, df: DataFrame) -> DataFrame:
        out, margins = df, []
        for i, model in enumerate(self.nested):
            # margins as literals of the fitted weights: one expression, no chain of transformers
            weights = [float(w) for w in model.coefficients.toArray()]
            dot = F.aggregate(F.zip_with(vector_to_array("features"), F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w),
                              F.lit(float(model.intercept)), lambda s, v: s + v)
            a, b = self.params["scale"][i]
            margins.append(1 / (1 + F.exp(-(F.lit(a) * dot + F.lit(b)))))
        if self.params["classes"] == 2:
            return _probabilities(out, F.array(1 - margins[0], margins[0]))
        total = sum(margins[1:], margins[0])
        return _probabilities(out, F.array(*[m / total for m in margins]))


class FourierSvcModel(CustomModel):
    """RBF SVC through random Fourier features (Rahimi and Recht 2007) and a calibrated linear SVC."""

    kind = "fourier_svc"
    nested_class = LinearSVCModel

    @staticmethod
    def _map(df: DataFrame, size: int, gamma: float, terms: int, seed: int) -> DataFrame:
        rng = np.random.default_rng(seed)
        w = rng.normal(0.0, math.sqrt(2 * gamma), (size, terms))
        b = rng.uniform(0, 2 * math.pi, terms)
        compute = _batch_probabilities(lambda x: math.sqrt(2 / terms) * np.cos(x @ w + b))
        return df.withColumn("features", array_to_vector(compute(vector_to_array("features"))))

    @staticmethod
    def fit(train: DataFrame, classes: int, size: int, terms: int = FOURIER_TERMS, weight: str | None = None, seed: int = 42,
            max_iter: int = 100) -> "FourierSvcModel":
        moments = cross_products(train, "features")[0.0]
        cells = moments[0] * size
        spread = np.trace(moments[2]) / cells - (moments[1].sum() / cells) ** 2
        gamma = 1.0 / (size * spread) if spread > 0 else 1.0
        mapped = FourierSvcModel._map(train, size, gamma, terms, seed).persist()
        try:
            inner = SvcModel.fit(mapped, classes, max_iter, weight=weight, seed=seed)
        finally:
            mapped.unpersist()
        return FourierSvcModel({"size": size, "gamma": gamma, "terms": terms, "seed": seed, "inner": inner.params}, inner.nested)

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        kept = df.withColumn("_plain", F.col("features"))
        mapped = self._map(kept, p["size"], p["gamma"], p["terms"], p["seed"])
        out = SvcModel(p["inner"], self.nested).transform(mapped)
        return out.withColumn("features", F.col("_plain")).drop("_plain")


class _Trees:
    """Fitted trees as arrays of nodes, scored together: one Arrow pass over the rows, however many trees there are."""

    def __init__(self, models: list):
        self.trees = []
        for model in models:
            nodes: list[list] = []
            self._add(model._java_obj.rootNode(), nodes)
            self.trees.append(nodes)

    def _add(self, node, nodes: list[list]) -> int:
        """Adds a node and what is below it: [feature, threshold or left categories, left, right, prediction]; a leaf has no feature."""
        at = len(nodes)
        nodes.append([None, None, at, at, float(node.prediction())])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            if split.getClass().getSimpleName() == "ContinuousSplit":
                nodes[at][:2] = [int(split.featureIndex()), float(split.threshold())]
            else:
                nodes[at][:2] = [int(split.featureIndex()), [float(v) for v in split.leftCategories()]]
            nodes[at][2], nodes[at][3] = self._add(node.leftChild(), nodes), self._add(node.rightChild(), nodes)
        return at

    @staticmethod
    def _descend(nodes: list[list], x: np.ndarray, at: int, rows: np.ndarray, out: np.ndarray) -> None:
        feature, where, left, right, value = nodes[at]
        if feature is None:
            out[rows] = value
            return
        side = np.isin(x[rows, feature], where) if isinstance(where, list) else x[rows, feature] <= where
        _Trees._descend(nodes, x, left, rows[side], out)
        _Trees._descend(nodes, x, right, rows[~side], out)

    def predictions(self, features: str = "features") -> Column:
        """The prediction of every tree, as an array."""
        trees = self.trees

        @F.pandas_udf("array<double>")
        def run(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            x = np.stack(vectors.to_numpy()).astype(float)
            out = np.empty((len(x), len(trees)))
            for k, nodes in enumerate(trees):
                _Trees._descend(nodes, x, 0, np.arange(len(x)), out[:, k])
            return pd.Series(list(out), dtype=object)
        return run(vector_to_array(features))


class BoostedClassifier(CustomModel):
    """AdaBoost, SAMME (Zhu et al. 2009), on shallow weighted trees."""

    kind = "boosted_classifier"
    nested_class = DecisionTreeClassificationModel

    @staticmethod
    def fit(train: DataFrame, classes: int, rounds: int = 100, depth: int = 1, weight: str | None = None, seed: int = 42) -> "BoostedClassifier":
        work = train.select("features", "label", (c(weight) if weight else F.lit(1.0)).alias("_w")).persist()
        held, alphas, models = work, [], []
        for i in range(rounds):
            model = DecisionTreeClassifier(maxDepth=depth, weightCol="_w", seed=seed + i).fit(work)
            wrong = F.col("prediction") != F.col("label")
            scored = model.transform(work)
            row = scored.agg(F.sum(F.when(wrong, F.col("_w")).otherwise(0.0)).alias("e"), F.sum("_w").alias("t")).first()
            error = row["e"] / row["t"]
            if error <= 0:
                alphas.append(1.0), models.append(model)
                break
            alpha = math.log((1 - error) / error) + math.log(classes - 1)
            if alpha <= 0:
                break
            alphas.append(alpha), models.append(model)
            # weights rescaled to mean 1 so they neither vanish nor overflow
            grown = row["t"] + row["e"] * (math.exp(alpha) - 1)
            work = scored.select("features", "label", (F.col("_w") * F.when(wrong, math.exp(alpha)).otherwise(1.0) * F.lit(row["t"] / grown)).alias("_w"))
            if (i + 1) % CHECKPOINT_ROUNDS == 0:
                work = cut_lineage(work)
        held.unpersist()
        if not models:
            raise ValueError("AdaBoost: the first tree is no better than chance.")
        return BoostedClassifier({"classes": classes, "alphas": alphas}, models)

    def transform(self, df: DataFrame) -> DataFrame:
        classes, alphas = self.params["classes"], self.params["alphas"]
        out = df.withColumn("_votes", _Trees(self.nested).predictions())
        weighted = F.zip_with("_votes", F.array(*map(F.lit, alphas)), lambda v, w: F.struct(v.alias("v"), w.alias("w")))
        votes = [F.aggregate(weighted, F.lit(0.0), lambda s, t: s + F.when(t["v"] == k, t["w"]).otherwise(0.0)) for k in range(classes)]
        return _probabilities(out, F.array(*[v / sum(alphas) for v in votes])).drop("_votes")


class BoostedRegressor(CustomModel):
    """AdaBoost.R2 (Drucker 1997) with linear loss and weighted trees; weighted-median prediction."""

    kind = "boosted_regressor"
    nested_class = DecisionTreeRegressionModel

    @staticmethod
    def fit(train: DataFrame, rounds: int = 100, depth: int = 3, seed: int = 42) -> "BoostedRegressor":
        work = train.select("features", "label", F.lit(1.0).alias("_w")).persist()
        held, weights, models = work, [], []
        for i in range(rounds):
            model = DecisionTreeRegressor(maxDepth=depth, weightCol="_w", seed=seed + i).fit(work)
            scored = model.transform(work).withColumn("_e", F.abs(F.col("prediction") - F.col("label")))
            top = scored.agg(F.max("_e")).first()[0]
            if not top:
                weights.append(1.0), models.append(model)
                break
            row = scored.agg(F.sum(F.col("_w") * F.col("_e") / top).alias("l"), F.sum("_w").alias("t")).first()
            loss = row["l"] / row["t"]
            if loss >= 0.5:
                if not models:
                    weights.append(1.0), models.append(model)
                break
            beta = loss / (1 - loss)
            weights.append(math.log(1 / beta)), models.append(model)
            work = scored.select("features", "label", (F.col("_w") * F.pow(F.lit(beta), 1 - F.col("_e") / top)).alias("_w"))
            if (i + 1) % CHECKPOINT_ROUNDS == 0:
                total = work.agg(F.avg("_w")).first()[0]
                work = cut_lineage(work.withColumn("_w", F.col("_w") / F.lit(total)))
        held.unpersist()
        return BoostedRegressor({"weights": weights}, models)

    def transform(self, df: DataFrame) -> DataFrame:
        half = sum(self.params["weights"]) / 2
        out = df.withColumn("_votes", _Trees(self.nested).predictions())
        weights = F.array(*[F.lit(float(w)) for w in self.params["weights"]])
        pairs = F.array_sort(F.zip_with("_votes", weights, lambda v, w: F.struct(v.alias("v"), w.alias("w"))))
        start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("m"))
        median = F.aggregate(pairs, start, lambda a, p: F.struct(
            (a["s"] + p["w"]).alias("s"), F.coalesce(a["m"], F.when(a["s"] + p["w"] >= half, p["v"])).alias("m")))["m"]
        return out.withColumn("prediction", median).drop("_votes")


class NeighbourModel(CustomModel):
    """k nearest training rows through the exact neighbour join; vote or mean."""

    kind = "neighbour"

    def __init__(self, params: dict, nested: list | None = None, rows: DataFrame | None = None):
        super().__init__(params, nested)
        self.rows = rows

    @staticmethod
    def fit(train: DataFrame, classes: int | None, k: int = 5) -> "NeighbourModel":
        rows = train.select(F.col("_id").cast("string").alias("rid"), vector_to_array("features").alias("vec"), F.col("label"))
        return NeighbourModel({"classes": classes, "k": k}, rows=rows)

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, path)
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")

    def restore(self, spark: SparkSession, path: str) -> None:
        self.rows = spark.read.parquet(f"{path}/rows")

    def transform(self, df: DataFrame) -> DataFrame:
        from tabloom.operators.neighbours import knn_join

        # row numbers are fixed by the checkpoint before both uses
        asked = cut_lineage(df.withColumn("_ask", F.monotonically_increasing_id()))
        near = knn_join(asked.select("_ask", vector_to_array("features").alias("vec")), self.rows, self.params["k"], "vec", "_ask", "rid")
        voted = near.join(self.rows.select(F.col("rid").alias("right_id"), F.col("label").alias("_label")), "right_id").groupBy(
            F.col("left_id").alias("_ask"))
        classes = self.params["classes"]
        if classes is None:
            return asked.join(voted.agg(F.avg("_label").alias("prediction")), "_ask").drop("_ask")
        shares = voted.agg(F.array(*[F.avg((F.col("_label") == float(k)).cast("double")) for k in range(classes)]).alias("_shares"))
        return _probabilities(asked.join(shares, "_ask"), F.col("_shares")).drop("_ask", "_shares")


class LinearWeights(CustomModel):
    """Fixed linear weights (Bayesian ridge)."""

    kind = "linear"

    @staticmethod
    def fit_bayesian_ridge(train: DataFrame, iterations: int = 300, tol: float = 1e-3) -> "LinearWeights":
        """Evidence maximisation (MacKay 1992) on the Gram matrix, aggregated once."""
        n, sums, gram = cross_products(train, "features", extra="label")[0.0]
        mean = sums / n
        centred = gram - n * np.outer(mean, mean)
        xtx, xty, yty = centred[:-1, :-1], centred[:-1, -1], centred[-1, -1]
        values, vectors = np.linalg.eigh(xtx)
        values = np.maximum(values, 0)
        alpha, lam, tiny = 1.0 / (yty / n + 1e-12), 1.0, 1e-6
        weights = np.zeros(len(xty))
        for _ in range(iterations):
            previous = weights
            weights = vectors @ ((vectors.T @ xty) / (values + lam / alpha))
            rss = float(yty - 2 * weights @ xty + weights @ xtx @ weights)
            gamma = float(np.sum(alpha * values / (lam + alpha * values)))
            lam = (gamma + 2 * tiny) / (float(weights @ weights) + 2 * tiny)
            alpha = (n - gamma + 2 * tiny) / (max(rss, 0.0) + 2 * tiny)
            if np.sum(np.abs(weights - previous)) < tol:
                break
        return LinearWeights({"weights": weights.tolist(), "intercept": float(mean[-1] - mean[:-1] @ weights), "alpha": alpha, "lambda": lam})

    def transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(w)) for w in self.params["weights"]])
        dot = F.aggregate(F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w), F.lit(self.params["intercept"]), lambda s, v: s + v)
        return df.withColumn("prediction", dot)


KINDS = {m.kind: m for m in (ConstantModel, DiscriminantModel, SvcModel, FourierSvcModel, BoostedClassifier, BoostedRegressor,
                             NeighbourModel, LinearWeights)}
