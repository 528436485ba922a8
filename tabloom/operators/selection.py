"""Supervised feature selection and principal components."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tabloom.functions.columns import c, is_numeric, numeric_columns, require_column
from tabloom.operators.aggregate import infer_task_type
from tabloom.operators.binned_forest import binned_sums
from tabloom.operators.clean import pairwise_correlations
from tabloom.operators.describe import mutual_information
from tabloom.operators.fitted import Fitted
from tabloom.operators.quantiles import exact_quantiles
from tabloom.operators.scale import fit_standard_scale

ROWS_PER_TASK = 100_000      # a forest keeps a weight per row and tree


def _candidates(df: DataFrame, target: str, key: list[str] | None) -> list[str]:
    require_column(df, target, "target_column")
    names = numeric_columns(df, exclude=[target, *(key or [])])
    if len(names) < 2:
        raise ValueError("Need at least 2 numeric feature columns for selection.")
    return names


def _setup(df: DataFrame, target: str, key: list[str] | None) -> tuple[DataFrame, list[str], str]:
    """(rows with a target and medians filled in, candidate columns, task)."""
    names = _candidates(df, target, key)
    known = df.where(c(target).isNotNull())
    medians = exact_quantiles(known, names, [0.5])
    filled = known.select(*[F.coalesce(c(n).cast("double"), F.lit(medians[n][0])).alias(n) for n in names], c(target))
    return filled, names, infer_task_type(df, target)


def f_scores(df: DataFrame, target: str, key: list[str] | None = None) -> DataFrame:
    """(feature, f): ANOVA F per feature for classes, the F of the correlation for a numeric target."""
    filled, names, task = _setup(df, target, key)
    if task == "regression":
        found = pairwise_correlations(filled, names, [target])
        rows = [(n, None if r is None else float("inf") if abs(r) >= 1 else r * r / (1 - r * r) * (k - 2)) for (n, _), (r, k) in found.items()]
    else:
        aggs = [F.count("*").alias("n")]
        for i, n in enumerate(names):
            aggs += [F.avg(c(n)).alias(f"m{i}"), F.var_pop(c(n)).alias(f"v{i}")]
        grand = filled.agg(*[F.avg(c(n)).alias(n) for n in names]).first()
        sums = [F.count("*").alias("k"), F.sum("n").alias("total")]
        for i, n in enumerate(names):
            gap = F.col(f"m{i}") - F.lit(grand[n])
            sums += [F.sum(F.col("n") * gap * gap).alias(f"b{i}"), F.sum(F.col("n") * F.col(f"v{i}")).alias(f"w{i}")]
        found = filled.groupBy(c(target)).agg(*aggs).agg(*sums).first()
        if found["k"] < 2 or found["total"] <= found["k"]:
            raise ValueError(f"'{target}' needs two classes, and more rows than classes.")
        rows = []
        for i, n in enumerate(names):
            between, within = found[f"b{i}"] / (found["k"] - 1), found[f"w{i}"] / (found["total"] - found["k"])
            rows.append((n, between / within if within > 0 else None))
    return df.sparkSession.createDataFrame(rows, "feature string, f double")


def _keep(df: DataFrame, names: list[str], kept: set[str]) -> DataFrame:
    return df.drop(*[n for n in names if n not in kept])


def select_k_best(df: DataFrame, target: str, k: int | None = None, mutual_info: bool = False, key: list[str] | None = None) -> DataFrame:
    """The k best numeric features by F (or mutual information); other columns stay."""
    names = numeric_columns(df, exclude=[target, *(key or [])])
    k = max(1, min(int(k if k is not None else 10), len(names)))
    if mutual_info:
        _candidates(df, target, key)
        scores = {r["feature"]: r["mutual_information"] for r in mutual_information(df, target, names).collect()}
    else:
        scores = {r["feature"]: r["f"] for r in f_scores(df, target, key).collect()}
    ranked = sorted(names, key=lambda n: (scores[n] is None, -(scores[n] or 0.0), names.index(n)))
    return _keep(df, names, set(ranked[:k]))


def _forest(task: str, trees: int, seed: int, depth: int):
    make = RandomForestClassifier if task == "classification" else RandomForestRegressor
    return make(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")


def _assembled(filled: DataFrame, names: list[str], target: str, task: str) -> tuple[DataFrame, int | None]:
    """(features, label) of every row, and the number of classes."""
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(filled)
    if task == "regression":
        return ready.select("features", c(target).cast("double").alias("label")), None
    classes = sorted(r[0] for r in filled.select(c(target).cast("string")).distinct().collect())
    index = F.array_position(F.array(*[F.lit(v) for v in classes]), c(target).cast("string")) - 1
    return ready.select("features", index.cast("double").alias("label")), len(classes)


def _spread(table: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The table as it lies, or dealt to more tasks where one of them would hold too many rows."""
    sizes = table.groupBy(F.spark_partition_id().alias("part")).count().agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
    return table.repartition(-(-sizes["rows"] // rows_per_task)) if (sizes["most"] or 0) > rows_per_task else table


def _dealt(table: DataFrame) -> tuple[DataFrame, int]:
    """The table, dealt anew where one task of it would have far more than its share of the rows, and their number."""
    sizes = table.groupBy(F.spark_partition_id().alias("part")).count().agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
    rows, tasks = sizes["rows"] or 0, table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(2 * tasks) if (sizes["most"] or 0) > max(ROWS_PER_TASK, 2 * rows // tasks) else table, rows


class _Importances:
    """Forest importances of any of the candidate columns: all from one pass over the rows where combinations of bins are few, else a forest
    of the ML library on one cached vector table."""

    def __init__(self, filled: DataFrame, names: list[str], target: str, task: str, trees: int, seed: int, depth: int):
        self.task, self.trees, self.seed, self.depth = task, trees, seed, depth
        ready, classes = _assembled(filled, names, target, task)
        ready, rows = _dealt(ready)
        self.sums = binned_sums(ready, len(names), rows, classes, trees, seed) if rows and trees > 1 and (classes is None or classes > 1) else None
        self.table = None if self.sums else _spread(ready).withColumnRenamed("features", "all").persist()

    def of(self, features: list[int]) -> list[float]:
        if self.sums:
            return self.sums.importances(features, self.depth)
        sliced = VectorSlicer(inputCol="all", outputCol="features", indices=features).transform(self.table)
        return _forest(self.task, self.trees, self.seed, self.depth).fit(sliced).featureImportances.toArray().tolist()

    def release(self) -> None:
        if self.table is not None:
            self.table.unpersist()


def importances(df: DataFrame, target: str, key: list[str] | None = None, trees: int = 100, seed: int = 42, depth: int = 10) -> dict[str, float]:
    filled, names, task = _setup(df, target, key)
    forest = _Importances(filled, names, target, task, trees, seed, depth)
    try:
        return dict(zip(names, forest.of(list(range(len(names))))))
    finally:
        forest.release()


def select_from_model(df: DataFrame, target: str, threshold="median", key: list[str] | None = None, trees: int = 100,
                      seed: int = 42, depth: int = 10) -> DataFrame:
    """Features whose forest importance reaches the median, the mean or a number."""
    found = importances(df, target, key, trees, seed, depth)
    values = sorted(found.values())
    if threshold == "median":
        half = len(values) // 2
        cut = values[half] if len(values) % 2 else (values[half - 1] + values[half]) / 2
    else:
        cut = sum(values) / len(values) if threshold == "mean" else float(threshold)
    kept = {n for n, v in found.items() if v >= cut}
    if not kept:
        raise ValueError("SelectFromModel kept no features - lower the threshold.")
    return _keep(df, list(found), kept)


def rfe_select(df: DataFrame, target: str, n_features_to_select: int | None = None, key: list[str] | None = None, step: int = 1,
               trees: int = 80, seed: int = 42, depth: int = 10) -> DataFrame:
    """Drops the ``step`` weakest features per round; all rounds use one table, of the sums of each tree or else of vectors."""
    filled, names, task = _setup(df, target, key)
    wanted = max(1, min(int(n_features_to_select if n_features_to_select is not None else 10), len(names)))
    forest = _Importances(filled, names, target, task, trees, seed, depth)
    left = list(range(len(names)))
    while len(left) > wanted:
        values = forest.of(left)
        drop = min(max(1, step), len(left) - wanted)
        weakest = sorted(range(len(left)), key=lambda i: (values[i], -left[i]))[:drop]
        left = [f for i, f in enumerate(left) if i not in weakest]
    forest.release()
    return _keep(df, names, {names[i] for i in left})


def fit_pca(df: DataFrame, n_components=None, target: str | None = None, key: list[str] | None = None) -> Fitted:
    """Components of the standardised numeric columns; below 1 the number is a share of variance.

    Signs are fixed so that each component's largest loading is positive.
    """
    names = numeric_columns(df, exclude=[n for n in [target, *(key or [])] if n])
    if len(names) < 2:
        raise ValueError("Need at least 2 numeric columns for PCA.")
    medians = exact_quantiles(df, names, [0.5])
    fill = lambda other: other.select(*[c(n) for n in other.columns if n not in names],
                                      *[F.coalesce(c(n).cast("double"), F.lit(medians[n][0] or 0.0)).alias(n) for n in names])
    scaler = fit_standard_scale(fill(df), names)
    wanted = n_components if n_components is not None else min(5, len(names))
    count = len(names) if wanted < 1 else min(int(wanted), len(names))
    assembler = VectorAssembler(inputCols=names, outputCol="_x")
    model = PCA(k=count, inputCol="_x", outputCol="_pc").fit(assembler.transform(scaler.transform(fill(df))).select("_x"))
    shares = model.explainedVariance.toArray().tolist()
    if wanted < 1:
        total, count = 0.0, 0
        while count < len(shares) and total < wanted:
            total += shares[count]
            count += 1
    loadings = model.pc.toArray()[:, :count]
    signs = [1.0 if column[abs(column).argmax()] >= 0 else -1.0 for column in loadings.T]

    def apply(other: DataFrame) -> DataFrame:
        ready = scaler.transform(fill(other))
        kept = [c(n) for n in other.columns if n not in names]
        parts = []
        for i in range(count):
            total = F.lit(0.0)
            for n, w in zip(names, loadings[:, i]):
                total = total + c(n) * F.lit(float(w * signs[i]))
            parts.append(total.alias(f"pc_{i + 1}"))
        return ready.select(*kept, *parts)

    return Fitted(apply, {"explained_variance": shares[:count], "loadings": loadings})


def pca(df: DataFrame, n_components=None, target: str | None = None, key: list[str] | None = None) -> DataFrame:
    return fit_pca(df, n_components, target, key).transform(df)
