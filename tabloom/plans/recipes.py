"""Named operators chained into replayable recipes; evaluation stays lazy until a sink or a fit."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tabloom.operators import aggregate, clean, dates, encode, impute, isolation, panel, resample, scale, selection, text
from tabloom.operators.describe import quality_recommendations
from tabloom.session import cut_lineage

OPERATORS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (
        clean.select_columns, clean.drop_columns, clean.rename_columns, clean.drop_duplicates, clean.drop_high_missing, clean.drop_constant,
        clean.drop_correlated, clean.filter_outliers, clean.zscore_outlier_removal, clean.clip_values, clean.winsorize,
        isolation.isolation_forest_outliers, impute.impute_missing, impute.constant_impute, impute.knn_impute, impute.iterative_impute,
        impute.add_missing_indicators, dates.datetime_parse, dates.encode_dates, encode.one_hot_encode, encode.ordinal_encode,
        encode.label_encode, encode.frequency_encode, encode.target_encode, encode.hash_encode, scale.standard_scale, scale.minmax_scale,
        scale.robust_scale, scale.max_abs_scale, scale.power_transform, scale.quantile_transform, scale.log_transform,
        scale.target_log_transform, scale.bin_numeric, scale.interaction_features, scale.polynomial_features, scale.cyclical_encode,
        scale.fourier_features, aggregate.groupby_aggregate, panel.dense_panel, panel.create_lag_features, panel.create_rolling_features,
        panel.create_lead_target, text.text_clean, text.text_length_features, text.count_vectorize, text.tfidf_vectorize, text.lsa_text,
        selection.select_k_best, selection.select_from_model, selection.rfe_select, selection.pca, resample.random_oversample,
        resample.random_undersample, resample.smote, resample.borderline_smote, resample.adasyn, resample.smote_tomek, resample.smote_enn)}

# the order stages should come in: cleaning, outliers, encoding, scaling, generation, selection, resampling
STAGES = {
    "cleaning": ("drop_duplicates", "drop_high_missing", "drop_constant", "drop_correlated", "impute_missing", "constant_impute", "knn_impute",
                 "iterative_impute", "add_missing_indicators", "text_clean", "text_length_features"),
    "outliers": ("filter_outliers", "zscore_outlier_removal", "isolation_forest_outliers", "winsorize", "clip_values"),
    "encoding": ("datetime_parse", "encode_dates", "cyclical_encode", "one_hot_encode", "ordinal_encode", "label_encode", "frequency_encode", "target_encode", "hash_encode"),
    "scaling": ("log_transform", "target_log_transform", "standard_scale", "minmax_scale", "robust_scale", "max_abs_scale", "power_transform",
                "quantile_transform"),
    "generation": ("bin_numeric", "interaction_features", "polynomial_features", "fourier_features", "groupby_aggregate", "dense_panel",
                   "create_lag_features", "create_rolling_features", "create_lead_target"),
    "selection": ("select_k_best", "select_from_model", "rfe_select", "pca"),
    "resampling": ("random_oversample", "random_undersample", "smote", "borderline_smote", "adasyn", "smote_tomek", "smote_enn"),
}

LINEAGE = "step int, parent int, operation string, params string, columns_before int, columns_after int, rows_before long, rows_after long"

_functions: dict[str, Callable[..., DataFrame]] = {}


def register_function(name: str, fn: Callable[..., DataFrame]) -> None:
    """A user function ``fn(df, **params) -> DataFrame`` as a named step; it may use pandas_udf,
    applyInPandas or mapInPandas."""
    if name in OPERATORS:
        raise ValueError(f"'{name}' is a built-in operation.")
    _functions[name] = fn


def select_expressions(df: DataFrame, expressions: list[str]) -> DataFrame:
    """A list of SQL expressions as a step."""
    return df.selectExpr(*expressions)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint between steps."""
    return cut_lineage(df)


OPERATORS["select_expressions"] = select_expressions
OPERATORS["materialize"] = materialize


def apply_operation(df: DataFrame, name: str, params: dict | None = None) -> DataFrame:
    operation = OPERATORS.get(name) or _functions.get(name)
    if operation is None:
        raise ValueError(f"No operation is called {name!r}.")
    out = operation(df, **(params or {}))
    if not isinstance(out, DataFrame):
        raise ValueError(f"Operation '{name}' must return a DataFrame.")
    return out


@dataclass
class Recipe:
    """Ordered (operation, parameters) steps."""

    steps: list[tuple[str, dict]] = field(default_factory=list)

    def run(self, df: DataFrame, ordered: bool = False) -> DataFrame:
        return self.run_with_lineage(df, ordered)[0]

    def run_with_lineage(self, df: DataFrame, ordered: bool = False, count_rows: bool = False) -> tuple[DataFrame, DataFrame]:
        """(result, lineage rows); ``ordered`` first puts the steps in stage order.

        ``parent`` is the step whose output a step reads, 0 the input. ``count_rows`` costs a job per step; without it row counts are NULL.
        """
        rows, before = [], df.count() if count_rows else None
        steps = self.in_stage_order().steps if ordered else self.steps
        spark = df.sparkSession
        for i, (name, params) in enumerate(steps, 1):
            out = apply_operation(df, name, params)
            after = out.count() if count_rows else None
            rows.append((i, i - 1, name, json.dumps(params, default=str), len(df.columns), len(out.columns), before, after))
            df, before = out, after
        return df, spark.createDataFrame(rows, LINEAGE)

    def in_stage_order(self) -> "Recipe":
        """Stable sort by stage; operations outside the stages keep their place after their predecessor."""
        place, last = [], -1
        where = {op: i for i, ops in enumerate(STAGES.values()) for op in ops}
        for name, params in self.steps:
            last = where.get(name, last)
            place.append((last, (name, params)))
        return Recipe([step for _, step in sorted(place, key=lambda t: t[0])])

    @staticmethod
    def replay(lineage: DataFrame) -> "Recipe":
        """The recipe behind a lineage table."""
        return Recipe([(r["operation"], json.loads(r["params"])) for r in lineage.orderBy("step").collect()])


def forecast_recipe(time_column: str, group_by: list[str], value: str, freq: str = "M", lags=(1, 3, 12), windows=(3, 6, 12), leads=(1,),
                    calendar: bool = False, aggregations: dict | None = None, rolling: tuple[str, ...] = ("mean",),
                    encode: list[str] | None = None) -> Recipe:
    """Dense panel, lags, previous-row rolling statistics and lead targets.

    When asked, ``aggregations`` first bring the input to one row per group and time (``value`` is then the aggregate's name), ``calendar``
    adds cycles of the year, and the group columns in ``encode`` are target-encoded by ``value`` last. The time column stays, for a
    chronological split by ``train_candidates``.

    The aggregated input is materialised before the panel and the panel before its windows, so the
    large tables behind them are scanned once.
    """
    keys = {"group_by": list(group_by), "time_column": time_column}
    steps = [("groupby_aggregate", {"group_by": [*group_by, time_column], "aggregations": aggregations})] if aggregations else []
    steps += [("materialize", {}),
             ("dense_panel", {**keys, "freq": freq, "fill_value": 0}),
             ("materialize", {}),
             ("create_lag_features", {**keys, "column": value, "lags": list(lags)}),
             *[("create_rolling_features", {**keys, "column": value, "windows": list(windows), "agg": how}) for how in rolling]]
    steps.append(("create_lead_target", {**keys, "column": value, "leads": list(leads)}))
    if calendar:
        steps.append(("fourier_features", {"column": time_column, "period": 365.25, "order": 2}))
    if encode:
        steps.append(("target_encode", {"columns": list(encode), "target_column": value}))
    return Recipe(steps)


def recipe(kind: str, df: DataFrame, target: str, key: list[str], text_column: str | None = None) -> Recipe:
    """The standard sequence for a task, with the steps its measured quality calls for."""
    if kind not in {"classification", "regression", "text"}:
        raise ValueError("kind must be 'classification', 'regression' or 'text' (forecast_recipe for panels).")
    features = df.drop(*key)
    if kind != "text":  # measured in many passes; texts would be written for a few
        features = cut_lineage(features)
    found: dict[str, list] = {}
    for r in quality_recommendations(features, target).collect():
        found.setdefault(r["finding"], []).append(r["column"])
    # later steps are fitted, so each of them reads its input
    steps: list[tuple[str, dict]] = [("drop_duplicates", {}), ("materialize", {})]
    if "missing > 50 %" in found:
        steps.append(("drop_high_missing", {"threshold": 0.5}))
    if "constant" in found:
        steps.append(("drop_columns", {"columns": found["constant"]}))
    if kind == "text":
        steps += [("text_clean", {"columns": [text_column]}), ("text_length_features", {"columns": [text_column]}),
                  ("lsa_text", {"column": text_column, "key": key[0], "n_components": 20, "max_features": 200})]
    gone = set(found.get("missing > 50 %", [])) | set(found.get("constant", [])) | {target, text_column}
    gaps = [n for f in ("missing 5-50 %",) for n in found.get(f, []) if n not in gone]
    if gaps:
        steps.append(("add_missing_indicators", {"columns": gaps}))
    steps.append(("impute_missing", {}))
    wide = [n for n in found.get("outlier rate > 10 %", []) if n not in gone]
    if wide:
        steps.append(("winsorize", {"columns": wide}))
    many = [n for n in found.get("cardinality > 50", []) if n not in gone]
    few = [n for f in ("cardinality 5-50", "cardinality < 5") for n in found.get(f, []) if n not in gone]
    if kind == "regression" and target in found.get("skewness > 1.5", []):
        steps.append(("target_log_transform", {"column": target}))
    if few:
        steps.append(("one_hot_encode", {"columns": few}))
    if many:
        steps.append(("hash_encode", {"columns": many, "n_features": 16, "expand": True}))
    steps.append(("standard_scale", {"exclude": [target, *key]}))
    if kind == "classification" and "class imbalance > 5" in found:
        steps.append(("random_oversample", {"target": target, "key": key}))
    return Recipe(steps)


def merge_patches(log: DataFrame, index: str, patch: str, answers: str, order_by: list[str]) -> DataFrame:
    """Steps with the answers of their last patch. Rows where ``patch`` is true carry answers for the
    step of the same index; the last one along ``order_by`` wins."""
    is_patch = F.coalesce(F.col(patch), F.lit(False))
    steps = log.where(~is_patch).drop(patch)
    wins = F.struct(*[F.col(n) for n in order_by])
    last = log.where(is_patch).groupBy(F.col(index)).agg(F.max_by(F.struct(F.col(answers).alias("a")), wins).alias("_last"))
    joined = steps.join(last, index, "left")
    return joined.select(*[F.when(F.col("_last").isNotNull(), F.col("_last.a")).otherwise(F.col(n)).alias(n) if n == answers else F.col(n)
                           for n in steps.columns])
