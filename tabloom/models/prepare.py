"""Preprocessing fitted on the training rows only, as a saveable pipeline of Spark ML stages."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.functions.columns import c, datetime_columns, is_numeric
from tabloom.operators.impute import mode_values
from tabloom.operators.quantiles import exact_quantiles

HASH_SLOTS = 1 << 18


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_text(value) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def numeric_features(df: DataFrame, features: list[str]) -> list[str]:
    return [n for n in features if is_numeric(df, n) or isinstance(df.schema[n].dataType, T.BooleanType) or n in datetime_columns(df)]


def _as_double(df: DataFrame, name: str) -> str:
    if name in datetime_columns(df):
        return f"CAST(unix_micros(CAST({_sql_name(name)} AS TIMESTAMP)) AS DOUBLE) / 1000000"
    return f"CAST({_sql_name(name)} AS DOUBLE)"


def build_preprocessor(train: DataFrame, features: list[str], output: str = "features", hashed_columns: tuple[str, ...] = ()) -> PipelineModel:
    """Median fill and standardising for numbers, flags and dates (as seconds); mode fill and one-hot
    for the rest, values unseen in training becoming all zeros.

    One-hot vectors are sparse, so any number of levels is indexed; the columns in ``hashed_columns`` are hashed to HASH_SLOTS slots instead.
    """
    if not features:
        raise ValueError("There is no feature column.")
    numeric = numeric_features(train, features)
    other = [n for n in features if n not in numeric]
    pieces = ["*"]
    if numeric:
        plain = train.select(*[F.expr(_as_double(train, n)).alias(n) for n in numeric])
        medians = exact_quantiles(plain, numeric, [0.5])
        fill = {n: medians[n][0] if medians[n][0] is not None else 0.0 for n in numeric}
        filled = plain.select(*[F.coalesce(c(n), F.lit(fill[n])).alias(n) for n in numeric])
        stats = filled.agg(*[a for i, n in enumerate(numeric) for a in (
            F.avg(c(n)).alias(f"m{i}"), F.stddev_pop(c(n)).alias(f"s{i}"))]).first()
        for i, n in enumerate(numeric):
            mean, spread = stats[f"m{i}"] or 0.0, stats[f"s{i}"] or 1.0
            pieces.append(f"(coalesce({_as_double(train, n)}, {fill[n]!r}D) - ({mean!r}D)) / ({spread!r}D) AS `_num_{i}`")
    index, hashed = [], []
    modes = mode_values(train.select(*[c(n).cast("string").alias(n) for n in other]), other) if other else {}
    for i, n in enumerate(other):
        pieces.append(f"coalesce(CAST({_sql_name(n)} AS STRING), {_sql_text(modes[n] or '')}) AS `_cat_{i}`")
        (hashed if n in hashed_columns else index).append(i)
    stages = [SQLTransformer(statement=f"SELECT {', '.join(pieces)} FROM __THIS__")]
    if index:
        stages.append(StringIndexer(inputCols=[f"_cat_{i}" for i in index], outputCols=[f"_idx_{i}" for i in index],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        # the extra "unseen" level is the last one, so dropLast leaves it without a slot
        stages.append(OneHotEncoder(inputCols=[f"_idx_{i}" for i in index], outputCols=[f"_hot_{i}" for i in index], dropLast=True))
    if hashed:
        stages.append(FeatureHasher(inputCols=[f"_cat_{i}" for i in hashed], outputCol="_hash", numFeatures=HASH_SLOTS))
    assembled = [f"_num_{i}" for i in range(len(numeric))] + [f"_hot_{i}" for i in index] + (["_hash"] if hashed else [])
    stages.append(VectorAssembler(inputCols=assembled, outputCol=output))
    return Pipeline(stages=stages).fit(train)


def feature_labels(prepared: DataFrame, features: list[str], source: DataFrame, output: str = "features") -> list[str]:
    """Readable name of every slot of the feature vector."""
    numeric = numeric_features(source, features)
    other = [n for n in features if n not in numeric]
    attributes = prepared.schema[output].metadata.get("ml_attr", {}).get("attrs", {})
    named = {a["idx"]: a.get("name", str(a["idx"])) for group in attributes.values() for a in group}
    out = []
    for i in range(prepared.schema[output].metadata.get("ml_attr", {}).get("num_attrs", len(named))):
        raw = named.get(i, str(i))
        parts = raw.split("_", 3)
        if raw.startswith("_num_"):
            out.append(numeric[int(raw[5:])])
        elif raw.startswith("_hot_"):
            out.append(f"{other[int(parts[2])]}_{parts[3]}")
        else:
            out.append(raw)
    return out


def drop_scratch(df: DataFrame) -> DataFrame:
    """Without the intermediate columns of the pipeline."""
    return df.drop(*[n for n in df.columns if n.startswith(("_num_", "_cat_", "_idx_", "_hot_")) or n == "_hash"])
