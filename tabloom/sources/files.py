"""Delimited, JSON and Parquet files, and the dataset sink with its metadata table."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabloom.functions.columns import nan_to_null

DATASETS = ("dataset_id string, name string, source_name string, source_type string, file_path string, parent string, "
            "operation string, row_count long, column_count int, uploaded_at timestamp")


def _not_empty(df: DataFrame, path: str) -> DataFrame:
    if not df.columns or df.isEmpty():
        raise ValueError(f"The dataset at {path} is empty.")
    return nan_to_null(df)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """Header CSV; a declared schema spares the inference pass over the files."""
    reader = spark.read.option("header", "true").option("sep", sep).option("escape", '"').option("multiLine", "false")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)
    return _not_empty(df, str(path))


def flatten_structs(df: DataFrame) -> DataFrame:
    """Nested objects become dotted columns; arrays stay arrays."""
    def leaves(kind: T.StructType, path: tuple[str, ...]):
        for f in kind.fields:
            here = path + (f.name,)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here))
    return df.select(*leaves(df.schema, ()))


def read_json(spark: SparkSession, path: str | list[str], multi_line: bool = True,
              schema: T.StructType | str | None = None) -> DataFrame:
    """Records, one array per file (``multi_line``) or one object per line (splittable)."""
    reader = spark.read.option("multiLine", str(multi_line).lower())
    return _not_empty(flatten_structs((reader.schema(schema) if schema else reader).json(path)), str(path))


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def load_dataset(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Reader by file ending."""
    from tabloom.sources.excel import read_excel
    from tabloom.sources.sqlite import read_sqlite

    ending = path.rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv, "json": read_json, "parquet": read_parquet, "xlsx": read_excel}
    if ending in readers:
        return readers[ending](spark, path)
    if ending in ("db", "sqlite", "sqlite3"):
        return read_sqlite(spark, path, table)
    raise ValueError(f"Unsupported file type '.{ending}'.")


def write_dataset(df: DataFrame, root: str, name: str, operation: str = "", parent: str = "", source_type: str = "derived") -> dict:
    """Parquet under ``root`` plus a metadata row; the row count comes from the written footers."""
    if not df.columns:
        raise ValueError("The operation produced an empty dataset.")
    dataset_id = f"{name}_{uuid.uuid4().hex[:8]}"
    path = f"{root}/data/{dataset_id}"
    df.write.mode("errorifexists").parquet(path)
    # answered from the footers of the files just written. An Observation would leave its manager in the
    # session, which later ML fits then fail to serialize.
    rows = df.sparkSession.read.parquet(path).count()
    if rows == 0:
        raise ValueError("The operation produced an empty dataset.")
    record = {"dataset_id": dataset_id, "name": name, "source_name": name, "source_type": source_type, "file_path": path,
              "parent": parent, "operation": operation, "row_count": rows, "column_count": len(df.columns),
              "uploaded_at": datetime.datetime.now(datetime.timezone.utc)}
    (df.sparkSession.createDataFrame([tuple(record.values())], DATASETS).coalesce(1)
     .write.mode("append").parquet(f"{root}/datasets"))
    return record


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Registered datasets, latest first."""
    return spark.read.schema(DATASETS).parquet(f"{root}/datasets").orderBy(F.desc("uploaded_at"), "dataset_id")


def write_splits(train: DataFrame, test: DataFrame, root: str, run_id: str) -> dict[str, str]:
    """Train and test rows of a run, beside its model."""
    paths = {"train": f"{root}/runs/{run_id}/train", "test": f"{root}/runs/{run_id}/test"}
    train.write.mode("errorifexists").parquet(paths["train"])
    test.write.mode("errorifexists").parquet(paths["test"])
    return paths
