"""SQLite tables as a Python data source: one input partition per rowid range of each file."""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual)

ROWS_PER_PARTITION = 500_000
ROWS_PER_BATCH = 10_000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _files(path: str) -> list[str]:
    found = sorted(glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path))
    found = [f for f in found if os.path.isfile(f) and not os.path.basename(f).startswith((".", "_"))]
    if not found:
        raise ValueError(f"no SQLite file at {path}")
    return found


def _tables(path: str) -> list[str]:
    with _connect(path) as db:
        rows = db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")
        return [r[0] for r in rows]


def _spark_type(declared: str) -> T.DataType:
    kind = (declared or "").upper()
    if "INT" in kind:
        return T.LongType()
    if any(k in kind for k in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return T.DoubleType()
    if "BLOB" in kind:
        return T.BinaryType()
    return T.StringType()


def _columns(path: str, table: str) -> dict[str, T.DataType]:
    with _connect(path) as db:
        return {r[1]: _spark_type(r[2]) for r in db.execute(f"PRAGMA table_info({_quoted(table)})")}


def _common(a: T.DataType | None, b: T.DataType) -> T.DataType:
    """The type that holds a column declared differently in two files."""
    if a is None or a == b:
        return b
    return T.DoubleType() if {type(a), type(b)} == {T.LongType, T.DoubleType} else T.StringType()


_ARROW = {T.LongType: (pa.int64(), int), T.DoubleType: (pa.float64(), float), T.StringType: (pa.string(), str), T.BinaryType: (pa.binary(), bytes)}


def _array(values: Sequence, kind: T.DataType) -> pa.Array:
    """One column of a batch; values stored under another type than the declared one are converted one by one."""
    arrow, convert = _ARROW[type(kind)]
    try:
        return pa.array(values, arrow)
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        return pa.array([None if v is None else convert(v.encode() if convert is bytes and isinstance(v, str) else v) for v in values], arrow)


class RowidRange(InputPartition):
    def __init__(self, path: str, low: int | None, high: int | None):
        self.path, self.low, self.high = path, low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, files: list[str], table: str, rows_per_partition: int):
        self.schema, self.files, self.table, self.step = schema, files, table, rows_per_partition
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        compare = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            plain = len(f.attribute) == 1 if hasattr(f, "attribute") else False
            kind = type(self.schema[f.attribute[0]].dataType) if plain and f.attribute[0] in self.schema.names else None
            name = _quoted(f.attribute[0]) if plain else None
            if kind not in (T.LongType, T.DoubleType, T.StringType):
                yield f
            elif type(f) in compare and isinstance(f.value, (int, float, str)):
                self.where.append((f"{name} {compare[type(f)]} ?", [f.value]))
            elif isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value) and 0 < len(f.value) < 500:
                self.where.append((f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif isinstance(f, IsNull):
                self.where.append((f"{name} IS NULL", []))
            elif isinstance(f, IsNotNull):
                self.where.append((f"{name} IS NOT NULL", []))
            else:
                yield f

    def partitions(self):
        out = []
        for path in self.files:
            with _connect(path) as db:
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:  # a WITHOUT ROWID table is read whole
                    out.append(RowidRange(path, None, None))
                    continue
            if low is not None:
                out += [RowidRange(path, at, min(at + self.step - 1, high)) for at in range(low, high + 1, self.step)]
        return out or [RowidRange(self.files[0], None, None)]

    def read(self, partition: RowidRange) -> Iterator[pa.RecordBatch]:
        there = _columns(partition.path, self.table)
        wanted = ", ".join(_quoted(n) if n in there else f"NULL AS {_quoted(n)}" for n in self.schema.names)
        inner, values = f"SELECT {wanted} FROM {_quoted(self.table)}", []
        if partition.low is not None:
            inner += " WHERE rowid BETWEEN ? AND ?"
            values += [partition.low, partition.high]
        # conditions see the selected columns, so that one a file lacks is NULL there
        sql = f"SELECT * FROM ({inner})" + (f" WHERE {' AND '.join(w for w, _ in self.where)}" if self.where else "")
        values += [v for _, vs in self.where for v in vs]
        kinds = [f.dataType for f in self.schema.fields]
        with _connect(partition.path) as db:
            found = db.execute(sql, values)
            while rows := found.fetchmany(ROWS_PER_BATCH):
                yield pa.RecordBatch.from_arrays([_array(column, kind) for column, kind in zip(zip(*rows), kinds)], self.schema.names)


class SqliteSource(DataSource):
    """Options: path (file, folder or glob every executor can reach), table, rows_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _table(self) -> tuple[str, list[str]]:
        """The table asked for, or the first by name, and the files that have it."""
        found = {f: _tables(f) for f in _files(self.options["path"])}
        names = sorted(set().union(*found.values()))
        wanted = self.options.get("table")
        if wanted and wanted not in names:
            raise ValueError(f"No table is called {wanted!r}; there are: {names}")
        if not names:
            raise ValueError("The database is empty.")
        table = wanted or names[0]
        return table, [f for f, tables in found.items() if table in tables]

    def schema(self) -> T.StructType:
        """The columns of all files, in the order they come; a file without one has NULLs there."""
        table, files = self._table()
        columns: dict[str, T.DataType] = {}
        for file in files:
            for name, kind in _columns(file, table).items():
                columns[name] = _common(columns.get(name), kind)
        return T.StructType([T.StructField(n, k) for n, k in columns.items()])

    def reader(self, schema: T.StructType) -> SqliteReader:
        table, files = self._table()
        return SqliteReader(schema, files, table, int(self.options.get("rows_per_partition", ROWS_PER_PARTITION)))


def read_sqlite(spark: SparkSession, path: str, table: str | None = None,
                rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """First table by name when none is given; an unknown table is an error naming the tables."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("path", path).option("rows_per_partition", str(rows_per_partition))
    return (reader.option("table", table) if table else reader).load()


def list_sqlite_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, table, rows) of every user table, ordered by name; tasks open the files and count."""
    files = spark.createDataFrame([(f,) for f in _files(path)], "file string")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for file in batch["file"]:
                tables = _tables(file)
                with _connect(file) as db:
                    found += [(file, t, db.execute(f"SELECT count(*) FROM {_quoted(t)}").fetchone()[0]) for t in tables]
            yield pd.DataFrame(found, columns=["file", "table", "rows"])

    return files.repartition(files.sparkSession.sparkContext.defaultParallelism, "file").mapInPandas(look, "file string, table string, rows long").orderBy("file", "table")


def register_sqlite_tables(spark: SparkSession, path: str) -> list[str]:
    """Every table of the database as a temporary view of its own name."""
    names = _tables(_files(path)[0])
    for n in names:
        read_sqlite(spark, path, n).createOrReplaceTempView(n)
    return names
