"""Helpers shared by the operators: shared folders, training samples, folds and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.session import cut_lineage

FOLD_STEPS = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches: ``spark.checkpoint.dir``; a local master (tests) may fall back to a fresh temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tabloom-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: a lineage cut that survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def held_out(key: Column) -> Column:
    """True for the evaluation fifth: crc32 of the key as text divisible by five. A NULL key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def hash_share(key: Column, share: Column | float, seed: int = 0) -> Column:
    """True for about ``share`` of the keys, the same keys on every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(FOLD_STEPS)) < F.lit(FOLD_STEPS) * share


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows_per_class: int, max_chars: int, *, id_col: str = "doc_id",
                    text_col: str = "text", seed: int = 0) -> DataFrame:
    """``(text, label)`` of labelled documents outside the held-out fifth, about ``rows_per_class`` of each class at most.

    Rows with a NULL id or label are not used, nor are texts longer than ``max_chars``: the training sample, not the scored data, is
    bounded. The chosen ids are at most ``2 * rows_per_class`` in expectation, so they are broadcast.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"))))
    totals = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for value, total in totals.items():
        chosen = chosen | ((F.col("label") == value) & hash_share(F.col("id"), min(1.0, rows_per_class / total), seed))
    picked = known.where(chosen).groupBy("id").agg(F.max("label").alias("label"))
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.where(F.length("text") <= max_chars).join(F.broadcast(picked), "id").select("text", "label")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges ``(a, b)``: ``(node, component)`` with the smallest node reachable.

    Alternating large-star and small-star rounds: each round only groups by node for a minimum and joins it back, so no component is
    ever held in one task, and the number of rounds grows with the logarithm of the largest component. NULL ends and loops are left out.
    """
    def undirected(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()

    def state(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    current = cut_lineage(undirected(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())))
    before = state(current)
    for _ in range(max_rounds):
        if before["n"] == 0:
            break
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where(F.col("b") > F.col("a")).join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = cut_lineage(undirected(large))
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        current = cut_lineage(undirected(small))
        after = state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal ``keys`` from batches sorted by them; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys)))
        start = 0
        for at in range(len(marks)):
            if at and marks[at] == marks[at - 1]:
                continue
            if at == 0 and marks[0] == last:
                continue
            if at > start:
                held.append(batch.slice(start, at - start))
            if held:
                yield pa.Table.from_batches(held)
                held = []
            start = at
        held.append(batch.slice(start))
        last = marks[-1]
    if held:
        yield pa.Table.from_batches(held)
