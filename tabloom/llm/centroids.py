"""Centroid clustering of integer vectors: Lloyd's rounds with bounds loosened by the norm of a centroid's whole displacement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import written
from tabloom.llm.integers import finite, floored, grouped, rows_of, squared, totals

MARGIN = 1e-12  # relative allowance for the roots; what lies within it is evaluated exactly


class Histories:
    """All centroids after every round, and how far each now lies from where it was then."""

    def __init__(self, rounds: Sequence[np.ndarray]):
        self.now, self.centres = len(rounds) - 1, rounds[-1]
        self.moved = np.stack([np.sqrt(((self.centres - then).astype(np.float64) ** 2).sum(axis=1)) for then in rounds])

    def settle(self, x: np.ndarray, cluster: np.ndarray, seen: np.ndarray, when: np.ndarray) -> np.ndarray:
        """New clusters of rows ``x``; ``seen`` holds the squared distances last evaluated and ``when`` their rounds, both updated in place.

        A distance seen in round t has changed by no more than the centroid's displacement since t, one norm of one vector, however many
        rounds lie between. Rows whose own loosened distance stays below all other loosened ones keep their cluster; for the others the own
        distance is evaluated, and then each centroid that it does not rule out.
        """
        rows, every = np.arange(len(x)), np.arange(len(self.centres))
        root, drift = np.sqrt(seen.astype(np.float64)), self.moved[when, every]
        least = root * (1 - MARGIN) - drift * (1 + MARGIN)
        own = (root + drift)[rows, cluster] * (1 + MARGIN)
        rival = least <= own[:, None]
        rival[rows, cluster] = False
        some = np.flatnonzero(rival.any(axis=1))
        mine = cluster[some]
        seen[some, mine], when[some, mine] = ((x[some] - self.centres[mine]) ** 2).sum(axis=1), self.now
        rival[some] &= least[some] <= (np.sqrt(seen[some, mine].astype(np.float64)) * (1 + MARGIN))[:, None]
        for k in np.flatnonzero(rival.any(axis=0)):
            asked = np.flatnonzero(rival[:, k])
            seen[asked, k], when[asked, k] = ((x[asked] - self.centres[k]) ** 2).sum(axis=1), self.now
        some = np.flatnonzero(rival.any(axis=1))
        rival[some, cluster[some]] = True
        out = cluster.copy()
        out[some] = np.where(rival[some], seen[some], np.iinfo(np.int64).max).argmin(axis=1)  # ties: the smaller number
        return out


def _matrix(column, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _binaries(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


COLUMNS = ["id", "vector", "before", "cluster", "seen", "when", "rescans"]


def _first(centres: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(1), size)
            seen = squared(x, centres)
            cluster = seen.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            none = pa.nulls(len(x), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), _binaries(x.astype("<i4")), none, pa.array(cluster, pa.int32()), _binaries(seen.astype("<i8")),
                                              _binaries(np.zeros(seen.shape, np.uint8)), pa.array(np.zeros(len(x), np.int64))], COLUMNS)
    return run


def _round(history: Histories):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), "<i4").astype(np.int64)
            before = batch.column(3).to_numpy().astype(np.int64)
            seen, when = _matrix(batch.column(4), "<i8").copy(), _matrix(batch.column(5), "u1").copy()
            cluster = history.settle(x, before, seen, when)
            rescans = batch.column(6).to_numpy() + (when == history.now).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(cluster, pa.int32()), _binaries(seen), _binaries(when),
                                              pa.array(rescans)], COLUMNS)
    return run


def _changes(size: int):
    """What the rows that changed their cluster add to the sums of the new one and take from those of the old one, a task's in one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch.column(0), "<i4").astype(np.int64).reshape(-1, size)
            for column, sign in ((2, 1), (1, -1)):
                there = batch.column(column).is_valid().to_numpy(zero_copy_only=False)
                for k, n, s in zip(*grouped(batch.column(column).filter(pa.array(there)).to_numpy(), x[there])):
                    counts[k] = counts.get(k, 0) + sign * int(n)
                    sums[k] = sums.get(k, np.zeros(size, np.int64)) + sign * s
        keys = sorted(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([counts[k] for k in keys], pa.int64()),
                                          pa.array([sums[k].tolist() for k in keys], pa.list_(pa.int64()))], ["cluster", "n", "sums"])
    return run


def _distances(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gaps = _matrix(batch.column(1), "<i4").astype(np.int64) - centres[batch.column(2).to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array((gaps * gaps).sum(axis=1)), batch.column(3)],
                                                 ["id", "cluster", "distance", "rescans"])
    return run


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, clusters: int = 16, rounds: int = 3, size: int = 64,
                    scale: int = 64, seed: int = 1) -> DataFrame:
    """Clusters vectors by Lloyd's rounds on the integers ``floor(scale * x)``, exactly.

    Returns, per kept vector, ``(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256, rescans)``: the squared distance to its
    centroid, its sum over the cluster and over all, the hash of the centroid's components, and how many distances the rounds after the
    first evaluated for it. Centroids start as the vectors with the smallest sha256 of ``seed:id``. A round assigns every vector to the
    nearest centroid (ties: smaller number), then replaces each non-empty centroid by the floor of its mean; one more assignment ends it.

    - Every centroid's history is kept. A vector keeps the exact squared distances it has evaluated and their rounds; a bound is loosened by
      the norm of the centroid's displacement since that round, not by the sum of its moves. What bounds do not settle is evaluated exactly.
    - A round is one map over the written state (vector, ``9 * clusters`` bytes of bounds); sums change by the rows that changed cluster only,
      added up within tasks, then by Spark. The driver holds ``clusters * size * rounds`` numbers. At most 255 rounds.

    Vectors that are NULL, have another length, or hold NULL or non-finite components are left out; zero vectors are kept. Repeated rows count
    as often as they occur, rows with a NULL id are clustered and start no centroid unless others are lacking; equal hashes go by vector.
    Components beyond 2^26 after scaling raise an error, for distances must fit 64 bits. With fewer vectors than ``clusters`` there are as
    many centroids as vectors; an empty table gives no rows. Extra columns are ignored.
    """
    if not 1 <= rounds <= 255:
        raise ValueError("rounds must lie between 1 and 255")
    kind, spark = dict(df.dtypes)[id_col], df.sparkSession
    kept = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where((F.size("v") == size) & finite("v"))
    kept = kept.select("id", floored("v", scale).alias("v"))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(clusters).collect()
    if not first:
        schema = f"{id_col} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, rescans bigint"
        return spark.createDataFrame([], schema)
    centres = [np.array([r["v"] for r in first], np.int64)]
    state_schema = f"id {kind}, vector binary, before int, cluster int, seen binary, when binary, rescans bigint"
    state = written(kept.mapInArrow(_first(centres[0], size), state_schema), "clusters")
    counts, sums = [0] * len(first), [[0] * size for _ in first]
    for _ in range(rounds):
        changed = state.where(~F.col("cluster").eqNullSafe(F.col("before"))).select("vector", "before", "cluster")
        partial = written(changed.mapInArrow(_changes(size), "cluster int, n bigint, sums array<bigint>"), "changes")
        for (k,), (n, s) in totals(partial, ["cluster"]).items():
            counts[k], sums[k] = counts[k] + n, [a + b for a, b in zip(sums[k], s)]
        centres.append(np.array([[x // n for x in s] if n else old.tolist() for n, s, old in zip(counts, sums, centres[-1])], np.int64))
        state = written(state.mapInArrow(_round(Histories(centres)), state_schema), "clusters")
    near = state.select("id", "vector", "cluster", "rescans").mapInArrow(_distances(centres[-1]), f"id {kind}, cluster int, distance bigint, rescans bigint")
    near = written(near, "distances")
    inertia = {r["cluster"]: int(r["d"]) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres[-1]]
    at = F.col("cluster") + 1
    return near.select(F.col("id").alias(id_col), "cluster", "distance",
                       F.element_at(F.array(*[F.lit(inertia.get(k, 0)).cast("bigint") for k in range(len(first))]), at).alias("cluster_inertia"),
                       F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
                       F.element_at(F.array(*map(F.lit, digests)), at).alias("centroid_sha256"), "rescans")
