"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import components, runs, written

FINE, BATCHES = 512, 8  # hashes of a comparison signature, one byte each, and the batches they are compared in
BLOCK = 512  # members of one bucket that are compared in one piece
WORD_CACHE = 200_000


class _WordHashes(dict):
    """64-bit hashes of words, kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _odd_numbers(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; A-Z lower-cased, words parted by ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    factors = _odd_numbers(words, 11)
    joined = np.zeros(len(parts) - size + 1, np.uint64)
    for k in range(size):
        joined += hashed[k:k + len(joined)] * factors[k]
    return np.unique(_mixed(joined + np.uint64(size)))


def _lowest(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values: the lowest of each hash function over a set."""
    lowest = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 512):
        np.minimum(lowest, (shingles[start:start + 512, None] * factors[None, :] + offsets[None, :]).min(axis=0), out=lowest)
    return lowest


def _band_keys(bands: int, rows: int):
    """Function from a set to a key for each band of its MinHash values."""
    factors, offsets = _odd_numbers(bands * rows, 5), _odd_numbers(bands * rows, 7)
    weights, marks = _odd_numbers(rows, 13), _odd_numbers(bands, 17)

    def keys(shingles: np.ndarray) -> np.ndarray:
        if not len(shingles):
            return np.empty(0, np.int64)
        return _mixed(_mixed(_lowest(shingles, factors, offsets).reshape(bands, rows)) @ weights + marks).view(np.int64)
    return keys


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*values, np.empty(0, np.int64)]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat))


def _sketches(words: int, bands: int, rows: int):
    """Per text: number of shingles, a 128-bit digest of the set, the band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, band_keys = _WordHashes(), _band_keys(bands, rows)
        for batch in batches:
            counts, digests, keys = [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), words, hashes)
                counts.append(len(shingles))
                digests.append(np.array([shingles.sum(), _mixed(shingles).sum()], "<u8").tobytes())
                keys.append(band_keys(shingles))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), _lists(keys)],
                                             ["id", "n_shingles", "digest", "keys"])
    return run


def _details(words: int, bands: int, rows: int):
    """Per text: the signature that pairs are compared by, the band keys, the whole set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors, offsets, band_keys = _WordHashes(), _odd_numbers(FINE, 23), _odd_numbers(FINE, 29), _band_keys(bands, rows)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(text.as_py(), words, hashes) for text in part.column(1)]
                signatures = [(_lowest(x, factors, offsets) >> np.uint64(40)).astype(np.uint8).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signatures, pa.binary()), _lists([band_keys(x) for x in sets]),
                                                  _lists([x.view(np.int64) for x in sets])], ["node", "signature", "keys", "shingles"])
    return run


def least_matches(compared: int, threshold: float, miss: float) -> int:
    """Fewest matches of ``compared`` hashes that leave the pair a chance above ``miss`` of reaching the threshold.

    With a uniform prior the similarity after m matches of n has the posterior Beta(m + 1, n - m + 1), and P(similarity >= t) equals
    P(Binomial(n + 1, t) <= m).
    """
    below, n = 0.0, compared + 1
    for m in range(compared + 1):
        below += math.comb(n, m) * threshold ** m * (1 - threshold) ** (n - m)
        if below >= miss:
            return m
    return compared


def _schedule(threshold: float, miss: float) -> list[tuple[int, int, int]]:
    step = FINE // BATCHES
    return [(start, start + step, least_matches(start + step, threshold, miss)) for start in range(0, FINE, step)]


def _survivors(left: np.ndarray, right: np.ndarray, schedule) -> np.ndarray:
    """Row numbers of signature pairs that no batch of comparisons ruled out."""
    alive, matched = np.arange(len(left)), np.zeros(len(left), np.int32)
    for start, end, least in schedule:
        matched = matched + (left[alive, start:end] == right[alive, start:end]).sum(axis=1, dtype=np.int32)
        keep = matched >= least
        alive, matched = alive[keep], matched[keep]
    return alive


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, FINE)


def _pairs_pruned(schedule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                keep = pa.array(_survivors(_matrix(part.column(2)), _matrix(part.column(3)), schedule))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], ["a", "b"])
    return run


def _blocks_pruned(schedule):
    """Pairs of different classes within a block pair of one bucket that the comparisons leave; a pair comes from its first common bucket only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("bucket", "first", "second")):
            nodes = np.array(group.column("node").to_pylist(), dtype=object)
            classes = np.array(group.column("class").to_pylist(), dtype=object)
            block, first, second = group.column("block").to_numpy(), group.column("first")[0].as_py(), group.column("second")[0].as_py()
            signatures, bucket = _matrix(group.column("signature")), group.column("bucket")[0].as_py()
            keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
            rows, cols = np.flatnonzero(block == first), np.flatnonzero(block == second)
            for start in range(0, len(rows), 64):
                i, j = (x.ravel() for x in np.meshgrid(rows[start:start + 64], cols, indexing="ij"))
                differ = classes[i] != classes[j]
                if first == second:
                    differ &= i < j
                i, j = i[differ], j[differ]
                keep = _survivors(signatures[i], signatures[j], schedule)
                i, j = i[keep], j[keep]
                own = keys[i, (keys[i] == keys[j]).argmax(axis=1)] == bucket
                i, j = i[own], j[own]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[i].tolist(), group.schema.field("node").type),
                                                      pa.array(nodes[j].tolist(), group.schema.field("node").type)], ["a", "b"])
    return run


def _linked(pairs: DataFrame, details: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have ``100 * intersection >= percent * union``."""
    left = details.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = details.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("left", "right")).alias("shared"),
                                                         (F.size("left") + F.size("right")).alias("total"))
    return both.where((F.col("shared") > 0) & (100 * F.col("shared") >= percent * (F.col("total") - F.col("shared")))).select("a", "b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 80, words: int = 5, bands: int = 24,
                    rows: int = 5, miss: float = 1e-5) -> DataFrame:
    """Groups of texts whose sets of ``words``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Returns ``(id_col, n_shingles, component_id, kept)``, one row per input row.

    1. Rows with equal shingle sets are one class (a grouped minimum); only its smallest id goes on.
    2. ``bands`` keys, each of ``rows`` MinHash values, put a class in buckets.
    3. Each member of a bucket is compared with the bucket's smallest member, so candidates grow with the members, not their square.
       Finer signatures are compared in batches; after each, a pair is dropped when its posterior chance of reaching the threshold is
       below ``miss``. Survivors are verified on their full sets; verified links make components.
    4. Pairs of one bucket that lie in different components are compared in blocks of bounded size in the same way. Pairs inside one
       component need no comparison: they cannot change the result.

    A pair at the threshold shares no bucket with chance (1 - t^rows)^bands (8e-7 at 0.85, 7e-5 at 0.8).

    Without words or text the set is empty and linked with nothing; with fewer words than ``words`` the whole sequence is the one shingle.
    Repeated rows fall in one class. An id with several texts is one node: it links with whatever one of them links. Rows with a NULL id
    are linked with nothing, get a NULL component and are kept. Very long texts are read whole; a text's set is held in one task.
    """
    kind, schedule = dict(df.dtypes)[id_col], _schedule(percent / 100, miss)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = written(texts.mapInArrow(_sketches(words, bands, rows), f"id {kind}, n_shingles bigint, digest binary, keys array<bigint>"), "sketches")
    filled = sketched.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = written(filled.groupBy("digest", "n_shingles").agg(F.min("id").alias("node")), "classes")
    first = filled.select("digest", F.col("id").alias("node"), "keys").join(classes.select("digest", "node"), ["digest", "node"], "left_semi")

    members = first.select("node", F.explode("keys").alias("bucket")).distinct()
    pivots = members.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    members = written(members.join(pivots, "bucket"), "buckets")
    met = members.select(F.col("node").alias("id")).distinct()
    details = written(texts.join(met.hint("merge"), "id", "left_semi").mapInArrow(_details(words, bands, rows),
                      f"node {kind}, signature binary, keys array<bigint>, shingles array<bigint>"), "details")

    starred = members.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    left = details.select(F.col("node").alias("a"), F.col("signature").alias("left"))
    right = details.select(F.col("node").alias("b"), F.col("signature").alias("right"))
    signed = starred.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    pairs = written(signed.mapInArrow(_pairs_pruned(schedule), f"a {kind}, b {kind}"), "survivors")
    links = written(_linked(pairs, details, percent), "links")
    found = written(components(links), "components")

    split = members.join(found, "node", "left").select("bucket", "node", "pivot", "members", F.coalesce("component", "node").alias("class"))
    mixed = split.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.first("members").alias("members"))
    mixed = mixed.where("low != high and members > 2").select("bucket")
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    rest = (split.join(mixed, "bucket").withColumn("blocks", blocks)
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(details.select("node", "signature", "keys"), "node")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("bucket", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "node", "class", "block", "signature", "keys"))
    rest = rest.repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")
    crossed = rest.mapInArrow(_blocks_pruned(schedule), f"a {kind}, b {kind}").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    crossed = written(crossed.distinct().join(starred, ["a", "b"], "left_anti"), "crossed")
    more = _linked(crossed, details, percent)
    found = written(components(links.union(more)), "components") if crossed.take(1) else found

    named = classes.join(found, "node", "left").select("digest", "n_shingles", F.coalesce("component", "node").alias("component"))
    out = sketched.select("id", "n_shingles", "digest").join(named, ["digest", "n_shingles"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
