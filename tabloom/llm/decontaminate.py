"""Benchmark decontamination: winnowed fingerprints of training and benchmark texts, joined and extended to whole shared windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.llm.common import written
from tabloom.operators.joins import BROADCAST_ROWS

GROUP_BYTES, SPAN_BYTES = 4 << 20, 1 << 20  # bytes of texts that are worked on together, and of words hashed at once
FILTER_BITS = 1 << 26  # bits of the filter of benchmark fingerprints, 8 MB
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WORD_BYTE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SALTS = 64


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(size, x)), dtype=np.uint64) for x in (BASE, INVERSE))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Start, end and hash of every word of some bytes: runs of digits, letters a to z (A to Z lower-cased) and bytes from 128 on."""

    def __init__(self, raw: np.ndarray):
        self.bytes = LOWER[raw]
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = WORD_BYTE[self.bytes]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.hashes = np.empty(len(self.starts), np.uint64)
        begin = 0
        while begin < len(self.starts):  # spans of bounded length, but for longer words
            end = max(begin + 1, int(np.searchsorted(self.ends, self.starts[begin] + SPAN_BYTES, "right")))
            self._hash(begin, end)
            begin = end

    def _hash(self, begin: int, end: int) -> None:
        """Sum of byte times BASE to the power of its place in the word, modulo 2^64, mixed."""
        first = int(self.starts[begin])
        part = self.bytes[first:int(self.ends[end - 1])].astype(np.uint64) + np.uint64(1)
        powers, back = _powers(SPAN_BYTES) if len(part) <= SPAN_BYTES else _powers.__wrapped__(len(part))
        sums = np.append(np.uint64(0), np.cumsum(part * powers[:len(part)], dtype=np.uint64))
        a, b = self.starts[begin:end] - first, self.ends[begin:end] - first
        self.hashes[begin:end] = _mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))

    def text(self, begin: int, end: int) -> str:
        return b" ".join(self.bytes[a:b].tobytes() for a, b in zip(self.starts[begin:end], self.ends[begin:end])).decode("utf-8", "replace")


def grams(hashes: np.ndarray, gram: int, length: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` words, different for each window ``length``."""
    count = max(0, len(hashes) - gram + 1)
    out = np.full(count, length, np.uint64)
    for at in range(gram):
        out = out * STEP + hashes[at:at + count]
    return _mixed(out)


def winnowed(values: np.ndarray, window: int, owner: np.ndarray) -> np.ndarray:
    """True where a value is the smallest, the last of equal ones, of some ``window`` consecutive values of one owner."""
    count = max(0, len(values) - window + 1)
    best, place = values[:count].copy(), np.arange(count)
    for at in range(1, window):
        better = np.flatnonzero(values[at:at + count] <= best)
        best[better], place[better] = values[better + at], better + at
    kept = np.zeros(len(values), bool)
    kept[place[owner[:count] == owner[window - 1:window - 1 + count]]] = True
    return kept


def _fingerprints(words: Words, owner: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints that every shared span of ``length`` words holds one of; ``owner`` is the text of each word."""
    short = min(gram, length)
    values = grams(words.hashes, short, length)
    count = len(values)
    whole = owner[:count] == owner[short - 1:short - 1 + count]
    # a run over a border belongs to no text: it gets an owner of its own, so that no window holds it
    runs = np.where(whole, owner[:count].astype(np.int64), -1 - np.arange(count))
    places = np.flatnonzero(winnowed(values, length - short + 1, runs) & whole)
    return places, values[places].view(np.int64)


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of some texts with a space behind each, and the first byte of each text."""
    texts = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", " ")
    offsets = np.frombuffer(texts.buffers()[1], "<i8" if pa.types.is_large_string(texts.type) else "<i4")[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // GROUP_BYTES)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


CONTEXT = pa.struct([("hash", pa.int64()), ("length", pa.int32()), ("at", pa.int32()), ("before", pa.string()), ("words", pa.string()), ("after", pa.string())])
CONTEXT_SQL = "struct<hash: bigint, length: int, at: int, before: string, words: string, after: string>"


def _marked(gram: int, lengths: Sequence[int], passes):
    """``(id, n_words, found)`` of texts: their fingerprints that ``passes(hashes)`` lets through, with the words around each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _groups(batch, 1):
                raw, offsets = _joined(some.column(1))
                words = Words(raw)
                owner = np.searchsorted(offsets, words.starts, "right") - 1
                first = np.searchsorted(owner, np.arange(some.num_rows + 1))
                found: list[list[dict]] = [[] for _ in range(some.num_rows)]
                for length in lengths:
                    short = min(gram, length)
                    for place, value in zip(*(x.tolist() for x in passes(*_fingerprints(words, owner, gram, length)))):
                        text = int(owner[place])
                        start, stop, around = int(first[text]), int(first[text + 1]), length - short
                        found[text].append({"hash": value, "length": length, "at": place - start, "before": words.text(max(start, place - around), place),
                                            "words": words.text(place, place + short), "after": words.text(place + short, min(stop, place + short + around))})
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(first)), pa.array(found, pa.list_(CONTEXT))], ["id", "n_words", "found"])
    return run


def _all(places: np.ndarray, values: np.ndarray):
    return places, values


def _filtered(buckets):
    """Lets fingerprints through whose bit is set; the filter is read from the broadcast."""
    def passes(places: np.ndarray, values: np.ndarray):
        bits = values & np.int64(FILTER_BITS - 1)
        hit = (buckets.value[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1
        return places[hit], values[hit]
    return passes


def _filter(spark: SparkSession, prints: DataFrame):
    """A broadcast filter of ``FILTER_BITS`` bits, whatever the number of fingerprints; its bytes are put together by Spark."""
    bit = F.col("hash").bitwiseAND(FILTER_BITS - 1)
    rows = prints.select(bit.alias("bit")).distinct().groupBy(F.shiftright("bit", 3).alias("byte")).agg(
        F.sum(F.expr("shiftleft(1, cast(bit & 7 as int))")).cast("int").alias("bits"))
    packed = np.zeros(FILTER_BITS >> 3, np.uint8)
    for part in rows.toArrow().to_batches():
        packed[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return spark.sparkContext.broadcast(packed)


def _same(left: Column, right: Column, reverse: bool) -> Column:
    """How many words two neighbouring runs share, from the fingerprint outwards."""
    def listed(words: Column) -> Column:
        some = F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))
        return F.reverse(some) if reverse else some
    same = F.zip_with(listed(left), listed(right), lambda a, b: F.coalesce(a == b, F.lit(False)))
    other = F.array_position(same, False)
    return F.when(other == 0, F.size(same)).otherwise(other - 1).cast("int")


def shared_spans(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", *, window: int = 10, gram: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: ``rows`` is ``(row, id, n_words)`` per document, ``spans`` is ``(row, item, start, stop)`` in words, stop excluded.

    See ``decontaminate``; a span is a run of words in which every window occurs in the item.
    """
    spark = documents.sparkSession
    item_kind, kind = dict(benchmark.dtypes)[item_col], dict(documents.dtypes)[id_col]
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text"))
    marked = items.mapInArrow(_marked_items(gram, window), f"id {item_kind}, n_words bigint, found array<{CONTEXT_SQL}>")
    prints = written(marked.select(F.col("id").alias("item"), F.inline("found")), "item-fingerprints")
    lengths = sorted(r["length"] for r in prints.select("length").distinct().collect())  # at most ``window``
    passes = _filtered(_filter(spark, prints))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(_marked(gram, lengths, passes), f"id {kind}, n_words bigint, found array<{CONTEXT_SQL}>")
    found = written(found.select(F.monotonically_increasing_id().alias("row"), "*"), "fingerprints")
    asked = found.where(F.size("found") > 0).select("row", F.inline("found"))
    held = prints.select("item", "hash", "length", *[F.col(x).alias(f"item_{x}") for x in ("before", "words", "after")])
    if prints.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = asked.join(F.broadcast(held), ["hash", "length"])
    else:  # a fingerprint of very many documents is dealt over salts, those of the items are repeated for each
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        met = asked.join(held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["hash", "length", "salt"])
    left, right = _same(F.col("before"), F.col("item_before"), True), _same(F.col("after"), F.col("item_after"), False)
    size = F.least(F.lit(gram), F.col("length"))
    spans = met.where("words = item_words").withColumn("left", left).withColumn("right", right).where(F.col("left") + size + F.col("right") >= F.col("length"))
    spans = spans.select("row", "item", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + size + F.col("right")).alias("stop"))
    return found.select("row", "id", "n_words"), spans


def _marked_items(gram: int, window: int):
    """Fingerprints of items: of ``window`` words, or of all words of an item that has fewer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                raw, _ = _joined(one.column(1))
                length = min(window, len(Words(raw).starts))
                yield from _marked(gram, [length] if length else [], _all)(iter([one]))
    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", *, window: int = 10, gram: int = 5) -> DataFrame:
    """Marks the words of documents that stand in any occurrence of ``window`` consecutive words of a benchmark item.

    Returns, per document, ``(id_col, n_words, n_hit, n_items, items_sha256, contaminated)``: words in occurrences, distinct items with
    occurrences, and the hash of their ids, sorted as strings and joined by commas (of the empty string without any). Words are runs of
    digits, letters (A-Z lower-cased) and characters beyond ASCII. An item with fewer words than ``window``, but not none, is one window.

    1. Runs of ``gram`` words are hashed; of every ``window - gram + 1`` consecutive runs the smallest hash is kept (the last of equal
       ones). Windows with equal words keep equal runs, so every shared window shares a fingerprint. Items shorter than ``window`` are
       winnowed by their own length, and the documents by each such length.
    2. Documents are read once. A bit filter of bounded size sorts out fingerprints that no item has; the others are written with the words
       around them and joined with those of the items (broadcast behind a check of their number, else salted).
    3. Hits are extended by comparing words, not hashes; a run at least as long as the window marks its words.

    NULL or empty texts have no words and are not contaminated; an item without words occurs nowhere. Rows that repeat an id are judged
    each by itself, rows with a NULL id as well. Items that repeat an id are one item; an item with a NULL id marks words, but is neither
    counted nor listed. Very long texts are hashed in spans of bounded length, with about 30 bytes a word besides. Empty tables give no rows, or
    only clean ones. Extra columns are ignored.
    """
    rows, spans = shared_spans(documents, benchmark, id_col, text_col, item_col, item_text_col, window=window, gram=gram)
    spans = written(spans, "spans")
    # spans in the order of their starts: each adds what lies beyond the farthest stop so far
    spread = F.array_sort(F.collect_list(F.struct("start", "stop")))
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(spread, start, lambda s, x: F.struct(
        F.greatest(s["reach"], x["stop"]).alias("reach"), (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["reach"], x["start"]))).alias("n")))["n"]
    hit = spans.groupBy("row", "start").agg(F.max("stop").alias("stop")).groupBy("row").agg(covered.alias("n_hit"))
    named = spans.where("item is not null").select("row", F.col("item").cast("string").alias("item")).distinct()
    named = named.groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items"))
    marks = hit.join(named, "row", "left")
    out = rows.join(marks, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
                      F.coalesce("items", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
