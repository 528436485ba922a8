"""Order over a whole table without a single-partition window.

Rows are put in buckets by literal boundaries of the sort key. The boundaries come from a small
content-hashed sample, so a re-run after a lost executor puts every row in the same bucket; window
functions then run per bucket and per-bucket totals supply the offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.functions.columns import c
from tabloom.session import cut_lineage

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 512
SAMPLE_PER_BUCKET = 40
ROWS_PER_SERIES_TASK = 5_000_000


def sort_keys(df: DataFrame, order: Iterable[str], nulls_last: bool = True) -> list[Column]:
    """Comparable key parts: a NULL flag and the value, timestamps as microseconds."""
    keys = []
    for name in order:
        kind, col = df.schema[name].dataType, c(name)
        if isinstance(kind, T.TimestampType):
            col = F.unix_micros(col)
        elif isinstance(kind, T.TimestampNTZType):
            col = F.unix_micros(col.cast("timestamp"))
        elif isinstance(kind, T.DateType):
            col = F.unix_date(col)
        keys.append(F.when(col.isNull(), 1 if nulls_last else -1).otherwise(0))
        keys.append(col)
    return keys


def _boundaries(keyed: DataFrame, key: str, buckets: int, rows: int) -> list:
    """Up to ``buckets - 1`` key values splitting the sample evenly; bounded by construction."""
    if buckets < 2:
        return []
    share = min(1.0, buckets * SAMPLE_PER_BUCKET / max(rows, 1))
    cut = int(share * (2 ** 31 - 1))
    sample = (keyed.where(F.shiftrightunsigned(F.xxhash64(F.col(key)), 33) <= F.lit(cut))
              .select(key).distinct().orderBy(key).collect())
    step = len(sample) / buckets
    picked = [sample[int(step * i)][0] for i in range(1, buckets) if int(step * i) < len(sample)]
    unique: list = []
    for value in picked:
        if not unique or value != unique[-1]:
            unique.append(value)
    return unique


def _literal(value, kind: T.StructType) -> Column:
    return F.struct(*[F.lit(value[i]).cast(f.dataType).alias(f.name) for i, f in enumerate(kind.fields)])


def _bucket(key: Column, bounds: list[Column], first: int = 0) -> Column:
    """Number of boundaries at or below the key, as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return (F.when(key < bounds[middle], _bucket(key, bounds[:middle], first))
            .otherwise(_bucket(key, bounds[middle + 1:], first + middle + 1)))


def with_bucket(df: DataFrame, order: list[str], nulls_last: bool = True,
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``_key`` (comparable struct) and ``_bucket`` (increasing with the key)."""
    keyed = df.withColumn("_key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys(df, order, nulls_last))]))
    rows = keyed.count()
    buckets = min(MAX_BUCKETS, max(1, -(-rows // rows_per_bucket)))
    kind = keyed.schema["_key"].dataType
    bounds = [_literal(v, kind) for v in _boundaries(keyed, "_key", buckets, rows)]
    return keyed.withColumn("_bucket", _bucket(F.col("_key"), bounds))


def with_position(df: DataFrame, order: list[str], position: str = "_pos", nulls_last: bool = True,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds the 0-based position of each row in the total order. ``order`` must end in a unique key."""
    bucketed = with_bucket(df, order, nulls_last, rows_per_bucket)
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    # at most MAX_BUCKETS rows, so one window over all of them and a broadcast are bounded
    offsets = sizes.select("_bucket", (F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy("_key")
    return (bucketed.withColumn("_rn", F.row_number().over(inside))
            .join(F.broadcast(offsets), "_bucket")
            .withColumn(position, F.col("_offset") + F.col("_rn") - 1)
            .drop("_bucket", "_key", "_rn", "_offset"))


def prefix_counts(counted: DataFrame, group: list[str], order: list[str], count: str, before: str,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Running total of ``count`` over rows strictly before each row of its group.

    ``counted`` holds one row per (group, order) value, so no bucket can be hot.
    """
    return running_sums(counted, group, order, {before: count}, rows_per_bucket)


def running_sums(counted: DataFrame, group: list[str], order: list[str], sums: dict[str, str],
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exclusive prefix sums ``{new column: summed column}`` per group along ``order``."""
    # read three times below (size, sample, sums): materialised once, so the table behind it is scanned once
    bucketed = with_bucket(cut_lineage(counted), order, True, rows_per_bucket)
    keys = [c(g) for g in group]
    part = bucketed.groupBy(*keys, "_bucket").agg(*[F.sum(c(s)).alias(f"_t_{n}") for n, s in sums.items()])
    over = Window.partitionBy(*keys).orderBy("_bucket") if group else Window.orderBy("_bucket")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(*[k.alias(f"_g{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"),
                          *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = (Window.partitionBy(*keys, "_bucket").orderBy("_key")
              .rowsBetween(Window.unboundedPreceding, -1))
    local = bucketed.select("*", *[F.coalesce(F.sum(c(s)).over(inside), F.lit(0)).alias(f"_l_{n}") for n, s in sums.items()])
    match = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        match = match & k.eqNullSafe(F.col(f"_g{i}"))
    return local.join(offsets, match).select(*[c(n) for n in counted.columns],
                                             *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def rows_up_to_rank(df: DataFrame, order: list[str], rank: int, nulls_last: bool = True,
                    final_rows: int = 100_000):
    """Key of the row at 0-based ``rank`` in the order, found by narrowing buckets, never by sorting
    the table. Returns (comparable key builder, literal key)."""
    keyed = df.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys(df, order, nulls_last))]).alias("_key"))
    kind = keyed.schema["_key"].dataType
    rows = keyed.count()
    while rows > final_rows:
        bounds = _boundaries(keyed, "_key", min(MAX_BUCKETS, 64), rows)
        if not bounds:
            break
        sizes = (keyed.groupBy(_bucket(F.col("_key"), [_literal(b, kind) for b in bounds]).alias("b"))
                 .count().orderBy("b").collect())
        passed = 0
        for b, size in sizes:
            if passed + size > rank:
                break
            passed += size
        span = keyed
        if b > 0:
            span = span.where(F.col("_key") >= _literal(bounds[b - 1], kind))
        if b < len(bounds):
            span = span.where(F.col("_key") < _literal(bounds[b], kind))
        if size == rows:
            break
        keyed, rank, rows = span, rank - passed, size
    # equal keys are counted together, so a key shared by many rows is one entry
    seen = 0
    for key, size in keyed.groupBy("_key").count().orderBy("_key").limit(min(rank + 1, final_rows)).collect():
        seen += size
        if seen > rank:
            return _literal(key, kind)
    raise ValueError("rank beyond the table")


PREFIX_DIGITS = 5


def first_in_group(df: DataFrame, group: str, order: str, ties: list[str], wanted: Column) -> DataFrame:
    """Adds ``_first``: whether a row is among the first ``wanted`` of its group by ``order``, a hexadecimal hash, and ``ties``.

    ``wanted`` is an expression of ``_n``, the group's rows. Rows are counted by group and leading digits of the hash; only the rows of the
    one stretch where a group's cut falls are ranked, so a group of any size, and any number of groups, works in bounded tasks.
    """
    stretch = F.substring(F.col(order), 1, PREFIX_DIGITS)
    counted = df.groupBy(c(group).alias("_g"), stretch.alias("_s")).agg(F.count("*").alias("_k"))
    ahead = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum("_k").over(ahead), F.lit(0))).withColumn("_n", F.sum("_k").over(Window.partitionBy("_g")))
    counted = counted.withColumn("_wanted", wanted)
    placed = df.join(counted, c(group).eqNullSafe(F.col("_g")) & (stretch == F.col("_s")))
    whole, none = F.col("_before") + F.col("_k") <= F.col("_wanted"), F.col("_before") >= F.col("_wanted")
    rank = F.row_number().over(Window.partitionBy("_g", "_s").orderBy(*sort_keys(df, [order] + ties)))
    cut = placed.where(~whole & ~none).withColumn("_first", rank <= F.col("_wanted") - F.col("_before"))
    clear = placed.where(whole | none).withColumn("_first", whole)
    return clear.union(cut).select(*[c(n) for n in df.columns], "_first")


def split_at(df: DataFrame, order: list[str], rank: int) -> tuple[DataFrame, DataFrame]:
    """(first ``rank`` rows, the others) in the order; a filter on each side, no global sort."""
    cut = rows_up_to_rank(df, order, rank)
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys(df, order))])
    return df.where(key < cut), df.where(~(key < cut))


def over_series(df: DataFrame, group: list[str], order: list[str], before: int, after: int,
                build: Callable[[Window], dict[str, Column]],
                max_rows: int = ROWS_PER_SERIES_TASK) -> DataFrame:
    """Window columns with a bounded reach (``before`` rows back, ``after`` rows ahead) per series.

    A series too long for one task is cut in chunks by position, each chunk also receiving the
    neighbouring rows its windows reach; those copies are dropped afterwards.
    """
    longest = df.groupBy(*[c(g) for g in group]).count().agg(F.max("count")).first()[0] or 0
    if longest <= max_rows:
        window = Window.partitionBy(*[c(g) for g in group]).orderBy(*[c(o) for o in order])
        new = build(window)
        return df.select("*", *[col.alias(n) for n, col in new.items()])
    chunk = max(max_rows, before, after)
    placed = with_position(df, group + order, "_pos", rows_per_bucket=min(ROWS_PER_BUCKET, max_rows))
    home = F.floor(F.col("_pos") / chunk)
    offset = F.col("_pos") % chunk
    copies = F.array(home, F.when(offset >= chunk - before, home + 1) if before else F.lit(None).cast("long"),
                     F.when(offset < after, home - 1) if after else F.lit(None).cast("long"))
    spread = (placed.withColumn("_home", home).withColumn("_chunk", F.explode(F.array_compact(copies))))
    window = Window.partitionBy(*[c(g) for g in group], "_chunk").orderBy("_pos")
    new = build(window)
    return (spread.select("*", *[col.alias(n) for n, col in new.items()])
            .where(F.col("_home") == F.col("_chunk")).drop("_pos", "_home", "_chunk"))


def steps(df: DataFrame, order: list[str], columns: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> dict[str, tuple[int, int, int]]:
    """``{column: (steps, rises, falls)}`` between neighbouring known values of each column along the order; NULLs are passed over.

    Every bucket gives its first and last known value and its rises and falls; the at most ``MAX_BUCKETS`` results are joined at their borders.
    ``order`` should end in a unique key, else rows with equal keys stand in any order.
    """
    bucketed = with_bucket(df.select(*dict.fromkeys(order + columns)), order, True, rows_per_bucket)
    before = Window.partitionBy("_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.select("_bucket", "_key", *[c(n).alias(f"v{i}") for i, n in enumerate(columns)],
                             *[F.last(c(n), ignorenulls=True).over(before).alias(f"p{i}") for i, n in enumerate(columns)])
    aggs = []
    for i in range(len(columns)):
        value, known = F.col(f"v{i}"), F.when(F.col(f"v{i}").isNotNull(), F.col("_key"))
        aggs += [F.count(value).alias(f"n{i}"), F.count_if(value > F.col(f"p{i}")).alias(f"u{i}"), F.count_if(value < F.col(f"p{i}")).alias(f"d{i}"),
                 F.min_by(value, known).alias(f"f{i}"), F.max_by(value, known).alias(f"l{i}")]
    rows = placed.groupBy("_bucket").agg(*aggs).orderBy("_bucket").collect()
    found = {}
    for i, name in enumerate(columns):
        known, rises, falls, last = 0, 0, 0, None
        for row in rows:
            if not row[f"n{i}"]:
                continue
            known, rises, falls = known + row[f"n{i}"], rises + row[f"u{i}"], falls + row[f"d{i}"]
            if last is not None:
                rises, falls = rises + (row[f"f{i}"] > last), falls + (row[f"f{i}"] < last)
            last = row[f"l{i}"]
        found[name] = (max(0, known - 1), rises, falls)
    return found
