"""Class balancing. Synthetic rows follow the published methods; every choice comes from seeded keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import c, is_numeric, numeric_columns, require_column
from tabloom.functions.seeded import seeded_fraction, seeded_key
from tabloom.operators.impute import null_counts
from tabloom.operators.neighbours import knn_join
from tabloom.operators.joins import lookup_join
from tabloom.operators.ordered import first_in_group, with_position
from tabloom.session import cut_lineage

CLASS_LIMIT = 20


@dataclass
class _Classes:
    """Rows per class, and the smallest and the largest class."""

    counts: DataFrame
    smallest: int
    most: int

    def of(self, df: DataFrame, target: str) -> DataFrame:
        """``df`` with ``_n``, the rows of its class."""
        return lookup_join(df, self.counts, [target], "_rows")


def _classes(df: DataFrame, target: str, key: list[str], numeric_only: str | None = None) -> _Classes:
    """The classes, after the checks shared by all resamplers; there may be any number of text classes."""
    require_column(df, target, "target_column")
    for k in key:
        require_column(df, k, "key")
    counts = df.where(c(target).isNotNull()).groupBy(c(target)).agg(F.count("*").alias("_n")).withColumn("_rows", F.col("_n"))
    facts = counts.agg(F.count("*").alias("classes"), F.min("_n").alias("least"), F.max("_n").alias("most")).first()
    if is_numeric(df, target) and facts["classes"] > CLASS_LIMIT:
        raise ValueError("The target has too many numbers to be classes.")
    features = df.drop(target)
    if any(null_counts(features).values()):
        raise ValueError("Fill the gaps before balancing classes.")
    if numeric_only:
        texts = [n for n in features.columns if n not in key and not is_numeric(df, n)]
        if texts:
            raise ValueError(f"{numeric_only} works on numbers; encode {texts[:8]} first.")
    if facts["classes"] < 2:
        raise ValueError("There is one class only, nothing to balance.")
    return _Classes(counts, facts["least"], facts["most"])


def _k(k_neighbors: int, smallest: int) -> int:
    return max(1, min(int(k_neighbors), smallest - 1)) if smallest > 1 else 1


def _first_of_classes(df: DataFrame, target: str, key: list[str], wanted: Column, seed: int) -> DataFrame:
    """The first ``wanted`` rows (of ``_n``) of every class in seeded order."""
    known = df.where(c(target).isNotNull()).withColumn("_order", seeded_key(seed, *key))
    return first_in_group(known, target, "_order", key, wanted).where("_first").drop("_order", "_first")


def random_undersample(df: DataFrame, target: str, key: list[str], seed: int = 42) -> DataFrame:
    """Every class down to the smallest."""
    return _first_of_classes(df, target, key, F.lit(_classes(df, target, key).smallest), seed)


def random_oversample(df: DataFrame, target: str, key: list[str], seed: int = 42) -> DataFrame:
    """Every class up to the largest: whole copies of the class plus a seeded remainder."""
    classes = _classes(df, target, key)
    sized = classes.of(df.where(c(target).isNotNull()), target)
    whole = sized.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.floor(F.lit(classes.most) / F.col("_n")).cast("int"))))
    return whole.drop("_copy", "_n").unionByName(_first_of_classes(df, target, key, F.lit(classes.most) % F.col("_n"), seed))


def _requests(bases: DataFrame, target: str, key: list[str], classes: _Classes, seed: int) -> DataFrame:
    """Requests that bring every class up to the largest, dealt evenly over its bases in seeded order: (row…, _copy).

    All classes are numbered by one position over (class, seeded order), less the place of the class's first row.
    """
    placed = with_position(bases.withColumn("_order", seeded_key(seed, *key)), [target, "_order"] + key, "_place").drop("_order")
    first = placed.groupBy(c(target)).agg(F.min("_place").alias("_first"), F.count("*").alias("_size")).withColumn("_weight", F.col("_size"))
    at, wanted = F.col("_place") - F.col("_first"), F.lit(classes.most) - F.col("_n")
    times = F.floor(wanted / F.col("_size")) + F.when(at < wanted % F.col("_size"), 1).otherwise(0)
    dealt = lookup_join(placed, first, [target], "_weight").withColumn("_times", times.cast("int"))
    return (dealt.where(F.col("_times") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
            .drop("_place", "_first", "_size", "_times"))


def _interpolate(requests: DataFrame, pool: DataFrame, near: DataFrame, df: DataFrame, target: str, key: list[str],
                 features: list[str], seed: int, spread: float = 1.0) -> DataFrame:
    """x + u (neighbour - x) for numbers; the neighbours' most frequent value for the other columns. ``_row`` names base and copy.

    ``near`` lists the neighbours of each base; the request's copy number picks one by seeded key.
    """
    lists = near.groupBy("left_id").agg(F.array_sort(F.collect_list(F.struct("rank", "right_id"))).alias("_near"))
    picked = requests.join(lists, requests["_id"] == lists["left_id"]).withColumn(
        "_pick", F.floor(seeded_fraction(seed + 1, *key, "_copy") * F.size("_near")).cast("int"))
    picked = picked.withColumn("_nb", F.col("_near")[F.col("_pick")]["right_id"])
    others = [n for n in df.columns if n not in features and n != target and n not in key]
    donors = pool.select(F.col("_id").alias("_nb"), *[c(n).cast("double").alias(f"_n_{n}") for n in features])
    joined = picked.join(donors, "_nb").withColumn("_u", seeded_fraction(seed + 2, *key, "_copy") * spread)
    if others:
        votes = (near.join(pool.select(F.col("_id").alias("right_id"), *[c(n) for n in others]), "right_id")
                 .select("left_id", *[c(n) for n in others]))
        modes = votes.groupBy("left_id").agg(*[F.mode(c(n), True).alias(f"_m_{n}") for n in others])
        joined = joined.drop("left_id").join(modes, joined["_id"] == modes["left_id"])
    columns = []
    for f in df.schema:
        n = f.name
        if n == target:
            columns.append(c(n))
        elif n in key:
            columns.append(F.lit(None).cast(f.dataType).alias(n))
        elif n in features:
            columns.append((c(n).cast("double") + F.col("_u") * (c(f"_n_{n}") - c(n).cast("double"))).alias(n))
        else:
            columns.append(c(f"_m_{n}").alias(n))
    return joined.select(*columns, F.concat(F.lit("+"), F.col("_id").cast("string"), F.lit("#"), F.col("_copy").cast("string")).alias("_row"))


def _double_features(df: DataFrame, features: list[str]) -> DataFrame:
    return df.select(*[c(n).cast("double").alias(n) if n in features else c(n) for n in df.columns])


def _identified(df: DataFrame, key: list[str]) -> DataFrame:
    return df.withColumn("_id", c(key[0]) if len(key) == 1 else F.md5(F.concat_ws("|", *[c(k).cast("string") for k in key])))


def _known(df: DataFrame, target: str, key: list[str], features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a class with ``_id``, and the same with real features and ``_row`` as the given part of a result."""
    base = _identified(df.where(c(target).isNotNull()), key)
    given = _double_features(base, features).withColumn("_row", F.concat(F.lit("="), F.col("_id").cast("string"))).drop("_id")
    return base, given


def _smote(df: DataFrame, target: str, key: list[str], k_neighbors: int, seed: int) -> DataFrame:
    classes = _classes(df, target, key)
    features = numeric_columns(df, exclude=[target, *key])
    if classes.smallest < 2:
        raise ValueError("A class has a single row.")
    base, given = _known(df, target, key, features)
    pool = classes.of(base, target).where(F.col("_n") < classes.most)
    near = knn_join(pool, pool, _k(k_neighbors, classes.smallest), features, "_id", "_id", within=target, exclude_same=True)
    return given.unionByName(_interpolate(_requests(pool, target, key, classes, seed), pool, near, df, target, key, features, seed))


def smote(df: DataFrame, target: str, key: list[str], k_neighbors: int = 5, seed: int = 42) -> DataFrame:
    """Minority classes up to the largest by interpolation inside the class; synthetic rows have a NULL key.

    One neighbour join serves all classes. Text and boolean columns take the neighbours' most frequent value;
    with no numeric feature at all this is random oversampling.
    """
    if not numeric_columns(df, exclude=[target, *key]):
        return random_oversample(df, target, key, seed)
    return _smote(df, target, key, k_neighbors, seed).drop("_row")


def _surroundings(pool: DataFrame, base: DataFrame, target: str, features: list[str], k: int) -> DataFrame:
    """(_id, _share): the share of other classes among the k nearest rows of all classes."""
    around = knn_join(pool, base, k, features, "_id", "_id", exclude_same=True)
    around = around.join(base.select(F.col("_id").alias("right_id"), c(target).alias("_theirs")), "right_id")
    around = around.join(pool.select(F.col("_id").alias("left_id"), c(target).alias("_own")), "left_id")
    return around.groupBy(F.col("left_id").alias("_id")).agg(F.avg((F.col("_theirs") != F.col("_own")).cast("double")).alias("_share"))


def borderline_smote(df: DataFrame, target: str, key: list[str], k_neighbors: int = 5, m_neighbors: int = 10,
                     seed: int = 42) -> DataFrame:
    """Only bases in danger: at least half, but not all, of their m neighbours are of other classes."""
    classes = _classes(df, target, key, "BorderlineSMOTE")
    features = numeric_columns(df, exclude=[target, *key])
    base, given = _known(df, target, key, features)
    pool = classes.of(base, target).where(F.col("_n") < classes.most)
    share = _surroundings(pool, base, target, features, m_neighbors)
    danger = cut_lineage(pool.join(share.where((F.col("_share") >= 0.5) & (F.col("_share") < 1)).select("_id"), "_id", "left_semi"))
    if not danger.limit(1).count():
        return given.drop("_row")
    near = knn_join(danger, pool, _k(k_neighbors, classes.smallest), features, "_id", "_id", within=target, exclude_same=True)
    made = _interpolate(_requests(danger, target, key, classes, seed), pool, near, df, target, key, features, seed)
    return given.unionByName(made).drop("_row")


def adasyn(df: DataFrame, target: str, key: list[str], k_neighbors: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows in proportion to the share of other classes around each base."""
    classes = _classes(df, target, key, "ADASYN")
    features = numeric_columns(df, exclude=[target, *key])
    k = _k(k_neighbors, classes.smallest)
    base, given = _known(df, target, key, features)
    pool = classes.of(base, target).where(F.col("_n") < classes.most)
    shared = cut_lineage(pool.join(_surroundings(pool, base, target, features, k), "_id"))
    totals = shared.groupBy(c(target)).agg(F.sum("_share").alias("_total"), F.count("*").alias("_weight"))
    if totals.where(F.col("_total") == 0).limit(1).count():
        raise ValueError("ADASYN found no minority row with neighbours of another class.")
    weighed = lookup_join(shared, totals, [target], "_weight")
    times = F.round(F.col("_share") / F.col("_total") * (F.lit(classes.most) - F.col("_n"))).cast("int")
    requests = (weighed.withColumn("_times", times).where(F.col("_times") > 0)
                .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_share", "_total"))
    near = knn_join(pool, pool, k, features, "_id", "_id", within=target, exclude_same=True)
    return given.unionByName(_interpolate(requests, pool, near, df, target, key, features, seed)).drop("_row")


def _with_row_id(df: DataFrame) -> DataFrame:
    """Rows without a name are numbered once and kept: a checkpoint fixes the numbers."""
    return cut_lineage(df if "_row" in df.columns else df.withColumn("_row", F.monotonically_increasing_id()))


def remove_tomek_links(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Drops both rows of every mutual nearest pair of different classes."""
    rows = _with_row_id(df)
    near = knn_join(rows, rows, 1, features, "_row", "_row", exclude_same=True).select("left_id", "right_id")
    back = near.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))
    labels = rows.select("_row", c(target).alias("_y"))
    pairs = (near.join(back, ["left_id", "right_id"])
             .join(labels.select(F.col("_row").alias("left_id"), F.col("_y").alias("_a")), "left_id")
             .join(labels.select(F.col("_row").alias("right_id"), F.col("_y").alias("_b")), "right_id")
             .where(F.col("_a") != F.col("_b")).select(F.col("left_id").alias("_row")).distinct())
    return rows.join(pairs, "_row", "left_anti").drop("_row")


def edited_neighbours(df: DataFrame, target: str, features: list[str], k: int = 3) -> DataFrame:
    """Keeps rows whose k nearest neighbours all carry their own class."""
    rows = _with_row_id(df)
    labels = rows.select(F.col("_row"), c(target).alias("_y"))
    near = knn_join(rows, rows, k, features, "_row", "_row", exclude_same=True)
    votes = (near.join(labels.select(F.col("_row").alias("right_id"), F.col("_y").alias("_b")), "right_id")
             .join(labels.select(F.col("_row").alias("left_id"), F.col("_y").alias("_a")), "left_id"))
    wrong = votes.where(F.col("_a") != F.col("_b")).select(F.col("left_id").alias("_row")).distinct()
    return rows.join(wrong, "_row", "left_anti").drop("_row")


def smote_tomek(df: DataFrame, target: str, key: list[str], k_neighbors: int = 5, seed: int = 42) -> DataFrame:
    _classes(df, target, key, "SMOTETomek")
    return remove_tomek_links(_smote(df, target, key, k_neighbors, seed), target, numeric_columns(df, exclude=[target, *key]))


def smote_enn(df: DataFrame, target: str, key: list[str], k_neighbors: int = 5, seed: int = 42) -> DataFrame:
    _classes(df, target, key, "SMOTEENN")
    return edited_neighbours(_smote(df, target, key, k_neighbors, seed), target, numeric_columns(df, exclude=[target, *key]))
