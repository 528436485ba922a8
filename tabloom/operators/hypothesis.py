"""Two-sample and k-sample tests from aggregated moments, contingency counts and mid-ranks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tabloom.functions.columns import c, require_column, require_numeric
from tabloom.functions.pvalues import chi2_tail, f_tail, t_two_sided
from tabloom.operators.ordered import ROWS_PER_BUCKET, prefix_counts


def _moments(df: DataFrame, column: str, group: str) -> DataFrame:
    x = c(column).cast("double")
    return (df.where(x.isNotNull() & c(group).isNotNull()).groupBy(c(group).alias("g"))
            .agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var")))


def _two(groups: DataFrame, test: str) -> list:
    """The rows of exactly two groups, in group order."""
    rows = groups.orderBy("g").limit(3).collect()
    if len(rows) != 2:
        raise ValueError(f"{test} compares exactly 2 groups, found {'more' if len(rows) > 2 else len(rows)}.")
    return rows


def ttest(df: DataFrame, column: str, group: str | None = None, paired: str | None = None,
          equal_var: bool = True) -> DataFrame:
    """Independent t between the two values of ``group``, or paired t against the column ``paired``."""
    require_numeric(df, column)
    if paired:
        d = c(column).cast("double") - c(require_numeric(df, paired)).cast("double")
        row = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).first()
        if row["n"] < 2:
            raise ValueError("Need at least 2 pairs.")
        t = row["m"] / (row["s"] / math.sqrt(row["n"])) if row["s"] else math.nan
        dof = float(row["n"] - 1)
        kind = "paired"
    else:
        a, b = _two(_moments(df, column, require_column(df, group, "group")), "ttest")
        if a["n"] < 2 or b["n"] < 2:
            raise ValueError("Each group needs at least 2 values.")
        va, vb = a["var"] / a["n"], b["var"] / b["n"]
        if equal_var:
            dof = float(a["n"] + b["n"] - 2)
            pooled = ((a["n"] - 1) * a["var"] + (b["n"] - 1) * b["var"]) / dof
            se = math.sqrt(pooled * (1 / a["n"] + 1 / b["n"]))
        else:
            dof = (va + vb) ** 2 / (va ** 2 / (a["n"] - 1) + vb ** 2 / (b["n"] - 1))
            se = math.sqrt(va + vb)
        t = (a["mean"] - b["mean"]) / se if se else math.nan
        kind = "independent"
    p = None if t != t else t_two_sided(t, dof)
    return df.sparkSession.createDataFrame([(kind, column, None if t != t else t, dof, p, p is not None and p < 0.05)],
                                           "test string, column string, statistic double, dof double, p double, significant boolean")


def anova(df: DataFrame, column: str, group: str) -> DataFrame:
    """One-way F from group counts, means and variances."""
    groups = _moments(df, require_numeric(df, column), require_column(df, group, "group"))
    x = c(column).cast("double")
    grand = df.where(x.isNotNull() & c(group).isNotNull()).agg(F.avg(x)).first()[0]
    gap = F.col("mean") - F.lit(grand).cast("double")
    row = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * gap * gap).alias("between"),
                     F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("within")).first()
    if row["k"] < 2:
        raise ValueError("An analysis of variance takes 2 groups or more.")
    between, within = row["between"], row["within"]
    d1, d2 = row["k"] - 1, row["n"] - row["k"]
    f = (between / d1) / (within / d2) if d2 > 0 and within > 0 else None
    p = None if f is None else f_tail(f, d1, d2)
    return df.sparkSession.createDataFrame([(column, f, d1, d2, p, p is not None and p < 0.05)],
                                           "column string, statistic double, dof_between long, dof_within long, p double, significant boolean")


def _rank_sums(df: DataFrame, column: str, group: str, rows_per_bucket: int):
    """Rank sum and size per group with mid-ranks for ties, and the tie term sum(t^3 - t).

    Everything after the first aggregation is one row per distinct value (and group).
    """
    x = c(column).cast("double")
    cells = (df.where(x.isNotNull() & c(group).isNotNull()).groupBy(x.alias("v"), c(group).alias("g"))
             .agg(F.count("*").alias("k")))
    values = cells.groupBy("v").agg(F.sum("k").alias("cnt"))
    ranked = prefix_counts(values, [], ["v"], "cnt", "before", rows_per_bucket)
    ranked = ranked.select("v", "cnt", (F.col("before") + (F.col("cnt") + 1) / 2).alias("midrank"))
    sums = cells.join(ranked, "v").groupBy("g").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("midrank")).alias("ranks"))
    t = F.col("cnt").cast("double")
    ties = values.agg(F.sum(t * t * t - t)).first()[0] or 0.0
    return sums, ties


def mannwhitney(df: DataFrame, column: str, group: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """U of the smaller group value; normal approximation with tie and continuity correction."""
    sums, ties = _rank_sums(df, require_numeric(df, column), require_column(df, group, "group"), rows_per_bucket)
    sums = _two(sums, "mannwhitney")
    n1, n2 = sums[0]["n"], sums[1]["n"]
    n = n1 + n2
    u = sums[0]["ranks"] - n1 * (n1 + 1) / 2
    spread = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) if n > 1 else 0.0
    larger = max(u, n1 * n2 - u)
    p = None if spread == 0 else min(1.0, 2 * 0.5 * math.erfc((larger - n1 * n2 / 2 - 0.5) / spread / math.sqrt(2)))
    return df.sparkSession.createDataFrame([(column, float(u), n1, n2, p, p is not None and p < 0.05)],
                                           "column string, statistic double, n1 long, n2 long, p double, significant boolean")


def kruskal_wallis(df: DataFrame, column: str, group: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    sums, ties = _rank_sums(df, require_numeric(df, column), require_column(df, group, "group"), rows_per_bucket)
    row = sums.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("ranks") * F.col("ranks") / F.col("n")).alias("squares")).first()
    if row["k"] < 2:
        raise ValueError("A rank analysis of variance takes 2 groups or more.")
    n = row["n"]
    h = 12 / (n * (n + 1)) * row["squares"] - 3 * (n + 1)
    correction = 1 - ties / (float(n) ** 3 - n)
    h = h / correction if correction > 0 else None
    dof = row["k"] - 1
    p = None if h is None else chi2_tail(h, dof)
    return df.sparkSession.createDataFrame([(column, h, dof, p, p is not None and p < 0.05)],
                                           "column string, statistic double, dof long, p double, significant boolean")


def chi2_test(df: DataFrame, a: str, b: str, correction: bool = True) -> DataFrame:
    """Independence of two categoricals; Yates correction for a 2 x 2 table.

    Cells are joined to their margins, so the table may have any number of categories. Absent
    cells are accounted for through sum(observed^2 / (row * column)).
    """
    require_column(df, a, "a"), require_column(df, b, "b")
    cells = (df.where(c(a).isNotNull() & c(b).isNotNull()).groupBy(c(a).alias("a"), c(b).alias("b"))
             .agg(F.count("*").alias("k")))
    rows = cells.groupBy("a").agg(F.sum("k").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("k").alias("cb"))
    ka, n = rows.agg(F.count("*"), F.sum("ra")).first()
    kb = cols.agg(F.count("*")).first()[0]
    if not n or ka < 2 or kb < 2:
        stat, dof, p = 0.0, 0, 1.0
    else:
        dof = (ka - 1) * (kb - 1)
        observed = F.col("k").cast("double")
        if dof == 1 and correction:
            margin_a, margin_b = ([r[1] for r in m.orderBy(m.columns[0]).collect()] for m in (rows, cols))
            corner = cells.agg(F.min_by("k", F.struct("a", "b")), F.min(F.struct("a", "b"))).first()
            first = cells.agg(F.min("a"), F.min("b")).first()
            top = corner[0] if tuple(corner[1]) == tuple(first) else 0
            stat = 0.0
            for i in (0, 1):
                for j in (0, 1):
                    seen = (top, margin_a[0] - top, margin_b[0] - top, margin_a[1] - margin_b[0] + top)[2 * i + j]
                    expected = margin_a[i] * margin_b[j] / n
                    gap = abs(seen - expected)
                    stat += (gap - min(0.5, gap)) ** 2 / expected
        else:
            joined = cells.join(rows, "a").join(cols, "b")
            stat = n * (joined.agg(F.sum(observed * observed / (F.col("ra").cast("double") * F.col("cb")))).first()[0] - 1)
        p = chi2_tail(stat, dof)
    return df.sparkSession.createDataFrame([(a, b, float(stat), int(dof), float(p), p < 0.05)],
                                           "col_a string, col_b string, statistic double, dof long, p double, significant boolean")
