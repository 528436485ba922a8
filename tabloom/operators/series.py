"""Time-series analysis per series: autocorrelation, decomposition, stationarity, AR forecasts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.functions.columns import c, require_column, require_numeric
from tabloom.functions.pvalues import normal_quantile
from tabloom.operators import lagged
from tabloom.operators.ordered import ROWS_PER_SERIES_TASK, over_series, with_position
from tabloom.session import cut_lineage


def _known(df: DataFrame, column: str, group_by: list[str]) -> DataFrame:
    """Rows with a value; a single unnamed series when no group is given."""
    work = df.where(c(column).isNotNull())
    return work if group_by else work.withColumn("_series", F.lit("all"))


def _lagged(df: DataFrame, column: str, order_by: list[str], group_by: list[str] | None) -> tuple[DataFrame, list[str]]:
    group = list(group_by or ["_series"])
    known = _known(df, column, list(group_by or []))
    return known.select(*[c(g) for g in group], *[c(o) for o in order_by if o not in group], c(column).cast("double").alias("_x")), group


def _longest(base: DataFrame, group: list[str]) -> int:
    return base.groupBy(*[c(g) for g in group]).count().agg(F.max("count")).first()[0] or 0


def acf_pacf(df: DataFrame, column: str, order_by: list[str], group_by: list[str] | None = None, nlags: int = 40,
             max_rows: int = ROWS_PER_SERIES_TASK) -> DataFrame:
    """(series, lag, acf, pacf, band, significance) with the biased ACF and a regression PACF.

    Lagged products are summed for all lags in one pass; the PACF of lag k is the last coefficient of a least-squares regression whose
    normal equations follow from those sums and the ends of the series (``operators/lagged.py``), solved per series on a few numbers.
    """
    require_numeric(df, column)
    base, group = _lagged(df, column, order_by, group_by)
    longest = _longest(base, group)
    if longest < 4:
        raise ValueError("Need at least 4 observations for ACF/PACF.")
    top = max(1, min(int(nlags), longest // 2 - 1))
    summed = lagged.lag_sums(base, group, order_by, "_x", top, max_rows)
    schema = T.StructType([summed.schema[g] for g in group] + [
        T.StructField("lag", T.IntegerType()), T.StructField("acf", T.DoubleType()), T.StructField("pacf", T.DoubleType()),
        T.StructField("band", T.DoubleType()), T.StructField("significant_acf", T.BooleanType()),
        T.StructField("significant_pacf", T.BooleanType())])

    def solve(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                found = lagged.Lags.of(row)
                band = 1.96 / math.sqrt(found.rows)
                for k in range(max(1, min(top, found.rows // 2 - 1)) + 1):
                    a = 1.0 if k == 0 else found.sums[k] / found.sums[0] if found.sums[0] else float("nan")
                    p = float(lagged.least_squares(found.gram(k + 1), 0, list(range(1, k + 2)))[0][k - 1]) if k and found.rows > k else 1.0 if not k else float("nan")
                    out.append([row[g] for g in group] + [k, a, p, band, k > 0 and abs(a) > band, k > 0 and abs(p) > band])
            yield pd.DataFrame(out, columns=schema.names)

    found = summed.mapInPandas(solve, schema)
    return found if group_by else found.drop("_series")


def seasonal_decompose(df: DataFrame, column: str, order_by: list[str], group_by: list[str] | None = None,
                       period: int | None = None, model: str = "additive",
                       max_rows: int = ROWS_PER_SERIES_TASK) -> DataFrame:
    """(series, position, observed, trend, seasonal, resid) by centred moving averages.

    Trend ends are extended by a least-squares line through the nearest ``period`` trend values.
    """
    if model not in {"additive", "multiplicative"}:
        raise ValueError("model must be 'additive' or 'multiplicative'.")
    require_numeric(df, column)
    group = list(group_by or ["_series"])
    work = _known(df, column, list(group_by or [])).select(*[c(g) for g in group], *[c(o) for o in order_by if o not in group],
                                                           c(column).cast("double").alias("observed"))
    sizes = work.groupBy(*[c(g) for g in group]).agg(F.count("*").alias("_n"))
    least, longest = sizes.agg(F.min("_n"), F.max("_n")).first()
    if least is None or least < 4:
        raise ValueError("Need at least 4 observations for seasonal decomposition.")
    period = int(period or min(12, least // 2))
    if least < 2 * period:
        raise ValueError(f"Need at least two periods of {period} observations.")
    if model == "multiplicative" and work.where(F.col("observed") <= 0).limit(1).count():
        raise ValueError("multiplicative decomposition needs positive values.")
    half = period // 2
    if longest <= max_rows:
        order = Window.partitionBy(*[c(g) for g in group]).orderBy(*[c(o) for o in order_by])
        placed = work.withColumn("position", F.row_number().over(order) - 1)
    else:
        ranked = with_position(work, group + order_by, "_at", rows_per_bucket=max_rows)
        first = ranked.groupBy(*[c(g) for g in group]).agg(F.min("_at").alias("_first"))
        placed = ranked.join(first, group).withColumn("position", F.col("_at") - F.col("_first")).drop("_at", "_first")

    def moving(w) -> dict[str, Column]:
        inner = F.sum("observed").over(w.rowsBetween(-half, half))
        if period % 2 == 0:
            ends = F.coalesce(F.lag("observed", half).over(w), F.lit(0.0)) + F.coalesce(F.lead("observed", half).over(w), F.lit(0.0))
            inner = inner - 0.5 * ends
        return {"_trend": inner / period}

    smooth = over_series(placed, group, ["position"], half, half, moving, max_rows).join(sizes, group)
    complete = (F.col("position") >= half) & (F.col("position") < F.col("_n") - half)
    smooth = smooth.withColumn("_trend", F.when(complete, F.col("_trend")))
    p = F.col("position").cast("double")
    front = F.when(F.col("_trend").isNotNull() & (F.col("position") < half + period), F.col("_trend"))
    back = F.when(F.col("_trend").isNotNull() & (F.col("position") >= F.col("_n") - half - period), F.col("_trend"))
    lines = smooth.groupBy(*[c(g) for g in group]).agg(
        F.regr_slope(front, p).alias("_fs"), F.regr_intercept(front, p).alias("_fi"),
        F.regr_slope(back, p).alias("_bs"), F.regr_intercept(back, p).alias("_bi"))
    trend = F.coalesce("_trend", F.when(F.col("position") < half, F.col("_fi") + F.col("_fs") * p).otherwise(F.col("_bi") + F.col("_bs") * p))
    trended = smooth.join(lines, group).withColumn("trend", trend)
    additive = model == "additive"
    detrended = F.col("observed") - F.col("trend") if additive else F.col("observed") / F.col("trend")
    trended = trended.withColumn("_d", detrended).withColumn("_phase", F.pmod(F.col("position"), F.lit(period)))
    phases = trended.groupBy(*[c(g) for g in group], "_phase").agg(F.avg("_d").alias("_s"))
    level = F.avg("_s").over(Window.partitionBy(*[c(g) for g in group]))
    phases = phases.select(*[c(g) for g in group], "_phase", (F.col("_s") - level if additive else F.col("_s") / level).alias("seasonal"))
    out = trended.join(phases, group + ["_phase"])
    resid = (F.col("observed") - F.col("trend") - F.col("seasonal") if additive
             else F.col("observed") / (F.col("trend") * F.col("seasonal")))
    keep = [c(g) for g in (group_by or [])]
    return out.select(*keep, "position", "observed", "trend", "seasonal", resid.alias("resid"))


def seasonal_strength(decomposed: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """var(seasonal) / (var(seasonal) + var(resid)); strong above 0.3."""
    keys = [c(g) for g in (group_by or [])]
    s, e = F.var_pop("seasonal"), F.var_pop("resid")
    return (decomposed.groupBy(*keys).agg((s / (s + e + 1e-12)).alias("seasonal_strength"))
            .withColumn("has_strong_seasonality", F.col("seasonal_strength") > 0.3))


# fixed values: MacKinnon (1994, 2010) response surfaces for the ADF test with a constant
ADF_CONSTANT_LIMITS = (-18.83, -1.61, 2.74)     # smallest, star and largest statistic
ADF_CONSTANT_SMALL = (2.1659, 1.4412, 0.038269)
ADF_CONSTANT_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
# fixed values: KPSS (1992) critical values around a level and their tail probabilities
KPSS_LEVEL = (0.347, 0.463, 0.574, 0.739)
KPSS_TAIL = (0.10, 0.05, 0.025, 0.01)


def _adf_p(stat: float) -> float:
    low, star, high = ADF_CONSTANT_LIMITS
    if stat > high:
        return 1.0
    if stat < low:
        return 0.0
    weights = ADF_CONSTANT_SMALL if stat <= star else ADF_CONSTANT_LARGE
    z = sum(w * stat ** i for i, w in enumerate(weights))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf_test(df: DataFrame, column: str, order_by: list[str], group_by: list[str] | None = None, lags: int | None = None,
             max_rows: int = ROWS_PER_SERIES_TASK) -> DataFrame:
    """(series, n, adf_stat, adf_p, adf_is_stationary): the ADF test with a constant, with ``lags`` differences or as many as AIC asks for.

    Series of any length: the normal equations come from sums of lagged products (``operators/lagged.py``). Series with fewer than eight
    values, or too few for ``lags``, and constant ones have no statistic.
    """
    require_numeric(df, column)
    base, group = _lagged(df, column, order_by, group_by)
    top = max(1, (lagged.most_differences(_longest(base, group)) if lags is None else int(lags)) + 1)
    summed = lagged.lag_sums(base, group, order_by, "_x", top, max_rows)
    schema = T.StructType([summed.schema[g] for g in group] + [T.StructField("n", T.LongType()), T.StructField("adf_stat", T.DoubleType()),
                                                                T.StructField("adf_p", T.DoubleType()), T.StructField("adf_is_stationary", T.BooleanType())])

    def solve(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                found, stat = lagged.Lags.of(row), float("nan")
                if found.rows >= max(8, 2 * (lags or 0) + 4):
                    stat = lagged.adf_statistic(found, lags)
                p = _adf_p(stat) if stat == stat else float("nan")
                out.append([row[g] for g in group] + [found.rows, *((stat, p, bool(p < 0.05)) if stat == stat else (None, None, None))])
            yield pd.DataFrame(out, columns=schema.names)

    found = summed.mapInPandas(solve, schema)
    return found if group_by else found.drop("_series")


def kpss_test(df: DataFrame, column: str, order_by: list[str], group_by: list[str] | None = None, max_rows: int = ROWS_PER_SERIES_TASK) -> DataFrame:
    """(series, n, kpss_stat, kpss_p, kpss_is_stationary): the KPSS test around a level with the automatic bandwidth, for series of any length.

    The bandwidth comes from lagged sums, numerator and long-run variance from partial sums joined by place (``operators/lagged.py``).
    """
    require_numeric(df, column)
    base, group = _lagged(df, column, order_by, group_by)
    keys = [c(g) for g in group]
    base = cut_lineage(base)
    summed = lagged.lag_sums(base, group, order_by, "_x", max(1, int(_longest(base, group) ** (2 / 9))), max_rows)

    def width(batches):
        for batch in batches:
            yield pd.DataFrame([[row[g] for g in group] + [lagged.kpss_bandwidth(lagged.Lags.of(row))] for row in batch.to_dict("records")], columns=group + ["bandwidth"])

    widths = summed.mapInPandas(width, T.StructType([summed.schema[g] for g in group] + [T.StructField("bandwidth", T.LongType())]))
    parts = lagged.kpss_parts(lagged.partial_sums(base, group, order_by, "_x"), widths, group)
    longrun = F.col("moving") / (F.col("n") * (F.col("bandwidth") + 1))
    stat = F.when(longrun > 0, F.col("numerator") / (F.col("n") * F.col("n")) / longrun)
    # the tail probability by straight lines between the published critical values
    points = list(zip(KPSS_LEVEL, KPSS_TAIL))
    tail = F.when(F.col("kpss_stat") <= points[0][0], F.lit(points[0][1]))
    for (x0, p0), (x1, p1) in zip(points, points[1:]):
        tail = tail.when(F.col("kpss_stat") <= x1, p0 + (F.col("kpss_stat") - x0) * (p1 - p0) / (x1 - x0))
    found = parts.select(*keys, "n", stat.alias("kpss_stat"))
    found = found.withColumn("kpss_p", F.when(F.col("kpss_stat").isNotNull(), tail.otherwise(F.lit(points[-1][1]))))
    found = found.withColumn("kpss_is_stationary", F.col("kpss_p") > 0.05)
    return found if group_by else found.drop("_series")


def stationarity_test(df: DataFrame, column: str, order_by: list[str], group_by: list[str] | None = None,
                      max_rows: int = ROWS_PER_SERIES_TASK) -> DataFrame:
    """ADF and KPSS per series with the four-way verdict; series need eight observations and may have any length."""
    require_numeric(df, column)
    work = df if group_by else df.withColumn("_series", F.lit("all"))
    group = list(group_by or ["_series"])
    adf = adf_test(work, column, order_by, group, max_rows=max_rows)
    kpss = kpss_test(work, column, order_by, group, max_rows).drop("n")
    short = F.col("n") < 8
    both = adf.join(kpss, group)
    for name in ("kpss_stat", "kpss_p", "kpss_is_stationary"):
        both = both.withColumn(name, F.when(~short, F.col(name)))
    a, k = F.col("adf_is_stationary"), F.col("kpss_is_stationary")
    verdict = (F.when(short, "Need at least 8 observations.").when(a.isNull() | k.isNull(), "Undefined").when(a & k, "Stationary")
               .when(~a & ~k, "Non-stationary").otherwise("Conflicting"))
    found = both.select(*[c(g) for g in group], "n", "adf_stat", "adf_p", "adf_is_stationary", "kpss_stat", "kpss_p", "kpss_is_stationary", verdict.alias("verdict"))
    return found if group_by else found.drop("_series")


def forecast_ar(df: DataFrame, column: str, order_by: list[str], group_by: list[str] | None = None, horizon: int = 12,
                max_order: int = 12, max_rows: int = ROWS_PER_SERIES_TASK) -> DataFrame:
    """Per series an AR(p) on levels or first differences, (p, d) by AIC; mean path and 95 % band. Series may have any length.

    All candidates are solved from sums of lagged products; the path starts from the last values of the series.
    """
    require_numeric(df, column)
    base, group = _lagged(df, column, order_by, group_by)
    summed = lagged.lag_sums(base, group, order_by, "_x", int(max_order) + 1, max_rows)
    schema = T.StructType([summed.schema[g] for g in group] + [
        T.StructField("step", T.IntegerType()), T.StructField("forecast", T.DoubleType()), T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()), T.StructField("p", T.IntegerType()), T.StructField("d", T.IntegerType())])
    z = normal_quantile(0.975)

    def path(keys: list, found: lagged.Lags) -> list:
        best = lagged.autoregression(found, max_order) if found.rows >= 3 else None
        if best is None:
            return [keys + [h, found.mean, None, None, 0, 0] for h in range(1, horizon + 1)]
        p, d, beta, variance = best
        past = list(np.diff(found.tail, d))
        weights, out, level, spread = [1.0], [], found.tail[-1] + found.mean, 0.0
        for h in range(1, horizon + 1):
            nxt = float(beta[0] + sum(beta[k] * past[-k] for k in range(1, p + 1)))
            past.append(nxt)
            level = level + nxt if d else nxt + found.mean
            if h > 1:
                weights.append(float(sum(beta[k] * weights[h - 1 - k] for k in range(1, min(p, h - 1) + 1))))
            spread += (sum(weights) if d else weights[-1]) ** 2
            width = z * math.sqrt(variance * spread)
            out.append(keys + [h, level, level - width, level + width, p, d])
        return out

    def forecast(batches):
        for batch in batches:
            yield pd.DataFrame([r for row in batch.to_dict("records") for r in path([row[g] for g in group], lagged.Lags.of(row))], columns=schema.names)

    found = summed.mapInPandas(forecast, schema)
    return found if group_by else found.drop("_series")
