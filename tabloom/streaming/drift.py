"""Drift of a stream against a reference table, one result per closed event-time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tabloom.functions.columns import c, numeric_columns
from tabloom.operators.drift import HIGH_PSI, JS_DENSITY, MODERATE_PSI, PSI_COUNT, left_closed_bin
from tabloom.operators.quantiles import exact_quantiles


class DriftBaseline:
    """Bin edges and bin counts of the reference rows; values outside fall in the end bins."""

    def __init__(self, reference: DataFrame, columns: list[str] | None = None, n_bins: int = 10):
        self.columns = numeric_columns(reference, columns)
        self.n_bins = n_bins
        found = exact_quantiles(reference, self.columns, [i / n_bins for i in range(n_bins + 1)])
        self.edges = {n: sorted({v for v in q if v is not None}) for n, q in found.items()}
        counts = reference.select(F.explode(self.cells()).alias("e")).where(F.col("e.bin").isNotNull()).groupBy("e.column", "e.bin").count().collect()
        self.counts = {n: [0] * max(1, len(self.edges[n]) - 1) for n in self.columns}
        for r in counts:
            self.counts[r["column"]][r["bin"]] = r["count"]

    def cells(self) -> Column:
        """One (column, bin) struct per measured column."""
        return F.array(*[F.struct(F.lit(n).alias("column"), left_closed_bin(c(n).cast("double"), self.edges[n]).alias("bin"))
                         for n in self.columns])

    def frame(self, like: DataFrame) -> DataFrame:
        """(column, bin, ref): as many rows as there are bins."""
        rows = [(n, b, k) for n in self.columns for b, k in enumerate(self.counts[n])]
        return like.sparkSession.createDataFrame(rows, "column string, bin int, ref long")


def binned(df: DataFrame, baseline: DriftBaseline, ts: str, window: str) -> DataFrame:
    """(window, column, bin, count) of a batch or streaming DataFrame."""
    return (df.select(F.window(c(ts), window).alias("window"), F.explode(baseline.cells()).alias("e")).where(F.col("e.bin").isNotNull())
            .groupBy("window", F.col("e.column").alias("column"), F.col("e.bin").alias("bin")).agg(F.count("*").alias("cur")))


def window_drift(counts: DataFrame, baseline: DriftBaseline) -> DataFrame:
    """(window_start, window_end, column, n, psi, js, severity) from binned counts; edges are the reference's own."""
    keys = ["window", "column"]
    seen = counts.select(*keys).distinct()
    # the baseline has columns x bins rows
    grid = seen.join(F.broadcast(baseline.frame(counts)), "column")
    cells = grid.join(counts, keys + ["bin"], "left").select(*keys, "bin", "ref", F.coalesce("cur", F.lit(0)).alias("cur"))
    over = Window.partitionBy(*keys)
    smooth = PSI_COUNT * baseline.n_bins
    p = (F.col("ref") + PSI_COUNT) / (F.sum("ref").over(over) + smooth)
    q = (F.col("cur") + PSI_COUNT) / (F.sum("cur").over(over) + smooth)
    a, b = F.col("ref") / F.sum("ref").over(over) + JS_DENSITY, F.col("cur") / F.sum("cur").over(over) + JS_DENSITY
    shares = cells.select(*keys, "cur", p.alias("p"), q.alias("q"), a.alias("a"), b.alias("b"))
    m = (F.col("a") + F.col("b")) / 2
    js = 0.5 * F.sum(F.col("a") * F.log(F.col("a") / m)) + 0.5 * F.sum(F.col("b") * F.log(F.col("b") / m))
    psi = F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p")))
    out = shares.groupBy(*keys).agg(F.sum("cur").alias("n"), F.round(psi, 6).alias("psi"), F.round(F.least(F.greatest(js, F.lit(0.0)), F.lit(1.0)), 6).alias("js"))
    severity = F.when(F.col("psi") > HIGH_PSI, "HIGH").when(F.col("psi") > MODERATE_PSI, "MODERATE").otherwise("LOW")
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "column", "n", "psi", "js",
                      severity.alias("severity"))


def drift_stream(reference: DataFrame, stream: DataFrame, ts: str, window: str = "1 day", watermark: str = "1 hour",
                 columns: list[str] | None = None, n_bins: int = 10, sink=None, checkpoint: str | None = None,
                 trigger: dict | None = None) -> StreamingQuery:
    """Starts the query: counts per (window, column, bin) in append mode, drift per closed window handed
    to ``sink(df, batch_id)``. Rows later than the watermark are dropped."""
    baseline = DriftBaseline(reference, columns, n_bins)
    # watermarks need an instant; a zone-less column is read in the session zone
    counts = binned(stream.withColumn(ts, c(ts).cast("timestamp")).withWatermark(ts, watermark), baseline, ts, window)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            sink(window_drift(batch, baseline), batch_id)

    writer = counts.writeStream.outputMode("append").foreachBatch(handle).trigger(**(trigger or {"availableNow": True}))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
