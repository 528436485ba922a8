"""Shapes of date texts never hide what a layout would read."""

from pyspark.sql import functions as F

from tabloom.operators.dates import DATE_FORMATS, FIRST_YEAR, LAST_YEAR, parse_timestamp

TEXTS = ["2024-01-02", "2024-1-2", "2024", "2024-03", "2024-01-02 03:04:05", "2024-01-02T03:04:05.123Z", "2024-01-02 03:04:05+02:00", "+2024-01-02", "-2024-01-02", "1/2/2024",
         "01/02/2024", "13/2/2024", "1/2/24", "1/2/2024 3:04", "1/2/2024 3:04:05", "2024/1/2", "2024/01/02 03:04:05", "2024/1/2 3:04", "5-Mar-2024", "05-mar-2024", "5-March-2024",
         "Mar 5, 2024", "March 5, 2024", "mar 5 2024", "20240105", "20241305", "2024010", "202401055", "12345", "123", "99999999", "173.25", "n/a", "", "  2024-01-02 ", "03:04:05",
         "T03:04", "2024-02-30", "1500-01-01", "3000-01-01", "x:y", "Ma5, 2024", "5--2024", "１２/１/2024", None]


def test_shapes_change_no_result(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    trimmed = F.trim("t")
    plain = F.coalesce(F.try_to_timestamp(trimmed), *[F.try_to_timestamp(trimmed, F.lit(f)) for f in DATE_FORMATS])
    plain = F.when(F.year(plain).between(FIRST_YEAR, LAST_YEAR), plain)
    rows = df.select("t", parse_timestamp(F.col("t")).alias("a"), plain.alias("b")).collect()
    timed = {"03:04:05", "T03:04"}  # today's date
    assert [r.t for r in rows if r.a != r.b and r.t not in timed] == [] and sum(r.a is not None for r in rows) > 20
