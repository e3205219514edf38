"""Dates in Indian wall time, and banking days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ZONE = "Asia/Kolkata"
# The bank holidays of 2026, and the layouts that exports use, tried in this order.
HOLIDAYS = [
    "2026-01-26", "2026-03-04", "2026-03-21", "2026-04-01", "2026-04-14", "2026-05-01", "2026-06-26",
    "2026-08-15", "2026-09-14", "2026-10-02", "2026-11-08", "2026-11-24", "2026-12-25",
]
WALL_LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d/M/yyyy HH:mm:ss", "d/M/yyyy", "d-M-yyyy",
    "d-MMM-yyyy", "d MMM yyyy", "d-MMM-yy", "MMM d, yyyy", "M/d/yyyy",
]
EPOCH_RANGE = (946684800, 4102444800)


def parse_datetime(raw: Column) -> Column:
    """TIMESTAMP_NTZ of the Indian wall clock, null where no layout fits.

    A text with an offset is an instant and is moved to India; others are wall time there already.  A bare number is
    an epoch only between the years 2000 and 2100.  Of two readings of a day and a month the day comes first.
    """
    s = F.trim(raw)
    offset = F.regexp_replace(F.regexp_replace(s, "Z$", "+00:00"), "([+-]\\d{2})(\\d{2})$", "$1:$2")
    instant = F.try_to_timestamp(F.when(offset.rlike("T.*[+-]\\d{2}:\\d{2}$"), offset), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    number = F.when(s.rlike("^\\d{9,10}$"), s.try_cast("long"))
    epoch = F.when(number.between(*EPOCH_RANGE), F.timestamp_seconds(number))
    here = lambda t: F.from_utc_timestamp(F.to_utc_timestamp(t, F.current_timezone()), ZONE).cast("timestamp_ntz")
    walls = [
        F.try_to_timestamp(
            F.when(~s.rlike("[+-]\\d{2}:?\\d{2}$|Z$") | s.rlike("^\\d{1,2}-|^\\d{4}-\\d{2}-\\d{2}$"), s), F.lit(x)
        ).cast("timestamp_ntz") for x in WALL_LAYOUTS
    ]
    return F.coalesce(here(instant), *walls, here(epoch))


def business_date(t: Column) -> Column:
    return t.cast("date")


def is_banking_day(day: Column, holidays=HOLIDAYS) -> Column:
    return (F.weekday(day) < 5) & ~day.isin([dt.date.fromisoformat(h) for h in holidays])


def calendar(spark: SparkSession, first: str, last: str, holidays=HOLIDAYS) -> DataFrame:
    """(day, banking, ord): ord counts banking days up to and with the day.  One row a day, so small whatever the data."""
    days = spark.range((dt.date.fromisoformat(last) - dt.date.fromisoformat(first)).days + 1).select(
        F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("day")
    )
    banking = days.withColumn("banking", is_banking_day(F.col("day"), holidays))
    return banking.withColumn("ord", F.sum(F.col("banking").cast("long")).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def add_banking_days(df: DataFrame, start: str, n, to: str, cal: DataFrame) -> DataFrame:
    """``to``: the n-th banking day after start; for n of 0 or less, start or the next banking day.  n: number or column."""
    n = F.lit(n) if isinstance(n, int) else n
    at = F.broadcast(cal.select(F.col("day").alias("_at"), F.col("ord").alias("_o"), F.col("banking").alias("_b")))  # a row a day
    target = F.broadcast(cal.where("banking").select(F.col("day").alias(to), F.col("ord").alias("_t")))
    step = F.when(n <= 0, F.when(F.col("_b"), F.lit(0)).otherwise(F.lit(1))).otherwise(n)
    return df.join(at, F.col(start) == F.col("_at"), "left").withColumn("_t2", F.col("_o") + step).join(
        target, F.col("_t2") == F.col("_t"), "left"
    ).drop("_at", "_o", "_b", "_t", "_t2")


def banking_days_between(df: DataFrame, a: str, b: str, to: str, cal: DataFrame) -> DataFrame:
    """``to``: banking days in (a, b], negative if b comes first."""
    one = F.broadcast(cal.select(F.col("day").alias("_da"), F.col("ord").alias("_oa")))  # a row a day
    two = F.broadcast(cal.select(F.col("day").alias("_db"), F.col("ord").alias("_ob")))
    return df.join(
        one, F.col(a) == F.col("_da"), "left"
    ).join(two, F.col(b) == F.col("_db"), "left").withColumn(to, F.col("_ob") - F.col("_oa")).drop("_da", "_db", "_oa", "_ob")


def next_banking_day(df: DataFrame, start: str, to: str, cal: DataFrame) -> DataFrame:
    return add_banking_days(df, start, 1, to, cal)


def settlement_window(df: DataFrame, captured: str, cal: DataFrame, cycle: int = 2, slack: int = 1) -> DataFrame:
    """target, earliest and latest: the cycle's banking day, and slack banking days to either side."""
    at = F.broadcast(cal.select(F.col("day").alias("_target"), F.col("ord").alias("_o")))  # a row a day
    pick = lambda name: F.broadcast(cal.where("banking").select(F.col("day").alias(name), F.col("ord").alias(f"_{name}")))
    out = add_banking_days(df, captured, cycle, "target", cal).join(at, F.col("target") == F.col("_target"), "left")
    for name, shift in (("earliest", -slack), ("latest", slack)):
        out = out.join(pick(name), F.col("_o") + shift == F.col(f"_{name}"), "left")
    return out.drop("_target", "_o", "_earliest", "_latest")


def date_range(first: Column, last: Column) -> Column:
    return F.sequence(first, last)
