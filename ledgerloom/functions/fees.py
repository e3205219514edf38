"""The gateway's fee model: commission by method, and GST on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rate card (method, basis points, threshold in paise, basis points above it, flat paise), the
# rate of an unknown method, and the GST percentage.
RATE_CARD = [
    ("upi", 0, None, None, 0), ("rupay_debit", 0, None, None, 0), ("debit_card", 40, 200000, 90, 0), ("credit_card", 200, None, None, 0),
    ("netbanking", 190, None, None, 0), ("wallet", 200, None, None, 0), ("emi", 250, None, None, 0), ("amex", 250, None, None, 0),
    ("international", 300, None, None, 0),
]
DEFAULT_BPS, GST_PERCENT, RADIUS = 200, 18, 4


def rate_card(spark: SparkSession, rows=RATE_CARD) -> DataFrame:
    return spark.createDataFrame(rows, "method string, bps long, threshold long, bps_above long, flat long")


def commission(gross: Column, bps: Column, threshold: Column, bps_above: Column, flat: Column) -> Column:
    rate = F.when(gross > threshold, bps_above).otherwise(bps)
    return F.floor((gross * rate + 5000) / F.lit(10000).cast("decimal(10,0)")).cast("long") + flat


def gst(fee: Column) -> Column:
    return F.floor((fee * GST_PERCENT + 50) / F.lit(100).cast("decimal(10,0)")).cast("long")


def with_fees(df: DataFrame, card: DataFrame, gross: str = "gross", method: str = "method") -> DataFrame:
    """Adds expected_fee, expected_tax and expected_net; an unknown method pays the default rate."""
    c = card.select(F.col("method").alias("_m"), *(F.col(x).alias(f"_{x}") for x in ("bps", "threshold", "bps_above", "flat")))
    joined = df.join(F.broadcast(c), F.col(method) == F.col("_m"), "left")  # a rate card has some ten rows
    fee = commission(F.col(gross), F.coalesce("_bps", F.lit(DEFAULT_BPS)), F.col("_threshold"), F.col("_bps_above"), F.coalesce("_flat", F.lit(0)))
    out = joined.withColumn("expected_fee", fee).withColumn("expected_tax", gst(F.col("expected_fee")))
    return out.withColumn("expected_net", F.col(gross) - F.col("expected_fee") - F.col("expected_tax")).drop("_m", "_bps", "_threshold", "_bps_above", "_flat")


def verify_fees(payments: DataFrame, card: DataFrame, tolerance: int = 1) -> DataFrame:
    """Adds delta (charged less expected, fee and tax together), fee_ok and what is wrong."""
    out = with_fees(payments, card).withColumn("delta", F.col("fee") + F.col("tax") - F.col("expected_fee") - F.col("expected_tax"))
    ok = F.abs(F.col("delta")) <= tolerance
    return out.withColumn("fee_ok", ok).withColumn(
        "explanation", F.when(ok, F.lit("ok")).when(F.col("delta") > 0, F.lit("overcharged")).otherwise(F.lit("undercharged"))
    )


def invert_fees(nets: DataFrame, card: DataFrame, net: str = "net", methods: DataFrame | None = None) -> DataFrame:
    """All grosses, by method, that leave the net after fees: (input columns, method, gross).

    Fees round, so several grosses may leave one net, or none.  Each rate gives a seed, and RADIUS paise around it are
    tried forwards.  The card has some ten rows, so every net meets each of them.
    """
    rates = card.select("method", F.explode(F.array_compact(F.array("bps", "bps_above"))).alias("_rate"), "flat").dropDuplicates(["method", "_rate"])
    tried = nets.join(F.broadcast(rates if methods is None else rates.join(methods, "method", "left_semi")))
    seed = F.round(
        (
            F.col(net).cast("decimal(30,8)") + F.col("flat") * F.lit(1.18).cast("decimal(4,2)")
        ) * 1000000 / (F.lit(1000000) - 118 * F.col("_rate")).cast("decimal(10,0)"),
        0
    ).cast("long")
    own = [c for c in nets.columns if c != "method"]
    grosses = tried.withColumn("gross", F.explode(F.sequence(seed - RADIUS, seed + RADIUS))).where("gross >= 1").select(*own, "method", "gross").distinct()
    return with_fees(grosses, card).where(F.col("expected_net") == F.col(net)).select(*own, "method", "gross")
