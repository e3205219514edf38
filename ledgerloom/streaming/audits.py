"""The fee audit over a stream of payments.  Whole runs stay batches: matching needs both sides of the period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fees import verify_fees


def fee_deviations(payments: DataFrame, card: DataFrame, tolerance: int = 1) -> DataFrame:
    """Payments of a stream whose fee is off the card; stateless, so late rows need no watermark."""
    return verify_fees(payments, card, tolerance).where("not fee_ok").select("payment_id", "method", "delta", "explanation")


def overcharge_by_hour(payments: DataFrame, card: DataFrame, late: str = "2 days") -> DataFrame:
    """Overcharge by hour of capture; rows later than ``late`` are not counted, and their hours' state is dropped."""
    off = verify_fees(payments.withWatermark("captured_at", late), card).where("not fee_ok and delta > 0")
    return off.groupBy(F.window("captured_at", "1 hour")).agg(F.sum("delta").alias("overcharge"), F.count(F.lit(1)).alias("payments"))
