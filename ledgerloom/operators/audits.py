"""Audits of the payout report by itself: none of them takes a record out of a pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fees import verify_fees
from ..sources.world import Batch
from .records import Config, as_exceptions, evidence


def payments_of(settlements: DataFrame, payments: DataFrame) -> DataFrame:
    """Known payments of each payout."""
    listed = settlements.select("settlement_id", F.explode("payment_ids").alias("payment_id"))
    return listed.join(payments.drop("settlement_id"), "payment_id")


def ledger_of(settlements: DataFrame, payments: DataFrame, ledger: DataFrame) -> DataFrame:
    """Book entries of each payout through its payments' orders; of several entries for an order the last one."""
    last = ledger.groupBy("order_id").agg(F.max("entry_id").alias("entry_id"))
    return payments_of(settlements, payments).join(last, "order_id").select("settlement_id", "payment_id", "entry_id")


def part_sums(payouts: DataFrame, b: Batch, keys: list[str], *more: Column) -> DataFrame:
    """By keys of payouts(payment_ids, refund_ids, adjustment_ids, ...): payments listed and known, sums of their gross,
    fee, tax and net, of refunds, and of adjustments with sign (adjustments) and by size (sizes).

    Payments, refunds and adjustments are parts of one table, so payouts are read and joined once.
    """
    listed = lambda kind: F.transform(f"{kind}_ids", lambda i: F.struct(F.lit(kind).alias("part"), i.alias("part_id")))
    ids = payouts.withColumn("_p", F.explode_outer(F.concat(*(F.coalesce(listed(k), F.array().cast("array<struct<part:string,part_id:string>>")) for k in ("payment", "refund", "adjustment")))))
    ids = ids.select(*(c for c in payouts.columns if not c.endswith("_ids")), "_p.part", "_p.part_id")
    nothing = {c: F.lit(None).cast("long") for c in ("fee", "tax", "net")}
    part = lambda df, kind, **values: df.select(
        F.lit(kind).alias("part"), F.col(f"{kind}_id").alias("part_id"), *(v.cast("long").alias(c) for c, v in values.items())
    )
    parts = part(b.payments, "payment", gross=F.col("gross"), fee=F.col("fee"), tax=F.col("tax"), net=F.col("net")).unionByName(
        part(b.refunds, "refund", gross=F.col("amount"), **nothing)
    ).unionByName(part(b.adjustments, "adjustment", gross=F.col("amount"), **nothing))
    known = ids.join(parts, ["part", "part_id"], "left")
    of = lambda kind, value: F.when(F.col("part") == kind, value)
    total = lambda value: F.coalesce(F.sum(value), F.lit(0))
    return known.groupBy(*keys).agg(
        F.count(of("payment", F.col("part_id"))).alias("n_listed"), F.count("net").alias("n_known"), total(of("payment", F.col("gross"))).alias("gross"),
        *(total(F.col(c)).alias(c) for c in ("fee", "tax", "net")), total(of("refund", F.col("gross"))).alias("refunds"),
        total(of("adjustment", F.col("gross"))).alias("adjustments"), total(of("adjustment", F.abs("gross"))).alias("sizes"), *more
    )


def component_sums(b: Batch, signed: bool = True) -> DataFrame:
    """Per payout: payments listed and known, sums of their parts, refunds and adjustments (signed or absolute)."""
    payouts = b.settlements.select("settlement_id", "amount", "settled_on", "payment_ids", "refund_ids", "adjustment_ids")
    out = part_sums(payouts, b, ["settlement_id", "amount", "settled_on"])
    return (out if signed else out.withColumn("adjustments", F.col("sizes"))).drop("sizes")


def component_audit(b: Batch, config: Config = Config()) -> DataFrame:
    """Payouts whose amount is not the sum of their parts; those with an unknown payment can't be judged."""
    sums = component_sums(b).where("n_known > 0 and n_known = n_listed").withColumn("expected", F.expr("net - refunds + adjustments"))
    off = sums.withColumn("delta", F.expr("amount - expected")).where(F.abs("delta") > config.amount_tolerance)
    reason = F.when(F.col("delta") < 0, "partial_settlement_open").otherwise("amount_mismatch")
    detail = F.format_string("Payout of %d where its parts make %d.", "amount", "expected")
    return as_exceptions(
        off, "psp", reason, F.array("settlement_id"), F.abs("delta"), F.col("settled_on"), detail, delta=F.col("delta"),
        proof=F.array(evidence("component_sum", detail, -0.5, F.col("settlement_id")))
    )


def fee_audit(b: Batch, card: DataFrame, config: Config = Config()) -> DataFrame:
    off = verify_fees(b.payments, card, config.fee_tolerance).where("not fee_ok")
    detail = F.format_string("%s: %s by %d.", F.col("method"), F.col("explanation"), F.abs("delta"))
    return as_exceptions(off, "psp", "fee_schedule_deviation", F.array("payment_id"), F.abs("delta"), F.col("captured_on"), detail, delta=F.col("delta"))


def fee_overcharge(b: Batch, card: DataFrame, config: Config = Config()) -> DataFrame:
    return verify_fees(b.payments, card, config.fee_tolerance).where("not fee_ok").agg(
        F.coalesce(F.sum(F.greatest(F.col("delta"), F.lit(0))), F.lit(0)).alias("fee_overcharge")
    )


def fx_audit(b: Batch) -> DataFrame:
    return as_exceptions(
        b.payments.where("international"), "psp", "fx_unverified", F.array("payment_id"), F.col("gross"), F.col("captured_on"),
        F.lit("Paid from abroad; the rate is not known.")
    )


def ledger_coverage(b: Batch) -> DataFrame:
    missing = b.payments.join(b.ledger.select("order_id"), "order_id", "left_anti")
    return as_exceptions(
        missing, "ledger", "ledger_entry_missing", F.array("payment_id"), F.col("gross"), F.col("captured_on"),
        F.concat(F.lit("No book entry for order "), "order_id")
    )


def unlinked_deductions(b: Batch) -> DataFrame:
    """Refunds and adjustments whose payment is not here; an adjustment that names none is unlinked too."""
    known = b.payments.select("payment_id")
    refunds = b.refunds.join(known, "payment_id", "left_anti")
    adjustments = b.adjustments.join(known.withColumnRenamed("payment_id", "linked_payment_id"), "linked_payment_id", "left_anti")
    reason = F.when(F.col("kind").isin("chargeback", "dispute_fee"), "unlinked_chargeback").otherwise("unlinked_refund")
    return as_exceptions(refunds, "psp", "unlinked_refund", F.array("refund_id"), F.col("amount"), F.col("created_on"), F.lit("Refund of an unknown payment.")).unionByName(
        as_exceptions(adjustments, "psp", reason, F.array("adjustment_id"), F.abs("amount"), F.col("created_on"), F.lit("Deduction for an unknown payment."))
    )


def quarantine_exceptions(quarantine: DataFrame, config: Config = Config()) -> DataFrame:
    """One exception for each row that couldn't be read.  A row without id is named by its place in the file, or where
    that isn't known by its text, so rows of one file stay apart."""
    text = F.left(F.sha2(F.to_json("raw"), 256), F.lit(12))
    subject = F.coalesce("record_id", F.concat(F.col("source_file"), F.lit(":"), F.coalesce(F.col("row_number").cast("string"), text)))
    return as_exceptions(
        quarantine, "bank", "malformed_record", F.array(subject), F.lit(0), F.lit(config.run_date).cast("date"),
        F.concat_ws(": ", "source_file", F.col("reason"))
    )


def duplicate_references(settlements: DataFrame) -> DataFrame:
    from ..functions.narration import normalize_ref

    return settlements.where("utr is not null").groupBy(normalize_ref(F.col("utr")).alias("utr")).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("settlement_id")), ",").alias("settlement_ids")
    ).where("n > 1")
