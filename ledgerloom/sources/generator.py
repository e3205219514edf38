"""Labelled batches of messy exports, made by hashing case numbers: the same seed gives the same rows anywhere."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import add_banking_days, calendar
from ..functions.fees import rate_card, with_fees

# Scenario, weight, disposition, expected reason, difficulty.
SCENARIOS = [
    ("clean_exact", 300, "match", "utr_exact", "trivial"), (
        "utr_noisy_narration", 120, "match", "utr_exact", "trivial"
    ), ("utr_truncated", 45, "match", "utr_in_narration", "routine"),
    ("utr_typo", 25, "match", "utr_in_narration", "hard"), (
        "no_utr_unique_amount", 55, "match", "amount_date_unique", "routine"
    ), ("rounding_drift", 40, "match", "rounding_tolerance", "routine"),
    ("fee_recovered", 30, "match", "fee_model_inverted", "hard"), ("batched_credit", 70, "match", "batch_subset_sum", "hard"), (
        "split_settlement", 30, "match", "split_settlement", "hard"
    ),
    ("late_credit", 35, "match", "utr_exact", "routine"), ("holiday_slip", 20, "match", "utr_exact", "routine"), (
        "timezone_boundary", 25, "match", "utr_exact", "hard"
    ),
    (
        "very_late_credit", 18, "exception", "date_out_of_window", "routine"
    ), ("refund_netted", 45, "match", "utr_exact", "routine"), ("chargeback_deduction", 25, "match", "utr_exact", "hard"),
    ("unlinked_chargeback", 12, "exception", "unlinked_chargeback", "unresolvable"), ("unlinked_refund", 12, "exception", "unlinked_refund", "unresolvable"),
    ("missing_bank_credit", 22, "exception", "missing_bank_credit", "unresolvable"), (
        "unexpected_credit", 20, "exception", "unexpected_bank_credit", "unresolvable"
    ),
    ("amount_mismatch", 18, "exception", "amount_mismatch", "routine"), ("same_amount_ambiguity", 16, "exception", "ambiguous_candidates", "unresolvable"),
    ("scale_error", 10, "exception", "scale_error_suspected", "routine"), ("transposition", 10, "exception", "transposition_suspected", "routine"),
    ("duplicate_utr", 10, "exception", "duplicate_identifier", "hard"), (
        "fee_overcharge", 14, "exception", "fee_schedule_deviation", "hard"
    ), ("fx_unverified", 12, "exception", "fx_unverified", "unresolvable"),
    ("ledger_missing", 14, "exception", "ledger_entry_missing", "routine"), ("partial_on_hold", 12, "exception", "partial_settlement_open", "routine"),
    ("malformed_amount", 8, "exception", "malformed_record", "routine"), ("reversal_pair", 18, "ignore", "reversal_netted", "hard"),
]
METHODS = ["upi", "debit_card", "credit_card", "netbanking", "wallet", "emi", "amex"]
BAD_AMOUNTS = ["", "#REF!", "N/A", "1,2E+05", "--"]
FIRST_DAY, SPAN = "2026-07-01", 31
NO_PAYOUT = ["unlinked_chargeback", "unlinked_refund", "unexpected_credit", "malformed_amount", "reversal_pair"]


@dataclass(frozen=True)
class Generated:
    files: dict[str, DataFrame]  # texts, as exports have them, by kind of file
    truth: DataFrame


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "scenario string, weight int, disposition string, expected_reason string, difficulty string")


def resolvable_share(spark: SparkSession) -> DataFrame:
    return catalogue(spark).agg((F.sum(F.when(F.col("disposition") != "exception", F.col("weight")).otherwise(0)) / F.sum("weight")).alias("share"))


def draw(seed: int, salt: str, most: int, *keys: Column) -> Column:
    """A number in 0..most - 1 from the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(most))


def _fixed(df: DataFrame) -> DataFrame:
    """Checkpointed, so that later expressions read columns instead of repeating how they were drawn."""
    from ..operators.matching import settle

    return settle(df)


def generate(spark: SparkSession, cases: int, seed: int = 1) -> Generated:
    """cases cases over a month, each of a scenario drawn by weight.  Batched credits take four payouts of their day."""
    total, at = sum(s[1] for s in SCENARIOS), 0
    which = F.lit(None).cast("string")
    for name, weight, *_ in SCENARIOS:
        which = F.when(draw(seed, "scenario", total, F.col("id")).between(at, at + weight - 1), F.lit(name)).otherwise(which)
        at += weight
    c = _fixed(spark.range(cases).withColumn("scenario", which))
    is_ = lambda *names: F.col("scenario").isin(*names)
    payouts = F.when(is_(*NO_PAYOUT), 0).when(is_("batched_credit"), 4).when(is_("same_amount_ambiguity"), 2).otherwise(1)
    captured = F.date_add(F.lit(FIRST_DAY).cast("date"), draw(seed, "day", SPAN, F.col("id")).cast("int"))
    captured = F.when(is_("holiday_slip"), F.lit("2026-11-05").cast("date")).otherwise(captured)
    c = c.withColumn("captured_on", captured).withColumn("payouts", payouts)
    cal = calendar(spark, "2026-06-01", "2026-12-31")
    local = F.when(is_("timezone_boundary"), F.date_add("captured_on", 1)).otherwise(F.col("captured_on"))
    c = add_banking_days(c.withColumn("local_on", local), "local_on", 2, "settled_on", cal)
    c = add_banking_days(add_banking_days(c, "settled_on", 1, "next_on", cal), "settled_on", 9, "far_on", cal)
    c = _fixed(c)
    s = c.where("payouts > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("payouts") - 1)))
    s = s.withColumn("settlement_id", F.format_string("setl_%08d_%d", "id", "part"))
    bare = is_("batched_credit", "same_amount_ambiguity", "fee_recovered")
    # the golden-ratio step keeps references far apart
    number = F.lpad(F.pmod(F.col("id") * 18033988749 + F.lit(seed * 7919 + 104729), F.lit(100000000000)).cast("string"), 11, "0")
    prefix = F.element_at(F.array(*map(F.lit, ["NORBN", "SUDBK", "ESTBR", "WESBC"])), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    s = s.withColumn("utr", F.when(~bare, F.concat(prefix, number)))
    per = F.when(is_("same_amount_ambiguity", "fee_recovered"), 1).when(is_("refund_netted", "chargeback_deduction"), 3).when(is_("split_settlement"), 2).otherwise(
        1 + draw(seed, "payments", 3, F.col("id"), F.col("part"))
    )
    p = s.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), per - 1)))
    same = F.when(is_("same_amount_ambiguity"), F.lit(0)).otherwise(F.col("part"))
    p = p.withColumn("gross", 50_000 + draw(seed, "gross", 4_000_000, F.col("id"), same, F.col("nth")))
    method = F.element_at(F.array(*map(F.lit, METHODS)), (draw(seed, "method", len(METHODS), F.col("id"), F.col("part"), F.col("nth")) + 1).cast("int"))
    p = p.withColumn("method", F.when(is_("same_amount_ambiguity"), "upi").when(is_("fx_unverified"), "international").otherwise(method))
    p = with_fees(p, rate_card(spark))
    over = F.when(
        is_("fee_overcharge") & (F.col("nth") == 0),
        F.greatest(F.lit(50), F.floor(F.col("gross") * (10 + draw(seed, "bps", 31, F.col("id"))) / 10000))
    ).otherwise(0).cast("long")
    p = p.withColumn("fee", F.col("expected_fee") + over).withColumn("net", F.expr("gross - fee - expected_tax")).withColumn(
        "payment_id", F.format_string("pay_%08d_%d_%d", "id", "part", "nth")
    )
    p = _fixed(p)
    net = p.groupBy("id", "part").agg(
        F.sum("net").alias("net"), F.array_sort(F.collect_list("payment_id")).alias("payment_ids"), F.min_by("net", "nth").alias("net0")
    )
    s = s.join(net, ["id", "part"])
    back = F.when(is_("refund_netted"), F.floor(F.col("net0") * 0.6)).when(is_("chargeback_deduction"), F.col("net0") + 75_000).otherwise(0).cast("long")
    held = F.when(is_("partial_on_hold"), F.floor(F.col("net") * (20 + draw(seed, "held", 26, F.col("id"))) / 100)).otherwise(0).cast("long")
    s = s.withColumn("back", back).withColumn("amount", F.col("net") - F.col("back") - held)
    s = _fixed(s)
    rupees = lambda x: F.concat(
        F.when(x < 0, "-").otherwise(""), F.floor(F.abs(x) / 100).cast("string"), F.lit("."), F.lpad((F.abs(x) % 100).cast("string"), 2, "0")
    )
    stamp = F.when(
        is_("timezone_boundary"), F.concat(F.date_format("captured_on", "yyyy-MM-dd"), F.lit("T23:45:00Z"))
    ).otherwise(F.concat(F.date_format("captured_on", "yyyy-MM-dd"), F.lit("T11:00:00+05:30")))
    payments = p.select("payment_id", F.concat(F.lit("ord_"), F.substring("payment_id", 5, 40)).alias("order_id"), rupees(F.col("gross")).alias("gross_amount"), rupees(F.col("fee")).alias("fee"), rupees(F.col("expected_tax")).alias("tax"),
                        rupees(F.col("net")).alias("net_amount"), stamp.alias("captured_at"), "method", F.lit("INR").alias("currency"), "settlement_id", F.when(is_("fx_unverified"), "true").otherwise("false").alias("international"))
    settlements = s.select("settlement_id", "utr", rupees(F.col("amount")).alias("amount"), F.concat(F.date_format("settled_on", "yyyy-MM-dd"), F.lit("T09:00:00+05:30")).alias("settled_at"), F.array_join("payment_ids", "|").alias("payment_ids"),
                           F.when(is_("refund_netted"), F.concat(F.lit("rfnd_"), "settlement_id")).alias("refund_ids"), F.when(
                               is_("chargeback_deduction"), F.concat(F.lit("adj_"), "settlement_id")
                           ).alias("adjustment_ids"))
    first = F.get("payment_ids", F.lit(0))
    day = F.date_format("captured_on", "yyyy-MM-dd")
    refunds = s.where(is_("refund_netted")).select(F.concat(F.lit("rfnd_"), "settlement_id").alias("refund_id"), first.alias("payment_id"), rupees(F.col("back")).alias("amount"), day.alias("created_at"), "settlement_id").union(
        c.where(is_("unlinked_refund")).select(
            F.format_string("rfnd_%08d", "id"), F.format_string("pay_prior_%08d", "id"), rupees(1000 + draw(seed, "r", 90_000, F.col("id"))), day,
            F.lit(None)
        ))
    adjustments = s.where(is_("chargeback_deduction")).select(F.concat(F.lit("adj_"), "settlement_id").alias("adjustment_id"), F.lit("chargeback").alias("kind"), rupees(-F.col("back")).alias("amount"), day.alias("created_at"), "settlement_id", first.alias("linked_payment_id")).union(
        c.where(is_("unlinked_chargeback")).select(
            F.format_string("adj_%08d", "id"), F.lit("chargeback"), rupees(-(1000 + draw(seed, "c", 90_000, F.col("id")))), day, F.lit(None),
            F.format_string("pay_prior_%08d", "id")
        ))
    ledger = p.where(~is_("ledger_missing")).select(
        F.concat(F.lit("led_"), F.substring("payment_id", 5, 40)).alias("entry_id"),
        F.concat(F.lit("ord_"), F.substring("payment_id", 5, 40)).alias("order_id"), rupees(F.col("gross")).alias("expected_gross"),
        day.alias("booked_on")
    )
    bank = _fixed(_bank(s, c, seed, is_))
    style = F.pmod("id", F.lit(4))
    shown = F.when(style == 0, F.date_format("value_date", "dd/MM/yyyy")).when(
        style == 1, F.date_format("value_date", "dd-MMM-yyyy")
    ).when(style == 2, F.date_format("value_date", "yyyy-MM-dd")).otherwise(F.date_format("value_date", "dd-MM-yyyy"))
    bad = F.element_at(F.array(*map(F.lit, BAD_AMOUNTS)), (F.pmod("id", F.lit(len(BAD_AMOUNTS))) + 1).cast("int"))
    statement = bank.select(
        "line_id", shown.alias("value_date"), "narration", F.when(is_("malformed_amount"), bad).otherwise(rupees(F.col("amount"))).alias("amount")
    )
    ids = lambda df, key, name: df.groupBy("id").agg(F.array_sort(F.collect_list(key)).alias(name))
    extra = refunds.select(
        F.col("refund_id").alias("record"), F.regexp_extract("refund_id", "(\\d{8})", 1).cast("long").alias("id")
    ).union(adjustments.select("adjustment_id", F.regexp_extract("adjustment_id", "(\\d{8})", 1).cast("long")))
    truth = c.select("id", "scenario").join(F.broadcast(catalogue(spark).drop("weight")), "scenario")  # one row a scenario
    for part in (
        ids(s, "settlement_id", "settlement_ids"), ids(bank, "line_id", "bank_line_ids"), ids(p, "payment_id", "payment_ids"),
        ids(extra, "record", "record_ids")
    ):
        truth = truth.join(part, "id", "left")
    truth = truth.select(
        F.format_string("case_%08d", "id").alias("case_id"), "scenario", "disposition", "expected_reason", "difficulty", "settlement_ids",
        "bank_line_ids", "payment_ids", "record_ids"
    )
    return Generated(
        {"payments": payments, "settlements": settlements, "refunds": refunds, "adjustments": adjustments, "bank": statement, "ledger": ledger}, truth
    )


def _bank(s: DataFrame, c: DataFrame, seed: int, is_) -> DataFrame:
    """Bank lines (id, scenario, line_id, value_date, narration, amount) of all scenarios."""
    at = F.pmod("id", F.lit(4))
    plain = F.when(
        at == 0, F.concat(F.lit("NEFT-"), "utr", F.lit("-ACME PAYMENTS PRIVATE LIMITED"))
    ).when(at == 1, F.concat(F.lit("MMT/IMPS/"), "utr", F.lit("/Settlement/ACME"))).when(at == 2, F.concat(
        F.lit("BY TRANSFER-NEFT*"), "utr", F.lit("*ACME SOFTWARE")
    )).otherwise(F.concat(F.lit("TRANSFER FROM "), "utr", F.lit(" ACME PVT LTD")))
    swapped = F.concat(F.left("utr", F.lit(7)), F.substring("utr", 9, 1), F.substring("utr", 8, 1), F.substring("utr", 10, 20))
    text = (
        F.when(is_("utr_noisy_narration"), F.concat(F.lit("CMS/RTGS "), "utr", F.lit(" BAL "), (F.col("id") % 90000).cast("string")))
        .when(is_("utr_truncated"), F.concat(F.lit("NEFT-"), F.left("utr", F.lit(12)))).when(is_("utr_typo"), F.concat(F.lit("NEFT-"), swapped, F.lit("-ACME")))
        .when(is_("no_utr_unique_amount", "fee_recovered", "same_amount_ambiguity"), F.lit("PAYMENT RECEIVED")).otherwise(plain)
    )
    digits = F.col("amount").cast("string")
    n = F.length(digits)
    turned = F.concat(F.substring(digits, F.lit(1), n - 2), F.right(digits, F.lit(1)), F.substring(digits, n - 1, F.lit(1))).cast("long")
    paid = (
        F.when(is_("rounding_drift"), F.col("amount") + F.element_at(F.array(F.lit(-2), F.lit(-1), F.lit(1), F.lit(2)), (at + 1).cast("int")))
        .when(is_("amount_mismatch"), F.col("amount") - F.greatest(F.lit(100), F.floor(F.col("amount") * (4 + draw(seed, "short", 22, F.col("id"))) / 100)))
        .when(is_("scale_error"), F.floor(F.col("amount") / 100)).when(is_("transposition"), turned).when(
            is_("split_settlement"), F.floor(F.col("amount") / 2)
        ).otherwise(F.col("amount"))
    ).cast("long")
    on = F.when(is_("late_credit"), F.col("next_on")).when(is_("very_late_credit"), F.col("far_on")).otherwise(F.col("settled_on"))
    row = lambda df, line, day, words, amount: df.select(
        "id", "scenario", line.alias("line_id"), day.alias("value_date"), words.alias("narration"), amount.cast("long").alias("amount")
    )
    own = s.where(~is_("missing_bank_credit", "batched_credit") & ~(is_("same_amount_ambiguity") & (F.col("part") == 1)))
    line = F.format_string("bank_%08d_1", "id")
    out = row(own, line, on, text, paid)
    second = s.where(is_("split_settlement", "duplicate_utr"))
    out = out.union(
        row(
            second, F.format_string("bank_%08d_2", "id"), F.col("settled_on"), plain,
            F.when(is_("duplicate_utr"), F.col("amount")).otherwise(F.col("amount") - F.floor(F.col("amount") / 2))
        )
    )
    sums = s.where(is_("batched_credit")).groupBy("id", "scenario", "settled_on").agg(F.sum("amount").alias("amount"))
    out = out.union(row(sums, line, F.col("settled_on"), F.lit("CONSOLIDATED PAYOUT"), F.col("amount")))
    lone = c.where(is_("unexpected_credit", "malformed_amount"))
    out = out.union(row(lone, line, F.col("settled_on"), F.lit("CASH DEPOSIT COUNTER"), 5_000_000 + draw(seed, "stray", 900_000_000, F.col("id"))))
    pair = c.where(is_("reversal_pair")).withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    token = F.concat(F.lit("REV RVSL"), F.lpad(F.pmod(F.col("id") * 7919 + seed, F.lit(10_000_000_000)).cast("string"), 10, "0"))
    return out.union(
        row(
            pair, F.format_string("bank_%08d_%s", F.col("id"), F.when(F.col("side") > 0, "c").otherwise("d")), F.col("settled_on"), token,
            F.col("side") * (100_000 + draw(seed, "rev", 90_000_000, F.col("id")))
        )
    )


def running_balance(bank: DataFrame) -> DataFrame:
    """Adds each account line's balance: a running sum by account, day and id."""
    w = Window.partitionBy("account").orderBy("value_date", "line_id").rowsBetween(Window.unboundedPreceding, 0)
    return bank.withColumn("balance", F.sum("amount").over(w))
