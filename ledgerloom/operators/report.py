"""Key figures and the views that a front end asks for."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.reasons import SEVERITIES
from .records import with_guidance


def tier_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("bank_total").cast("long").alias("value"))


def reason_counts(exceptions: DataFrame) -> DataFrame:
    return exceptions.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def severity_counts(exceptions: DataFrame) -> DataFrame:
    return with_guidance(exceptions).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("long").alias("value"))


def match_rate(matches: DataFrame, settlements: DataFrame) -> DataFrame:
    """One row: distinct matched payouts, payouts, and their ratio to four digits (0 of none)."""
    got = matches.select(F.explode("settlement_ids").alias("settlement_id")).agg(F.count_distinct("settlement_id").alias("matched"))
    return got.join(settlements.agg(F.count(F.lit(1)).alias("settlements"))).withColumn(
        "match_rate", F.expr("CASE WHEN settlements = 0 THEN 0.0 ELSE round(CAST(matched AS DOUBLE) / settlements, 4) END")
    )


def values(matches: DataFrame, exceptions: DataFrame) -> DataFrame:
    at_risk = with_guidance(exceptions).where(F.col("severity").isin("critical", "high")).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).cast("long").alias("value_at_risk")
    )
    return matches.agg(F.coalesce(F.sum("bank_total"), F.lit(0)).cast("long").alias("value_matched")).join(at_risk)


def daily_series(matches: DataFrame, settlements: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Matched payouts and exceptions by day, zero where a day has none."""
    m = matches.select(F.explode("settlement_ids").alias("settlement_id")).distinct().join(
        settlements.select("settlement_id", "settled_on", "amount"), "settlement_id"
    )
    a = m.groupBy(F.col("settled_on").alias("day")).agg(F.sum("amount").cast("long").alias("matched"))
    b = exceptions.groupBy(F.col("as_of").alias("day")).agg(F.sum("amount").cast("long").alias("excepted"))
    return a.join(b, "day", "full_outer").fillna(0, ["matched", "excepted"])


def exposure(exceptions: DataFrame) -> DataFrame:
    """Count, value and worst severity by reason."""
    return with_guidance(exceptions).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("long").alias("value"), F.min_by("severity", "rank").alias("worst")
    )


def register(exceptions: DataFrame) -> DataFrame:
    """Exceptions with guidance, the gravest and largest first."""
    return with_guidance(exceptions).orderBy("rank", F.desc("amount"), "exception_id")


def exception_page(
    exceptions: DataFrame, severity: str | None = None, reason: str | None = None, text: str | None = None, limit: int = 60, offset: int = 0
) -> DataFrame:
    """One page of the register under filters: a severity ceiling, a reason, a text in the summary or a subject id."""
    return filtered(exceptions, severity, reason, text).orderBy("rank", F.desc("amount"), "exception_id").offset(max(0, offset)).limit(max(1, min(1000, limit)))


def filtered(exceptions: DataFrame, severity: str | None = None, reason: str | None = None, text: str | None = None) -> DataFrame:
    x = with_guidance(exceptions)
    if severity:
        x = x.where(F.col("rank") <= SEVERITIES.index(severity))
    if reason:
        x = x.where(F.col("reason") == reason)
    if text:
        needle = F.lit(text.lower())
        x = x.where(F.contains(F.lower("summary"), needle) | F.exists("subject_ids", lambda i: F.contains(F.lower(i), needle)))
    return x


def page_info(exceptions: DataFrame, limit: int = 60, offset: int = 0, **filters) -> DataFrame:
    """One row: how many exceptions the filter leaves, and whether there are more beyond the page."""
    end = max(0, offset) + max(1, min(1000, limit))
    return filtered(exceptions, **filters).agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.col("total") > end)


def exception_detail(exceptions: DataFrame, settlements: DataFrame, bank: DataFrame, payments: DataFrame) -> DataFrame:
    """Exceptions with guidance and the records that they name, in the order in which they name them."""
    related = related_records(exceptions, settlements, bank, payments)
    listed = related.groupBy("exception_id").agg(F.array_sort(F.collect_list(F.struct("place", "record_id", "kind", "amount", "day"))).alias("related"))
    return with_guidance(exceptions).join(listed, "exception_id", "left")


def page_facts(exceptions: DataFrame, **filters) -> DataFrame:
    """Counts by severity and value of all that a filter leaves, not of the page alone."""
    return filtered(exceptions, **filters).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("long").alias("value"))


def match_page(matches: DataFrame, tier: str | None = None, limit: int = 120) -> DataFrame:
    return (matches.where(F.col("tier") == tier) if tier else matches).orderBy("match_id").limit(max(1, min(500, limit)))


def journal_page(entries: DataFrame, limit: int = 40) -> DataFrame:
    return entries.orderBy("posted_on", "entry_id").limit(max(1, min(400, limit)))


def related_records(exceptions: DataFrame, settlements: DataFrame, bank: DataFrame, payments: DataFrame, first: int = 12) -> DataFrame:
    """The first records that an exception names, each as a payout, else a bank line, else a payment."""
    ids = exceptions.select(
        "exception_id", F.posexplode(F.array_distinct(F.concat("subject_ids", "candidates"))).alias("place", "record_id")
    ).where(F.col("place") < first)
    s = settlements.select(
        F.col("settlement_id").alias("record_id"),
        F.struct(F.lit("settlement").alias("kind"), F.col("amount").alias("amount"), F.col("settled_on").alias("day")).alias("s")
    )
    b = bank.select(
        F.col("line_id").alias("record_id"),
        F.struct(F.lit("bank_line").alias("kind"), F.col("amount").alias("amount"), F.col("value_date").alias("day")).alias("b")
    )
    p = payments.select(
        F.col("payment_id").alias("record_id"),
        F.struct(F.lit("payment").alias("kind"), F.col("gross").alias("amount"), F.col("captured_on").alias("day")).alias("p")
    )
    found = ids.join(s, "record_id", "left").join(b, "record_id", "left").join(p, "record_id", "left").withColumn("r", F.coalesce("s", "b", "p"))
    return found.where("r is not null").select("exception_id", "place", "record_id", "r.kind", "r.amount", "r.day")


def interesting(exceptions: DataFrame, per_reason: int = 3) -> DataFrame:
    """The largest exceptions of each reason."""
    w = Window.partitionBy("reason").orderBy(F.desc("amount"), "exception_id")
    return with_guidance(exceptions).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_reason)


def scenario_summary(catalogue: DataFrame, cases: DataFrame) -> DataFrame:
    """Every scenario of the catalogue with its cases and how many came out right; scenarios without a case stay."""
    from .scorecard import GOOD

    by = cases.groupBy("scenario").agg(F.count(F.lit(1)).alias("cases"), F.sum(F.col("verdict").isin(GOOD).cast("long")).alias("good"))
    return catalogue.join(by, "scenario", "left").fillna(0, ["cases", "good"])


def counted(df: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """One row: a map from each key to its rows, or to the sum of a value."""
    n = F.count(F.lit(1)) if value is None else F.sum(value).cast("long")
    return df.groupBy(key).agg(n.alias("_n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), "_n")))).alias("counts"))


def counters(run) -> DataFrame:
    """One row of what each pass did: payouts matched by reason, exceptions by reason, and what was taken in vain."""
    m, x = run.proposed, run.exceptions
    by = lambda *reasons: F.count_if(F.col("reason").isin(*reasons))
    left = m.agg(
        by(
            "utr_exact", "utr_in_narration"
        ).alias("identifier_matched"), by("split_settlement").alias("split_matched"), by("amount_date_unique").alias("unique_amount_matched"),
        by("batch_subset_sum").alias("batches_matched"), by("rounding_tolerance").alias("tolerance_matched"), by("adjudicated_match").alias("adjudicated"), by("reversal_netted").alias("reversals_netted"))
    right = x.agg(
        by("fee_schedule_deviation").alias("fee_deviations"), by("fx_unverified").alias("fx_unverified"), by("ledger_entry_missing").alias("ledger_missing"),
        by(
            "unlinked_refund", "unlinked_chargeback"
        ).alias("unlinked_deductions"), by("ambiguous_candidates").alias("ambiguous"), by("malformed_record").alias("quarantined"))
    return left.join(right)


def run_summary(run) -> DataFrame:
    """One row of key figures of a finished run (plans.cascade.Run): sizes, rates, counts by tier, reason and severity,
    stage times, adjudication, checks, posting and the passes' counters.  Every join is of single rows."""
    from .journal import totals
    from .verify import report as checks

    b = run.batch
    rows = match_rate(run.accepted, b.settlements).join(values(run.accepted, run.exceptions)).join(b.record_count())
    rows = rows.join(run.accepted.agg(F.count(F.lit(1)).alias("matches"))).join(run.exceptions.agg(F.count(F.lit(1)).alias("exceptions")))
    rows = rows.join(b.bank.agg(F.count(F.lit(1)).alias("bank_lines"))).join(b.payments.agg(F.count(F.lit(1)).alias("payments")))
    for df, key, name in (
        (run.accepted, "tier", "tier_counts"), (run.exceptions, "reason", "reason_counts"),
        (with_guidance(run.exceptions), "severity", "severity_counts")
    ):
        rows = rows.join(counted(df, key).withColumnRenamed("counts", name))
    rows = rows.join(
        checks(run.proposed, run.violations).select(
            "violations", F.col("rejected").alias("verifier_rejections"), F.col("adjudicated_rejections").alias("verifier_rejected_adjudications")
        )
    )
    posted = totals(run.journal).select(
        F.col("entries").alias("journal_entries"), F.col("balanced").alias("journal_balances"), F.col("debits").alias("journal_debits"),
        F.col("credits").alias("journal_credits")
    )
    seconds = sum(run.timings.values())
    times = F.map_from_arrays(
        F.array(*map(F.lit, run.timings)), F.array(*map(F.lit, run.timings.values()))
    ) if run.timings else F.lit(None).cast("map<string,double>")
    out = rows.join(posted).join(counters(run)).withColumn(
        "adjudicator", F.lit(run.adjudicator)
    ).withColumn("stage_timings", times).withColumn("seconds", F.lit(seconds))
    return out.withColumn("throughput_per_second", F.when(F.col("seconds") > 0, F.round(F.col("records") / F.col("seconds"), 1)))


def ask(question: str, run) -> DataFrame:
    """Answers a plain question with the rows that ground it; the first topic that fits is taken."""
    q = question.lower().strip()
    has = lambda *words: any(w in q for w in words)
    x = run.exceptions
    if not q:
        return run_summary(run)
    if has("at risk", "exposure"):
        return severity_counts(x).where(F.col("severity").isin("critical", "high"))
    if has("critical", "worst", "urgent"):
        return exception_page(x, severity="critical", limit=4)
    if has("duplicate", "twice"):
        return filtered(x, reason="duplicate_identifier")
    if has("match rate", "how many matched", "matched"):
        return match_rate(run.accepted, run.batch.settlements)
    if has("accuracy", "precision", "recall"):
        from .scorecard import ratios

        return ratios(run.cases) if run.cases is not None else run_summary(run)
    if has("agent", "adjudicat"):
        return run.accepted.where("tier = 'T7'")
    if has("verif", "veto", "reject"):
        from .verify import violation_counts

        return violation_counts(run.violations)
    if has("fee", "finding", "overcharge"):
        return exposure(x)
    if has("throughput", "records", "volume"):
        return run.batch.record_count()
    record = re.search(r"\b(setl|bank|pay|x)_[a-z0-9_]+", q)
    if record:
        return x.where(F.array_contains("subject_ids", record[0]) | F.array_contains("candidates", record[0]) | (F.col("exception_id") == record[0]))
    from ..functions.reasons import REASONS

    named = next((r for r, *_ in REASONS if r in q or r.replace("_", " ") in q), None)
    return filtered(x, reason=named) if named else exposure(x)
