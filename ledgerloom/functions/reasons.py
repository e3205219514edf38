"""Why something is not settled: reasons, severities, owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEVERITIES = ["critical", "high", "medium", "low", "info"]
# Reason, severity, owner; summaries and actions are in our own words.
REASONS = [
    ("no_candidate", "high", "Finance ops", "Nothing in the window comes near this record.", "check that the period is covered and fetch the bank feed again"),
    (
        "amount_mismatch", "high", "Finance ops", "The counterpart is there but its amount is off.",
        "compare with the gateway's figures and look for a deduction"
    ),
    (
        "ambiguous_candidates", "medium", "Finance ops", "Several counterparts fit equally well.",
        "decide by the payer's text or ask the gateway for its references"
    ),
    ("scale_error_suspected", "critical", "Engineering", "One amount is a hundred times the other.", "check the currency unit of the feed"),
    (
        "transposition_suspected", "high", "Finance ops", "The amounts are the same digits in another order.",
        "look at the source document before changing either side"
    ),
    ("date_out_of_window", "medium", "Finance ops", "Reference and amount agree but the date is outside the cycle.", "check the settlement terms for a drift"),
    (
        "duplicate_identifier", "critical", "Engineering", "One reference stands on several records.",
        "look for a replayed import and hold settlement until then"
    ),
    ("missing_bank_credit", "high", "Treasury", "A payout has no bank credit.", "ask the gateway once the term has passed"),
    ("unexpected_bank_credit", "medium", "Treasury", "A bank credit has no payout or book entry.", "classify by hand; a direct transfer is likely"),
    ("fee_schedule_deviation", "high", "Finance", "The fee is not what the rate card says.", "claim the difference from the gateway"),
    ("unlinked_refund", "medium", "Finance ops", "A refund was deducted whose payment is not here.", "widen the period to find the payment"),
    ("unlinked_chargeback", "high", "Risk", "A chargeback has no disputed payment here.", "pull the dispute before its deadline"),
    ("currency_mismatch", "high", "Engineering", "The reference agrees and the currency does not.", "find where the currency is lost"),
    ("fx_unverified", "medium", "Treasury", "The conversion rate can't be checked.", "ask the gateway for the rate it used"),
    ("ledger_entry_missing", "medium", "Finance ops", "Money came in that the books do not show.", "book the receivable"),
    ("partial_settlement_open", "low", "Finance ops", "Part of the payout is still held back.", "wait a cycle and then ask"),
    ("adjudicator_abstained", "medium", "Finance ops", "The evidence did not allow a decision.", "decide by hand from the candidates"),
    ("verifier_rejected", "high", "Engineering", "A proposed match failed its checks.", "review the proposal"),
    ("malformed_record", "critical", "Engineering", "The record could not be read.", "mend the export; totals leave this record out"),
]


def reason_dim(spark: SparkSession) -> DataFrame:
    """(reason, severity, rank, owner, summary, action): one row a reason."""
    rows = [(r, s, SEVERITIES.index(s), o, text, a) for r, s, o, text, a in REASONS]
    return spark.createDataFrame(rows, "reason string, severity string, rank int, owner string, reason_summary string, action string")


def severity_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SEVERITIES)), "rank int, severity string")
