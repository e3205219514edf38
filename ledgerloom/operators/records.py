"""Matches and exceptions as rows, and how passes hand them on."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.reasons import reason_dim

EVIDENCE = "array<struct<kind:string,detail:string,weight:double,record_ids:array<string>>>"


@dataclass(frozen=True)
class Config:
    """Thresholds of a run; money in paise, spans in days (banking days where named so)."""

    amount_tolerance: int = 5
    batch_tolerance: int = 5
    fee_tolerance: int = 1
    reference_threshold: float = 0.60
    late_banking_days: int = 5
    plausible_banking_days: int = 6
    sla_banking_days: int = 2
    slack_days: int = 3
    max_cardinality: int = 6
    combination_budget: int = 5000
    shortlist: int = 8
    run_date: str = "2026-08-31"


@dataclass(frozen=True)
class PassOut:
    """What a pass made, and the records it took out of the pools: claims(kind, id), kind 's' or 'b'."""

    matches: DataFrame | None
    exceptions: DataFrame | None
    claims: DataFrame | None


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, in the folder the session names, that ends a pass's lineage."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerloom-"))
    return df.checkpoint(eager=True)


def evidence(kind: str, detail: Column, weight: Column | float, *ids: Column) -> Column:
    w = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight.cast("double")
    return F.struct(
        F.lit(kind).alias("kind"), detail.cast("string").alias("detail"), w.alias("weight"), F.array(*ids).cast("array<string>").alias("record_ids")
    )


def as_matches(df: DataFrame, tier: str | Column, reason: str | Column, confidence: Column, lines: Column, settlements: Column, bank_total: Column, expected_total: Column, proof: Column,
               rationale: Column | None = None, adjudicator: str | None = None) -> DataFrame:
    tier, reason = (F.lit(x) if isinstance(x, str) else x for x in (tier, reason))
    lines, settlements = F.array_sort(lines), F.array_sort(settlements)
    return df.select(
        stable_id("m", tier, F.concat_ws("|", lines), F.concat_ws("|", settlements)).alias("match_id"),
        lines.cast("array<string>").alias("bank_line_ids"),
        settlements.cast("array<string>").alias("settlement_ids"),
        tier.alias("tier"),
        reason.alias("reason"),
        F.round(confidence.cast("double"), 4).alias("confidence"),
        bank_total.cast("long").alias("bank_total"),
        expected_total.cast("long").alias("expected_total"),
        proof.cast(EVIDENCE).alias("evidence"),
        (F.lit("") if rationale is None else rationale).cast("string").alias("rationale"),
        F.lit(adjudicator).cast("string").alias("adjudicator"),
    )


def with_members(matches: DataFrame, payments: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds what a match's payouts are made of: payment_ids and ledger_entry_ids, sorted.  payments(settlement_id,
    payment_id) and ledger(settlement_id, entry_id) list them by payout."""
    out = matches
    for table, key, name in ((payments, "payment_id", "payment_ids"), (ledger, "entry_id", "ledger_entry_ids")):
        listed = matches.select("match_id", F.explode("settlement_ids").alias("settlement_id")).join(table.select("settlement_id", key), "settlement_id")
        found = listed.groupBy("match_id").agg(F.array_sort(F.collect_set(key)).alias(name))
        out = out.join(found, "match_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def as_exceptions(
    df: DataFrame, source: str, reason: str | Column, subjects: Column, amount: Column, as_of: Column, detail: Column,
    candidates: Column | None = None, delta: Column | None = None, proof: Column | None = None
) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    subjects = F.array_sort(subjects)
    return df.select(
        stable_id("x", reason, F.concat_ws("|", subjects)).alias("exception_id"),
        F.lit(source).alias("subject_source"),
        subjects.cast("array<string>").alias("subject_ids"),
        reason.alias("reason"),
        amount.cast("long").alias("amount"),
        as_of.cast("date").alias("as_of"),
        detail.cast("string").alias("summary"),
        (F.array().cast("array<string>") if candidates is None else F.array_sort(candidates).cast("array<string>")).alias("candidates"),
        (F.lit(None) if delta is None else delta).cast("long").alias("delta"),
        (F.array().cast(EVIDENCE) if proof is None else proof.cast(EVIDENCE)).alias("evidence"),
    )


def with_guidance(exceptions: DataFrame) -> DataFrame:
    """Adds severity, rank, owner and suggested action; an unknown reason is of medium severity and has no owner."""
    dim = reason_dim(exceptions.sparkSession)
    out = exceptions.join(F.broadcast(dim), "reason", "left")  # one row a reason
    return out.withColumn(
        "severity", F.coalesce("severity", F.lit("medium"))
    ).withColumn("rank", F.coalesce("rank", F.lit(2))).withColumn("owner", F.coalesce("owner", F.lit("Unclassified")))


def claims(df: DataFrame, settlements: Column | None, lines: Column | None) -> DataFrame:
    parts = []
    if settlements is not None:
        parts.append(df.select(F.lit("s").alias("kind"), F.explode(settlements).alias("id")))
    if lines is not None:
        parts.append(df.select(F.lit("b").alias("kind"), F.explode(lines).alias("id")))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def unclaimed(df: DataFrame, key: str, kind: str, claimed: DataFrame | None) -> DataFrame:
    return df if claimed is None else df.join(claimed.where(F.col("kind") == kind).select(F.col("id").alias(key)).distinct(), key, "left_anti")


def all_of(*frames: DataFrame | None) -> DataFrame | None:
    out = None
    for f in frames:
        if f is not None:
            out = f if out is None else out.unionByName(f)
    return out
