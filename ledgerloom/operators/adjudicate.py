"""Weighing the evidence where no rule decides, or declining to."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import money as M
from ..functions.dates import banking_days_between
from ..functions.fees import invert_fees
from ..functions.narration import candidates, score_matches
from .audits import component_sums
from .joins import contested, in_window, window_candidates, with_windows
from .matching import settle
from .records import Config, PassOut, as_matches, claims, evidence

# What each piece of evidence weighs, and what a decision needs.
STRONG_REF, WEAK_REF, EXACT, NEAR, SCALE, TRANSPOSED, OFF, ON_TIME, LATE, PER_DAY, INVERTS = 0.55, 0.28, 0.35, 0.22, -0.60, -0.50, -0.45, 0.12, 0.06, -0.05, 0.15
DECIDE, MARGIN = 0.60, 0.15


class Adjudicator(Protocol):
    """Turns shortlisted candidates (one row per settlement_id and line_id, with features) into one decision row per
    settlement_id: decision ('match' or 'abstain'), line_id, confidence, rationale."""

    def __call__(self, candidates: DataFrame) -> DataFrame: ...


def shortlist(settlements: DataFrame, credits: DataFrame, cal: DataFrame, card: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """The best few open credits of each payout's window, with what speaks for and against them."""
    s = with_windows(settlements, cal, config).select("settlement_id", "utr", F.col("amount").alias("payout"), "settled_on", "win_lo", "win_hi")
    ids = window_candidates(s, credits, config.shortlist)
    pairs = ids.join(
        credits.select("line_id", "amount", "value_date", "narration"), "line_id"
    ).join(s.withColumn("utr", F.coalesce("utr", F.lit(""))), "settlement_id")
    scored = score_matches(pairs).withColumn("delta", F.expr("amount - payout"))
    rank = F.row_number().over(Window.partitionBy("settlement_id").orderBy(F.desc("score"), F.abs("delta"), "line_id"))
    best = scored.withColumn("place", rank).where(F.col("place") <= config.shortlist)
    out = banking_days_between(best, "settled_on", "value_date", "late", cal)
    out = out.withColumn("scale_error", M.is_scale_error(F.col("amount"), F.col("payout"))).withColumn(
        "transposition", M.is_transposition(F.col("amount"), F.col("payout"))
    )
    if card is None:
        return out.withColumn("inverts", F.lit(False))
    off = F.abs("delta") > config.amount_tolerance
    nets = out.where(off).select(F.col("amount").alias("net")).distinct()
    hits = invert_fees(nets, card).select(F.col("net").alias("amount")).distinct().withColumn("_hit", F.lit(True))
    return out.join(hits, "amount", "left").withColumn("inverts", off & F.coalesce("_hit", F.lit(False))).drop("_hit")


def evidence_score(tolerance: int = 5) -> Column:
    """Sum of the weights, between 0 and 1, to four digits."""
    reference = F.when(F.col("score") >= 0.85, F.col("score") * STRONG_REF).when(F.col("score") >= 0.60, F.col("score") * WEAK_REF).otherwise(0.0)
    amount = F.when(F.col("delta") == 0, EXACT).when(F.abs("delta") <= tolerance, NEAR).when(F.col("scale_error"), SCALE).when(
        F.col("transposition"), TRANSPOSED
    ).otherwise(OFF)
    date = F.when(F.col("late") == 0, ON_TIME).when(F.col("late").between(1, 3), LATE).otherwise(F.abs("late") * PER_DAY)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), reference + amount + date + F.when(F.col("inverts"), INVERTS).otherwise(0.0))), 4)


def offline(candidates: DataFrame) -> DataFrame:
    """The default adjudicator: the best candidate, if it is good enough and clearly better than the next."""
    w = Window.partitionBy("settlement_id").orderBy(F.desc("confidence"), "line_id")
    ranked = candidates.withColumn("confidence", evidence_score()).withColumn("_k", F.row_number().over(w)).withColumn(
        "next", F.lead("confidence").over(w)
    ).where("_k = 1")
    margin = F.col("confidence") - F.col("next")
    why = F.when(F.col("confidence") < DECIDE, "evidence too weak").when(margin < MARGIN, "too close to the next").otherwise("clear")
    return ranked.withColumn("rationale", why).withColumn("decision", F.when(F.col("rationale") == "clear", "match").otherwise("abstain"))


def adjudication(
    settlements: DataFrame, credits: DataFrame, cal: DataFrame, card: DataFrame | None = None, adjudicator: Adjudicator | None = offline,
    config: Config = Config()
) -> tuple[PassOut, DataFrame]:
    """Matches by weight of evidence, and what was declined (settlement_id, reviewed, rationale).

    Payouts go in order of id.  A match holds unless an earlier payout's match of the round takes a credit from its
    shortlist, then it is looked at again; rounds go on until one brings none.  Only payouts whose shortlist has lost a
    credit are listed and decided anew, against the credits of their windows' days; all others keep what they have.
    """
    if adjudicator is None:
        none = settlements.limit(0).select("settlement_id", F.array().cast("array<string>").alias("reviewed"), F.lit("").alias("rationale"))
        return PassOut(None, None, None), none
    out, s, c = None, settlements, credits
    listed = settle(shortlist(s, c, cal, card, config))
    decided = settle(adjudicator(listed))
    while True:
        matched = decided.where("decision = 'match'").select("settlement_id", "line_id", "confidence", "rationale", "payout", "amount", "score", "delta")
        takes = matched.select(F.col("settlement_id").alias("_by"), "line_id")
        members = listed.select("settlement_id", "line_id")
        disturbed = members.join(takes, "line_id").where(F.col("_by") < F.col("settlement_id")).select("settlement_id").distinct()
        valid = settle(matched.join(disturbed, "settlement_id", "left_anti"))
        out = valid if out is None else out.unionByName(valid)
        if valid.isEmpty():
            break
        s, c = settle(s.join(valid, "settlement_id", "left_anti")), settle(c.join(valid, "line_id", "left_anti"))
        lost = settle(members.join(valid.select("line_id"), "line_id", "left_semi").select("settlement_id").distinct())
        again = s.join(lost, "settlement_id", "left_semi")
        near = with_windows(again, cal, config).select(F.explode(F.sequence("win_lo", "win_hi")).alias("value_date")).distinct()
        fresh = settle(shortlist(again, c.join(near, "value_date", "left_semi"), cal, card, config))
        listed = settle(listed.join(lost, "settlement_id", "left_anti").unionByName(fresh))
        decided = settle(decided.join(lost, "settlement_id", "left_anti").unionByName(adjudicator(fresh)))
    declined = settle(decided.where("decision <> 'match'").select("settlement_id", "rationale").join(
        listed.groupBy("settlement_id").agg(F.collect_set("line_id").alias("reviewed")), "settlement_id"
    ))
    name = getattr(adjudicator, "name", getattr(adjudicator, "__name__", "adjudicator"))
    proof = F.array(evidence("adjudicated", F.concat(F.lit("weight of evidence "), F.col("confidence").cast("string")), F.col("confidence"), F.col("line_id")))
    m = as_matches(
        out, "T7", "adjudicated_match", F.col("confidence"), F.array("line_id"), F.array("settlement_id"), F.col("amount"), F.col("payout"), proof,
        F.col("rationale"), name
    )
    return PassOut(m, None, claims(out, F.array("settlement_id"), F.array("line_id"))), declined


# What an investigator asks about one payout's candidates, as frames.
def scan_references(scored: DataFrame, first: int = 8) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("settlement_id").orderBy(F.desc("score"), "line_id"))
    return scored.withColumn("_r", rank).where(F.col("_r") <= first).select(
        "settlement_id", "line_id", "score", "mechanism", strength(F.col("score")).alias("strength"), (F.col("score") >= 0.75).alias("carries")
    )


def get_credit(credits: DataFrame) -> DataFrame:
    """What an investigator sees of a credit: amount, day, narration and its reference-like tokens, the likeliest first."""
    return credits.select("line_id", "amount", "value_date", "narration", F.transform(candidates(F.col("narration")), lambda c: c["token"]).alias("tokens"))


def score_reference(pairs: DataFrame) -> DataFrame:
    """How well each pair's reference fits its narration (utr, narration): score, mechanism and a verdict."""
    return score_matches(pairs).withColumn("strength", strength(F.col("score")))


def strength(score: Column) -> Column:
    return F.when(score >= 0.95, "decisive").when(score >= 0.75, "strong").when(score > 0, "weak").otherwise("none")


def payout_components(b) -> DataFrame:
    """What each payout is made of, as far as it is known: sums of the known payments, refunds and adjustments, what
    they make, and how many payments are listed and known."""
    out = component_sums(b).withColumn("expected", F.expr("net - refunds + adjustments"))
    return out.select(
        "settlement_id", "n_listed", "n_known", "gross", "fee", "tax", "net", "refunds", "adjustments", "expected",
        F.expr("amount - expected").alias("delta")
    )


def invert_fee(nets: DataFrame, card: DataFrame, methods: int = 5, grosses: int = 3) -> DataFrame:
    """Grosses that a net may come from: the first few of the first few methods by name."""
    found = invert_fees(nets, card)
    m = F.dense_rank().over(Window.partitionBy("net").orderBy("method"))
    g = F.row_number().over(Window.partitionBy("net", "method").orderBy("gross"))
    return found.withColumn("_m", m).withColumn("_g", g).where((F.col("_m") <= methods) & (F.col("_g") <= grosses)).select("net", "method", "gross")


def open_cases(exceptions: DataFrame, settlements: DataFrame) -> DataFrame:
    """Exceptions worth an investigation: they name candidates, and a payout is their subject."""
    named = exceptions.where(F.size("candidates") > 0).select("exception_id", "reason", "amount", "candidates", F.explode("subject_ids").alias("settlement_id"))
    return named.join(settlements.select("settlement_id"), "settlement_id", "left_semi")


def explain_gap(pairs: DataFrame, tolerance: int = 5) -> DataFrame:
    """Adds delta and what may explain it: rounding, a unit error, swapped digits."""
    out = pairs.withColumn("delta", F.expr("amount - payout"))
    side = F.when(F.col("delta") > 0, "larger").when(F.col("delta") < 0, "smaller").otherwise("identical")
    return out.withColumn("side", side).withColumn("within_tolerance", F.abs("delta") <= tolerance).withColumn("scale_error", M.is_scale_error(F.col("amount"), F.col("payout"))).withColumn(
        "transposition", M.is_transposition(F.col("amount"), F.col("payout"))
    )


def credits_near(settlements: DataFrame, credits: DataFrame, days: int, first: int = 12) -> DataFrame:
    """The first few credits within so many days, nearest day first, then by id: of a day only its first few can be among them."""
    span = max(0, min(10, days))
    s = settlements.select("settlement_id", "settled_on", F.date_sub("settled_on", span).alias("_lo"), F.date_add("settled_on", span).alias("_hi"))
    of_day = F.row_number().over(Window.partitionBy("value_date").orderBy("line_id"))
    c = credits.select("line_id", "amount", "value_date").withColumn("_n", of_day).where(F.col("_n") <= first).drop("_n")
    near = in_window(s, c, "_lo", "_hi", "value_date")
    rank = F.row_number().over(Window.partitionBy("settlement_id").orderBy(F.abs(F.datediff("value_date", "settled_on")), "line_id"))
    return near.withColumn("_r", rank).where(F.col("_r") <= first).select("settlement_id", "line_id", "amount", "value_date")


def check_contested(settlements: DataFrame, pairs: DataFrame) -> DataFrame:
    return contested(settlements, pairs)
