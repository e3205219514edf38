"""Joins that the passes share: date windows, near amounts, nearest amounts, reference candidates.

Each is an equi-join on keys that both sides can list, so none compares all payouts of a window with all its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import narration as N
from ..functions.dates import add_banking_days
from . import edits
from .records import Config, settle

#: Letters of a reference that a narration's pieces are joined on.
HEAD = 8
#: Days that a window join has in one key.
SPAN = 8
#: Paise of a bucket in which amounts of a day are ranked by one task.
BUCKET = 100_000


def with_windows(settlements: DataFrame, cal: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds win_lo..win_hi (slack_days before to sla_banking_days after) and wide_lo..wide_hi (a day more before, to the
    last banking day that isn't late)."""
    out = add_banking_days(settlements, "settled_on", config.sla_banking_days, "win_hi", cal)
    out = add_banking_days(out, "settled_on", config.late_banking_days, "wide_hi", cal)
    return out.withColumn("win_lo", F.date_sub("settled_on", config.slack_days)).withColumn("wide_lo", F.date_sub("settled_on", config.slack_days + 1))


def in_window(left: DataFrame, right: DataFrame, lo: str, hi: str, day: str, *keys: str) -> DataFrame:
    """left x right where day lies in lo..hi, both included, and further keys are equal: an equi-join on spans of SPAN days,
    of which a window meets two or three, so a left row is sent that often and not once a day."""
    span = lambda c: F.floor(F.unix_date(c) / SPAN)
    far = left.withColumn("_span", F.explode(F.sequence(span(F.col(lo)), span(F.col(hi)))))
    near = right.withColumn("_span", span(F.col(day)))
    return far.join(near, ["_span", *keys]).drop("_span").where(F.col(day).between(F.col(lo), F.col(hi)))


def near_amount(left: DataFrame, right: DataFrame, a: str, b: str, tolerance: int, days: tuple[str, str, str] | None = None) -> DataFrame:
    """left x right where the amounts differ by the tolerance at most: an equi-join on buckets of amounts, so wide that few
    left rows reach into a second one.

    days (lo, hi, day) keeps rights whose day lies in the left's lo..hi, and puts the day into the key: a price that many
    have meets itself within a window only.
    """
    bucket = lambda x: F.floor(x / (20 * tolerance + 1))
    near = left.withColumn("_near", F.explode(F.sequence(bucket(F.col(a) - tolerance), bucket(F.col(a) + tolerance))))
    rest = right.withColumn("_near", bucket(F.col(b)))
    joined = near.join(rest, "_near") if days is None else in_window(near, rest, *days, "_near")
    return joined.drop("_near").where(F.abs(F.col(a) - F.col(b)) <= tolerance)


def nearest_amounts(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """For each left row and day of its window, the k right rows of that day on either side of its amount.

    left: settlement_id, payout, win_lo, win_hi; right: line_id, amount, value_date.  The k rows nearest in amount (ties
    by line_id) of the whole window are among them.  Rows of a day are ranked by amount, bucket by bucket, and a left
    row takes the ranks next to its own place, so it meets 2 k lines a day however many the day has.
    """
    days = left.select("settlement_id", "payout", F.explode(F.sequence("win_lo", "win_hi")).alias("day"))
    lines = right.select("line_id", "amount", F.col("value_date").alias("day"))
    out = None
    for up in (True, False):
        # lines of the payout's own amount count as above it
        amount = lambda c: F.col(c) if up else -F.col(c)  # noqa: B023, E731
        both = lines.select(
            "line_id", F.lit(None).cast("string").alias("settlement_id"), amount("amount").alias("x"), "day", F.lit(1).alias("is_line"),
            F.lit(1 if up else 0).alias("side")
        )
        both = both.unionByName(
            days.select(
                F.lit(None).cast("string").alias("line_id"), "settlement_id", amount("payout").alias("x"), "day", F.lit(0).alias("is_line"),
                F.lit(0 if up else 1).alias("side")
            )
        )
        both = both.withColumn("bucket", F.floor(F.col("x") / BUCKET))
        sizes = both.groupBy("day", "bucket").agg(F.sum("is_line").alias("n"))
        before = Window.partitionBy("day").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
        bases = sizes.select("day", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        own = Window.partitionBy("day", "bucket").orderBy("x", "side", "line_id").rowsBetween(Window.unboundedPreceding, 0)
        ranked = both.withColumn("rank", F.sum("is_line").over(own)).join(bases, ["day", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
        wanted = ranked.where("is_line = 0").select("settlement_id", "day", F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + k)).alias("rank"))
        found = wanted.join(ranked.where("is_line = 1").select("day", "rank", "line_id"), ["day", "rank"]).select("settlement_id", "line_id")
        out = found if out is None else out.union(found)
    return out


def contested(settlements: DataFrame, lines: DataFrame, days: int = 3, tolerance: int = 5, first: int = 6) -> DataFrame:
    """For each line, other payouts near it in date and amount: settlement_id given, rival_id, gap; first few by gap."""
    own = settlements.select("settlement_id", F.col("settled_on").alias("_own_day"))
    rival = settlements.select(F.col("settlement_id").alias("rival_id"), F.col("amount").alias("rival_amount"), F.col("settled_on").alias("rival_on"))
    asked = lines.join(own, "settlement_id").withColumns({"_lo": F.date_sub("_own_day", days), "_hi": F.date_add("_own_day", days)})
    near = near_amount(asked, rival, "amount", "rival_amount", tolerance, ("_lo", "_hi", "rival_on"))
    near = near.where(F.col("rival_id") != F.col("settlement_id"))
    gap = F.abs(F.col("rival_amount") - F.col("amount"))
    rank = F.row_number().over(Window.partitionBy("settlement_id", "line_id").orderBy(gap, "rival_id"))
    return near.withColumn("gap", gap).withColumn("_r", rank).where(F.col("_r") <= first).select("settlement_id", "line_id", "rival_id", "gap")


def line_facts(bank: DataFrame) -> DataFrame:
    return bank.withColumn("flat", N.normalize_ref(F.col("narration"))).withColumn(
        "tokens", N.candidate_tokens(F.col("narration"))
    )


def references(settlements: DataFrame, *more: str) -> DataFrame:
    return settlements.where("utr is not null").select("settlement_id", N.normalize_ref(F.col("utr")).alias("_t"), *more).where("_t <> ''")


def line_tokens(facts: DataFrame) -> DataFrame:
    return facts.select("line_id", F.explode("tokens").alias("token"))


def fewer_letters(text: Column) -> Column:
    """The text and what is left of it without one or two of its letters, each once."""
    less = lambda x: F.transform(
        F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))),
    )
    one = less(text)
    return F.array_distinct(F.concat(F.array(text), one, F.flatten(F.transform(one, less))))


def by_token(refs: DataFrame, facts: DataFrame) -> DataFrame:
    """A line's token is the reference, its beginning of HEAD letters or more, or has its head and is within EDITS edits.

    Beginnings are joined as keys of their own.  Two texts within two edits (a swap is one) are the same text when each
    has lost two letters at most, so behind a common head the rests are joined on what such losses leave, and what meets
    is measured: references that merely share a head, as most of a bank do, meet nowhere.
    """
    tok = line_tokens(facts)
    n = F.length("_t")
    begun = F.when(n >= HEAD, F.transform(F.sequence(F.lit(HEAD), n), lambda k: F.left("_t", k))).otherwise(F.array("_t"))
    whole = refs.select("settlement_id", F.explode(begun).alias("token")).join(tok, "token").select("settlement_id", "line_id")
    mine, others = refs.where(n >= N.NEAR_LENGTH - N.EDITS).select("settlement_id", "_t"), tok.where(F.length("token") >= N.NEAR_LENGTH)
    head = lambda df, text: df.withColumn("_head", F.left(text, F.lit(HEAD)))
    count = lambda df, text: head(df, text).groupBy("_head").agg(F.count(F.lit(1)).alias("_n"))
    hot = count(mine, "_t").unionByName(count(others, "token")).groupBy("_head").agg(F.sum("_n").alias("_n")).where(F.col("_n") > edits.HOT)
    hot = settle(hot.select("_head"))
    if hot.isEmpty():
        return whole.union(edits.near_tokens(mine, others, HEAD))
    kept = lambda df, text, how: head(df, text).join(hot, "_head", how)
    near = edits.near_tokens(kept(mine, "_t", "left_anti"), kept(others, "token", "left_anti"), HEAD)
    return whole.union(near).union(by_losses(kept(mine, "_t", "left_semi"), kept(others, "token", "left_semi")))


def by_losses(refs: DataFrame, tok: DataFrame) -> DataFrame:
    """The same for heads that too many texts have for one task: what letters' losses leave is the key of a join."""
    split = lambda df, text: df.withColumn("_k", F.explode(fewer_letters(F.substring(F.col(text), F.lit(HEAD + 1), F.length(text)))))
    near = split(refs, "_t").join(split(tok, "token"), ["_head", "_k"])
    near = near.where((F.abs(F.length("token") - F.length("_t")) <= N.EDITS) & (F.col("token") != F.col("_t"))).select("settlement_id", "line_id", "_t", "token")
    near = near.distinct().where(F.levenshtein("token", "_t", 2 * N.EDITS) >= 0).where(N.osa("token", "_t") <= N.EDITS)
    return near.select("settlement_id", "line_id")


def headed(refs: DataFrame, facts: DataFrame) -> DataFrame:
    """(settlement_id): references whose head some token has; such a payout isn't looked for by edits."""
    heads = line_tokens(facts).where(F.length("token") >= HEAD).select(F.left("token", F.lit(HEAD)).alias("_head")).distinct()
    return refs.where(F.length("_t") >= HEAD).withColumn("_head", F.left("_t", F.lit(HEAD))).join(heads, "_head", "left_semi").select("settlement_id")


def by_text(refs: DataFrame, facts: DataFrame, lo: str, hi: str) -> DataFrame:
    """The reference is part of a narration of the window: pieces of the narration as long as the reference's beginning (the
    whole of a shorter one) are joined to it, and what meets is compared.  A piece that no reference begins with isn't sent."""
    level = F.array_max(F.filter(F.array(*map(F.lit, edits.LEVELS)), lambda n: n <= F.length("_t")))
    heads = refs.withColumn("_n", level).withColumn("_k", F.left("_t", F.col("_n")))
    known, out = edits.piece_filter(heads), None
    for n in sorted(r["_n"] for r in heads.select("_n").distinct().collect()):  # as many as LEVELS at most
        found = in_window(heads.where(F.col("_n") == n), edits.pieces(facts, n, known), lo, hi, "value_date", "_k")
        found = found.where(F.contains("flat", "_t")).select("settlement_id", "line_id")
        out = found if out is None else out.union(found)
    return out if out is not None else refs.select("settlement_id", F.lit("").alias("line_id")).limit(0)


def by_edits(refs: DataFrame, facts: DataFrame, lo: str, hi: str) -> DataFrame:
    """A long token of the window within EDITS edits of the reference, or equal to it."""
    tok = facts.select("line_id", "value_date", F.explode("tokens").alias("token")).where(F.length("token") >= N.NEAR_LENGTH)
    long = refs.where(F.length("_t") >= N.NEAR_LENGTH - N.EDITS)
    same = in_window(long.withColumn("token", F.col("_t")), tok, lo, hi, "value_date", "token").select("settlement_id", "line_id")
    return same.union(edits.near_in_window(long, tok, lo, hi, "value_date", SPAN))


def reference_candidates(settlements: DataFrame, bank: DataFrame, claimed_lines: DataFrame | None = None) -> DataFrame:
    """(settlement_id, line_id) that may score, from cheap tests to dear ones.

    By token: anywhere in time, and any line counts, even a debit or a taken one.  By text: open credits of the wide
    window.  Only a payout with neither, and whose head no token has, is compared by edits.
    """
    refs, facts = settle(references(settlements, "wide_lo", "wide_hi")), settle(line_facts(bank).select("line_id", "value_date", "amount", "flat", "tokens"))
    credits = facts.where("amount > 0")
    if claimed_lines is not None:
        credits = credits.join(claimed_lines, "line_id", "left_anti")
    cheap = settle(by_token(refs, facts).union(by_text(refs, credits, "wide_lo", "wide_hi")).distinct())
    rest = settle(refs.join(cheap.select("settlement_id").union(headed(refs, facts)).distinct(), "settlement_id", "left_anti"))
    return cheap if rest.isEmpty() else cheap.union(by_edits(rest, credits, "wide_lo", "wide_hi").distinct())


def window_candidates(settlements: DataFrame, credits: DataFrame, k: int) -> DataFrame:
    """(settlement_id, line_id): the credits of each payout's window whose reference may score, and those nearest in
    amount.  The k best by score, then amount, then id are among them.  settlements: with utr, payout and its window."""
    refs, facts = settle(references(settlements, "win_lo", "win_hi")), settle(line_facts(credits).select("line_id", "value_date", "flat", "tokens"))
    token = by_token(refs, facts).join(
        settlements.select("settlement_id", "win_lo", "win_hi"), "settlement_id"
    ).join(credits.select("line_id", "value_date"), "line_id")
    token = token.where(F.col("value_date").between(F.col("win_lo"), F.col("win_hi"))).select("settlement_id", "line_id")
    scored = token.union(by_text(refs, facts, "win_lo", "win_hi")).union(by_edits(refs, facts, "win_lo", "win_hi"))
    return scored.union(nearest_amounts(settlements, credits, k)).distinct()
