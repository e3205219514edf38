"""References in bank narrations: tokens, shapes, and how well one fits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words before a reference, words that are never one, and the shapes of references with their scores.
RAIL_WORDS = ["NEFT", "RTGS", "IMPS", "UPI", "ACH", "MMT", "P2A", "P2M", "TRF", "TRANSFER", "PAYOUT", "SETTLEMENT", "CMS", "INF", "INB"]
STOPWORDS = [
    "SOFTWARE", "PRIVATE", "LIMITED", "LTD", "PVT", "INDIA", "BANK", "BY", "TO", "FROM", "FOR", "THE", "AND", "CR", "DR", "SETTLEMENT",
    "PAYMENT", "PAYOUT", "TRANSFER", "CREDIT", "DEBIT", "MERCHANT", "COLLECTION", "ACCOUNT", "REF", "REFNO", "TXN",
]
SHAPES = [
    ("^[A-Z]{4}[A-Z0-9]{12}$", "neft_utr", 0.95),
    ("^[A-Z]{4}[A-Z0-9]{18}$", "rtgs_utr", 0.95),
    ("^[0-9]{12}$", "imps_rrn", 0.90),
    ("^[A-Z]{2,6}[0-9]{8,16}$", "prefixed_ref", 0.75),
    ("^[A-Z0-9]{14,24}$", "long_alnum", 0.60),
    ("^[0-9]{9,18}$", "numeric_ref", 0.55),
    ("^[A-Z0-9]{10,13}$", "short_alnum", 0.40),
]
ACCEPTED, NEAR_LENGTH, EDITS = 0.60, 10, 2


def normalize_ref(value: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z0-9]", "")


def tokens(narration: Column) -> Column:
    return F.filter(F.split(F.upper(F.coalesce(narration, F.lit(""))), "[^A-Z0-9]+"), lambda x: x != "")


def shape_of(token: Column, value: str = "name") -> Column:
    first, *rest = [(token.rlike(p), F.lit(name if value == "name" else score)) for p, name, score in SHAPES]
    out = F.when(*first)
    for condition, x in rest:
        out = out.when(condition, x)
    return out


def candidates(narration: Column) -> Column:
    """array<struct(token, shape, score, position, after_rail)>: reference-like tokens, the likeliest first.

    A digit and a shape are needed; a rail word before it speaks for a token, and a late place against it.
    """
    words = tokens(narration)

    def one(token, position):
        after_rail = F.coalesce(F.get(words, position - 1).isin(RAIL_WORDS), F.lit(False))
        shape = F.when(token.rlike("[0-9]") & ~token.isin(STOPWORDS), shape_of(token))
        score = shape_of(token, "score") + F.when(after_rail, 0.10).otherwise(0.0) - F.least(position, F.lit(8)) * 0.015
        score = F.round(F.least(score, F.lit(1.0)), 4)
        return F.struct(
            (-score).alias("order"), token.alias("token"), shape.alias("shape"), score.alias("score"), position.alias("position"),
            after_rail.alias("after_rail")
        )

    found = F.array_sort(F.filter(F.transform(words, one), lambda c: c["shape"].isNotNull()))
    return F.transform(
        found,
        lambda c: F.struct(
            c["token"].alias("token"), c["shape"].alias("shape"), c["score"].alias("score"), c["position"].alias("position"),
            c["after_rail"].alias("after_rail")
        )
    )


def candidate_tokens(narration: Column) -> Column:
    """array<string>: the tokens that candidates() has, in order of the text; nothing is scored."""
    shaped = "|".join(f"(?:{p})" for p, _, _ in SHAPES)
    return F.filter(tokens(narration), lambda t: t.rlike("[0-9]") & t.rlike(shaped) & ~t.isin(STOPWORDS))


def mentions_any(narration: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(F.upper(narration), F.upper(w)))


def osa_distance(a: str, b: str, bound: int) -> int:
    """Edits, a swap of neighbours being one, no part edited twice; bound + 1 if there are more than bound."""
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows = [rows[-1], row]
        if min(row) > bound:
            return bound + 1
    return min(rows[-1][-1], bound + 1)


@F.pandas_udf(T.IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    """osa_distance up to EDITS; Spark's levenshtein counts a swap as two.  Only for pairs that shorter tests left."""
    return pd.Series([osa_distance(x, y, EDITS) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def osa_each(tokens: pd.Series, target: pd.Series) -> pd.Series:
    """osa_distance of every token of a row; rows have none unless shorter tests left some."""
    return pd.Series([[osa_distance(x, t, EDITS) for x in xs] for xs, t in zip(tokens, target, strict=True)])


def score_matches(pairs: DataFrame, utr: str = "utr", narration: str = "narration") -> DataFrame:
    """Adds score, mechanism and matched_token of each row's reference in its narration, without a shuffle.

    The reference as part of the narration is exact; else the best of its candidate tokens counts: a clipped beginning
    of eight characters or more, or one or two edits.  A swap counts two in levenshtein, so only tokens near in length
    and within twice EDITS of it reach the edit distance.
    """
    out = pairs.withColumn("_t", normalize_ref(F.col(utr)))
    out = out.withColumn("_exact", (F.col("_t") != "") & F.contains(normalize_ref(F.col(narration)), F.col("_t")))
    none = F.array().cast("array<struct<k:int,w:string>>")
    numbered = F.transform(candidates(F.col(narration)), lambda c, i: F.struct(i.cast("int").alias("k"), normalize_ref(c["token"]).alias("w")))
    out = out.withColumn("_c", F.when(F.col("_exact") | (F.col("_t") == ""), none).otherwise(numbered))
    clipped = lambda c: (F.length(c["w"]) >= 8) & F.col("_t").startswith(c["w"])
    long = lambda c: (F.length(c["w"]) >= NEAR_LENGTH) & (F.abs(F.length("_t") - F.length(c["w"])) <= EDITS)
    close = lambda c: F.levenshtein(c["w"], F.col("_t"), 2 * EDITS) >= 0
    out = out.withColumn("_near", F.filter("_c", lambda c: ~clipped(c) & long(c) & close(c)))
    out = out.withColumn("_d", osa_each(F.transform("_near", lambda c: c["w"]), F.col("_t")))
    hit = lambda c, score, how: F.struct(F.round(score, 4).alias("s"), (-c["k"]).alias("nk"), how.alias("m"), c["w"].alias("w"))
    by_clip = F.transform(F.filter("_c", clipped), lambda c: hit(c, F.lit(0.70) + 0.02 * F.least(F.length(c["w"]) - 8, F.lit(8)), F.lit("truncated_prefix")))
    measured = F.filter(
        F.zip_with("_near", "_d", lambda c, d: F.struct(c["k"].alias("k"), c["w"].alias("w"), d.alias("d"))), lambda x: x["d"].between(1, EDITS)
    )
    by_edit = F.transform(measured, lambda x: hit(x, F.when(x["d"] == 1, 0.85).otherwise(0.65), F.concat(F.lit("edit_distance_"), x["d"].cast("string"))))
    out = out.withColumn("_b", F.array_max(F.concat(by_clip, by_edit)))
    pick = lambda exact, empty, part, none: F.when(F.col("_exact"), exact).when(F.col("_t") == "", empty).otherwise(F.coalesce(part, none))
    out = out.withColumn("score", pick(F.lit(1.0), F.lit(0.0), F.col("_b.s"), F.lit(0.0)))
    out = out.withColumn("mechanism", pick(F.lit("exact_substring"), F.lit("no_reference"), F.col("_b.m"), F.lit("no_match")))
    out = out.withColumn("matched_token", pick(F.col("_t"), F.lit(""), F.col("_b.w"), F.lit("")))
    return out.drop("_t", "_exact", "_c", "_near", "_d", "_b")
