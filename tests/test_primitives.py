"""Column builders against tables of literals, and kernels against brute force."""

import datetime as dt
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, fees, money, narration
from ledgerloom.operators import subsets


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.i)]


def test_parse_money(spark):
    good = {
        "12,34,567.89": 123456789, "1.234,56": 123456, "1,234.56": 123456, "1234.56": 123456, "(1,234.50)": -123450, "500 DR": -50000, "500 CR": 50000, "₹1,234.50": 123450,
        "Rs. 1234.50": 123450, "INR 1234.50": 123450, "1234.50 INR": 123450, "1234,5": 123450, "0.025": 2500, "-5": -500, "5-": -500, "+5.10": 510, "1 234.50": 123450, "-(5)": None, "0.10": 10,
    }
    bad = ["", "-", "N/A", "NULL", "#REF!", "abc", None, "1,2E+05", "--", "12,34,5", "  "]
    good.pop("-(5)")
    assert column(spark, list(good), "string", money.parse_money) == list(good.values())
    assert column(spark, bad, "string", money.parse_money) == [None] * len(bad)


def test_money_formats(spark):
    assert column(
        spark, [123456789, -5, 100, 99999900, 1000000000], "long", lambda p: money.format_inr(p, "")
    ) == ["12,34,567.89", "-0.05", "1.00", "9,99,999.00", "1,00,00,000.00"]
    assert column(spark, [25, -25], "long", lambda p: money.rupees_to_paise(p.cast("decimal(10,3)") / 1000)) == [3, -3]
    pairs = spark.createDataFrame([(123456, 1234), (123456, 123400), (123400, 124300), (123400, 123500), (0, 0)], "a long, b long")
    assert [
        tuple(r) for r in pairs.select(money.is_scale_error(F.col("a"), F.col("b")), money.is_transposition(F.col("a"), F.col("b"))).collect()
    ] == [(True, False), (False, False), (False, True), (False, False), (False, False)]


def test_parse_datetime(spark):
    day = dt.date(2026, 7, 15)
    same = [
        "2026-07-15", "15/07/2026", "15-07-2026", "15-Jul-2026", "15 Jul 2026", "15-Jul-26", "Jul 15, 2026", "07/15/2026", "2026-07-15T10:00:00",
        "2026-07-15 10:00:00", "2026-07-15T10:00:00+05:30", "2026-07-15T18:29:00Z"
    ]
    assert column(spark, same, "string", lambda v: dates.business_date(dates.parse_datetime(v))) == [day] * len(same)
    assert column(
        spark, ["2026-07-15T18:30:00Z", "2026-07-15T23:45:00Z", "5/7/2026"], "string", lambda v: dates.business_date(dates.parse_datetime(v))
    ) == [dt.date(2026, 7, 16), dt.date(2026, 7, 16), dt.date(2026, 7, 5)]
    assert column(spark, ["12345", "soon", "", None], "string", dates.parse_datetime) == [None] * 4
    assert column(spark, ["1784140200"], "string", lambda v: dates.business_date(dates.parse_datetime(v))) == [dt.date(2026, 7, 16)]


def test_banking_days(spark):
    cal = dates.calendar(spark, "2026-01-01", "2026-12-31")
    d = dt.date
    df = spark.createDataFrame(
        [
            (d(2026, 7, 10), 2, d(2026, 7, 14)), (d(2026, 11, 5), 2, d(2026, 11, 9)), (d(2026, 7, 11), 0, d(2026, 7, 13)),
            (d(2026, 7, 10), 0, d(2026, 7, 10))
        ],
        "a date, n int, due date"
    )
    assert all(r.due == r.got for r in dates.add_banking_days(df, "a", F.col("n"), "got", cal).collect())
    both = spark.createDataFrame([(d(2026, 7, 10), d(2026, 7, 14), 2), (d(2026, 7, 14), d(2026, 7, 10), -2)], "a date, b date, n long")
    assert all(r.n == r.got for r in dates.banking_days_between(both, "a", "b", "got", cal).collect())
    assert dates.next_banking_day(df, "a", "got", cal).count() == 4
    assert column(spark, [d(2026, 7, 10)], "date", lambda v: F.size(dates.date_range(v, F.date_add(v, 3)))) == [4]


def test_fees(spark):
    card = fees.rate_card(spark)
    df = spark.createDataFrame(
        [
            (100000, "credit_card", 2000, 360), (150000, "debit_card", 600, 108), (500000, "debit_card", 4500, 810), (99, "upi", 0, 0),
            (100000, "barter", 2000, 360)
        ],
        "gross long, method string, fee long, tax long"
    )
    assert all(r.fee == r.expected_fee and r.tax == r.expected_tax for r in fees.with_fees(df, card).collect())
    charged = df.withColumn("fee", F.col("fee") + F.when(F.col("method") == "credit_card", 500).otherwise(1))
    rows = {r.method: (r.fee_ok, r.delta, r.explanation) for r in fees.verify_fees(charged, card).collect()}
    assert rows["credit_card"] == (False, 500, "overcharged") and rows["upi"] == (True, 1, "ok")


def test_fee_inversion_finds_the_gross(spark):
    card = fees.rate_card(spark)
    grosses = spark.createDataFrame(
        [(g, m) for g in range(7919, 400_000, 7919) for m in ("upi", "credit_card", "netbanking", "debit_card", "amex")], "gross long, method string"
    )
    nets = fees.with_fees(grosses, card).select(F.col("gross").alias("true_gross"), F.col("method").alias("true_method"), F.col("expected_net").alias("net"))
    found = fees.invert_fees(nets, card)
    assert found.where("gross = true_gross and method = true_method").count() == grosses.count()
    assert fees.with_fees(found, card).where("expected_net <> net").count() == 0


def test_reference_scores(spark):
    utr = "HDFCN12345678901"
    cases = [
        (utr, f"NEFT-{utr}-ACME", 1.0, "exact_substring"), (
            utr, "MMT/IMPS/HDFCN 12345678901/x", 1.0, "exact_substring"
        ), (utr, "NEFT-HDFCN1234567", 0.78, "truncated_prefix"),
        (
            utr, "NEFT-HDFCN12354678901-ACME", 0.85, "edit_distance_1"
        ), (utr, "NEFT-HDFCN99345678901", 0.65, "edit_distance_2"), (utr, "CASH DEPOSIT", 0.0, "no_match"), (None, "NEFT", 0.0, "no_reference"),
    ]
    df = spark.createDataFrame([(i, u, n) for i, (u, n, *_) in enumerate(cases)], "pair_id int, utr string, narration string")
    rows = {r.pair_id: r for r in narration.score_matches(df).collect()}
    assert [(rows[i].score, rows[i].mechanism) for i in range(len(cases))] == [c[2:] for c in cases]


def test_tokens(spark):
    got = column(
        spark, ["BANK TRANSFER TO MERCHANT", "NEFT HDFCN12345678901 BAL 123456789", None], "string",
        lambda v: F.transform(narration.candidates(v), lambda c: F.concat_ws(":", c["token"], c["shape"], c["score"].cast("string")))
    )
    assert got == [[], ["HDFCN12345678901:neft_utr:1.0", "123456789:numeric_ref:0.505"], []]
    assert column(spark, ["AXIS-P001 234", None], "string", narration.normalize_ref) == ["AXISP001234", ""]


def test_osa_distance():
    assert narration.osa_distance("ABCD", "ABDC", 2) == 1 and narration.osa_distance("AAAAAAA", "ZZZZZZZ", 2) == 3 and narration.osa_distance("CA", "ABC", 3) == 3


def test_subset_sums():
    pool = {"a": 10000, "b": 10000, "c": 5000, "d": 15000}
    found = subsets.find_subsets(pool, 15000)
    assert len(found.solutions) >= 3 and not found.unique and subsets.find_subsets(pool, 0).solutions == []
    rng = random.Random(11)
    for n in (8, 12):
        items = {f"r{i}": rng.randrange(100, 100_000) for i in range(n)}
        chosen = rng.sample(sorted(items), 3)
        target = sum(items[c] for c in chosen)
        want = {tuple(sorted(c)) for k in range(1, 5) for c in combinations(items, k) if abs(sum(items[x] for x in c) - target) <= 5}
        for cut in (34, 4):  # both searches
            subsets.SPLIT_ABOVE, keep = cut, subsets.SPLIT_ABOVE
            got = {refs for _, refs in subsets.find_subsets(items, target, 5, 4, cap=1000).solutions}
            subsets.SPLIT_ABOVE = keep
            assert tuple(sorted(chosen)) in got and got <= want and (cut == 4 or got == want)


def test_cardinality_and_credibility(spark):
    assert [subsets.credible_cardinality(n) for n in (10, 25, 64, 250)] == [6, 3, 2, 1]
    got = spark.range(1, 301).select(F.col("id"), subsets.cardinality_column(F.col("id")).alias("k")).collect()
    assert all(r.k == subsets.credible_cardinality(r.id) for r in got)
    wide = {f"p{i}": (i + 1) * 7_000_000 for i in range(8)}
    assert subsets.is_credible(wide, wide["p0"] + wide["p3"], 5, 6)
    near = {f"p{i}": 100_000 + i for i in range(40)}
    assert not subsets.is_credible(near, 200_050, 5, 2)
    assert subsets.closest_subset({"a": 700, "b": 250}, 1000) == (-50, ("a", "b"))


@pytest.mark.parametrize("n", [60, 120])
def test_large_pools_end(n):
    rng = random.Random(n)
    pool = {f"p{i}": rng.randrange(10_000, 10_000_000) for i in range(n)}
    assert subsets.find_subsets(pool, sum(list(pool.values())[:2]), 5, 2).solutions
