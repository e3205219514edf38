"""The world as Spark reads it, and joins by windows: what is sent, not only what comes out."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from ledgerloom.operators import adjudicate, joins
from ledgerloom.sources import world

SF = "/root/testdata/sf0.001"


def shuffles(df) -> int:
    return len(re.findall("Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_calendar_is_not_a_reason_to_send_payouts(spark):
    b = world.load(spark, SF)
    assert shuffles(b.bank) <= 16 and shuffles(b.settlements) <= 6


def test_only_named_tables_are_read(spark):
    assert "setl AS" not in world.needed("SELECT k FROM li") and "orders" in world.needed("SELECT * FROM bank")
    assert world.needed("SELECT 1") == "SELECT 1"
    assert list(world.tables_of("a AS (SELECT ')' AS x), b AS (SELECT (1))")) == ["a", "b"]


def test_a_window_is_sent_by_spans(spark):
    rng, day = random.Random(5), dt.date(1999, 12, 20)
    at = lambda i: day + dt.timedelta(days=i)
    left = [(i, at(lo := rng.randrange(60)), at(lo + rng.randrange(16)), rng.randrange(2)) for i in range(60)]
    right = [(i, at(rng.randrange(80)), rng.randrange(2)) for i in range(150)]
    s, c = spark.createDataFrame(left, "i int, lo date, hi date, k int"), spark.createDataFrame(right, "j int, day date, k int")
    got = joins.in_window(s, c, "lo", "hi", "day", "k")
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, lo, hi, k in left for j, d, m in right if lo <= d <= hi and k == m)
    assert "sequence(lo" not in got._jdf.queryExecution().analyzed().toString()


def test_near_amounts_by_brute_force(spark):
    rng = random.Random(6)
    left, right = [(i, rng.randrange(-400, 400)) for i in range(80)], [(i, rng.randrange(-400, 400)) for i in range(80)]
    got = joins.near_amount(spark.createDataFrame(left, "i int, a long"), spark.createDataFrame(right, "j int, b long"), "a", "b", 5)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, a in left for j, b in right if abs(a - b) <= 5)
    wide = joins.near_amount(spark.range(1000).select("id", (F.col("id") * 997).alias("a")), spark.createDataFrame(right, "j int, b long"), "a", "b", 5)
    assert wide.count() == sum(abs(i * 997 - b) <= 5 for i in range(1000) for _, b in right)


def test_a_busy_day_lends_its_first_credits_only(spark):
    day = dt.date(2026, 7, 15)
    lines = spark.range(500).select(F.format_string("b%05d", "id").alias("line_id"), F.col("id").alias("amount"), F.lit(day).alias("value_date"))
    more = spark.createDataFrame([("a9", 1, day + dt.timedelta(days=1))], lines.schema)
    s = spark.createDataFrame([("s1", day), ("s2", day + dt.timedelta(days=1))], "settlement_id string, settled_on date")
    out = adjudicate.credits_near(s, lines.union(more), 2)
    got = sorted((r.settlement_id, r.line_id) for r in out.collect())
    firsts = [f"b{i:05d}" for i in range(12)]
    assert got == sorted([("s1", x) for x in firsts] + [("s2", x) for x in ["a9", *firsts[:11]]])
    assert "_n" in out._jdf.queryExecution().analyzed().toString()


def test_a_text_is_read_once(spark):
    from ledgerloom.plans import coverage

    plan = coverage.ingest_payments(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.split("\n") if "Filter" in x]
    assert not any("INR" in x or "yyyy-MM-dd" in x for x in filters)


def test_plain_amounts_say_what_the_general_rule_says(spark):
    from ledgerloom.functions import money

    texts = ["0.00", "7.05", "123456789012345.67", "1234567890123456.78", "007.10", "12.345", "1.2", "1234", "12.30\n", " 5.00", "-5.00", "5.00-", "1,234.50"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = {r.t: (r.plain, r.general) for r in df.select("t", money.parse_money(F.col("t")).alias("plain"), money.parse_money(F.concat(F.lit("INR"), "t")).alias("general")).collect()}
    assert got.pop("-5.00")[0] == -500  # a sign behind the mark isn't one before
    assert all(a == b for a, b in got.values()) and got["7.05"][0] == 705 and got["12.30\n"][0] == 1230
