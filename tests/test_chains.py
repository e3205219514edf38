"""Conflicts in order of id: chains, components, runs of days and relisting against sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.dates import calendar
from ledgerloom.operators import adjudicate, chains, joins, matching
from ledgerloom.operators.records import Config
from ledgerloom.operators.subsets import credible_cardinality, find_subsets, is_credible

from .test_passes import LINE, SETTLEMENT, days, reckless


@pytest.fixture(scope="module")
def cal(spark):
    return calendar(spark, "2026-06-01", "2026-12-31").cache()


def least(p):
    return p.groupBy("settlement_id").agg(F.min("line_id").alias("line_id"))


def test_a_chain_of_ten_thousand_takes_few_jobs(spark):
    pairs = spark.range(10_000).select(F.format_string("s%05d", "id").alias("settlement_id"), F.explode(F.array(F.col("id") - 1, "id")).alias("j"))
    pairs = pairs.where("j >= 0").select("settlement_id", F.format_string("b%05d", "j").alias("line_id"))
    spark.sparkContext.setJobGroup("chain", "chain")
    got = chains.ordered(pairs, least, lambda own: "first").select(F.substring("settlement_id", 2, 9).alias("s"), F.substring("line_id", 2, 9).alias("b"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.count() == got.where("s = b").count() == 10_000 and jobs < 60  # stages of exchanges count as jobs here


def test_components_are_followed_like_a_sequence(spark):
    rng = random.Random(8)
    rows = sorted({(f"s{(i := rng.randrange(90)):03d}", f"b{i // 2 + rng.randrange(3):03d}", rng.randrange(3)) for _ in range(190)} | {(f"t{i:03d}", f"c{j:03d}", 1) for i in range(24) for j in (i, i + 1)})
    gone, want = set(), {}
    for i in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == i and r[1] not in gone]
        if own:
            takes = len(own) == 1 or all(r[2] == own[0][2] for r in own)
            want[i] = sorted(r[1] for r in own) if takes else None
            gone |= {r[1] for r in own} if takes else set()

    def decide(p):
        n = p.groupBy("settlement_id").agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"))
        return p.join(n, "settlement_id").select("settlement_id", F.when(F.col("lo") == F.col("hi"), F.col("line_id")).alias("line_id"))

    df = spark.createDataFrame(rows, "settlement_id string, line_id string, amount int")
    own = chains.components(df, "settlement_id", "line_id").collect()
    label = {r.settlement_id: r.component for r in own}
    lines = {}
    for i, b, _ in rows:
        lines.setdefault(b, set()).add(label[i])
    assert all(len(x) == 1 for x in lines.values()) and len(label) == len({r[0] for r in rows}) and len(set(label.values())) > 5 and all(c <= i for i, c in label.items())
    for rounds, task_pairs in ((1, 100_000), (1, 100), (0, 20)):  # one task; components; components, larger ones in rounds
        got = {}
        for r in chains.ordered(df, decide, lambda own: "all" if len(own) == 1 or own["amount"].nunique() == 1 else "none", rounds=rounds, task_pairs=task_pairs).collect():
            got.setdefault(r.settlement_id, []).append(r.line_id)
        assert {i: sorted(x) if x[0] is not None else None for i, x in got.items()} == want


def sums_in_order(s, b, config):
    open_s, want = {r[0]: r for r in s}, {}
    for i, amount, d, _ in sorted(b):
        near = {k: r for k, r in open_s.items() if (d - r[3]).days in (0, 1)}
        bare = {k: r for k, r in near.items() if r[1] is None}
        pool = {k: r[2] for k, r in (bare if len(bare) >= 2 else near).items()}
        if len(pool) < 2:
            continue
        most = credible_cardinality(len(pool), config.max_cardinality, config.combination_budget)
        verdict, chosen = "open", ()
        if most >= 2:
            found = find_subsets(pool, amount, config.batch_tolerance, most)
            if found.solutions and not is_credible(pool, amount, config.batch_tolerance, most):
                verdict = "chance"
            elif found.unique or (len(found.exact) == 1 and not found.truncated):
                best = found.solutions[0][1] if found.unique else found.exact[0]
                verdict, chosen = ("match", best) if len(best) >= 2 else ("open", ())
            elif len(found.solutions) > 1:
                verdict = "ambiguous"
        want[i] = (verdict, tuple(sorted(chosen)), sum(pool[k] for k in chosen), len(pool), most)
        for k in chosen:
            del open_s[k]
    return want


def test_sums_by_runs_of_days(spark):
    """Pools above and below the budget side by side, a hot day, gaps in the calendar; runs in a task and in rounds."""
    rng, config = random.Random(12), Config(combination_budget=30)  # pools of eight payouts may be summed, fifty matter
    s = [(f"s{i:03d}", None if rng.random() < 0.6 else "x", rng.randrange(10_000, 90_000_000), days(rng.choice([0, 1, 2, 3, 6, 7, 8, 20, 21]))) for i in range(60)]
    s += [(f"t{i:03d}", None if i % 2 else "x", rng.randrange(10_000, 90_000_000), days(22)) for i in range(120)] + [(f"u{i:03d}", "x", 7_000_000 + i, days(41)) for i in range(70)]
    b = []
    for i in range(90):
        d = rng.choice([0, 1, 2, 3, 4, 6, 7, 8, 9, 20, 21, 22, 22, 23, 40, 41])
        near = [r for r in s if (days(d) - r[3]).days in (0, 1)]
        bare = [r for r in near if r[1] is None]
        near = bare if len(bare) >= 2 and rng.random() < 0.9 else near
        b.append((f"b{i:03d}", sum(r[2] for r in rng.sample(near, min(2, len(near)))) if near and rng.random() < 0.6 else rng.randrange(10_000, 90_000_000), days(d), ""))
    want = sums_in_order(s, b, config)
    assert {v[0] for v in want.values()} >= {"open", "match"} and {v[4] for v in want.values()} >= {0, 1, 2} and sum(v[0] == "match" for v in want.values()) > 4
    sd, bd = spark.createDataFrame(s, SETTLEMENT), spark.createDataFrame(b, LINE)
    for run_credits in (5000, 12):
        got = {r.line_id: (r.verdict, tuple(sorted(r.settlements)), r.total, r.pool_size, r.most) for r in matching.decompose(sd, bd, config, run_credits).collect()}
        assert got == want
    assert matching.decompose(sd.limit(0), bd, config).count() == matching.decompose(sd, bd.limit(0), config).count() == 0


def test_jobs_of_sums_dont_grow_with_the_calendar(spark):
    jobs = []
    for n in (5, 150):
        rng = random.Random(n)
        s = [(f"s{i:05d}", None, rng.randrange(10_000, 90_000_000), days(i // 3)) for i in range(3 * n)]
        b = [(f"b{i:05d}", s[3 * i][2] + s[3 * i + 1][2], days(i), "") for i in range(n)]
        group = f"sums{n}"
        spark.sparkContext.setJobGroup(group, group)
        got = matching.decompose(spark.createDataFrame(s, SETTLEMENT), spark.createDataFrame(b, LINE)).where("verdict = 'match'").count()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got > n / 2
    assert jobs[1] <= jobs[0] + 5


def test_only_payouts_that_lost_a_credit_are_listed_again(spark, cal, monkeypatch):
    """Three payouts want the same credit, one takes it each round; a payout far away keeps what it has."""
    s = [("s1", None, 1000, days(0)), ("s2", None, 1000, days(0)), ("s3", None, 1000, days(0)), ("s4", None, 9000, days(40))]
    b = [("b1", 1000, days(0), ""), ("b2", 1001, days(0), ""), ("b3", 1002, days(0), ""), ("b9", 9000, days(40), "")]
    listed, plain = [], adjudicate.shortlist

    def counted(payouts, *rest):
        listed.append(sorted(r.settlement_id for r in payouts.select("settlement_id").collect()))
        return plain(payouts, *rest)

    monkeypatch.setattr(adjudicate, "shortlist", counted)
    out, declined = adjudicate.adjudication(spark.createDataFrame(s, SETTLEMENT), spark.createDataFrame(b, LINE), cal, adjudicator=reckless)
    assert {(r.settlement_ids[0], r.bank_line_ids[0]) for r in out.matches.collect()} == {("s1", "b1"), ("s2", "b2"), ("s3", "b3"), ("s4", "b9")}
    assert listed[:3] == [["s1", "s2", "s3", "s4"], ["s2", "s3"], ["s3"]] and declined.isEmpty()


def test_near_amounts_meet_within_days_only(spark):
    n = 20_000
    s = spark.range(n).select(F.col("id").alias("i"), F.lit(500).cast("long").alias("payout"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 200).cast("int")).alias("lo")).withColumn("hi", F.col("lo"))
    b = spark.range(200).select(F.col("id").alias("j"), (F.lit(498) + F.col("id") % 5).alias("amount"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    met = joins.near_amount(s, b, "payout", "amount", 5, ("lo", "hi", "day"))
    assert met.count() == n and met.where("day <> lo").isEmpty()


def test_reversals_share_amount_days_and_a_token(spark):
    rng = random.Random(4)
    c = [(f"c{i:03d}", rng.choice([100, 200]), days(rng.randrange(12)), f"NEFT-QWERK{rng.randrange(6)}0000012345-X") for i in range(40)]
    d = [(f"d{i:03d}", -rng.choice([100, 200]), days(rng.randrange(12)), f"NEFT-QWERK{rng.randrange(6)}0000012345-Y-MNBVC{rng.randrange(3)}0000054321") for i in range(40)]
    config, gone, want = Config(), set(), set()
    tokens = {r.line_id: set(r.tokens) for r in joins.line_facts(spark.createDataFrame(c + d, LINE)).collect()}
    for i, a, on, _ in sorted(c):
        fits = [k for k, x, at, _ in sorted(d) if k not in gone and x == -a and abs((at - on).days) <= config.slack_days and tokens[i] & tokens[k]]
        if fits:
            want.add((i, fits[0]))
            gone.add(fits[0])
    got = matching.reversals(spark.createDataFrame(c, LINE), spark.createDataFrame(d, LINE), config).matches.collect()
    found = {tuple(sorted(r.bank_line_ids)) for r in got}
    assert len(want) > 5 and (sorted(found - want), sorted(want - found)) == ([], [])
