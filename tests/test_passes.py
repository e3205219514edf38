"""Passes and joins against sequential or all-pairs versions, hot keys, and runs under other settings."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import narration
from ledgerloom.functions.dates import calendar
from ledgerloom.operators import adjudicate, audits, joins, matching, report, verify
from ledgerloom.operators.records import Config
from ledgerloom.operators.subsets import credible_cardinality, find_subsets, is_credible
from ledgerloom.plans import cascade
from ledgerloom.sources import files

DAY = dt.date(2026, 7, 15)
SETTLEMENT, LINE = "settlement_id string, utr string, amount long, settled_on date", "line_id string, amount long, value_date date, narration string"


@pytest.fixture(scope="module")
def cal(spark):
    return calendar(spark, "2026-06-01", "2026-12-31").cache()


def days(n):
    return DAY + dt.timedelta(days=n)


def test_a_long_chain_of_conflicts_is_decided_fully(spark):
    """Each payout's line is also the next one's; more rounds than any fixed cap of 50."""
    pairs = [(f"s{i:03d}", f"b{j:03d}") for i in range(55) for j in (i - 1, i) if j >= 0]
    df = spark.createDataFrame(pairs, "settlement_id string, line_id string").coalesce(1)
    got = matching.ordered(df, lambda p: p.groupBy("settlement_id").agg(F.min("line_id").alias("line_id")))
    assert sorted((r.settlement_id, r.line_id) for r in got.collect()) == [(f"s{i:03d}", f"b{i:03d}") for i in range(55)]


def windows(s, cal_rows):
    banking = [d for d, b in cal_rows if b]
    after = lambda d, n: [x for x in banking if x > d][n - 1]
    return {i: (d - dt.timedelta(days=3), after(d, 2)) for i, _, _, d in s}


def test_unique_amount_by_brute_force(spark, cal):
    rng = random.Random(1)
    s = [(f"s{i:03d}", None, rng.choice([100, 200, 300, 400 + i]), days(rng.randrange(60))) for i in range(150)]
    b = [(f"b{i:03d}", rng.choice([100, 200, 300, 400 + i]), days(rng.randrange(60)), "") for i in range(150)]
    span = windows(s, [(r.day, r.banking) for r in cal.collect()])
    open_s, open_b, want, sets = {r[0]: r for r in s}, {r[0]: r for r in b}, set(), set()
    for i, _, a, _d in sorted(s):
        if i not in open_s:
            continue
        lo, hi = span[i]
        mine = [k for k, x, d, _ in open_b.values() if x == a and lo <= d <= hi]
        rivals = [k for k, _, x, d in open_s.values() if x == a and lo - dt.timedelta(days=2) <= d <= hi + dt.timedelta(days=2)]
        if not mine or (len(rivals) == 1 and len(mine) > 1):
            continue
        (want if len(rivals) == 1 else sets).add((tuple(sorted(rivals)), tuple(sorted(mine))))
        for k in rivals:
            del open_s[k]
        for k in mine:
            del open_b[k]
    out = matching.unique_amount(spark.createDataFrame(s, SETTLEMENT), spark.createDataFrame(b, LINE), cal)
    assert {(tuple(r.settlement_ids), tuple(r.bank_line_ids)) for r in out.matches.collect()} == want
    assert {(tuple(r.subject_ids), tuple(r.candidates)) for r in out.exceptions.collect()} == sets and want and sets


def test_one_amount_on_many_payouts(spark, cal):
    n = 100_000
    s = spark.range(n).select(F.format_string("s%06d", "id").alias("settlement_id"), F.lit(None).cast("string").alias("utr"), F.lit(499_00).cast("long").alias("amount"),
                              F.date_add(F.lit("2026-07-01").cast("date"), (F.col("id") % 90).cast("int")).alias("settled_on"))
    b = spark.range(n // 2).select(F.format_string("b%06d", "id").alias("line_id"), F.lit(499_00).cast("long").alias("amount"),
                                   F.date_add(
                                       F.lit("2026-07-01").cast("date"), (F.col("id") % 90).cast("int")
                                   ).alias("value_date"), F.lit("").alias("narration"))
    out = matching.unique_amount(s, b, cal)
    assert out.matches.isEmpty()
    named = out.exceptions.select(F.explode("subject_ids")).count()
    assert named == out.exceptions.select(F.explode("subject_ids")).distinct().count() == n


def test_decompose_by_brute_force(spark):
    rng, config = random.Random(2), Config()
    s = [(f"s{i:03d}", None if rng.random() < 0.7 else "x", rng.randrange(10_000, 90_000_000), days(rng.randrange(6))) for i in range(40)]
    b = []
    for i in range(25):
        d = rng.randrange(6)
        near = [r for r in s if (days(d) - r[3]).days in (0, 1)]
        amount = sum(r[2] for r in rng.sample(near, min(2, len(near)))) if rng.random() < 0.7 else rng.randrange(10_000, 90_000_000)
        b.append((f"b{i:03d}", amount, days(d), ""))
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
                if len(best) >= 2:
                    verdict, chosen = "match", best
            elif len(found.solutions) > 1:
                verdict = "ambiguous"
        want[i] = (verdict, tuple(sorted(chosen)), len(pool), most)
        for k in chosen:
            del open_s[k]
    got = matching.decompose(spark.createDataFrame(s, SETTLEMENT), spark.createDataFrame(b, LINE)).collect()
    assert {r.line_id: (r.verdict, tuple(sorted(r.settlements)), r.pool_size, r.most) for r in got} == want
    assert sum(v[0] == "match" for v in want.values()) > 4


def test_nearest_amounts_by_brute_force(spark):
    rng = random.Random(3)
    s = [(f"s{i}", rng.randrange(1000), days(0), days(4)) for i in range(30)]
    b = [(f"b{i:03d}", rng.choice([rng.randrange(1000), 500]), days(rng.randrange(6))) for i in range(200)]
    left = spark.createDataFrame(s, "settlement_id string, payout long, win_lo date, win_hi date")
    found = {}
    for r in joins.nearest_amounts(left, spark.createDataFrame(b, "line_id string, amount long, value_date date"), 8).collect():
        found.setdefault(r.settlement_id, set()).add(r.line_id)
    for i, payout, lo, hi in s:
        order = sorted((abs(a - payout), k) for k, a, d in b if lo <= d <= hi)[:8]
        assert {k for _, k in order} <= found[i] and len(found[i]) <= 5 * 16


def test_reference_candidates_by_brute_force(spark, cal):
    rng = random.Random(4)
    letters = "ABCDEFGHKLMN0123456789"
    refs = ["".join(rng.choice(letters) for _ in range(rng.choice([5, 9, 12, 16, 18]))) for _ in range(60)]
    s = [(f"s{i:02d}", r, 100, days(rng.randrange(5))) for i, r in enumerate(refs)]
    b = []
    for i, r in enumerate(refs):
        t = list(r)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(t) - 1)
            how = rng.randrange(4)
            if how == 0:
                t[k], t[k + 1] = t[k + 1], t[k]
            elif how == 1:
                t[k] = rng.choice(letters)
            elif how == 2 and len(t) > 4:
                del t[k]
            else:
                t.insert(k, rng.choice(letters))
        b.append((f"b{i:02d}", 100, days(rng.randrange(9)), rng.choice(["NEFT-%s-X", "IMPS%s", "to %s by"]) % "".join(t)))
    windowed = joins.with_windows(spark.createDataFrame(s, SETTLEMENT), cal)
    bank = spark.createDataFrame(b, LINE)
    got = {(r.settlement_id, r.line_id) for r in joins.reference_candidates(windowed, bank).collect()}
    facts = {r.line_id: r for r in joins.line_facts(bank).collect()}
    want = set()
    for r in windowed.collect():
        near = {k for k, f in facts.items() if r.wide_lo <= f.value_date <= r.wide_hi}
        cheap = {k for k, f in facts.items() if any(t == r.utr or (len(t) >= 8 and len(r.utr) >= 8 and t[:8] == r.utr[:8]) for t in f.tokens)}
        cheap |= {k for k in near if r.utr in facts[k].flat}
        if not cheap:
            cheap = {
                k for k in near if any(
                    len(t) >= 10 and abs(len(t) - len(r.utr)) <= 2 and narration.osa_distance(t, r.utr, 2) <= 2 for t in facts[k].tokens
                )
            }
        want |= {(r.settlement_id, k) for k in cheap}
    named = spark.createDataFrame(sorted(want), "settlement_id string, line_id string").join(windowed, "settlement_id").join(bank, "line_id")
    scoring = {(r.settlement_id, r.line_id) for r in narration.score_matches(named).where("score > 0").collect()}
    assert scoring <= got <= want and len(scoring) > 20  # pairs that share a head and nothing else score nothing


def test_references_of_one_head_meet_only_near_ones(spark):
    """A thousand references of a bank with one head, each on a line of its own, some with two letters changed."""
    rng = random.Random(8)
    refs = [f"NORBN180{n:08d}" for n in rng.sample(range(10**8), 1000)]
    swap = lambda t: t[:12] + t[13] + t[12] + t[14:]
    shown = [swap(t) if i % 10 == 0 else t[:12] if i % 10 == 1 else t[:10] + t[11:-1] if i % 10 == 2 else t for i, t in enumerate(refs)]
    s = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(refs)], "settlement_id string, _t string")
    f = spark.createDataFrame([(f"b{i}", [t]) for i, t in enumerate(shown)], "line_id string, tokens array<string>")
    got = {(int(r.settlement_id[1:]), int(r.line_id[1:])) for r in joins.by_token(s, f).collect()}
    near = lambda t, x: t.startswith(x) or (abs(len(t) - len(x)) <= 2 and narration.osa_distance(t, x, 2) <= 2)
    digits = lambda x: [x.count(d) for d in "0123456789"]
    apart = lambda a, b: sum(abs(x - y) for x, y in zip(a, b, strict=True)) > 4
    a, b = [digits(t) for t in refs], [digits(x) for x in shown]
    want = {(i, j) for i in range(1000) for j in range(1000) if (not apart(a[i], b[j]) or refs[i].startswith(shown[j])) and near(refs[i], shown[j])}
    assert got == want and len({i for i, j in want if i == j}) == 1000 and len(want) < 1200
    assert {r[0] for r in joins.headed(s, f).collect()} == {f"s{i}" for i in range(1000)}


def test_rows_that_cant_be_read_have_their_numbers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,date,amount,narration\nb1,2026-07-15,10,a\n,2026-07-15,20,b\nb3,never,30,c\n,2026-07-15,40,d\n")
    _, bad = files.parse_rows(files.read_csv(spark, str(tmp_path / "x.csv")), "bank", "x.csv")
    assert sorted((r.row_number, r.reason, r.record_id) for r in bad.collect()) == [
        (3, "line_id is missing", None), (4, "value_date can't be read", "b3"), (5, "line_id is missing", None)
    ]
    x = audits.quarantine_exceptions(bad).collect()
    assert len({r.exception_id for r in x}) == 3 and {r.subject_ids[0] for r in x} == {"x.csv:3", "b3", "x.csv:5"}


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_a_run_again_gives_the_same(spark, labelled):
    _, batch, run = labelled
    again = cascade.run(batch)
    assert ids(again.accepted.select("match_id")) == ids(run.accepted.select("match_id")) != []
    assert ids(again.exceptions.select("exception_id")) == ids(run.exceptions.select("exception_id"))
    assert ids(
        again.journal.select(F.concat_ws("|", "entry_id", "account", "amount"))
    ) == ids(run.journal.select(F.concat_ws("|", "entry_id", "account", "amount")))


def test_matches_carry_what_they_are_made_of(spark, labelled):
    _, _, run = labelled
    own = run.accepted.where("size(settlement_ids) > 0")
    assert own.where("size(payment_ids) = 0").isEmpty() and not own.where("size(ledger_entry_ids) > 0").isEmpty()
    assert run.accepted.where("tier = 'T7' and adjudicator <> 'offline'").isEmpty()


def test_key_figures_of_a_run(spark, labelled):
    _, batch, run = labelled
    row = report.run_summary(run).first()
    assert row.records == batch.record_count().first().records and row.adjudicator == "offline" and row.journal_balances
    assert sum(row.tier_counts.values()) == row.matches and sum(row.reason_counts.values()) == row.exceptions == sum(row.severity_counts.values())
    assert set(row.stage_timings) == {"reconcile", "verify", "post", "score"} and row.throughput_per_second > 0
    assert row.quarantined == batch.quarantine.count() and row.verifier_rejections == 0


def test_tolerance_of_nothing_matches_no_more(spark, labelled, cal):
    _, batch, run = labelled
    credits = batch.bank.where("amount > 0")
    loose, tight = (matching.tolerance_amount(batch.settlements, credits, batch.calendar, Config(amount_tolerance=t)).matches for t in (5, 0))
    assert 0 < tight.count() <= loose.count() and tight.where("bank_total <> expected_total").isEmpty()


def reckless(candidates):
    """Takes the first candidate, always, and is sure of it."""
    first = candidates.where("place = 1")
    return first.withColumn("confidence", F.lit(1.0)).withColumn("rationale", F.lit("sure")).withColumn("decision", F.lit("match"))


def test_a_reckless_adjudicator_is_stopped(spark, cal):
    s = spark.createDataFrame([(f"s{i}", None, 1000 * i, DAY) for i in range(1, 5)], SETTLEMENT)
    b = spark.createDataFrame([("b1", 1000, DAY, "x"), ("b2", 1990, DAY, "x"), ("b3", 3003, days(1), "x")], LINE)
    proposed = adjudicate.adjudication(s, b, cal, adjudicator=reckless)[0].matches.withColumn("seq", F.xxhash64("match_id"))
    accepted, rejected, found = verify.verify(proposed, s, b, cal)
    assert {r.settlement_ids[0] for r in accepted.collect()} == {"s1", "s3"} and {r.settlement_ids[0] for r in rejected.collect()} == {"s2"}
    assert {r.invariant for r in found.collect()} == {"balances"} and {r.adjudicator for r in proposed.collect()} == {"reckless"}
    assert adjudicate.adjudication(s.limit(0), b.limit(0), cal, adjudicator=reckless)[0].matches.isEmpty()


def test_recorded_sessions_and_truth(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"recorded_at": "x", "provider": "p", "model": "m", "cases": [{"settlement_id": "s1", "candidates": ["b1", "b2"], "confidence": 0.5}]}]')
    rows = files.load_transcripts(spark, str(tmp_path / "t.json")).collect()
    assert [(r.settlement_id, r.candidates, r.model) for r in rows] == [("s1", ["b1", "b2"], "m")]
    assert files.load_transcripts(spark, str(tmp_path / "none.json")).count() == 0 == files.load_truth(spark, str(tmp_path / "none.json")).count()
    files.write_truth(spark.createDataFrame([("c1", "s", "match")], "case_id string, scenario string, disposition string"), str(tmp_path / "truth"))
    assert spark.read.schema(files.TRUTH).json(str(tmp_path / "truth")).first().disposition == "match"


def test_fee_audit_of_a_stream(spark, tmp_path):
    from ledgerloom.functions.fees import rate_card, with_fees
    from ledgerloom.streaming import audits as streaming

    at = dt.datetime(2026, 7, 15, 10, 0)
    rows = [(f"p{i}", 100_000, "credit_card", at + dt.timedelta(minutes=20 * i)) for i in range(9)]
    p = with_fees(spark.createDataFrame(rows, "payment_id string, gross long, method string, captured_at timestamp"), rate_card(spark))
    p = p.select("payment_id", "gross", "method", "captured_at", (F.col("expected_fee") + F.when(F.crc32("payment_id") % 2 == 0, 500).otherwise(0)).alias("fee"), F.col("expected_tax").alias("tax"))
    p.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")
    for name, df, mode in (("off", streaming.fee_deviations(stream, rate_card(spark)), "append"), ("hours", streaming.overcharge_by_hour(stream, rate_card(spark)), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        assert q.awaitTermination(120)
    want = p.where("fee > 2000").count()
    assert spark.table("off").count() == want > 0 and spark.table("off").where("delta = 500").count() == want
    assert spark.table("hours").agg(F.sum("payments"), F.sum("overcharge")).first()[:] == (want, 500 * want)
