"""Passes on small hand-made batches, guards against bad proposals, and a labelled batch end to end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.dates import calendar
from ledgerloom.operators import adjudicate, journal, matching, report, scorecard, verify
from ledgerloom.operators.records import EVIDENCE, evidence
from ledgerloom.plans import cascade
from ledgerloom.sources import files, generator, world

DAY = dt.date(2026, 7, 15)


@pytest.fixture(scope="module")
def cal(spark):
    return calendar(spark, "2026-06-01", "2026-09-30").cache()


def payouts(spark, rows):
    return spark.createDataFrame([(i, u, a, d) for i, u, a, d in rows], "settlement_id string, utr string, amount long, settled_on date")


def lines(spark, rows):
    return spark.createDataFrame(rows, "line_id string, amount long, value_date date, narration string")


def test_reversals_take_the_first_partner(spark):
    c = lines(spark, [("c1", 500, DAY, "REV RVSL0000000001"), ("c2", 500, DAY, "REV RVSL0000000001"), ("c3", 700, DAY, "none")])
    d = lines(spark, [("d1", -500, DAY, "RVSL0000000001 back"), ("d2", -700, DAY, "none")])
    got = matching.reversals(c, d).matches.collect()
    assert [r.bank_line_ids for r in got] == [["c1", "d1"]] and got[0].bank_total == 0


def test_identifier_verdicts(spark, cal):
    u = [f"NORBN{i:011d}" for i in (11111111111, 22222222222, 33333333333, 44444444444, 55555555555, 66666666666, 77777777777)]
    s = payouts(spark, [(f"s{i}", x, 100_000 + i, DAY) for i, x in enumerate(u)])
    late = DAY + dt.timedelta(days=14)
    b = lines(spark, [
        ("b0", 100_000, DAY, f"NEFT-{u[0]}-X"), ("b1", 100_003, DAY, f"NEFT-{u[1]}-X"), (
            "b2", 100_002, late, f"NEFT-{u[2]}-X"
        ), ("b3", 1_000, DAY, f"NEFT-{u[3]}-X"),
        ("b4a", 50_002, DAY, f"NEFT-{u[4]}-X"), ("b4b", 50_002, DAY, f"NEFT-{u[4]}-X"), ("b5a", 100_005, DAY, f"NEFT-{u[5]}-X"), ("b5b", 100_005, DAY, f"NEFT-{u[5]}-X"), (
            "b6", 100_006, DAY, f"NEFT-{u[6][:12]}"
        ),
    ])
    out = matching.identifier(s, b, b, cal)
    m = {r.settlement_ids[0]: (r.tier, r.reason) for r in out.matches.collect()}
    assert m == {"s0": ("T0", "utr_exact"), "s1": ("T3", "rounding_tolerance"), "s4": ("T5", "split_settlement"), "s6": ("T1", "utr_in_narration")}
    x = {tuple(r.subject_ids): r.reason for r in out.exceptions.collect()}
    assert x == {("s2",): "date_out_of_window", ("s3",): "scale_error_suspected", ("b5a", "b5b"): "duplicate_identifier"}


def test_unique_amount_is_mutual(spark, cal):
    far = DAY + dt.timedelta(days=40)
    s = payouts(spark, [("s1", None, 100, DAY), ("s2", None, 200, DAY), ("s3", None, 200, DAY), ("s4", None, 300, DAY), ("s5", None, 100, far)])
    b = lines(spark, [("b1", 100, DAY, ""), ("b2", 200, DAY, ""), ("b3", 300, DAY, ""), ("b4", 300, DAY, ""), ("b5", 100, far, "")])
    out = matching.unique_amount(s, b, cal)
    assert {(*r.settlement_ids, *r.bank_line_ids) for r in out.matches.collect()} == {("s1", "b1"), ("s5", "b5")}
    assert [(r.subject_ids, r.candidates) for r in out.exceptions.collect()] == [(["s2", "s3"], ["b2"])]


def test_tolerance_goes_in_order(spark, cal):
    s = payouts(spark, [("s1", None, 1000, DAY), ("s2", None, 1004, DAY)])
    b = lines(spark, [("b1", 1002, DAY, "")])
    assert [r.settlement_ids for r in matching.tolerance_amount(s, b, cal).matches.collect()] == [["s1"]]


def test_batches(spark):
    s = payouts(spark, [(f"s{i}", None, a, DAY) for i, a in enumerate((1_234_567, 2_345_678, 9_876_543, 5_555_555))])
    b = lines(spark, [("b1", 1_234_567 + 9_876_543, DAY, ""), ("b2", 77, DAY, "")])
    out, vain = matching.batch_decomposition(s, b)
    assert [r.settlement_ids for r in out.matches.collect()] == [["s0", "s2"]] and [r.line_id for r in vain.collect()] == ["b2"]


def test_adjudication_declines_what_is_close(spark, cal):
    s = payouts(spark, [("s1", "NORBN11111111111", 1000, DAY), ("s2", "NORBN22222222222", 5000, DAY)])
    b = lines(spark, [("b1", 1000, DAY, "NEFT NORBN1111111"), ("b2", 5003, DAY, "NEFT"), ("b3", 5002, DAY, "NEFT")])
    out, declined = adjudicate.adjudication(s, b, cal)
    assert [(r.settlement_ids, r.tier) for r in out.matches.collect()] == [(["s1"], "T7")]
    assert [r.settlement_id for r in declined.collect()] == ["s2"]
    assert adjudicate.adjudication(s, b, cal, adjudicator=None)[0].matches is None


def proposal(spark, rows):
    m = spark.createDataFrame(
        rows,
        "match_id string, seq long, bank_line_ids array<string>, settlement_ids array<string>, reason string, confidence double, bank_total long, expected_total long, weight double"
    )
    return m.withColumn("tier", F.lit("T7")).withColumn("evidence", F.array(evidence("x", F.lit("x"), F.col("weight"))).cast(EVIDENCE)).drop("weight")


def test_verifier_checks_one_by_one(spark, cal):
    s = payouts(spark, [("s1", None, 1000, DAY), ("s2", None, 1000, DAY), ("s3", None, 500, DAY)])
    b = lines(spark, [("b1", 1000, DAY, ""), ("b2", -500, DAY, ""), ("b3", 500, DAY + dt.timedelta(days=30), ""), ("b4", 500, DAY, "")])
    rows = [
        ("good", 1, ["b1"], ["s1"], "utr_exact", 0.9, 1000, 1000, 1.0), (
            "again", 2, ["b1"], ["s2"], "utr_exact", 0.9, 1000, 1000, 1.0
        ), ("lost", 3, ["b9"], ["s3"], "utr_exact", 0.9, 500, 500, 1.0),
        (
            "bare", 4, ["b4"], ["s3"], "utr_exact", 0.9, 500, 500, 0.0
        ), ("sure", 5, ["b4"], ["s3"], "utr_exact", 1.2, 500, 500, 1.0), ("off", 6, ["b4"], ["s2"], "utr_exact", 0.9, 500, 1000, 1.0),
        (
            "stated", 7, ["b4"], ["s3"], "utr_exact", 0.9, 499, 500, 1.0
        ), ("debit", 8, ["b2"], ["s3"], "utr_exact", 0.9, -500, 500, 1.0), ("old", 9, ["b3"], ["s3"], "utr_exact", 0.9, 500, 500, 1.0),
        ("net", 10, ["b2", "b4"], [], "reversal_netted", 0.9, 0, 0, 1.0), ("badnet", 11, ["b1", "b2"], [], "reversal_netted", 0.9, 500, 0, 1.0),
    ]
    accepted, rejected, found = verify.verify(proposal(spark, rows), s, b, cal)
    by = {}
    for r in found.collect():
        by.setdefault(r.match_id, set()).add(r.invariant)
    assert by == {
        "again": {"no_double_claim"}, "lost": {"records_exist"}, "bare": {"has_evidence"}, "sure": {"confidence_sane"}, "off": {"balances"},
        "stated": {"balances"}, "debit": {"balances", "credits_only"}, "old": {"date_plausible"}, "badnet": {"balances"}
    }
    assert {r.match_id for r in accepted.collect()} == {"good", "net"} and rejected.count() == 9
    x = verify.rejections(rejected, found)
    assert x.count() == 9 and x.where("subject_source = 'bank'").count() == 1
    assert verify.report(proposal(spark, rows), found).first().rejected == 9


def test_labelled_batch(spark, labelled):
    folder, batch, run = labelled
    card = scorecard.ratios(run.cases).first()
    assert card.false_match == 0 and card.wrong_match == 0 and card.precision == 1.0
    assert card.accuracy >= 0.93 and card.exception_recall >= 0.99 and card.reason_accuracy >= 0.97
    totals = journal.totals(run.journal).first()
    assert totals.balanced and totals.debits == totals.credits and journal.unbalanced(run.journal).isEmpty()
    held = run.accepted.select(F.explode(F.concat("bank_line_ids", "settlement_ids")).alias("id"))
    assert held.count() == held.distinct().count()
    assert batch.quarantine.count() == run.exceptions.where("reason = 'malformed_record'").count() > 0
    settled = run.accepted.select(F.explode("settlement_ids").alias("settlement_id"))
    flagged = run.exceptions.select(F.explode("subject_ids").alias("settlement_id")).union(run.exceptions.select(F.explode("candidates")))
    assert batch.settlements.join(settled.union(flagged), "settlement_id", "left_anti").isEmpty()


def test_reports_of_a_run(spark, labelled, tmp_path):
    _, _, run = labelled
    assert report.ask("", run).count() == 1 and report.ask("what is at risk?", run).count() <= 2 and report.ask("match rate", run).count() == 1
    assert report.ask("any missing bank credit?", run).count() == run.exceptions.where("reason = 'missing_bank_credit'").count()
    files.export(run, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/matches").count() == run.accepted.count()
    assert report.scenario_summary(generator.catalogue(spark), run.cases).count() == 30


def test_empty_folder(spark, tmp_path):
    batch = files.load_batch(spark, str(tmp_path))
    assert batch.record_count().first().records == 0
    run = cascade.run(batch)
    assert run.accepted.isEmpty() and run.exceptions.isEmpty() and journal.totals(run.journal).first().balanced


def test_reader_takes_aliases_and_marks(spark, tmp_path):
    (tmp_path / "x.csv").write_text(
        "﻿Txn ID,Posting Date,Particulars,DR,CR\nb1,15/07/2026,hello,\"1,000.50\",\nb2,15-Jul-2026,there,,20\n,15-Jul-2026,none,,20\nb4,never,none,,20\n",
        encoding="utf-8"
    )
    good, bad = files.parse_rows(files.read_csv(spark, str(tmp_path / "x.csv")), "bank")
    assert {(r.line_id, r.amount, r.narration) for r in good.collect()} == {("b1", -100050, "hello"), ("b2", 2000, "there")}
    assert sorted((r.reason, r.record_id, r.row_number) for r in bad.collect()) == [("line_id is missing", None, 4), ("value_date can't be read", "b4", 5)]


def test_world_is_the_same_for_shuffled_input(spark, tmp_path):
    """The settlement world of tables whose rows come in another order is the same."""
    import shutil

    rows = []
    for n, name in enumerate(("one", "two")):
        folder = tmp_path / name
        folder.mkdir()
        for table in ("orders", "lineitem"):
            df = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").where(("o_" if table == "orders" else "l_") + "orderkey < 40")
            df.repartition(3 + n).write.parquet(f"{folder}/{table}.parquet")
        b = world.load(spark, str(folder))
        rows.append([sorted(map(str, df.collect())) for df in (b.payments, b.settlements.select("settlement_id", "utr", "amount", "settled_on"), b.bank)])
        shutil.rmtree(folder)
    assert rows[0] == rows[1] and all(rows[0])
