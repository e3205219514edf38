"""The SQL of unique_amount goes in order of id, as the pass does: what leaves the pools is gone for later payouts."""

import datetime as dt
import random

import duckdb

from ledgerloom.plans import queries


def in_order(payouts, lines):
    """(payout, line) of the pass, payout by payout."""
    day = dt.timedelta(days=1)
    left, credits, out = dict(payouts), dict(lines), []
    for i in sorted(payouts):
        if i not in left:
            continue
        amount, lo, hi = left[i][0], left[i][1] - 3 * day, left[i][2]
        mine = [x for x, (a, d) in credits.items() if a == amount and lo <= d <= hi]
        rivals = [x for x, (a, d, _) in left.items() if a == amount and lo - 2 * day <= d <= hi + 2 * day]
        if not mine or (len(rivals) == 1 and len(mine) > 1):
            continue
        if len(rivals) == 1:
            out.append((i, mine[0], amount))
        for x in rivals:
            del left[x]
        for x in mine:
            del credits[x]
    return sorted(out)


def test_sql_goes_in_order():
    rng, start, day, chained = random.Random(2), dt.date(2026, 1, 1), dt.timedelta(days=1), 0
    old = """SELECT settlement_id, min(line_id), min(amount) FROM (SELECT b.settlement_id, l.line_id, b.amount FROM win b JOIN bank l ON l.amount = b.amount AND
      l.value_date BETWEEN b.lo AND b.hi WHERE l.amount > 0) JOIN (SELECT s.settlement_id FROM win s JOIN win r ON r.amount = s.amount AND r.settled_on BETWEEN
      s.lo - 2 AND s.hi + 2 GROUP BY s.settlement_id HAVING count(*) = 1) USING (settlement_id) GROUP BY settlement_id HAVING count(*) = 1"""
    turns = queries.TURNS[queries.TURNS.index("day_pay AS") :]
    for _ in range(25):
        payouts = {f"s{rng.randrange(10**6)}": (rng.randrange(1, 6), (d := start + rng.randrange(60) * day), d + rng.randrange(2, 5) * day) for _ in range(24)}
        # payouts of one day have one window, as in the calendar
        ends = {d: hi for _, d, hi in payouts.values()}
        payouts = {i: (a, d, ends[d]) for i, (a, d, _) in payouts.items()}
        lines = {f"b{i}": (rng.randrange(1, 6), start + rng.randrange(60) * day) for i in range(40)}
        c = duckdb.connect()
        c.execute("CREATE TABLE win (settlement_id VARCHAR, amount BIGINT, settled_on DATE, lo DATE, hi DATE)")
        c.execute("CREATE TABLE bank (line_id VARCHAR, amount BIGINT, value_date DATE)")
        c.executemany("INSERT INTO win VALUES (?, ?, ?, ?, ?)", [(i, a, d, d - 3 * day, hi) for i, (a, d, hi) in payouts.items()])
        c.executemany("INSERT INTO bank VALUES (?, ?, ?)", [(i, a, d) for i, (a, d) in lines.items()])
        select = queries.SQL["unique_amount"][queries.SQL["unique_amount"].index("SELECT w.matched AS settlements") :]
        want = in_order(payouts, lines)
        assert sorted(c.execute(f"WITH {turns}\n{select}").fetchall()) == want
        chained += sorted(c.execute(old).fetchall()) != want
    assert chained  # the earlier SQL looked at all payouts and credits at once
