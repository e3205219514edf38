"""More registered queries: ingest of each export, calendars, tool views, report views, subset sums, scoring.

Like those of plans.queries, each works on whole tables of the settlement world, with the SQL that it is compared with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import fees
from ..operators import adjudicate, joins, journal, matching, report, scorecard, subsets, verify
from ..operators.records import EVIDENCE, Config, as_exceptions, evidence, settle, with_members
from ..sources import files, generator, world
from .queries import (
    AUDITED, CASES, COMPONENTS, IDENTIFIED, INVERT_SQL, PAIRS, POSTED, TOKEN_SQL, WEIGHED, WINDOWED, _decided, _evidence, audited, fixed, posted, query, rel, seeded_matches,
)


# --- ingest ----------------------------------------------------------------------------------------------------------
def rupees(paise: str):
    x = F.abs(F.col(paise))
    return F.concat(F.when(F.col(paise) < 0, "-").otherwise(""), F.floor(x / 100).cast("string"), F.lit("."), F.lpad((x % 100).cast("string"), 2, "0"))


@query(world.sql("SELECT payment_id, order_id, gross, fee, tax, net, captured_on, method, currency, settlement_id, international FROM paynet"))
def ingest_payments(spark, sf_dir):
    """Payments from texts under another export's names; a third state no net, which then follows from the rest."""
    p = world.load(spark, sf_dir).payments
    raw = p.select(
        F.col("payment_id").alias("Txn ID"), F.col("order_id").alias("Reference ID"), rupees("gross").alias("Gross Amount"), rupees("fee").alias("Commission"), rupees("tax").alias("GST"),
        F.when(F.crc32("payment_id") % 3 > 0, rupees("net")).alias("Settled Amount"), F.concat(
            F.date_format("captured_on", "yyyy-MM-dd"), F.lit("T12:00:00+05:30")
        ).alias("Created At"),
        F.upper("method").alias("METHOD"), F.lit(" ").alias("currency"), "settlement_id", F.when(
            F.col("international"), "Yes"
        ).otherwise("no").alias("international"))
    return files.parse_rows(raw, "payments")[0].select(
        "payment_id", "order_id", "gross", "fee", "tax", "net", "captured_on", "method", "currency", "settlement_id", "international"
    )


@query(world.sql("""SELECT s.settlement_id, s.utr, s.amount, s.settled_on, p.ids, coalesce(r.ids, '') AS refund_ids, coalesce(a.ids, '') AS
  adjustment_ids FROM setl s
  JOIN (SELECT settlement_id, string_agg(payment_id, ',' ORDER BY payment_id) AS ids FROM pay GROUP BY settlement_id) p USING (settlement_id)
  LEFT JOIN (SELECT settlement_id, string_agg(refund_id, ',') AS ids FROM rfd GROUP BY settlement_id) r USING (settlement_id)
  LEFT JOIN (SELECT settlement_id, string_agg(adjustment_id, ',') AS ids FROM adj GROUP BY settlement_id) a USING (settlement_id)"""))  # fmt: skip
def ingest_settlements(spark, sf_dir):
    """Payouts whose ids are packed with one of three separators."""
    s = world.load(spark, sf_dir).settlements
    mark = F.element_at(F.array(F.lit("|"), F.lit(" , "), F.lit("; ")), (F.crc32("settlement_id") % 3 + 1).cast("int"))
    packed = lambda c: F.aggregate(c, F.lit(""), lambda acc, x: F.when(acc == "", x).otherwise(F.concat(acc, mark, x)))
    raw = s.select(F.col("settlement_id").alias("Payout ID"), F.col("utr").alias("RRN"), rupees("amount").alias("Payout Amount"), F.date_format("settled_on", "dd-MMM-yyyy").alias("Settlement Date"),
                   packed("payment_ids").alias("payment_ids"), packed("refund_ids").alias("refund_ids"), packed("adjustment_ids").alias("adjustment_ids"))
    good = files.parse_rows(raw, "settlements")[0]
    listed = lambda c, name: F.concat_ws(",", F.array_sort(c)).alias(name)
    return good.select(
        "settlement_id", "utr", "amount", "settled_on", listed("payment_ids", "ids"), listed("refund_ids", "refund_ids"),
        listed("adjustment_ids", "adjustment_ids")
    )


@query(
    world.sql(
        "SELECT refund_id AS id, 'refund' AS kind, amount, created_on AS day, settlement_id, payment_id AS linked FROM rfd UNION ALL SELECT adjustment_id, kind, amount, created_on, settlement_id, linked_payment_id FROM adj"
    )
)
def ingest_deductions(spark, sf_dir):
    """Refunds and adjustments from texts; amounts in brackets or with a sign."""
    b = world.load(spark, sf_dir)
    r = b.refunds.select(
        F.col("refund_id").alias("ID"), "payment_id", rupees("amount").alias("amount"), F.date_format("created_on", "dd/MM/yyyy").alias("date"),
        "settlement_id"
    )
    size = F.abs("amount")
    bracket = F.concat(F.lit("("), F.floor(size / 100).cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"), F.lit(")"))
    a = b.adjustments.select(
        "adjustment_id", F.upper("kind").alias("Type"), bracket.alias("amount"), F.date_format("created_on", "yyyy-MM-dd").alias("created_at"),
        "settlement_id", F.col("linked_payment_id").alias("payment_id")
    )
    good_r, good_a = files.parse_rows(r, "refunds")[0], files.parse_rows(a, "adjustments")[0]
    return good_r.select(F.col("refund_id").alias("id"), F.lit("refund").alias("kind"), "amount", F.col("created_on").alias("day"), "settlement_id", F.col("payment_id").alias("linked")).unionByName(
        good_a.select(
            F.col("adjustment_id").alias("id"), "kind", "amount", F.col("created_on").alias("day"), "settlement_id",
            F.col("linked_payment_id").alias("linked")
        ))


@query(world.sql("SELECT entry_id, order_id, expected_gross, booked_on, 'INR' AS currency, 'open' AS status FROM led"))
def ingest_ledger(spark, sf_dir):
    raw = world.load(spark, sf_dir).ledger.select(
        "entry_id", F.col("order_id").alias("Order"), rupees("expected_gross").alias("Invoice Amount"),
        F.date_format("booked_on", "MMM d, yyyy").alias("Invoice Date")
    )
    return files.parse_rows(raw, "ledger")[0].select("entry_id", "order_id", "expected_gross", "booked_on", "currency", "status")


@query(world.sql("SELECT 'bank_statement.csv:' || CAST(k AS STRING) AS subject FROM pay WHERE seq = 1"))
def quarantine_subjects(spark, sf_dir):
    """Rows without id are named by their place, each for itself."""
    raw = rel(spark, sf_dir, "SELECT k, '' AS id, 'x' AS amount, '2026-07-15' AS date FROM pay WHERE seq = 1")
    bad = files.parse_rows(raw, "bank", row_number=F.col("k"))[1]
    from ..operators.audits import quarantine_exceptions

    return quarantine_exceptions(bad).select(F.get("subject_ids", F.lit(0)).alias("subject"))


# --- calendars and windows -------------------------------------------------------------------------------------------
_holidays = ", ".join(f"DATE '{h}'" for h in D.HOLIDAYS)
YEAR = f"""days AS (SELECT DATE '2026-01-01' + CAST(i AS INTEGER) AS day FROM range(420) AS t(i)),
marked AS (SELECT day, isodow(day) < 6 AND day NOT IN ({_holidays}) AS banking FROM days),
chain AS (SELECT day, banking, min(CASE WHEN banking THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM marked)"""


@query(
    world.sql(
        "SELECT o.o_orderkey AS k, c.day, c.banking, c.next FROM orders o JOIN chain c ON c.day = DATE '2026-01-01' + CAST(o.o_orderkey % 365 AS INTEGER)",
        YEAR
    )
)
def banking_calendar(spark, sf_dir):
    cal = D.calendar(spark, "2026-01-01", "2027-03-31")
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("k"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("o_orderkey") % 365).cast("int")).alias("day")
    )
    return D.next_banking_day(days.withColumn("banking", D.is_banking_day(F.col("day"))), "day", "next", cal)


@query(world.sql("SELECT settlement_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM win", WINDOWED))
def date_ranges(spark, sf_dir):
    return rel(spark, sf_dir, "SELECT settlement_id, lo, hi FROM win", WINDOWED).select(
        "settlement_id", F.explode(D.date_range(F.col("lo"), F.col("hi"))).alias("day")
    )


@query(
    world.sql(
        "SELECT s.settlement_id, s.settled_on - 1 AS win_lo, a.bday AS win_hi, s.settled_on - 2 AS wide_lo, b.bday AS wide_hi FROM setl s JOIN bday a ON a.bord = s.settled_ord + 4 JOIN bday b ON b.bord = s.settled_ord + 7"
    )
)
def configured_windows(spark, sf_dir):
    b = world.load(spark, sf_dir)
    config = Config(sla_banking_days=4, slack_days=1, late_banking_days=7)
    return joins.with_windows(b.settlements, b.calendar, config).select("settlement_id", "win_lo", "win_hi", "wide_lo", "wide_hi")


# --- subset sums -----------------------------------------------------------------------------------------------------
# A pool is all orders of a customer or of a week, its target the first and the last order's sum, up to two paise off.
ITEMS = """priced AS (SELECT o_custkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_orderkey AS k,
  lpad(CAST(o_orderkey AS STRING), 10, '0') AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders),
item AS (SELECT 'customer ' || CAST(o_custkey AS STRING) AS c, k, id, p FROM priced UNION ALL SELECT 'week ' || CAST(week AS STRING), k, id, p FROM priced),
goal AS (SELECT c, CAST(min_by(p, k) + max_by(p, k) AS BIGINT) + min(k) % 5 - 2 AS goal, count(*) AS pool_size FROM item GROUP BY c)"""
# The budget of 5,000 combinations: triples up to 32 orders, pairs up to 100; larger pools are counted only.
SUMS = f"""{ITEMS}, sized AS (SELECT *, CASE WHEN pool_size > 5000 THEN 0 WHEN pool_size > 100 THEN 1 WHEN pool_size > 32 THEN 2
  ELSE least(3, pool_size) END AS most FROM goal),
one AS (SELECT i.c, i.id, i.p, i.k, s.most FROM item i JOIN sized s ON s.c = i.c WHERE p > 0 AND pool_size <= 100),
sums AS (SELECT c, p AS total, 1 AS size, id AS refs FROM one
  UNION ALL SELECT a.c, a.p + b.p, 2, least(a.id, b.id) || ',' || greatest(a.id, b.id) FROM one a JOIN one b ON a.c = b.c AND a.k < b.k WHERE a.most >= 2
  UNION ALL SELECT a.c, a.p + b.p + d.p, 3, array_to_string(list_sort([a.id, b.id, d.id]), ',') FROM one a
    JOIN one b ON a.c = b.c AND a.k < b.k JOIN one d ON d.c = a.c AND b.k < d.k WHERE a.most >= 3),
gaps AS (SELECT s.c, size, refs, total - goal AS gap FROM sums s JOIN goal g ON g.c = s.c)"""
# The 28 largest orders of a pool in two halves, of which each gives three at most.
HALVES = f"""{ITEMS}, ranked AS (SELECT item.c, p, k, row_number() OVER (PARTITION BY item.c ORDER BY p DESC, id) AS r, pool_size
  FROM item JOIN goal ON goal.c = item.c WHERE p > 0 AND pool_size <= 100),
one AS (SELECT c, p, k, r > least(28, count(*) OVER (PARTITION BY c)) // 2 AS late FROM ranked WHERE r <= 28),
part_sums AS (SELECT c, late, 0 AS size, 0 AS s FROM goal, (VALUES (true), (false)) AS v(late) WHERE pool_size <= 100
  UNION ALL SELECT c, late, 1, p FROM one
  UNION ALL SELECT a.c, a.late, 2, a.p + b.p FROM one a JOIN one b ON a.c = b.c AND a.late = b.late AND a.k < b.k
  UNION ALL SELECT a.c, a.late, 3, a.p + b.p + d.p FROM one a JOIN one b ON a.c = b.c AND a.late = b.late AND a.k < b.k
    JOIN one d ON d.c = a.c AND d.late = a.late AND b.k < d.k)"""


def pools(spark, sf_dir) -> DataFrame:
    """The pool of every customer and week: c, goal, pool_size, most, ids, amounts (null where even pairs are over the budget)."""
    items = rel(spark, sf_dir, "SELECT c, id, p FROM item", ITEMS)
    return subsets.bounded_pools(items, ["c"], "id", "p", most=3).join(rel(spark, sf_dir, "SELECT c, goal FROM goal", ITEMS), "c")


@query(world.sql("""SELECT s.c, s.pool_size, CAST(s.most AS INTEGER) AS most, CASE WHEN pool_size <= 100 THEN least(count(g.c), 8) END AS solutions,
  CASE WHEN pool_size <= 100 THEN count(g.c) > 8 END AS truncated, CASE WHEN pool_size <= 100 THEN count(g.c) = 1 END AS is_unique,
  CASE WHEN pool_size <= 100 THEN CAST(count(*) FILTER (gap = 0) AS BIGINT) END AS exact, first(refs ORDER BY abs(gap), size, refs) AS best
  FROM sized s LEFT JOIN (SELECT * FROM gaps WHERE abs(gap) <= 5) g ON g.c = s.c GROUP BY s.c, s.pool_size, s.most""", SUMS))  # fmt: skip
def subset_sums(spark, sf_dir):
    """What of a pool's orders adds up to the target; pools of more than 34 take branch and bound."""
    solved = F.when(F.col("ids").isNotNull(), subsets.solve(*subsets.listed("ids", "amounts"), "goal", "most"))
    found = pools(spark, sf_dir).withColumn("s", solved)
    return found.select("c", "pool_size", "most", "s.solutions", "s.truncated", "s.is_unique", "s.exact", "s.best")


@query(world.sql("""SELECT s.c, round(least(count(g.c), 120) * 11 / 4001.0, 6) AS chance, least(count(g.c), 120) * 11 / 4001.0 < 0.05 AS credible
  FROM sized s LEFT JOIN (SELECT * FROM gaps WHERE abs(gap) <= 2000) g ON g.c = s.c WHERE s.pool_size <= 100 GROUP BY s.c""", SUMS))  # fmt: skip
def chance_hits(spark, sf_dir):
    found = pools(spark, sf_dir).where("ids IS NOT NULL").select("c", subsets.chance("ids", "amounts", "goal", "most").alias("chance"))
    return found.select("c", F.round("chance", 6).alias("chance"), (F.col("chance") < subsets.CHANCE).alias("credible"))


@query(world.sql("""SELECT g.c, min(abs(l.s + r.s - g.goal - 777777)) AS gap FROM goal g JOIN part_sums l ON l.c = g.c AND NOT l.late
  JOIN part_sums r ON r.c = g.c AND r.late WHERE l.size + r.size > 0 GROUP BY g.c""", HALVES))  # fmt: skip
def closest_sums(spark, sf_dir):
    """The nearest sum; the larger and the smaller half of a pool give three items each, so six in all."""
    found = pools(spark, sf_dir).where("ids IS NOT NULL").select("c", matching.nearest("ids", "amounts", F.col("goal") + 777777).alias("s"))
    return found.select("c", F.abs("s.gap").alias("gap"))


@query(world.sql("""WITH near AS (SELECT utr IS NULL AS bare, settled_on AS day FROM setl UNION ALL SELECT utr IS NULL, settled_on + 1 FROM setl),
  sized AS (SELECT day, count(*) AS n, count(*) FILTER (bare) AS b FROM near GROUP BY day), chosen AS (SELECT day, CASE WHEN b >= 2 THEN b ELSE n END
    AS size FROM sized)
  SELECT day AS value_date, CAST(size AS INTEGER) AS pool_size, CAST(CASE WHEN size <= 100 THEN size ELSE 0 END AS INTEGER) AS listed FROM chosen
    WHERE size >= 2""").replace("\nWITH near", ",\nnear"))  # fmt: skip
def payout_pools(spark, sf_dir):
    """What a day's credit may be a sum of; pools too large for pairs are counted only."""
    out = matching.day_pools(world.load(spark, sf_dir).settlements)
    return out.select("value_date", "pool_size", F.size(F.coalesce("pool", F.array().cast("array<struct<id:string,amount:bigint>>"))).alias("listed"))


# --- an investigator's tools -----------------------------------------------------------------------------------------
@query(
    world.sql(
        "SELECT b.line_id, b.amount, b.value_date, b.narration, coalesce(string_agg(c.t, ',' ORDER BY c.score DESC, c.t, c.i), '') AS tokens FROM bank b LEFT JOIN cand c ON c.line_id = b.line_id AND c.shape IS NOT NULL GROUP BY b.line_id, b.amount, b.value_date, b.narration",
        TOKEN_SQL
    )
)
def credit_details(spark, sf_dir):
    return adjudicate.get_credit(world.load(spark, sf_dir).bank).withColumn("tokens", F.concat_ws(",", "tokens"))


@query(world.sql("""SELECT settlement_id, line_id, strength, carries FROM (SELECT 'setl_' || CAST(k // 10 AS STRING) AS settlement_id, 'bank_' ||
  lpad(CAST(k AS STRING), 10, '0') AS line_id,
    CASE WHEN score >= 0.95 THEN 'decisive' WHEN score >= 0.75 THEN 'strong' WHEN score > 0 THEN 'weak' ELSE 'none' END AS strength, score >= 0.75 AS carries,
    row_number() OVER (PARTITION BY k // 10 ORDER BY score DESC, k) AS n FROM weighed) WHERE n <= 8""", WEIGHED))  # fmt: skip
def reference_scan(spark, sf_dir):
    w = rel(spark, sf_dir, "SELECT * FROM weighed", WEIGHED)
    scored = w.select(
        F.concat(F.lit("setl_"), F.floor(F.col("k") / 10).cast("string")).alias("settlement_id"), F.format_string("bank_%010d", "k").alias("line_id"),
        "score", F.lit("m").alias("mechanism")
    )
    return adjudicate.scan_references(scored).select("settlement_id", "line_id", "strength", "carries")


@query(world.sql("""SELECT p.line_id, CASE WHEN p.utr IS NULL THEN 'no_reference' WHEN contains(regexp_replace(upper(p.narration), '[^A-Z0-9]', '',
  'g'), p.utr) THEN 'exact_substring' ELSE 'other' END AS how,
  CASE WHEN p.utr IS NOT NULL AND contains(regexp_replace(upper(p.narration), '[^A-Z0-9]', '', 'g'), p.utr) THEN 'decisive' ELSE 'less' END AS
    strength FROM pairs p""", PAIRS))  # fmt: skip
def reference_strength(spark, sf_dir):
    out = adjudicate.score_reference(rel(spark, sf_dir, "SELECT line_id, utr, narration FROM pairs", PAIRS))
    how = F.when(F.col("mechanism").isin("no_reference", "exact_substring"), F.col("mechanism")).otherwise("other")
    return out.select("line_id", how.alias("how"), F.when(F.col("strength") == "decisive", "decisive").otherwise("less").alias("strength"))


@query(world.sql("""SELECT c.settlement_id, n.n AS n_listed, n.n AS n_known, n.gross, n.net, c.expected, c.amount - c.expected AS delta FROM comps c
  JOIN (SELECT settlement_id, count(*) AS n, CAST(sum(gross) AS BIGINT) AS gross, CAST(sum(net) AS BIGINT) AS net FROM paynet GROUP BY settlement_id)
    n USING (settlement_id)""", COMPONENTS))  # fmt: skip
def payout_components(spark, sf_dir):
    return adjudicate.payout_components(world.load(spark, sf_dir)).select("settlement_id", "n_listed", "n_known", "gross", "net", "expected", "delta")


@query(world.sql("""SELECT net, method, gross FROM (SELECT net, method, gross, dense_rank() OVER (PARTITION BY net ORDER BY method) AS m,
  row_number() OVER (PARTITION BY net, method ORDER BY gross) AS g
  FROM priced WHERE gross - fee - CAST(floor((fee * 18 + 50) / 100.0) AS BIGINT) = net) WHERE m <= 5 AND g <= 3""", INVERT_SQL))  # fmt: skip
def fee_inversion_view(spark, sf_dir):
    return adjudicate.invert_fee(rel(spark, sf_dir, "SELECT DISTINCT net FROM paynet WHERE net > 0"), fees.rate_card(spark))


@query(world.sql("""SELECT settlement_id, line_id FROM (SELECT s.settlement_id, l.line_id, row_number() OVER (PARTITION BY s.settlement_id ORDER BY
  abs(date_diff('day', s.settled_on, l.value_date)), l.line_id) AS n
  FROM setl s JOIN bank l ON l.value_date BETWEEN s.settled_on - 2 AND s.settled_on + 2 WHERE s.k % 50 = 0) WHERE n <= 12"""))  # fmt: skip
def credits_nearby(spark, sf_dir):
    """The search's queries are the payouts whose key is divisible by 50, against all lines."""
    asked = rel(spark, sf_dir, "SELECT settlement_id, settled_on FROM setl WHERE k % 50 = 0")
    return adjudicate.credits_near(asked, world.load(spark, sf_dir).bank, 2).select("settlement_id", "line_id")


@query(
    world.sql(
        "SELECT settlement_id, CAST(n AS INTEGER) AS candidates FROM verdicts WHERE verdict NOT IN ('utr_exact', 'utr_in_narration', 'rounding_tolerance', 'split_settlement', 'duplicate_identifier')",
        IDENTIFIED
    )
)
def open_cases(spark, sf_dir):
    b = fixed(spark, sf_dir)
    x = matching.identifier(b.settlements, b.bank, b.bank.where("amount > 0"), b.calendar).exceptions
    return adjudicate.open_cases(x, b.settlements).select("settlement_id", F.size("candidates").alias("candidates"))


@query(world.sql("SELECT settlement_id, line_id, confidence, rationale FROM verdicts", f"""{WEIGHED},
judged AS (SELECT 'setl_' || lpad(CAST(k // 4 AS STRING), 10, '0') AS settlement_id, 'bank_' || lpad(CAST(k AS STRING), 10, '0') AS line_id,
  {_evidence} AS confidence FROM weighed), {_decided}"""))  # fmt: skip
def decide_or_abstain(spark, sf_dir):
    w = rel(spark, sf_dir, "SELECT * FROM weighed", WEIGHED)
    named = w.withColumn("settlement_id", F.format_string("setl_%010d", F.floor(F.col("k") / 4))).withColumn("line_id", F.format_string("bank_%010d", "k"))
    return adjudicate.offline(named).select("settlement_id", "line_id", "confidence", "rationale")


# --- checks, posting -------------------------------------------------------------------------------------------------
NETTED = """netted AS (SELECT 'net_' || CAST(k AS STRING) AS match_id, k, k AS seq FROM sc WHERE sc = 27),
debited AS (SELECT 'deb_' || CAST(k AS STRING) AS match_id, k, k + 1000000000 AS seq, amount AS payout FROM sc WHERE sc = 27)"""


def netted_matches(spark, sf_dir) -> DataFrame:
    """Reversals, every second one without its debit, and payouts that claim a debit line."""
    line = lambda side: F.concat(F.lit("bank_"), F.lpad(F.col("k").cast("string"), 10, "0"), F.lit(f"_{side}"))
    none = F.array().cast("array<string>")
    proof = F.array(evidence("seed", F.lit("seed"), 1.0)).cast(EVIDENCE)
    n = rel(spark, sf_dir, "SELECT * FROM netted", NETTED)
    n = n.select("match_id", "seq", F.when(F.floor(F.col("k") / 30) % 2 == 0, F.array(line("c"))).otherwise(F.array(line("c"), line("d"))).alias("bank_line_ids"), none.alias("settlement_ids"),
                 F.lit("reversal_netted").alias("reason"), F.lit(0).cast("long").alias("bank_total"), F.lit(0).cast("long").alias("expected_total"))
    d = rel(spark, sf_dir, "SELECT * FROM debited", NETTED)
    d = d.select("match_id", "seq", F.array(line("d")).alias("bank_line_ids"), F.array(F.concat(F.lit("setl_"), F.col("k").cast("string"))).alias("settlement_ids"),
                 F.lit("utr_exact").alias("reason"), (-F.col("k") - 500000).alias("bank_total"), F.col("payout").alias("expected_total"))
    return settle(n.unionByName(d)).withColumns({"tier": F.lit("T0"), "confidence": F.lit(0.9), "evidence": proof})


CHECKED = f"""{NETTED}, found AS (SELECT match_id, 'balances' AS invariant FROM netted WHERE k // 30 % 2 = 0
  UNION ALL SELECT match_id, 'balances' FROM debited UNION ALL SELECT match_id, 'credits_only' FROM debited)"""


@query(world.sql("SELECT match_id, invariant FROM found", CHECKED))
def verify_reversals(spark, sf_dir):
    b = fixed(spark, sf_dir)
    return verify.verify(netted_matches(spark, sf_dir), b.settlements, b.bank, b.calendar)[2].select("match_id", "invariant")


@query(world.sql("""SELECT 'bank' AS source, 'bank_' || lpad(CAST(k AS STRING), 10, '0') || '_c' AS subject, CAST(0 AS BIGINT) AS amount, CAST(0 AS
  BIGINT) AS delta FROM netted WHERE k // 30 % 2 = 0
  UNION ALL SELECT 'psp', 'setl_' || CAST(k AS STRING), abs(payout), -(500000 + k) - payout FROM debited""", NETTED))  # fmt: skip
def rejected_matches(spark, sf_dir):
    b = fixed(spark, sf_dir)
    _, rejected, found = verify.verify(netted_matches(spark, sf_dir), b.settlements, b.bank, b.calendar)
    return verify.rejections(rejected, found).select(
        F.col("subject_source").alias("source"), F.get("subject_ids", F.lit(0)).alias("subject"), "amount", "delta"
    )


@query(world.sql("""SELECT (SELECT count(*) FROM netted) + (SELECT count(*) FROM debited) AS proposed, (SELECT count(*) FROM netted WHERE k // 30 % 2
  = 1) AS accepted,
  (SELECT count(DISTINCT match_id) FROM found) AS rejected, (SELECT count(*) FROM found) AS violations, CAST(0 AS BIGINT) AS
    adjudicated_rejections""", CHECKED))  # fmt: skip
def verification_report(spark, sf_dir):
    b = fixed(spark, sf_dir)
    m = netted_matches(spark, sf_dir)
    out = verify.report(m, verify.verify(m, b.settlements, b.bank, b.calendar)[2])
    return out.select(*(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in out.columns))


@query(world.sql("""SELECT line_id AS match_id, CASE k % 7 WHEN 0 THEN 'reversal' WHEN 1 THEN 'no payouts' ELSE 'no known payments' END AS why
  FROM (SELECT line_id, CAST(substr(line_id, 6, 10) AS BIGINT) AS k FROM pairs) WHERE k % 7 < 3""", PAIRS))  # fmt: skip
def unposted(spark, sf_dir):
    m = rel(spark, sf_dir, "SELECT line_id AS match_id, settlement_id, CAST(substr(line_id, 6, 10) AS BIGINT) % 7 AS r FROM pairs", PAIRS)
    ids = F.when(F.col("r") == 1, F.array().cast("array<string>")).when(F.col("r") == 2, F.array(F.lit("setl_nowhere"))).otherwise(F.array("settlement_id"))
    m = m.select("match_id", ids.alias("settlement_ids"), F.when(F.col("r") == 0, "reversal_netted").otherwise("utr_exact").alias("reason"))
    return journal.skipped(m, world.load(spark, sf_dir))


@query(
    world.sql(
        "SELECT 'je_' || substr(sha256(line_id), 1, 12) AS entry_id, CAST(sum(CASE WHEN debit THEN amount ELSE 0 END) AS BIGINT) AS amount, count(*) AS n_lines FROM jl WHERE amount <> 0 GROUP BY line_id",
        POSTED
    )
)
def journal_entries(spark, sf_dir):
    return journal.entries(posted(spark, sf_dir)).select("entry_id", "amount", "n_lines")


@query(
    world.sql(
        "SELECT line_id AS match_id, -CAST(amount AS BIGINT) AS off FROM jl WHERE account = '5300' AND amount <> 0 AND CAST(substr(line_id, 6, 10) AS BIGINT) % 20 = 0",
        POSTED
    )
)
def unbalanced_entries(spark, sf_dir):
    """Entries that lost their fee line."""
    lines = posted(spark, sf_dir)
    lost = (F.col("account") == "5300") & (F.substring("match_id", 6, 10).cast("long") % 20 == 0)
    return journal.unbalanced(lines.where(~lost)).select("match_id", "off")


@query(world.sql("""SELECT entry_id FROM (SELECT 'je_' || substr(sha256(jl.line_id), 1, 12) AS entry_id, row_number() OVER (ORDER BY p.settled_on,
  'je_' || substr(sha256(jl.line_id), 1, 12)) AS n
  FROM (SELECT DISTINCT line_id FROM jl WHERE amount <> 0) jl JOIN pairs p ON p.line_id = jl.line_id) WHERE n <= 40""", POSTED))  # fmt: skip
def journal_page(spark, sf_dir):
    return report.journal_page(journal.entries(posted(spark, sf_dir))).select("entry_id")


@query(world.sql("""SELECT p.line_id AS match_id, string_agg(DISTINCT y.payment_id, ',' ORDER BY y.payment_id) AS payment_ids,
  coalesce(string_agg(DISTINCT l.entry_id, ',' ORDER BY l.entry_id), '') AS ledger_entry_ids
  FROM pairs p JOIN pay y ON y.settlement_id = p.settlement_id LEFT JOIN led l ON l.order_id = y.order_id GROUP BY p.line_id""", PAIRS))  # fmt: skip
def match_members(spark, sf_dir):
    from ..operators import audits

    b = world.load(spark, sf_dir)
    m = rel(spark, sf_dir, "SELECT line_id AS match_id, settlement_id FROM pairs", PAIRS).select("match_id", F.array("settlement_id").alias("settlement_ids"))
    out = with_members(m, audits.payments_of(b.settlements, b.payments), audits.ledger_of(b.settlements, b.payments, b.ledger))
    return out.select("match_id", F.concat_ws(",", "payment_ids").alias("payment_ids"), F.concat_ws(",", "ledger_entry_ids").alias("ledger_entry_ids"))


# --- report views ----------------------------------------------------------------------------------------------------
@query(world.sql("SELECT severity, count(*) AS n, CAST(sum(amount) AS BIGINT) AS value FROM found GROUP BY severity", AUDITED))
def severity_counts(spark, sf_dir):
    return report.severity_counts(audited(spark, sf_dir))


@query(world.sql("SELECT reason, count(*) AS n FROM found GROUP BY reason", AUDITED))
def reason_counts(spark, sf_dir):
    return report.reason_counts(audited(spark, sf_dir))


@query(
    world.sql(
        "SELECT tier, count(*) AS n, CAST(sum(amount) AS BIGINT) AS value FROM (SELECT CASE WHEN amount = payout THEN 'T0' ELSE 'T3' END AS tier, amount FROM pairs) GROUP BY tier",
        PAIRS
    )
)
def tier_counts(spark, sf_dir):
    m = rel(spark, sf_dir, "SELECT CASE WHEN amount = payout THEN 'T0' ELSE 'T3' END AS tier, amount AS bank_total FROM pairs", PAIRS)
    return report.tier_counts(m)


@query(
    world.sql(
        "SELECT (SELECT CAST(sum(amount) AS BIGINT) FROM pairs) AS value_matched, (SELECT CAST(sum(amount) AS BIGINT) FROM found WHERE severity IN ('critical', 'high')) AS value_at_risk",
        AUDITED, PAIRS
    )
)
def matched_and_at_risk(spark, sf_dir):
    return report.values(rel(spark, sf_dir, "SELECT amount AS bank_total FROM pairs", PAIRS), audited(spark, sf_dir))


@query(
    world.sql(
        "SELECT severity, count(*) AS n, CAST(sum(amount) AS BIGINT) AS value FROM found WHERE reason = 'fee_schedule_deviation' AND contains(subject, 'pay_1') GROUP BY severity",
        AUDITED
    )
)
def filtered_facts(spark, sf_dir):
    return report.page_facts(audited(spark, sf_dir), reason="fee_schedule_deviation", text="PAY_1")


@query(world.sql("SELECT count(*) AS total, count(*) > 80 AS has_more FROM found WHERE rank <= 1", AUDITED))
def page_info(spark, sf_dir):
    return report.page_info(audited(spark, sf_dir), limit=60, offset=20, severity="high")


@query(world.sql("SELECT subject AS subjects, severity, subject AS related, 1 AS n FROM found", AUDITED))
def exception_detail(spark, sf_dir):
    b, x = world.load(spark, sf_dir), audited(spark, sf_dir)
    out = report.exception_detail(x, b.settlements, b.bank, b.payments)
    return out.select(
        F.concat_ws(",", "subject_ids").alias("subjects"), "severity",
        F.concat_ws(",", F.transform("related", lambda r: r["record_id"])).alias("related"), F.size("related").alias("n")
    )


@query(
    world.sql(
        "SELECT match_id FROM (SELECT line_id AS match_id, row_number() OVER (ORDER BY line_id) AS n FROM pairs WHERE amount = payout) WHERE n <= 500",
        PAIRS
    )
)
def match_page(spark, sf_dir):
    """At most 500, whatever is asked for."""
    m = rel(spark, sf_dir, "SELECT line_id AS match_id, CASE WHEN amount = payout THEN 'T0' ELSE 'T3' END AS tier FROM pairs", PAIRS)
    return report.match_page(m, tier="T0", limit=9999).select("match_id")


@query(
    world.sql(
        "SELECT line_id, CAST(sum(amount) OVER (PARTITION BY length(narration) ORDER BY value_date, line_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM bank"
    )
)
def running_balance(spark, sf_dir):
    bank = world.load(spark, sf_dir).bank.withColumn("account", F.length("narration"))
    return generator.running_balance(bank).select("line_id", "balance")


# --- scores ----------------------------------------------------------------------------------------------------------
GRADED = """graded AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'exception' ELSE 'ignore' END AS disposition,
  o_orderkey // 3 AS j FROM orders),
verdicts AS (SELECT 'case_' || CAST(k AS STRING) AS case_id, CASE disposition
  WHEN 'match' THEN CASE j % 4 WHEN 0 THEN 'correct_match' WHEN 1 THEN 'wrong_match' ELSE 'missed_match' END
  WHEN 'exception' THEN CASE WHEN j % 2 = 0 THEN 'correct_exception' WHEN j % 7 = 0 THEN 'exception_wrong_reason' WHEN j % 5 = 0 THEN 'false_match'
    ELSE 'missed_exception' END
  ELSE CASE WHEN j % 2 = 0 THEN 'false_break' ELSE 'correct_ignore' END END AS verdict FROM graded)"""


@query(world.sql("SELECT case_id, verdict FROM verdicts", GRADED))
def case_verdicts(spark, sf_dir):
    """Every way a case can end, from made-up truth, matches and exceptions."""
    g = rel(spark, sf_dir, "SELECT * FROM graded", GRADED.replace("//", "DIV"))
    own = lambda p: F.concat(F.lit(p), F.col("k").cast("string"))
    none = F.array().cast("array<string>")
    truth = g.select(own("case_").alias("case_id"), F.lit("s").alias("scenario"), F.lit("d").alias("difficulty"), "disposition", F.lit("amount_mismatch").alias("expected_reason"),
                     F.array(own("s_")).alias("settlement_ids"), F.array(own("b_")).alias("bank_line_ids"), none.alias("payment_ids"), none.alias("record_ids"))
    hit = ((F.col("disposition") == "match") & (F.col("j") % 4 < 2)) | ((F.col("disposition") == "exception") & (F.col("j") % 5 == 0))
    wrong = (F.col("disposition") == "match") & (F.col("j") % 4 == 1)
    matches = g.where(hit).select(own("m_").alias("match_id"), F.col("k").alias("seq"), F.array(own("s_")).alias("settlement_ids"),
                                  F.when(wrong, F.array(own("x_"))).otherwise(F.array(own("b_"))).alias("bank_line_ids"), F.lit("utr_exact").alias("reason"))
    even = F.col("j") % 2 == 0
    x = lambda rows, reason, subjects, candidates: as_exceptions(
        rows, "psp", reason, subjects, F.lit(1), F.lit("2026-01-01"), F.lit(""), candidates=candidates
    )
    expected = x(g.where((F.col("disposition") == "exception") & even), "amount_mismatch", F.array(own("s_")), none)
    other = x(g.where((F.col("disposition") == "exception") & (F.col("j") % 7 == 0)), "fx_unverified", F.array(own("z_")), F.array(own("b_")))
    broken = x(g.where((F.col("disposition") == "ignore") & even), "fx_unverified", F.array(own("b_")), none)
    return scorecard.score_cases(truth, matches, expected.unionByName(other).unionByName(broken)).select("case_id", "verdict")
