"""The registered queries over the settlement world, each with the SQL that DuckDB runs on the same tables.

Inputs are the shared common tables of sources.world; the operators run in Spark's DataFrame functions, the SQL says
the same in its own words.  Queries without SQL are compared with brute force in tests.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import fees, money, narration
from ..operators import adjudicate, audits, joins, journal, matching, report, scorecard, subsets, verify
from ..operators.records import Config
from ..sources import files, generator, world
from . import cascade

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def rel(spark: SparkSession, sf_dir: str, select: str, *more: str) -> DataFrame:
    return world.relation(spark, sf_dir, select, *(text.replace(PAIRS, PAIRED) for text in more))


def fixed(spark: SparkSession, sf_dir: str) -> world.Batch:
    """The world with its most used tables checkpointed: passes read them many times, and the world is a long query.
    Passes and checks don't ask what a payout is made of, so its lists are left out."""
    b = world.load(spark, sf_dir)
    s = b.settlements.select("settlement_id", "utr", "amount", "settled_on")
    return replace(b, settlements=matching.settle(s), bank=matching.settle(b.bank), calendar=matching.settle(b.calendar))


def flat(exceptions: DataFrame) -> DataFrame:
    """Exceptions without nested columns or prose."""
    return exceptions.select(
        "exception_id", "reason", F.concat_ws(",", "subject_ids").alias("subjects"), "amount", "as_of",
        F.concat_ws(",", "candidates").alias("candidates"), F.col("delta")
    )


def exception_sql(reason: str, subject: str, amount: str, as_of: str, delta: str = "CAST(NULL AS BIGINT)", candidates: str = "''") -> str:
    return f"'x_' || substr(sha256({reason} || '|' || {subject}), 1, 12) AS exception_id, {reason} AS reason, {subject} AS subjects, CAST({amount} AS BIGINT) AS amount, {as_of} AS as_of, {candidates} AS candidates, CAST({delta} AS BIGINT) AS delta"


# --- money -----------------------------------------------------------------------------------------------------------
AMOUNTS = """amounts AS (
  SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders),
parts AS (SELECT k, p, CAST(CAST(floor(p / 100.0) AS BIGINT) AS STRING) AS r, lpad(CAST(p % 100 AS STRING), 2, '0') AS c FROM amounts),
texts AS (
  SELECT k, CASE k % 14 WHEN 12 THEN NULL WHEN 13 THEN NULL WHEN 1 THEN -p WHEN 2 THEN -p WHEN 6 THEN -p WHEN 8 THEN p - p % 100 ELSE p END AS expected,
    CASE k % 14 WHEN 0 THEN r || '.' || c WHEN 1 THEN '(' || r || '.' || c || ')' WHEN 2 THEN r || '.' || c || ' DR' WHEN 3 THEN 'Rs. ' || r || '.' || c
      WHEN 4 THEN 'INR' || r || ',' || c WHEN 5 THEN r || '.' || c || ' cr' WHEN 6 THEN r || '.' || c || '-' WHEN 7 THEN '+' || r || '.' || c WHEN 8 THEN r
      WHEN 9 THEN CASE WHEN length(r) > 3 THEN substr(r, 1, length(r) - 3) || ',' || substr(r, length(r) - 2, 3) ELSE r END || '.' || c
      WHEN 10 THEN '₹' || CASE WHEN length(r) > 3 THEN substr(r, 1, length(r) - 3) || '.' || substr(r, length(r) - 2, 3) ELSE r END || ',' || c
      WHEN 11 THEN r || ' ' || '.' || c WHEN 12 THEN '1,2E+' || c ELSE 'N/A' END AS raw
  FROM parts)"""


@query(world.sql("SELECT k, raw, expected AS paise FROM texts", AMOUNTS))
def money_parse(spark, sf_dir):
    return rel(spark, sf_dir, "SELECT k, raw FROM texts", AMOUNTS).withColumn("paise", money.parse_money(F.col("raw")))


@query(world.sql("""SELECT k, p, CASE WHEN p % 7 = 0 AND p > 0 THEN '-' ELSE '' END || '₹' || CASE
    WHEN length(r) > 7 THEN substr(r, 1, length(r) - 7) || ',' || substr(r, length(r) - 6, 2) || ',' || substr(r, length(r) - 4, 2) || ',' ||
      substr(r, length(r) - 2, 3)
    WHEN length(r) > 5 THEN substr(r, 1, length(r) - 5) || ',' || substr(r, length(r) - 4, 2) || ',' || substr(r, length(r) - 2, 3)
    WHEN length(r) > 3 THEN substr(r, 1, length(r) - 3) || ',' || substr(r, length(r) - 2, 3) ELSE r END || '.' || c AS shown,
    CAST(p / 100.0 AS DECIMAL(20,2)) AS rupees FROM parts""", AMOUNTS))  # fmt: skip
def money_format(spark, sf_dir):
    df = rel(spark, sf_dir, "SELECT k, p FROM parts", AMOUNTS)
    return df.select(
        "k", "p", money.format_inr(F.when(F.col("p") % 7 == 0, -F.col("p")).otherwise(F.col("p"))).alias("shown"),
        money.paise_to_rupees(F.col("p")).alias("rupees")
    )


PAIRS = """pairs AS (
  SELECT s.settlement_id, l.line_id, s.amount AS payout, l.amount, s.settled_on, l.value_date, s.utr, l.narration
  FROM setl s JOIN line1 l ON l.line_id = 'bank_' || lpad(CAST(s.k AS STRING), 10, '0') || '_1')"""

#: The same for Spark: a payout's line is made of the payout, so neither is looked up.
PAIRED = f"""pairs AS (SELECT settlement_id, line.line_id, payout, line.amount, settled_on, line.value_date, utr, line.narration
  FROM (SELECT settlement_id, amount AS payout, settled_on, utr, {world.LINE1} AS line FROM sc) WHERE line IS NOT NULL)"""


@query(world.sql("""SELECT line_id, abs(greatest(abs(amount), abs(payout)) - 100 * least(abs(amount), abs(payout))) < 100 AND amount <> 0 AND payout
  <> 0 AS scale_error,
    amount <> payout AND sign(amount) * sign(payout) > 0 AND (abs(amount) - abs(payout)) % 9 = 0
      AND list_sort(string_split(CAST(abs(amount) AS VARCHAR), '')) = list_sort(string_split(CAST(abs(payout) AS VARCHAR), '')) AS transposition FROM
      pairs""", PAIRS))  # fmt: skip
def amount_suspicions(spark, sf_dir):
    a, b = F.col("amount"), F.col("payout")
    return rel(spark, sf_dir, "SELECT * FROM pairs", PAIRS).select(
        "line_id", money.is_scale_error(a, b).alias("scale_error"), money.is_transposition(a, b).alias("transposition")
    )


# --- dates -----------------------------------------------------------------------------------------------------------
DATES = """dated AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
fields AS (SELECT k, d, CAST(year(d) AS STRING) AS y, CAST(month(d) AS STRING) AS m, CAST(day(d) AS STRING) AS dd, lpad(CAST(month(d) AS STRING), 2,
  '0') AS m2, lpad(CAST(day(d) AS STRING), 2, '0') AS d2,
  CASE month(d) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May' WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8
    THEN 'Aug' WHEN 9 THEN 'Sep' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'Dec' END AS mon FROM dated),
shown AS (SELECT k, CASE WHEN k % 9 = 8 THEN NULL WHEN k % 9 = 7 THEN d + 1 ELSE d END AS expected, CASE k % 9 WHEN 0 THEN y || '-' || m2 || '-' ||
  d2 WHEN 1 THEN d2 || '/' || m2 || '/' || y WHEN 2 THEN dd || '-' || m || '-' || y
  WHEN 3 THEN d2 || '-' || mon || '-' || y WHEN 4 THEN dd || ' ' || mon || ' ' || y WHEN 5 THEN mon || ' ' || dd || ', ' || y WHEN 6 THEN y || '-' ||
    m2 || '-' || d2 || 'T12:30:00+05:30'
  WHEN 7 THEN y || '-' || m2 || '-' || d2 || 'T18:30:00Z' ELSE 'soon' END AS raw FROM fields)"""


@query(world.sql("SELECT k, raw, expected AS day FROM shown", DATES))
def date_parse(spark, sf_dir):
    return rel(spark, sf_dir, "SELECT k, raw FROM shown", DATES).withColumn("day", D.business_date(D.parse_datetime(F.col("raw"))))


@query(
    world.sql(
        "SELECT d.k, d.d AS start, b.bday AS due FROM dated d JOIN cal c ON c.day = d.d JOIN bday b ON b.bord = c.ord + CASE WHEN d.k % 4 = 0 THEN 1 - c.banking ELSE d.k % 4 END",
        DATES
    )
)
def banking_day_add(spark, sf_dir):
    cal = world.load(spark, sf_dir).calendar
    df = rel(spark, sf_dir, "SELECT k, d AS start, k % 4 AS n FROM dated", DATES)
    return D.add_banking_days(df, "start", F.col("n"), "due", cal).select("k", "start", "due")


@query(
    world.sql(
        "SELECT p.line_id, CAST(b.ord - a.ord AS BIGINT) AS n, CAST(a.ord - b.ord AS BIGINT) AS back FROM pairs p JOIN cal a ON a.day = p.settled_on JOIN cal b ON b.day = p.value_date",
        PAIRS
    )
)
def banking_days_between(spark, sf_dir):
    cal = world.load(spark, sf_dir).calendar
    df = D.banking_days_between(rel(spark, sf_dir, "SELECT * FROM pairs", PAIRS), "settled_on", "value_date", "n", cal)
    return D.banking_days_between(df, "value_date", "settled_on", "back", cal).select("line_id", "n", "back")


@query(
    world.sql(
        "SELECT d.k, t.bday AS target, e.bday AS earliest, l.bday AS latest FROM dated d JOIN cal c ON c.day = d.d JOIN bday t ON t.bord = c.ord + 2 JOIN bday e ON e.bord = c.ord + 1 JOIN bday l ON l.bord = c.ord + 3",
        DATES
    )
)
def settlement_window(spark, sf_dir):
    df = rel(spark, sf_dir, "SELECT k, d FROM dated", DATES)
    return D.settlement_window(df, "d", world.load(spark, sf_dir).calendar).select("k", "target", "earliest", "latest")


# --- narrations ------------------------------------------------------------------------------------------------------
_shape = lambda values: "CASE " + " ".join(
    f"WHEN regexp_matches(t, '{p}') THEN {v}" for (p, _, _), v in zip(narration.SHAPES, values, strict=True)
) + " END"
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
TOKEN_SQL = f"""words AS (SELECT line_id, list_filter(regexp_split_to_array(upper(narration), '[^A-Z0-9]+'), lambda x: x <> '') AS w FROM bank),
toks AS (SELECT line_id, w[i + 1] AS t, i, coalesce(w[i], '') AS prev FROM words, unnest(range(0, len(w))) AS r(i)),
cand AS (SELECT line_id, t, i, {_shape([f"'{n}'" for _, n, _ in narration.SHAPES])} AS shape,
  round(least(1.0, CAST({_shape([s for _, _, s in narration.SHAPES])} AS DOUBLE) + CASE WHEN prev IN ({_quoted(narration.RAIL_WORDS)}) THEN 0.10 ELSE
    0 END - least(i, 8) * 0.015), 4) AS score
  FROM toks WHERE regexp_matches(t, '[0-9]') AND t NOT IN ({_quoted(narration.STOPWORDS)}))"""


@query(world.sql("SELECT line_id, t AS token, shape, score, CAST(i AS INTEGER) AS position FROM cand WHERE shape IS NOT NULL", TOKEN_SQL))
def narration_tokens(spark, sf_dir):
    df = rel(spark, sf_dir, "SELECT line_id, narration FROM bank").select("line_id", F.explode(narration.candidates(F.col("narration"))).alias("c"))
    return df.select("line_id", "c.token", "c.shape", "c.score", "c.position")


@query(
    world.sql(
        "SELECT line_id, regexp_replace(upper(narration), '[^A-Z0-9]', '', 'g') AS flat, contains(upper(narration), 'ACME') OR contains(upper(narration), 'CASH') AS named FROM bank"
    )
)
def normalize_ref(spark, sf_dir):
    df = rel(spark, sf_dir, "SELECT line_id, narration FROM bank")
    return df.select(
        "line_id", narration.normalize_ref(F.col("narration")).alias("flat"),
        narration.mentions_any(F.col("narration"), F.array(F.lit("Acme"), F.lit("cash"))).alias("named")
    )


@query(world.sql("""SELECT p.line_id, CASE WHEN p.utr IS NULL THEN 0.0 WHEN contains(regexp_replace(upper(p.narration), '[^A-Z0-9]', '', 'g'), p.utr) THEN 1.0
    ELSE coalesce(max(CASE WHEN length(c.t) >= 8 AND starts_with(p.utr, c.t) THEN round(0.70 + 0.02 * least(length(c.t) - 8, 8), 4)
      WHEN abs(length(c.t) - length(p.utr)) <= 2 AND length(c.t) >= 10 THEN CASE damerau_levenshtein(c.t, p.utr) WHEN 1 THEN 0.85 WHEN 2 THEN 0.65
      END END), 0.0) END AS score
  FROM pairs p LEFT JOIN cand c ON c.line_id = p.line_id AND c.shape IS NOT NULL GROUP BY p.line_id, p.utr, p.narration""", TOKEN_SQL, PAIRS))  # fmt: skip
def ref_score(spark, sf_dir):
    df = rel(spark, sf_dir, "SELECT * FROM pairs", PAIRS)
    return narration.score_matches(df).select("line_id", "score")


# --- fees ------------------------------------------------------------------------------------------------------------
@query(
    world.sql(
        "SELECT 'pay_' || CAST(k AS STRING) || '_' || CAST(seq AS STRING) AS payment_id, base_fee AS expected_fee, CAST(floor((base_fee * 18 + 50) / 100.0) AS BIGINT) AS expected_tax FROM lf"
    )
)
def fee_breakdown(spark, sf_dir):
    return fees.with_fees(world.load(spark, sf_dir).payments, fees.rate_card(spark)).select("payment_id", "expected_fee", "expected_tax")


FEE_OFF = "off AS (SELECT p.payment_id, p.captured_on, p.fee - lf.base_fee AS delta FROM pay p JOIN lf ON lf.k = p.k AND lf.seq = p.seq WHERE abs(p.fee - lf.base_fee) > 1)"


@query(world.sql(f"SELECT {exception_sql(chr(39) + 'fee_schedule_deviation' + chr(39), 'payment_id', 'abs(delta)', 'captured_on', 'delta')} FROM off", FEE_OFF))
def fee_audit(spark, sf_dir):
    return flat(audits.fee_audit(world.load(spark, sf_dir), fees.rate_card(spark)))


@query(world.sql("SELECT CAST(coalesce(sum(greatest(delta, 0)), 0) AS BIGINT) AS fee_overcharge FROM off", FEE_OFF))
def fee_overcharge(spark, sf_dir):
    return audits.fee_overcharge(world.load(spark, sf_dir), fees.rate_card(spark))


CARD_SQL = "card AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS method, {b} AS bps, {t or 'CAST(NULL AS INTEGER)'} AS threshold, {a or 'CAST(NULL AS INTEGER)'} AS above" for m, b, t, a,
    _ in fees.RATE_CARD
) + ")"
INVERT_SQL = f"""{CARD_SQL}, rates AS (SELECT method, bps AS rate FROM card UNION SELECT method, above FROM card WHERE above IS NOT NULL),
netted AS (SELECT DISTINCT net FROM paynet WHERE net > 0),
seeds AS (SELECT net, method, CAST(round(CAST(net AS DECIMAL(30,8)) * 1000000 / (1000000 - 118 * rate)) AS BIGINT) AS seed FROM netted CROSS JOIN rates),
tries AS (SELECT DISTINCT net, method, seed + o - 4 AS gross FROM seeds, unnest(range(0, 9)) AS r(o)),
priced AS (SELECT t.net, t.method, t.gross, CAST(floor((t.gross * CASE WHEN t.gross > c.threshold THEN c.above ELSE c.bps END + 5000) / 10000.0) AS
  BIGINT) AS fee FROM tries t JOIN card c ON c.method = t.method WHERE t.gross >= 1)"""


@query(world.sql("SELECT net, method, gross FROM priced WHERE gross - fee - CAST(floor((fee * 18 + 50) / 100.0) AS BIGINT) = net", INVERT_SQL))
def fee_inversion(spark, sf_dir):
    nets = rel(spark, sf_dir, "SELECT DISTINCT net FROM paynet WHERE net > 0")
    return fees.invert_fees(nets, fees.rate_card(spark)).select("net", "method", "gross")


# --- audits ----------------------------------------------------------------------------------------------------------
COMPONENTS = """comps AS (SELECT s.k, s.settlement_id, s.amount, s.settled_on, n.net - coalesce(r.amount, 0) + coalesce(a.amount, 0) AS expected FROM
  setl s JOIN nets n ON n.k = s.k
  LEFT JOIN rfd r ON r.k = s.k AND r.settlement_id IS NOT NULL LEFT JOIN adj a ON a.k = s.k AND a.settlement_id IS NOT NULL)"""


@query(
    world.sql(
        f"SELECT {
            exception_sql('reason', 'settlement_id', 'abs(delta)', 'settled_on', 'delta')
        } FROM (SELECT *, amount - expected AS delta, CASE WHEN amount < expected THEN 'partial_settlement_open' ELSE 'amount_mismatch' END AS reason FROM comps) WHERE abs(delta) > 5",
        COMPONENTS
    )
)
def component_audit(spark, sf_dir):
    return flat(audits.component_audit(world.load(spark, sf_dir)))


@query(world.sql(f"SELECT {exception_sql(chr(39) + 'fx_unverified' + chr(39), 'payment_id', 'gross', 'captured_on')} FROM pay WHERE international"))
def fx_audit(spark, sf_dir):
    return flat(audits.fx_audit(world.load(spark, sf_dir)))


@query(
    world.sql(
        f"SELECT {
            exception_sql(chr(39) + 'ledger_entry_missing' + chr(39), 'payment_id', 'gross', 'captured_on')
        } FROM pay p WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.order_id = p.order_id)"
    )
)
def ledger_coverage(spark, sf_dir):
    return flat(audits.ledger_coverage(world.load(spark, sf_dir)))


@query(world.sql(f"""SELECT {exception_sql(chr(39) + 'unlinked_refund' + chr(39), 'refund_id', 'amount', 'created_on')} FROM rfd WHERE payment_id NOT IN (SELECT payment_id FROM pay)
  UNION ALL SELECT {exception_sql('reason', 'adjustment_id', 'abs(amount)', 'created_on')} FROM (SELECT *, CASE WHEN kind IN ('chargeback',
    'dispute_fee') THEN 'unlinked_chargeback' ELSE 'unlinked_refund' END AS reason FROM adj)
  WHERE linked_payment_id IS NULL OR linked_payment_id NOT IN (SELECT payment_id FROM pay)"""))  # fmt: skip
def unlinked_deductions(spark, sf_dir):
    return flat(audits.unlinked_deductions(world.load(spark, sf_dir)))


@query(world.sql("SELECT 'setl_' || CAST(p.k AS STRING) AS settlement_id, p.payment_id, l.entry_id FROM pay p JOIN led l ON l.order_id = p.order_id"))
def payout_ledger(spark, sf_dir):
    b = world.load(spark, sf_dir)
    return audits.ledger_of(b.settlements, b.payments, b.ledger)


@query(
    world.sql(
        "SELECT utr, count(*) AS n, string_agg(settlement_id, ',' ORDER BY settlement_id) AS settlement_ids FROM (SELECT settlement_id, CASE WHEN k % 100 = 0 THEN 'SHARED' ELSE utr END AS utr FROM setl) WHERE utr IS NOT NULL GROUP BY utr HAVING count(*) > 1"
    )
)
def duplicate_utrs(spark, sf_dir):
    return audits.duplicate_references(rel(spark, sf_dir, "SELECT settlement_id, CASE WHEN k % 100 = 0 THEN 'sha-red' ELSE utr END AS utr FROM setl"))


# --- joins -----------------------------------------------------------------------------------------------------------
WINDOWED = "win AS (SELECT s.*, s.settled_on - 3 AS lo, b.bday AS hi FROM setl s JOIN bday b ON b.bord = s.settled_ord + 2)"


@query(
    world.sql(
        "SELECT w.settlement_id, count(*) AS n, CAST(sum(l.amount) AS BIGINT) AS amount FROM win w JOIN bank l ON l.value_date BETWEEN w.lo AND w.hi GROUP BY w.settlement_id",
        WINDOWED
    )
)
def window_range_join(spark, sf_dir):
    """Lines are summed by day first, so a payout meets a row a day of its window."""
    s = rel(spark, sf_dir, "SELECT settlement_id, lo, hi FROM win", WINDOWED)
    days = world.load(spark, sf_dir).bank.groupBy("value_date").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return joins.in_window(s, days, "lo", "hi", "value_date").groupBy("settlement_id").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))


@query(world.sql("SELECT s.settlement_id, l.line_id, l.amount - s.amount AS gap FROM setl s JOIN bank l ON l.amount BETWEEN s.amount - 5 AND s.amount + 5"))
def near_amount_join(spark, sf_dir):
    b = world.load(spark, sf_dir)
    s = b.settlements.select("settlement_id", F.col("amount").alias("payout"))
    return joins.near_amount(s, b.bank.select("line_id", "amount"), "payout", "amount", 5).select(
        "settlement_id", "line_id", F.expr("amount - payout").alias("gap")
    )


@query(world.sql("""SELECT settlement_id, line_id, rival_id, gap FROM (SELECT p.settlement_id, p.line_id, r.settlement_id AS rival_id, abs(r.amount -
  p.amount) AS gap,
    row_number() OVER (PARTITION BY p.settlement_id, p.line_id ORDER BY abs(r.amount - p.amount), r.settlement_id) AS n
  FROM pairs p JOIN setl r ON abs(r.amount - p.amount) <= 5000 AND r.settlement_id <> p.settlement_id AND abs(date_diff('day', r.settled_on,
    p.settled_on)) <= 3) WHERE n <= 6""", PAIRS))  # fmt: skip
def contested_credits(spark, sf_dir):
    """Near means 50 rupees here: at 5 paise these tables have hardly a rival."""
    lines = rel(spark, sf_dir, "SELECT settlement_id, line_id, amount FROM pairs", PAIRS)
    return joins.contested(world.load(spark, sf_dir).settlements, lines, days=3, tolerance=5000)


# --- passes ----------------------------------------------------------------------------------------------------------
def flat_matches(m: DataFrame) -> DataFrame:
    return m.select(
        "match_id", F.concat_ws(",", "bank_line_ids").alias("lines"), F.concat_ws(",", "settlement_ids").alias("settlements"), "tier", "reason",
        "confidence", "bank_total", "expected_total"
    )


@query(world.sql("""SELECT 'm_' || substr(sha256('T0|' || c.line_id || '|' || d.line_id || '|'), 1, 12) AS match_id, c.line_id || ',' || d.line_id AS
  lines, '' AS settlements, 'T0' AS tier, 'reversal_netted' AS reason,
  0.99 AS confidence, CAST(0 AS BIGINT) AS bank_total, CAST(0 AS BIGINT) AS expected_total
  FROM reversed c JOIN reversed d ON c.amount = -d.amount AND c.amount > 0 AND c.narration = d.narration"""))  # fmt: skip
def reversals(spark, sf_dir):
    bank = world.load(spark, sf_dir).bank
    return flat_matches(matching.reversals(bank.where("amount > 0"), bank.where("amount <= 0")).matches)


IDENTIFIED = f"""{TOKEN_SQL},
utrs AS (SELECT s.settlement_id, s.utr, s.amount AS payout, s.settled_on, s.settled_ord, s.settled_on - 4 AS lo, b.bday AS hi FROM setl s JOIN bday b
  ON b.bord = s.settled_ord + 5 WHERE utr IS NOT NULL),
flats AS (SELECT line_id, value_date, amount, regexp_replace(upper(narration), '[^A-Z0-9]', '', 'g') AS flat FROM bank),
near AS (
  SELECT DISTINCT u.settlement_id, c.line_id FROM utrs u JOIN cand c ON c.shape IS NOT NULL AND length(c.t) >= 8 AND left(c.t, 8) = left(u.utr, 8)
  UNION SELECT u.settlement_id, l.line_id FROM utrs u JOIN flats l ON l.value_date BETWEEN u.lo AND u.hi AND contains(l.flat, u.utr)),
fit AS (
  SELECT u.settlement_id, l.line_id, u.payout, l.amount, u.settled_ord, v.ord AS value_ord, CASE WHEN contains(l.flat, u.utr) THEN 1.0
    WHEN length(c.t) >= 8 AND starts_with(u.utr, c.t) THEN round(0.70 + 0.02 * least(length(c.t) - 8, 8), 4)
    WHEN abs(length(c.t) - length(u.utr)) <= 2 AND length(c.t) >= 10 THEN CASE damerau_levenshtein(c.t, u.utr) WHEN 1 THEN 0.85 WHEN 2 THEN 0.65 ELSE
      0.0 END ELSE 0.0 END AS score
  FROM near n JOIN utrs u USING (settlement_id) JOIN flats l USING (line_id) JOIN cal v ON v.day = l.value_date LEFT JOIN cand c ON c.line_id =
    n.line_id AND c.shape IS NOT NULL
  WHERE l.amount > 0),
fits AS (SELECT settlement_id, line_id, payout, amount, settled_ord, value_ord, max(score) AS score FROM fit GROUP BY ALL),
sums AS (SELECT settlement_id, string_agg(line_id, ',' ORDER BY line_id) AS lines, count(*) AS n, any_value(payout) AS payout, CAST(sum(amount) AS
  BIGINT) AS total, bool_and(amount = payout) AS same, max(score) AS score,
  max(value_ord - settled_ord) AS late, CASE WHEN max(score) = 1.0 THEN 'exact' ELSE 'part' END AS how FROM fits WHERE score >= 0.6 GROUP BY settlement_id),
verdicts AS (SELECT *, CASE WHEN n > 1 THEN CASE WHEN abs(total - payout) <= 5 THEN 'split_settlement' WHEN same THEN 'duplicate_identifier' ELSE
  'ambiguous_candidates' END
  WHEN late > 5 THEN 'date_out_of_window' WHEN total = payout THEN CASE how WHEN 'exact' THEN 'utr_exact' ELSE 'utr_in_narration' END WHEN abs(total
    - payout) <= 5 THEN 'rounding_tolerance' ELSE 'off' END AS verdict FROM sums)"""


@query(world.sql("""SELECT settlement_id AS settlements, lines, verdict AS reason, CASE verdict WHEN 'utr_exact' THEN 'T0' WHEN 'utr_in_narration'
  THEN 'T1' WHEN 'rounding_tolerance' THEN 'T3' ELSE 'T5' END AS tier,
    round(CASE verdict WHEN 'rounding_tolerance' THEN least(score, 0.95) WHEN 'split_settlement' THEN 0.93 ELSE score END, 4) AS confidence, total AS
      bank_total, payout AS expected_total
  FROM verdicts WHERE verdict IN ('utr_exact', 'utr_in_narration', 'rounding_tolerance', 'split_settlement')""", IDENTIFIED))  # fmt: skip
def identifier_match(spark, sf_dir):
    b = fixed(spark, sf_dir)
    out = matching.identifier(b.settlements, b.bank, b.bank.where("amount > 0"), b.calendar)
    return flat_matches(out.matches).select("settlements", "lines", "reason", "tier", "confidence", "bank_total", "expected_total")


@query(
    world.sql(
        "SELECT settlement_id AS settlements, lines, payout, CASE WHEN verdict = 'date_out_of_window' THEN late ELSE total - payout END AS delta, verdict IN ('date_out_of_window', 'duplicate_identifier', 'ambiguous_candidates') AS not_amount FROM verdicts WHERE verdict NOT IN ('utr_exact', 'utr_in_narration', 'rounding_tolerance', 'split_settlement')",
        IDENTIFIED
    )
)
def identifier_breaks(spark, sf_dir):
    b = fixed(spark, sf_dir)
    pairs = matching.identifier_pairs(b.settlements, b.bank, b.bank.where("amount > 0"), b.calendar, Config())
    d = matching.decide_identifier(pairs, Config()).where("verdict not in ('utr_exact', 'utr_in_narration', 'rounding_tolerance', 'split_settlement')")
    rows = d.groupBy("settlement_id", "verdict").agg(
        F.concat_ws(",", F.array_sort(F.collect_list("shown"))).alias("lines"), F.first("payout").alias("payout"), F.first("gap").alias("gap"),
        F.max("late").alias("late")
    )
    return rows.select(
        F.col("settlement_id").alias("settlements"), "lines", "payout",
        F.when(F.col("verdict") == "date_out_of_window", F.col("late")).otherwise(F.col("gap")).alias("delta"),
        F.col("verdict").isin("date_out_of_window", "duplicate_identifier", "ambiguous_candidates").alias("not_amount")
    )


NEAR = f"""{WINDOWED},
hits AS (SELECT b.settlement_id, l.line_id, b.amount, l.amount AS got FROM win b JOIN bank l ON l.amount BETWEEN b.amount - 5 AND b.amount + 5 AND
  l.value_date BETWEEN b.lo AND b.hi WHERE l.amount > 0)"""
# Payouts of an amount in order of id: one with a credit left in its window and no rival left is a match if the credit is alone,
# and waits if there are several; with rivals, they and the window's credits leave together.  Payouts of one day have one turn.
TURNS = f"""{WINDOWED},
day_pay AS (SELECT amount, settled_on AS day, min(settlement_id) AS first, count(*) AS n, min(lo) AS lo, min(hi) AS hi FROM win GROUP BY amount, settled_on),
day_line AS (SELECT amount, value_date AS day, count(*) AS n FROM bank WHERE amount > 0 GROUP BY amount, value_date),
turn AS (SELECT *, row_number() OVER (PARTITION BY amount ORDER BY first) AS i FROM day_pay),
start AS (SELECT amount, payouts, lines FROM (SELECT amount, list({{'day': day, 'n': n}}) AS payouts FROM day_pay GROUP BY amount)
  JOIN (SELECT amount, list({{'day': day, 'n': n}}) AS lines FROM day_line GROUP BY amount) USING (amount))"""
WALK = """WITH RECURSIVE walk AS (
  SELECT amount, CAST(0 AS BIGINT) AS i, payouts, lines, CAST(NULL AS VARCHAR) AS matched, CAST(NULL AS DATE) AS day FROM start
  UNION ALL SELECT amount, i, CASE WHEN goes THEN list_filter(payouts, lambda x: NOT (x.day BETWEEN lo - 2 AND hi + 2)) ELSE payouts END,
    CASE WHEN goes THEN list_filter(lines, lambda x: NOT (x.day BETWEEN lo AND hi)) ELSE lines END, CASE WHEN goes AND rivals = 1 THEN first END, mine[1].day
  FROM (SELECT *, here AND found > 0 AND (rivals > 1 OR found = 1) AS goes FROM (
    SELECT *, coalesce(list_sum(list_transform(mine, lambda x: x.n)), 0) AS found FROM (
      SELECT w.amount, t.i, w.payouts, w.lines, t.lo, t.hi, t.first, list_contains(list_transform(w.payouts, lambda x: x.day), t.day) AS here,
        list_filter(w.lines, lambda x: x.day BETWEEN t.lo AND t.hi) AS mine,
        coalesce(list_sum(list_transform(list_filter(w.payouts, lambda x: x.day BETWEEN t.lo - 2 AND t.hi + 2), lambda x: x.n)), 0) AS rivals
      FROM walk w JOIN turn t ON t.amount = w.amount AND t.i = w.i + 1))))"""


@query(
    world.sql(
        f"SELECT w.matched AS settlements, l.line_id AS lines, w.amount FROM ({WALK} SELECT * FROM walk WHERE matched IS NOT NULL) w JOIN bank l ON l.amount = w.amount AND l.value_date = w.day",
        TURNS
    )
)
def unique_amount(spark, sf_dir):
    b = fixed(spark, sf_dir)
    out = matching.unique_amount(b.settlements, b.bank.where("amount > 0"), b.calendar).matches
    return flat_matches(out).select("settlements", "lines", F.col("bank_total").alias("amount"))


@query(
    world.sql(
        "SELECT settlement_id AS settlements, min(line_id) AS lines, min(got) AS bank_total FROM hits GROUP BY settlement_id HAVING count(*) = 1",
        NEAR
    )
)
def tolerance_match(spark, sf_dir):
    b = fixed(spark, sf_dir)
    out = matching.tolerance_amount(b.settlements, b.bank.where("amount > 0"), b.calendar).matches
    return flat_matches(out).select("settlements", "lines", "bank_total")


@query()
def batch_decomposition(spark, sf_dir):
    b = fixed(spark, sf_dir)
    rows = matching.decompose(b.settlements, b.bank.where("amount > 0"))
    return rows.select(
        "verdict", "line_id", "amount", "value_date", F.concat_ws(",", F.array_sort("settlements")).alias("settlements"), "total", "pool_size", "most"
    )


@query("""WITH pools AS (SELECT 'customer' AS pool, CAST(o_custkey AS STRING) AS id, count(*) AS n FROM orders GROUP BY o_custkey
  UNION ALL SELECT 'day', CAST(CAST(o_orderdate AS DATE) AS STRING), count(*) FROM orders GROUP BY CAST(o_orderdate AS DATE)),
  c AS (SELECT *, n * (n - 1) / 2.0 AS c2, n * (n - 1) * (n - 2) / 6.0 AS c3, n * (n - 1) * (n - 2) * (n - 3) / 24.0 AS c4,
    CAST(n AS DOUBLE) * (n - 1) * (n - 2) * (n - 3) * (n - 4) / 120.0 AS c5,
    CAST(n AS DOUBLE) * (n - 1) * (n - 2) * (n - 3) * (n - 4) * (n - 5) / 720.0 AS c6 FROM pools)
  SELECT pool, id, n, CAST(CASE WHEN n > 5000 THEN 0 WHEN n < 2 OR c2 > 5000 THEN 1 WHEN n < 3 OR c3 > 5000 THEN 2 WHEN n < 4 OR c4 > 5000 THEN 3
    WHEN n < 5 OR c5 > 5000 THEN 4 WHEN n < 6 OR c6 > 5000 THEN 5 ELSE 6 END AS INTEGER) AS k FROM c""")  # fmt: skip
def cardinality_budget(spark, sf_dir):
    """How many orders of a customer, and of a day, a credible combination may have."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sizes = lambda pool, key: orders.groupBy(key.cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(pool).alias("pool"), "id", "n")
    pools = sizes("customer", F.col("o_custkey")).union(sizes("day", F.col("o_orderdate").cast("date")))
    return pools.select("pool", "id", "n", subsets.cardinality_column(F.col("n")).alias("k"))


WEIGHED = """weighed AS (SELECT o_orderkey AS k, CAST((o_orderkey * 7) % 101 AS DOUBLE) / 100 AS score, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN
  4 WHEN 2 THEN -900 ELSE 70000 END AS delta,
  o_orderkey % 7 - 2 AS late, o_orderkey % 5 = 3 AS scale_error, o_orderkey % 5 = 4 AS transposition, o_orderkey % 3 = 0 AS inverts FROM orders)"""


@query(world.sql("""SELECT k, round(greatest(0.0, least(1.0, CASE WHEN score >= 0.85 THEN score * 0.55 WHEN score >= 0.60 THEN score * 0.28 ELSE 0 END
    + CASE WHEN delta = 0 THEN 0.35 WHEN abs(delta) <= 5 THEN 0.22 WHEN scale_error THEN -0.60 WHEN transposition THEN -0.50 ELSE -0.45 END
    + CASE WHEN late = 0 THEN 0.12 WHEN late BETWEEN 1 AND 3 THEN 0.06 ELSE -0.05 * abs(late) END + CASE WHEN inverts THEN 0.15 ELSE 0 END)), 4) AS
      confidence FROM weighed""", WEIGHED))  # fmt: skip
def offline_adjudicate(spark, sf_dir):
    return rel(spark, sf_dir, "SELECT * FROM weighed", WEIGHED).select("k", adjudicate.evidence_score().alias("confidence"))


LISTED = f"""{WINDOWED}, {TOKEN_SQL},
seen AS (SELECT w.settlement_id, w.utr, w.amount AS payout, w.settled_ord, l.line_id, l.amount, l.value_date, l.narration FROM win w JOIN bank l ON
  l.value_date BETWEEN w.lo AND w.hi WHERE l.amount > 0),
rated AS (SELECT s.settlement_id, s.line_id, s.payout, s.amount, s.settled_ord, s.value_date, CASE WHEN s.utr IS NULL THEN 0.0 WHEN
  contains(regexp_replace(upper(s.narration), '[^A-Z0-9]', '', 'g'), s.utr) THEN 1.0
    ELSE coalesce(max(CASE WHEN length(c.t) >= 8 AND starts_with(s.utr, c.t) THEN round(0.70 + 0.02 * least(length(c.t) - 8, 8), 4)
      WHEN abs(length(c.t) - length(s.utr)) <= 2 AND length(c.t) >= 10 THEN CASE damerau_levenshtein(c.t, s.utr) WHEN 1 THEN 0.85 WHEN 2 THEN 0.65
      END END), 0.0) END AS score
  FROM seen s LEFT JOIN cand c ON c.line_id = s.line_id AND c.shape IS NOT NULL GROUP BY s.settlement_id, s.line_id, s.payout, s.amount,
    s.settled_ord, s.value_date, s.utr, s.narration),
listed AS (SELECT * FROM (SELECT *, amount - payout AS delta, row_number() OVER (PARTITION BY settlement_id ORDER BY score DESC, abs(amount -
  payout), line_id) AS place FROM rated) WHERE place <= 8)"""
_scale = "abs(greatest(abs(amount), abs(payout)) - 100 * least(abs(amount), abs(payout))) < 100 AND amount <> 0 AND payout <> 0"
_turned = "amount <> payout AND sign(amount) * sign(payout) > 0 AND (abs(amount) - abs(payout)) % 9 = 0 AND list_sort(string_split(CAST(abs(amount) AS VARCHAR), '')) = list_sort(string_split(CAST(abs(payout) AS VARCHAR), ''))"
_evidence = """round(greatest(0.0, least(1.0, CASE WHEN score >= 0.85 THEN score * 0.55 WHEN score >= 0.60 THEN score * 0.28 ELSE 0 END
    + CASE WHEN delta = 0 THEN 0.35 WHEN abs(delta) <= 5 THEN 0.22 WHEN scale_error THEN -0.60 WHEN transposition THEN -0.50 ELSE -0.45 END
    + CASE WHEN late = 0 THEN 0.12 WHEN late BETWEEN 1 AND 3 THEN 0.06 ELSE -0.05 * abs(late) END + CASE WHEN inverts THEN 0.15 ELSE 0 END)), 4)"""
_decided = """ranked AS (SELECT *, row_number() OVER (PARTITION BY settlement_id ORDER BY confidence DESC, line_id) AS r, lead(confidence) OVER
  (PARTITION BY settlement_id ORDER BY confidence DESC, line_id) AS next FROM judged),
verdicts AS (SELECT settlement_id, line_id, confidence, CASE WHEN confidence < 0.60 THEN 'evidence too weak' WHEN confidence - next < 0.15 THEN
  'too close to the next' ELSE 'clear' END AS rationale FROM ranked WHERE r = 1)"""
JUDGED = f"""{LISTED},
  {INVERT_SQL.replace("netted AS (SELECT DISTINCT net FROM paynet WHERE net > 0)", "netted AS (SELECT DISTINCT amount AS net FROM listed WHERE abs(delta) > 5)")},
made AS (SELECT DISTINCT net FROM priced WHERE gross - fee - CAST(floor((fee * 18 + 50) / 100.0) AS BIGINT) = net),
facts AS (SELECT l.settlement_id, l.line_id, l.score, l.delta, v.ord - l.settled_ord AS late, {_scale} AS scale_error, {_turned} AS transposition,
  abs(l.delta) > 5 AND m.net IS NOT NULL AS inverts
  FROM listed l JOIN cal v ON v.day = l.value_date LEFT JOIN made m ON m.net = l.amount),
judged AS (SELECT settlement_id, line_id, {_evidence} AS confidence FROM facts), {_decided}"""


@query(
    world.sql(
        "SELECT settlement_id, line_id, confidence, CASE rationale WHEN 'clear' THEN 'match' ELSE 'abstain' END AS decision, rationale FROM verdicts",
        JUDGED
    )
)
def adjudication_decisions(spark, sf_dir):
    b = fixed(spark, sf_dir)
    listed = matching.settle(adjudicate.shortlist(b.settlements, b.bank.where("amount > 0"), b.calendar, fees.rate_card(spark)))
    return adjudicate.offline(listed).select("settlement_id", "line_id", "confidence", "decision", "rationale")


@query(world.sql("SELECT settlement_id, line_id, score, CAST(place AS INTEGER) AS place FROM listed", LISTED))
def shortlist_topk(spark, sf_dir):
    b = fixed(spark, sf_dir)
    return adjudicate.shortlist(b.settlements, b.bank.where("amount > 0"), b.calendar).select("settlement_id", "line_id", "score", "place")


@query(world.sql(f"""SELECT line_id, amount - payout AS delta, CASE WHEN amount > payout THEN 'larger' WHEN amount < payout THEN 'smaller' ELSE
  'identical' END AS side, abs(amount - payout) <= 5 AS within_tolerance,
  {_scale} AS scale_error, {_turned} AS transposition FROM pairs""", PAIRS))  # fmt: skip
def explain_gap(spark, sf_dir):
    return adjudicate.explain_gap(rel(spark, sf_dir, "SELECT * FROM pairs", PAIRS)).select(
        "line_id", "delta", "side", "within_tolerance", "scale_error", "transposition"
    )


# --- checks and posting ----------------------------------------------------------------------------------------------
SEEDED = f"""{PAIRS}, seeded AS (SELECT 'm_' || line_id AS match_id, CAST(row_number() OVER (ORDER BY line_id) AS BIGINT) AS seq, line_id, CASE WHEN
  length(line_id) * 0 + CAST(substr(line_id, 6, 10) AS BIGINT) % 50 = 1 THEN 'setl_nowhere' ELSE settlement_id END AS settlement_id,
  CASE WHEN CAST(substr(line_id, 6, 10) AS BIGINT) % 50 = 2 THEN 1.5 ELSE 0.9 END AS confidence, CASE WHEN CAST(substr(line_id, 6, 10) AS BIGINT) %
    50 = 3 THEN amount + 1 ELSE amount END AS bank_total, payout AS expected_total,
  CASE WHEN CAST(substr(line_id, 6, 10) AS BIGINT) % 50 = 4 THEN 0.0 ELSE 1.0 END AS weight FROM pairs),
claimed AS (SELECT * FROM seeded UNION ALL SELECT match_id || '_again', seq + 1000000000, line_id, settlement_id, confidence, bank_total,
  expected_total, weight FROM seeded WHERE seq % 40 = 0)"""


def seeded_matches(spark, sf_dir) -> DataFrame:
    from ..operators.records import EVIDENCE, evidence

    m = matching.settle(rel(spark, sf_dir, "SELECT * FROM claimed", SEEDED))
    proof = F.array(evidence("seed", F.lit("seed"), F.col("weight"))).cast(EVIDENCE)
    return m.select(
        "match_id", "seq", F.array("line_id").alias("bank_line_ids"), F.array("settlement_id").alias("settlement_ids"), F.lit("T0").alias("tier"),
        F.lit("utr_exact").alias("reason"), F.col("confidence").cast("double").alias("confidence"), "bank_total", "expected_total",
        proof.alias("evidence")
    )


FAILED = f"""{SEEDED}, facts AS (SELECT c.*, p.amount AS line_sum, p.payout AS paid_sum, v.ord - s.ord AS late FROM claimed c LEFT JOIN pairs p ON
  p.line_id = c.line_id LEFT JOIN cal v ON v.day = p.value_date LEFT JOIN cal s ON s.day = p.settled_on),
basic AS (
  SELECT match_id, seq, 'records_exist' AS invariant FROM facts WHERE settlement_id = 'setl_nowhere'
  UNION ALL SELECT match_id, seq, 'has_evidence' FROM facts WHERE weight <= 0 AND settlement_id <> 'setl_nowhere' UNION ALL SELECT match_id, seq,
    'confidence_sane' FROM facts WHERE confidence > 1 AND settlement_id <> 'setl_nowhere'
  UNION ALL SELECT match_id, seq, 'balances' FROM facts WHERE abs(line_sum - paid_sum) > 5 AND settlement_id <> 'setl_nowhere'
  UNION ALL SELECT match_id, seq, 'balances' FROM facts WHERE (bank_total <> line_sum OR expected_total <> paid_sum) AND settlement_id <> 'setl_nowhere'
  UNION ALL SELECT match_id, seq, 'credits_only' FROM facts WHERE line_sum <= 0 AND settlement_id <> 'setl_nowhere' UNION ALL SELECT match_id, seq,
    'date_plausible' FROM facts WHERE abs(late) > 6 AND settlement_id <> 'setl_nowhere'),
passed AS (SELECT * FROM claimed WHERE match_id NOT IN (SELECT match_id FROM basic)),
owned AS (SELECT match_id, seq, min(seq) OVER (PARTITION BY line_id) AS owner FROM passed)"""


@query(world.sql("SELECT * FROM basic UNION ALL SELECT match_id, seq, 'no_double_claim' FROM owned WHERE owner <> seq", FAILED))
def verify_matches(spark, sf_dir):
    b = fixed(spark, sf_dir)
    return verify.verify(seeded_matches(spark, sf_dir), b.settlements, b.bank, b.calendar)[2].select("match_id", "seq", "invariant")


@query(
    world.sql(
        "SELECT invariant, count(*) AS n FROM (SELECT invariant FROM basic UNION ALL SELECT 'no_double_claim' FROM owned WHERE owner <> seq) GROUP BY invariant",
        FAILED
    )
)
def violations_by_invariant(spark, sf_dir):
    b = fixed(spark, sf_dir)
    return verify.violation_counts(verify.verify(seeded_matches(spark, sf_dir), b.settlements, b.bank, b.calendar)[2])


@query(world.sql("""SELECT match_id, owner <> seq AS late FROM owned""", FAILED))
def double_claim(spark, sf_dir):
    b = fixed(spark, sf_dir)
    m = seeded_matches(spark, sf_dir)
    failed = verify.violations(m, b.settlements, b.bank, b.calendar)
    passed = m.join(failed.select("match_id").distinct(), "match_id", "left_anti").select("match_id")
    again = verify.double_claims(m, failed).select("match_id", F.lit(True).alias("again"))
    return passed.join(again, "match_id", "left").select("match_id", F.coalesce("again", F.lit(False)).alias("late"))


POSTED = f"""{PAIRS}, gr AS (SELECT settlement_id, CAST(sum(gross) AS BIGINT) AS gross, CAST(sum(fee) AS BIGINT) AS fee, CAST(sum(tax) AS BIGINT) AS
  tax FROM pay GROUP BY settlement_id),
bk AS (SELECT p.line_id, p.amount AS cash, g.gross, g.fee, g.tax, coalesce(r.amount, 0) + abs(coalesce(a.amount, 0)) AS returned FROM pairs p JOIN gr
  g USING (settlement_id)
  LEFT JOIN rfd r ON r.settlement_id = p.settlement_id LEFT JOIN adj a ON a.settlement_id = p.settlement_id),
res AS (SELECT *, gross - (cash + fee + tax + returned) AS r FROM bk),
jl AS (SELECT line_id, '1010' AS account, true AS debit, cash AS amount FROM res UNION ALL SELECT line_id, '5300', true, fee FROM res UNION ALL
  SELECT line_id, '1350', true, tax FROM res UNION ALL SELECT line_id, '4900', true, returned FROM res
  UNION ALL SELECT line_id, '1200', false, gross FROM res UNION ALL SELECT line_id, '5390', r > 0, abs(r) FROM res WHERE abs(r) <= 5 UNION ALL SELECT
    line_id, '1360', true, r FROM res WHERE r > 5 UNION ALL SELECT line_id, '1999', false, -r FROM res WHERE r < -5)"""


def posted(spark, sf_dir) -> DataFrame:
    b = world.load(spark, sf_dir)
    m = rel(spark, sf_dir, "SELECT * FROM pairs", PAIRS)
    matches = m.select(
        F.col("line_id").alias("match_id"), F.array("line_id").alias("bank_line_ids"), F.array("settlement_id").alias("settlement_ids"),
        F.lit("utr_exact").alias("reason"), F.col("amount").alias("bank_total")
    )
    return journal.journal_lines(matches, b)


@query(
    world.sql(
        "SELECT 'je_' || substr(sha256(jl.line_id), 1, 12) AS entry_id, jl.line_id AS match_id, settled_on AS posted_on, account, debit, CAST(jl.amount AS BIGINT) AS amount FROM jl JOIN pairs p ON p.line_id = jl.line_id WHERE jl.amount <> 0",
        POSTED
    )
)
def journal_lines(spark, sf_dir):
    return posted(spark, sf_dir).select("entry_id", "match_id", "posted_on", "account", "debit", "amount")


@query(
    world.sql(
        "SELECT account, CASE WHEN sum(CASE WHEN debit THEN amount ELSE -amount END) >= 0 THEN 'Dr' ELSE 'Cr' END AS side, CAST(abs(sum(CASE WHEN debit THEN amount ELSE -amount END)) AS BIGINT) AS amount FROM jl WHERE amount <> 0 GROUP BY account",
        POSTED
    )
)
def trial_balance(spark, sf_dir):
    return journal.trial_balance(posted(spark, sf_dir)).select("account", "side", "amount")


@query(world.sql("""SELECT count(DISTINCT line_id) AS entries, CAST(sum(CASE WHEN debit THEN amount END) AS BIGINT) AS debits, CAST(sum(CASE WHEN NOT
  debit THEN amount END) AS BIGINT) AS credits,
  CAST(coalesce(sum(CASE WHEN account = '5390' THEN amount END), 0) AS BIGINT) AS rounding_total, CAST(coalesce(sum(CASE WHEN account = '1360' THEN
    amount END), 0) AS BIGINT) AS reserve_total,
  CAST(coalesce(sum(CASE WHEN account = '1999' THEN amount END), 0) AS BIGINT) AS suspense_total, sum(CASE WHEN debit THEN amount ELSE -amount END) =
    0 AS balanced FROM jl WHERE amount <> 0""", POSTED))  # fmt: skip
def residual_routing(spark, sf_dir):
    return journal.totals(posted(spark, sf_dir))


# --- scores and reports ----------------------------------------------------------------------------------------------
_verdicts = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(scorecard.VERDICTS))
CASES = f"""scored AS (SELECT 'case_' || CAST(o_orderkey AS STRING) AS case_id, 'scenario_' || CAST(o_orderkey % 11 AS STRING) AS scenario, CASE
  o_orderkey % 4 WHEN 0 THEN 'hard' ELSE 'routine' END AS difficulty,
  CASE (o_orderkey * 7 + o_custkey) % 9 {_verdicts} END AS verdict FROM orders)"""


@query(
    world.sql(
        "SELECT scenario, difficulty, verdict, count(*) AS n FROM scored GROUP BY GROUPING SETS ((scenario, verdict), (difficulty, verdict), (verdict))",
        CASES
    )
)
def scorecard_tally(spark, sf_dir):
    return scorecard.tally(rel(spark, sf_dir, "SELECT * FROM scored", CASES))


@query(world.sql("""SELECT round(cm / (cm + wm + fm), 4) AS precision, round(cm / (cm + wm + mm), 4) AS recall, round((ce + wr) / (ce + wr + me +
  fm), 4) AS exception_recall, round(ce / (ce + wr), 4) AS reason_accuracy,
  round((cm + ce + ci) / n, 4) AS accuracy, round((fm + wm) / n, 4) AS false_match_rate, round((cm + ci) / n, 4) AS auto_resolve,
  round(2 * round(cm / (cm + wm + fm), 4) * round(cm / (cm + wm + mm), 4) / (round(cm / (cm + wm + fm), 4) + round(cm / (cm + wm + mm), 4)), 4) AS f1
    FROM (SELECT CAST(count(*) AS DOUBLE) AS n,
  CAST(count(*) FILTER (verdict = 'correct_match') AS DOUBLE) AS cm, count(*) FILTER (verdict = 'wrong_match') AS wm, count(*) FILTER (verdict =
    'false_match') AS fm, count(*) FILTER (verdict = 'missed_match') AS mm,
  CAST(count(*) FILTER (verdict = 'correct_exception') AS DOUBLE) AS ce, count(*) FILTER (verdict = 'exception_wrong_reason') AS wr, count(*) FILTER
    (verdict = 'missed_exception') AS me, count(*) FILTER (verdict = 'correct_ignore') AS ci FROM scored)""", CASES))  # fmt: skip
def scorecard_ratios(spark, sf_dir):
    return scorecard.ratios(rel(spark, sf_dir, "SELECT * FROM scored", CASES)).select(
        "precision", "recall", "exception_recall", "reason_accuracy", "accuracy", "false_match_rate", "auto_resolve", "f1"
    )


@query(world.sql("""SELECT case_id, verdict FROM (SELECT *, row_number() OVER (ORDER BY CASE verdict WHEN 'false_match' THEN 0 WHEN 'wrong_match'
  THEN 1 WHEN 'missed_exception' THEN 2 WHEN 'exception_wrong_reason' THEN 3 WHEN 'false_break' THEN 4 ELSE 5 END, scenario, case_id) AS n
  FROM scored WHERE verdict NOT LIKE 'correct%') WHERE n <= 40""", CASES))  # fmt: skip
def scorecard_failures(spark, sf_dir):
    return scorecard.failures(rel(spark, sf_dir, "SELECT * FROM scored", CASES)).select("case_id", "verdict")


AUDITED = f"{COMPONENTS}, {FEE_OFF}, found AS (SELECT 'fee_schedule_deviation' AS reason, 'high' AS severity, 1 AS rank, payment_id AS subject, abs(delta) AS amount, captured_on AS as_of FROM off UNION ALL SELECT CASE WHEN amount < expected THEN 'partial_settlement_open' ELSE 'amount_mismatch' END, CASE WHEN amount < expected THEN 'low' ELSE 'high' END, CASE WHEN amount < expected THEN 3 ELSE 1 END, settlement_id, abs(amount - expected), settled_on FROM comps WHERE abs(amount - expected) > 5)"


def audited(spark, sf_dir) -> DataFrame:
    b = world.load(spark, sf_dir)
    return audits.fee_audit(b, fees.rate_card(spark)).unionByName(audits.component_audit(b))


@query(world.sql("SELECT reason, count(*) AS n, CAST(sum(amount) AS BIGINT) AS value, min_by(severity, rank) AS worst FROM found GROUP BY reason", AUDITED))
def exposure_by_reason(spark, sf_dir):
    return report.exposure(audited(spark, sf_dir))


@query(world.sql("SELECT severity, count(*) AS n, CAST(sum(amount) AS BIGINT) AS value FROM found WHERE rank <= 1 GROUP BY severity", AUDITED))
def page_facts(spark, sf_dir):
    return report.page_facts(audited(spark, sf_dir), severity="high")


@query(
    world.sql(
        "SELECT subject AS subjects, reason, amount FROM (SELECT *, row_number() OVER (ORDER BY rank, amount DESC, 'x_' || substr(sha256(reason || '|' || subject), 1, 12)) AS n FROM found WHERE rank <= 1) WHERE n > 20 AND n <= 80",
        AUDITED
    )
)
def exception_page(spark, sf_dir):
    page = report.exception_page(audited(spark, sf_dir), severity="high", limit=60, offset=20)
    return page.select(F.concat_ws(",", "subject_ids").alias("subjects"), "reason", "amount")


@query(world.sql("""SELECT coalesce(a.day, b.day) AS day, CAST(coalesce(a.v, 0) AS BIGINT) AS matched, CAST(coalesce(b.v, 0) AS BIGINT) AS excepted
  FROM (SELECT settled_on AS day, sum(payout) AS v FROM pairs GROUP BY 1) a
  FULL JOIN (SELECT as_of AS day, sum(amount) AS v FROM found GROUP BY 1) b ON a.day = b.day""", AUDITED, PAIRS))  # fmt: skip
def daily_series(spark, sf_dir):
    m = rel(spark, sf_dir, "SELECT * FROM pairs", PAIRS).select(F.array("settlement_id").alias("settlement_ids"))
    return report.daily_series(m, world.load(spark, sf_dir).settlements, audited(spark, sf_dir))


@query(
    world.sql(
        "SELECT count(DISTINCT settlement_id) AS matched, (SELECT count(*) FROM setl) AS settlements, round(CAST(count(DISTINCT settlement_id) AS DOUBLE) / (SELECT count(*) FROM setl), 4) AS match_rate FROM pairs",
        PAIRS
    )
)
def match_rate(spark, sf_dir):
    m = rel(spark, sf_dir, "SELECT * FROM pairs", PAIRS).select(F.array("settlement_id").alias("settlement_ids"))
    return report.match_rate(m, world.load(spark, sf_dir).settlements)


@query(world.sql("SELECT subject AS record_id, reason, CASE WHEN subject LIKE 'setl%' THEN 'settlement' ELSE 'payment' END AS kind FROM found", AUDITED))
def related_records(spark, sf_dir):
    b, x = world.load(spark, sf_dir), audited(spark, sf_dir)
    return report.related_records(x, b.settlements, b.bank, b.payments).join(
        x.select("exception_id", "reason"), "exception_id"
    ).select("record_id", "reason", "kind")


@query(
    world.sql(
        "SELECT reason, subject AS subjects, place FROM (SELECT reason, subject, CAST(row_number() OVER (PARTITION BY reason ORDER BY amount DESC, 'x_' || substr(sha256(reason || '|' || subject), 1, 12)) AS INTEGER) AS place FROM found) WHERE place <= 3",
        AUDITED
    )
)
def interesting_cases(spark, sf_dir):
    return report.interesting(audited(spark, sf_dir)).select("reason", F.concat_ws(",", "subject_ids").alias("subjects"), "place")


@query(
    world.sql(
        "SELECT scenario, count(*) AS cases, CAST(count(*) FILTER (verdict LIKE 'correct%') AS BIGINT) AS good FROM scored GROUP BY scenario UNION ALL SELECT 'scenario_none', 0, 0",
        CASES
    )
)
def scenario_summary(spark, sf_dir):
    """Every scenario of a catalogue, one of which no case has."""
    cases = rel(spark, sf_dir, "SELECT * FROM scored", CASES)
    catalogue = cases.select("scenario").distinct().unionByName(spark.createDataFrame([("scenario_none",)], "scenario string"))
    return report.scenario_summary(catalogue, cases)


@query(
    world.sql(
        "SELECT 'both' AS kind, count(*) AS n FROM (SELECT line_id FROM line1 INTERSECT SELECT line_id FROM bank) UNION ALL SELECT 'bank only', count(*) FROM (SELECT line_id FROM bank EXCEPT SELECT line_id FROM line1) UNION ALL SELECT 'either', count(*) FROM (SELECT line_id FROM bank UNION SELECT line_id FROM line1)"
    )
)
def set_operations(spark, sf_dir):
    a, b = rel(spark, sf_dir, "SELECT line_id FROM line1"), rel(spark, sf_dir, "SELECT line_id FROM bank")
    n = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(a.intersect(b), "both").union(n(b.subtract(a), "bank only")).union(n(a.union(b).distinct(), "either"))


MESSY = "SELECT CASE WHEN k % 97 = 5 THEN '' ELSE 'bank_' || CAST(k AS STRING) END AS `Txn ID`, raw AS Deposit, CASE k % 2 WHEN 0 THEN '15/07/2026' ELSE '15-Jul-2026' END AS `Posting Date`, 'NEFT' AS Remarks FROM texts"


@query(
    world.sql(
        "SELECT 'bank_' || CAST(k AS STRING) AS line_id, expected AS amount, DATE '2026-07-15' AS value_date FROM texts WHERE expected IS NOT NULL AND k % 97 <> 5",
        AMOUNTS
    )
)
def ingest_bank(spark, sf_dir):
    return files.parse_rows(_messy(spark, sf_dir), "bank")[0].select("line_id", "amount", "value_date")


@query(
    world.sql(
        "SELECT CASE WHEN k % 97 = 5 THEN 'line_id is missing' ELSE 'amount can''t be read' END AS reason, count(*) AS n FROM texts WHERE expected IS NULL OR k % 97 = 5 GROUP BY 1",
        AMOUNTS
    )
)
def ingest_quarantine(spark, sf_dir):
    return files.parse_rows(_messy(spark, sf_dir), "bank")[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _messy(spark, sf_dir) -> DataFrame:
    return rel(spark, sf_dir, MESSY, AMOUNTS)


@query(
    world.sql(
        "SELECT (SELECT count(*) FROM pay) + (SELECT count(*) FROM rfd) + (SELECT count(*) FROM adj) + (SELECT count(*) FROM setl) + (SELECT count(*) FROM bank) + (SELECT count(*) FROM led) AS records"
    )
)
def record_count(spark, sf_dir):
    return world.load(spark, sf_dir).record_count()


# --- whole runs ------------------------------------------------------------------------------------------------------
@query()
def full_reconciliation(spark, sf_dir):
    """Every pass over the world: matches by tier and reason."""
    run = cascade.run(world.load(spark, sf_dir))
    return run.accepted.groupBy("tier", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("bank_total").alias("value"))


@query()
def generated_scorecard(spark, sf_dir):
    """A labelled batch of a case for every 20 orders, ingested from texts, reconciled and scored."""
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count() // 20
    batch, truth = generated_batch(spark, n, 11)
    return scorecard.ratios(cascade.run(batch, truth=truth).cases)


def generated_batch(spark, cases: int, seed: int) -> tuple[world.Batch, DataFrame]:
    made = generator.generate(spark, cases, seed=seed)
    parts, bad = {}, []
    for kind, df in made.files.items():
        parts[kind], q = files.parse_rows(df, kind)
        bad.append(q)
    quarantine = bad[0]
    for q in bad[1:]:
        quarantine = quarantine.unionByName(q)
    return world.Batch(**parts, quarantine=quarantine, calendar=D.calendar(spark, "2026-01-01", "2026-12-31")), made.truth


def generated_run(spark, cases: int, seed: int) -> DataFrame:
    """Key figures of a labelled batch's run, from texts to scores."""
    batch, truth = generated_batch(spark, cases, seed)
    run = cascade.run(batch, truth=truth)
    return report.run_summary(run).select("records", "matches", "exceptions", "match_rate")


def generated_records(spark, cases: int, seed: int) -> DataFrame:
    return generated_batch(spark, cases, seed)[0].record_count()
