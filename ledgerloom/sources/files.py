"""Gateway, bank and ledger exports as typed frames, with what can't be read set aside; and sinks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import calendar, parse_datetime
from ..functions.money import parse_money
from .world import Batch

# The names that exports give to each column, the first that holds something counts.
ALIASES = {
    "payments": {
        "payment_id": "payment_id id txn_id", "order_id": "order_id order reference_id", "gross": "gross_amount amount gross", "fee": "fee commission", "tax": "tax gst",
        "net": "net_amount net settled_amount", "captured_at": "captured_at created_at transaction_date", "method": "method", "currency": "currency",
        "settlement_id": "settlement_id", "international": "international", "source_currency": "source_currency", "fx_rate": "fx_rate",
    },
    "settlements": {
        "settlement_id": "settlement_id id payout_id", "utr": "utr reference rrn", "amount": "amount net_amount payout_amount", "settled_at": "settled_at settlement_date date",
        "payment_ids": "payment_ids", "refund_ids": "refund_ids", "adjustment_ids": "adjustment_ids", "currency": "currency",
    },
    "refunds": {"refund_id": "refund_id id", "payment_id": "payment_id", "amount": "amount", "created_at": "created_at date", "settlement_id": "settlement_id"},
    "adjustments": {
        "adjustment_id": "adjustment_id id", "kind": "kind type", "amount": "amount", "created_at": "created_at date", "settlement_id": "settlement_id",
        "linked_payment_id": "linked_payment_id payment_id",
    },
    "bank": {
        "line_id": "line_id id txn_id", "amount": "amount credit deposit transaction_amount", "credit": "credit_amount cr", "debit": "debit_amount dr", "balance": "balance",
        "value_date": "value_date date txn_date posting_date", "narration": "narration description particulars remarks", "bank_ref": "bank_ref cheque_no ref_no", "currency": "currency",
    },
    "ledger": {
        "entry_id": "entry_id id", "order_id": "order_id order reference", "expected_gross": "expected_gross amount invoice_amount", "customer": "customer party counterparty",
        "booked_on": "booked_on date invoice_date", "currency": "currency", "status": "status",
    },
}
FILES = {
    "payments": "psp_payments.csv", "settlements": "psp_settlements.csv", "refunds": "psp_refunds.csv", "adjustments": "psp_adjustments.csv", "bank": "bank_statement.csv", "ledger": "ledger.csv",
}
YES = ["true", "yes", "y", "1"]


def plain(header: str) -> str:
    return re.sub("[^a-z0-9]+", "", header.lower())


#: Where a row was read from: its file, the split's first byte, and a number that grows along the split.
PLACE = ["_file", "_start", "_order"]


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text, and PLACE.  A file that is not there, or has no bytes, is an empty table; a byte-order mark
    is dropped.  multi_line: quoted texts may hold line breaks; a file is then read by one task.

    The path goes to Spark's own readers only, so any store they know will do.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(conf)
    if not store.exists(at) or store.getContentSummary(at).getLength() == 0:
        return spark.createDataFrame([], "_none string")
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line).option("escape", '"').csv(path)
    named = [F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in df.columns]
    return df.select(
        *named, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_order")
    )


def row_numbers(rows: DataFrame) -> DataFrame:
    """(_file, _start, _first): the number that the first row of each split has, less its _order.  A row's number in its
    file (the header is row 1) is _order and this together; one row a split."""
    splits = rows.groupBy("_file", "_start").agg(F.min("_order").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return splits.select("_file", "_start", (before + 2 - F.col("_least")).alias("_first"))


def pick(df: DataFrame, names: str) -> Column:
    """The first of the columns, by plain name, that holds a text."""
    by = {plain(c): c for c in df.columns}
    found = [F.nullif(F.trim(F.col(f"`{by[plain(n)]}`")), F.lit("")) for n in names.split() if plain(n) in by]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def split_ids(packed: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(packed, F.lit("")), "[|,;]"), lambda x: F.trim(x)), lambda x: x != "")


@dataclass(frozen=True)
class Spec:
    """How a file's text becomes rows: the texts that are amounts and dates, typed columns made of what these were read
    as (paise(), stamp()), and the first complaint about a row, if any."""

    amounts: str
    dates: str
    columns: dict[str, Column]
    complaints: list[tuple[Column, str]] = field(default_factory=list)


def paise(name: str) -> Column:
    return F.col(f"_{name}_paise")


def stamp(name: str) -> Column:
    return F.col(f"_{name}_stamp")


def read_texts(named: DataFrame, spec: Spec) -> DataFrame:
    """Adds what each amount and date text says, once, however often the columns and complaints ask."""
    amounts = {f"_{n}_paise": parse_money(F.col(n)) for n in spec.amounts.split()}
    read = amounts | {f"_{n}_stamp": parse_datetime(F.col(n)) for n in spec.dates.split()}
    # a generator, as a filter would else be moved before the reading and read all again
    return named.withColumn("_read", F.explode(F.array(F.struct(*(v.alias(k) for k, v in read.items()))))).select(*named.columns, "_read.*")


def _required(*names: str) -> list[tuple[Column, str]]:
    return [(F.col(n).isNull(), f"{n} is missing") for n in names]


def _amount(name: str) -> tuple[Column, str]:
    return paise(name).isNull(), f"{name} can't be read"


def _date(name: str) -> tuple[Column, str]:
    return stamp(name).isNull(), f"{name} can't be read"


def specs() -> dict[str, Spec]:
    c, money, when = F.col, paise, stamp
    upper = lambda n, d: F.upper(F.coalesce(c(n), F.lit(d)))
    lower = lambda n, d: F.lower(F.coalesce(c(n), F.lit(d)))
    zero = lambda n: F.when(c(n).isNull(), F.lit(0)).otherwise(money(n)).cast("long")
    whole = F.coalesce(money("net"), money("gross") - zero("fee") - zero("tax"))
    stated = F.when(c("amount").isNotNull(), money("amount")).when(c("credit").isNotNull(), money("credit")).when(
        c("debit").isNotNull(), -F.abs(money("debit"))
    )
    return {
        "payments": Spec(
            "gross fee tax net", "captured_at",
            {"payment_id": c("payment_id"), "order_id": c("order_id"), "gross": money("gross"), "fee": zero("fee"), "tax": zero("tax"), "net": whole, "captured_at": when("captured_at"),
             "captured_on": when("captured_at").cast("date"), "method": lower("method", "unknown"), "currency": upper("currency", "INR"), "settlement_id": c("settlement_id"),
             "international": F.lower(F.coalesce(c("international"), F.lit(""))).isin(YES), "fx_rate": c("fx_rate"), "source_currency": c("source_currency")},
            [*_required("payment_id"), _amount("gross"), (zero("fee").isNull(), "fee can't be read"), (zero("tax").isNull(), "tax can't be read"), (c("net").isNotNull() & money("net").isNull(), "net can't be read"),
             (c("net").isNotNull() & (money("net") != money("gross") - zero("fee") - zero("tax")), "net is not gross less fee and tax"), _date("captured_at")],
        ),
        "settlements": Spec(
            "amount", "settled_at",
            {"settlement_id": c("settlement_id"), "utr": c("utr"), "amount": money("amount"), "settled_at": when("settled_at"), "settled_on": when("settled_at").cast("date"),
             "payment_ids": split_ids(c("payment_ids")), "refund_ids": split_ids(c("refund_ids")), "adjustment_ids": split_ids(c("adjustment_ids")), "currency": upper("currency", "INR")},
            [*_required("settlement_id"), _amount("amount"), _date("settled_at")],
        ),
        "refunds": Spec(
            "amount", "created_at",
            {
                "refund_id": c("refund_id"), "payment_id": c("payment_id"), "amount": money("amount"), "created_on": when("created_at").cast("date"),
                "settlement_id": c("settlement_id")
            },
            [*_required("refund_id"), _amount("amount"), _date("created_at")],
        ),
        "adjustments": Spec(
            "amount", "created_at",
            {
                "adjustment_id": c("adjustment_id"), "kind": lower("kind", "correction"), "amount": money("amount"),
                "created_on": when("created_at").cast("date"), "settlement_id": c("settlement_id"), "linked_payment_id": c("linked_payment_id")
            },
            [*_required("adjustment_id"), _amount("amount"), _date("created_at")],
        ),
        "bank": Spec(
            "amount credit debit balance", "value_date",
            {
                "line_id": c("line_id"), "value_date": when("value_date").cast("date"), "narration": F.coalesce(c("narration"), F.lit("")),
                "amount": stated, "balance": money("balance"), "bank_ref": c("bank_ref"), "currency": upper("currency", "INR")
            },
            [*_required("line_id"), (stated.isNull(), "amount can't be read"), _date("value_date")],
        ),
        "ledger": Spec(
            "expected_gross", "booked_on",
            {
                "entry_id": c("entry_id"), "order_id": c("order_id"), "expected_gross": money("expected_gross"), "customer": c("customer"),
                "booked_on": when("booked_on").cast("date"), "currency": upper("currency", "INR"), "status": lower("status", "open")
            },
            [*_required("entry_id"), _amount("expected_gross"), _date("booked_on")],
        ),
    }


def parse_rows(raw: DataFrame, kind: str, source: str = "", row_number: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine) of a table of texts; every row lands in one of them.

    Quarantine: source_file, row_number, reason, record_id, raw (map).  A row's number is its place in its file, where
    read_csv() or the caller gives it; else null, and the raw texts identify the row.
    """
    spec = specs()[kind]
    placed = row_number is None and all(c in raw.columns for c in PLACE)
    if placed:
        row_number, numbers = F.col("_order"), row_numbers(raw)
        raw, where = raw.drop("_file", "_start"), raw.select("_order", "_file", "_start")
    texts = [c for c in raw.columns if c != "_order"]
    named = raw.select(
        *(pick(raw, a).alias(n) for n, a in ALIASES[kind].items()), F.to_json(F.struct(*(F.col(f"`{c}`") for c in texts))).alias("_raw"),
        (row_number if row_number is not None else F.lit(None).cast("long")).alias("_row")
    )
    complaint = F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for bad, text in spec.complaints))
    judged = read_texts(named, spec).withColumn("_why", complaint)
    good = judged.where("_why is null").select(*(v.alias(k) for k, v in spec.columns.items()), F.from_json("_raw", "map<string,string>").alias("raw"))
    ids = [c for c in ("line_id", "payment_id", "settlement_id", "entry_id", "refund_id", "adjustment_id") if c in ALIASES[kind]]
    bad = judged.where("_why is not null").select(
        F.lit(source or FILES[kind]).alias("source_file"), F.col("_row").alias("row_number"), F.col("_why").alias("reason"),
        F.coalesce(*ids).alias("record_id"), F.from_json("_raw", "map<string,string>").alias("raw")
    )
    if placed:  # only what couldn't be read needs its number
        at = where.join(numbers, ["_file", "_start"]).select(F.col("_order").alias("row_number"), (F.col("_order") + F.col("_first")).alias("_number"))
        bad = bad.join(at, "row_number").withColumn("row_number", F.col("_number")).drop("_number")
    return good, bad


def load_batch(spark: SparkSession, folder: str, files: dict[str, str] = FILES, days: tuple[str, str] = ("2025-01-01", "2027-12-31")) -> Batch:
    """The six exports of a folder.  Truth is not among them: only the scorer reads it."""
    parts, bad = {}, []
    for kind, name in files.items():
        parts[kind], q = parse_rows(read_csv(spark, f"{folder}/{name}"), kind, name)
        bad.append(q)
    quarantine = bad[0]
    for q in bad[1:]:
        quarantine = quarantine.unionByName(q)
    return Batch(**parts, quarantine=quarantine, calendar=calendar(spark, *days))


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array, or no rows where the file is not there (truth labels, recorded sessions)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


TRUTH = "case_id string, scenario string, disposition string, expected_reason string, difficulty string, settlement_ids array<string>, bank_line_ids array<string>, payment_ids array<string>, record_ids array<string>, note string"


TRANSCRIPTS = (
    "recorded_at string, provider string, model string, data_dir string, usage map<string,bigint>, cases array<struct<settlement_id string, reason string, payout_amount bigint, "
    "payout_date string, reference string, candidate_count bigint, candidates array<string>, decision string, chosen array<string>, confidence double, reasoning string>>"
)


def load_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Recorded investigations, one row a case; no rows where the file is not there."""
    return load_json(spark, path, TRANSCRIPTS).select(
        "recorded_at", "provider", "model", F.explode("cases").alias("c")
    ).select("recorded_at", "provider", "model", "c.*")


def write_truth(truth: DataFrame, path: str) -> None:
    truth.write.mode("overwrite").json(path)


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    return load_json(spark, path, TRUTH)


def export(run, folder: str) -> None:
    """A finished run's views as JSON, one folder of parts each."""
    from ..operators import report

    views = {
        "run": report.run_summary(run), "exceptions": report.register(run.exceptions), "matches": run.accepted, "journal": run.journal,
        "daily": report.daily_series(run.accepted, run.batch.settlements, run.exceptions), "exposure": report.exposure(run.exceptions)
    }
    if run.cases is not None:
        views["scenarios"] = run.cases
    for name, df in views.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def write_csv(frames: dict[str, DataFrame], folder: str, files: dict[str, str] = FILES) -> None:
    for kind, df in frames.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{files[kind]}")
