"""Money as whole paise (BIGINT)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for no amount, and currency marks that are dropped wherever they stand.
NO_AMOUNT = ["-", "--", "–", "—", "NA", "N/A", "NULL", "NIL", "NONE", "."]
CURRENCY_MARKS = "INR|RS\\.|RS|USD|EUR|GBP|AED|SGD|₹|₨|\\$|€|£"


def decimal_separator(s: Column) -> Column:
    """',' or '.' or '' of a number's text: the later mark if both stand in it; one kind alone is grouping exactly when
    three characters follow its last one."""
    tail = lambda mark: F.length(F.substring_index(s, mark, -1))
    comma, dot = F.instr(s, ",") > 0, F.instr(s, ".") > 0
    return (
        F.when(comma & dot, F.when(tail(".") < tail(","), F.lit(".")).otherwise(F.lit(",")))
        .when(comma & (tail(",") != 3), F.lit(","))
        .when(dot & (tail(".") != 3), F.lit("."))
        .otherwise(F.lit(""))
    )


def rupees_to_paise(rupees: Column) -> Column:
    """Half-up, away from zero for negative amounts."""
    return F.round(rupees * 100, 0).cast("long")


def paise_to_rupees(paise: Column) -> Column:
    return (paise.cast("decimal(20,0)") / 100).cast("decimal(20,2)")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: expressions nested in each other would multiply."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_money(raw: Column) -> Column:
    """Paise of a bank's or gateway's amount text, null where it can't be read.

    Brackets, DR, and a sign before or behind make an amount negative; currency marks, blanks and quotes as grouping
    are dropped.  Exponents are rejected rather than read.
    """
    trimmed = F.upper(F.regexp_replace(raw, "^[\\s\u00A0]+|[\\s\u00A0]+$", ""))
    unreadable = lambda u: u.isNull() | (u == "") | u.isin(NO_AMOUNT)
    bracketed = lambda u: u.startswith("(") & u.endswith(")")

    def from_upper(u):
        inner = F.when(bracketed(u), F.trim(F.substring(u, F.lit(2), F.length(u) - 2))).otherwise(u)
        value = let(inner, lambda i: from_inner(i, bracketed(u)))
        return F.when(unreadable(u), F.lit(None).cast("long")).otherwise(value)

    def from_inner(i, negative):
        bare = F.when(i.rlike("(DR|DB|CR)$"), F.substring(i, F.lit(1), F.length(i) - 2)).otherwise(i)
        plain = F.regexp_replace(F.regexp_replace(bare, CURRENCY_MARKS, ""), "[ \\t\u00A0\u2009'_]", "")
        return let(plain, lambda p: signed(p, negative | i.rlike("(DR|DB)$")))

    def signed(p, negative):
        minus = negative.cast("int") + p.startswith("-").cast("int") + p.rlike("^.+-$").cast("int")
        value = let(F.regexp_replace(p, "^[+-]|-$", ""), lambda d: let(as_number(d), rupees_to_paise))
        return F.when(minus % 2 == 1, -value).otherwise(value)

    def as_number(d):
        plain = let(decimal_separator(d), lambda mark: (
            F.when(mark == ",", F.replace(F.replace(d, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(mark == ".", F.replace(d, F.lit(","), F.lit("")))
            .otherwise(F.regexp_replace(d, "[.,]", ""))
        ))
        return let(plain, lambda n: F.when(n.rlike("^[0-9]+(\\.[0-9]+)?$"), n).try_cast("decimal(30,8)"))

    # most texts are plain, and say what their digits say
    return F.when(raw.rlike("^[0-9]{1,15}\\.[0-9]{2}$"), F.replace(raw, F.lit("."), F.lit("")).cast("long")).otherwise(let(trimmed, from_upper))


def format_inr(paise: Column, symbol: str = "₹") -> Column:
    """Indian grouping: the last three digits of the rupees, then twos."""
    rupees, rest = (F.abs(paise) / 100).cast("decimal(20,2)"), F.lpad((F.abs(paise) % 100).cast("string"), 2, "0")
    whole = F.split(rupees.cast("string"), "\\.")[0]
    head = F.when(F.length(whole) > 3, F.regexp_replace(F.substring(whole, F.lit(1), F.length(whole) - 3), "(\\d)(?=(\\d{2})+$)", "$1,"))
    grouped = F.concat(F.coalesce(F.concat(head, F.lit(",")), F.lit("")), F.when(F.length(whole) > 3, F.right(whole, F.lit(3))).otherwise(whole))
    return F.concat(F.when(paise < 0, F.lit("-")).otherwise(F.lit("")), F.lit(symbol), grouped, F.lit("."), rest)


def is_scale_error(a: Column, b: Column) -> Column:
    """One amount is the other's hundredfold, but for less than a rupee."""
    low, high = F.least(F.abs(a), F.abs(b)), F.greatest(F.abs(a), F.abs(b))
    return (a != 0) & (b != 0) & (F.abs(high - 100 * low) < 100)


def is_transposition(a: Column, b: Column) -> Column:
    """Different amounts of one sign that are written with the same digits."""
    digits = lambda x: F.array_sort(F.split(F.abs(x).cast("string"), ""))
    same_sign = F.signum(a.cast("double")) * F.signum(b.cast("double")) > 0
    return (a != b) & same_sign & ((F.abs(a) - F.abs(b)) % 9 == 0) & (digits(a) == digits(b))
