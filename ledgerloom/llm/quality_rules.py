"""Line-first quality rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base rules of the result contract.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A document that loses more than this share of its words' characters is rejected.
MAX_LOST_PERCENT = 50
#: A line fails the punctuation rule if more than this share of its words end in a symbol or in two marks.
MAX_MARKED_PERCENT = 30
#: A line is navigation if at least so many of its words are bare separators, and at least this share.
MIN_SEPARATORS, MIN_SEPARATOR_PERCENT = 2, 20
#: RE2 and Java read these alike, so the check in SQL shares them.
MARKED_WORD = r"[^\x20\x09-\x0D]*([#*$%&<>]|!!|\?\?)([\x20\x09-\x0D]|$)"
SEPARATOR_WORD = r"(^|[\x20\x09-\x0D])([|>/]|»|›|·|•|::)([\x20\x09-\x0D]|$)"
MENU_LINE = (
    r"^[\x20\x09-\x0D]*(home|menu|about( us)?|contact( us)?|log ?in|log ?out|sign ?in|sign ?up|register|search|next|previous|back|"
    r"skip to (main )?content|read more|share( this)?|back to top|sitemap|faq|help|archives?|categories|tags)[\x20\x09-\x0D]*[:.>»]?[\x20\x09-\x0D]*$"
)
BOILERPLATE = (
    r"all rights reserved|copyright|©|licensed? under|gnu (lesser |affero )?general public license|creative commons|"
    r"terms of (use|service)|privacy policy|cookie(s| policy)|enable javascript|lorem ipsum|subscribe to|click here|powered by"
)
WORD = r"[^\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _n_repeat_words(words: Column, word_hashes: Column) -> Column:
    """Words inside windows of 8 that occur twice or more.  Hashes of the windows tell which can repeat at all; those are
    compared by their words."""
    n = F.size(word_hashes)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(word_hashes, i, WINDOW))))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(
            at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))),
            lambda a, b: F.when(b.isNull(), F.lit(WINDOW)).otherwise(F.least(b - a, F.lit(WINDOW)))
        )
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def repeated(ranked: Column) -> Column:
        """The places, in order, of what has an equal neighbour."""

        def again(x, i):
            before, after = F.get(ranked, i - 1), F.get(ranked, i + 1)
            same = F.coalesce(before["g"] == x["g"], F.lit(False)) | F.coalesce(after["g"] == x["g"], F.lit(False))
            return F.when(same, x["i"])

        return F.array_sort(F.filter(F.transform(ranked, again), lambda x: x.isNotNull()))

    def by_words(at: Column) -> Column:
        window = lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("g"), i.alias("i"))
        return F.array_sort(F.transform(at, window))

    def counted(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        exact = _let(_let(_let(_let(ranked, repeated), by_words), repeated), covered)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact)

    return F.when(n < WINDOW, F.lit(0)).otherwise(_let(hashes, counted)).cast("long")


def line_rules(line: Column) -> Column:
    """What is wrong with a line: 'punctuation', 'navigation', 'boilerplate', or null."""
    low = F.lower(line)
    words = F.regexp_count(line, F.lit(WORD))
    bars = F.regexp_count(line, F.lit(SEPARATOR_WORD))
    return (
        F.when(F.regexp_count(line, F.lit(MARKED_WORD)) * 100 > words * MAX_MARKED_PERCENT, F.lit("punctuation"))
        .when((bars >= MIN_SEPARATORS) & (bars * 100 >= words * MIN_SEPARATOR_PERCENT), F.lit("navigation"))
        .when(low.rlike(MENU_LINE), F.lit("navigation"))
        .when(low.rlike(BOILERPLATE), F.lit("boilerplate"))
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: the contract's counts and verdicts, and what the line rules left.

    Lines are judged first and on their own; lines that fail are removed; a document that loses more than
    MAX_LOST_PERCENT of its word characters is rejected; one that loses just that share is kept.  A null or empty text
    has no words, so it fails the base rules; texts of any length are read whole; repeated rows have equal rows; a null
    doc_id stays null; no rows in, no rows out.  Columns besides doc_id and text are ignored, whatever their names.
    Everything is one projection: no shuffle, no Python.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        F.col("doc_id"),
        text.alias("_t"),
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("_l"),
    )
    parts = split.select(
        "doc_id",
        "_l",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _let(F.transform("_w", lambda w: F.xxhash64(w)), lambda h: _n_repeat_words(F.col("_w"), h)).alias("n_repeat_words"),
        F.transform("_l", lambda x: F.struct(x.alias("line"), line_rules(x).alias("rule"))).alias("_r"),
    )
    bare = lambda x: F.length(F.regexp_replace(x["line"], r"[\x20\x09-\x0D]+", ""))
    lost = F.aggregate(F.filter("_r", lambda x: x["rule"].isNotNull()), F.lit(0).cast("long"), lambda s, x: s + bare(x))
    counted = parts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_r",
        ((F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)).alias("base_failed"),
        lost.alias("lost_chars"),
    )
    of = lambda name: F.size(F.filter("_r", lambda x: x["rule"] == name)).cast("long")
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST_PERCENT)).alias("kept"),
        "lost_chars",
        of("punctuation").alias("n_punctuation_lines"), of("navigation").alias("n_navigation_lines"), of("boilerplate").alias("n_boilerplate_lines"),
    )


def clean_text(docs: DataFrame) -> DataFrame:
    """doc_id and the text without the lines that fail a rule; lines without a word go too."""
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return docs.select("doc_id", F.array_join(F.filter(lines, lambda x: line_rules(x).isNull()), "\n").alias("clean_text"))


def op3(spark, sf_dir):
    from .common import table

    return quality_rules(table(spark, sf_dir, "documents"))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_q(WORD)}) AS w FROM documents),
win AS (
    SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g
    FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS r(i) WHERE len(w) >= {WINDOW}),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, unnest(range(0, {WINDOW})) AS r(o) GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM d, unnest(string_split(t, chr(10))) AS r(line) WHERE regexp_matches(line, {_q(WORD)})),
ruled AS (
    SELECT doc_id, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS bare,
      CASE WHEN len(regexp_extract_all(line, {_q(MARKED_WORD)})) * 100 > len(regexp_extract_all(line, {_q(WORD)})) * {MAX_MARKED_PERCENT} THEN 'punctuation'
           WHEN len(regexp_extract_all(line, {_q(SEPARATOR_WORD)})) >= {MIN_SEPARATORS}
            AND len(regexp_extract_all(line, {_q(SEPARATOR_WORD)})) * 100 >= len(regexp_extract_all(line, {_q(WORD)})) * {MIN_SEPARATOR_PERCENT} THEN 'navigation'
           WHEN regexp_matches(lower(line), {_q(MENU_LINE)}) THEN 'navigation'
           WHEN regexp_matches(lower(line), {_q(BOILERPLATE)}) THEN 'boilerplate' END AS rule
    FROM lines),
l AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(bare) FILTER (rule IS NOT NULL), 0) AS lost,
      count(*) FILTER (rule = 'punctuation') AS p, count(*) FILTER (rule = 'navigation') AS n, count(*) FILTER (rule = 'boilerplate') AS b
    FROM ruled GROUP BY doc_id),
c AS (
    SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
      coalesce(l.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(l.lost, 0) AS lost_chars,
      coalesce(l.p, 0) AS n_punctuation_lines, coalesce(l.n, 0) AS n_navigation_lines, coalesce(l.b, 0) AS n_boilerplate_lines
    FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept,
  CAST(lost_chars AS BIGINT) AS lost_chars, CAST(n_punctuation_lines AS BIGINT) AS n_punctuation_lines,
  CAST(n_navigation_lines AS BIGINT) AS n_navigation_lines, CAST(n_boilerplate_lines AS BIGINT) AS n_boilerplate_lines
FROM c
"""
