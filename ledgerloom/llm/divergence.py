"""Audit of how far the sources of a language differ in the words they use, as plain relational joins and sums."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, give_back, partitions_for, small_batches, table, text_bytes

#: Fixed values of the result contract: what a term is, documents a kept term needs, the scale of shares, ranks of terms.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Different terms and groups that a task counts before it hands its counts on.
COUNTED = 700_000
#: Exact shares: 64 bits hold SCALE times most counts, decimals any.
SHARE = (
    f"case when %s < {9 * 10**9 - 1} then 1 + (cast({SCALE} as bigint) * (%s + 1)) div %s "
    f"else cast(1 + (cast({SCALE} as decimal(10,0)) * cast(%s + 1 as decimal(20,0))) div cast(%s as decimal(20,0)) as bigint) end"
)


def share(n: str, whole: str):
    return F.expr(SHARE % (n, n, whole, n, whole))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents); a group with a text without terms has a row with a null term.

    Matches are found on bytes, as all of UTF-8 but ASCII is part of terms, and counted by document; a task hands on the
    counts of its documents whenever it has COUNTED of them, so the shuffle gets sums, and memory doesn't grow.
    """
    match = re.compile(TERM.encode()).findall

    def handed_on(counts):
        keys = [key for key, own in counts.items() for _ in own]
        names = [pa.array([key[k] for key in keys], pa.string()) for k in (0, 1)]
        terms = pa.array([term for own in counts.values() for term in own], pa.binary()).cast(pa.string())
        both = np.fromiter((x for own in counts.values() for x in own.values()), np.int64, len(keys))
        return pa.RecordBatch.from_arrays([*names, terms, pa.array(both >> 32), pa.array(both & 0xFFFFFFFF)], ["lang", "source", "term", "n", "df"])

    def run(batches):
        counts, held = {}, 0  # of a term: occurrences << 32 | documents
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            data, at = data.tobytes().lower(), at.tolist()  # bytes lower A-Z alone
            for k, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = counts.setdefault(key, {})
                held -= len(own)
                had = own.get
                for term, n in (Counter(match(data, at[k], at[k + 1])) or {None: 0}).items():
                    own[term] = had(term, 0) + (n << 32) + 1
                held += len(own)
            if held >= COUNTED:
                yield handed_on(counts)
                counts, held = {}, 0
        yield handed_on(counts)
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    rows = rows.mapInArrow(run, "lang string, source string, term string, n long, df long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def divergence(docs: DataFrame, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: sources of a language compared in pairs, and the terms each overuses.

    Null text, lang and source are ''.  A row is a document, so repeated rows count again.  Every (lang, source) that occurs
    has its pairs, also without terms (value 0 if its language keeps no term); a language's only source has none.  Equal
    values rank by the bytes of the item.  No documents, no rows.  Columns besides text, lang and source are ignored.

    Terms and groups are few beside the text, and all that is joined is checkpointed counts.  Groups meet the kept
    vocabulary of their language salted by term, so a language with most of the vocabulary is dealt to all tasks; the
    self-join, on the number of a language's term, has one row a source on each side.  Of two sources the pair is joined
    once, for both directions.
    """
    spark = docs.sparkSession
    counts = cut(term_counts(docs))
    vocabulary = cut(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= MIN_DOCS).drop("df"))
    vocabulary = vocabulary.withColumn("at", F.monotonically_increasing_id())  # a checkpoint's rows keep their places
    kept = counts.join(vocabulary, ["lang", "term"]).drop("df")
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = (
        counts.select("lang", "source").distinct()
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", (F.coalesce("total", F.lit(0)) + F.col("v")).alias("whole"), (F.col("lang_total") + F.col("v")).alias("lang_whole"))
    )
    groups = cut(groups).withColumn("id", F.monotonically_increasing_id())
    found = kept.join(groups, ["lang", "source"])

    salts = partitions_for(spark)
    salted = vocabulary.select("lang", "at", F.pmod(F.xxhash64("at"), F.lit(salts)).alias("salt"))
    everywhere = groups.where("whole is not null").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    zeros = salted.join(everywhere, ["lang", "salt"]).select("at", "id", F.lit(0).cast("long").alias("n"), "whole")
    dense = zeros.unionByName(found.select("at", "id", "n", "whole")).repartition(salts, "at")
    dense = dense.groupBy("at", "id").agg(F.sum("n").alias("n"), F.max("whole").alias("whole")).select("at", "id", share("n", "whole").alias("p"))

    a = dense.select("at", F.col("id").alias("a"), F.col("p").alias("pa"))
    b = dense.select("at", F.col("id").alias("b"), F.col("p").alias("pb"))
    met = a.join(b, "at").where("a < b").withColumn("gap", (F.col("pa") - F.col("pb")) * (F.col("pa") - F.col("pb")))
    sums = met.groupBy("a", "b").agg(F.expr("sum(gap div pb)").alias("there"), F.expr("sum(gap div pa)").alias("back"))
    ways = [F.struct("a", "b", F.col("there").alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("value"))]
    sums = sums.select(F.explode(F.array(*ways)).alias("s")).select("s.*")
    names = groups.select("lang", "source", "id")
    pairs = names.withColumnRenamed("id", "a").join(names.select("lang", F.col("source").alias("item"), F.col("id").alias("b")), "lang").where("a <> b")
    pairs = pairs.join(sums, ["a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    over = found.select("lang", "source", F.col("term").alias("item"), share("n", "whole").alias("p"), share("lang_n", "lang_whole").alias("q")).where("p > q")
    over = over.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by))
    over = over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)
    return pairs.withColumn("part", F.lit("pair")).unionByName(over.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def op11(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
with docs as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
found as (
  select id, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from docs
),
counts as (select lang, source, term, count(*)::hugeint as n from found group by lang, source, term),
vocabulary as (
  select lang, term, count(*)::hugeint as n from found group by lang, term having count(distinct id) >= {MIN_DOCS}
),
langs as (select lang, count(*)::hugeint as v, sum(n) as total from vocabulary group by lang),
groups as (select distinct lang, source from docs),
dense as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.n as lang_n
  from groups g join vocabulary k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
),
totals as (select lang, source, sum(n) as total from dense group by lang, source),
shares as (
  select d.lang, d.source, d.term, d.n, 1 + ({SCALE}::hugeint * (d.n + 1)) // (t.total + l.v) as p,
    1 + ({SCALE}::hugeint * (d.lang_n + 1)) // (l.total + l.v) as q
  from dense d join totals t on t.lang = d.lang and t.source = d.source join langs l on l.lang = d.lang
),
sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
),
terms as (
  select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value from shares where n > 0 and p > q
),
ranked as (
  select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
  from (select * from pairs union all select * from terms)
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TOP_TERMS}
"""
