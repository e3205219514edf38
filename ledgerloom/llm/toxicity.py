"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Bound of what is learned from: labelled rows.  All terms of theirs that pass the test are insults.
MAX_LABELLED = 20_000
#: A stem is the beginning of a word, of so many characters; shorter or longer whole words are learned too.
STEMS = (4, 5, 6, 7)
#: Words a negation reaches.
REACH = 3
#: What a clause's pattern does to the weight of an insult in it, and the weight of a threat with a target.
AIMED, NEGATED, REPORTED, THREAT_WEIGHT = 1.5, 0.3, 0.6, 2.0
#: The closed word classes of the grammar (English, German, French, Spanish).
THREATS = "kill murder hurt stab shoot strangle destroy töten umbringen erschießen tuer frapper étrangler matar golpear disparar".split()
TARGETS = "you your you're youre u he she they him her them people everyone du dich dir ihr euch er sie tu toi te vous il elle ils tú usted ustedes él ella ellos".split()
NEGATIONS = "not never no n't isn't aren't don't without nicht nie kein keine keinen jamais pas ni nunca jamás sin".split()
REPORTS = "said says say called calls claimed wrote quoted allegedly sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split()
QUOTES = '"“”«»'
NEUTRAL, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLOSED = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws} | {c: REPORT for c in QUOTES}
WORD = re.compile(rf"[^\W_]+(?:['’][^\W_]+)*|[{QUOTES}]")
CLAUSE_END = re.compile(r"[.!?;\n]")


# Each transducer maps (state, word class) to (next state, factor on an insult's weight, weight of its own).
def insult_transducer(state: int, kind: int):
    return 0, 1.0 if kind == INSULT else 0.0, 0.0


def threat_transducer(state: int, kind: int):
    """A threat and a target make one match, in either order of words up to the clause's end."""
    if kind == THREAT:
        return 1, 1.0, 0.0
    return (0, 1.0, THREAT_WEIGHT) if kind == TARGET and state else (state, 1.0, 0.0)


def target_transducer(state: int, kind: int):
    return (1 if kind == TARGET else state), AIMED if state else 1.0, 0.0


def negation_transducer(state: int, kind: int):
    return (REACH if kind == NEGATION else max(0, state - 1)), NEGATED if state else 1.0, 0.0


def report_transducer(state: int, kind: int):
    return (1 if kind == REPORT else state), REPORTED if state else 1.0, 0.0


PARTS = [(insult_transducer, 1), (threat_transducer, 2), (target_transducer, 2), (negation_transducer, REACH + 1), (report_transducer, 2)]


def compose(parts=PARTS) -> dict[tuple[int, int], tuple[int, float, float]]:
    """The product transducer: one table over numbered state tuples; factors multiply, own weights scale with them."""
    states = list(product(*(range(n) for _, n in parts)))
    number = {s: i for i, s in enumerate(states)}
    table = {}
    for s in states:
        for kind in range(6):
            steps = [f(x, kind) for (f, _), x in zip(parts, s, strict=True)]
            factor = float(np.prod([x[1] for x in steps]))
            softer = float(np.prod([x[1] for x in steps[3:]]))  # negation and report soften a threat too
            table[number[s], kind] = number[tuple(x[0] for x in steps)], factor, softer * sum(x[2] for x in steps)
    return table


def words_of(text: str) -> list[str]:
    return WORD.findall(text)


def terms_of(text: str) -> set[str]:
    """Whole words and stems (marked by a star) of a text, lower case."""
    words = {w for w in words_of(text.lower()) if len(w) > 2}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


class Grammar:
    """Scores a text's clauses: finds threats and insults by one automaton, then reads only the clauses that have some."""

    def __init__(self, insults: dict[str, float]):
        import ahocorasick

        self.insults, self.table = insults, compose()
        self.find = ahocorasick.Automaton()
        for w in {*insults, *THREATS}:
            self.find.add_word(w.rstrip("*"), w)
        self.find.make_automaton()
        self.empty = len(self.find) == 0

    def weight(self, word: str) -> float:
        return max([self.insults.get(word, 0.0), *(self.insults.get(word[:k] + "*", 0.0) for k in STEMS if len(word) > k)])

    def clause(self, words: list[str]) -> float:
        state = total = 0
        for w in words:
            kind = CLOSED.get(w, NEUTRAL)
            own = 0.0
            if kind == NEUTRAL and (own := self.weight(w)):
                kind = INSULT
            state, factor, add = self.table[state, kind]
            total += own * factor + add
        return total

    def features(self, text: str | None) -> list[float]:
        """Sum, largest and number of the matched clauses' weights, and their sum for each hundred words."""
        low = (text or "").lower()
        if not low or self.empty:
            return [0.0, 0.0, 0.0, 0.0]
        scores, done = [], 0
        for end, w in self.find.iter(low):
            start = end + 1 - len(w.rstrip("*"))
            if start < done or start and low[start - 1].isalnum() or w[-1] != "*" and end + 1 < len(low) and low[end + 1].isalnum():
                continue
            begin = max((low.rfind(c, done, start) + 1 for c in ".!?;\n"), default=0) or done
            stop = CLAUSE_END.search(low, end + 1)
            done = stop.end() if stop else len(low)
            scores.append(self.clause(words_of(low[begin:done])))
        scores = [s for s in scores if s > 0]
        if not scores:
            return [0.0, 0.0, 0.0, 0.0]
        n = low.count(" ") + 1
        return [float(np.log1p(sum(scores))), max(scores), float(min(len(scores), 5)), min(100 * sum(scores) / n, 20.0)]


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn_insults(sample: DataFrame) -> dict[str, float]:
    """Words and stems that go with the label far beyond chance, with their weights.

    sample(text, toxic) is bounded.  Documents are counted by term in Spark; a term stays if its log-likelihood ratio
    beats what the number of terms tried makes likely by chance, and most documents that have it are toxic.  A stem
    goes if its words alone say as much.
    """

    def run(batches):
        for batch in batches:
            yes, all_ = Counter(), Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = terms_of(text or "")
                all_.update(terms)
                if y:
                    yes.update(terms)
            names = list(all_)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([yes[t] for t in names], pa.int64()), pa.array([all_[t] for t in names], pa.int64())],
                ["term", "k", "n"]
            )

    counts = sample.groupBy(F.col("toxic").alias("y")).count().collect()
    total, toxic = sum(r["count"] for r in counts), sum(r["count"] for r in counts if r["y"])
    if not toxic or toxic == total:
        return {}
    p = toxic / total
    by_term = sample.select("text", "toxic").mapInArrow(run, "term string, k long, n long").groupBy("term").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    rate = F.col("k") / F.col("n")
    part = lambda k, q: F.when(k > 0, k * F.log(q)).otherwise(0.0)
    gain = 2 * (part(F.col("k"), rate / p) + part(F.col("n") - F.col("k"), (1 - rate) / (1 - p)))
    n_terms = by_term.where("n > 1").count()
    rows = (
        by_term.where("n > 2").withColumn("rate", rate).where(F.col("rate") > 0.5 * (1 + p)).withColumn("gain", gain)
        .where(F.col("gain") > 2 * float(np.log(max(n_terms, 2))) + 4).orderBy(F.desc("gain"), "term").collect()
    )
    found = {r["term"]: r for r in rows}
    out: dict[str, float] = {}
    for r in rows:
        t = r["term"]
        if t[-1] == "*":
            inside = [x for x in found if x != t and x.startswith(t[:-1])]
            if any(found[x]["k"] >= 0.9 * r["k"] for x in inside):
                continue
        out[t] = float(min(4.0, max(0.5, np.log((r["k"] + 0.5) / (r["n"] - r["k"] + 0.5)) - np.log(p / (1 - p)))))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, decay: float = 1e-3) -> np.ndarray:
    """Newton's method on the regularised logistic loss; the bias is last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + decay * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) / len(x) + decay * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Learned insults and the weights that turn a document's matches into a score; from MAX_LABELLED rows at most.

    The rows are chosen by hash among the labelled ones not held out; copies of one text count once.  An id, or a text,
    with two labels is toxic.  The sample is checkpointed, so whole texts are scanned for it once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = cut(mine.join(F.broadcast(some), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).repartition(8))
    grammar = Grammar(insults := learn_insults(sample))

    def run(batches):
        for batch in batches:
            x = [grammar_of(insults).features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.mapInArrow(run, "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in rows], float)
    if not len(rows) or y.min() == y.max():
        return {"insults": grammar.insults, "weights": np.array([1.0, 0.5, 0.5, 0.0, -2.0])}
    return {"insults": grammar.insults, "weights": fit_logistic(np.array([r["x"] for r in rows]), y)}


_GRAMMARS: dict[int, Grammar] = {}


def grammar_of(insults: dict[str, float]) -> Grammar:
    """One grammar for each worker and lexicon."""
    key = hash(frozenset(insults.items()))
    if key not in _GRAMMARS:
        _GRAMMARS.clear()
        _GRAMMARS[key] = Grammar(insults)
    return _GRAMMARS[key]


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted.  One pass, no shuffle; extra columns are ignored."""

    def run(batches):
        grammar, w = grammar_of(model["insults"]), model["weights"]
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = np.array([grammar.features(t) for t in part.column(1).to_pylist()]).reshape(-1, 4)
                s = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train, then score every document: doc_id, held_out, score, predicted.

    A null or empty text has no clause and the lowest score that the weights give; texts of any length are read whole;
    equal rows have equal scores; a null doc_id is not held out.  No rows in, no rows out.  Without labels, or with labels of
    one kind only, fixed weights score the threats.  Columns besides doc_id and text are ignored, whatever their names.
    """
    return score_documents(docs, train(docs, labels))


def op10(spark, sf_dir):
    from .common import table

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
