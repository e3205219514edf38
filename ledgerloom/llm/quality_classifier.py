"""Document quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled rows; the unlabelled rows are all documents that aren't held out.  Labels of 0 are never
read.  What the fit needs of the unlabelled rows are sums over all of them (gradient, curvature, loss, a histogram), so a
step is one distributed pass over the packed features, of some 150 bytes a document, and nothing is sampled there.

1. a logistic score tells positives from unlabelled rows on one half of both;
2. the class prior is the least ratio of the unlabelled rows' share above a threshold to the positives', on the other half,
   where few positives make a threshold dear by their confidence bound;
3. the risk prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]) is minimised by damped Newton steps.
"""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Bound of what is learned from labelled rows: trusted positives.
MAX_POSITIVE = 8_000
#: Newton steps of a fit, at most, the change that ends it, and the weight of the squared weights.
STEPS, CLOSE, DECAY = 25, 1e-6, 1e-4
#: Thresholds of the prior's estimate, and how surely its bounds hold.
BINS, DELTA = 4096, 0.1

#: Bytes counted together; each group is a feature, as a share of all bytes.
GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)),
    "digit": b"0123456789",
    "space": b" \t\x0b\x0c\r",
    "line": b"\n",
    "stop": b".",
    "comma": b",;:",
    "bang": b"!?",
    "quote": b"'\"`",
    "bracket": b"()[]{}",
    "symbol": b"#*$%&@~^_=+\\",
    "bar": b"|<>/",
}
NAMES = [*GROUPS, "repeat_next", "distinct_words", "repeat_lines", "word_length", "line_words", "words"]


def _group_matrix() -> np.ndarray:
    m = np.zeros((256, len(GROUPS)))
    for k, own in enumerate(GROUPS.values()):
        m[list(own), k] = 1
    return m


def features(texts: list[str | None]) -> np.ndarray:
    """What the style of a whole text shows: byte shares, repeats and lengths.  An empty text is all zeros."""
    groups, out = _group_matrix(), np.zeros((len(texts), len(NAMES)))
    k = len(GROUPS)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        out[i, :k] = np.sqrt(np.bincount(raw, minlength=256) @ groups / len(raw))
        words = text.split()
        lines = [x for x in text.split("\n") if x]
        n = len(words)
        if n:
            out[i, k] = np.sqrt(sum(map(eq, words, words[1:])) / n)
            out[i, k + 1] = len(set(words)) / n
            out[i, k + 2] = 1 - len(set(lines)) / max(1, len(lines))
            out[i, k + 3] = min(len(raw) / n, 40) / 10
            out[i, k + 4] = np.log1p(n / max(1, len(lines))) / 5
            out[i, k + 5] = np.log1p(n) / 10
    return out


sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
loss = lambda z: np.logaddexp(0, -z)


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def negative_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of rows taken for negatives: their number, loss, gradient and curvature, as one row of numbers."""
    x = with_bias(x)
    z = x @ w
    p = sigma(z)
    return np.concatenate(([len(x), loss(-z).sum()], x.T @ p, ((x * (p * (1 - p))[:, None]).T @ x).ravel()))


def fit(positive: np.ndarray, unlabelled, prior: float | None) -> np.ndarray:
    """Weights (bias last) of a linear score.  unlabelled(w) gives negative_sums() over all unlabelled rows.

    With a prior: the non-negative unbiased risk.  For the logistic loss l(z) - l(-z) = -z, so while the second part of
    the risk is positive it is convex and Newton's step is used; where it falls below zero, the score has fitted the
    unlabelled rows too closely, and a step along that part's own gradient undoes it.  Without: the plain logistic loss
    of positives against unlabelled rows.
    """
    x_p = with_bias(positive)
    d = x_p.shape[1]
    w, ridge = np.zeros(d), DECAY * np.eye(d)
    mean_p = x_p.mean(axis=0)
    for _ in range(STEPS):
        z_p = x_p @ w
        n, l_u, *rest = unlabelled(w)
        g_u, h_u = np.array(rest[:d]) / n, np.array(rest[d:]).reshape(d, d) / n
        if prior is None:
            p = sigma(z_p)
            g = g_u - x_p.T @ (1 - p) / len(x_p) + DECAY * w
            h = h_u + (x_p * (p * (1 - p))[:, None]).T @ x_p / len(x_p) + ridge
        else:
            if l_u / n - prior * loss(-z_p).mean() < 0:
                w = w + 0.05 * (g_u - prior * x_p.T @ sigma(z_p) / len(x_p))
                continue
            g, h = g_u - prior * mean_p + DECAY * w, h_u + ridge
        step = np.linalg.solve(h, g)
        size = float(np.abs(step).max())
        w = w - step * min(1.0, 2.0 / max(size, 1e-12))
        if size < CLOSE:
            break
    return w


def estimate_prior(shares: np.ndarray, n: int, positive: np.ndarray) -> float:
    """The share of positives among unlabelled rows.  shares: how many of n unlabelled rows fall in each of BINS bins of
    the score; positive: the scores of positives that the score wasn't fitted to."""
    above_u = np.cumsum(shares[::-1])[::-1] / n
    bins = np.minimum((positive * BINS).astype(np.int64), BINS - 1)
    above_p = np.cumsum(np.bincount(bins, minlength=BINS)[::-1])[::-1] / len(positive)
    some = above_p > 0
    slack = np.sqrt(np.log(4 / DELTA) / 2) * (n**-0.5 + len(positive) ** -0.5)
    bound = (above_u[some] + 1.01 * slack) / above_p[some]
    best = int(np.argmin(bound))
    return float(np.clip(above_u[some][best] / above_p[some][best], 0.01, 0.99))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def packed_features(docs: DataFrame) -> DataFrame:
    """The features of all documents, a batch a row: ids, held_out, half (of the text) and x."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = features(part.column(1).to_pylist())
                half = np.array([zlib.crc32(r) >> 5 & 1 for r in x], np.uint8)
                ids, held = part.column(0), part.column(2).cast(pa.uint8()).to_numpy(zero_copy_only=False)
                blobs = [pa.array([c.tobytes()], pa.binary()) for c in (held, half, x)]
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), *blobs], ["ids", "held", "half", "x"])

    small_batches(docs.sparkSession)
    held = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))
    return cut(own.mapInArrow(run, "ids array<long>, held binary, half binary, x binary"))


def _matrix(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(-1, len(NAMES))


def sums(packed: DataFrame, of, half: int | None = None) -> np.ndarray | None:
    """The sum of of(x), a row of numbers, over all unlabelled rows (of one half); partial sums are added in Spark."""

    def run(batches):
        acc = None
        for batch in batches:
            for held, halves, x in zip(*(batch.column(c).to_pylist() for c in ("held", "half", "x")), strict=True):
                own = np.frombuffer(held, np.uint8) == 0
                if half is not None:
                    own = own & (np.frombuffer(halves, np.uint8) == half)
                if own.any():
                    more = of(_matrix(x)[own])
                    acc = more if acc is None else acc + more
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([acc.tolist()], pa.list_(pa.float64()))], ["v"])

    rows = packed.mapInArrow(run, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["pos"])]) if rows else None


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of MAX_POSITIVE labelled positives at most, chosen by hash among those not held out; an id's label is
    its largest one, a null label is none."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    good = known.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & (F.col("y") == 1)).select("doc_id").distinct()
    some = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_POSITIVE)
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mine.join(F.broadcast(some), "doc_id")


def train(docs: DataFrame, labels: DataFrame, packed: DataFrame | None = None) -> dict:
    """The model: scale, shift, weights and prior, or only a constant where there are no positives to learn from."""
    packed = packed_features(docs) if packed is None else packed

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in features(batch.column(0).to_pylist())], pa.binary())], ["x"])

    found = trusted(docs, labels).select("text").mapInArrow(run, "x binary").collect()
    d = len(NAMES)
    moments = sums(packed, lambda x: np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0))))
    if not found or moments is None:
        return {"constant": 0.5}
    n = moments[0]
    shift = moments[1 : d + 1] / n
    scale = np.sqrt(np.maximum(moments[d + 1 :] / n - shift**2, 0)) + 1e-3
    norm = lambda x: (x - shift) / scale
    x_p = np.stack([np.frombuffer(r["x"], np.float64) for r in found])
    side = np.array([zlib.crc32(r) >> 5 & 1 for r in x_p])
    x_p = norm(x_p)
    over = lambda half: lambda w: sums(packed, lambda x: negative_sums(norm(x), w), half)
    prior = 0.5
    if (side == 0).any() and (side == 1).any() and (
        n_other := sums(packed, lambda x: np.array([len(x)]), 1)
    ) is not None and sums(packed, lambda x: np.ones(1), 0) is not None:
        g = fit(x_p[side == 0], over(0), None)
        score = lambda x: sigma(with_bias(x) @ g)
        share = lambda x: np.bincount(np.minimum((score(norm(x)) * BINS).astype(np.int64), BINS - 1), minlength=BINS)
        prior = estimate_prior(sums(packed, share, 1), int(n_other[0]), score(x_p[side == 1]))
    return {"shift": shift, "scale": scale, "weights": fit(x_p, over(None), prior), "prior": prior}


def _scores(x: np.ndarray, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    z = (x - model["shift"]) / model["scale"]
    return sigma(z @ model["weights"][:-1] + model["weights"][-1])


def scores(texts: list[str | None], model: dict) -> np.ndarray:
    return _scores(features(texts), model)


def score_packed(packed: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted of every document of packed_features()."""

    def run(batches):
        for batch in batches:
            for ids, held, x in zip(*(batch.column(c).to_pylist() for c in ("ids", "held", "x")), strict=True):
                s = _scores(_matrix(x), model)
                columns = [pa.array(ids, pa.int64()), pa.array(np.frombuffer(held, np.uint8) == 1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return packed.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train, then score every document: one row per row, doc_id, held_out, score, predicted.

    Null and empty texts have a score like any other, texts of any length are read whole, equal rows have equal scores, a
    null id is not held out.  No rows in, no rows out; without positives every score is 0.5.  Columns besides doc_id and
    text are ignored, whatever their names.  Features are computed once and checkpointed; nothing is shuffled but sums.
    """
    packed = packed_features(docs)
    return score_packed(packed, train(docs, labels, packed))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The input's rows that are predicted good, with all their columns.  Each row goes by its own text's score, so rows
    without id, or of one id with different texts, are judged like any other.  No rows in, no rows out.  No shuffle."""
    model, at = train(docs, labels), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                yield part.filter(pa.array(scores(part.column(at).to_pylist(), model) >= 0.5))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op6(spark, sf_dir):
    from .common import table

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
