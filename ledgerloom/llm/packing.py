"""Packing of token pieces into fixed sequences by cutting-stock column generation."""

from __future__ import annotations

import os
import warnings
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, give_back, partitions_for, small_batches

#: Fixed values of the result contract: tokens in a sequence, the id that ends a document.
CAPACITY, END = 4096, 2
#: Lengths are planned in steps of so many tokens, so the linear program has CAPACITY / STEP rows whatever the input.
STEP = 16
#: Distinct words one worker remembers.
REMEMBERED = 250_000


class WordIds(dict):
    """Ids of whole texts by the tokenizers library, each distinct word (text between white space) encoded once.

    The vocabulary's pieces never cross white space and its normaliser drops it, so words are independent.  For a word
    of Latin letters the normaliser only lowers case; such a word is split here and goes straight to the BPE model.
    All others, and what looks like a special token, take the library's whole path.
    """

    #: Fixed value: the vocabulary's own pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, vocabulary_file: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        from .bpe_codec import byte_alphabet

        self.split = regex.compile(self.PATTERN)
        self.odd = regex.compile(r"[^\x00-\u024F]|\u0130|<\||[\x1C-\x1F]")
        self.stand_in = {b: c for c, b in byte_alphabet().items()}
        self.model = Tokenizer.from_file(vocabulary_file)
        self.model.no_truncation()
        self.model.no_padding()
        self.tokenize = self.model.model.tokenize
        self.tails = {c: self._ids(c) for c in ".,;:!?"}

    def _ids(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.stand_in)
        return array("I", [t.id for t in self.tokenize(part)]).tobytes()

    def _word(self, word: str) -> bytes:
        core, tail = word, b""
        if not word.isalpha() and word[-1] in self.tails and word[:-1].isalpha():
            core, tail = word[:-1], self.tails[word[-1]]
        if self.odd.search(core) or len(core) > 200:
            return array("I", self.model.encode(word, add_special_tokens=False).ids).tobytes()
        if core.isalpha():
            low = core.lower()
            known = self.get(low) if tail or low != word else None
            return (known or self._ids(low)) + tail
        return b"".join(map(self._ids, self.split.findall(core.lower()))) + tail

    def __missing__(self, word: str) -> bytes:
        ids = self._word(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with END behind."""
        end, get, out = END.to_bytes(4, "little"), self.__getitem__, []
        for text in texts:
            # Python also splits at four controls that are no white space to the library
            words = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else [text]
            out.append(b"".join(map(get, words)) + end)
        return out


@lru_cache(maxsize=1)
def _of(vocabulary_file: str) -> WordIds:
    return WordIds(vocabulary_file)


def pieces(docs: DataFrame, vocabulary_file: str, with_ids: bool = False) -> DataFrame:
    """Documents cut at every CAPACITY tokens: doc_id, start, length, ids_crc32, doc_tokens (and ids, if asked for)."""

    def run(batches):
        encode = _of(vocabulary_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    n = len(ids) // 4
                    for start in range(0, n, CAPACITY):
                        own = ids[4 * start : 4 * (start + CAPACITY)]
                        rows.append((doc_id, start, len(own) // 4, zlib.crc32(own), n, own if with_ids else None))
                columns = list(zip(*rows, strict=True))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
                if with_ids:
                    names, arrays = [*names, "ids"], [*arrays, pa.array(columns[5], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names)
        give_back()

    small_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def best_patterns(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: for each size, the pattern (items of each size) of most value among those with an item
    of it that fit the capacity, and their values; the best of them is the best of all.  Sizes are in rising order."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            totals = best[c - sizes[: fits[c]]] + values[: fits[c]]
            k = int(totals.argmax())
            if totals[k] > best[c] + 1e-12:
                best[c], took[c] = totals[k], k
    patterns = np.eye(len(sizes), dtype=np.int64)
    for k, own in enumerate(patterns):
        c = capacity - int(sizes[k])
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                own[took[c]] += 1
                c -= int(sizes[took[c]])
    return values + best[capacity - sizes], patterns


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Inverse by elimination with row pivots, in elementwise steps: threaded BLAS on a driver beside a JVM can stall, and a
    matrix has CAPACITY / STEP rows at most."""
    m = len(matrix)
    both = np.hstack([matrix, np.eye(m)])
    for k in range(m):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        if pivot != k:
            both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        others = both[:, k].copy()
        others[k] = 0
        rows = np.flatnonzero(others)
        both[rows] -= others[rows, None] * both[k]
    return both[:, m:]


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most value that fits the capacity."""
    worth, patterns = best_patterns(values, sizes, capacity)
    return float(worth.max()), patterns[int(worth.argmax())]


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_rounds: int = 1000) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns and how often each is used, in the linear relaxation of covering the demand with fewest sequences.

    Revised simplex: it starts with one pattern for each size; the dual prices of the basis go to the knapsack, whose
    patterns, one for each size, enter the basis from the most worth on, as long as they are worth more than a sequence by
    then, each for the pattern that first reaches zero.  Prices of a basis jump, so the knapsack sees them drawn towards the
    prices that gave the best lower bound so far, at first each size's share of a sequence, and less so whenever that finds
    nothing.  It ends when no pattern is worth more than a sequence at the basis's own prices.  Should max_rounds come
    first, the patterns are valid and cover the demand, with more padding than need be; a warning says so.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / (capacity // sizes))
    used = demand * inverse.diagonal()
    centre, bound, pull, since = sizes / capacity, 0.0, 0.9, 0
    for _ in range(max_rounds):
        prices = inverse.sum(axis=0)
        seen = pull * centre + (1 - pull) * prices
        worth, patterns = best_patterns(seen, sizes, capacity)
        best = worth.max(initial=0)
        if pull == 0 and best <= 1 + 1e-7:
            break
        if (lower := float((seen * demand).sum()) / max(1.0, best)) > bound:
            centre, bound = seen / max(1.0, best), lower
        entered = 0
        for pattern in patterns[np.argsort(-worth, kind="stable")]:
            some = np.flatnonzero(pattern)
            if (prices[some] * pattern[some]).sum() <= 1 + 1e-7:
                continue
            step = (inverse[:, some] * pattern[some]).sum(axis=1)
            rows = np.flatnonzero(step > 1e-9)
            leaves = rows[np.argmin(used[rows] / step[rows])]
            t = used[leaves] / step[leaves]
            used = used - t * step
            used[leaves] = t
            basis[:, leaves] = pattern
            row = inverse[leaves] / step[leaves]
            inverse = inverse - step[:, None] * row
            inverse[leaves] = row
            prices = inverse.sum(axis=0)
            entered += 1
        if entered:
            since += entered
            if since > 400:
                inverse, since = inverted(basis), 0
                used = np.maximum((inverse * demand).sum(axis=1), 0)
            pull = max(pull, 0.5)
        else:
            pull = pull / 2 if pull > 0.05 else 0.0
    else:
        warnings.warn(f"column generation stopped after {max_rounds} rounds, a pattern is still worth {best:.6f}", stacklevel=2)
    return [basis[:, j].round().astype(np.int64) for j in range(m)], np.maximum(used, 0)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, step: int = STEP) -> list[tuple[int, int, int, int, int]]:
    """Which sequences take the pieces of each size class: rows (class, first rank, last rank, items a sequence, first sequence).

    Full use of the linear program's patterns is rounded down; what is left (fewer pieces than classes times the items
    of a pattern) goes first-fit by falling size.  Everything here depends on the number of classes, not of documents.
    """
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    units = capacity // step
    uses: list[tuple[np.ndarray, int]] = []
    if len(sizes):
        for pattern, x in zip(*column_generation(sizes, left.astype(float), units), strict=True):
            pattern = np.minimum(pattern, left)
            times = int(x + 1e-6)
            if pattern.any():
                times = min(times, int((left[pattern > 0] // pattern[pattern > 0]).min()))
                if times > 0:
                    uses.append((pattern, times))
                    left = left - times * pattern
        bins: list[list] = []
        for k in range(len(sizes) - 1, -1, -1):
            for _ in range(int(left[k])):
                home = next((b for b in bins if b[0] >= sizes[k]), None)
                if home is None:
                    bins.append(home := [units, np.zeros(len(sizes), np.int64)])
                home[0] -= int(sizes[k])
                home[1][k] += 1
        uses += [(b[1], 1) for b in bins]
    rows, rank, sequence = [], np.zeros(len(sizes), np.int64), 0
    for pattern, times in uses:
        for k in np.flatnonzero(pattern):
            n = int(pattern[k]) * times
            rows.append((int(sizes[k]), int(rank[k]), int(rank[k]) + n - 1, int(pattern[k]), sequence))
            rank[k] += n
        sequence += times
    return rows


def assign(parts: DataFrame) -> DataFrame:
    """sequence_id and offset for every piece.

    The histogram of size classes (CAPACITY / STEP rows at most) goes to the driver and the plan, as small, comes back
    by broadcast.  A piece's rank in its class is its rank in its bucket and the count of the buckets before, so even a
    class that holds most pieces is ranked by as many tasks as there are buckets.
    """
    spark = parts.sparkSession
    sized = parts.withColumn("_class", F.ceil(F.col("length") / STEP).cast("int"))
    buckets = partitions_for(spark)
    sized = sized.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    histogram = {r["_class"]: r["n"] for r in sized.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(histogram)
    schema = "_c int, _from long, _to long, _items int, _first long"
    planned = spark.createDataFrame(rows, schema)
    counts = sized.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_class", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_class", "_bucket").orderBy("doc_id", "start", "length", "ids_crc32", "doc_tokens")  # ties beyond these are equal pieces
    ranked = sized.withColumn("_rank", F.row_number().over(own) - 1).join(bases, ["_class", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    placed = ranked.join(F.broadcast(planned), (F.col("_class") == F.col("_c")) & F.col("_rank").between(F.col("_from"), F.col("_to")))
    placed = placed.withColumn("sequence_id", F.col("_first") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_items")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("offset", F.sum("length").over(inside) - F.col("length"))
    return out.select(*(c for c in parts.columns if c != "ids"), "sequence_id", "offset", *(c for c in parts.columns if c == "ids"))


def pack(docs: DataFrame, vocabulary_file: str, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A null text is an empty one, and an empty document is the one id END.  Documents longer than a sequence are cut at
    every CAPACITY ids; others stay whole.  Repeated rows are packed once each.  No documents, no pieces.  Extra columns
    are ignored.  The pieces (some fifty bytes a document without ids) are checkpointed, so texts are encoded once.
    """
    return assign(cut(pieces(docs, vocabulary_file, with_ids)))


def op7(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
