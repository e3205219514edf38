"""Near-duplicates by SimHash: a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, cut, small_batches

#: Fixed values of the result contract: words in a shingle, hash seed, bits that linked fingerprints may differ in.
SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Byte positions of a fingerprint, and the bytes that two linked ones share at their positions at least.
POSITIONS = 8
MIN_SHARED = POSITIONS - MAX_BITS
#: The posting lists: every choice of INDEXED positions, a byte fewer than must match, so the tally has pairs to drop.
INDEXED = MIN_SHARED - 1
CHOICES = list(combinations(range(POSITIONS), INDEXED))
#: Members of a list that are compared with one another; those of a longer one are linked by their single-bit variants.
LONG = 256


def fingerprint(text: str | None) -> bytes:
    """The 64 bits, most significant first; eight zero bytes without a word."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)])
    bits = np.zeros(64, np.int64)
    hashes = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    for at in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * bits > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, and ``more`` long columns as they are."""

    def run(batches):
        for batch in batches:
            raw = b"".join(map(fingerprint, batch.column(1).to_pylist()))
            names = ["doc_id", "fp", *batch.schema.names[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64)), *batch.columns[2:]], names)

    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    return own.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in own.columns[2:])]))


def postings(distinct: DataFrame) -> DataFrame:
    """(fp, key): one posting for each choice of INDEXED byte positions, its key the choice and the bytes there."""
    at = lambda p: F.shiftrightunsigned("fp", 8 * (POSITIONS - 1 - p)).bitwiseAND(F.lit(255).cast("long"))
    keys = []
    for number, choice in enumerate(CHOICES):
        key = F.lit(number).cast("long")
        for p in choice:
            key = F.shiftleft(key, 8).bitwiseOR(at(p))
        keys.append(key)
    return distinct.select("fp", F.explode(F.array(*keys)).alias("key"))


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally of a pair: positions at which both have the same byte.  Every byte's lowest bit becomes the or of its bits."""
    x = a.bitwiseXOR(b)
    for step in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, step))
    return F.lit(POSITIONS) - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def linked(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def by_lists(met: DataFrame) -> DataFrame:
    """(a, b) of the lists in ``met(fp, key)``: pairs of a list are tallied, those that reach MIN_SHARED are verified."""
    members = met.groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    own = members.select(F.posexplode("fps").alias("i", "a"), "fps").select("a", F.slice("fps", F.col("i") + 2, F.size("fps")).alias("after"))
    kept = F.filter("after", lambda b: shared_bytes(F.col("a"), b) >= MIN_SHARED)
    return own.select("a", F.explode(F.filter(kept, lambda b: linked(F.col("a"), b))).alias("b"))


def by_variants(hot: DataFrame) -> DataFrame:
    """(a, b): all linked pairs of ``hot(fp)``, however many share bytes.

    A fingerprint posts itself and its 64 single-bit variants.  Two that differ in one or two bits have a variant in
    common, and what shares one differs in two bits at most, so a list has 65 members and each of its pairs is linked.
    """
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)))
    met = hot.withColumn("flip", F.explode(flips)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    return by_lists(met)


def candidates(distinct: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of ``distinct(fp)`` that reach the minimum of shared positional bytes, and are linked.

    Two of the bytes may differ, so MIN_SHARED match.  Pairs that share INDEXED bytes meet in a list; the tally over all
    positions drops those that share no more, and only then bits are compared, so one row leaves a list for each linked
    pair in it.  Lists of single bytes would be quadratic in the corpus.  A list of more than LONG members isn't compared
    pair by pair: its members are linked by variants, which takes 65 rows each and finds the same pairs.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    met = cut(postings(distinct).withColumn("n", n).where("n > 1"))
    short, hot = met.where(F.col("n") <= LONG).select("fp", "key"), met.where(F.col("n") > LONG).select("fp").distinct()
    pairs = by_lists(short).union(by_variants(hot)).distinct()
    return pairs.select("a", "b", shared_bytes(F.col("a"), F.col("b")).alias("shared"))


def links(distinct: DataFrame) -> DataFrame:
    """All pairs (a, b) of different fingerprints that differ in MAX_BITS bits or fewer."""
    return candidates(distinct).select("a", "b")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable), group_size.

    Documents without a word, null ones too, have fingerprint zero and are linked like others.  Texts of any length are
    read whole.  A bit that half of the shingles set, no more, is 0.  Only distinct fingerprints are indexed, so copies
    cost one row; repeated rows are rows of one component; an empty table gives no rows; a null doc_id keeps its row and
    never names a component that has another.  Columns besides doc_id and text are ignored, whatever their names.
    """
    prints = cut(fingerprints(docs))  # 16 bytes a document, read by several steps
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = components(links(distinct.select("fp"))).distinct()
    groups = distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "least", "n")
    smallest = groups.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    of = groups.join(smallest, "component").select("fp", "component_id", "group_size")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The input's rows that stay: of each component the one with the smallest doc_id, and one without id only where
    no other has one.  Rows are told apart by id and a hash of the text together; rows that repeat both stay together.
    An empty table gives none; other columns stay as they are.
    """
    mark = F.xxhash64("text", F.octet_length("text"))
    prints = cut(fingerprints(docs, mark.alias("mark")))
    rank = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark"))
    distinct = prints.groupBy("fp").agg(rank.alias("best"))
    nodes = components(links(distinct.select("fp"))).distinct()
    groups = distinct.join(nodes, distinct.fp == nodes.node, "left").select(F.coalesce("component", "fp").alias("component"), "best")
    kept = groups.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("_kept_id"), F.col("best.mark").alias("_kept_mark"))
    same = [F.col("_own_id").eqNullSafe(F.col("_kept_id")), F.col("_own_mark") == F.col("_kept_mark")]
    return docs.withColumns({"_own_id": F.col("doc_id").cast("long"), "_own_mark": mark}).join(kept, same, "left_semi").drop("_own_id", "_own_mark")


def op4(spark, sf_dir):
    from .common import table

    return simhash_dedup(table(spark, sf_dir, "documents"))
