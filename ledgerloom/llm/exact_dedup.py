"""Exact duplicates by a tree-merge of sorted digest runs.

1. runs: each input partition sorts its texts' digests to runs, one for each slice of the digest space;
2. rounds: the runs of a slice form a binomial tree over the partitions' numbers.  In round r, the partitions whose
   number has bit r set hand their run to the one without it, which merges all that it then holds of the slice; equal
   digests become one entry with the winning identifier and the number of rows;
3. after the last round each slice has one run; entries of more than one row are joined back to the rows.

Slices are as many as keep a root at SLICE_ROWS entries, so no round gathers the corpus in a task, and copies leave a
partition as one entry.  A text's identity is SHA-256, verified in every merge by its length and XXH64: entries are one
only if all three are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions_for, small_batches
from .packed import loosen, runs_of, squeeze

KEY = ["digest", "n_bytes", "check"]
#: Bytes of a packed key: SHA-256, length, XXH64.
WIDTH = 32 + 8 + 8
#: Entries of a slice's root run, about; rows that a partition sorts at a time.
SLICE_ROWS, SORTED_ROWS = 1 << 18, 1 << 17
#: A text with more than this share of all rows is joined by broadcast: fewer than so many texts can have it.
HOT_SHARE = 4096


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the three parts of a text's identity, and the input partition."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("check"),
        F.spark_partition_id().alias("run"),
    )


def collapsed(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, keep: str) -> tuple[np.ndarray, ...]:
    """A sorted run with one entry for equal keys: the winning id and all rows."""
    at = runs_of(keys)
    pick = np.maximum if keep == "max" else np.minimum
    return keys[at], pick.reduceat(ids, at), np.add.reduceat(counts, at)


def merged(runs: list[tuple[np.ndarray, ...]], keep: str) -> tuple[np.ndarray, ...]:
    """Multiway merge of sorted runs, the two shortest first; an entry's place is its own and its rank in the other run."""
    runs = sorted(runs, key=lambda r: len(r[0]))
    while len(runs) > 1:
        a, b = runs[0], runs[1]
        at_b = np.searchsorted(a[0], b[0], "right") + np.arange(len(b[0]))
        from_b = np.zeros(len(a[0]) + len(b[0]), bool)
        from_b[at_b] = True
        columns = []
        for x, y in zip(a, b, strict=True):
            z = np.empty(len(from_b), x.dtype)
            z[from_b], z[~from_b] = y, x
            columns.append(z)
        runs = sorted([*runs[2:], collapsed(*columns, keep)], key=lambda r: len(r[0]))
    return runs[0]


def _nobody(keep: str) -> int:
    """Stands for a null id, which never wins over another."""
    return -(1 << 63) if keep == "max" else (1 << 63) - 1


def digest_runs(rows: DataFrame, slices: int, keep: str) -> DataFrame:
    """(slice, run, blob): the sorted runs of each partition, several where it has more than SORTED_ROWS rows."""

    def run(batches):
        waiting, n = [], 0

        def flush():
            table = pa.Table.from_batches(waiting)
            digest = np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
            rest = [table.column(c).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8) for c in ("n_bytes", "check")]
            keys = np.ascontiguousarray(np.hstack([digest, *rest])).view(f"S{WIDTH}").ravel()
            ids = table.column("doc_id").fill_null(_nobody(keep)).to_numpy()
            order = np.argsort(keys, kind="stable")
            found = collapsed(keys[order], ids[order], np.ones(len(order), np.int64), keep)
            first = digest[order[runs_of(keys[order])], :4].copy().view(">u4").ravel().astype(np.int64)
            edges = np.searchsorted(first * slices >> 32, np.arange(slices + 1))
            out = [(k, s, e) for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s]
            blobs = [squeeze(*(c[s:e] for c in found)) for _, s, e in out]
            number = table.column("run")[0].as_py()
            columns = [pa.array([k for k, _, _ in out], pa.int32()), pa.array([number] * len(out), pa.int32()), pa.array(blobs, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["slice", "run", "blob"])

        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= SORTED_ROWS:
                yield flush()
                waiting, n = [], 0
        if n:
            yield flush()

    return rows.mapInArrow(run, "slice int, run int, blob binary")


def tree_merge(runs: DataFrame, n_runs: int, keep: str = "max") -> DataFrame:
    """The binomial rounds: one run for each slice is left."""

    def merge(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        found = merged([tuple(loosen(b, f"S{WIDTH}", np.int64, np.int64)) for b in blobs], keep) if len(blobs) > 1 else None
        return pa.table({
            "slice": pa.array([table.column("slice")[0].as_py()], pa.int32()),
            "run": pa.array([table.column("to")[0].as_py()], pa.int32()),
            "blob": pa.array([squeeze(*found) if found else blobs[0]], pa.binary()),
        })

    for r in range(max(1, (max(n_runs, 1) - 1).bit_length())):
        receiver = F.col("run").bitwiseAND(F.lit(~(1 << r)))
        runs = runs.withColumn("to", receiver).groupBy("slice", "to").applyInArrow(merge, "slice int, run int, blob binary")
    return runs


def copies(roots: DataFrame, keep: str, at_least: int = 2) -> DataFrame:
    """The roots' entries of ``at_least`` rows: digest, n_bytes, check, keep_id, group_size."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                keys, ids, counts = loosen(blob, f"S{WIDTH}", np.int64, np.int64)
                some = np.flatnonzero(counts >= at_least)
                raw = np.frombuffer(keys.tobytes(), np.uint8).reshape(-1, WIDTH)[some]
                number = lambda s: pa.array(raw[:, s : s + 8].copy().view(">i8").ravel().astype(np.int64))
                digest = pa.array([bytes(x) for x in raw[:, :32]], pa.binary())
                null = ids[some] == _nobody(keep)
                columns = [digest, number(32), number(40), pa.array(ids[some], mask=null), pa.array(counts[some])]
                yield pa.RecordBatch.from_arrays(columns, [*KEY, "keep_id", "group_size"])

    return roots.mapInArrow(run, "digest binary, n_bytes long, check long, keep_id long, group_size long")


def merged_groups(rows: DataFrame, n_rows: int, n_runs: int, keep: str, at_least: int = 2) -> DataFrame:
    slices = partitions_for(rows.sparkSession, -(-n_rows // SLICE_ROWS))
    return copies(tree_merge(digest_runs(rows, slices, keep), n_runs, keep), keep, at_least)


def _sized(rows: DataFrame) -> tuple[int, int]:
    n, last = rows.agg(F.count(F.lit(1)), F.max("run")).first()
    return n, (last or 0) + 1


def exact_dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text equals an empty one.  Of equal texts the largest doc_id stays (keep="min": the smallest).  Rows that
    repeat both id and text share the verdict, and a null id never wins over another.  Texts of any length are one
    digest.  No rows in, no rows out.  Columns besides doc_id and text are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    rows = cut(digests(docs))  # some sixty bytes a row, read by the merge and by the join back
    n_rows, n_runs = _sized(rows)
    groups = cut(merged_groups(rows, n_rows, n_runs, keep))
    hot = F.broadcast(groups.where(F.col("group_size") * HOT_SHARE > n_rows))  # fewer than HOT_SHARE rows
    cold = groups.where(F.col("group_size") * HOT_SHARE <= n_rows)
    rows = rows.drop("run")
    both = rows.join(hot, KEY).unionByName(rows.join(hot, KEY, "left_anti").join(cold, KEY, "left"), allowMissingColumns=True)
    alone = F.col("group_size").isNull()
    return both.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("keep_id", "doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull())).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The input's rows that stay, with all their columns: of each text one row, with the id that exact_dedup keeps.

    Rows are told apart by id and text together, so rows that share an id, or have none, but differ in text all stay.
    Of a text that only rows without id have, one of them stays; those are made one in each partition before the join,
    so many of them don't meet in one task.  Texts are shuffled once: the join and the last step share their key.
    """
    small_batches(docs.sparkSession)
    found = cut(digests(docs))
    n_rows, n_runs = _sized(found)
    who = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    kept = merged_groups(found, n_rows, n_runs, keep, 1).select(*(F.col(c).alias(f"_own_{c}") for c in KEY), who("keep_id").alias("_own_who"))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = {"_own_digest": F.unhex(F.sha2(text.cast("binary"), 256)), "_own_n_bytes": F.octet_length(text).cast("long"), "_own_check": F.xxhash64(text)}
    rows = docs.withColumns(own).withColumn("_own_who", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")))
    own = [*own, "_own_who"]
    nameless = F.col("_own_who") == "none"
    rows = rows.where(~nameless).unionByName(rows.where(nameless).dropDuplicates(own))
    return rows.join(kept, own, "left_semi").dropDuplicates(own).drop(*own)


def op9(spark, sf_dir):
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
