"""Product codes of vectors: exact integer codebooks, nearest entries by exponion search."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, table

#: Fixed values of the result contract.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of the limbs that sums travel in, so that sums of any size stay exact.
LIMB = 32
#: A label with more than a row in so many is joined by broadcast: fewer than HEAVY labels have that.
HEAVY = 4096


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite floats: 64-bit integers, or Python's where they might not do for squares."""
    if not values.size or np.abs(values).max() < 2.0**18:
        return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)
    whole = [int(x) * SCALE if abs(x) > 2.0**60 else int(np.floor(x * SCALE)) for x in values.astype(np.float64).ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(values.shape)


def cuts(width: int) -> list[int]:
    """Where the PARTS consecutive parts of a vector begin and end; equal when the width is a multiple of PARTS."""
    return [width * k // PARTS for k in range(PARTS + 1)]


class Codebook:
    """One part's entries, each with the other entries by rising distance (ties to the lower index)."""

    def __init__(self, entries: list[list[int]]):
        wide = max((abs(x) for e in entries for x in e), default=0) >= 1 << 26
        self.entries = np.array(entries, object if wide else np.int64).reshape(len(entries), -1)
        gaps = self.entries[:, None, :] - self.entries[None, :, :]
        gaps = (gaps * gaps).sum(axis=2) if self.entries.shape[1] else np.zeros((len(entries), len(entries)), np.int64)
        rank = [sorted((j for j in range(len(entries)) if j != i), key=lambda j: (gaps[i, j], j)) for i in range(len(entries))]
        self.order = np.array(rank, np.int64).reshape(len(entries), -1)
        self.sorted = np.take_along_axis(gaps, self.order, axis=1)

    def to(self, vectors: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = vectors - self.entries[entry]
        return (gap * gap).sum(axis=1) if gap.shape[1] else np.zeros(len(gap), np.int64)

    def nearest(self, vectors: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry, the lower index of equal ones.

        An entry as near as ``start`` or nearer lies within twice the distance to ``start`` of it, so only that much of
        its list of neighbours is scanned: squared, four times the squared distance.
        """
        best, entry = self.to(vectors, start), start.copy()
        if self.order.shape[1] == 0 or not len(vectors):
            return entry, best
        reach = np.zeros(len(vectors), np.int64)
        for a in np.unique(start).tolist():
            own = np.flatnonzero(start == a)
            reach[own] = np.searchsorted(self.sorted[a], 4 * best[own], "right")
        rows = np.argsort(-reach, kind="stable")  # those that scan on are always the first
        ends = np.searchsorted(-reach[rows], -np.arange(1, reach.max(initial=0) + 1), "right")
        for k, n in enumerate(ends.tolist()):
            on = rows[:n]
            other = self.order[start[on], k]
            far = self.to(vectors[on], other)
            better = (far < best[on]) | ((far == best[on]) & (other < entry[on]))
            on = on[better]
            best[on], entry[on] = far[better], other[better]
        return entry, best


def matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return integers(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width))


def assigned(vectors: DataFrame, books: list[list[list[int]]], width: int) -> DataFrame:
    """vec_id, label, embedding, code (a byte a part) and error (a decimal text), searched from the code that is there."""
    label = vectors.schema["label"].dataType.simpleString()
    kind = vectors.schema["embedding"].dataType.simpleString()

    def run(batches):
        searched, at = [Codebook(b) for b in books], cuts(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = matrix(batch.column(2), width)
            before = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, PARTS)
            codes, errors = np.zeros_like(before), 0
            for p, book in enumerate(searched):
                entry, far = book.nearest(values[:, at[p] : at[p + 1]], before[:, p].astype(np.int64))
                codes[:, p] = entry
                errors = errors + far
            code = pa.array([row.tobytes() for row in codes], pa.binary())
            error = pa.array([str(e) for e in errors.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], code, error], ["vec_id", "label", "embedding", "code", "error"])

    return vectors.select("vec_id", "label", "embedding", "code").mapInArrow(run, f"vec_id long, label {label}, embedding {kind}, code binary, error string")


def moved(coded: DataFrame, books: list[list[list[int]]], width: int) -> list[list[list[int]]]:
    """Entries replaced by the floored mean of their parts; unused ones stay.

    Tasks sum their own rows; the sums, a bounded number of rows a task, meet by part, entry, place and limb, and those of
    the whole, PARTS * ENTRIES * width / PARTS numbers, go to the driver.
    """

    def run(batches):
        sums: dict[tuple[int, int], list[int]] = {}
        at = cuts(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = matrix(batch.column(0), width)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                order = np.argsort(codes[:, p], kind="stable")
                entries, first = np.unique(codes[order, p], return_index=True)
                own = np.add.reduceat(values[order, at[p] : at[p + 1]], first, axis=0)
                counts = np.diff([*first.tolist(), len(order)])
                for e, n, total in zip(entries.tolist(), counts.tolist(), own.tolist(), strict=True):
                    had = sums.get((p, e), [0] * (len(total) + 1))
                    sums[p, e] = [x + y for x, y in zip(had, [n, *total], strict=True)]
        rows = []
        for (p, e), totals in sums.items():
            for place, total in enumerate(totals):
                limb = 0
                while True:
                    last = -(1 << 62) <= total < 1 << 62 and limb > 0 or -(1 << LIMB) < total < 1 << LIMB
                    rows.append((p, e, place, limb, total if last else total & ((1 << LIMB) - 1)))
                    if last:
                        break
                    total, limb = total >> LIMB, limb + 1
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "limb", "total"])

    parts = coded.select("embedding", "code").mapInArrow(run, "part long, entry long, place long, limb long, total long")
    parts = parts.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums: dict[tuple[int, int], dict[int, int]] = {}
    for r in parts.collect():
        own = sums.setdefault((r.part, r.entry), {})
        own[r.place] = own.get(r.place, 0) + (int(r.total) << (LIMB * r.limb))
    return [[[own[k + 1] // own[0] for k in range(len(entry))] if (own := sums.get((p, e))) else entry for e, entry in enumerate(book)] for p, book in enumerate(books)]


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error as decimal text) of every kept row, and the final codebooks [part][entry][place].

    Rows whose vector is null or has null or non-finite components are dropped, and so are those of another width than
    the kept row of the smallest vec_id (null ids come last, ties go by vector).  Numbers of any size are exact.  Repeated
    rows are coded each and count each.  A width that PARTS doesn't divide is cut as evenly as can be; fewer than ENTRIES
    kept rows make smaller codebooks; no kept rows, no rows and empty codebooks.  Extra columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("embedding").isNotNull() & fine)
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    seed = rows.select("vec_id", "embedding").orderBy(*order).limit(1).collect()
    if not seed:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit("0").alias("error")), [[] for _ in range(PARTS)]
    width = len(seed[0].embedding)
    rows = rows.where(F.size("embedding") == width)
    seeds = rows.select("vec_id", "embedding").orderBy(*order).limit(ENTRIES).collect()
    at = cuts(width)
    firsts = [[int(x) for x in integers(np.array(s.embedding, np.float64))] for s in seeds]
    books = [[first[at[p] : at[p + 1]] for first in firsts] for p in range(PARTS)]
    coded = rows.withColumn("code", F.lit(bytes(PARTS)))
    for _ in range(rounds):
        coded = cut(assigned(coded, books, width).drop("error"))
        books = moved(coded, books, width)
    return assigned(coded, books, width).drop("embedding"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """error as a number and label_error, its sum over equal labels (nulls together); null where 64 bits don't hold it.

    Few labels can be heavy, so their sums are broadcast; the rows of others are shuffled by label.
    """
    rows = cut(coded)
    number = F.expr("try_cast(error as decimal(20,0))")  # their sums have 30 digits; what is longer has no 64 bits' sum
    whole = F.when(F.max(number.isNull()), F.lit(None)).otherwise(F.sum(number))
    sums = rows.groupBy("label").agg(whole.alias("s"), F.count(F.lit(1)).alias("n"))
    sums = cut(sums.select(F.col("label").alias("_label"), F.expr("try_cast(s as bigint)").alias("label_error"), "n"))
    many = F.col("n") > F.lit((sums.agg(F.sum("n")).first()[0] or 0) // HEAVY)
    heavy = F.broadcast(sums.where(many).drop("n").withColumn("_heavy", F.lit(True)))
    met = rows.join(heavy, F.col("label").eqNullSafe(F.col("_label")), "left")
    first = met.where("_heavy").drop("_label", "_heavy")
    rest = met.where("_heavy is null").drop("_label", "_heavy", "label_error").join(sums.where(~many).drop("n"), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return first.unionByName(rest).withColumn("error", F.expr("try_cast(error as bigint)"))


def op12(spark, sf_dir):
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    rows = with_label_error(coded)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigned(book: str) -> str:
    return f"""
  select vec_id, part, arg_min(entry, far * 64::hugeint + entry) as entry, min(far) as far from (
    select v.vec_id, v.part, b.entry, sum((v.x - b.y) * (v.x - b.y))::hugeint as far from parts v join {book} b using (part, place) group by 1, 2, 3
  ) group by 1, 2"""


def _moved(book: str, codes: str) -> str:
    return f"""
  select b.part, b.entry, b.place,
    case when n is null then y when s < 0 and s % n <> 0 then s // n - 1 else s // n end as y
  from {book} b left join (
    select part, entry, place, sum(x)::hugeint as s, count(*)::hugeint as n from parts join {codes} using (vec_id, part) group by 1, 2, 3
  ) using (part, entry, place)"""


OP12_SQL = f"""
with kept as (
  select vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
spread as (select vec_id, len(embedding) // {PARTS} as w, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from kept),
parts as (select vec_id, i // w as part, i % w as place, floor({SCALE} * x::double)::hugeint as x from spread),
seeds as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < {ENTRIES}),
book0 as (select part, entry, place, x as y from parts join seeds using (vec_id)),
codes0 as ({_assigned("book0")}),
book1 as ({_moved("book0", "codes0")}),
codes1 as ({_assigned("book1")}),
book2 as ({_moved("book1", "codes1")}),
codes2 as ({_assigned("book2")}),
coded as (select vec_id, string_agg(printf('%02x', entry::int), '' order by part) as code, sum(far)::bigint as error from codes2 group by vec_id),
digest as (select sha256(string_agg(y::varchar, ',' order by part, entry, place)) as codebooks_sha256 from book2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join kept using (vec_id), digest
"""
