"""Repeated byte strings across documents, by prefix-free parsing split over the cluster.

Dealing.  Of every MATCH bytes, the WIDTH-byte string with the least rolling hash is their trigger.  Windows of MATCH
bytes that share one trigger occurrence lie side by side and make a fragment; equal windows have equal triggers, so
fragments that can share a window are dealt to one bucket by trigger, and no window lies in two fragments.

1. every group of texts tells the buckets its triggers (a few bytes each), and learns which ones several documents have;
2. of those it sends its different fragments with their bytes, and each one's smallest document: copies go once;
3. a bucket's fragments are its corpus.  It is parsed prefix-free (corpus_order): rolling-hash triggers make phrases, the
   suffix arrays of the dictionary and of the parse combine into corpus order, where equal windows are neighbours.  The
   neighbours' bytes are compared, and each run's smallest document goes back to the groups that have the fragments;
4. every group maps that to its occurrences, and cuts what has an earlier document.

A trigger that HOT fragments or more have (a phrase that a third of the corpus quotes, each time in another context) would
make one large group; its windows are dealt one by one, by all their bytes, so that different ones part.  Groups and
buckets are as many as the input's bytes ask for.  Hashes only deal: wherever fragments, phrases or windows are taken for
equal, their bytes have been compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, group_of, small_batches, text_bytes, text_groups
from .packed import dealt, loosen, runs_of, slices, squeeze
from .rolling import byte_values, prefix_hash, range_hash, sliding_min, window_hashes

#: Fixed value of the result contract: bytes of a repeated string.  WIDTH: bytes of a trigger that deals.
MATCH, WIDTH = 50, 24
#: The parse: bytes of a trigger, and one of how many windows is one.  END stands in no UTF-8 text.
PARSE_WIDTH, PARSE_EVERY, END = 6, 24, 0xFF
#: Bytes hashed at a time, at most (places in a piece must fit 24 bits), and fragments parsed at a time.
PIECE, SORTED = 1 << 18, 1 << 13
#: Fragments of a trigger whose windows are dealt one by one.
HOT = 1 << 16
_PLACE = np.uint64((1 << 24) - 1)
_LOW = np.uint64((1 << 32) - 1)


def fragments(prefix: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(trigger hash, begin, length) of the fragments of the texts between the boundaries, in order."""
    none = np.zeros(0, np.int64)
    if len(prefix) <= MATCH:
        return none.astype(np.uint64), none, none
    hashes = window_hashes(prefix, WIDTH)
    least = sliding_min((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), MATCH - WIDTH + 1)
    long = np.diff(at) >= MATCH
    step = np.zeros(len(prefix), np.int32)
    np.add.at(step, at[:-1][long], 1)
    np.add.at(step, at[1:][long] - MATCH + 1, -1)
    inside = np.cumsum(step, dtype=np.int32)[: len(least)] > 0  # windows that lie in one text
    other = np.ones(len(least) + 1, bool)
    other[1:-1] = least[1:] != least[:-1]
    first = np.flatnonzero(inside & (other[:-1] | ~np.concatenate(([True], inside[:-1]))))
    last = np.flatnonzero(inside & (other[1:] | ~np.concatenate((inside[1:], [False]))))
    return hashes[(least[first] & _PLACE).astype(np.int64)], first, last + MATCH - first


def text_pieces(raw: np.ndarray, at: np.ndarray):
    """(bytes, boundaries, where it begins) of runs of whole texts of PIECE bytes or less, and of parts of longer texts
    that share MATCH - 1 bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        if at[i + 1] - at[i] > PIECE:
            for s in range(int(at[i]), int(at[i + 1]) - MATCH + 1, PIECE):
                part = raw[s : min(s + PIECE + MATCH - 1, int(at[i + 1]))]
                yield part, np.array([0, len(part)]), s
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        yield raw[at[i] : at[j]], at[i : j + 1] - at[i], int(at[i])
        i = j


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def equal_ranges(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, runs): an order of the ranges by key and content, and where in it a new key or content begins.

    ``mark`` is a hash of each range's bytes; the bytes of all that it takes for equal are compared, and where they
    aren't, the ranges are ordered by their bytes instead.
    """
    order = np.lexsort((size, mark, key))
    at = runs_of(key[order], mark[order], size[order])
    model = np.repeat(order[at], np.diff(np.append(at, len(order))))
    for s in range(0, len(order), SORTED):
        one, two = order[s : s + SORTED], model[s : s + SORTED]
        differ = one != two
        one, two = one[differ], two[differ]
        if (raw[spread(begin[one], size[one])] != raw[spread(begin[two], size[two])]).any():
            break
    else:
        return order, at
    wide = np.zeros((len(size), int(size.max())), np.uint8)
    wide[np.arange(wide.shape[1]) < size[:, None]] = raw[spread(begin, size)]
    content = np.unique(wide.view(f"V{wide.shape[1]}").ravel(), return_inverse=True)[1]
    order = np.lexsort((size, content, key))
    return order, runs_of(key[order], content[order], size[order])


def bucket_key(hashes: np.ndarray, groups: int) -> np.ndarray:
    """The bucket above 32 bits, and 32 other bits of the hash."""
    return hashes % np.uint64(groups) << np.uint64(32) | hashes // np.uint64(groups) & _LOW


class Group:
    """The texts of one group, and their fragments."""

    def __init__(self, table: pa.Table, groups: int):
        self.raw, self.at = text_bytes(table.column("text"))
        ids = table.column("doc_id")
        self.known = pc.is_valid(ids).to_numpy()
        self.doc = ids.fill_null(0).to_numpy().astype(np.int64)
        self.groups = groups

    def parse(self, told: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """(bucket key, begin, length, mark) of the fragments; told(keys, marks): of those that are shared, with the hot
        ones' windows in their place."""
        out = []
        for part, bounds, base in text_pieces(self.raw, self.at):
            prefix = prefix_hash(byte_values()[part])
            h, begin, size = fragments(prefix, bounds)
            key = bucket_key(h, self.groups)
            mark = key
            if told is not None:
                place = np.minimum(np.searchsorted(told[0], key), max(0, len(told[0]) - 1))
                hit = told[0][place] == key if len(told[0]) else np.zeros(len(key), bool)
                key, begin, size, hot = key[hit], begin[hit], size[hit], told[1][place[hit]] > 1 if len(told[0]) else hit[hit]
                mark = range_hash(prefix, begin, begin + size)
                if hot.any():
                    windows = spread(begin[hot], size[hot] - MATCH + 1)
                    own = range_hash(prefix, windows, windows + MATCH)
                    key, mark = np.concatenate((key[~hot], bucket_key(own, self.groups))), np.concatenate((mark[~hot], own))
                    begin, size = np.concatenate((begin[~hot], windows)), np.concatenate((size[~hot], np.full(len(windows), MATCH)))
            out.append((key, begin + base, size, mark))
        if not out:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none, none.astype(np.uint64)
        key, begin, size, mark = (np.concatenate(c) for c in zip(*out, strict=True))
        known = self.known[self.row(begin)]
        return key[known], begin[known], size[known], mark[known]

    def told(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket key and document of everything that may be shared."""
        key, begin, _, _ = self.parse()
        return key, self.doc[self.row(begin)]

    def row(self, begin: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, begin, "right") - 1

    def different(self, told) -> tuple[np.ndarray, ...]:
        """The shared fragments: (bucket key, begin, length, document) in order of key and content, and where a new one
        begins.  Depends on the texts and on told alone, so two steps number the fragments alike."""
        key, begin, size, mark = self.parse(told)
        order, at = equal_ranges(self.raw, begin, size, key, mark)
        begin = begin[order]
        return key[order], begin, size[order], self.doc[self.row(begin)], at


def triggers(texts: DataFrame, groups: int, kind=Group) -> DataFrame:
    """(bucket, db, blob): each group's triggers, whether several of its documents have one, and how often it is told."""

    def run(table: pa.Table) -> pa.Table:
        key, doc = kind(table, groups).told()
        names, blobs = [], []
        if len(key):
            order = np.argsort(key)
            doc = doc[order]
            at = runs_of(key[order])
            several = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)).astype(np.uint8)
            count = np.diff(np.append(at, len(order))).astype(np.uint32)
            key = key[order[at]]
            for b, own in dealt((key >> np.uint64(32)).astype(np.int64)):
                names.append(b)
                blobs.append(squeeze(np.diff((key[own] & _LOW).astype(np.uint32), prepend=np.uint32(0)), several[own], count[own]))
        db = table.column("db")[0].as_py()
        give_back()
        return pa.table({"bucket": pa.array(names, pa.int64()), "db": pa.array([db] * len(names), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return texts.groupBy("db").applyInArrow(run, "bucket long, db long, blob binary")


def shared_triggers(told: DataFrame, hot_from: int | None = None) -> DataFrame:
    """(db, bucket, blob): for each group its triggers that several documents have, 2 where they are hot (told hot_from
    times or more)."""
    hot_from = hot_from or HOT

    def run(table: pa.Table) -> pa.Table:
        parts = [loosen(b, np.uint32, np.uint8, np.uint32) for b in table.column("blob").to_pylist()]
        low, several, count = (np.concatenate(c) for c in zip(*((np.cumsum(p[0], dtype=np.uint32), *p[1:]) for p in parts), strict=True))
        order = np.argsort(low, kind="stable")
        at = runs_of(low[order])
        n = np.diff(np.append(at, len(order)))
        both = (n > 1) | (np.maximum.reduceat(several[order], at) > 0)
        hot = np.add.reduceat(count[order].astype(np.int64), at) >= hot_from
        mark = np.zeros(len(low), np.uint8)
        mark[order] = np.repeat(np.where(both, 1 + hot, 0), n)
        ends = np.cumsum([len(p[0]) for p in parts])
        names, blobs = [], []
        for db, s, e in zip(table.column("db").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            own = s + np.flatnonzero(mark[s:e])
            if len(own):
                names.append(db)
                blobs.append(squeeze(np.diff(low[own], prepend=np.uint32(0)), mark[own]))
        bucket = table.column("bucket")[0].as_py()
        give_back()
        return pa.table({"db": pa.array(names, pa.int64()), "bucket": pa.array([bucket] * len(names), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return told.groupBy("bucket").applyInArrow(run, "db long, bucket long, blob binary")


def told_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for bucket, blob in zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True):
        steps, mark = loosen(blob, np.uint32, np.uint8)
        keys.append(np.uint64(bucket) << np.uint64(32) | np.cumsum(steps, dtype=np.uint32).astype(np.uint64))
        marks.append(mark)
    key, mark = np.concatenate(keys), np.concatenate(marks)
    order = np.argsort(key)
    return key[order], mark[order]


def shared_fragments(texts: DataFrame, shared: DataFrame, groups: int) -> DataFrame:
    """(bucket, db, blob): each group's different shared fragments with their bytes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, blobs, db = [], [], 0
        if left.num_rows and right.num_rows:
            db = left.column("db")[0].as_py()
            group = Group(left, groups)
            key, begin, size, doc, at = group.different(told_keys(right))
            if len(at):
                least, most = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
                key, begin, size = key[at], begin[at], size[at]
                for b, own in dealt((key >> np.uint64(32)).astype(np.int64)):
                    names.append(b)
                    low, several = (key[own] & _LOW).astype(np.uint32), (least[own] != most[own]).astype(np.uint8)
                    data = group.raw[spread(begin[own], size[own])]
                    blobs.append(squeeze(np.diff(low, prepend=np.uint32(0)), size[own].astype(np.uint8), least[own], several, data))
        give_back()
        return pa.table({"bucket": pa.array(names, pa.int64()), "db": pa.array([db] * len(names), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return texts.groupBy("db").cogroup(shared.groupBy("db")).applyInArrow(run, "bucket long, db long, blob binary")


def suffix_ranks(first: np.ndarray, end: np.ndarray, step: int) -> np.ndarray:
    """Ranks of the suffixes of many strings by prefix doubling, equal for equal suffixes.  first: each place's key of
    ``step`` symbols; end: where the place's string ends.  A suffix that ends goes before what continues it.

    A rank is one more than the number of smaller suffixes as far as they are compared, so a round touches only the
    places that share a rank with others and have symbols left.
    """
    order = np.argsort(first)
    key = first[order]
    place = np.arange(len(first))
    rank, now = np.ones(len(first), np.int64), np.ones(len(first), np.int64)
    while True:
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else place[:0]
        n = np.diff(np.append(at, len(order)))
        group = np.flatnonzero(np.concatenate(([True], now[1:] != now[:-1]))) if len(now) else at
        base = np.repeat(group, np.diff(np.append(group, len(now))))[at] if len(at) else at
        rank[order] = np.repeat(now[at] + at - base, n)
        more = np.maximum.reduceat((end - place)[order], at) > step if len(at) else at > 0
        left = np.repeat((n > 1) & more, n)
        order = order[left]
        if not len(order):
            return rank
        now, after = rank[order], order + step
        inside = after < end[order]
        key = now << 32 | np.where(inside, rank[np.where(inside, after, 0)], 0)
        by = np.argsort(key)
        order, key, now = order[by], key[by], now[by]
        step *= 2


def parsed_phrases(text: np.ndarray, begin: np.ndarray, end: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the phrases of the strings text[begin:end], each of which PARSE_WIDTH END bytes follow.

    A phrase goes from a trigger to the end of the next one, so phrases overlap by PARSE_WIDTH bytes.  Triggers are the
    windows with a rolling hash of 0 modulo PARSE_EVERY, a string's beginning, and the END bytes after it.
    """
    hashes = window_hashes(prefix, PARSE_WIDTH)
    trigger = hashes % np.uint64(PARSE_EVERY) == 0
    body = np.zeros(len(text) + 1, np.int32)
    body[begin] += 1
    body[end] -= 1
    starts = trigger & (np.cumsum(body[: len(trigger)], dtype=np.int32) > 0)
    starts[begin] = True
    closes = starts.copy()
    closes[begin] = False
    closes[end] = True
    return np.flatnonzero(starts), np.flatnonzero(closes) + PARSE_WIDTH


def corpus_order(text: np.ndarray, begin: np.ndarray, end: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, keys): the windows' places in the order of the suffixes that begin there, by prefix-free parsing of the
    strings text[begin:end], and a number for each that is equal only for equal suffixes.

    No suffix of a phrase that is longer than a trigger is a proper prefix of another one, as it ends with a trigger and
    has none inside.  So suffixes of the corpus are ordered by the rest of their phrase (its rank in the dictionary's
    suffix array) and then by what follows it (the rank of the next phrase in the parse's suffix array).
    """
    prefix = prefix_hash(byte_values()[text])
    s, e = parsed_phrases(text, begin, end, prefix)
    size = e - s
    # the dictionary: different phrases, one after the other
    by, at = equal_ranges(text, s, size, np.zeros(len(s), np.int8), range_hash(prefix, s, e))
    phrase = np.empty(len(s), np.int64)
    phrase[by] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(by))))
    one = by[at]
    dictionary = text[spread(s[one], size[one])]
    d_end = np.cumsum(size[one])
    d_begin = d_end - size[one]
    ends = np.repeat(d_end, size[one])
    # its suffix array: eight bytes at first, then doubling; bytes beyond a phrase's end count as none
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate((dictionary, np.zeros(8, np.uint8))), 8)[: len(dictionary)]
    first = words.copy().view(">u8").ravel().astype(np.uint64)
    beyond = np.maximum(8 - (ends - np.arange(len(ends))), 0).astype(np.uint64) * np.uint64(8)
    rank = suffix_ranks(first >> beyond << beyond, ends, 8)
    # the parse and its suffix array
    string = np.searchsorted(begin, s, "right") - 1
    last = np.searchsorted(string, np.arange(len(begin)), "right")
    follow = suffix_ranks(rank[d_begin[phrase]], last[string], 1)
    # both combined
    own = np.searchsorted(s, windows, "right") - 1
    after = np.where(own + 1 < last[string[own]], follow[np.minimum(own + 1, len(s) - 1)], 0)
    key = rank[d_begin[phrase[own]] + windows - s[own]] << 32 | after
    order = np.argsort(key)
    return order, key[order]


def same_windows(text: np.ndarray, windows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where among windows in corpus order a new MATCH-byte string begins; bytes are compared unless the suffixes are equal."""
    new = np.ones(len(windows), bool)
    at = np.flatnonzero(key[1:] != key[:-1]) + 1
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    one, two = windows[at], windows[at - 1]
    new[1:] = False
    for o in [*range(0, MATCH - 7, 8), MATCH - 8]:
        differ = words[one + o].view(np.uint64).ravel() != words[two + o].view(np.uint64).ravel()
        new[at[differ]] = True
        at, one, two = at[~differ], one[~differ], two[~differ]
    return np.flatnonzero(new)


def least_documents(size: np.ndarray, low: np.ndarray, doc: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document of every window of the fragments, one after the other, and each fragment's first window."""
    begin = np.cumsum(size) - size
    mark = np.concatenate([range_hash(prefix_hash(byte_values()[raw[begin[s] : begin[s] + size[s:e].sum()]]), begin[s:e] - begin[s], begin[s:e] - begin[s] + size[s:e])
                           for s, e in ((s, min(s + 4096, len(size))) for s in range(0, len(size), 4096))])
    by, at = equal_ranges(raw, begin, size, low, mark)
    which = np.empty(len(size), np.int64)
    which[by] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(by))))
    owner = np.minimum.reduceat(doc[by], at)
    one = by[at]
    # the bucket's corpus: different fragments, each with END bytes behind
    wide = size[one] + PARSE_WIDTH
    end = np.cumsum(wide) - PARSE_WIDTH
    start = end - size[one]
    text = np.full(int(wide.sum()), END, np.uint8)
    text[spread(start, size[one])] = raw[spread(begin[one], size[one])]
    count = size[one] - MATCH + 1
    windows = spread(start, count)
    of = np.repeat(np.arange(len(one)), count)
    order, key = corpus_order(text, start, end, windows)
    at = same_windows(text, windows[order], key)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(owner[of[order]], at), np.diff(np.append(at, len(order))))
    head = (np.cumsum(count) - count)[which]
    n = count[which]
    return least[spread(head, n)], np.cumsum(n) - n


def earlier_documents(sent: DataFrame) -> DataFrame:
    """(db, bucket, blob): runs of windows (fragment's number, first window, windows, smallest document) that a group has
    an occurrence of in a later document."""

    def run(table: pa.Table) -> pa.Table:
        parts = [loosen(b, np.uint32, np.uint8, np.int64, np.uint8, np.uint8) for b in table.column("blob").to_pylist()]
        low = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
        size = np.concatenate([p[1] for p in parts]).astype(np.int64)
        doc, several = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        raw = np.concatenate([p[4] for p in parts])
        number = np.concatenate([np.arange(len(p[1])) for p in parts])
        source = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        del parts
        ends = np.cumsum(size)
        order = np.argsort(low, kind="stable")
        found = []
        for s, e in slices(runs_of(low[order]), len(order), SORTED):
            own = order[s:e]
            n = size[own]
            least, head = least_documents(n, low[own], doc[own], raw[spread(ends[own] - n, n)])
            count = n - MATCH + 1
            who = np.repeat(np.arange(len(own)), count)
            nth = np.arange(len(who)) - head[who]
            hit = np.flatnonzero((least < doc[own][who]) | (several[own][who] > 0))
            who, nth, least = who[hit], nth[hit], least[hit]
            if len(hit):
                at = runs_of(who, least, nth - np.arange(len(nth)))
                found.append((own[who[at]], nth[at], np.diff(np.append(at, len(who))), least[at]))
        names, blobs = [], []
        dbs = table.column("db").to_pylist()
        if found:
            which, first, n, least = (np.concatenate(c) for c in zip(*found, strict=True))
            for k, rows in dealt(source[which]):
                rows = rows[np.lexsort((first[rows], number[which[rows]]))]
                names.append(dbs[k])
                blobs.append(
                    squeeze(
                        np.diff(number[which[rows]], prepend=0).astype(np.uint32), first[rows].astype(np.uint8), n[rows].astype(np.uint8), least[rows]
                    )
                )
        bucket = table.column("bucket")[0].as_py()
        give_back()
        return pa.table({"db": pa.array(names, pa.int64()), "bucket": pa.array([bucket] * len(names), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "db long, bucket long, blob binary")


def repeated_bytes(group: Group, told: pa.Table, found: pa.Table) -> np.ndarray:
    """Which bytes of a group's texts go."""
    change = np.zeros(len(group.raw) + 1, np.int32)
    key, begin, _, doc, at = group.different(told_keys(told))
    bucket = (key[at] >> np.uint64(32)).astype(np.int64) if len(at) else at
    ends = np.append(at[1:], len(key))
    for b, blob in zip(found.column("bucket").to_pylist(), found.column("blob").to_pylist(), strict=True):
        steps, first, n, least = loosen(blob, np.uint32, np.uint8, np.uint8, np.int64)
        which = np.searchsorted(bucket, b) + np.cumsum(steps, dtype=np.int64)
        times = ends[which] - at[which]
        occurrence = spread(at[which], times)
        later = np.repeat(least, times) < doc[occurrence]
        start = (begin[occurrence] + np.repeat(first, times))[later]
        np.add.at(change, start, 1)
        np.add.at(change, start + np.repeat(n, times)[later].astype(np.int64) - 1 + MATCH, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def cut_repeats(texts: DataFrame, told: DataFrame, groups: int, with_text: bool, carry: list[str]) -> DataFrame:
    """One row per document, with what goes.  carry: further columns of texts to hand on."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left, groups)
        raw, at = group.raw, group.at
        gone = np.zeros(len(raw), bool)
        if right.num_rows and left.num_rows:
            is_told = pc.equal(right.column("kind"), 0)
            gone = repeated_bytes(group, right.filter(is_told), right.filter(pc.invert(is_told)))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        if len(raw):
            heads = at[:-1][at[:-1] < len(raw)]
            opens[heads] = gone[heads]
        total = lambda of: np.diff(np.concatenate(([0], np.cumsum(of)))[at]) if len(raw) else np.zeros(len(at) - 1, np.int64)
        removed, n_spans = total(gone), total(opens)
        kept = []
        for s, e, n in zip(at[:-1].tolist(), at[1:].tolist(), removed.tolist(), strict=True):
            kept.append((raw[s:e][~gone[s:e]] if n else raw[s:e]).tobytes())
        columns = {
            "doc_id": left.column("doc_id").cast(pa.int64()),
            "n_bytes": pa.array(np.diff(at)),
            "n_removed": pa.array(removed),
            "n_spans": pa.array(n_spans),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        if with_text:
            columns["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
        columns |= {c: left.column(c) for c in carry}
        del kept, raw, gone, opens, group
        give_back()
        return pa.table(columns)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    schema += "".join(f", `{c}` {kind}" for c, kind in texts.dtypes if c in carry)
    return texts.groupBy("db").cogroup(told.groupBy("db")).applyInArrow(run, schema)


def _deduped(docs: DataFrame, with_text: bool, carry: dict) -> DataFrame:
    small_batches(docs.sparkSession)
    groups = text_groups(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c.alias(k) for k, c in carry.items()))
    texts = own.withColumn("db", group_of(groups)).repartition(groups, "db")
    # not checkpointed: that would end the job, and the next one would shuffle the texts again
    shared = shared_triggers(triggers(texts, groups).repartition(groups, "bucket"))
    found = earlier_documents(shared_fragments(texts, shared, groups).repartition(groups, "bucket"))
    told = shared.withColumn("kind", F.lit(0)).unionByName(found.withColumn("kind", F.lit(1)))
    return cut_repeats(texts, told, groups, with_text, list(carry))


def suffix_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, if asked for).

    A byte goes if a MATCH-byte string that covers it also begins in a document with a smaller doc_id.  A null text is
    an empty one; a document without id is compared with none and keeps all; rows that repeat id and text have the same
    result and remove nothing from one another; texts of any length are read whole; no rows in, no rows out.  Columns
    besides doc_id and text are ignored, whatever their names.  Texts are shuffled once and serve all three steps that
    need them.  kept_text drops the bytes of a character that a span cut in two.
    """
    return _deduped(docs, with_text, {})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The input with its repeated strings cut out of text, and n_chars as it then is; other columns travel with the
    text and stay as they are.  Texts are shuffled once."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = _deduped(docs, True, {f"_own_{i}": F.col(f"`{c}`") for i, c in enumerate(others)})
    out = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    out |= {c: F.col(f"_own_{i}") for i, c in enumerate(others)}
    return cut.select(*(out[c].alias(c) for c in docs.columns))


def op8(spark, sf_dir):
    from .common import table

    return suffix_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, h[2 * p + 1 : 2 * p + {2 * MATCH}] AS g FROM d, unnest(range(0, length(h) // 2 - {MATCH - 1})) AS r(p)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS least FROM w) WHERE least < doc_id),
i AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {MATCH}, true) AS opens FROM f),
s AS (
    SELECT doc_id, min(p) AS b, max(p) + {MATCH} AS e
    FROM (SELECT *, sum(opens::int) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i) GROUP BY doc_id, k),
k AS (SELECT doc_id, b, e, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS nb FROM s),
t AS (
    SELECT d.doc_id, any_value(h) AS h, coalesce(sum(e - b), 0) AS n_removed, count(b) AS n_spans, coalesce(min(b), length(any_value(h)) // 2) AS head,
      coalesce(string_agg(h[2 * e + 1 : coalesce(2 * nb, length(h))], '' ORDER BY b), '') AS tail
    FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans,
  sha256(unhex(h[1 : 2 * head] || tail)) AS kept_sha256
FROM t
"""
