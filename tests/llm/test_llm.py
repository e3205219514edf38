"""The corpus operators against brute-force versions, the tokenizers library, DuckDB, and odd inputs."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe_codec, chain_dedup, exact_dedup, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [
    "", "  a", "a  b", " x", "é▁b\t\n x", "日本語 ☃", "<|endoftext|> hi <|endoftext|>", "<s> x</s>", "aaaa" * 100, "\n \n x", "   \n\n  a   ",
    "it's they'll", "x́ y", "²½ 12a_b", "Á x\x1cy", "ΣΑΣ", "İstanbul", "a b　c", "IT'S don'T",
] + ["".join(random.Random(i).choices(" \n\tabcdeEé'.,1²x☃", k=50)) for i in range(120)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # columns whose names the operators use inside

        df = df.withColumns({c: F.lit(1) for c in ("kept", "fp", "bucket", "digest", "score", "_class", "component", "db")})
    return df


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(3000)]
    return " ".join(rng.choice(words) for _ in range(n)) + "."


def test_bpe_matches_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    codec, library = bpe_codec.ByteBpe(path), Tokenizer.from_file(path)
    for t in ODD:
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(array("I", codec.encode(t))) == ids
        assert codec.decode(codec.encode(t)) == library.decode(ids, skip_special_tokens=False)
    rng = random.Random(0)
    for _ in range(3000):
        a, b = rng.randrange(50256), rng.randrange(50256)
        assert codec.compatible(a, b) == (codec.merged([codec.single[x] for x in codec.bytes[a] + codec.bytes[b]]) == [a, b])


def test_unigram_counts_match_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    known = token_counts.Remembered(token_counts.UnigramCounter(vocabulary))
    for t in ODD:
        assert token_counts.count_text(t, known) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_ties_go_to_the_earlier_piece():
    count = token_counts.UnigramCounter([("a", -1.0), ("b", -1.0), ("ab", -2.0)])
    assert count("ab") == 1  # one piece and two score the same


def test_encode_and_decode_frames(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = frame(spark, [*ODD[:30], None], extra=True)
    encoded = bpe_codec.encode_documents(docs, path)
    back = {r.doc_id: r.text for r in bpe_codec.decode_documents(encoded, path).collect()}
    assert back == {i: t or "" for i, t in enumerate([*ODD[:30], None])}
    rows = {r.doc_id: r for r in bpe_codec.round_trip(docs, path).collect()}
    assert rows[30].n_tokens == 0 and rows[30].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).where("doc_id = 30").first().n_tokens == 0


def test_repeat_words_by_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(120)] + [None, "", "x " * 400, "a\n\na\nb | c\r\n"]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        seen = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        covered = {k + o for ks in seen.values() if len(ks) > 1 for k in ks for o in range(8)}
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), len(covered))
        lines = [x for x in (t or "").split("\n") if x.split()]
        assert got[i].n_dup_lines == len(lines) - len(set(lines))
        assert got[i].base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_line_rules(spark):
    good = prose(random.Random(1), 40)
    bars = " | ".join(good.split())
    marked = " ".join(w + "%%%" for w in good.split())
    texts = [good, bars, marked, good + "\nAll rights reserved.\nHome", good.upper().replace(" ", "!! ")]
    rows = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    assert [rows[i].kept for i in range(5)] == [True, False, False, True, False]
    assert quality_rules.clean_text(frame(spark, texts)).where("doc_id = 3").first().clean_text == good


def test_exact_dedup(spark):
    texts = ["a", "b", "a", None, "", "a", "c"]
    rows = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, texts, extra=True).repartition(5)).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in rows.items()} == {
        0: (5, 3, False), 1: (1, 1, True), 2: (5, 3, False), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 3, True), 6: (6, 1, True),
    }
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    twice = exact_dedup.drop_copies(frame(spark, ["a", "a"], ids=[3, 3]))
    assert twice.count() == 1 and twice.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert exact_dedup.exact_dedup(frame(spark, ["a", "a"], ids=[None, 1])).where("kept").first().doc_id == 1


def test_exact_dedup_keeps_rows_that_differ_in_text(spark):
    got = exact_dedup.drop_copies(frame(spark, ["a", "b", "c", "d", "e", "e", "f", "f"], ids=[None, None, 3, 3, None, None, None, 7])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "a"), (0, "b"), (0, "e"), (3, "c"), (3, "d"), (7, "f")]


def test_near_dedup_keeps_rows_that_differ_in_text(spark):
    rng = random.Random(43)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    got = simhash.drop_near_copies(frame(spark, [a, b, c, d, a.upper(), b.upper(), b], ids=[None, None, 3, 3, 5, None, 2])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(5, a.upper()), (2, b), (3, c), (3, d)])
    alone = simhash.drop_near_copies(frame(spark, [a, a.upper(), c], ids=[None, None, None])).collect()
    assert len(alone) == 2 and c in {r.text for r in alone}


def test_quality_stage_judges_each_row_by_its_text(spark, monkeypatch):
    at = quality_classifier.NAMES.index("words")
    weights = np.zeros(len(quality_classifier.NAMES) + 1)
    weights[at], weights[-1] = 100, -20  # good: more than six words
    monkeypatch.setattr(quality_classifier, "train", lambda docs, labels: {"shift": 0, "scale": 1, "weights": weights})
    good, bad = "a b c d e f g h i j", "a b"
    got = quality_classifier.drop_rejected(frame(spark, [good, bad, good, bad, good], ids=[None, None, 3, 3, 4], extra=True), None).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, good), (3, good), (4, good)]


def brute_components(fps):
    ids = list(fps)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(fps[a] ^ fps[b]).count("1") <= 2 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def test_fingerprint_by_definition():
    import xxhash

    for t in ["", "one", "A b  C d\te", prose(random.Random(2), 50), "x x x x x x"]:
        w = "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in t).split()
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        bits = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
        assert int.from_bytes(simhash.fingerprint(t), "big") == bits


def test_simhash_by_brute_force(spark):
    rng = random.Random(7)
    base = [prose(rng, 30) for _ in range(25)]
    texts = base + [rng.choice(base).replace("w1", "v1", 1) + " more" * rng.randrange(2) for _ in range(60)] + [None, "", "  "]
    rows = {r.doc_id: r for r in simhash.simhash_dedup(frame(spark, texts, extra=True)).collect()}
    want = brute_components({i: int(r.fingerprint, 16) for i, r in rows.items()})
    assert {i: r.component_id for i, r in rows.items()} == want
    assert simhash.simhash_dedup(frame(spark, [])).count() == 0


def test_links_find_all_pairs(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from ledgerloom.llm.common import components

    found = {r.node: r.component for r in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    want = brute_components({f: f & (2**64 - 1) for f in signed})
    groups = {}
    for f in signed:
        groups.setdefault(want[f], set()).add(found.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_count_filter_keeps_the_pairs_that_share_six_bytes(spark):
    rng = random.Random(61)
    base = rng.getrandbits(64)
    bit = lambda *at: base ^ sum(1 << a for a in at)
    fps = [base, bit(3), bit(3, 60), bit(1, 9, 17), bit(1, 2, 3), bit(1, 9), bit(40, 41)]  # three bytes differ in the fourth, so the tally drops it
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    shared = lambda a, b: sum((a >> 8 * k & 255) == (b >> 8 * k & 255) for k in range(8))
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    met = {}
    for r in simhash.postings(df).collect():
        met.setdefault(r.key, set()).add(r.fp)
    together = {(a, b) for fs in met.values() for a in fs for b in fs if a < b}
    mask = (1 << 64) - 1
    every = {(a, b) for a in signed for b in signed if a < b}
    assert together == {(a, b) for a, b in every if shared(a & mask, b & mask) >= 5} != every
    tallied = spark.createDataFrame(sorted(every), "a long, b long").select("a", "b", simhash.shared_bytes(F.col("a"), F.col("b")).alias("s"))
    assert all(r.s == shared(r.a & mask, r.b & mask) for r in tallied.collect())
    got = {(r.a, r.b): r.shared for r in simhash.candidates(df).collect()}
    assert got == {(a, b): shared(a & mask, b & mask) for a, b in every if bin((a ^ b) & mask).count("1") <= 2}


def test_long_lists_lose_no_link(spark, monkeypatch):
    """A cluster around one fingerprint, its lists far longer than are compared, against all pairs."""
    rng = random.Random(62)
    base, mask = rng.getrandbits(64), (1 << 64) - 1
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(500)} | {rng.getrandbits(64) for _ in range(100)}
    fps |= {base ^ 1 << 63, base ^ 1 << 63 ^ 1}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & mask).count("1") <= 2}
    df = spark.createDataFrame([(f,) for f in signed], "fp long").cache()
    for most in (256, 8, 1):
        monkeypatch.setattr(simhash, "LONG", most)
        got = [(r.a, r.b) for r in simhash.links(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    assert simhash.links(df.where("false")).count() == 0


def brute_suffix(texts):
    first = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    out = []
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def test_suffix_dedup_by_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(1, 60), ["ab", "c", "déf", "g h"]) for _ in range(40)]
    texts += ["x" * n for n in (49, 50, 51, 300)] + [None, ""] + [t[5:90] + prose(rng, 5) + t[-70:] for t in texts[:20]] + texts[:5]
    want = brute_suffix([(t or "").encode() for t in texts])
    for piece, hot in ((1 << 20, 1 << 16), (120, 3)):  # long texts in parts, hot triggers window by window
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        rows = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame(spark, texts, extra=True)).collect()}
        assert [(rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) for i in range(len(texts))] == want
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0
    same = suffix_dedup.suffix_dedup(frame(spark, ["y" * 80, "y" * 80, "y" * 80], ids=[4, 4, None])).collect()
    assert [r.n_removed for r in same] == [0, 0, 0]
    cut = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, ["z" * 80, "z" * 80 + "end"])).collect()}
    assert cut[1].text == "end" and cut[1].n_chars == 3


def test_corpus_order_by_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        parts = [bytes(rng.choice(b"ab c\0") for _ in range(rng.randrange(50, 77))) for _ in range(rng.randrange(1, 30))]
        parts += [p for p in (p[:30] + parts[0][30:] for p in parts[:5]) if len(p) >= 50]
        text = b"".join(p + b"\xff" * suffix_dedup.PARSE_WIDTH for p in parts)
        sizes = np.array([len(p) for p in parts])
        end = np.cumsum(sizes + suffix_dedup.PARSE_WIDTH) - suffix_dedup.PARSE_WIDTH
        raw, start = np.frombuffer(text, np.uint8), end - sizes
        windows = suffix_dedup.spread(start, sizes - 49)
        order, key = suffix_dedup.corpus_order(raw, start, end, windows)
        of = np.repeat(end, sizes - 49)
        suffixes = [text[windows[i] : of[i] + suffix_dedup.PARSE_WIDTH] for i in order]
        assert suffixes == sorted(suffixes)
        assert [a == b for a, b in zip(suffixes, suffixes[1:], strict=False)] == (key[1:] == key[:-1]).tolist()
        want = [i for i in range(len(suffixes)) if i == 0 or suffixes[i][:50] != suffixes[i - 1][:50]]
        assert suffix_dedup.same_windows(raw, windows[order], key).tolist() == want


def test_equal_hashes_of_different_bytes_are_told_apart():
    raw = np.frombuffer(b"abcabcxbcabd", np.uint8)
    begin, size = np.arange(0, 12, 3), np.full(4, 3)
    order, at = suffix_dedup.equal_ranges(raw, begin, size, np.zeros(4, np.uint64), np.zeros(4, np.uint64))
    groups = [set(g.tolist()) for g in np.split(order, at[1:])]
    assert sorted(map(sorted, groups)) == [[0, 1], [2], [3]]


def test_sorted_runs_merge_like_one_sort():
    rng = random.Random(67)
    runs, whole = [], {}
    for _ in range(9):
        rows = [(bytes(rng.choice(b"ab") for _ in range(3)).ljust(48, b"z"), rng.randrange(99)) for _ in range(rng.randrange(1, 40))]
        for k, i in rows:
            most, n = whole.get(k, (-1, 0))
            whole[k] = max(most, i), n + 1
        rows.sort()
        columns = np.array([k for k, _ in rows], "S48"), np.array([i for _, i in rows]), np.ones(len(rows), np.int64)
        runs.append(exact_dedup.collapsed(*columns, "max"))
    keys, ids, counts = exact_dedup.merged(runs, "max")
    assert [(k, i, n) for k, i, n in zip(keys.tolist(), ids.tolist(), counts.tolist(), strict=True)] == [(k, *whole[k]) for k in sorted(whole)]


def test_chain_dedup_finds_planted_passages(spark):
    rng = random.Random(13)
    docs = [prose(rng, rng.randrange(80, 200)).split() for _ in range(60)]
    for i in range(30):
        p = list(docs[i][10:66])
        for _ in range(i % 5):
            p[rng.randrange(len(p))] = "changed"
        docs.append(prose(rng, 30).split() + p + prose(rng, 30).split())
    texts = [" ".join(d) for d in docs] + [None, "", "a " * 500, "short text", " ".join(docs[0])]
    rows = chain_dedup.chain_dedup(frame(spark, texts, extra=True)).collect()
    pairs = {(r.doc_id, r.partner_id) for r in rows}
    assert {(60 + i, i) for i in range(30)} <= pairs and (94, 0) in pairs
    assert not [p for p in pairs if p[0] < 60 or p[0] in (90, 91, 92, 93)]
    for r in rows:
        a = texts[r.doc_id].lower().split()[r.first_word : r.end_word]
        b = texts[r.partner_id].lower().split()[r.partner_first_word : r.partner_end_word]
        assert r.distance == plain_distance(a, b) and r.similarity >= 0.8
    assert chain_dedup.chain_dedup(frame(spark, [])).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(17)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(25))] for _ in "ab")
        assert chain_dedup.edit_distance(a, b, 99) == plain_distance(a, b)


def test_alignment_and_its_alike_parts_by_brute_force(monkeypatch):
    rng = random.Random(47)
    monkeypatch.setattr(chain_dedup, "MIN_WORDS", 8)
    found = 0
    for n in range(300):
        monkeypatch.setattr(chain_dedup, "TABLE", 1 << 24 if n % 2 else 20)
        a = [rng.randrange(9) for _ in range(rng.randrange(40))]
        b = [c if rng.random() < 0.8 else rng.randrange(9) for c in a if rng.random() < 0.9] + [rng.randrange(9) for _ in range(rng.randrange(9))]
        steps = chain_dedup.alignment(a, b)
        x, y, e = ([0, *np.cumsum(c).tolist()] for c in (steps != 3, steps != 2, steps != 0))
        assert (x[-1], y[-1], e[-1]) == (len(a), len(b), plain_distance(a, b))
        most = 0
        for p in range(len(steps)):
            for q in range(p + 1, len(steps) + 1):
                size, p_size = x[q] - x[p], y[q] - y[p]
                if steps[p] == steps[q - 1] == 0 and min(size, p_size) >= 8 and 5 * (e[q] - e[p]) <= max(size, p_size):
                    most = max(most, min(size, p_size))
        parts = chain_dedup.alike_parts(steps)
        assert max([min(x_end - x, y_end - y) for x, x_end, y, y_end, _ in parts], default=0) == most
        for x, x_end, y, y_end, d in parts:
            assert d == plain_distance(a[x:x_end], b[y:y_end]) and 5 * d <= max(x_end - x, y_end - y)
        found += len(parts)
    assert found > 100


def test_chain_dedup_keeps_alike_parts_of_a_chain_that_fails(spark):
    rng = random.Random(53)
    docs = []
    for _ in range(12):
        word = lambda: f"u{rng.randrange(10**9)}"
        exact, pieces = [word() for _ in range(50)], [[word() for _ in range(20)] for _ in range(6)]
        docs.append(exact + sum(pieces, []))
        docs.append(exact + sum(([word() for _ in range(10)] + p for p in pieces), []))
    texts = [" ".join(d) for d in docs]
    rows = chain_dedup.chain_dedup(frame(spark, texts)).collect()
    for r in rows:
        a, b = (texts[i].split() for i in (r.doc_id, r.partner_id))
        d = plain_distance(a[r.first_word : r.end_word], b[r.partner_first_word : r.partner_end_word])
        assert r.distance == d and r.similarity >= 0.8
    assert {r.doc_id for r in rows if r.first_word == 0 and r.end_word >= 50} == set(range(1, 24, 2))


def word_maker(rng):
    return lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]


def test_chain_dedup_is_not_led_astray_by_shorter_holders(spark):
    w = word_maker(random.Random(71))
    long, half = w(70), w(50)
    pieces = [long[i : i + 13] for i in range(0, 65, 13)]
    mix = lambda: sum((w(25) + p for p in pieces), []) + w(25)
    docs = {0: mix(), 1: w(20) + long + w(20), 4: mix(), 5: w(30) + long + w(9), 300: w(10) + long + w(10)}
    docs |= {200 + k: mix() for k in range(30)}  # more holders of each seed than are all compared
    docs |= {101: w(9) + half[:35], 103: half[:35] + w(9), 100: w(9) + half[15:], 104: half[15:] + w(9), 102: w(9) + half + w(9), 105: w(9) + half + w(9)}
    rows = chain_dedup.chain_dedup(frame(spark, [" ".join(d) for d in docs.values()], ids=list(docs))).collect()
    assert {(r.doc_id, r.partner_id): r.end_word - r.first_word for r in rows} == {(5, 1): 70, (105, 102): 50, (300, 1): 70, (300, 5): 70}


def test_chain_dedup_of_a_passage_in_a_third_of_the_texts(spark):
    """Over many partitions and groups: links grow with the texts, and every text is linked."""

    rng = random.Random(59)
    passage = [f"p{i}" for i in range(60)]
    n = 600
    texts = [" ".join(prose(rng, 20).split() + (passage if i % 3 == 0 else prose(rng, 60).split()) + prose(rng, 20).split()) for i in range(n)]
    spark.conf.set("ledgerloom.groupBytes", "20000")
    try:
        docs = frame(spark, texts).repartition(211)
        rows = chain_dedup.chain_dedup(docs).collect()
        groups = chain_dedup.text_groups(docs)
        own = docs.withColumn("db", chain_dedup.group_of(groups)).select("db", "doc_id", "text").repartition(groups, "db")
        told = chain_dedup.shared_triggers(chain_dedup.triggers(own, groups, chain_dedup.Words), chain_dedup.MANY + 1)
        sent = chain_dedup.occurrences(own, told, groups).where("not local").collect()
    finally:
        spark.conf.unset("ledgerloom.groupBytes")
    assert groups > 10
    per_group = {}
    for r in sent:  # a group sends two texts of a seed that all have, or MANY
        for low, k in zip(*np.unique(chain_dedup.documents_of([r.blob], np.uint32, np.uint32, np.uint8)[3], return_counts=True), strict=True):
            per_group[r.bucket, r.db, low] = int(k)
    assert max(per_group.values()) <= chain_dedup.MANY
    linked = {r.doc_id for r in rows if r.end_word - r.first_word >= 60}
    assert linked == set(range(3, n, 3)) and len(rows) < 20 * n
    parent = {i: i for i in range(0, n, 3)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in rows:
        parent[root(r.doc_id)] = root(r.partner_id)
    assert len({root(i) for i in parent}) == 1
    assert docs.agg(F.count("*")).first()[0] == n


def local_alignment(a, b):
    """(words of a, words of b, changes, first word of a) of the best local alignment, a change costing three equal words."""
    score = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            score[i, j] = max(0, score[i - 1, j - 1] + (1 if x == y else -3), score[i - 1, j] - 3, score[i, j - 1] - 3)
    i, j = (int(v) for v in np.unravel_index(score.argmax(), score.shape))
    end, d = (i, j), 0
    while i and j and score[i, j]:
        if score[i, j] == score[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -3):
            d += a[i - 1] != b[j - 1]
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] - 3:
            i, d = i - 1, d + 1
        else:
            j, d = j - 1, d + 1
    return end[0] - i, end[1] - j, d, i


def test_chain_dedup_recall_against_all_pairs(spark):
    rng = random.Random(73)
    w = word_maker(rng)
    phrases = [w(9) for _ in range(6)]  # what many texts share without a passage
    bases = [w(60) for _ in range(8)]
    docs = []
    for i in range(70):
        body = []
        if i % 5 < 3:
            rate = rng.choice([0, 0.03, 0.06, 0.1, 0.14])
            body = [x if rng.random() >= rate else w(1)[0] for x in rng.choice(bases) if rng.random() >= rate / 3]
        docs.append(w(5) + rng.choice(phrases) + body + rng.choice(phrases) + w(8))
    rows = chain_dedup.chain_dedup(frame(spark, [" ".join(d) for d in docs])).collect()
    covered = {}
    for r in rows:
        covered.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
        covered.setdefault(r.partner_id, set()).update(range(r.partner_first_word, r.partner_end_word))
    want = got = 0
    for i in range(70):
        for j in range(i):
            n, m, d, start = local_alignment(docs[i], docs[j]) if set(docs[i]) & set(docs[j]) else (0, 0, 0, 0)
            if min(n, m) >= chain_dedup.MIN_WORDS and d <= 0.2 * max(n, m):
                want += 1
                got += len(covered.get(i, set()) & set(range(start, start + n))) >= 0.8 * n
    assert want > 50 and got >= 0.95 * want


def changed(passage, w, step, offset):
    """The passage with every ``step``-th word, from ``offset`` on, another one."""
    return [w(1)[0] if k % step == offset else x for k, x in enumerate(passage)]


def test_chain_dedup_finds_two_holders_of_a_changed_passage(spark):
    """Every sixth and every seventh word changed: five and six words in a row are left, one and two k-mers."""
    w = word_maker(random.Random(97))
    docs, want = [], {6: [], 7: []}
    for k in range(80):
        base, step = w(66), 6 + k % 2
        docs.append(w(20) + base + w(20))
        docs.append(w(20) + changed(base, w, step, k % step) + w(20))
        want[step].append((2 * k + 1, 2 * k))
    rows = chain_dedup.chain_dedup(frame(spark, [" ".join(d) for d in docs])).collect()
    pairs = {(r.doc_id, r.partner_id) for r in rows}
    assert pairs <= set(want[6] + want[7])
    assert len(pairs & set(want[6])) >= 0.9 * len(want[6]) and len(pairs & set(want[7])) >= 0.95 * len(want[7])


def test_chain_dedup_links_holders_whose_every_seed_many_texts_have(spark):
    """Sixty texts hold a passage's parts among other words; two that hold the passage itself, every seventh word changed or
    left out, have no four seeds in a row in common, and others stand before and between them."""
    w = word_maker(random.Random(107))
    bases = [w(70) for _ in range(16)]
    mix = lambda: sum((w(20) + b[i : i + 14] for b in bases for i in range(0, 70, 14)), [])
    docs = {i: mix() for i in range(30)} | {200 + i: mix() for i in range(30)}
    for i, b in enumerate(bases):
        left_out = {k for k in range(3, 70, 7) if i % 2 and k % 3 == 0}
        docs[100 + i] = w(15) + b + w(15)
        docs[300 + i] = w(9) + [x for k, x in enumerate(changed(b, w, 7, 3)) if k not in left_out] + w(20)
    rows = chain_dedup.chain_dedup(frame(spark, [" ".join(d) for d in docs.values()], ids=list(docs))).collect()
    assert {(r.doc_id, r.partner_id, r.class_id) for r in rows} == {(300 + i, 100 + i, 100 + i) for i in range(16)}


def test_chain_dedup_filters_of_surroundings_lose_no_passage():
    """Forty words or more that are alike enough, at any place around the seed and with any kinds of changes, pass."""
    rng = random.Random(109)
    a, b = [], []
    for n in range(600):
        size = rng.randrange(40, 80)
        at = rng.choice([0, size - 5, rng.randrange(size - 4)])
        one = [rng.randrange(1, 40 if n % 3 else 30_000) for _ in range(size)]
        places = [k for k in range(size) if not at <= k < at + 5]
        where = set(rng.sample(places, size // 5)) if n % 2 else set(sorted(places, key=lambda k: abs(k - at))[: size // 5])
        kinds, two, seed = rng.choice(["changed", "out", "in", "all"]), [], 0
        for k, x in enumerate(one):
            kind = (rng.choice(["changed", "out", "in"]) if kinds == "all" else kinds) if k in where else ""
            seed = len(two) if k == at else seed
            two += {"": [x], "changed": [rng.randrange(30_000, 32_000)], "out": [], "in": [rng.randrange(30_000, 32_000), x]}[kind]
        pad = lambda words, p: [rng.randrange(1, 32_000) for _ in range(max(0, 35 - p))] + words[max(0, p - 35) :] + [rng.randrange(1, 32_000) for _ in range(90)]
        for rows, words in ((a, pad(one, at)), (b, pad(two, seed))):
            rows.append([2 * x + 1 for x in words[: chain_dedup.WIDE]])
    a, b = (np.array(r, np.uint16) for r in (a, b))
    (bits_a, least_a), (bits_b, least_b) = chain_dedup.sketches(a), chain_dedup.sketches(b)
    shared = np.bitwise_count(bits_a & bits_b).sum(axis=1)
    assert (shared >= least_a).all() and (shared >= least_b).all()
    assert (chain_dedup.may_share(a, b) | chain_dedup.may_share(b, a)).all()
    other = np.random.default_rng(1).permutation(len(b))
    assert not chain_dedup.may_share(a, b[other])[::3].any()


def planted_runs(n):
    """Texts of runs of one word each, the same word's among them: (first words, length of that word's longest run, arguments of crowd_links)."""
    rng = random.Random(113)
    words, first, row, place, longest = [], [0], [], [], []
    for i in range(n):
        runs = []
        for _ in range(rng.choice([1, 1, 2])):
            runs += [(rng.randrange(10, 10**6), rng.randrange(15, 60)), (1, rng.choice([17, 22, 26, 30, 45, 60, 90]))]
        runs.append((rng.randrange(10, 10**6), rng.randrange(70, 90)))
        text = [w for w, k in runs for _ in range(k)]
        at = [k for k in range(len(text) - 4) if text[k : k + 5] == [1] * 5]
        row, place = row + [i] * len(at), place + at
        longest.append(max(k for w, k in runs if w == 1))
        words += text
        first.append(len(words))
    row, place = np.array(row), np.array(place)
    hashes = np.array(words, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    around = chain_dedup.surroundings(hashes, np.array(first), row, place)
    kept = np.sort(chain_dedup.copies(np.zeros(len(row), np.int64), row, around)[0])
    return longest, np.zeros(len(kept), np.int64), row[kept], around[kept]


def test_chain_dedup_hands_on_few_pairs_of_runs_of_one_word():
    """Runs of 40 words or more are of one class, whatever stands around them; shorter ones don't send each text to be
    aligned with all others at all places of their runs."""
    longest, key, doc, around = planted_runs(60)
    one, two, sure = chain_dedup.crowd_links(key, doc, around)
    assert (doc[one] > doc[two]).all()
    parent = list(range(60))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(doc[one[sure]].tolist(), doc[two[sure]].tolist(), strict=True):
        parent[root(i)] = root(j)
    assert len({root(i) for i in range(60) if longest[i] >= 40}) == 1 and sum(k >= 40 for k in longest) > 20
    assert (~sure).sum() < 2 * len(key)


def test_chain_dedup_band_of_edits_loses_no_passage():
    """Forty words or more with a fifth of them changed, left out or put in pass, on either side of the seed."""
    rng = random.Random(127)
    a, b = [], []
    for _ in range(400):
        size, seed = rng.randrange(40, 80), 0
        at = rng.choice([0, size - 5, rng.randrange(size - 4)])
        one, two = [rng.randrange(1, 200) for _ in range(size)], []
        where = set(rng.sample([k for k in range(size) if not at <= k < at + 5], size // 5))
        for k, x in enumerate(one):
            seed = len(two) if k == at else seed
            new = rng.randrange(20_000, 30_000)
            two += rng.choice([[new], [], [new, x]] if len(one) < 60 else [[new], []]) if k in where else [x]
        if len(two) > len(one):
            continue
        pad = lambda words, p: [rng.randrange(1, 32_000) for _ in range(max(0, 35 - p))] + words[max(0, p - 35) :] + [rng.randrange(1, 32_000) for _ in range(90)]
        for rows, words in ((a, pad(one, at)), (b, pad(two, seed))):
            rows.append([2 * x + 1 for x in words[: chain_dedup.WIDE]])
    a, b = (np.array(r, np.uint16) for r in (a, b))
    assert len(a) > 200 and chain_dedup.may_align(a, b).all() and chain_dedup.may_align(b, a).all()
    assert not chain_dedup.may_align(a, np.roll(b, 1, axis=0)).any()


def test_chain_dedup_classes_of_fuzzy_and_equal_holders(spark):
    """Texts that share a passage at 0.8 are in one class, others are not; the class names its smallest document."""
    w = word_maker(random.Random(101))
    fuzzy, equal, lone = w(60), w(60), w(60)
    docs = [w(20) + changed(fuzzy, w, 8, i % 4) + w(20) for i in range(20)]
    docs += [w(20) + equal + w(20) for _ in range(12)] + [w(20) + lone + w(20), w(7) + lone, w(100)]
    rows = chain_dedup.chain_dedup(frame(spark, [" ".join(d) for d in docs])).collect()
    classes = {}
    for r in rows:
        assert classes.setdefault(r.doc_id, r.class_id) == r.class_id and classes.setdefault(r.partner_id, r.class_id) == r.class_id
    assert classes == {i: i % 4 for i in range(20)} | dict.fromkeys(range(20, 32), 20) | {32: 32, 33: 32}
    sizes = {r.class_id: (r.class_size, r.class_word) for r in rows}
    assert {c: n for c, (n, _) in sizes.items()} == {0: 5, 1: 5, 2: 5, 3: 5, 20: 12, 32: 2} and sizes[20][1] == sizes[32][1] == 20


def test_passage_classes_by_brute_force(spark):
    rng = random.Random(103)
    for size in (0, 1, 60):
        rows = []
        for _ in range(size):
            d, p, x, y = rng.randrange(1, 25), 0, rng.randrange(0, 400), rng.randrange(0, 400)
            p = rng.randrange(0, d)
            rows.append((d, p, x, x + rng.randrange(40, 60), y, y + rng.randrange(40, 60), 0, 1.0))
        rows += rows[:3]
        names = ["doc_id", "partner_id", "first_word", "end_word", "partner_first_word", "partner_end_word", "distance", "similarity"]
        schema = ", ".join(f"{n} {'double' if n == 'similarity' else 'long'}" for n in names)
        got = chain_dedup.with_classes(spark.createDataFrame(rows, schema)).collect()
        ranges = [(r[0], r[2], r[3]) for r in rows] + [(r[1], r[4], r[5]) for r in rows]
        group = list(range(len(ranges)))
        while True:  # least label of what overlaps or is linked
            new = [min(group[j] for j, b in enumerate(ranges) if j == i or (a[0] == b[0] and a[1] < b[2] and b[1] < a[2]) or abs(i - j) == len(rows)) for i, a in enumerate(ranges)]
            if new == group:
                break
            group = new
        want = []
        for i, r in enumerate(rows):
            members = [ranges[j] for j in range(len(ranges)) if group[j] == group[i]]
            least = min(members)
            want.append((*r, least[0], least[1], len({m[0] for m in members})))
        assert sorted(map(tuple, got)) == sorted(want)


def test_chains_by_brute_force():
    rng = random.Random(19)
    for _ in range(60):
        segments = []
        for _ in range(rng.randrange(1, 9)):
            x, y, n = rng.randrange(60), rng.randrange(60), rng.randrange(5, 20)
            segments.append((x, y, x + n, y + n, n))
        segments.sort()
        s = np.array(segments)
        best = [0.0] * len(s)
        for i in range(len(s)):
            best[i] = s[i, 4] + max(
                [0.0, *(best[j] - 0.5 * (s[i, 0] - s[j, 2] + s[i, 1] - s[j, 3]) for j in range(len(s)) if s[j, 2] <= s[i, 0] and s[j, 3] <= s[i, 1])]
            )
        got = chain_dedup.best_chains(s)
        if got:
            worth = s[got[0][0], 4]
            for j, i in zip(got[0], got[0][1:], strict=False):
                worth += s[i, 4] - 0.5 * (s[i, 0] - s[j, 2] + s[i, 1] - s[j, 3])
            assert worth == pytest.approx(max(best))


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(23)
    texts = [*ODD, None, *(prose(rng, rng.randrange(1, 900)) for _ in range(60)), prose(rng, 9000)]
    rows = packing.pack(frame(spark, texts, extra=True), path, with_ids=True).collect()
    own = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert [r.start for r in own[i]] == [*range(0, len(ids), packing.CAPACITY)] and {r.doc_tokens for r in own[i]} == {len(ids)}
        for r in own[i]:
            assert bytes(r.ids) == ids[r.start : r.start + r.length].tobytes() and r.ids_crc32 == zlib.crc32(bytes(r.ids))
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= packing.CAPACITY
    assert packing.pack(frame(spark, []), path).count() == 0


def test_column_generation_reaches_the_bound():
    rng = np.random.default_rng(29)
    histogram = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 257), 60, False), rng.integers(20, 400, 60), strict=True)}
    rows = packing.plan(histogram)
    sequences = {}
    for size, first, last, items, sequence in rows:
        for k in range((last - first + 1) // items):
            sequences[sequence + k] = sequences.get(sequence + k, 0) + size * items
    assert max(sequences.values()) <= 256
    assert sum(sequences.values()) == sum(s * n for s, n in histogram.items())
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes.tolist()], float)
    patterns, used = packing.column_generation(sizes, demand, 256)
    assert np.allclose(np.stack(patterns, axis=1) @ used, demand)
    prices = np.linalg.inv(np.stack(patterns, axis=1).astype(float)).sum(axis=0)
    assert packing.best_pattern(prices, sizes, 256)[0] <= 1 + 1e-6 and prices @ demand == pytest.approx(used.sum())  # so it is the least
    assert used.sum() - 1e-6 <= len(sequences) <= used.sum() + len(sizes)


def labelled(spark, rng, n):
    words = [f"word{i}" for i in range(500)]
    texts, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        bad, rude = rng.random() < 0.25, rng.random() < 0.3
        if bad:
            w = [x.upper() + "!!" for x in w]
        if rude and not bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zonk", "blarg", "grumf"])
        texts.append(" ".join(w) + ".")
        labels.append((i, int(not bad), int(rude and not bad)))
    return texts, labels


def test_classifiers_on_held_out_rows(spark):
    texts, labels = labelled(spark, random.Random(31), 900)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, [*texts, None, ""], extra=True)
    for run, k, modulus, rest in ((quality_classifier.quality_scores, 1, 3, 1), (toxicity.toxicity, 2, 5, 0)):
        rows = {r.doc_id: r for r in run(docs, table).collect()}
        assert len(rows) == 902 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
        assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == rest) for i, r in rows.items())
        held = [i for i in range(900) if rows[i].held_out]
        assert np.mean([rows[i].predicted == labels[i][k] for i in held]) > 0.93
        assert run(frame(spark, []), table.limit(0)).count() == 0
        assert run(docs, table.limit(0)).count() == 902


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"zonk": 2.0, "blar*": 3.0})
    plain, aimed, negated, quoted = (g.clause(toxicity.words_of(t)) for t in ("the zonk thing", "you are a zonk", "not a zonk", 'he said "zonk"'))
    assert aimed > plain == 2.0 > negated > 0 and quoted < aimed
    assert g.clause(toxicity.words_of("i will kill you")) > 0 == g.clause(toxicity.words_of("kill the lights"))
    assert g.features("blargs everywhere. fine")[2] == 1.0 and g.features("xblarg zonks")[2] == 0.0


def test_null_word_counts_and_long_text(spark):
    long = "lorem ipsum dolor sit amet " * 40000
    docs = frame(spark, [long, None])
    assert simhash.simhash_dedup(docs).count() == 2
    assert quality_rules.quality_rules(docs).where("doc_id = 0").first().base_failed
    assert suffix_dedup.suffix_dedup(docs).where("n_removed > 0").count() == 0


def test_plan_of_all_size_classes_ends_beside_a_session(spark):
    import time

    assert spark.range(10).count() == 10  # the driver has its JVM
    rng = np.random.default_rng(7)
    lengths = np.minimum(rng.lognormal(5.5, 1.3, 30000).astype(int) + 1, packing.CAPACITY)
    histogram = dict(zip(*(x.tolist() for x in np.unique(np.r_[-(-lengths // packing.STEP), np.arange(1, 257)], return_counts=True)), strict=True))
    began = time.time()
    rows = packing.plan(histogram)
    assert len(histogram) == 256 and time.time() - began < 60
    used = max(r[4] + (r[2] - r[1] + 1) // r[3] for r in rows)
    least = -(-sum(s * n for s, n in histogram.items()) // 256)
    assert least <= used <= least + 256
    basis = rng.integers(0, 5, (40, 40)) + np.diag(rng.integers(1, 9, 40))
    assert np.allclose(packing.inverted(basis.astype(float)) @ basis, np.eye(40))
