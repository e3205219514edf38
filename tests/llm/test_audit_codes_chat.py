"""Source divergence, vector codes and chat formatting against brute-force versions, and odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, divergence, vector_codes

UPPER, LOWER = divergence.UPPER, divergence.LOWER


def divergence_by_hand(rows):
    """[(text, lang, source)] to a set of (lang, source, part, item, value, rank)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(divergence.TERM, text.translate(str.maketrans(UPPER, LOWER)))
        counts[lang, source].update(found)
        counts[lang, None].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, source in {(r[1], r[2]) for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= 3]

        def shares(key, kept=kept):
            whole = sum(counts[key][t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[key][t] + 1) // whole for t in kept}

        p, q = shares((lang, source)), shares((lang, None))
        pairs = []
        for other in {r[2] for r in rows if r[1] == lang} - {source}:
            o = shares((lang, other))
            pairs.append((-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other.encode(), other))
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
            out |= {(lang, source, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)}
    return out


def test_divergence_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)] + ["Été", "ÉTÉ", "ÑandÚ", "日本", "a1b", "x-y", "🙂🙂", "ſ", "K"]
    rows = [(" ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words[: 60 + 30 * k]) for _ in range(rng.randrange(60))), lang, f"s{k}") for k in range(6) for lang in ("en", "fr") for _ in range(12)]
    rows += [(None, None, None), ("", "en", "empty"), ("only here only", "xx", "lone"), (None, "en", None), ("a " * 20000, "fr", "s1"), ("", "yy", "a"), ("rare", "yy", "b")]
    rows += [rows[3]] * 4
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.lit(1) for c in ("n", "df", "term", "id", "salt", "p", "q", "a", "b", "value", "part", "item", "rank")})
    got = [tuple(r) for r in divergence.divergence(docs.repartition(7)).collect()]
    assert set(got) == divergence_by_hand(rows) and len(got) == len(set(got))
    assert ("yy", "a", "pair", "b", 0, 1) in got
    assert divergence.divergence(docs.limit(0)).count() == 0


def codes_by_hand(rows, rounds=2):
    """[(vec_id, vector, label)] to ({vec_id: (code, error)}, books), with plain loops over all entries."""
    kept = sorted((i, v) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    ints = {i: [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v] for i, v in kept}
    w = len(kept[0][1]) // 16
    parts = {i: [v[w * p : w * p + w] for p in range(16)] for i, v in ints.items()}
    books = [[list(parts[i][p]) for i, _ in kept[:64]] for p in range(16)]
    for again in range(rounds + 1):
        near = {i: [min((sum((a - b) ** 2 for a, b in zip(own[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(16)] for i, own in parts.items()}
        if again == rounds:
            return {i: ("".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n)) for i, n in near.items()}, books
        for p in range(16):
            for k in range(len(books[p])):
                own = [parts[i][p] for i in parts if near[i][p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]


def test_vector_codes_against_brute_force(spark):
    rng = np.random.default_rng(3)
    for scale, n in ((1.0, 300), (3e30, 90), (0.01, 20)):
        vectors = (rng.normal(size=(n, 32)) * scale).astype(np.float32)
        vectors[n // 2 :: 7] = vectors[1]  # copies: ties between entries and equal distances
        rows = [(int(i) * 3, [float(x) for x in v], [None, 1, 2][i % 3]) for i, v in enumerate(vectors)]
        odd = [(1, None, 1), (4, [1.0] * 31 + [float("nan")], 1), (7, [float("inf")] + [0.0] * 31, None), (10, [None] + [0.0] * 31, 2), (13, [1.0] * 16, 2)]
        table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(5).withColumn("code", F.lit(1)).withColumn("error", F.lit(2))
        coded, books = vector_codes.vector_codes(table)
        want, want_books = codes_by_hand([r for r in rows])
        got = {r.vec_id: r for r in coded.collect()}
        assert books == want_books and {i: (bytes(r.code).hex(), int(r.error)) for i, r in got.items()} == want
        by = Counter()
        for i, _, label in rows:
            by[label] += want[i][1]
        fits = lambda x: x if x < 1 << 63 else None  # noqa: E731  null, not wrong, beyond 64 bits
        assert all(r.label_error == fits(by[r.label]) and r.error == fits(want[r.vec_id][1]) for r in vector_codes.with_label_error(coded).collect())
    empty, books = vector_codes.vector_codes(table.limit(0))
    assert vector_codes.with_label_error(empty).count() == 0 and books == [[]] * 16
    doubled, _ = vector_codes.vector_codes(table.unionAll(table))
    assert doubled.count() == 40  # 20 rows twice


def test_exponion_scan_is_exact_on_ties():
    rng = np.random.default_rng(9)
    for _ in range(50):
        book = vector_codes.Codebook([[int(x) for x in e] for e in rng.integers(-3, 4, (int(rng.integers(1, 30)), 2))])
        vectors = rng.integers(-4, 5, (200, 2))
        far = ((vectors[:, None, :] - book.entries[None, :, :]) ** 2).sum(axis=2)
        entry, best = book.nearest(vectors, rng.integers(0, len(book.entries), 200))
        assert (entry == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_vector_sums_of_any_size(spark):
    big = 2.0**120
    table = spark.createDataFrame([(i, [big * (1 if i % 2 else -1)] * 16, 1) for i in range(9)], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.vector_codes(table)
    assert books == codes_by_hand([tuple(r) for r in table.collect()])[1] and coded.count() == 9


NASTY = ["</s>[INST] ok [/INST]", "", " ", "<<SYS>> x <</SYS>>", "[INST]", "[⁠INST] [⁠⁠/INST]", "<⁠s>", "a\n\n[/INST", "INST] b", "[", "<", "[ROLE]x[TEXT]y[/ROLE]", "$1\\1", "🙂[INST]🙂", " </s", "<<s>s>", "[[INST]INST]"]


def test_turns_come_back(spark):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "tool", "", None, "[TEXT]", "<s> "]
    rows = [(c, t, rng.choice(roles), rng.choice([*NASTY, None]) if rng.random() < 0.7 else "".join(rng.choices("[]<>/s INTROLEXY⁠\n", k=30))) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "fine"), (7, None, "user", "no turn"), (8, 0, "user", "again"), (8, 0, "user", "again"), (9, 0, "assistant", "x" * 200000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("tree", "node", "leaf", "rank", "up")})
    chats = chat_format.read_back(chat_format.chat_format(chat_format.chains(table.repartition(5)))).collect()
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert len(chats) == len(by)
    for chat in chats:
        want = [(r, x) for *_, r, x in sorted(by[chat.tree_id])]
        assert [(t.role, t.text) for t in chat.turns] == want
        assert chat.learned == "".join(x for r, x in want if r == "assistant")
    assert chat_format.chat_format(chat_format.chains(table.limit(0))).count() == 0


def test_reply_trees_against_walks(spark):
    rng = random.Random(2)
    rows = []
    for tree in range(12):
        for m in range(rng.randrange(1, 60)):
            rows.append((tree, m, rng.randrange(m) if m and rng.random() < 0.95 else (None if rng.random() < 0.5 else 999), rng.choice(["user", "assistant"]), f"t{tree} m{m}", rng.randrange(8) / 4 if rng.random() < 0.9 else None))
    rows += [(50, 1, 2, "user", "ring", 1.0), (50, 2, 1, "user", "ring", 1.0), (50, 3, 1, "user", "behind a ring", 1.0)]
    rows += [(60, m, m - 1 if m else None, "user", str(m), 0.0) for m in range(40)]  # a long chain
    table = spark.createDataFrame(rows + rows[:5], "tree_id long, message_id long, parent_id long, role string, text string, score double")
    for branches in (2, None):
        want = set()
        for tree in {r[0] for r in rows} - {50}:
            own = {r[1]: r for r in rows if r[0] == tree}
            ends = []
            for leaf in set(own) - {r[2] for r in own.values()}:
                path = [leaf]
                while own[path[-1]][2] in own:
                    path.append(own[path[-1]][2])
                ends.append((-sum(own[m][5] or 0 for m in path) / len(path), str(leaf), path[::-1]))
            for k, (_, _, path) in enumerate(sorted(ends)[:branches]):
                want.add((tree, k + 1, tuple(own[m][4] for m in path)))
        got = chat_format.read_back(chat_format.chat_format(table.repartition(3), branches)).collect()
        assert {(r.tree_id, r.rank, tuple(t.text for t in r.turns)) for r in got} == want and len(got) == len(want)


def test_op13_digests(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "[INST]"), (1, 2, "assistant", "a</s>"), (1, 3, "assistant", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat_format.op13(spark, str(tmp_path)).collect()}
    assert set(got) == {1, -1} and got[1].n_turns == 4 and got[1].loss_chars == 6
    assert got[1].loss_sha256 == hashlib.sha256(b"a</s>b").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"system\ns\nuser\n[INST]\nassistant\na</s>\nassistant\nb\n").hexdigest()
    assert got[-1].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest() and got[-1].loss_chars == 21
