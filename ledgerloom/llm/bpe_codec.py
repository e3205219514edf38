"""Byte-level BPE encoding by per-prefix dynamic programming, and decoding."""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Chunks and words one worker remembers, and token pairs.
REMEMBERED, REMEMBERED_PAIRS = 400_000, 1_000_000
#: Fixed value: the public pattern that splits a text for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text with none of these splits at its spaces: every piece of the pattern then lies between two spaces.
MIXED_SPACE = r"[^\S \n]|  | \n|\n "
#: Ranks above all others: of the merge that never comes, and of a pair that has none.
NEVER, NONE = 1 << 30, (1 << 31, 0)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SuffixAutomaton:
    """Generalised suffix automaton of the tokens: reads bytes, and tells the tokens that are suffixes of what it read."""

    def __init__(self, tokens: dict[bytes, int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for token in tokens:
            state = 0
            for b in token:
                state = self._extend(state, b)
        self.token: list[int] = [-1] * len(self.next)
        for token, i in tokens.items():
            state = 0
            for b in token:
                state = self.next[state][b]
            self.token[state] = i  # a whole token is the longest string of its state
        self.shorter: dict[int, tuple[int, ...]] = {0: (), -1: ()}

    def _extend(self, last: int, b: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if b in nxt[last]:
            q = nxt[last][b]
            return q if length[q] == length[last] + 1 else self._split(last, b, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and b not in nxt[p]:
            nxt[p][b] = new
            p = link[p]
        if p != -1:
            q = nxt[p][b]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, b, q)
        return new

    def _split(self, p: int, b: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(b) == q:
            nxt[p][b] = copy
            p = link[p]
        link[q] = copy
        return copy

    def suffixes(self, state: int, read: int) -> tuple[int, ...]:
        """Tokens that end here, longest first; read: bytes of the current match."""
        if read == self.length[state] and self.token[state] >= 0:
            return self._all(state)
        return self._all(self.link[state])

    def _all(self, state: int) -> tuple[int, ...]:
        if state not in self.shorter:
            own = (self.token[state],) if self.token[state] >= 0 else ()
            self.shorter[state] = own + self._all(self.link[state])
        return self.shorter[state]


class ByteBpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE, no prefix space)."""

    def __init__(self, vocabulary_file: str):
        import regex

        with open(vocabulary_file, encoding="utf-8") as f:
            model = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        vocab = {to_bytes(s): i for s, i in model["model"]["vocab"].items() if s not in self.special}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"]]
        self.rank = {(vocab[to_bytes(a)], vocab[to_bytes(b)]): (r, vocab[to_bytes(a + b)]) for r, (a, b) in enumerate(pairs)}
        self.parts = {ab: (r, pair) for pair, (r, ab) in self.rank.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in vocab.items():
            self.bytes[i] = s
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.size = [len(s) for s in self.bytes]
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.matches = SuffixAutomaton(vocab)
        self.split = regex.compile(PATTERN)
        self.mixed = regex.compile(MIXED_SPACE)
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pair: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """Merges by rank until none is left: the definition, for short inputs."""
        while len(ids) > 1:
            r, i = min((self.rank.get((a, b), (NEVER, 0))[0], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)))
            if r == NEVER:
                break
            ids[i : i + 2] = [self.rank[ids[i], ids[i + 1]][1]]
        return ids

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge (0: left, 1: right) of a token's merge tree, from its byte up, each with the rank of
        the merge that ends it (the whole token's never comes)."""
        known = self.spines[side].get(token)
        if known is None:
            known = [(token, NEVER)]
            while known[-1][0] in self.parts:
                r, pair = self.parts[known[-1][0]]
                known.append((pair[side], r))
            known.reverse()
            self.spines[side][token] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens, joined, encode as just these two.

        While the two are built by rising ranks, one edge token of each side meets at the border.  They are torn apart
        if the merge of these two comes before either side's next one; of equal ranks the left one comes first.
        """
        key = a << 20 | b
        known = self.pair.get(key)
        if known is None:
            left, right, i, j, rank = self.spine(a, 1), self.spine(b, 0), 0, 0, self.rank
            while True:
                (x, x_end), (y, y_end) = left[i], right[j]
                r = rank.get((x, y), NONE)[0]
                if r < x_end and r <= y_end:
                    known = False
                    break
                if x_end == NEVER and y_end == NEVER:
                    known = True
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            if len(self.pair) >= REMEMBERED_PAIRS:
                self.pair.clear()
            self.pair[key] = known
        return known

    def encode_word(self, word: str) -> bytes:
        """Ids of one piece of the pattern, as little-endian unsigned 32-bit integers.

        last[i] is the one token that ends the encoding of the first i bytes: of the tokens that match there, the one
        that starts the text or goes with the last token before it.  The way back through last is the encoding.
        """
        known = self.words.get(word)
        if known is not None:
            return known
        raw = word.encode()
        m, size, pair = self.matches, self.size, self.pair
        nxt, link, length = m.next, m.link, m.length
        last = [-1] * (len(raw) + 1)
        state = read = 0
        for end, b in enumerate(raw, 1):
            while state and b not in nxt[state]:
                state = link[state]
                read = length[state]
            state = nxt[state][b]
            read += 1
            for t in m.suffixes(state, read):
                start = end - size[t]
                if start == 0:
                    last[end] = t
                    break
                before = last[start]
                fits = pair.get(before << 20 | t)
                if fits is None:
                    fits = self.compatible(before, t)
                if fits:
                    last[end] = t
                    break
        ids, end = [], len(raw)
        while end:
            ids.append(last[end])
            end -= size[last[end]]
        ids.reverse()
        known = array("I", ids).tobytes()
        if len(raw) <= 64:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[word] = known
        return known

    def _plain(self, text: str) -> bytes:
        if self.mixed.search(text):
            return b"".join(map(self.encode_word, self.split.findall(text)))
        first, *rest = text.split(" ")
        chunks, out = self.chunks, [self._chunk(first)] if first else []
        for c in rest:
            known = chunks.get(c)
            if known is None:
                known = self._chunk(" " + c)
                if len(c) <= 64:
                    if len(chunks) >= REMEMBERED:
                        chunks.clear()
                    chunks[c] = known
            out.append(known)
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.encode_word, self.split.findall(chunk)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a special token's own string is that token."""
        if not self.at_special or not self.at_special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += [self._plain(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _of(vocabulary_file: str) -> ByteBpe:
    return ByteBpe(vocabulary_file)


def encode_documents(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) of every text.

    A null text is an empty one and has no ids; texts of any length are encoded whole; repeated rows have equal rows; a
    null doc_id stays null; no rows in, no rows out.  Columns besides doc_id and text are ignored, whatever their names.
    """

    def run(batches):
        codec = _of(vocabulary_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"]
                )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary_file: str) -> DataFrame:
    """The input's columns but ids, and text: what its ids stand for (null ids: empty)."""
    keep = [c for c in encoded.columns if c not in ("ids", "text")]

    def run(batches):
        codec = _of(vocabulary_file)
        for batch in batches:
            text = [codec.decode(x or b"") for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(text, pa.string())], [*keep, "text"])

    fields = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c in keep)
    return encoded.mapInArrow(run, f"{fields}, text string")


def round_trip(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; encodes and decodes in one pass over the table.  Null,
    empty, long and repeated texts, empty tables and further columns are as in encode_documents()."""

    def run(batches):
        codec = _of(vocabulary_file)
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                ids = codec.encode(t or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode("utf-8", "replace")).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
