"""Token counts by a count-only Viterbi search over a unigram vocabulary."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Distinct words one worker remembers.
REMEMBERED = 600_000
BAR = "▁"  # the piece files write a space as this


def piece_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in id order; the scores are read as unigram log-probabilities."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Counts the pieces of the best segmentation of a word, without building the segmentation.

    An Aho-Corasick automaton of the vocabulary lists every piece that ends at each character.  For each prefix the
    search carries only the best score and the number of pieces behind it.  Ties go as in the tokenizers library: at
    each end the piece that starts first wins, so a later, shorter piece must score strictly more.  A character that is
    no piece by itself may be unknown (lowest score less 10) and counts one piece for each of its bytes.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - 10.0

    def __call__(self, word: str) -> int:
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        done = 0  # prefixes up to here are settled
        top, pieces, single = None, 0, False

        def settle(end: int) -> None:
            nonlocal top, pieces, single
            if not single:
                score = best[end - 1] + self.unknown
                if top is None or score > top:
                    top, pieces = score, count[end - 1] + len(word[end - 1].encode())
            best[end], count[end] = top, pieces
            top, pieces, single = None, 0, False

        for last, (length, score) in self.matches.iter(word):
            while done < last:
                done += 1
                settle(done)
            start = last + 1 - length
            total = best[start] + score
            if top is None or total > top:
                top, pieces = total, count[start] + 1
            if length == 1:
                single = True
        while done < n:
            done += 1
            settle(done)
        return count[n]


class Remembered(dict):
    """Counts by word; forgets all when full, so that a worker's memory is bounded."""

    def __init__(self, counter: UnigramCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = self.counter(BAR + word)
        return n


@lru_cache(maxsize=2)
def _of(model_file: str) -> Remembered:
    return Remembered(UnigramCounter(piece_vocabulary(model_file)))


def count_text(text: str | None, known: Remembered) -> int:
    """Pieces of a whole text: words are split at spaces, each with the bar in front, as Metaspace does."""
    if not text:
        return 0
    if BAR in text:
        text = text.replace(BAR, " ")
    if text[0] == " ":
        text = text[1:]
    return sum(map(known.__getitem__, text.split(" ")))


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per document: doc_id, n_tokens.

    Null and empty texts have no tokens; texts of any length are read whole; of pieces with one score the earlier in the
    vocabulary counts, and of equal splits the library's; repeated rows have equal rows; a null doc_id stays null; no
    rows in, no rows out.  Columns besides doc_id and text are ignored, whatever their names.
    """

    def run(batches):
        known = _of(model_file)
        for batch in batches:
            n = [count_text(t, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def op1(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
