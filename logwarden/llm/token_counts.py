"""Token counts by a count-only Viterbi pass over a unigram vocabulary (operator 6)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.tokens import tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
#: How much worse than the worst piece a character outside the vocabulary scores; fixed by the tokenizer.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"


def unigram_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores by id, and the id of the unknown piece, from a vocabulary file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], sp.unk_id()


class Counter:
    """``count(text)``: how many ids the unigram tokenizer gives for a text.

    The text gets a space mark in front unless it begins with a space, spaces become marks, and every mark begins a new
    word. In a word the pieces with the largest sum of scores win. A position is reached from the left, and a later
    start only takes over with a strictly larger sum, so of equal sums the longest last piece stays. Where no piece of
    one character begins, that character can be unknown, at the worst score less a penalty; it counts one id per UTF-8
    byte, as the vocabulary has all bytes.

    An Aho-Corasick automaton gives all pieces that end at a position, longest first, which is the order of their starts.
    Only the best sum and its number of ids are kept for a position, no path. Words repeat, so their counts are kept, as
    many as ``limit``; other words are counted again.
    """

    def __init__(self, pieces: list[tuple[str, float]], unknown: int, limit: int = 300_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        known: dict[str, float] = {}
        for i, (piece, score) in enumerate(pieces):
            if piece and i != unknown:
                known[piece] = score
        for piece, score in known.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in known if len(p) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.seen: dict[str, int] = {}
        self.limit = limit

    def word(self, word: str) -> int:
        n = len(word)
        best, ids = [None] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        matches, nothing = self.automaton.iter(word), (n, None)
        end, found = next(matches, nothing)
        for to in range(1, n + 1):
            top, count = None, 0
            while end == to - 1:
                length, score = found
                total = score + best[to - length]
                if top is None or total > top:
                    top, count = total, ids[to - length] + 1
                end, found = next(matches, nothing)
            char = word[to - 1]
            if char not in self.single:
                total = self.unknown + best[to - 1]
                if top is None or total > top:
                    top, count = total, ids[to - 1] + len(char.encode("utf-8", "surrogatepass"))
            best[to], ids[to] = top, count
        return ids[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        seen, total = self.seen, 0
        parts = text.replace(SPACE, " ").split(" ")
        if parts[0] == "":
            del parts[0]
        for part in parts:
            n = seen.get(part)
            if n is None:
                n = self.word(SPACE + part)
                if len(part) <= 64:
                    if len(seen) >= self.limit:
                        seen.clear()
                    seen[part] = n
            total += n
        return total


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens for every row of ``docs`` (doc_id, text): ids of the whole text under a unigram vocabulary.

    Null and empty texts have 0 tokens. Repeated rows are counted each; other columns are not looked at; no rows give no
    rows. One pass without a shuffle; a task holds one batch, the vocabulary and a bounded number of words.
    """
    file = path or tokenizer_path(VOCABULARY)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = file if os.path.exists(file) else tokenizer_path(os.path.basename(file))
        counter = Counter(*unigram_vocabulary(here))
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", F.col("text")).mapInArrow(counted, f"doc_id {kind}, n_tokens bigint")
