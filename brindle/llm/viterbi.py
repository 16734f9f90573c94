"""Token counts of a unigram tokenizer, by dynamic programming over automaton matches.

The vocabulary is a set of pieces with scores. An Aho-Corasick automaton lists every piece that occurs in
a word; over these matches the best path is found carrying only (score, number of ids), never the pieces.
Ties go as in the public library's unigram model: matches are tried by start, and a path replaces another
only if its score is strictly greater, so the piece that starts first wins. A character without a piece of
its own gets the unknown score (lowest score less 10); unknown characters count as their UTF-8 bytes, as
the byte pieces stand for them. Scores are 64-bit floats, summed from left to right.

Text is cut as the library's Metaspace step does: a space becomes U+2581 and starts a new word, and the
first word gets one too. Words are independent, so counts are kept in a bounded memo.

Defined cases: a null or empty text has no tokens; equal texts have equal counts; words of any length take
time linear in it (pieces are of bounded length) and memory for a score, a count and the matches of each character.
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame

from .common import Memo, map_rows, per_process

SPACE = "▁"
UNK_PENALTY = 10.0
#: Longer words are counted without a place in the memo.
MEMO_CHARS = 64


def load_pieces(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.unk = min(s for _, s in pieces) - UNK_PENALTY
        a = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                a.add_word(piece, (len(piece), score))
        a.make_automaton()
        self.matches = a.iter

    def count(self, word: str) -> tuple[int, float]:
        """Number of ids and the score of the best path."""
        n = len(word)
        by_start: list[list | None] = [None] * n
        for end, (size, score) in self.matches(word):
            start = end + 1 - size
            if by_start[start] is None:
                by_start[start] = [(size, score)]
            else:
                by_start[start].append((size, score))
        best: list[float | None] = [None] * (n + 1)
        ids = [0] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            here, k, single = best[at], ids[at], False
            for size, score in by_start[at] or ():
                total, to = score + here, at + size
                single = single or size == 1
                if best[to] is None or total > best[to]:
                    best[to], ids[to] = total, k + 1
            if not single:
                total = self.unk + here
                if best[at + 1] is None or total > best[at + 1]:
                    best[at + 1], ids[at + 1] = total, k + len(word[at].encode("utf-8", "surrogatepass"))
        return ids[n], best[n]


def words_of(text: str) -> list[str]:
    """Words without their U+2581."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    return text[text[0] == " " :].split(" ")


SCHEMA = "doc_id long, n_words long, n_tokens long, score double"


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, score (of the best path, summed over words)."""
    held = docs.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary; its size does not follow the data

    def rows(ids, texts):
        counter = per_process(("viterbi", len(held.value), held.value[-1]), lambda: Counter(held.value))
        memo = per_process(("viterbi-memo", len(held.value), held.value[-1]), lambda: Memo(lambda w: counter.count(SPACE + w), 64 << 20))
        for i, t in zip(ids, texts, strict=True):
            words = words_of(t or "")
            found = [memo[w] if len(w) <= MEMO_CHARS else counter.count(SPACE + w) for w in words]
            yield i, len(words), sum(n for n, _ in found), float(sum(s for _, s in found))

    return map_rows(docs, [doc_id, text], rows, SCHEMA)
