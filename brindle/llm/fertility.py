"""Quality rules by tokeniser fertility.

Public vocabularies measure a text: characters per token and the share of byte-fallback tokens under a
sentencepiece vocabulary, characters per token under a byte-level one, and the entropy of the text's token
distribution (bits per token, over log2 of the number of tokens at most). A text is rejected if a measure
leaves the band of its language; languages without a band of their own take that of the text's script.
Words are tokenised one by one: each distinct word of a slice of texts once, and its measures are kept in a bounded memo.

Beside the measures stand base counts of words, symbols, repeated lines and repeated word triples, with two
base rejections. Counting is linear in the text; memory is that of one batch of texts.

Defined cases: a null text has no words and fails the base rule; a text with fewer than ``MIN_TOKENS``
tokens is not judged by the method (only by the base rules); a null or unknown language takes its script's
band; a text without letters takes the band ``other``; equal texts have equal measures.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, Memo, filter_rows, map_rows, per_process, split_words

WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
MEMO_CHARS = 64
MIN_WORDS = 50
MIN_TOKENS = 50
#: Characters of texts whose distinct words are measured together.
SLICE_CHARS = 3 << 20


@dataclass(frozen=True)
class Band:
    """Characters per token of the two vocabularies, byte share, and entropy in bits."""

    piece_low: float
    piece_high: float
    byte_low: float
    byte_high: float
    bytes_most: float
    entropy_low: float


#: Rejection bands by language, then by script.
BANDS = {
    "en": Band(1.75, 6.0, 1.95, 7.0, 0.02, 5.0),
    "de": Band(1.75, 6.0, 2.00, 7.0, 0.02, 5.0),
    "fr": Band(1.55, 6.0, 1.72, 7.0, 0.02, 5.0),
    "es": Band(1.65, 6.0, 1.95, 7.0, 0.02, 5.0),
    "latin": Band(1.35, 6.0, 1.25, 7.0, 0.05, 3.5),
    "cyrillic": Band(1.10, 6.0, 0.50, 6.0, 0.10, 3.5),
    "greek": Band(0.80, 5.0, 0.45, 5.0, 0.10, 3.5),
    "arabic": Band(0.60, 5.0, 0.45, 5.0, 0.60, 3.5),
    "cjk": Band(0.30, 3.0, 0.25, 3.0, 0.90, 3.5),
    "other": Band(0.25, 6.0, 0.20, 7.0, 1.00, 3.0),
}

#: First and last code point of letters of a script.
SCRIPTS = (
    ("latin", 0x41, 0x24F),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("arabic", 0x600, 0x77F),
    ("cjk", 0x3040, 0x30FF),
    ("cjk", 0x4E00, 0x9FFF),
    ("cjk", 0xAC00, 0xD7AF),
)


def script_of(text: str) -> str:
    """The script with most letters of the text; the first listed at a tie; ``other`` without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    n: Counter = Counter()
    for c, k in Counter(text).items():
        if c.isalpha():
            n[next((s for s, lo, hi in SCRIPTS if lo <= ord(c) <= hi), "other")] += k
    order = [s for s, _, _ in SCRIPTS] + ["other"]
    return max(n, key=lambda s: (n[s], -order.index(s))) if n else "other"


class Vocabularies:
    """A sentencepiece model with byte fallback and a byte-level vocabulary."""

    def __init__(self, piece_model: str, byte_ranks: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.sp = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        with open(byte_ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_level = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = [self.sp.is_byte(i) for i in range(self.sp.get_piece_size())]
        self.ids = list(range(self.sp.get_piece_size()))  # one object for each id
        self.bytes = np.array(self.is_byte)

    def measure(self, word: str) -> tuple[tuple[int, ...], int, int]:
        """Piece ids, how many of them are bytes, and the number of byte-level tokens."""
        ids = tuple(map(self.ids.__getitem__, self.sp.encode(word)))
        return ids, sum(map(self.is_byte.__getitem__, ids)), len(self.byte_level.encode_ordinary(word))

    def packed(self, words: list[str]) -> list[bytes]:
        """For each word its piece ids and then the number of byte-level tokens, as 32-bit numbers."""
        pieces, tokens = self.sp.encode(words, num_threads=1) if words else [], self.byte_level.encode_ordinary
        return [array("I", [*ids, len(tokens(w))]).tobytes() for w, ids in zip(words, pieces, strict=True)]


def repeated_words(words: list[str], size: int = 3) -> int:
    """Words in windows of ``size`` words that occur at least twice."""
    grams = list(zip(*(words[k:] for k in range(size)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    n, seen, end = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if n[g] > 1:
            seen += i + size - max(end, i)
            end = i + size
    return seen


def repeated_numbers(words: np.ndarray) -> int:
    """As ``repeated_words`` in windows of three, of words that are numbers below 2**21."""
    grams = words[:-2] << 42 | words[1:-1] << 21 | words[2:]
    order = np.sort(grams)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(grams, twice)
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(again)] |= again
    return int(hit.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    n = Counter(lines)
    return sum(k - 1 for line, k in n.items() if k > 1 and WORDS.search(line))


def entropy(counts: list[int] | np.ndarray) -> float:
    counts = np.asarray(counts)
    total = int(counts.sum())
    many = counts[counts > 1]
    return math.log2(total) - math.fsum((many * np.log2(many)).tolist()) / total if total else 0.0


def verdict(band: Band, chars: int, pieces: int, byte_pieces: int, byte_tokens: int, bits: float) -> bool:
    """True if the measures are within the band. Few tokens can have little entropy: seven tenths of the most suffice."""
    if pieces < MIN_TOKENS:
        return True
    low = min(band.entropy_low, 0.7 * math.log2(pieces))
    return (
        band.piece_low <= chars / pieces <= band.piece_high
        and band.byte_low <= chars / byte_tokens <= band.byte_high
        and byte_pieces <= band.bytes_most * pieces
        and bits >= low
    )


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_pieces long, n_byte_pieces long, n_byte_tokens long, token_bits double, band string"
)


class Rater:
    """Rates texts in a worker; made from plain values, so it is cheap to ship."""

    def __init__(self, piece_model: str, byte_ranks: str, bands: dict[str, Band]):
        self.paths, self.plain = (piece_model, byte_ranks), {k: astuple(b) for k, b in bands.items()}

    def __call__(self, texts: list, langs: list) -> Iterator[tuple]:
        at = size = 0
        for end, t in enumerate(texts, 1):
            size += len(t or "")
            if size >= SLICE_CHARS or end == len(texts):
                yield from self._slice([t or "" for t in texts[at:end]], langs[at:end])
                at, size = end, 0

    def _measures(self, v: Vocabularies, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece ids of all words, how many each has, byte-level tokens of each). ``words``: distinct."""
        memo = per_process(("fertility-words", *self.paths), lambda: Memo(lambda w: v.packed([w])[0], 96 << 20))
        got = list(map(memo.get, words))
        new = []
        fresh: dict[str, bytes] = {}
        for k in [k for k, x in enumerate(got) if x is None]:
            if (x := memo.old.get(words[k])) is not None:
                got[k] = fresh[words[k]] = x
            else:
                new.append(k)
        for at in range(0, len(new), 5000):
            few = new[at : at + 5000]
            for k, x in zip(few, v.packed([words[k] for k in few]), strict=True):
                got[k] = x
                if len(words[k]) <= MEMO_CHARS:
                    fresh[words[k]] = x
        memo.put_all(fresh, sum(map(len, fresh)) + sum(map(len, fresh.values())) + 90 * len(fresh))
        flat, ends = np.frombuffer(b"".join(got), np.uint32), np.cumsum(np.array([len(x) // 4 for x in got], np.int64))
        is_id = np.ones(len(flat), bool)
        is_id[ends - 1] = False
        return flat[is_id].astype(np.int64), np.diff(ends, prepend=0) - 1, flat[ends - 1].astype(np.int64)

    def _slice(self, texts: list[str], langs: list) -> Iterator[tuple]:
        v = per_process(("fertility", *self.paths), lambda: Vocabularies(*self.paths))
        table = {k: Band(*b) for k, b in self.plain.items()}
        index, words, before = split_words(pa.array(texts, pa.large_string()))
        index, n_words = index.astype(np.int64), np.diff(before)
        ids, n_ids, others = self._measures(v, words)

        def of_texts(by_word: np.ndarray) -> list[int]:
            return np.diff(np.concatenate(([0], np.cumsum(by_word[index])))[before]).tolist()

        first = np.cumsum(n_ids) - n_ids
        sums = np.concatenate(([0], np.cumsum(v.bytes[ids])))
        chars, pieces, tokens, byte_pieces = (of_texts(x) for x in (np.array([len(w) for w in words], np.int64), n_ids, others, sums[first + n_ids] - sums[first]))
        # how often each piece is in a text: runs of equal (text, piece)
        n = n_ids[index]
        start = np.cumsum(n) - n
        key = ids[np.repeat(first[index] - start, n) + np.arange(int(n.sum()))]
        kinds = len(v.ids)
        key += np.repeat(np.arange(len(texts)) * kinds, pieces)
        key.sort()
        edge = np.flatnonzero(np.concatenate((key[:1] >= 0, key[1:] != key[:-1])))
        counts = np.diff(np.append(edge, len(key)))
        cuts = np.searchsorted(key[edge], np.arange(len(texts) + 1) * kinds).tolist()
        for k, (t, g) in enumerate(zip(texts, langs, strict=True)):
            a, b = before[k : k + 2]
            n_repeat = repeated_numbers(index[a:b]) if len(words) < 1 << 21 else repeated_words(index[a:b].tolist())
            failed = bool(n_words[k] < MIN_WORDS or 100 * n_repeat > 50 * n_words[k])
            bits = entropy(counts[cuts[k] : cuts[k + 1]])
            name = g if g in table else script_of(t)
            good = verdict(table[name if name in table else "other"], chars[k], pieces[k], byte_pieces[k], tokens[k], bits)
            symbols = sum(map(t.count, SYMBOLS))
            yield int(n_words[k]), chars[k], symbols, repeated_lines(t), n_repeat, failed, not failed and good, pieces[k], byte_pieces[k], tokens[k], bits, name


def rate(
    docs: DataFrame, piece_model: str, byte_ranks: str, bands: dict[str, Band] = BANDS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """One row per document: base counts, measures, and whether it is kept."""
    rater = Rater(piece_model, byte_ranks, bands)

    def rows(ids, texts, langs):
        for i, r in zip(ids, rater(texts, langs), strict=True):
            yield i, *r

    return map_rows(docs, [doc_id, text, lang], rows, SCHEMA)


def keep_good(docs: DataFrame, piece_model: str, byte_ranks: str, bands: dict[str, Band] = BANDS, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without those that are rejected, with all columns."""
    rater = Rater(piece_model, byte_ranks, bands)
    return filter_rows(docs, [text, lang], lambda texts, langs: [r[6] for r in rater(texts, langs)])
