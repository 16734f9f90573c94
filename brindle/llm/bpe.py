"""BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

Encoding. A sequence of tokens is the BPE encoding of its text exactly if each token encodes to itself and
no merge ever crosses the boundary of two neighbours. A crossing merge depends only on the pieces at the
right edge of the left token and at the left edge of the right one while they are built, so every pair of
tokens is either compatible or not, once and for all. Hence each prefix has exactly one last token that is
compatible with the encoding before it, and the transducer keeps just that: one token per position.

A token can be emitted once every position from which a later token may start has it in its chain. The
merge list bounds how far that can lie ahead: whether a merge happens can hang on an earlier merge to the
right that takes away its right part, which can hang on a still earlier one, and so on; ``lookahead`` is
the longest such chain in symbols. The buffer of a stream is cut to that bound plus the longest token.

Decoding. Ids are fed one at a time; bytes run through a UTF-8 state machine that gives out text as soon
as it is whole, with U+FFFD for what can't be part of any character. A tokenizer file without a decoder
gives token strings joined by one space, as its library's ``decode`` does.

A table is encoded in slices of texts: the distinct words of a slice are cut into pieces, and its distinct pieces go
through the transducer in lockstep, a position of all pieces at a time (``Lockstep``).

Defined cases: a null or empty text has no ids and decodes to the empty string; equal texts have equal
ids; a word of any length is encoded in time linear in it with a buffer of bounded length; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import Memo, per_process, slices, split_words

INF = 1 << 60
#: Longer words are encoded without a place in the memo.
MEMO_CHARS = 64
#: Characters of words that need no library call to normalise and split: printable ASCII and the letters
#: U+00C0 to U+024F (without the two signs among them and U+0130, whose lower case is two characters).
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ɏ]+")
LETTER = "a-zA-ZÀ-ÖØ-öø-ɏ"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\\s{LETTER}0-9]+")
PLAIN_TEXT = re.compile(f"[ {PLAIN.pattern[1:]}")
SPLIT_WORDS = re.compile(f"{SPLIT.pattern}| ")
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


#: The stand-ins of bytes from 128 on; printable ASCII stands for itself.
BYTE_CHARS = dict(enumerate(byte_chars()[128:], 128))


#: Words cut or joined at a time.
FEW_WORDS = 10_000


def plain_words(words: list[str], barred: str) -> np.ndarray:
    """Which words (without ASCII white space) are plain and do not hold ``barred``; tried many at a time."""
    out = np.ones(len(words), bool)
    for at in range(0, len(words), 200):
        few = words[at : at + 200]
        text = " ".join(few)
        if barred in text or not PLAIN_TEXT.fullmatch(text):
            out[at : at + 200] = [PLAIN.fullmatch(w) is not None and barred not in w for w in few]
    return out


def plain_pieces(words: list[str]) -> tuple[list[str], np.ndarray]:
    """(the distinct pieces of plain words, the numbers of each word's pieces). Number 0 is a space, which stands before
    each word; bytes of the other pieces are in their stand-ins."""
    texts = (" " + " ".join(words[at : at + FEW_WORDS]).lower() for at in range(0, len(words), FEW_WORDS))
    found = pa.chunked_array([pa.array(SPLIT_WORDS.findall(t)) for t in texts], pa.string()).combine_chunks().dictionary_encode()
    pieces = [p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_CHARS) for p in found.dictionary.to_numpy(zero_copy_only=False).tolist()]
    return pieces, found.indices.to_numpy()


class Merges:
    """A merge list over vocabulary strings, with what streaming needs of it."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        self.rank: dict[tuple[str, str], int] = {}
        for i, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), i)
        self.longest = max((len(self._symbols(t)) for t in vocab), default=1)
        self._edges = Memo(self.edges, 8 << 20)
        self._pairs = Memo(lambda p: self._compatible(*p), 16 << 20)
        self._prefixes = Memo(lambda p: self._last(p, len(p), ""), 16 << 20)
        self._lookahead: int | None = None
        self._good: dict[str, int] | None = None
        self._lengths: dict = {}  # by the last two symbols of a token: lengths of such tokens, longest first

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merge(self, symbols: list[str]) -> list[tuple]:
        """Plain BPE: trees (token, rank, left, right) of the final tokens."""
        parts: list[tuple] = [(s, -1, None, None) for s in symbols]
        while len(parts) > 1:
            ranks = [self.rank.get((a[0], b[0]), INF) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == INF:
                break
            i = ranks.index(best)
            a, b = parts[i], parts[i + 1]
            parts[i : i + 2] = [(a[0] + b[0], best, a, b)]
        return parts

    def edges(self, token: str) -> tuple[tuple, tuple] | None:
        """Left and right edge of a token while it is built: (part, rank at which it is taken up).

        None if the token does not encode to itself, so no encoding has it."""
        parts = self.merge(self._symbols(token))
        if len(parts) > 1 or parts[0][0] not in self.vocab:
            return None
        left, right = [], []
        for out, side in ((left, 2), (right, 3)):
            node, taken = parts[0], INF
            while node:
                out.append((node[0], taken))
                node, taken = node[side], node[1]
        return tuple(left), tuple(right)

    def _compatible(self, a: str, b: str) -> bool:
        rank = self.rank.get
        for x, x_taken in self._edges[a][1]:
            for y, y_taken in self._edges[b][0]:
                r = rank((x, y))
                # at equal rank the pair further left goes first
                if r is not None and r < x_taken and r <= y_taken:
                    return False
        return True

    @property
    def lookahead(self) -> int:
        """Symbols behind a boundary that can decide it, at most."""
        if self._lookahead is None:
            ahead: dict[str, int] = {}
            right_part: dict[str, str] = {}
            most = 0
            for (a, b), _ in sorted(self.rank.items(), key=lambda kv: kv[1]):
                far, part = 0, b
                while part is not None:
                    far = max(far, ahead.get(part, 0))
                    part = right_part.get(part)
                here = len(self._symbols(b)) + far
                ahead[a] = max(ahead.get(a, 0), here)
                right_part.setdefault(a + b, b)
                most = max(most, here)
            self._lookahead = most
        return self._lookahead

    def _self_encoding(self) -> dict[str, int]:
        """Tokens that encode to themselves, with their length in symbols."""
        if self._good is None:
            self._good = {t: len(self._symbols(t)) for t in self.vocab if self.edges(t) is not None}
            for t, n in self._good.items():
                self._lengths.setdefault("".join(self._symbols(t)[-2:]), set()).add(n)
            self._lengths = {k: sorted(v, reverse=True) for k, v in self._lengths.items()}
        return self._good

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word, each as soon as it is stable. The word's last symbol has the end mark."""
        longest, good, pairs, none = self.longest, self._self_encoding(), self._pairs, ()
        lengths, held = self._lengths, ""  # held: the symbol before
        limit = 4 * (self.lookahead + longest)
        text = ""  # symbols since the last emitted token, without the end mark
        last: list[str | None] = [None]  # last token of each prefix of text; None at its start
        before: str | None = None  # the token emitted last
        n = 0
        for s in symbols:
            n += 1
            text += s  # only the last symbol is longer than one character
            token = None
            for size in lengths.get(held + s, none) if held else none:
                j = n - size
                if j >= 0 and (t := text[j:]) in good:
                    prev = last[j] if j else before
                    if pairs[prev, t] if prev is not None else j == 0:
                        token = t
                        break
            else:
                prev = last[n - 1] if n > 1 else before
                if s in good and (pairs[prev, s] if prev is not None else n == 1):
                    token = s
            held = s
            last.append(token)
            if n >= limit and (done := self._stable(last, longest)):
                yield from done
                cut = sum(good[t] for t in done)
                before, text, last = done[-1], text[cut:], [None, *last[cut + 1 :]]
                n -= cut
        yield from self._chain(last, n)

    def tokens_of(self, text: str) -> list[str]:
        """Tokens of a short word, by the same rule from its end: the state of a prefix is its last token, and
        prefixes are shared by many words, so their states are kept in a bounded memo."""
        good, prefix, at = self._self_encoding(), self._prefixes, len(text)
        out = [self._last(text, at, self.end)]
        at -= good[out[0]]
        while at > 0:
            t = prefix[text[:at]]
            out.append(t)
            at -= good[t]
        return out[::-1]

    def _last(self, text: str, n: int, mark: str) -> str:
        """The last token of ``text``, a word (``mark`` is its end mark) or a prefix of one (no mark)."""
        good, prefix, pairs = self._good, self._prefixes, self._pairs
        for size in self._lengths.get(text[-2:] + mark, ()) if n > 1 else ():
            if size <= n and (t := text[n - size :] + mark) in good and (size == n or pairs[prefix[text[: n - size]], t]):
                return t
        t = text[-1] + mark
        if t not in good or (n > 1 and not pairs[prefix[text[:-1]], t]):
            raise ValueError("a symbol is not in the vocabulary")
        return t

    def _chain(self, last: list, at: int) -> list[str]:
        out = []
        while at > 0:
            if last[at] is None:
                raise ValueError("a symbol is not in the vocabulary")
            out.append(last[at])
            at -= self._good[last[at]]
        return out[::-1]

    def _stable(self, last: list, longest: int) -> list[str]:
        """The tokens that all positions from which a token may still start have in common."""
        n = len(last) - 1
        live = [self._chain(last, i) for i in range(max(1, n - longest + 1), n + 1) if last[i] is not None]
        k = 0
        while live and all(len(c) > k and c[k] == live[0][k] for c in live):
            k += 1
        return live[0][:k] if live else []


class Lockstep:
    """The transducer over many short words at once: the last token of each prefix, position by position. Candidates for a
    position are the tokens met on a walk back from it through a trie of reversed tokens."""

    #: Pairs of tokens whose compatibility is remembered, at most.
    PAIRS = 1 << 18

    def __init__(self, merges: Merges):
        good, end = merges._self_encoding(), merges.end
        self.merges, self.tokens = merges, [*good]
        self.size = np.fromiter(good.values(), np.int64, len(good))
        chars: dict[str, int] = {}
        trie: dict[tuple[int, int], int] = {}
        token_at = [-1, -1]  # the roots: of tokens without the end mark and with it
        for i, t in enumerate(self.tokens):
            marked = bool(end) and t.endswith(end) and len(t) > len(end)
            node = int(marked)
            for c in reversed(t[: -len(end)] if marked else t):
                step = node, chars.setdefault(c, len(chars) + 1)
                node = trie.setdefault(step, len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
            token_at[node] = i
        self.code = np.zeros(max(map(ord, chars), default=0) + 2, np.int64)  # 0: in no token
        for c, k in chars.items():
            self.code[ord(c)] = k
        self.width = len(chars) + 1
        keys = np.array([a * self.width + c for a, c in trie], np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = np.append(keys[order], -1), np.append(np.fromiter(trie.values(), np.int32, len(trie))[order], -1)
        self.token_at = np.array(token_at, np.int32)
        self.known, self.fits = np.array([1 << 62]), np.zeros(1, bool)

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a * len(self.tokens) + b
        at = np.searchsorted(self.known, pair)
        if len(new := np.unique(pair[self.known[at] != pair])):
            if len(self.known) + len(new) > self.PAIRS:
                self.known, self.fits = self.known[-1:], self.fits[-1:]
                new = np.unique(pair)
            fits = [self.merges._compatible(self.tokens[p // len(self.tokens)], self.tokens[p % len(self.tokens)]) for p in new.tolist()]
            known, fits = np.concatenate((self.known, new)), np.concatenate((self.fits, np.array(fits, bool)))
            order = np.argsort(known)
            self.known, self.fits = known[order], fits[order]
            at = np.searchsorted(self.known, pair)
        return self.fits[at]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the tokens of all words, tokens before each word and at the end)."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")  # words that reach a position come first
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        codes = self.code[np.minimum(points, len(self.code) - 1)]
        start, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
        most = int(length[0]) if len(words) else 0
        reach = np.searchsorted(-length, -np.arange(most + 2), "right")  # words of so many symbols or more
        base = np.concatenate(([0], np.cumsum(reach[1:])))  # where the prefixes of a length begin
        last = np.full(int(base[most]), -1, np.int64)
        for k in range(1, most + 1):
            last[base[k - 1] : base[k]] = self._position(k, codes, start, base, last, reach[k], reach[k + 1])
        where, at = np.arange(len(words)), length.copy()
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(where):
            token = last[base[at - 1] + where]
            steps.append((where, token))
            at = at - self.size[token]
            where, at = where[at > 0], at[at > 0]
        count = np.zeros(len(words), np.int64)
        for where, _ in steps:
            count[order[where]] += 1
        ends = np.concatenate(([0], np.cumsum(count)))
        out = np.zeros(int(ends[-1]), np.int64)
        for back, (where, token) in enumerate(steps, 1):  # from the last token to the first
            out[ends[order[where] + 1] - back] = token
        return out, ends

    def _position(self, k: int, codes: np.ndarray, start: np.ndarray, base: np.ndarray, last: np.ndarray, n: int, longer: int) -> np.ndarray:
        """The last token of the first ``k`` symbols of each of the first ``n`` words; all but ``longer`` of them end there."""
        word = np.arange(n)
        node = (word >= longer).astype(np.int64)
        met = []
        for size in range(1, k + 1):
            step = node * self.width + codes[start[word] + k - size]
            at = np.searchsorted(self.keys[:-1], step)
            on = self.keys[at] == step
            word, node = word[on], self.nodes[at[on]].astype(np.int64)
            if not len(word):
                break
            token = self.token_at[node]
            is_token = token >= 0
            met.append((size, word[is_token], token[is_token].astype(np.int64)))
        out = np.full(n, -1, np.int64)
        for size, word, token in reversed(met):
            free = out[word] < 0
            word, token = word[free], token[free]
            if len(word) and size < k:
                good = self._compatible(last[base[k - size - 1] + word], token)
                word, token = word[good], token[good]
            out[word] = token
        if (out < 0).any():
            raise ValueError("a symbol is not in the vocabulary")
        return out


class WordBpe:
    """A tokenizer file with byte-level words and an end mark: words in, ids out."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        j = json.loads(spec)
        m = j["model"]
        self.end = m.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = m["vocab"]
        self.merges = Merges(self.vocab, [tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in m["merges"]], self.end)
        # the library's normaliser and splitter alone, without its copy of the vocabulary
        library = Tokenizer.from_str(json.dumps(j | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self.normalise = library.normalizer.normalize_str
        self.pieces_of = library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.byte = byte_chars()
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}

    def _encode_piece(self, piece: str) -> list[int]:
        tokens = self.merges.tokens_of(piece) if len(piece) <= MEMO_CHARS else self.merges.stream(self._symbols(piece))
        return [self.vocab[t] for t in tokens]

    def _symbols(self, piece: str) -> Iterator[str]:
        """Symbols of a piece one by one; the last has the end mark."""
        for i in range(len(piece) - 1):
            yield piece[i]
        yield piece[-1] + self.end

    def encode_word(self, word: str) -> list[int]:
        """Ids of a text without ASCII white space at which texts are cut."""
        out: list[int] = []
        for part in self.special_re.split(word) if "<|" in word else (word,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for piece in self._split(part):
                    out.extend(self._encode_piece(piece))
        return out

    def _split(self, part: str) -> list[str]:
        if PLAIN.fullmatch(part):
            pieces = SPLIT.findall(part.lower())
            if part.isascii():  # printable ASCII stands for itself
                return pieces
            return ["".join(map(self.byte.__getitem__, p.encode())) for p in pieces]
        return [p for p, _ in self.pieces_of(self.normalise(part))]

    def encode(self, text: str) -> list[int]:
        return [i for w in SPACES.findall(text) for i in self.encode_word(w)]


class TextDecoder:
    """Bytes in, text out: a UTF-8 state machine that holds three bytes at most."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):  # an unfinished character at the end stays
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                if back < need:
                    cut = len(data) - back
                break
            if b < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class IdDecoder:
    """Ids in, text out, one piece of the stream at a time.

    ``joined`` gives token strings with one space between (a file without a decoder); else byte-level
    tokens are turned back into bytes, an end mark into a space, and bytes into text."""

    def __init__(self, tokens: dict[int, str], end: str = "", joined: bool = True):
        self.tokens, self.end, self.joined, self.first = tokens, end, joined, True
        self.utf8 = TextDecoder()
        self.bytes = {c: b for b, c in enumerate(byte_chars())}

    def feed(self, ids: Iterable[int]) -> str:
        if self.joined:
            out = " ".join([self.tokens[i] for i in ids if i in self.tokens])
            if out and not self.first:
                out = " " + out
            self.first = self.first and not out
            return out
        text = ""
        for i in ids:
            t = self.tokens.get(i, "")
            ends = bool(self.end) and t.endswith(self.end)
            body = t[: -len(self.end)] if ends else t
            data = b"".join(bytes([self.bytes[c]]) if c in self.bytes else c.encode() for c in body)
            text += self.utf8.feed(data)
            if ends:
                text += self.utf8.close() + " "
        return text

    def close(self) -> str:
        return "" if self.joined else self.utf8.close()


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words joined and digested at a time: the text's ids are never held whole.
CHUNK_WORDS = 1 << 14
#: Bytes of texts whose distinct words are encoded together.
SLICE_BYTES = 3 << 20


class WordStrings:
    """Ids of words, and what these decode to, as strings joined by spaces. A bounded memo keeps pieces."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.decoder = bpe, IdDecoder(bpe.tokens, bpe.end)
        self.steps = Lockstep(bpe.merges)
        self.ids = [str(bpe.vocab[t]) for t in self.steps.tokens]
        self.memo = Memo(lambda piece: " ".join(map(str, bpe._encode_piece(piece))), 32 << 20)

    def _pieces(self, pieces: list[str]) -> list[str]:
        """Ids of distinct pieces."""
        memo, out = self.memo, list(map(self.memo.get, pieces))
        fresh: dict[str, str] = {}
        new = []
        for k in [k for k, x in enumerate(out) if x is None]:
            p = pieces[k]
            if (x := memo.old.get(p)) is not None:
                out[k] = fresh[p] = x
            elif len(p) <= MEMO_CHARS:
                new.append(k)
            else:
                out[k] = memo.compute(p)
        tokens, ends = self.steps.encode([pieces[k] for k in new])
        ids, ends = list(map(self.ids.__getitem__, tokens.tolist())), ends.tolist()
        for k, a, b in zip(new, ends, ends[1:], strict=False):
            out[k] = fresh[pieces[k]] = " ".join(ids[a:b])
        memo.put_all(fresh, sum(map(len, fresh)) + sum(map(len, fresh.values())) + 122 * len(fresh))
        return out

    def _decoded(self, ids: str) -> str:
        self.decoder.first = True
        return self.decoder.feed(map(int, ids.split(" "))) if ids else ""

    def of(self, words: list[str]) -> tuple[list[str], list[str]]:
        """(ids, their decoding) of distinct words."""
        plain = plain_words(words, "<|")
        ids, texts = [""] * len(words), [""] * len(words)
        if plain.any():
            pieces, places = plain_pieces(words if plain.all() else [w for w, x in zip(words, plain, strict=True) if x])
            where, starts = np.flatnonzero(plain), np.append(np.flatnonzero(places == 0), len(places))
            # a line feed is in no id and no stand-in
            by_ids = ["\n", *self._pieces(pieces[1:])]
            by_text = ["\n", *map(self._decoded, by_ids[1:])]
            for at in range(0, len(where), FEW_WORDS):
                here = where[at : at + FEW_WORDS].tolist()
                part = places[starts[at] + 1 : starts[at + len(here)]].tolist()
                for out, by_piece in ((ids, by_ids), (texts, by_text)):
                    for k, x in zip(here, " ".join(map(by_piece.__getitem__, part)).split(" \n "), strict=True):
                        out[k] = x
        for k in np.flatnonzero(~plain).tolist():
            ids[k] = " ".join(map(str, self.bpe.encode_word(words[k])))
            texts[k] = self._decoded(ids[k])
        return ids, texts


def digests(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the number of its ids, the digest of the ids, the digest of their decoding."""
    held = docs.sparkSession.sparkContext.broadcast(spec)  # the vocabulary file; its size does not follow the data
    key = hashlib.sha256(spec.encode()).hexdigest()
    schema = _parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = per_process(("bpe-words", key), lambda: WordStrings(WordBpe(held.value)))
        for batch in batches:
            for few in slices(batch, 1, SLICE_BYTES):
                index, words, before = split_words(few.column(1))
                ids, texts = strings.of(words)
                some = None if all(ids) else (lambda x: x != "")  # words may have no ids
                out = []
                for a, b in zip(before.tolist(), before[1:].tolist(), strict=False):
                    n, sha_ids, sha_text = 0, hashlib.sha256(), hashlib.sha256()
                    for at in range(a, b, CHUNK_WORDS):
                        chunk = index[at : min(at + CHUNK_WORDS, b)].tolist()
                        joined, decoded = (" ".join(x if some is None else filter(some, x)) for x in (map(ids.__getitem__, chunk), map(texts.__getitem__, chunk)))
                        if joined:
                            sha_ids.update((" " + joined if n else joined).encode())
                            sha_text.update((" " + decoded if n else decoded).encode())
                            n += joined.count(" ") + 1
                    out.append((n, sha_ids.hexdigest(), sha_text.hexdigest()))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([few.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, [*arrow][1:], strict=True))], schema=arrow)

    return docs.select(doc_id, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)
