"""Token ids in files, compressed by Re-Pair grammars, with random access.

Documents are ordered by doc_id over range partitions; each task encodes its documents and cuts them into
shards of about ``SHARD_IDS`` ids (a document is never cut). In a shard, frequent pairs of neighbouring
symbols are replaced by new symbols, again and again. A round counts all pairs of the shard exactly and
replaces every pair that has at least ``SHARE`` of the most frequent one's uses, rather than that one alone;
where hits overlap, every second one from the left is taken. Rounds end when no pair pays for its rule, or
when all 65,536 codes of a symbol are given out.

File format: a Parquet data set with one row per shard. ``blob`` is, little-endian: magic ``BRP1``; uint32
number of terminals V, rules R, symbols S, documents D, step; uint64 number of ids; then uint16 left[R],
uint16 right[R], uint32 length[R] (ids a rule expands to), uint16 symbols[S], uint64 mark[...] (ids before
every step-th symbol), int64 doc_id[D], uint64 end[D] (ids of the shard up to each document's end). Rule r
is symbol V + r. To read ids a to b, a search in ``mark`` gives a symbol at most ``step`` before a; lengths
lead to the symbols that overlap a..b, and only these are expanded. Documents are read back that way.

Defined cases: a null or empty text has only the end id; a null doc_id sorts first and is kept; repeated
rows each have their place, in the order of their text's hash; an empty table makes an empty data set.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import MEMO_CHARS, plain_pieces, plain_words
from .common import Memo, Tables, map_rows, per_process, split_words

MAGIC = b"BRP1"
HEAD = struct.Struct("<4sIIIIIQ")
NO_ID = -(1 << 63)
SHARD_IDS = 1 << 21
#: A round takes the pairs with at least this share of the uses of the most frequent one.
SHARE = 0.05
#: A rule takes eight bytes, and each use saves one symbol of two.
MIN_COUNT = 6
#: Symbols are uint16.
CODES = 1 << 16
#: Pairs of a round at most, which bounds its lookup table; what is left waits for the next round.
PER_ROUND = 4096
STEP = 1024
#: Documents read back at a time.
AT_ONCE = 64
#: Texts encoded at a time.
TEXTS = 5000


def compress(ids: np.ndarray, terminals: int, share: float = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, left, right), all uint16."""
    a = ids.astype(np.uint16)
    lefts, rights, n_rules = [], [], 0
    while len(a) > 1 and terminals + n_rules < CODES:
        key = (a[:-1].astype(np.uint32) << 16) | a[1:]
        key.sort()
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(edge, len(key)))
        often = count >= max(MIN_COUNT, share * count.max())
        pairs, count = key[edge[often]], count[often]
        if not len(pairs):
            break
        pairs = pairs[np.lexsort((pairs, -count))[: min(PER_ROUND, CODES - terminals - n_rules)]]
        left, right = (pairs >> 16).astype(np.uint16), (pairs & 0xFFFF).astype(np.uint16)
        # which rule a pair has, by the places of its two symbols among left and right parts
        row, col = np.zeros(65536, np.uint16), np.zeros(65536, np.uint16)
        ul, ur = np.unique(left), np.unique(right)
        row[ul], col[ur] = np.arange(1, len(ul) + 1), np.arange(1, len(ur) + 1)
        table = np.zeros((len(ul) + 1, len(ur) + 1), np.uint16)
        table[row[left], col[right]] = np.arange(1, len(pairs) + 1)
        at = a.astype(np.intp)  # else each of the two makes its own
        x, y = row[at], col[at]
        maybe = np.flatnonzero((x[:-1] > 0) & (y[1:] > 0))
        hit = table[x[maybe], y[maybe + 1]]
        pos, hit = maybe[hit > 0], hit[hit > 0]
        first = np.concatenate(([True], np.diff(pos) != 1))
        run = np.maximum.accumulate(np.where(first, np.arange(len(pos)), 0))
        every = (np.arange(len(pos)) - run) % 2 == 0
        take, rule = pos[every], hit[every] - 1
        # where neighbours take the places of a pair it may not pay now; it waits, but the first of a round never does
        good = np.bincount(rule, minlength=len(pairs)) >= MIN_COUNT
        good[0] |= not good.any()
        code = (terminals + n_rules - 1 + np.cumsum(good)).astype(np.uint16)
        take, rule = take[good[rule]], rule[good[rule]]
        b = a.copy()
        b[take] = code[rule]
        keep = np.ones(len(a), bool)
        keep[take + 1] = False
        a = b[keep]
        lefts.append(left[good])
        rights.append(right[good])
        n_rules += int(good.sum())
    none = np.zeros(0, np.uint16)
    return a, np.concatenate(lefts or [none]), np.concatenate(rights or [none])


def lengths_of(left: np.ndarray, right: np.ndarray, terminals: int) -> np.ndarray:
    out: list[int] = []
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        out.append((1 if x < terminals else out[x - terminals]) + (1 if y < terminals else out[y - terminals]))
    return np.array(out, np.uint32)


def pack(doc_ids: list[int], ends: list[int], ids: np.ndarray, terminals: int) -> bytes:
    symbols, left, right = compress(ids, terminals)
    length = lengths_of(left, right, terminals)
    size = np.ones(terminals + len(length), np.uint64)
    size[terminals:] = length
    before = np.concatenate(([0], np.cumsum(size[symbols])))[: len(symbols)]
    head = HEAD.pack(MAGIC, terminals, len(left), len(symbols), len(doc_ids), STEP, len(ids))
    parts = (left.astype("<u2"), right.astype("<u2"), length.astype("<u4"), symbols.astype("<u2"), before[::STEP].astype("<u8"), np.array(doc_ids, "<i8"), np.array(ends, "<u8"))
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A reader of one blob."""

    def __init__(self, blob: bytes):
        magic, self.terminals, r, s, d, self.step, self.n_ids = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = HEAD.size

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.left, self.right, self.length = take(r, "<u2"), take(r, "<u2"), take(r, "<u4")
        self.symbols, self.mark = take(s, "<u2"), take(-(-s // self.step), "<u8")
        self.doc_ids, self.ends = take(d, "<i8"), take(d, "<u8")
        self._flat: tuple | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All symbols' ids in one array, where each starts, and how many it has."""
        if self._flat is None:
            v = self.terminals
            size = np.concatenate([np.ones(v, np.int64), self.length.astype(np.int64)])
            start = np.cumsum(size) - size
            flat = np.empty(int(size.sum()), np.uint32)
            flat[:v] = np.arange(v)
            depth = [0] * v
            for x, y in zip(self.left.tolist(), self.right.tolist(), strict=True):
                depth.append(1 + max(depth[x], depth[y]))
            levels = np.array(depth[v:])
            for d in range(1, int(levels.max(initial=0)) + 1):  # rules whose parts are all there
                rule = np.flatnonzero(levels == d)
                for part, at in ((self.left[rule], start[v + rule]), (self.right[rule], start[v + rule] + size[self.left[rule]])):
                    n = size[part]
                    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    flat[np.repeat(at, n) + within] = flat[np.repeat(start[part], n) + within]
            self._flat = flat, start, size
        return self._flat

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, start, size = self._expansions()
        n = size[symbols]
        shift = start[symbols] - np.concatenate(([0], np.cumsum(n)[:-1]))
        return flat[np.repeat(shift, n) + np.arange(int(n.sum()))] if len(symbols) else flat[:0]

    def ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def read(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the shard; only the symbols that overlap them are expanded."""
        b = min(b, self.n_ids)
        if a >= b:
            return np.zeros(0, np.uint32)
        _, _, size = self._expansions()
        k, last = (int(np.searchsorted(self.mark, x, "right")) - 1 for x in (a, b - 1))
        symbols = self.symbols[k * self.step : (last + 1) * self.step]
        edge = np.concatenate(([0], np.cumsum(size[symbols]))) + int(self.mark[k])
        first, end = int(np.searchsorted(edge, a, "right")) - 1, int(np.searchsorted(edge, b))
        return self._expand(symbols[first:end])[a - int(edge[first]) : b - int(edge[first])]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


class WordIds:
    """Ids of texts by the tokenizers library, word by word (see bpe for why a text may be cut at ASCII white
    space). Plain words (see bpe) need no more than their pieces between spaces: the library's model then ends each piece
    with the end mark. The distinct new pieces of a batch are encoded many at a time; all other words are encoded one by
    one as whole texts. A bounded memo keeps pieces, and these words behind a space."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        rules = json.loads(spec)
        end = rules["model"].get("end_of_word_suffix")
        rules |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.pieces = Tokenizer.from_str(json.dumps(rules))
        self.is_end = np.zeros(CODES, bool)
        for token, i in self.lib.get_vocab(with_added_tokens=False).items() if end else ():
            self.is_end[i] = token.endswith(end)
        self.by_pieces = bool(end)
        self.memo = Memo(lambda key: self.one(key[1:]), 96 << 20)

    def one(self, word: str) -> bytes:
        return np.array(self.lib.encode(word, add_special_tokens=False).ids, "<u2").tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        got = list(map(self.memo.get, pieces))
        miss = [k for k, x in enumerate(got) if x is None]
        old = list(map(self.memo.old.get, [pieces[k] for k in miss]))
        new = [k for k, x in zip(miss, old, strict=True) if x is None]
        fresh: dict[str, bytes] = {}
        for k, x in zip(miss, old, strict=True):
            if x is not None:
                got[k] = fresh[pieces[k]] = x
        for at in range(0, len(new), 1000):
            few = new[at : at + 1000]
            ids = np.array(self.pieces.encode_batch_fast([" ".join([pieces[k] for k in few])], add_special_tokens=False)[0].ids, "<u2")
            data, cuts = ids.tobytes(), (2 * np.flatnonzero(self.is_end[ids]) + 2).tolist()
            for k, a, b in zip(few, [0, *cuts], cuts, strict=False):
                got[k] = fresh[pieces[k]] = data[a:b]
        self.memo.put_all(fresh, sum(map(len, fresh)) + sum(map(len, fresh.values())) + 98 * len(fresh))
        return got

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each word begin, how many it has) of distinct words."""
        plain = plain_words(words, "<") & (np.fromiter(map(len, words), np.int64, len(words)) <= MEMO_CHARS) & self.by_pieces
        flat, first, size = np.zeros(0, "<u2"), np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        if plain.any():
            pieces, places = plain_pieces(words if plain.all() else [w for w, x in zip(words, plain, strict=True) if x])
            got = [b"", *self._pieces(pieces[1:])]
            known = np.array([len(x) for x in got], np.int32) // 2
            n = known[places]
            flat = _gathered(np.frombuffer(b"".join(got), "<u2"), (np.cumsum(known, dtype=np.int32) - known)[places], n)
            size[plain] = np.add.reduceat(n, np.flatnonzero(places == 0))
            first[plain] = np.cumsum(size[plain], dtype=np.int32) - size[plain]
        others = np.flatnonzero(~plain)
        got = [self.memo[" " + words[k]] if len(words[k]) <= MEMO_CHARS else self.one(words[k]) for k in others.tolist()]
        size[others] = np.array([len(x) for x in got], np.int32) // 2
        first[others] = len(flat) + np.cumsum(size[others], dtype=np.int32) - size[others]
        return np.concatenate((flat, np.frombuffer(b"".join(got), "<u2"))), first, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each text and at the end)."""
        index, words, before = split_words(texts)
        flat, first, size = self._words(words)
        n = size[index]
        ends = np.concatenate(([0], np.cumsum(n, dtype=np.int32)))  # a batch has fewer than 2**31 ids
        return _gathered(flat, first[index], n), ends[before]


def _gathered(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ``flat``: for each of ``first`` the ``n`` numbers from there on."""
    start = np.cumsum(n, dtype=np.int32) - n
    return flat[np.repeat(first - start, n) + np.arange(int(n.sum()), dtype=np.int32)]


WRITTEN = "shard long, n_ids long, n_docs long, blob binary"


def write(docs: DataFrame, path: str, spec: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` with the tokenizer file ``spec`` and write shards to ``path``, ascending by doc_id."""
    held = docs.sparkSession.sparkContext.broadcast(spec)  # the vocabulary file; its size does not follow the data
    key = zlib.crc32(spec.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_process(("repair-words", key), lambda: WordIds(held.value))
        terminals = words.lib.get_vocab_size()
        if terminals >= CODES or end_id >= terminals:
            raise ValueError("ids do not fit the format")
        end = np.array([end_id], "<u2").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        ends: list[int] = []
        data: list[bytes] = []
        size = 0

        def flush():
            nonlocal seq
            got = np.frombuffer(b"".join(data), "<u2")
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq], pa.int64()), pa.array([len(got)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pack(ids, ends, got, terminals)], pa.binary())],
                names=["shard", "n_ids", "n_docs", "blob"],
            )
            seq += 1
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                few = batch.slice(at, TEXTS)
                got, edge = words.encode(few.column(1))
                for i, a, b in zip(few.column(0).to_pylist(), edge.tolist(), edge[1:].tolist(), strict=False):
                    ids.append(NO_ID if i is None else i)
                    data += [got[a:b].tobytes(), end]
                    size += b - a + 1
                    ends.append(size)
                    if size >= shard_ids:
                        yield flush()
                        ids, ends, data, size = [], [], [], 0
        if ids:
            yield flush()

    (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(run, WRITTEN)
        .write.parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (of uint32 little-endian ids)."""
    files = spark.read.schema(WRITTEN).parquet(path)
    # one row per shard of millions of ids
    starts = files.select("shard", F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def rows(shards, blobs):
        for s, blob in zip(shards, blobs, strict=True):
            shard = Shard(blob)
            ids, ends, a = shard.doc_ids.tolist(), shard.ends.tolist(), 0
            for at in range(0, len(ids), AT_ONCE):
                first, data = a, shard.read(a, ends[min(at + AT_ONCE, len(ids)) - 1]).astype("<u4")
                for i, b in zip(ids[at : at + AT_ONCE], ends[at : at + AT_ONCE], strict=True):
                    yield None if i == NO_ID else i, s, a, b - a, zlib.crc32(data[a - first : b - first])
                    a = b

    docs = map_rows(files, ["shard", "blob"], rows, "doc_id long, shard long, local long, n_tokens long, ids_crc32 long")
    return docs.join(starts, "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, spec: str, end_id: int, **kw) -> DataFrame:
    """Write to the shared folder and read back."""
    path = Tables(docs.sparkSession, "repair").path("ids")
    write(docs, path, spec, end_id, **kw)
    return read(docs.sparkSession, path)
