"""Benchmark decontamination by latent semantic retrieval.

1. Terms are the benchmark's words. One pass writes each document as term numbers, and the document frequency
   of each term is counted; terms in more than ``MAX_DF`` of all documents go, but each item keeps its
   ``KEEP_TERMS`` rarest.
2. A second pass takes every passage of every document as a TF-IDF row ``a`` over these terms and sums
   ``a' (a G)`` for a seeded Gaussian ``G``: a randomised SVD of the passage matrix A in one pass, by the
   Nystroem form of ``A'A``. Partial sums are added over blocks of terms on the executors; only terms by
   ``RANK`` numbers come to the driver, whatever the corpus.
3. A third pass projects all passages onto the leading right singular vectors and compares them with all
   items. Passages of three lengths, each at a stride of one block, are held against items that fit in them.
   An item that fits in none is looked for by overlapping parts that fit in the longest, and as a whole; any
   of these makes it a candidate. Pairs with a cosine of ``COSINE`` or more whose passage reaches at least
   ``REACH`` along the item (or part) are candidates.
4. A candidate is verified on the words themselves: within one and a half times the item's length, the
   longest common subsequence covers ``COVER`` of the item, and at least half of the item's answer terms
   (its ``ANSWER`` rarest words) are there. A document with a verified item is contaminated.

The benchmark is cut into blocks of bounded bytes, so what is broadcast is bounded; each block takes the
passes by itself. Every document and every passage counts; nothing is sampled.

Defined cases: words compare in lower case without punctuation at their ends; null or empty texts and items
have no words; items of fewer than ``MIN_WORDS`` words are not looked for; repeated items each report;
repeated documents and null doc_ids each get their row; a null item id is written "null"; columns of any name pass;
an empty benchmark leaves all clean; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import WORD, Memo, Tables, filter_rows, map_rows, per_process

BLOCK = 16
SCALES = (2, 3, 5)  # blocks in a passage; one of b blocks holds any (b - 1) * BLOCK words whole
LONG = SCALES[-1]
FITS = (LONG - 1) * BLOCK  # words of the longest item that fits in a passage
RANK, EXTRA = 128, 16
MAX_DF = 0.05
KEEP_TERMS = 8
COSINE = 0.4
#: Projection of a candidate passage on the item, as a share of the item's own length in latent space.
REACH = 0.5
COVER = 0.6
ANSWER = 6
MIN_WORDS = 5
#: Bytes of benchmark text that are broadcast at a time.
BENCHMARK_BYTES = 4 << 20

WORDS = re.compile(WORD)
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def term_of(word: str) -> str:
    return EDGE.sub("", word.lower())


def terms_of(text: str | None) -> list[str]:
    return [t for t in map(term_of, WORDS.findall(text or "")) if t]


def lcs(a: list[int], places: dict[int, int], n: int) -> int:
    """Longest common subsequence of ``a`` with a sequence of ``n`` given as symbol -> bits of its places."""
    full = (1 << n) - 1
    v = full
    for x in a:
        m = places.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


@dataclass
class Items:
    """A block of the benchmark: ids, words as term numbers, and the numbers of all terms."""

    ids: list
    words: list[list[int]]
    vocab: dict[str, int]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        vocab: dict[str, int] = {}
        ids, words = [], []
        for i, t in rows:
            ts = terms_of(t)
            if len(ts) >= MIN_WORDS:
                ids.append(i)
                words.append([vocab.setdefault(t, len(vocab)) for t in ts])
        return cls(ids, words, vocab)


#: The column of term numbers that the first pass adds; it takes another name where a table has one of this name.
IDS = "_term_ids"


def numbered(docs: DataFrame, items: Items, tables: Tables, text: str = "text", drop: tuple = (), ids: str = IDS) -> DataFrame:
    """``docs`` with the term number of each word (-1: no term of the block), written to the shared folder. Texts are
    cut into words once; the passes after this one read numbers alone."""
    held, key = docs.sparkSession.sparkContext.broadcast(items.vocab), _key(items)
    kind = _kind(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = held.value

        def number(w: bytes) -> int:
            t = term_of(w.decode("utf-8", "replace"))
            return vocab.get(t, -1) if t else -2

        memo = per_process(("latent-numbers", key), lambda: Memo(number, 48 << 20))
        for batch in batches:
            out = []
            for t in batch.column(batch.schema.names.index(text)).cast(pa.binary()).to_pylist():
                words = (t or b"").split()  # bytes split at ASCII white space alone
                x = np.fromiter(map(memo.__getitem__, words), np.int32, len(words))
                out.append(x[x > -2].astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, ids])

    out = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(ids, BinaryType())]))
    return tables.write(out.drop(*drop), "numbered")


def _kind(items: Items) -> str:
    return "<i2" if len(items.vocab) < 1 << 15 else "<i4"


def document_frequency(docs: DataFrame, items: Items, ids: str = IDS) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each term occurs. ``docs``: numbered."""
    terms, kind = len(items.vocab), _kind(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(terms + 1, np.int64), 0  # what is no term counts at the end
        for batch in batches:
            for b in batch.column(0).to_pylist():
                df[np.unique(np.frombuffer(b, kind))] += 1
                n += 1
        term = np.append(np.flatnonzero(df[:-1]), -1)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(np.append(df[term[:-1]], n))], names=["term", "n"])

    out = np.zeros(terms, np.int64)
    total = 0
    for term, n in docs.select(ids).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # a row for each term of the block
        if term < 0:
            total = n
        else:
            out[term] = n
    return total, out


def _key(items: Items) -> tuple:
    return len(items.vocab), hash(tuple(items.vocab)) & 0xFFFFFFFF


def parts_of(words: list[int]) -> list[list[int]]:
    """What an item is looked for by: itself, and if no passage holds it, its overlapping parts of ``FITS`` words as well."""
    n = len(words)
    starts = [*range(0, n - FITS, FITS // 2), n - FITS] if n > FITS else []
    return [words, *(words[a : a + FITS] for a in starts)]


def weights(items: Items, total: int, df: np.ndarray) -> np.ndarray:
    """IDF of each term; zero for those that are too common to keep. Parts of long items keep their rarest as items do."""
    idf = np.log1p(total / np.maximum(df, 1))
    keep = df <= MAX_DF * total
    for ws in items.words:
        for part in parts_of(ws):
            for t in sorted(set(part), key=lambda t: (df[t], t))[:KEEP_TERMS]:
                keep[t] = True
    return np.where(keep, idf, 0.0).astype(np.float32)


#: Blocks of a text that are taken at once, and blocks in a chunk of texts; a multiple of ``LONG``.
SEGMENT, CHUNK = 4000, 10_000


@dataclass
class Chunk:
    """Texts side by side in blocks, so far apart that no passage holds words of two."""

    texts: list[np.ndarray]
    text: list[int]  # of each segment: its text, its first block there, and its first block in the chunk
    first: list[int]
    at: list[int]
    blocks: int

    @classmethod
    def empty(cls) -> Chunk:
        return cls([], [], [], [], 0)

    def add(self, x: np.ndarray, overlap: int) -> None:
        """Cut ``x`` into segments, each with ``overlap`` blocks of the next."""
        n = -(-len(x) // BLOCK)
        for first in range(0, n, SEGMENT):
            self.text.append(len(self.texts))
            self.first.append(first)
            self.at.append(self.blocks)
            self.blocks += (min(SEGMENT + overlap, n - first) + 2 * LONG - 1) // LONG * LONG
        self.texts.append(x)

    def terms(self, weight: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, term) of all weighted terms, in the order of blocks."""
        parts = [self.texts[t][f * BLOCK : (f + SEGMENT + overlap) * BLOCK] for t, f in zip(self.text, self.first, strict=True)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.array([len(q) for q in parts])
        x = np.concatenate(parts).astype(np.int64)
        place = np.arange(len(x)) + np.repeat(np.array(self.at) * BLOCK - (np.cumsum(size) - size), size)
        good = np.flatnonzero((x >= 0) & (weight[x] > 0))
        return place[good] // BLOCK, x[good]


def _gaussian(n: int) -> np.ndarray:
    return np.random.default_rng(17).standard_normal((n, RANK + EXTRA)).astype(np.float32)


def _row_sums(block: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(block):
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        out[block[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def singular_vectors(docs: DataFrame, items: Items, weight: np.ndarray, ids: str = IDS) -> np.ndarray:
    """Leading right singular vectors (terms by rank) of the TF-IDF matrix of all passages. ``docs``: numbered."""
    terms, kind = len(items.vocab), _kind(items)
    held = docs.sparkSession.sparkContext.broadcast(weight)
    per = 8  # terms in a row of partial sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, g = held.value, _gaussian(terms)
        z = np.zeros(g.shape, np.float64)

        def take(chunk: Chunk) -> None:
            block, term = chunk.terms(w, 0)
            if not len(term):
                return
            values = w[term][:, None]
            y = _row_sums(block // LONG, values * g[term], chunk.blocks // LONG)
            rows = values * y[block // LONG]
            order = np.argsort(term, kind="stable")
            first = np.flatnonzero(np.diff(term[order], prepend=-1))
            z[term[order][first]] += np.add.reduceat(rows[order], first, axis=0)

        chunk = Chunk.empty()
        for batch in batches:
            for b in batch.column(0).to_pylist():
                chunk.add(np.frombuffer(b, kind), 0)
                if chunk.blocks >= CHUNK:
                    take(chunk)
                    chunk = Chunk.empty()
        take(chunk)
        n = -(-terms // per)
        padded = np.zeros((n * per, g.shape[1]))
        padded[:terms] = z
        used = np.flatnonzero(np.abs(padded).reshape(n, -1).sum(1))
        blobs = [padded[k * per : (k + 1) * per].tobytes() for k in used]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(blob, np.float64)
                total[k] = total[k] + s if k in total else s
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s.tobytes() for s in total.values()], pa.binary())], names=["part", "sums"])

    schema = "part int, sums binary"
    summed = docs.select(ids).mapInArrow(run, schema).repartition("part").mapInArrow(add, schema)
    g = _gaussian(terms).astype(np.float64)
    z = np.zeros((-(-terms // per) * per, g.shape[1]))
    for k, blob in summed.collect():  # terms by rank numbers
        z[k * per : (k + 1) * per] += np.frombuffer(blob, np.float64).reshape(per, -1)
    z = z[:terms]
    core = g.T @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > 1e-9 * max(value[-1], 1e-30)
    if not good.any():
        return np.zeros((terms, 1), np.float32)
    left, _, _ = np.linalg.svd(z @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    return np.ascontiguousarray(left[:, :RANK].astype(np.float32))


class Matcher:
    """Everything the third pass needs about a block of items."""

    def __init__(self, items: Items, weight: np.ndarray, basis: np.ndarray, df: np.ndarray):
        self.items, self.weight = items, weight
        self.terms = basis * weight[:, None]
        parts = [(k, part) for k, w in enumerate(items.words) for part in parts_of(w)]
        item = np.array([k for k, _ in parts], np.int64)
        latent = np.stack([self.terms[part].sum(0) for _, part in parts]) if parts else np.zeros((0, basis.shape[1]), np.float32)
        norm = np.linalg.norm(latent, axis=1)
        latent = latent / np.where(norm > 0, norm, 1)[:, None]
        size = np.array([len(part) for _, part in parts], np.int64)
        self.scales = []
        room = [(b - 1) * BLOCK for b in SCALES]
        for k, blocks in enumerate(SCALES):
            low, high = room[k - 1] if k else 0, room[k] if k + 1 < len(SCALES) else size.max(initial=0)
            at = np.flatnonzero((size > low) & (size <= high) & (norm > 0))
            if len(at):
                self.scales.append((blocks, item[at], np.ascontiguousarray(latent[at].T), REACH * norm[at]))
        self.places = []
        for w in items.words:
            bits: dict[int, int] = {}
            for k, t in enumerate(w):
                bits[t] = bits.get(t, 0) | 1 << k
            self.places.append(bits)
        self.answers = [sorted(set(w), key=lambda t: (df[t], t))[:ANSWER] for w in items.words]

    def verify(self, x: np.ndarray, a: int, b: int, k: int) -> float:
        """The largest share of item ``k`` that one and a half times its length of words hold in order, with at
        least half of its answer, among words a to b and its length of words around them (for items that fit in no
        passage: up to twice as many); 0 below ``COVER``."""
        n, places, answer = len(self.items.words[k]), self.places[k], self.answers[k]
        size = n + n // 2 + 1
        # the passage may hold either end of a long item, and what is near then stands for the next passages too
        before, after = (size, size + n // 2) if n > FITS else (n, n)
        near = x[max(0, a - before) : b + after].tolist()

        def share(words: list[int]) -> float:
            have = set(words)
            if 2 * sum(t in have for t in answer) < len(answer):
                return 0.0
            got = lcs(words, places, n) / n
            return got if got >= COVER else 0.0

        if len(near) <= size or not share(near):
            return share(near)
        return max(share(near[at : at + size]) for at in range(0, len(near) - size + n // 4 + 1, max(1, n // 4)))

    def candidates(self, chunk: Chunk) -> Iterator[tuple[int, int, int, int]]:
        """(text, first word, end, item) of passages whose cosine with an item is high."""
        block, term = chunk.terms(self.weight, LONG)
        if not len(term):
            return
        y = _row_sums(block, self.terms[term], chunk.blocks + LONG)
        at = np.array(chunk.at)
        for blocks, items, latent, reach in self.scales:
            n = len(y) - blocks + 1
            p = sum(y[k : k + n] for k in range(blocks))
            norm = np.sqrt(np.einsum("ij,ij->i", p, p))
            live = np.flatnonzero(norm > 1e-3)
            dot = p[live] @ latent
            for r, c in zip(*np.nonzero((dot >= reach) & (dot >= COSINE * norm[live][:, None])), strict=True):
                seg = int(np.searchsorted(at, live[r], "right")) - 1
                first = chunk.first[seg] + int(live[r]) - chunk.at[seg]
                yield chunk.text[seg], first * BLOCK, (first + blocks) * BLOCK, int(items[c])

    def hits(self, chunk: Chunk) -> list[dict[int, float]]:
        """For each text: item -> the best share of it that is found."""
        best: list[dict[int, float]] = [{} for _ in chunk.texts]
        last: dict[tuple[int, int], int] = {}
        for t, a, b, k in self.candidates(chunk):
            # what surrounds a passage holds the next one too, if the item has a block of words
            n, seen = len(self.items.words[k]), last.get((t, k))
            if n >= BLOCK and seen is not None and (0 <= a - seen <= n // 2 if n > FITS else a - seen == BLOCK):
                continue
            last[t, k] = a
            if best[t].get(k, 0.0) < 1.0:
                share = self.verify(chunk.texts[t], a, b, k)
                if share > best[t].get(k, 0.0):
                    best[t][k] = share
        return best


SCHEMA = "doc_id long, n_items long, item_ids string, best_share double, contaminated boolean"


class Searcher:
    """Finds a block's items in numbered documents, in a worker. Fitting it takes two passes over all of them."""

    def __init__(self, docs: DataFrame, items: Items, ids: str = IDS):
        total, df = document_frequency(docs, items, ids)
        weight = weights(items, total, df)
        basis = singular_vectors(docs, items, weight, ids)
        self.held = docs.sparkSession.sparkContext.broadcast((items, weight, basis, df))  # of bounded size: see BENCHMARK_BYTES
        self.number, self.kind = uuid.uuid4().hex, _kind(items)

    def __call__(self, ids: list[bytes]) -> Iterator[tuple[list, float]]:
        """Items found in each document, and the best share."""
        m = per_process(("latent-matcher", self.number), lambda: Matcher(*self.held.value))
        chunk = Chunk.empty()
        for end, b in enumerate(ids, 1):
            chunk.add(np.frombuffer(b, self.kind), LONG)
            if chunk.blocks >= CHUNK or end == len(ids):
                for best in m.hits(chunk):
                    yield list({m.items.ids[k] for k in best}), max(best.values(), default=0.0)
                chunk = Chunk.empty()


FOUND = "row long, doc_id long, items array<string>, best_share double"


def _search(docs: DataFrame, items: Items) -> DataFrame:
    """``docs``: row, doc_id, text."""
    if not items.words:
        return docs.select("row", "doc_id", F.array().cast("array<string>").alias("items"), F.lit(0.0).alias("best_share"))
    ready = numbered(docs, items, Tables(docs.sparkSession, "latent"), drop=("text",))
    search = Searcher(ready, items)

    def rows(row, ids, terms):
        for n, i, (found, best) in zip(row, ids, search(terms), strict=True):
            yield n, i, ["null" if x is None else str(x) for x in found], best

    return map_rows(ready, ["row", "doc_id", IDS], rows, FOUND)


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The benchmark in blocks of bounded bytes."""
    b = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    size = b.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / BENCHMARK_BYTES))
    for k in range(n):
        rows = b.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        yield Items.of([tuple(r) for r in rows])


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_items, item_ids (ascending, numbers as such; joined by commas), best_share, contaminated."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = list(item_blocks(benchmark))
    if len(blocks) > 1:  # numbers of rows hold for all blocks once they are written
        own = Tables(docs.sparkSession, "latent").write(own, "rows")
    parts = [_search(own, items) for items in blocks]
    out = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.collect_list("items")).alias("items"), F.max("best_share").alias("best_share"))
    ordered = F.expr("transform(array_sort(transform(array_distinct(items), x -> struct(try_cast(x as decimal(38,0)) as n, x as x))), y -> y.x)")
    return out.select(
        "doc_id",
        F.size(F.array_distinct("items")).cast("long").alias("n_items"),
        F.array_join(ordered, ",").alias("item_ids"),
        "best_share",
        (F.size("items") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones, with all columns; no shuffle of texts."""
    out, name = docs, IDS
    while name in docs.columns:
        name += "_"
    for items in item_blocks(benchmark):
        if items.words:
            ready = numbered(out, items, Tables(docs.sparkSession, "latent"), text, ids=name)
            search = Searcher(ready, items, name)
            out = filter_rows(ready, [name], lambda ids, search=search: [not found for found, _ in search(ids)]).drop(name)
    return out
