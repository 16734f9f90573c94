"""Fuzzy line dedup: MinHash bands over character shingles, exact Jaccard, union-find, one line kept.

Lines (cut at line feeds) with at least one word take part; equal lines are one. A line's set is its
``SHINGLE``-character runs (a shorter line is one run). One-permutation MinHash fills ``BANDS * ROWS`` bins
(an empty bin borrows from another by a fixed sequence), and each band of rows is a key.

Lines that share a key are candidates, unless their signatures agree in less than ``AGREE`` of 64 bins, which a
similar pair does with a probability of about 1e-5 (1e-3 if it has but 30 shingles); this spares texts from being fetched for unlike lines. A
coarser test comes first, on a bit of each bin (``UNLIKE_BITS``), as that many fit beside a key.

Keys leave a task as records of 20 bytes, packed by part, not as rows, and one task has all records of a part. Of a key with
up to ``ALL`` lines all pairs are candidates at once; of one with up to ``MANY``, each line and the first it may be similar to; lines
with more such partners, and all lines of larger keys, go on by their key. A key with more than ``MANY`` lines in one
task goes on by itself, spread over all parts, with a note to its own, so a hot key makes no part large.

Rows that go on are sorted by ranges of (key, line), so a key with a large share of all lines lies in many tasks; each
reads its rows as a stream and has its own leader of such a key, the smallest line, against which the others are held. What is verified is
linked, and components are formed. What still lies in different components of a key is held against each other, the
signatures first, so that of all pairs of a key only close ones come out: keys of up to ``ROWS_KEY`` lines in one task each,
larger ones by a join that the adaptive skew join splits. Lines that were close to another, similar or
not, are copies that differ by about as much as the threshold, and may be many: between two of these, in keys of
more than ``FEW``, the shingles' hashes are compared as well, so that only links come out, and few pairs that ``SLACK`` equal
hashes of unlike shingles could decide. A key full of copies of one line thus costs a few pairs per line, and no candidate is left out. A pair
is linked if the Jaccard similarity of the two sets is ``SIMILARITY`` or more, over the whole lines.
Within a component only the first line by (doc_id, line number) stays; only lines that are repeated or in a component take
part in that. First places and sizes are aggregates (combined before their shuffle) that are written and joined back.

Shuffles carry hashes. The lines of candidate pairs are fetched by a bit map of their hashes (of fixed size: at worst
it holds nothing back), repeats combined before the shuffle; texts move by doc_id once, to take lines out. Memory: one batch of texts, the keys of
``LINES_OUT`` lines, the records of one part, or ``PAIRS`` bytes of pairs with their shingles. Defined cases: null texts stay null
and have no lines; blank lines always stay; rows that repeat doc_id and text are one document; ties of doc_id go
by the text's hash; columns of any name pass; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import WORD, Tables, release
from .components import components
from .debruijn import _mixed, rolling

#: Short, so that one changed character or word leaves short lines similar; long enough that unrelated long ones are not.
SHINGLE = 4
#: A pair at the threshold shares no band with a probability of 0.4 %; six rows keep unlike lines of large corpora apart.
BANDS, ROWS = 18, 6
SIMILARITY = 0.8
#: Characters hashed at a time: what fits in a core's cache.
CHUNK = 1 << 15
#: Chunks whose empty bins borrow together.
CHUNKS = 16
#: Bytes of the texts of pairs that are held against each other at a time.
PAIRS = 1 << 20
#: Hashes of sets in a batch.
SET_HASHES = 1 << 20
#: Lines whose keys a task deals out together; bytes of records that leave it at a time.
LINES_OUT = 1 << 16
BLOB = 1 << 22
#: Rows of a key up to which its close pairs all go to the texts.
FEW = 16
#: Lines of a key up to which all its pairs that may be similar come out at once.
ALL = 32
#: Lines of a key up to which one task holds all of them against each other by bits of their sketches.
MANY = 256
#: Lines of a key, of several components, up to which one task holds them against each other.
ROWS_KEY = 1024
#: Of 64 bits, one of each bin, the most in which lines that may be similar differ. A similar pair differs in more with a
#: probability of 6e-7 if its bins are independent; of 300,000 simulated pairs at the threshold, of 10 to 300 shingles, none did.
UNLIKE_BITS = 20
#: Equal hashes (of 32 bits) of unlike shingles that a pair is allowed; more have a probability below 1e-18.
SLACK = 3
#: Bits of the map of wanted lines that is broadcast, a row for 64 of them.
MAP_BITS = 1 << 25
#: Longs of a sketch, which has four bits of each of the first bins; the share of bins in which similar lines agree.
SKETCH = 4
AGREE = 0.6
#: Hashes of lines that a task remembers, to send a repeated line's keys once.
SEEN = 200_000

HAS_WORD = re.compile(WORD)
_BINS = BANDS * ROWS
_EMPTY = np.uint64(1 << 63)
_RECORD = np.dtype([("sub", "<u4"), ("line", "<i8"), ("bits", "<u8")])
_MANY = np.dtype([("key", "<i8"), ("line", "<i8")])
_SKETCHED = np.dtype([("line", "<i8"), ("sketch", "<u8", (SKETCH,))])
#: Where an empty bin looks, try after try.
_BORROW = np.random.default_rng(11).integers(0, _BINS, (512, _BINS))


def line_hash(line: str) -> int:
    """The hash Spark's xxhash64 gives, signed."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def _points(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _padded(line: str) -> str:
    return line if len(line) >= SHINGLE else line + "\0" * (SHINGLE - len(line))


def _hashes(points: np.ndarray) -> np.ndarray:
    """A hash of each run of ``SHINGLE`` characters."""
    return _mixed(rolling(_mixed(points + np.uint64(1)), SHINGLE))


def _minima(lines: list[str]) -> np.ndarray:
    """For each line the least hash of each bin."""
    lines = [_padded(x) for x in lines]
    sizes = np.array([len(x) for x in lines], np.int64)
    h = _hashes(_points("".join(lines)))
    ends = np.cumsum(sizes)
    sig = np.full(len(lines) * _BINS + 1, _EMPTY)  # the last is for what lies in two lines
    bins = (((h >> np.uint64(40)) * np.uint64(_BINS)) >> np.uint64(24)).view(np.int64)
    bins += np.repeat(np.arange(0, len(lines) * _BINS, _BINS), sizes)[: len(h)]
    bins[np.add.outer(ends[:-1], np.arange(1 - SHINGLE, 0)).ravel()] = len(lines) * _BINS
    np.minimum.at(sig, bins, h & np.uint64(0xFFFFFFFFFF))
    return sig[:-1].reshape(len(lines), _BINS)


def _borrow(sig: np.ndarray) -> None:
    """Empty bins take the value of the first bin with one of its own, of those they look at in turn."""
    own = sig.copy().ravel()
    r, b = np.nonzero(sig == _EMPTY)
    row = r * _BINS
    for step in _BORROW:
        if not len(b):
            break
        found = own[row + step[b]]
        have = found != _EMPTY
        if have.any():
            sig.ravel()[(row + b)[have]] = found[have]
            row, b = row[~have], b[~have]


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``BANDS`` keys and a sketch for each line. A line above ``CHUNK`` is hashed in overlapping pieces."""
    step = CHUNK - SHINGLE + 1
    cut = {k: [x[a : a + CHUNK] for a in range(0, len(x) - SHINGLE + 1, step)] for k, x in enumerate(lines) if len(x) > CHUNK}
    short = [x if k not in cut else "" for k, x in enumerate(lines)]
    chunk = (np.cumsum([len(x) + SHINGLE for x in short]) // CHUNK).tolist()
    sig = np.concatenate([_minima([x for _, x in part]) for _, part in groupby(zip(chunk, short, strict=True), lambda x: x[0])])
    for k, parts in cut.items():
        sig[k] = np.min([_minima([p])[0] for p in parts], axis=0)
    _borrow(sig)
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for k in range(ROWS):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::ROWS] + np.uint64(1)
    few = (sig[:, : 16 * SKETCH] & np.uint64(15)).reshape(-1, SKETCH, 16) << np.arange(0, 64, 4, dtype=np.uint64)
    return _mixed(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.bitwise_or.reduce(few, axis=2)


def _bits(sketch: np.ndarray) -> np.ndarray:
    """A bit of each bin of the sketches."""
    one = sketch & np.uint64(0x1111111111111111)
    return np.bitwise_or.reduce(one << np.arange(SKETCH, dtype=np.uint64), axis=1)


def _dealt(ids: np.ndarray, keys: np.ndarray, sketch: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, kind, records) of the keys (0; 1 and 2: of many lines) and sketches (3) of lines, each once. A key is its part and ``sub``, 32 bits; records of a key go to
    its part, but for a key with more than ``MANY`` lines here, of which one line goes there and all go anywhere."""
    key = keys.ravel()
    part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
    rows = np.empty(len(key), _RECORD)
    rows["sub"] = sub = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    rows["line"] = np.repeat(ids, BANDS)
    rows["bits"] = np.repeat(_bits(sketch), BANDS)
    order = np.argsort(sub)
    size = np.diff(np.append(_runs(sub[order]), len(sub)))
    if size.max(initial=0) > MANY:
        at = order[np.repeat(size > MANY, size)]
        whole = part[at].astype(np.int64) << 32 | sub[at]
        _, first, back, n = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
        first, many = at[first[n > MANY]], n[back] > MANY
        at, whole = at[many], whole[many]
        out = np.empty(len(at), _MANY)
        out["key"], out["line"] = whole, rows["line"][at]
        to = (_mixed((out["line"] ^ whole).view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        yield from ((p, 2, out[to == p].tobytes()) for p in np.unique(to).tolist())
        yield from ((p, 1, rows[first[part[first] == p]].tobytes()) for p in np.unique(part[first]).tolist())
        rest = np.ones(len(rows), bool)
        rest[at] = False
        rows, part = rows[rest], part[rest]
    lines = np.empty(len(ids), _SKETCHED)
    lines["line"], lines["sketch"] = ids, sketch
    yield from _split(rows, part, 0, parts)
    yield from _split(lines, (ids.view(np.uint64) % np.uint64(parts)).astype(part.dtype), 3, parts)


def _split(records: np.ndarray, to: np.ndarray, kind: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    ordered = records[np.argsort(to, kind="stable")]
    ends = np.cumsum(np.bincount(to, minlength=parts))
    for p in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
        yield p, kind, ordered[ends[p - 1] if p else 0 : ends[p]].tobytes()


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _signed(docs: DataFrame, parts: int) -> DataFrame:
    """(part, kind, records) of the keys and sketches of all lines, as ``_dealt`` gives them, and of repeated lines (4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("lines")
        seen: set[int] = set()
        again: set[int] = set()
        ids: list[int] = []
        part: list[str] = []
        done: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            repeats = np.array(list(again), np.int64)
            to = (repeats.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            for row in chain(
                _dealt(np.array(ids, np.int64), *(np.concatenate(x) for x in zip(*done, strict=True)), parts),
                _split(repeats, to, 4, parts),
            ):
                held.append(row)
                size += len(row[2])
                if size >= BLOB:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

        def batch_of(rows: list) -> pa.RecordBatch:
            p, kind, data = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["part", "kind", "records"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for x in t.split("\n") if t else ():
                    if not HAS_WORD.search(x):
                        continue
                    if (i := line_hash(x)) in seen:
                        again.add(i)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(i)
                    ids.append(i)
                    part.append(x)
                    size += len(x)
                    if size >= CHUNKS * CHUNK:
                        done.append(signatures(part))
                        part, size = [], 0
                        if len(ids) >= LINES_OUT:
                            yield from out()
                            again, ids, done = set(), [], []
        if part:
            done.append(signatures(part))
        if ids or again:
            done.append((np.zeros((0, BANDS), np.uint64), np.zeros((0, SKETCH), np.uint64)))
            yield from out()

    return docs.select("text").mapInArrow(run, "part int, kind int, records binary")


def _meetings(signed: DataFrame, parts: int) -> DataFrame:
    """(key, line, other, sketch). With a sketch: a line's; with a key: a line of a key that is for ``_shared``; with another
    line: a pair of lines that share a key and may be similar; with none of these: a line that occurs more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("lines")
        held: dict[tuple[int, int], list[bytes]] = {}
        for batch in batches:
            for p, kind, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if kind == 2:
                    many = np.frombuffer(data, _MANY)
                    yield _met_rows(key=many["key"], line=many["line"])
                else:
                    held.setdefault((p, kind), []).append(data)
        for p in {p for p, _ in held}:
            lines = np.frombuffer(b"".join(held.pop((p, 3), [])), _SKETCHED)
            _, first, n = np.unique(lines["line"], return_index=True, return_counts=True)
            lines = lines[first]
            yield _met_rows(line=lines["line"], sketch=lines["sketch"])
            yield _met_rows(line=np.union1d(lines["line"][n > 1], np.frombuffer(b"".join(held.pop((p, 4), [])), np.int64)))
            rows, flags = (np.frombuffer(b"".join(held.pop((p, k), [])), _RECORD) for k in (0, 1))
            yield from _met(p, rows, flags)

    return signed.repartitionById(parts, F.col("part")).mapInArrow(run, "key long, line long, other long, sketch array<long>")


def _met_rows(key=None, line=None, other=None, sketch=None) -> pa.RecordBatch:
    n = len(line)
    longs = [pa.nulls(n, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x), pa.int64()) for x in (key, line, other)]
    lists = pa.nulls(n, pa.list_(pa.int64())) if sketch is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * SKETCH, pa.int32()), pa.array(np.ascontiguousarray(sketch).view(np.int64).ravel()))
    return pa.RecordBatch.from_arrays([*longs, lists], names=["key", "line", "other", "sketch"])


def _met(part: int, rows: np.ndarray, flags: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What ``_meetings`` gives of the keys of a part. Pairs of keys with up to ``ALL`` lines all come out if they may be similar;
    of keys with up to ``MANY`` lines those with the first line that each has, and lines with more of them by their key; of
    larger keys, and of those that ``flags`` name, all lines by their key."""
    many = np.unique(flags["sub"])
    rows = np.concatenate((rows, flags))
    order = np.argsort(rows["sub"])
    start = _runs(rows["sub"][order])
    size = np.diff(np.append(start, len(rows)))
    order = order[np.repeat(size > 1, size) | np.isin(rows["sub"][order], many)]
    rows = rows[order]
    rows = rows[np.lexsort((rows["line"], rows["sub"]))]
    sub, line = rows["sub"], rows["line"]
    new = np.concatenate(([True], (sub[1:] != sub[:-1]) | (line[1:] != line[:-1])))[: len(rows)]
    sub, line, bits = sub[new], line[new], rows["bits"][new]
    start = _runs(sub)
    size = np.diff(np.append(start, len(sub)))
    large = (size > MANY) | np.isin(sub[start], many)
    by_key = np.repeat(large, size)
    few = np.repeat(size <= ALL, size)
    left = np.repeat(np.where(large, 0, size), size) - (np.arange(len(sub)) - np.repeat(start, size)) - 1  # lines after each in its key
    has = np.zeros(len(sub), bool)
    ahead = np.argsort(-left, kind="stable")
    counts = -left[ahead]
    for d in range(int(left.max(initial=0)), 0, -1):
        i = ahead[: np.searchsorted(counts, -d, "right")]
        i = i[np.bitwise_count(bits[i] ^ bits[i + d]) <= UNLIKE_BITS]
        if not len(i):
            continue
        first = ~has[i + d]
        has[i + d] = True
        more = i[~first & ~few[i]]
        by_key[more] = by_key[more + d] = True
        i = i[first | few[i]]
        if len(i):
            yield _met_rows(line=line[i], other=line[i + d])
    if by_key.any():
        yield _met_rows(key=sub[by_key].astype(np.int64) | part << 32, line=line[by_key])


def _shared(keys: DataFrame) -> DataFrame:
    """(key, line, leader, edge) of keys with two lines or more; ``leader`` is the least line that the task has of the key.
    A row with ``edge`` tells the leader of the first and of the last key of a task, which others may have more of."""
    names = ["key", "line", "leader", "edge"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(key, line, leader, edge=False):
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(line, pa.int64()), pa.array(leader, pa.int64()), pa.array([edge] * len(key), pa.bool_())], names=names)

        release("lines")
        first = last = None  # (key, leader, line seen last) of the first key and of the one that may go on
        waits = False  # the last key has one line so far, which is not out
        for batch in batches:
            key, line = (batch.column(c).to_numpy() for c in range(2))
            if last:
                key, line = np.append(last[0], key), np.append(last[2], line)
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])))
            key, line = key[new], line[new]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            leader = line[start]
            if last:
                leader[0] = last[1]
            out = np.repeat(size > 1, size)
            if last and not waits:
                out[0] = False  # was out with an earlier batch
            if out.any():
                yield rows(key[out], line[out], np.repeat(leader, size)[out])
            waits = size[-1] == 1 and (len(size) > 1 or waits or not last)
            last = key[-1], leader[-1], line[-1]
            first = first or (key[0], leader[0])
        if last:
            yield rows(*([x[0], y[0]] for x, y in ((first[:1], last[:1]), (first[1:], last[1:]), (first[1:], last[1:]))), True)

    ordered = keys.select("key", "line").repartitionByRange("key", "line").sortWithinPartitions("key", "line")
    return ordered.mapInArrow(run, "key long, line long, leader long, edge boolean")


def shingle_set(line: str) -> np.ndarray:
    """The distinct shingles of a line, ascending; each is its characters, in 21 bits each."""
    p = _points(_padded(line))
    n = len(p) - SHINGLE + 1
    both = np.empty(n, "u8,u8")
    both["f0"], both["f1"] = (p[k : k + n] << np.uint64(21) | p[k + 1 : k + 1 + n] for k in (0, 2))
    return np.unique(both)


def _packed(line: str) -> np.ndarray | None:
    """As ``shingle_set``, a long for each shingle, for lines whose characters have 16 bits at most; else None."""
    p = _points(_padded(line))
    if p.max() >> np.uint64(16):
        return None
    n = len(p) - SHINGLE + 1
    x = p[:n].copy()
    for k in range(1, SHINGLE):
        x = x << np.uint64(16) | p[k : k + n]
    return np.unique(x)


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    x, y = _packed(a), _packed(b)
    if x is None or y is None:
        x, y = shingle_set(a), shingle_set(b)
    return _near(x, y, least)


def _near(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> bool:
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)))
    both = int(np.count_nonzero(both[1:] == both[:-1]))
    return both >= least * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines that are similar. Rows come in the order of ``a``, whose shingles are held for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("lines")
        for batch in batches:
            for part in _by_size(batch, (2, 3), PAIRS):
                a, b = (part.column(k).to_numpy() for k in range(2))
                ok = _similar_pairs(a, part.column(2).to_pylist(), part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    left = texts.select(F.col("line").alias("a"), F.col("content").alias("ta"))
    right = texts.select(F.col("line").alias("b"), F.col("content").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _by_size(batch: pa.RecordBatch, columns: tuple[int, ...], most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts in ``columns`` have about ``most`` bytes at most, or one row."""
    sizes = sum(pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in columns)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _similar_pairs(a: np.ndarray, left: list[str], right: list[str]) -> np.ndarray:
    """Which pairs (left, right) are similar; rows with the same ``a`` in turn have the same text at the left."""
    start = _runs(a)
    texts = [_padded(left[k]) for k in start.tolist()] + [_padded(x) for x in right]
    p = _points("".join(texts))
    if p.max() >> np.uint64(16):
        return np.array([similar(x, y) for x, y in zip(left, right, strict=True)], bool)
    n = len(p) - SHINGLE + 1
    x = p[:n].copy()
    for k in range(1, SHINGLE):
        x = x << np.uint64(16) | p[k : k + n]
    ends = np.cumsum([len(t) for t in texts]).tolist()

    def distinct(k: int) -> np.ndarray:
        one = x[ends[k - 1] if k else 0 : ends[k] - SHINGLE + 1]
        one.sort()
        new = one[1:] != one[:-1]
        return one if new.all() else one[np.concatenate(([True], new))]

    ok = np.zeros(len(a), bool)
    bounds = [*start.tolist(), len(a)]
    for k in range(len(start)):
        own = distinct(k)
        for j in range(bounds[k], bounds[k + 1]):
            ok[j] = _near(own, distinct(len(start) + j))
    return ok


def _has_word(line):
    return F.octet_length(F.btrim(line, F.lit(" \t\n\x0b\f\r"))) > 0


def _at(x):
    return F.pmod(x, F.lit(MAP_BITS))


def _bit(x):
    return F.call_function("shiftleft", F.lit(1).cast("long"), _at(x).bitwiseAND(F.lit(63)).cast("int"))


def _marked(rows: DataFrame, column: str, wanted: DataFrame, how: str) -> tuple[DataFrame, Column]:
    """``rows`` with a bit map of ``wanted`` joined, and whether a row's ``column``, a hash, is on it: it is if it is wanted, and
    seldom else."""
    x = F.col(wanted.columns[0])
    bits = wanted.select(F.shiftright(_at(x), 6).alias("_word"), _bit(x).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    joined = rows.join(F.broadcast(bits), F.shiftright(_at(F.col(column)), 6) == F.col("_word"), how)
    return joined, F.col("_bits").bitwiseAND(_bit(F.col(column))) != 0


def _among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``wanted``."""
    joined, on = _marked(rows, column, wanted, "inner")
    return joined.filter(on).select(*rows.columns)


def _occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, th, no, line, content) of all lines with a word; with their contents if they are in ``wanted``."""
    lines = docs.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("no", "content"))
    joined, on = _marked(lines.filter(_has_word("content")).withColumn("line", F.xxhash64("content")), "line", wanted, "left")
    return joined.select("doc_id", "th", "no", "line", F.when(on, F.col("content")).alias("content"))


def _contents(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, content) of the lines in ``wanted``."""
    return lines.filter("content is not null").select("line", "content").dropDuplicates(["line"]).join(wanted, "line", "left_semi")


class _Texts:
    """Contents of lines, fetched from the documents when pairs ask for them. The first time all places are written."""

    def __init__(self, docs: DataFrame, tables: Tables):
        self.docs, self.tables, self.places, self.held = docs, tables, None, []

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar; asked for twice at most."""
        lines = pairs.select(F.col("a").alias("line")).union(pairs.select("b")).distinct()
        for t in self.held:
            lines = lines.join(t, "line", "left_anti")
        lines = self.tables.write(lines, "lines")
        if self.held:  # few are missing: one text for each
            first = _among(self.places.select("line", "th"), "line", lines).groupBy("line").agg(F.min("th").alias("th")).select("th")
            holders = self.tables.write(first, "holders")
            found = _occurrences(_among(self.docs, "th", holders), lines)
        else:
            found = self.places = self.tables.write(_occurrences(self.docs, lines), "places")
        self.held.append(self.tables.write(_contents(found, lines), "texts"))
        self.tables.drop(lines)
        self.tables.free()
        every = self.held[0]
        if self.held[1:]:
            every = _among(every, "line", pairs.select("a").union(pairs.select("b"))).union(self.held[1])
        return self.tables.write(_verified(pairs, every), "links")


def groups(docs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(places of all lines that are repeated or similar to others, (node, root) of lines that are not their component's
    root). ``docs``: doc_id, text, th."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = tables.write(_meetings(_signed(docs, parts), parts), "met")
    table = tables.write(_shared(met.filter("key is not null").select("key", "line")), "shared")
    texts = _Texts(docs, tables)
    repeated = tables.write(met.filter("key is null and other is null and sketch is null").select("line"), "repeated")

    edge = table.filter("edge").select("key", F.col("leader").alias("b"))  # two rows a task
    between = edge.join(edge.groupBy("key").agg(F.min("b").alias("a")), "key").filter("a < b").select("a", "b")
    star = table.filter("line <> leader").select(F.col("leader").alias("a"), F.col("line").alias("b"))
    pairs = tables.write(met.filter("other is not null").select(F.col("line").alias("a"), F.col("other").alias("b")).union(star).union(between).distinct(), "pairs")
    wanted = table.select("line").union(pairs.select("a")).union(pairs.select("b"))
    sketches = tables.write(_among(met.filter("sketch is not null").select("line", "sketch"), "line", wanted), "sketches")
    tables.drop(met)
    apart, pairs = pairs, tables.write(_close(pairs, sketches), "close")
    tables.drop(apart)
    tables.free()
    links = texts.verified(pairs)
    roots = components(links, tables)
    shared = table.select("key", "line")
    mixed = tables.write(_mixed_keys(shared.join(roots, F.col("line") == F.col("node"), "left").select("key", "line", F.coalesce("root", "line").alias("root")), tables), "mixed")
    sets = tables.write(_sets(_among(texts.held[0], "line", mixed.filter(F.col("n") > FEW).select("line"))), "sets")
    # both lines of a pair tried above have sets, which tell them apart if they were not linked
    more = tables.write(_close_across(mixed, sketches, sets, tables), "more")
    tables.drop(mixed, sets)
    tables.free()
    links = links.union(more.filter("sure").select("a", "b")).union(texts.verified(more.filter("not sure").select("a", "b")))
    roots = components(links, tables)
    tables.drop(table, sketches, *texts.held, pairs, more)
    # other lines are alone in their group
    places = texts.places.select("doc_id", "th", "no", "line")
    grouped = tables.write(_among(places, "line", repeated.union(roots.select("node")).union(roots.select("root"))), "grouped")
    tables.drop(texts.places, repeated)
    return grouped, roots


def _mixed_keys(named: DataFrame, tables: Tables) -> DataFrame:
    """The rows (key, line, root, n) of keys with lines of several components; n: rows of the key."""
    named = tables.write(named, "named")
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("key", "n")
    return named.join(tables.write(mixed, "mixed-keys"), "key")


def _sets(texts: DataFrame) -> DataFrame:
    """(line, hashes of its distinct shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("lines")

        def out() -> pa.RecordBatch:
            starts = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(sets).view(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], names=["line", "set"])

        ids, sets, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                ids.append(i)
                sets.append(np.unique((_hashes(_points(_padded(t.as_py()))) >> np.uint64(32)).astype(np.uint32)))
                size += len(sets[-1])
                if size >= SET_HASHES:
                    yield out()
                    ids, sets, size = [], [], 0
        if ids:
            yield out()

    return texts.select("line", "content").mapInArrow(run, "line long, set array<int>")


def _may_be_similar(x: str, y: str):
    """Whether the sketches in columns ``x`` and ``y`` agree in enough bins."""

    def unlike(k: int):
        z = F.col(x)[k].bitwiseXOR(F.col(y)[k])
        z = z.bitwiseOR(F.shiftright(z, 1))
        return F.bit_count(z.bitwiseOR(F.shiftright(z, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    return sum((unlike(k) for k in range(SKETCH)), F.lit(0)) <= int((1 - AGREE) * 16 * SKETCH)


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be similar."""
    x, y = (sketches.select(F.col("line").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    return pairs.join(y, "b").join(x, "a").filter(_may_be_similar("sa", "sb")).select("a", "b")


def _close_across(mixed: DataFrame, sketches: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """(a, b, sure) of lines that share a key, in different components, that may be similar, or surely are. Keys
    with more than ``ROWS_KEY`` lines are joined with themselves, others are held in one task each."""
    by_line = mixed.groupBy("line", "root").agg(F.collect_set(F.struct("key", "n")).alias("x"))  # a line has ``BANDS`` keys
    known = tables.write(by_line.join(_among(sketches, "line", mixed.select("line")), "line").join(sets, "line", "left").select("line", "root", "x", "sketch", "set"), "known")
    known = known.select("line", "root", F.col("x.key").alias("keys"), "sketch", "set", F.explode("x").alias("x"))
    # keys of few lines have few pairs: sets needn't travel there
    known = known.select("line", "root", "keys", "sketch", F.when(F.col("x.n") > FEW, F.col("set")).alias("set"), F.col("x.key").alias("key"), F.col("x.n").alias("n"))
    large = known.filter(F.col("n") > ROWS_KEY)
    apart = (F.col("l.key") == F.col("r.key")) & (F.col("l.line") < F.col("r.line")) & (F.col("l.root") != F.col("r.root"))
    least = F.array_min(F.array_intersect("l.keys", "r.keys")) == F.col("l.key")
    both, each = F.size(F.array_intersect("l.set", "r.set")), F.size("l.set") + F.size("r.set")
    # with up to SLACK equal hashes of unlike shingles, sets are larger and share more or less by as many
    open_ = F.col("l.set").isNull() | F.col("r.set").isNull() | (both + SLACK >= SIMILARITY * (each - both - SLACK))
    sure = F.coalesce(both - SLACK >= SIMILARITY * (each - both + 3 * SLACK), F.lit(False))
    found = large.alias("l").join(large.alias("r"), apart & _may_be_similar("l.sketch", "r.sketch") & least & open_)
    found = found.select(F.col("l.line").alias("a"), F.col("r.line").alias("b"), sure.alias("sure"))
    rest = known.filter(F.col("n") <= ROWS_KEY).select("key", "line", "root", "sketch", "set")
    return found.union(rest.repartition("key").sortWithinPartitions("key", "line").mapInArrow(_across, "a long, b long, sure boolean")).distinct()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_close_across`` of rows (key, line, root, sketch, set) in the order of (key, line)."""
    release("lines")
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held else rows
        last = int(_runs(rows.column(0).to_numpy())[-1]) if len(rows) else 0  # of the key that may go on
        if last:
            yield from _across_keys(rows.slice(0, last))
        held = rows.slice(last)
    if held:
        yield from _across_keys(held)


def _across_keys(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    key, line, root = (rows.column(k).to_numpy() for k in range(3))
    sketch = rows.column(3).chunk(0).flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)
    sets = rows.column(4).chunk(0)
    has_set, hashes = sets.is_valid().to_numpy(zero_copy_only=False), sets.flatten().to_numpy()
    end = np.cumsum(pc.fill_null(pc.list_value_length(sets), 0).to_numpy())
    begin = np.append(0, end[:-1])
    start = _runs(key)
    many = np.diff(np.append(start, len(key)))
    left = np.repeat(many, many) - (np.arange(len(key)) - np.repeat(start, many)) - 1  # lines after each in its key
    ahead = np.argsort(-left, kind="stable")
    counts = -left[ahead]
    most = int((1 - AGREE) * 16 * SKETCH)
    for d in range(1, int(left.max()) + 1):
        i = ahead[: np.searchsorted(counts, -d, "right")]
        i = i[root[i] != root[i + d]]
        z = sketch[i] ^ sketch[i + d]
        z |= z >> np.uint64(1)
        z = (z | z >> np.uint64(2)) & np.uint64(0x1111111111111111)
        i = i[np.bitwise_count(z).sum(axis=1) <= most]
        if not len(i):
            continue
        open_, sure = np.ones(len(i), bool), np.zeros(len(i), bool)
        for k, j in enumerate(i.tolist()):
            if has_set[j] and has_set[j + d]:
                both = np.sort(np.concatenate((hashes[begin[j] : end[j]], hashes[begin[j + d] : end[j + d]])))
                each, both = len(both), np.count_nonzero(both[1:] == both[:-1])
                open_[k] = both + SLACK >= SIMILARITY * (each - both - SLACK)
                sure[k] = both - SLACK >= SIMILARITY * (each - both + 3 * SLACK)
        i, sure = i[open_], sure[open_]
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(line[i]), pa.array(line[i + d]), pa.array(sure)], names=["a", "b", "sure"])


def _removed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, Tables]:
    """(d, h, gone): of each document that loses lines the numbers of these, by doc_id and the text's hash."""
    tables = Tables(docs.sparkSession, "lines")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    places, roots = groups(narrow, tables)
    rooted = places.join(roots, F.col("line") == F.col("node"), "left")
    rooted = tables.write(rooted.select(F.coalesce("root", "line").alias("group"), F.struct("doc_id", "th", "no").alias("at")), "rooted")
    tables.drop(places, roots)
    first = tables.write(rooted.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    gone = rooted.join(first, "group").filter(~F.col("at").eqNullSafe(F.col("first"))).select("at.*")
    by_doc = gone.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.collect_set("no").alias("gone"))
    by_doc = tables.write(by_doc, "gone")
    tables.drop(rooted, first)
    tables.free()
    return by_doc, tables


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text without the lines that go, n_lines, n_removed."""
    by_doc, _ = _removed(docs, doc_id, text)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    joined = own.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h")), "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return joined.select("doc_id", _left().alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """``docs`` with all its columns, ``text`` without the lines that go; ``n_chars`` names a column that follows the text."""
    by_doc, _ = _removed(docs, doc_id, text)
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    joined = boxed.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h")), "left").select("row", _left().alias("text"))
    new = {text: F.col("text")} | ({n_chars: F.length("text").cast(docs.schema[n_chars].dataType)} if n_chars else {})
    return joined.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _left():
    return F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone")))


@F.pandas_udf(StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for t, g in zip(text, gone, strict=True):
        if g is None or t is None:
            out.append(t)
        else:
            drop = set(g.tolist() if hasattr(g, "tolist") else g)
            out.append("\n".join([x for i, x in enumerate(t.split("\n")) if i not in drop]))
    return pd.Series(out, dtype=object)
