"""Repeated spans of words by a de Bruijn graph over all documents.

Every ``WINDOW`` consecutive words are an edge of the graph. As in parallel genome assembly, edges are
dealt by minimizer: the smallest hash of the ``KMER``-word runs inside the window. Equal windows have equal
minimizers, and neighbouring windows mostly share one, so a run of windows with one minimizer (a packet)
travels as one row. Three joins do the work:

1. minimizers of all packets are grouped; those met once can hold no repeated window and go;
2. packets whose minimizer is met again are cut from their documents (join by doc_id), grouped by
   (minimizer, window hash), and each window learns its first place, by doc_id and then by start;
3. windows that are not first compact into paths, across packets, as long as their first places follow each
   other: a span with its source coordinates. Spans and the distinct places at their sources go back to
   their documents (one join by doc_id); each side gives a 128-bit digest of its words, and an anti-join
   finds spans whose words are not those at the source.

A group of one (minimizer, window) is a sorted stream, never a collected list. Minimizers met more than
``HOT`` times are reduced by a pre-aggregated minimum and joined back, so that no task gets all of a hot
passage. Windows are judged on the input. Two windows are first taken as equal if a 64-bit hash of the window
and that of a run inside it agree; if the words at the source turn out to be others, no span with that source
and length is removed. A branch of the graph ends a path only where the first places part there. Finished
stages are written to the shared folder.

Defined cases: null texts and texts of fewer words than a window lose nothing; rows that repeat both
doc_id and text are one document (each row gets the result of the first); rows that repeat only the doc_id
are judged each by itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Memo, Tables, map_rows, per_process, split_words

WINDOW = 20
KMER = 8
#: Windows in a packet at most: their offsets are bits of an integer.
PACKET = 16
#: Packets of a minimizer beyond which its windows are pre-aggregated.
HOT = 200_000

WORDS = re.compile(WORD)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(words: list[str]) -> np.ndarray:
    memo = per_process("word-hash", lambda: Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7), 48 << 20))
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every ``size`` values in a row, modulo 2**64: runs of powers of two are joined."""
    n = len(h) - size + 1
    out, have, part, span = None, 0, h, 1
    while True:
        if size & span:
            shift = np.uint64(pow(int(_BASE), span, 1 << 64))
            out = part if out is None else out[:n] * shift + part[have : have + n]
            have += span
        if have == size:
            return out[:n]
        part = part[:-span] * np.uint64(pow(int(_BASE), span, 1 << 64)) + part[span:]
        span *= 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while 2 * span <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def packets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window hashes, minimizers by window, start and length of each packet)."""
    windows = _mixed(rolling(h, WINDOW))
    least = sliding_min(_mixed(rolling(h, KMER)), WINDOW - KMER + 1)
    new = np.concatenate(([True], least[1:] != least[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(least)), 0))
    start = np.flatnonzero((np.arange(len(least)) - first) % PACKET == 0)
    return windows, least, start, np.diff(np.append(start, len(least)))


def _minimizers(docs: DataFrame) -> DataFrame:
    """A row for each packet: minimizer, doc_id, start, weight (2 if one of its windows repeats inside the document)."""
    names = ["least", "doc_id", "start", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            ids = batch.column(0)
            codes, distinct, before = split_words(batch.column(1))
            hashes = word_hashes(distinct)[codes]
            for k in np.flatnonzero(np.diff(before) >= WINDOW).tolist():
                windows, least, start, length = packets(hashes[before[k] : before[k + 1]])
                ordered = np.sort(windows)
                twice = np.zeros(len(start), bool)
                if len(again := np.unique(ordered[1:][ordered[1:] == ordered[:-1]])):
                    twice = np.maximum.reduceat(np.isin(windows, again), start)
                cols[0].append(least[start].view(np.int64))
                cols[1].append(pa.concat_arrays([ids.slice(k, 1)]).take(pa.array(np.zeros(len(start), np.int32))))
                cols[2].append(start.astype(np.int32))
                cols[3].append(1 + twice.astype(np.int8))
            if cols[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cols[0])), pa.concat_arrays(cols[1]).cast(pa.int64()), pa.array(np.concatenate(cols[2])), pa.array(np.concatenate(cols[3]))], names=names
                )

    return docs.select("doc_id", "text").mapInArrow(run, "least long, doc_id long, start int, weight byte")


def _packet_rows(docs: DataFrame) -> DataFrame:
    """The packets listed in ``starts`` (twice the start, plus one for a hot minimizer), with their window hashes."""

    def rows(ids, hashes, texts, starts):
        for i, th, t, want in zip(ids, hashes, texts, starts, strict=True):
            if not want:
                continue
            words = WORDS.findall(t or "")
            if len(words) < WINDOW:
                continue
            windows, least, start, length = packets(word_hashes(words))
            windows, least = windows.view(np.int64), least.view(np.int64)
            hot = {s >> 1: s & 1 for s in want}
            for s, n in zip(start.tolist(), length.tolist(), strict=True):
                if s in hot:
                    yield int(least[s]), i, th, s, windows[s : s + n].tolist(), bool(hot[s])

    return map_rows(docs, ["doc_id", "th", "text", "starts"], rows, "least long, doc_id long, th long, start int, windows array<long>, hot boolean")


def _judged(docs: DataFrame, tables: Tables) -> DataFrame:
    """Rows (doc_id, th, start, source_doc, shift, later): paths inside a packet that starts at ``start``; the bits of
    ``later`` are its windows whose first place is in ``source_doc``, ``shift`` words from their own."""
    packets_ = _minimizers(docs)
    met = packets_.withColumn("met", F.sum(F.col("weight").cast("long")).over(W.partitionBy("least"))).filter("met > 1")
    wanted = met.groupBy("doc_id").agg(F.collect_list(F.col("start") * 2 + (F.col("met") > HOT).cast("int")).alias("starts"))
    wanted = tables.write(wanted, "wanted")
    tables.free()
    th = F.xxhash64("text").alias("th")
    listed = docs.select("doc_id", "text").join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select(docs["doc_id"], th, "text", "starts")
    rows = _packet_rows(listed)
    place = F.struct("doc_id", "s")

    def windows(df: DataFrame) -> DataFrame:
        return df.select("least", "doc_id", "th", "start", F.posexplode("windows").alias("o", "w")).withColumn("s", F.col("start") + F.col("o"))

    def back(df: DataFrame) -> DataFrame:
        """Windows of a packet whose first places are as far from their own follow one path."""
        path = df.withColumn("source_doc", F.col("source.doc_id")).withColumn("shift", F.col("source.s") - F.col("s"))
        return path.groupBy("least", "doc_id", "th", "start", "source_doc", "shift").agg(F.expr("bit_or(shiftleft(1, o))").alias("later")).drop("least")

    # first() over an ordered frame and rank() need no buffer: a group is streamed
    order = W.partitionBy("least", "w").orderBy("doc_id", "s")
    cold = windows(rows.filter("not hot").repartition("least")).withColumn("r", F.rank().over(order)).withColumn("source", F.first(place).over(order.rowsBetween(W.unboundedPreceding, 0)))
    hot = tables.write(rows.filter("hot"), "hot") if not wanted.filter(F.exists("starts", lambda x: x % 2 == 1)).isEmpty() else None
    out = back(cold.filter("r > 1"))
    if hot is not None:
        each = windows(hot)
        source = each.groupBy("least", "w").agg(F.min(place).alias("source"))
        out = out.unionByName(back(each.join(source, ["least", "w"]).filter("struct(doc_id, s) > source")))
    return out


def _bits(later: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(PACKET - 1)), lambda o: later.bitwiseAND(F.call_function("shiftleft", F.lit(1), o)) != 0)


def _compacted(docs: DataFrame, tables: Tables) -> DataFrame:
    """Paths across packets: (doc_id, th, start, n, source_doc, source_start), ``n`` windows from ``start`` whose first
    places follow each other from ``source_start``."""
    keys = ["doc_id", "th", "source_doc", "shift"]
    one = _judged(docs, tables).select(*keys, "start", F.explode(_bits(F.col("later"))).alias("o")).select(*keys, (F.col("start") + F.col("o")).alias("s"))
    island = one.withColumn("island", F.col("s") - F.row_number().over(W.partitionBy(*keys).orderBy("s")))
    path = island.groupBy(*keys, "island").agg(F.min("s").alias("start"), F.count("*").cast("int").alias("n"))
    return path.select("doc_id", "th", "start", "n", "source_doc", (F.col("start") + F.col("shift")).alias("source_start"))


def covered(starts: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words the paths of ``counts`` windows from ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + WINDOW - 1, -1)
    return np.cumsum(edge[:n]) > 0


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
#: A path as its document has it (own), and the words at a source as the source has them (there).
DIGESTS = "own array<struct<source_doc:long,source_start:int,n:int,digest:binary>>, there array<struct<start:int,n:int,digest:binary>>"


def _without(docs: DataFrame, paths: DataFrame, with_text: bool) -> DataFrame:
    """SCHEMA and DIGESTS: documents without the words of ``paths``, in one pass that also reads the words of each path
    and those at its source."""
    none = F.lit(None).cast("long")
    source = paths.select(F.col("source_doc").alias("doc_id"), none.alias("th"), F.col("source_start").alias("start"), "n", none.alias("source_doc"), F.lit(None).cast("int").alias("source_start"))
    place = F.collect_list(F.struct("th", "start", "n", "source_doc", "source_start"))
    listed = paths.unionByName(source.distinct()).groupBy("doc_id").agg(place.alias("p"))
    listed = listed.select(F.col("doc_id").alias("d"), *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("th", "start", "n", "source_doc", "source_start")))
    joined = docs.withColumn("th", F.xxhash64("text")).join(listed, F.col("doc_id").eqNullSafe(F.col("d")), "left")

    def digest(words: list[str]) -> bytes:
        return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def rows(ids, hashes, texts, *lists):
        for i, th, t, *path in zip(ids, hashes, texts, *lists, strict=True):
            words = WORDS.findall(t or "")
            kept, own, there, starts, counts = words, [], [], [], []
            for h, s, n, source_doc, source_start in zip(*path, strict=True) if path[0] else ():
                end = s + n + WINDOW - 1
                if h is None:
                    there.append((s, n, digest(words[s:end])))
                elif h == th:
                    own.append((source_doc, source_start, n, digest(words[s:end])))
                    starts.append(s)
                    counts.append(n)
            if starts:
                gone = covered(np.array(starts), np.array(counts), len(words)).tolist()
                kept = [w for w, g in zip(words, gone, strict=True) if not g]
            out = " ".join(kept)
            sha = hashlib.sha256(out.encode("utf-8", "surrogatepass")).hexdigest()
            yield i, len(words), len(words) - len(kept), sha, out if with_text else None, own, there

    return map_rows(joined, ["doc_id", "th", "text", "p_th", "p_start", "p_n", "p_source_doc", "p_source_start"], rows, f"{SCHEMA}, {DIGESTS}")


def _unlike(done: DataFrame) -> DataFrame:
    """(source_doc, source_start, n, digest) of paths whose words are not those at their source."""
    own = done.select(F.explode("own").alias("p")).select("p.*").distinct()
    there = done.select(F.col("doc_id").alias("t_doc"), F.explode("there").alias("p")).select("t_doc", F.col("p.start").alias("t_start"), F.col("p.n").alias("t_n"), F.col("p.digest").alias("t_digest"))
    same = F.col("source_doc").eqNullSafe(F.col("t_doc")) & (F.col("source_start") == F.col("t_start")) & (F.col("n") == F.col("t_n")) & (F.col("digest") == F.col("t_digest"))
    return own.join(there, same, "left_anti")


def remove_paths(docs: DataFrame, paths: DataFrame, tables: Tables, with_text: bool = True) -> DataFrame:
    """SCHEMA: documents without the words of those ``paths`` whose words equal the words at their source."""
    done = tables.write(_without(docs, paths, with_text), "done")
    tables.free()
    unlike = _unlike(done)
    if not unlike.isEmpty():
        # Hashes agreed and words do not: all paths with that source and length go, but for those that are like it.
        unlike = unlike.select(F.col("source_doc").alias("u_doc"), F.col("source_start").alias("u_start"), F.col("n").alias("u_n")).distinct()
        at = F.col("source_doc").eqNullSafe(F.col("u_doc")) & (F.col("source_start") == F.col("u_start")) & (F.col("n") == F.col("u_n"))
        done = _without(docs, paths.join(tables.write(unlike, "unlike"), at, "left_anti"), with_text)
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by a space)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    tables = Tables(docs.sparkSession, "debruijn")
    paths = tables.write(_compacted(docs, tables), "paths")
    tables.free()
    return remove_paths(docs, paths, tables, with_text)


def repeated_paths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Compacted paths: (doc_id, start, n_windows, source_doc, source_start), the words from ``start`` being
    those from ``source_start`` of the first document that has them."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    paths = _compacted(docs, Tables(docs.sparkSession, "debruijn"))
    return paths.select("doc_id", "start", F.col("n").alias("n_windows"), "source_doc", "source_start")
