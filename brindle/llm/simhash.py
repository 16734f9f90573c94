"""SimHash near-duplicates, candidates by pigeonring filtering.

Fingerprints of 64 bits are cut into ``m`` segments on a ring. If two fingerprints differ in at most
``tau`` bits, some start segment has, for every length ``l``, at most ``l * tau / m`` differing bits in the
``l`` segments that follow it. Up to length ``e`` = the longest with ``e * tau < m`` that budget is less
than one bit, so those segments are equal: their value is the join key. Longer chains are checked as part
of the join condition, and the full distance last. Every pair is found from its viable start.

Groups of equal fingerprints are one node. Keys shared by more than ``HOT`` fingerprints are not paired:
their members are linked through all fingerprints that differ from them in at most ``tau / 2`` bits
outside the key. For tau = 2, two fingerprints differ in at most two bits exactly if they share such a
neighbour, so links of a hot key cost a constant number of rows per member and none is lost. (For other
``tau`` the hot path is not defined; odd or larger tau raises.)

Links become components by star contraction (see components), of fingerprints, so rows that repeat a doc_id keep
apart. Defined cases: a text without words (null, empty, white space) has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle; repeated rows are in one component; a component of null doc_ids
alone has a null id; columns of any name pass; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, map_rows, release

SHINGLE = 3
SEED = 42
SEGMENTS = 5
TAU = 2
#: Fingerprints that may share a key before their pairs are replaced by shared neighbours.
HOT = 48
#: Shingles hashed at a time, so that long texts need bounded memory.
CHUNK = 1 << 15

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[str]:
    """Words between ASCII white space, A-Z in lower case."""
    if not text:
        return []
    text = text.lower() if text.isascii() else text.translate(_LOWER)
    # only these six are word ends; split() would take more
    for c in "\t\n\v\f\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def shingles(words: list[str], size: int = SHINGLE) -> Iterator[str]:
    if len(words) <= size:
        if words:
            yield " ".join(words)
        return
    for i in range(len(words) - size + 1):
        yield " ".join(words[i : i + size])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = words_of(text)
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, 0
    counts = np.zeros(64, np.int64)
    step = max(1, len(words) - size + 1)
    for at in range(0, step, CHUNK):
        part = words[at : at + CHUNK + size - 1]
        if len(part) > size:
            pieces = [f"{a} {b} {c}" for a, b, c in zip(part, part[1:], part[2:], strict=False)] if size == 3 else list(shingles(part, size))
        else:
            pieces = list(shingles(part, size))
        h = np.fromiter((digest(p, SEED) for p in pieces), np.uint64, len(pieces))
        for k in range(0, len(h), 255):  # sums of 255 bits fit in a byte
            bits = np.unpackbits(h[k : k + 255].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
        n += len(pieces)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (the 64 bits as a signed long), th (the text's hash)."""

    def rows(ids, texts, hashes):
        release("simhash")
        for i, t, h in zip(ids, texts, hashes, strict=True):
            f = fingerprint(t)
            yield i, f - (1 << 64) if f >> 63 else f, h

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    return map_rows(own, ["doc_id", "text", "th"], rows, "doc_id long, fp long, th long")


def segment_masks(m: int = SEGMENTS) -> list[int]:
    edges = [round(64 * i / m) for i in range(m + 1)]
    return [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chain_masks(start: int, m: int = SEGMENTS) -> list[int]:
    """Bits of the first 1, 2, ... m segments from ``start`` around the ring."""
    masks, out, acc = segment_masks(m), [], 0
    for k in range(m):
        acc |= masks[(start + k) % m]
        out.append(acc)
    return out


def exact_length(tau: int = TAU, m: int = SEGMENTS) -> int:
    return max(e for e in range(1, m) if e * tau < m)


def _viable(x: Column, start: int, tau: int, m: int) -> Column:
    """Whether the differing bits ``x`` keep within budget for every chain from ``start``."""
    ok = F.lit(True)
    for length, mask in enumerate(chain_masks(start, m), 1):
        if length > exact_length(tau, m):
            ok &= F.bit_count(x.bitwiseAND(F.lit(_signed(mask)))) <= length * tau // m
    return ok


def links(fps: DataFrame, tables: Tables, tau: int = TAU, m: int = SEGMENTS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``tau`` bits. ``fps``: distinct longs ``fp``."""
    if tau != 2:
        raise ValueError("the hot path is stated for two bits")
    e = exact_length(tau, m)
    index = fps.select(
        "fp",
        F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(chain_masks(s, m)[e - 1]))) for s in range(m)))).alias("start", "key"),
    )
    shared = index.groupBy("start", "key").agg(F.count("*").alias("members")).filter("members > 1")
    index = tables.write(index.join(shared, ["start", "key"]), "index")
    cold = index.filter(F.col("members") <= HOT)
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    near = F.coalesce(*(F.when(F.col("l.start") == s, _viable(x, s, tau, m)) for s in range(m)))
    pairs = (
        cold.alias("l")
        .join(cold.alias("r"), ["start", "key"])
        .filter((F.col("l.fp") < F.col("r.fp")) & near & (F.bit_count(x) <= tau))
        .select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    )
    hot = index.filter(F.col("members") > HOT)
    flips = [F.col("fp")] + [F.when(F.lit(_signed(1 << k)).bitwiseAND(_key_mask(m, e)) == 0, F.col("fp").bitwiseXOR(F.lit(_signed(1 << k)))) for k in range(64)]
    spread = hot.select("start", "key", "fp", F.explode(F.array_compact(F.array(*flips))).alias("hub"))
    hubs = spread.groupBy("start", "key", "hub").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).filter("first < last")
    stars = spread.join(hubs, ["start", "key", "hub"]).filter("fp > first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    return pairs.union(stars)


def _key_mask(m: int, e: int) -> Column:
    return F.coalesce(*(F.when(F.col("start") == s, F.lit(_signed(chain_masks(s, m)[e - 1]))) for s in range(m)))


def _grouped(docs: DataFrame, doc_id: str, text: str, tables: Tables) -> DataFrame:
    """One row per document: doc_id, fp, th, group (the smallest fingerprint of its component)."""
    from .components import components

    found = tables.write(fingerprints(docs, doc_id, text), "fingerprints")
    roots = components(links(found.select("fp").distinct(), tables), tables)
    return found.join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", "fp", "th", F.coalesce("root", "fp").alias("group"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id it is linked to by any path)."""
    tables = Tables(docs.sparkSession, "simhash")
    grouped = tables.write(_grouped(docs, doc_id, text, tables), "grouped")
    least = tables.write(grouped.groupBy("group").agg(F.min("doc_id").alias("component_id")), "least")
    return grouped.join(least, "group").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all columns, of each component one document alone: the one with the smallest doc_id (null first), then the
    smallest hash of its text; of rows that repeat both, any."""
    tables = Tables(docs.sparkSession, "simhash")
    first = _grouped(docs, doc_id, text, tables).groupBy("group").agg(F.min(F.struct("doc_id", "th")).alias("x"))
    stay = tables.write(first.select(F.col("x.doc_id").alias("d"), F.col("x.th").alias("h")), "first").withColumn("key", F.xxhash64(F.col("d").isNull(), "d", "h"))
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"))
    boxed = boxed.withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "th"))
    kept = boxed.alias("l").join(stay.alias("r"), (F.col("l.key") == F.col("r.key")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left_semi")
    one = kept.dropDuplicates(["key", "doc_id", "th"])
    return one.select(*(F.col("row")[c].alias(c) for c in docs.columns))
