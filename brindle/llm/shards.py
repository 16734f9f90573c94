"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded pseudo-random order and ranked; row ``r`` of a source of ``n``
rows gets the fractional rank ``(2r - 1) / 2n``. Sorting all rows by that fraction spreads every source
evenly over the whole order, so equal cuts of it hold each source in proportion.

With S sources, a source of n of all N rows has in each of k shards n / k rows, give or take 1 + (S + 1) * n / N: the
rows before a cut are those of fractions up to some x, which each source has in proportion to half a row, so x
itself is within S / 2N of the cut.

Both rankings are done in buckets: rows of one source (or one range of fractions) are dealt over many
buckets by a prefix of the sort key, ranked inside a bucket, and shifted by the counts of the buckets
before. No window ever holds a whole source or the whole table, so a source with a third of all rows is
no hot spot. Only narrow columns are shuffled; texts stay where they are read.

Defined cases: a null text has size 1 and crc32 0; a null source is a source of its own; repeated rows
each get a slot; an empty table gives no rows. Ties in the order are cut by doc_id, then crc32 and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables

#: A bucket is the first three hex digits of the md5 for the shuffle within a source.
HEX_DIGITS = 3
#: Ranges of the fractional rank for the global order.
RANGES = 4096


def _offsets(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows before each bucket: a running sum over bucket counts, within ``keys``."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def assign(
    docs: DataFrame, shards: int = 8, seed: int = 42, doc_id: str = "doc_id", source: str = "source", text: str = "text", row: str | None = None
) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, shard, slot (and ``row``, a column that tells rows apart). Row
    counts differ by one at most."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        *([F.col(row).alias("row")] if row else []),
        F.col(doc_id).alias("doc_id"),
        F.concat(F.when(F.col(source).isNull(), "0").otherwise("1"), F.coalesce(F.col(source), F.lit(""))).alias("src"),
        (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary")).alias("h"),
    ).withColumn("bucket", F.substring("h", 1, HEX_DIGITS))

    in_source = rows.groupBy("src", "bucket").agg(F.count("*").alias("n"))
    source_n = in_source.groupBy("src").agg(F.sum("n").alias("source_n"))
    before = _offsets(in_source, ["src"], "bucket").drop("n").join(source_n, "src")
    tie: list[Column | str] = ["h", "doc_id", "text_crc32", "size"]
    ranked = (
        rows.withColumn("r", F.row_number().over(W.partitionBy("src", "bucket").orderBy(*tie)))
        .join(before, ["src", "bucket"])
        .withColumn("frac", (2 * (F.col("before") + F.col("r")) - 1).cast("double") / (2 * F.col("source_n")).cast("double"))
        .withColumn("span", F.floor(F.col("frac") * RANGES).cast("int"))
        .drop("r", "before", "source_n", "bucket")
    )
    in_span = ranked.groupBy("span").agg(F.count("*").alias("n"))
    everything = in_span.withColumn("all", F.lit(0))  # at most RANGES rows
    span_before = _offsets(everything, ["all"], "span").withColumn("total", F.sum("n").over(W.partitionBy("all")))
    pos = (
        ranked.withColumn("r", F.row_number().over(W.partitionBy("span").orderBy("frac", "src", *tie)))
        .join(F.broadcast(span_before.select("span", "before", "total")), "span")  # at most RANGES rows
        .withColumn("pos", F.col("before") + F.col("r") - 1)
    )
    exact = F.expr(f"cast((pos * {shards}) div total as int)")
    first = F.expr(f"((shard * total) + {shards - 1}) div {shards}")
    return (
        pos.withColumn("shard", exact)
        .withColumn("slot", F.col("pos") - first)
        .select(*(["row"] if row else []), "doc_id", F.expr("if(left(src, 1) = '0', null, substring(src, 2))").alias("source"), "size", "text_crc32", "shard", "slot")
    )


def write_shards(docs: DataFrame, path: str, **kw) -> None:
    """Write ``docs`` with its shard and slot, one folder per shard, in slot order inside each file; columns of its own named
    shard or slot go. Rows are numbered in a written table, so rows that repeat a doc_id, or have none, each keep their slot."""
    tables = Tables(docs.sparkSession, "shards")
    boxed = tables.write(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")), "rows")
    columns = {k: kw.pop(k, k) for k in ("doc_id", "source", "text")}
    placed = assign(boxed.select("row", *(F.col("own")[c].alias(k) for k, c in columns.items())), row="row", **kw).select("row", "shard", "slot")
    (
        boxed.join(placed, "row")
        .select(*(F.col("own")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")
        .repartition("shard", F.floor(F.col("slot") / 1_000_000))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
    tables.drop(boxed)
