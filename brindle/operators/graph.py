"""Edge building over findings: capped pairs, fair caps, bounded closures, dedup, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_pairs(df: DataFrame, key: str, order: list[Column | str], limit: int, fid: str = "fid") -> DataFrame:
    """The first ``limit`` pairs (a, b) of each key in nested-loop order.

    Pair (i, j), i < j, of n rows has number (i-1)(2n-i)/2 + (j-i). Only rows that such a number can
    hold are ranked into the join: with n rows the first element is at most ``limit`` and the second at
    most ``limit`` + 1, so the self-join has at most ``limit`` squared rows a key, whatever the group's size.
    """
    w = W.partitionBy(key).orderBy(*order)
    ranked = df.select(key, fid, F.row_number().over(w).alias("i")).filter(F.col("i") <= limit + 1)
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    a, b = ranked.select(key, F.col(fid).alias("a"), "i"), ranked.select(key, F.col(fid).alias("b"), F.col("i").alias("j"))
    number = F.expr("(i - 1) * (2 * n - i) div 2 + (j - i)")
    return a.join(b, key).filter("i < j").join(n, key).filter(number <= limit).select(key, "a", "b", number.alias("number"))


def first_pairs_across(df: DataFrame, key: str, part: str, order: list[Column | str], limit: int, fid: str = "fid") -> DataFrame:
    """The first ``limit`` pairs (a, b) of each key with a's part before b's, in nested-loop order by (part, order).

    A row of a part that ends at e of n rows makes n - e pairs, so numbers follow from counts of parts; of each
    part only the first ``limit`` rows can be in such a pair."""
    n = df.groupBy(key, part).agg(F.count("*").alias("n"))
    before = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # one row a part
    place = n.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("after", F.sum("n").over(W.partitionBy(key)) - F.col("start") - F.col("n"))
    place = place.withColumn("made", F.coalesce(F.sum(F.col("n") * F.col("after")).over(before), F.lit(0)))
    ranked = df.select(key, part, fid, F.row_number().over(W.partitionBy(key, part).orderBy(*order)).alias("r")).filter(F.col("r") <= limit)
    rows = ranked.join(place, [key, part])
    a = rows.filter((F.col("made") + (F.col("r") - 1) * F.col("after") < limit) & (F.col("after") > 0))
    a = a.select(key, F.col(fid).alias("a"), (F.col("start") + F.col("n")).alias("end"), (F.col("made") + (F.col("r") - 1) * F.col("after")).alias("base"))
    b = rows.select(key, F.col(fid).alias("b"), (F.col("start") + F.col("r")).alias("j"))
    number = F.col("base") + F.col("j") - F.col("end")
    return a.join(b, key).filter((F.col("j") > F.col("end")) & (number <= limit)).select(key, "a", "b", number.alias("number"))


def fair_cap(df: DataFrame, partition: str, order: list[Column | str], limit: int = 50) -> DataFrame:
    """At most ``limit`` rows, taken in turns over the partitions in their order.

    Each partition is cut to its first ``limit`` rows before the global order is formed, so what meets in
    one task is at most ``limit`` rows from each partition that can still win a turn."""
    turn = df.withColumn("turn", F.row_number().over(W.partitionBy(partition).orderBy(*order))).filter(F.col("turn") <= limit)
    top = turn.orderBy("turn", partition).limit(limit)
    return top.withColumn("place", F.row_number().over(W.orderBy("turn", partition)))


def closure(edges: DataFrame, src: str, dst: str, depth: int, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst, hops): every node reachable in at most ``depth`` steps, with the least number of steps.

    One join a step; pairs that were reached before are left out by an anti-join, so cycles end."""
    e = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).distinct()
    start = e if seeds is None else e.join(seeds.select(F.col(seeds.columns[0]).alias("x")).distinct(), "x", "left_semi")
    seen = front = start.filter("x <> y").select(F.col("x").alias("src"), F.col("y").alias("dst"), F.lit(1).alias("hops"))
    for k in range(2, depth + 1):
        step = front.join(e, F.col("dst") == F.col("x")).select("src", F.col("y").alias("dst")).filter("src <> dst").distinct()
        front = step.join(seen, ["src", "dst"], "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def reach(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(first column of ``roots``, node, hops): nodes reached from each root's nodes in at most ``depth`` steps, with the least
    number. ``roots``: (label, node); ``edges``: (from, to). Only new (label, node) pairs go on, so cycles end."""
    label, start = roots.columns
    e = edges.toDF("x", "y").distinct()
    seen = front = roots.select(label, F.col(start).alias("node")).distinct().withColumn("hops", F.lit(0))
    for k in range(1, depth + 1):
        step = front.join(e, F.col("node") == F.col("x")).select(label, F.col("y").alias("node")).distinct()
        front = step.join(seen, [label, "node"], "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def chains(edges: DataFrame, src: str, dst: str, depth: int, keep: int = 3) -> DataFrame:
    """(src, dst, path): up to ``keep`` shortest simple paths to each target, ties by the path; pruned paths are not extended."""
    e = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).distinct()
    kept = front = e.filter("x <> y").select(F.col("x").alias("src"), F.col("y").alias("dst"), F.array("x", "y").alias("path"))
    for _ in range(2, depth + 1):
        longer = front.join(e, F.col("dst") == F.col("x")).filter(~F.array_contains("path", F.col("y"))).select("src", F.col("y").alias("dst"), F.concat("path", F.array("y")).alias("path"))
        have = kept.groupBy("src", "dst").agg(F.count("*").alias("have"))
        w = W.partitionBy("src", "dst").orderBy("path")
        front = longer.join(have, ["src", "dst"], "left").withColumn("r", F.row_number().over(w) + F.coalesce("have", F.lit(0))).filter(F.col("r") <= keep).select("src", "dst", "path")
        kept = kept.unionByName(front)
    return kept


def dedup_edges(edges: DataFrame, symmetric: tuple[str, ...] = ("same_file", "config", "env")) -> DataFrame:
    """One edge for each (source, target, type, reasoning); symmetric types have their ends in order."""
    turn = F.col("edge_type").isin(*symmetric)
    a, b = F.when(turn, F.least("source", "target")).otherwise(F.col("source")), F.when(turn, F.greatest("source", "target")).otherwise(F.col("target"))
    return edges.select(a.alias("source"), b.alias("target"), "edge_type", "reasoning").distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("source").alias("fid"), F.col("target").alias("other")).union(edges.select("target", "source")).filter("fid <> other")
    return both.groupBy("fid").agg(F.array_sort(F.collect_set("other")).alias("others"))


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before it: a union ordered once per key, no range join."""
    rows = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side")).unionByName(
        right.select(by, at, value).withColumn("side", F.lit(0)), allowMissingColumns=True
    )
    w = W.partitionBy(by).orderBy(at, "side").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("side = 1").drop("side")
