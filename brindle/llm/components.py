"""Connected components by alternating star contraction, without lineage that grows.

Edges are first thinned inside each partition by union-find (a spanning forest of what the partition
holds keeps every component). Then rounds of large-star and small-star joins, each a pre-aggregated
minimum and an equi-join, turn every component into a star around its smallest node. Each round is written
to the shared folder, so a lost executor costs one round at most; nothing is collected to the driver. Minima are
written before they are joined back, so the adaptive skew join can split the links of a hub. Edges that one
task may hold are stars after the thinning already.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: Edges a task thins at a time; memory of a task is bounded by it.
FOREST_EDGES = 250_000


def _forest(edges: DataFrame) -> DataFrame:
    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def out(parent):
            pairs = [(x, find(parent, x)) for x in parent]
            pairs = [p for p in pairs if p[0] != p[1]]
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        def find(parent, x):
            root = x
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        parent: dict[int, int] = {}
        n = 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ra, rb = find(parent, parent.setdefault(a, a)), find(parent, parent.setdefault(b, b))
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
            n += batch.num_rows
            if n >= FOREST_EDGES:
                yield from out(parent)
                parent, n = {}, 0
        yield from out(parent)

    return edges.mapInArrow(run, "a long, b long")


def _large_star(edges: DataFrame, tables: Tables) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = tables.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    out = tables.write(both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
    tables.drop(least)
    return out


def _small_star(edges: DataFrame, tables: Tables) -> DataFrame:
    least = tables.write(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a")
    out = tables.write(moved.select("a", F.col("m").alias("b")).union(moved.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "small")
    tables.drop(least, edges)
    return out


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, tables: Tables, rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has a link to a smaller one; root is the component's smallest node.

    ``edges``: two long columns, in any direction, loops and repeats allowed. Nodes without a row are
    roots. Raises if the rounds do not suffice (they are logarithmic in practice)."""
    a, b = edges.columns[:2]
    ordered = tables.write(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b"), "edges")
    tasks = -(-ordered.count() // FOREST_EDGES)
    now = tables.write(_forest(ordered.coalesce(1) if tasks < 2 else ordered).distinct(), "forest")
    tables.drop(ordered)
    if tasks < 2:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        new = _small_star(_large_star(now, tables), tables)
        tables.drop(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
