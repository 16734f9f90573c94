"""Graph helpers on fixtures by hand, and the synthetic fixture's closed numbers."""

import random

from pyspark.sql import functions as F

from brindle.operators import graph as G


def test_first_pairs_is_the_nested_loop(spark):
    for n, limit in ((0, 5), (1, 5), (4, 50), (15, 50), (60, 50), (200, 30)):
        ids = [f"{i:03d}" for i in range(n)]
        df = spark.createDataFrame([("k", x) for x in reversed(ids)], "key string, fid string")
        want = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]][:limit]
        got = [(r.a, r.b) for r in G.first_pairs(df, "key", ["fid"], limit).orderBy("number").collect()]
        assert got == want


def test_fair_cap_takes_turns_and_ignores_input_order(spark):
    rows = [(p, i) for p, n in (("a", 100), ("b", 3), ("c", 1)) for i in range(n)]
    out = None
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = [(r.p, r.i) for r in G.fair_cap(spark.createDataFrame(rows, "p string, i int"), "p", ["i"], 8).orderBy("place").collect()]
        assert got == [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("b", 1), ("a", 2), ("b", 2), ("a", 3)]
        assert out is None or got == out
        out = got


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "x string, y string")
    got = {(r.src, r.dst): r.hops for r in G.closure(e, "x", "y", 6).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("b", "c"): 1, ("b", "a"): 2, ("b", "d"): 2, ("c", "a"): 1, ("c", "d"): 1, ("c", "b"): 2}


def test_same_file_edges_of_the_synthetic_fixture(spark):
    """Two findings a module: one same-file edge for each module, and fifty import edges after the cap."""
    for modules in (80, 200, 500):
        m = spark.range(modules).select(F.concat(F.lit("mod"), "id").alias("file_url"), "id")
        f = m.select("file_url", F.explode(F.array(F.lit("endpoint"), F.lit("secret"))).alias("kind"), "id").withColumn("fid", F.concat_ws("-", "kind", "id"))
        assert G.first_pairs(f, "file_url", ["kind"], 50).count() == modules
        i = m.select("id", F.explode(F.sequence(F.col("id") + 1, F.col("id") + 3)).alias("to")).filter(F.col("to") < modules)
        a, b = f.select(F.col("fid").alias("a"), "id", "file_url"), f.select(F.col("fid").alias("b"), F.col("id").alias("to"))
        cand = a.join(i, "id").join(b, "to")
        assert G.fair_cap(cand, "file_url", ["to", "a", "b"], 50).count() == 50


def test_asof(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("z", 9)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "x"), ("k", 5, "y"), ("k", 7, "z")], "k string, t int, v string")
    assert {(r.k, r.t): r.v for r in G.asof(left, right, "k", "t", "v").collect()} == {("k", 5): "y", ("k", 1): None, ("z", 9): None}
