import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import debruijn
from brindle.llm.common import Tables
from tests.llm.helpers import ODD, SF, empty_docs, odd_docs, same_as_oracle


def brute(docs):
    """Words left of each document: [(doc_id, text)] in doc_id order."""
    seen, out = set(), []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone.update(range(s, s + 20))
            seen.add(k)
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def check(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in debruijn.remove_repeats(df).collect())
    assert got == brute(docs)
    return df


def fixture(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(40))
    shared = [" ".join(word() for _ in range(rnd.randint(18, 90))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            parts.append(rnd.choice(shared) if rnd.random() < 0.4 else " ".join(word() for _ in range(rnd.randint(0, 60))))
        docs.append((i, "\n".join(parts)))
    docs += [(60, "x " * 100), (61, "x y " * 60), (62, docs[3][1]), (63, None), (64, ""), (65, "a\x1cb\x85 c\xa0d " * 30)]
    return docs


def test_equals_brute_force(spark):
    for seed in (1, 2):
        check(spark, fixture(seed))


def test_hot_minimizers(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "HOT", 3)
    check(spark, fixture(3))


def test_paths_follow_their_source(spark):
    docs = fixture(5)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    paths = debruijn.repeated_paths(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    gone = {i: set() for i in words}
    for p in paths:
        n = p.n_windows + debruijn.WINDOW - 1
        assert (p.source_doc, p.source_start) < (p.doc_id, p.start)
        assert words[p.doc_id][p.start : p.start + n] == words[p.source_doc][p.source_start : p.source_start + n]
        gone[p.doc_id].update(range(p.start, p.start + n))
    assert {i: len(g) for i, g in gone.items()} == {i: n for i, _, n, _ in brute(docs)}


def test_paths_unlike_their_source_stay(spark):
    docs = spark.createDataFrame([(1, "a b " * 20), (2, "a b " * 19 + "a c"), (None, "q " * 30), (4, "z " + "q " * 30)], "doc_id long, text string")
    rows = [(2, "a b " * 19 + "a c", 0, 21, 1, 0), (4, "z " + "q " * 30, 1, 11, None, 0)]
    paths = spark.createDataFrame(rows, "doc_id long, t string, start int, n int, source_doc long, source_start int")
    paths = paths.select("doc_id", F.xxhash64("t").alias("th"), "start", "n", "source_doc", "source_start")
    got = {r.doc_id: (r.n_removed, r.kept) for r in debruijn.remove_paths(docs, paths, Tables(spark, "t")).collect()}
    assert got[2] == (0, ("a b " * 19 + "a c")) and got[4] == (30, "z") and got[1][0] == got[None][0] == 0


def test_query_equals_oracle(spark):
    assert len(same_as_oracle(spark, "op9_debruijn_spans")) == 200


def test_odd_rows(spark):
    rows = debruijn.remove_repeats(odd_docs(spark)).collect()
    assert len(rows) == len(ODD)
    first = next(r for r in rows if r.doc_id == 1)
    assert (first.n_words, first.n_removed, first.kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert debruijn.remove_repeats(empty_docs(spark)).count() == 0
    null = spark.createDataFrame([(None, "w " * 30), (1, "w " * 30)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in debruijn.remove_repeats(null).collect()} == {None: 29, 1: 30}


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 1000, 200).astype(np.uint64)
    for k in (1, 2, 3, 5, 8, 13):
        assert debruijn.sliding_min(x, k).tolist() == [int(x[i : i + k].min()) for i in range(200 - k + 1)]
