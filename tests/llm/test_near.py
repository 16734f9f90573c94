"""Near-duplicate documents and components."""

import random

import xxhash

from brindle.llm import components, simhash
from brindle.llm.common import Tables
from brindle.llm.queries import queries
from tests.llm.helpers import ODD, SF, empty_docs, odd_docs


def roots_of(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark, monkeypatch):
    rnd = random.Random(2)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(330)]
    edges += [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2000 + i) for i in range(300)] + [(5, 5), (1, 2), (2, 1)]
    nodes = {n for e in edges for n in e}
    df = spark.createDataFrame(edges, "x long, y long").repartition(5)
    want = roots_of(edges, nodes)
    for one_task in (components.FOREST_EDGES, 20):
        monkeypatch.setattr(components, "FOREST_EDGES", one_task)
        got = {r.node: r.root for r in components.components(df, Tables(spark, "t")).collect()}
        assert {n: got.get(n, n) for n in nodes} == want
        assert components.components(df.limit(0), Tables(spark, "t")).count() == 0


def brute_fp(text):
    ws = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def check(rows, texts):
    fps = {i: brute_fp(t) for i, t in texts.items()}
    ids = sorted(fps)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = roots_of(edges, ids)
    for r in rows:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op7_simhash_ring"](spark, SF).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_odd_rows(spark):
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == len(ODD)
    from pyspark.sql import Row

    check([Row(doc_id=r.doc_id, fingerprint=f"{r.fp & (1 << 64) - 1:016x}", component_id=r.component_id) for r in got], {r[0]: r[1] for r in ODD})
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def test_links_with_hot_keys(spark):
    """Chains of flips around a few centres: many share a key, and the hot path must lose no link."""
    rnd = random.Random(4)
    fps = set()
    for _ in range(3):
        x = rnd.getrandbits(64)
        for _ in range(160):
            y = x
            for _ in range(rnd.randint(0, 5)):
                y ^= 1 << rnd.randrange(40)
            fps.add(y)
        fps.update(x ^ (1 << k) ^ (1 << (k * 7) % 64) for k in range(64))
    fps.update(rnd.getrandbits(64) for _ in range(300))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    t = Tables(spark, "t")
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), t).collect()]
    assert got and all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in got)
    assert roots_of(got, signed) == roots_of(edges, signed)


def test_pigeonring_bound():
    rnd = random.Random(6)
    for _ in range(2000):
        x = 0
        for _ in range(rnd.randint(0, 2)):
            x |= 1 << rnd.randrange(64)
        assert any(all((x & m).bit_count() <= n * 2 // 5 for n, m in enumerate(simhash.chain_masks(s), 1)) for s in range(5))
