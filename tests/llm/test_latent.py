import random

import numpy as np

from brindle.llm import latent
from brindle.llm.queries import queries
from tests.llm.helpers import ODD, SF, empty_docs, odd_docs

SCHEMA = "item_id long, text string"


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_lcs_equals_table():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randint(0, 40))] for _ in range(2))
        bits = {}
        for k, t in enumerate(b):
            bits[t] = bits.get(t, 0) | 1 << k
        assert latent.lcs(a, bits, len(b)) == lcs_table(a, b)


def brute(docs, items):
    """doc_id -> items found by verifying every passage of every length at every block, without retrieval."""
    block = latent.Items.of(items)
    df = np.zeros(len(block.vocab), np.int64)
    number = block.vocab
    xs = {i: np.array([number.get(t, -1) for t in latent.terms_of(t_)], np.int64) for i, t_ in docs}
    for x in xs.values():
        u = np.unique(x)
        df[u[u >= 0]] += 1
    m = latent.Matcher(block, np.ones(len(df), np.float32), np.eye(len(df), 4, dtype=np.float32), df)
    out = {}
    for i, x in xs.items():
        out[i] = sorted({block.ids[k] for k in range(len(block.ids)) for a in range(0, len(x), latent.BLOCK) if m.verify(x, a, a + latent.LONG * latent.BLOCK, k)})
    return out


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute(docs, items)
    rows = queries()["op10_latent_decontam"](spark, SF).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: [int(x) for x in r.item_ids.split(",") if x] for r in rows}
    pairs = {(i, k) for i, ks in want.items() for k in ks}
    found = {(i, k) for i, ks in got.items() for k in ks}
    assert found <= pairs and len(found) >= 0.9 * len(pairs)
    # items that occur whole are all found
    whole = {(i, k) for i, t in docs for k, s in items if s in t}
    assert whole <= found
    assert all(r.contaminated == (r.n_items > 0) for r in rows)


def test_planted_cases(spark):
    """Whole, shortened, reordered by a word and padded items are found in long texts; others are left alone."""
    rnd = random.Random(3)
    word = lambda n=4: "".join(rnd.choice(["ba", "ko", "tri", "sel", "un", "mo", "ra", "vi", "est"]) for _ in range(rnd.randint(1, n)))
    items = [(k, " ".join(word() for _ in range(rnd.choice([7, 14, 25, 40, 62])))) for k in range(30)]
    docs, planted = [], set()
    for i in range(240):
        ws = [word() for _ in range(rnd.randint(50, 1500))]
        if i % 4 == 0:
            k = rnd.randrange(30)
            own = items[k][1].split(" ")
            kind = rnd.randrange(3)
            if kind == 1 and len(own) > 10:
                del own[len(own) // 2]
                own[2] = "other"
            if kind == 2:
                own = [w.upper() + "," for w in own]
            at = rnd.randrange(len(ws))
            ws[at:at] = own
            planted.add((i, k))
        docs.append((i, " ".join(ws)))
    docs.append((1000, "x " * 100_000 + items[3][1]))
    planted.add((1000, 3))
    rows = latent.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, SCHEMA)).collect()
    found = {(r.doc_id, int(k)) for r in rows for k in r.item_ids.split(",") if k}
    assert len(found & planted) >= 0.98 * len(planted) and not found - planted


def test_blocks_of_the_benchmark(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {r.doc_id: r.item_ids for r in latent.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(latent, "BENCHMARK_BYTES", 5000)
    assert len(list(latent.item_blocks(bench))) > 1
    assert {r.doc_id: r.item_ids for r in latent.find_leaks(docs, bench).collect()} == whole


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "the end of the whole story"), (3, "the end of the whole story"), (4, "x")], SCHEMA)
    rows = latent.find_leaks(odd_docs(spark), bench).collect()
    assert len(rows) == len(ODD) and not any(r.contaminated for r in rows)
    assert latent.find_leaks(empty_docs(spark), bench).count() == 0
    assert not any(r.contaminated for r in latent.find_leaks(odd_docs(spark), bench.limit(0)).collect())
    assert latent.clean(odd_docs(spark), bench).columns == odd_docs(spark).columns


def test_long_items_are_found(spark):
    """Whole copies of items of any length, and long ones of which a quarter of the words are others or a third in a row is missing."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["ba", "ko", "tri", "sel", "un", "mo", "ra", "vi", "est"]) for _ in range(rnd.randint(2, 5)))
    sizes = [5, 64, 65, 100, 200, 250, 300, 400, 1000]
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate(sizes)]
    docs, planted = [], set()
    for i in range(270):
        ws = [word() for _ in range(rnd.randint(50, 1500))]
        if i % 3 == 0:
            k = i // 3 % len(sizes)
            own = items[k][1].split(" ")
            kind = i // 27 % 3 if len(own) >= 100 else 0
            if kind == 1:
                for p in rnd.sample(range(len(own)), len(own) // 4):
                    own[p] = word()
            elif kind == 2:
                del own[(p := rnd.randrange(len(own) * 2 // 3)) : p + len(own) // 3]
            at = rnd.randrange(len(ws))
            ws[at:at] = own
            planted.add((i, k, kind))
        docs.append((i, " ".join(ws)))
    rows = latent.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, SCHEMA)).collect()
    found = {(r.doc_id, int(k)) for r in rows for k in r.item_ids.split(",") if k}
    want = {(i, k) for i, ks in brute(docs, items).items() for k in ks}
    # copies that lack most of the item's answer are no leaks
    assert found == want and want <= {(i, k) for i, k, _ in planted} and {(i, k) for i, k, kind in planted if not kind} <= found
    assert sum(kind > 0 and (i, k) in found for i, k, kind in planted) >= 5
