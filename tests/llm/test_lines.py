import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import lines
from brindle.llm.queries import queries
from tests.llm.helpers import ODD, SF, empty_docs, odd_docs
from tests.llm.test_near import roots_of


def shingles(line):
    """The runs of four characters of a line, as plain substrings."""
    return {line[i : i + 4] for i in range(max(1, len(line) - 3))}


def alike(a, b, least=0.8):
    return 10 * len(a & b) >= 10 * least * len(a | b)


def brute(docs):
    """doc_id -> text without later lines of each component, all pairs of distinct lines held against each other."""
    distinct = sorted({x for _, t in docs if t for x in t.split("\n") if lines.HAS_WORD.search(x)})
    sets = [shingles(x) for x in distinct]
    by: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    edges = []
    for i, s in enumerate(sets):
        for j in {j for g in s for j in by[g] if j > i}:
            if alike(s, sets[j]):
                edges.append((i, j))
    root = roots_of(edges, range(len(distinct)))
    number = {x: root[i] for i, x in enumerate(distinct)}
    seen, out = set(), {}
    for i, t in sorted(docs):
        if t is None:
            out[i] = None
            continue
        kept = []
        for x in t.split("\n"):
            if x in number:
                if number[x] in seen:
                    continue
                seen.add(number[x])
            kept.append(x)
        out[i] = "\n".join(kept)
    return out


def fixture(n=60, seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["ba", "ko", "tri", "sel", "un", "mo", "é"]) for _ in range(rnd.randint(1, 4)))
    base = [" ".join(word() for _ in range(rnd.randint(8, 60))) for _ in range(15)]
    docs = []
    for i in range(n):
        ls = []
        for _ in range(rnd.randint(0, 7)):
            r = rnd.random()
            if r < 0.5:
                ws = rnd.choice(base).split(" ")
                for _ in range(rnd.randint(0, 2)):
                    ws[rnd.randrange(len(ws))] = word()
                ls.append(" ".join(ws))
            elif r < 0.6:
                ls.append(rnd.choice(["", " ", "\t", "ab", "short"]))
            else:
                ls.append(" ".join(word() for _ in range(rnd.randint(1, 40))))
        docs.append((i, "\n".join(ls)))
    return docs


def test_equals_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    want = brute(docs)
    # bands find pairs with high probability, not surely; on this fixture all components are found
    assert got == want


def test_copies_near_the_threshold_lose_no_link(spark):
    """Many copies of few lines, each changed by about as much as the threshold allows."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(3))
    docs = []
    for f in range(3):
        base = [word() for _ in range(30)]
        for i in range(60):
            ws = list(base)
            for _ in range(rnd.choice((1, 2, 2, 3))):
                ws[rnd.randrange(len(ws))] = word()
            docs.append((100 * f + i, " ".join(ws)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got, want = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}, brute(docs)
    assert got == want and sum(t != "" for t in want.values()) > 3


def test_band_recall():
    """Pairs at the threshold share a band in at least 99 of 100 cases."""
    rnd = random.Random(1)
    hit = n = 0
    for _ in range(500):
        a = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(60, 400)))
        b = list(a)
        for _ in range(max(1, len(a) // 90)):
            b[rnd.randrange(len(b))] = "z"
        b = "".join(b)
        if alike(shingles(a), shingles(b)):
            n += 1
            k, (x, y) = lines.signatures([a, b])
            agree = sum((int(x[i]) >> s & 15) == (int(y[i]) >> s & 15) for i in range(lines.SKETCH) for s in range(0, 64, 4))
            hit += bool((k[0] == k[1]).any()) and agree >= 64 * lines.AGREE
    assert n > 200 and hit / n >= 0.99


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs)
    rows = queries()["op4_fuzzy_lines"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_shared_keys_of_sorted_tasks(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice((7, 7, 9, rnd.randrange(60))), rnd.randrange(40)) for _ in range(900)] + [(100, 5), (100, 5)]
    keys = spark.createDataFrame(rows, "key long, line long")
    of: dict = {}
    for k, x in rows:
        of.setdefault(k, set()).add(x)
    for parts, batch in ((1, 10000), (1, 7), (9, 3), (40, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = lines._shared(keys).collect()
        for s in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(s)
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        have: dict = {}
        for r in got:
            assert r.leader <= r.line and r.leader in of[r.key]
            have.setdefault(r.key, set()).add(r.line)
        assert all(have[k] == v for k, v in of.items() if len(v) > 1) and all(have[k] <= of[k] for k in have)
        # leaders of a key that lies in several tasks all have an edge row
        for k in have:
            leaders = {r.leader for r in got if r.key == k}
            assert len(leaders) == 1 or leaders <= {r.leader for r in got if r.key == k and r.edge}


def test_sets_are_compared_exactly():
    rnd = random.Random(6)
    for alphabet in ("ab", "abcdefgh é", "a日本語", "x👍𝒳"):
        for _ in range(150):
            a = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60)))
            b = "".join(c if rnd.random() > 0.04 else rnd.choice(alphabet) for c in a)
            assert lines.similar(a, b) == alike(shingles(a), shingles(b))


def test_a_line_of_any_length_is_hashed_in_pieces(monkeypatch):
    rnd = random.Random(8)
    long = "".join(rnd.choice("abcdef ") for _ in range(5000))
    whole = lines.signatures([long, "short", "another line"])
    monkeypatch.setattr(lines, "CHUNK", 100)
    for x, y in zip(lines.signatures([long, "short", "another line"]), whole, strict=True):
        assert (x == y).all()


def test_odd_rows(spark):
    df = odd_docs(spark)
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    for c in ("n_lines", "n_removed", "d", "h", "gone", "row", "th", "line", "_th", "_gone"):
        df = df.withColumn(c, F.lit("mine"))
    kept = lines.clean(df)
    assert kept.columns == df.columns and {(r.n_lines, r.gone, r.row, r.shard) for r in kept.collect()} == {("mine", "mine", "mine", 1)}
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((r.doc_id, r.text or "") for r in got.collect())
    rows = got.collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].text is None and by[2].text == "" and by[4].text == "same text here and there" and by[5].text == ""
    assert lines.dedup_lines(empty_docs(spark)).count() == 0


def test_signature_is_of_the_line_alone():
    xs = ["short", "a line of some length, to be sure", "é" * 40, "日本語の文章です。とても短い"]
    each = np.vstack([lines.signatures([x])[0] for x in xs])
    assert (lines.signatures(xs)[0] == each).all()


def test_small_edits_of_short_lines_go(spark):
    """Of lines of 40 to 120 characters, copies with another character go, and most with another word where it is short
    against the line; other lines stay."""
    rnd = random.Random(4)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    distinct = sorted({x for t in texts if t for x in t.split("\n") if 40 <= len(x) < 120 and len(x.split(" ")) > 4})
    # no two of them similar before the edits
    base: list = []
    for x in rnd.sample(distinct, len(distinct)):
        s = shingles(x)
        if len(base) < 120 and not any(alike(s, y, 0.5) for _, y in base):
            base.append((x, s))
    docs, kind = [], {}
    for i, (x, _) in enumerate(base):
        docs.append((i, x))
        p = rnd.randrange(len(x))
        docs.append((1000 + i, x[:p] + "#" + x[p + 1 :]))
        kind[1000 + i] = "char"
        if len(x) >= 80:
            ws = x.split(" ")
            ws[rnd.randrange(len(ws))] = "other"
            docs.append((2000 + i, " ".join(ws)))
            kind[2000 + i] = "word"
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    share = lambda k: sum(got[d] for d in kind if kind[d] == k) / max(1, sum(c == k for c in kind.values()))
    assert len(base) >= 50 and sum(c == "word" for c in kind.values()) >= 10
    assert not any(got[i] for i in range(len(base)))
    assert share("char") >= 0.95 and share("word") >= 0.6
