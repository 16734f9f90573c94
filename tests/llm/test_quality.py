import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers

from brindle.llm import common, fertility
from brindle.llm.queries import queries
from tests.llm.helpers import ODD, SF, empty_docs, odd_docs

PATHS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    hit = set()
    for i in range(len(w) - 2):
        if sum(w[i : i + 3] == w[j : j + 3] for j in range(len(w) - 2)) > 1:
            hit |= {i, i + 1, i + 2}
    lines = t.split("\n")
    dup = sum(bool(x.strip(" \t\n\v\f\r")) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed


def test_base_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text) < 4000}
    rows = {r.doc_id: r for r in queries()["op5_fertility_rules"](spark, SF).collect()}
    assert len(rows) == 200
    for i, t in texts.items():
        assert tuple(rows[i])[1:7] == brute(t), t
        assert not (rows[i].base_failed and rows[i].kept)
    odd = fertility.rate(odd_docs(spark), *PATHS).collect()
    assert len(odd) == len(ODD)
    want = {r[0]: brute(r[1]) for r in ODD}
    assert all(tuple(r)[1:7] == want[r.doc_id] for r in odd)
    assert fertility.rate(empty_docs(spark), *PATHS).count() == 0
    for t in ["a b a b a b", "a a a a", "a b c d a b c", "x y z x y", "q\n q\nq\n\n \n \n", "#|# #|# #|#"]:
        assert (fertility.repeated_words(t.split()), fertility.repeated_lines(t)) == (brute(t)[4], brute(t)[3])


def test_measures():
    v = fertility.Vocabularies(*PATHS)
    ids, by, other = v.measure("𐍈𐍉")
    assert by == 8 and len(ids) >= 8 and other > 0 and v.measure("the")[1] == 0
    assert fertility.entropy([1, 1, 1, 1]) == 2.0 and fertility.entropy([5]) == 0.0 and fertility.entropy([]) == 0.0
    assert fertility.script_of("привет мир abc") == "cyrillic" and fertility.script_of("日本語") == "cjk" and fertility.script_of("12 !") == "other"


def test_verdicts_on_labelled_rows(spark):
    """Held out: no document labelled good goes by the method; most symbol noise does."""
    sf = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    rows = [r for r in queries()["op5_fertility_rules"](spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    n = Counter((labels[r.doc_id], r.kept) for r in rows)
    assert n[1, False] == 0 and n[0, False] > 0


def test_slices_measure_each_word_once(spark, monkeypatch):
    """Rows do not depend on the slice a text is in, and a slice asks for each of its words once."""
    rater, asked = fertility.Rater(*PATHS, fertility.BANDS), []
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    texts, langs = [r.text for r in rows] + [r[1] for r in ODD], [r.lang for r in rows] + [r[2] for r in ODD]
    want = [next(rater([t], [g])) for t, g in zip(texts, langs, strict=True)]
    v = fertility.Vocabularies(*PATHS)
    for t, r in zip(texts, want, strict=True):
        got = [v.measure(w) for w in fertility.WORDS.findall(t or "")]
        assert r[7:10] == (sum(len(x[0]) for x in got), sum(x[1] for x in got), sum(x[2] for x in got))
        assert abs(r[10] - fertility.entropy(list(Counter(i for x in got for i in x[0]).values()))) < 1e-9
    packed = fertility.Vocabularies.packed
    monkeypatch.setattr(fertility.Vocabularies, "packed", lambda v, words: asked.extend(words) or packed(v, words))
    monkeypatch.setattr(common, "_PER_PROCESS", {})
    assert list(rater(texts, langs)) == want
    assert sorted(asked) == sorted({w for t in texts for w in fertility.WORDS.findall(t or "")})
    monkeypatch.setattr(fertility, "SLICE_CHARS", 5000)
    assert list(rater(texts, langs)) == want


def test_repeated_numbers():
    rnd = random.Random(2)
    for _ in range(2000):
        words = [rnd.choice((0, 1, 2, (1 << 21) - 1)) for _ in range(rnd.randint(0, 14))]
        assert fertility.repeated_numbers(np.array(words, np.int64)) == fertility.repeated_words(words)
