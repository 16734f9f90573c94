import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from brindle.llm import repair
from brindle.llm.queries import _spec, queries
from tests.llm.helpers import ODD, SF, empty_docs, odd_docs


def test_grammar_round_trip_and_random_access():
    rnd = random.Random(7)
    for n, v in ((0, 100), (1, 100), (5000, 30), (30_000, 60_000), (4000, 1)):
        words = [[rnd.randrange(v) for _ in range(rnd.randint(1, 6))] for _ in range(40)]
        ids = np.array([x for _ in range(n) for x in rnd.choice(words)][:n], np.uint16)
        ends = sorted({rnd.randint(0, n) for _ in range(5)} | {n})
        shard = repair.Shard(repair.pack(list(range(len(ends))), ends, ids, v))
        assert np.array_equal(shard.ids(), ids)
        if n >= 4000 and v < 60_000:
            assert len(shard.symbols) < n / 2
        for _ in range(50):
            a = rnd.randint(0, n)
            b = rnd.randint(a, n)
            assert np.array_equal(shard.read(a, b), ids[a:b])
        a = 0
        for k, b in enumerate(ends):
            assert np.array_equal(shard.document(k), ids[a:b])
            a = b


def test_rounds_end_when_no_pair_pays_or_codes_are_out():
    rnd = np.random.default_rng(5)
    for n, v in ((40_000, 300), (60_000, 65_500), (20_000, 2)):
        ids = (rnd.zipf(1.3, n) % v).astype(np.uint16)
        symbols, left, right = repair.compress(ids, v)
        if v + len(left) < repair.CODES:
            pairs = list(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True))
            assert max(pairs.count(p) for p in set(pairs)) < repair.MIN_COUNT
        uses = np.bincount(np.concatenate([symbols, left, right]), minlength=v + len(left))[v:]
        assert len(left) and uses.min() >= 1


def test_words_as_the_library_has_them():
    lib, words = Tokenizer.from_str(_spec()), repair.WordIds(_spec())
    texts = [r[1] for r in ODD] + ["a\x1cb\x85c\xa0d it's WE'LL <|endoftext|>x< >y 3.14 \x00z ÅÉß İſ don't", "é" * 300 + "'ll", " \t"]
    for _ in range(2):
        ids, edge = words.encode(pa.array(texts))
        for t, a, b in zip(texts, edge, edge[1:], strict=False):
            assert ids[a:b].tolist() == lib.encode(t or "", add_special_tokens=False).ids


def test_a_piece_of_many_words_is_encoded_once():
    lib, words = Tokenizer.from_str(_spec()), repair.WordIds(_spec())
    texts = ["stone, stone. (stone) Stone! stone's á Ã¡ Ã¡x", "STONE? 'stone' stone;stone á"]
    sent = []

    class Told:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **kw):
            sent.extend(p for t in texts for p in t.split(" "))
            return self.inner.encode_batch_fast(texts, **kw)

    words.pieces = Told(words.pieces)
    for _ in range(2):
        ids, edge = words.encode(pa.array(texts))
        for t, a, b in zip(texts, edge, edge[1:], strict=False):
            assert ids[a:b].tolist() == lib.encode(t, add_special_tokens=False).ids
    assert sent.count("stone") == 1 and len(sent) == len(set(sent))


def check(rows, docs, lib):
    rows = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(d[0] for d in docs)
    texts, at = {d[0]: d[1] for d in docs}, 0
    for r in rows:
        ids = [*lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_query_equals_library(spark):
    lib = Tokenizer.from_str(_spec())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(queries()["op2_repair_ids"](spark, SF).collect(), docs, lib)
    # many shards, rows in another order
    df = spark.read.parquet(f"{SF}/documents.parquet").orderBy("text")
    check(repair.round_trip(df, _spec(), 2, shard_ids=1000).collect(), docs, lib)


def test_odd_rows(spark):
    lib = Tokenizer.from_str(_spec())
    check(repair.round_trip(odd_docs(spark), _spec(), 2).collect(), [r[:2] for r in ODD], lib)
    assert repair.round_trip(empty_docs(spark), _spec(), 2).count() == 0
    null = spark.createDataFrame([(None, "a"), (3, "b")], "doc_id long, text string")
    assert [r.doc_id for r in repair.round_trip(null, _spec(), 2).orderBy("start").collect()] == [None, 3]
