import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brindle.llm import fertility
from brindle.llm.queries import _spec
from tests.llm import test_latent, test_lines, test_near
from tests.llm.helpers import SF, empty_docs, odd_docs


def brute(docs, langs, items):
    rater = fertility.Rater(public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), fertility.BANDS)
    docs = [(i, t) for i, t in docs if next(rater([t], [langs[i]]))[6]]
    yield docs
    docs = sorted(test_lines.brute(docs).items())
    yield docs
    fps = {i: test_near.brute_fp(t) for i, t in docs}
    ids = sorted(fps)
    root = test_near.roots_of([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2], ids)
    docs = [(i, t) for i, t in docs if root[i] == i]
    yield docs
    found = test_latent.brute(docs, items)
    docs = [(i, t) for i, t in docs if not found[i]]
    yield docs


def test_stages_and_run_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = table.collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute([(r.doc_id, r.text) for r in rows], {r.doc_id: r.lang for r in rows}, items)
    docs = table
    for (_, stage), after in zip(corpus_pipeline.STAGES, want, strict=False):
        docs = stage(spark, docs, SF)
        assert docs.columns == table.columns
        got = docs.collect()
        assert sorted((r.doc_id, r.text) for r in got) == after
        assert all(r.n_chars == len(r.text) for r in got)
        docs = spark.createDataFrame(got, table.schema)
    lib = Tokenizer.from_str(_spec())
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(out) == [i for i, _ in after]
    for i, t in after:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_stages_with_odd_rows(spark):
    odd = odd_docs(spark).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns, name
        ids = [r.doc_id for r in got.collect()]
        assert set(ids) <= {r.doc_id for r in odd.collect()}
        if name == "simhash_near_dedup":
            assert sorted(ids) == sorted(set(ids)) and 1 in ids and 2 not in ids and 4 in ids and 5 not in ids
        assert stage(spark, empty_docs(spark), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()
