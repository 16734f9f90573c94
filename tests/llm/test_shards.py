from collections import Counter

from pyspark.sql import functions as F

from brindle.llm import shards
from tests.llm.helpers import ODD, SF, empty_docs, odd_docs, same_as_oracle


def test_query_equals_oracle(spark):
    got = same_as_oracle(spark, "op3_stratified_shards")
    assert len(got) == 200


def test_law_mixture_and_slots(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source", "repeat('é', int(id % 5)) as text")
    rows = shards.assign(docs).collect()
    n = Counter(r.shard for r in rows)
    assert sorted(n) == list(range(8)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
        sources = Counter(r.source for r in rows)
        for src, all_ in sources.items():
            assert abs(sum(r.shard == s and r.source == src for r in rows) - all_ / 8) <= 1 + (len(sources) + 1) * all_ / len(rows)
    again = shards.assign(docs.repartition(7)).collect()
    assert sorted(rows) == sorted(again)


def test_mixture_of_many_sources(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('s', int(pow(id % 61, 2) / 40)) as source", "'x' as text")
    rows = shards.assign(docs, shards=5).collect()
    sources, at = Counter(r.source for r in rows), Counter((r.source, r.shard) for r in rows)
    assert len(sources) > 30
    for src, n in sources.items():
        for s in range(5):
            assert abs(at[src, s] - n / 5) <= 1 + (len(sources) + 1) * n / len(rows)


def test_written_shards_hold_each_row_once(spark, tmp_path):
    odd = odd_docs(spark).withColumn("row", F.lit("mine")).withColumn("own", F.lit(1))
    docs = odd.union(odd.withColumn("doc_id", F.lit(None).cast("long"))).union(odd.limit(3))
    shards.write_shards(docs, f"{tmp_path}/out", shards=4, seed=1)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    key = lambda r: (str(r.doc_id), str(r.text), str(r.lang), str(r.source), r.row)
    assert sorted(map(key, got)) == sorted(map(key, docs.collect()))
    for s in range(4):
        slots = [r.slot for r in got if r.shard == s]
        assert sorted(slots) == list(range(len(slots)))


def test_odd_rows(spark):
    rows = shards.assign(odd_docs(spark)).collect()
    assert len(rows) == len(ODD)
    one = next(r for r in rows if r.doc_id == 1)
    assert (one.size, one.text_crc32, one.source) == (1, 0, None)
    assert shards.assign(empty_docs(spark)).count() == 0
