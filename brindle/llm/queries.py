"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, debruijn, fertility, latent, lines, repair, secrets, shards, simhash, viterbi
from .common import read_table


def _spec(name: str = "word_bpe_49k.json") -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op2_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(read_table(spark, sf_dir, "documents"), _spec(), end_id=2)


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(read_table(spark, sf_dir, "documents"), shards=8, seed=42)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.rate(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    )


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), _spec())


def op7_simhash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(read_table(spark, sf_dir, "documents"), viterbi.load_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op9_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debruijn.remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_latent_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_secret_scan,
            op2_repair_ids,
            op3_stratified_shards,
            op4_fuzzy_lines,
            op5_fertility_rules,
            op6_bpe_transducer,
            op7_simhash_ring,
            op8_viterbi_counts,
            op9_debruijn_spans,
            op10_latent_decontam,
        )
    }


#: CRC-32 (reflected 0xEDB88320) over the bytes of a text, bit by bit through a table made in SQL.
_CRC = """
crc_table as (
  select list(c order by i) t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c
    from (select range i from range(256))))
"""

OP3 = f"""
with {_CRC},
bytes as (
  select doc_id, source, encode(coalesce(text, '')) b, hex(encode(coalesce(text, ''))) hx, t from documents, crc_table),
rows_ as (
  select doc_id, source, octet_length(b) + 1 size,
    xor(list_reduce(list_prepend(4294967295::bigint,
        list_transform(range(1, octet_length(b)::bigint * 2, 2), lambda i: ('0x' || substr(hx, i, 2))::bigint)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) text_crc32,
    md5('42:' || doc_id) h
  from bytes),
ranked as (
  select *, (2 * row_number() over (partition by source order by h, doc_id, text_crc32, size) - 1)::double
    / (2 * count(*) over (partition by source))::double frac from rows_),
placed as (
  select *, row_number() over (order by frac, source nulls first, h, doc_id, text_crc32, size) - 1 pos, count(*) over () total from ranked)
select doc_id, size::bigint size, text_crc32::bigint text_crc32, 'rows' law, ((pos * 8) // total)::int shard,
  (pos - (((pos * 8) // total) * total + 7) // 8)::bigint slot, null::int grown_shard
from placed
"""


OP9 = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
places as (
  select doc_id, ws, unnest(range(1, len(ws) - 18)) s from words),
judged as (
  select doc_id, s, row_number() over (partition by array_to_string(ws[s:s + 19], ' ') order by doc_id, s) r from places),
gone as (
  select doc_id, list(distinct p) ps from (select doc_id, unnest(range(s, s + 20)) p from judged where r > 1) group by doc_id),
left_ as (
  select doc_id, len(ws) n_words, coalesce(len(ps), 0) n_removed,
    case when ps is null then ws else list_filter(ws, lambda w, i: not list_contains(ps, i)) end kept
  from words left join gone using (doc_id))
select doc_id, n_words::bigint n_words, n_removed::bigint n_removed, sha256(array_to_string(kept, ' ')) kept_sha256 from left_
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_stratified_shards": OP3, "op9_debruijn_spans": OP9}
