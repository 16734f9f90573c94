"""Scores, tiers, filters, summaries and report projections over findings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions import scores as S
from brindle.functions import texts as T
from brindle.plans.registry import query
from brindle.sources.tables import FINDINGS, findings, table

SCORED = f"(select *, {S.TIER_SQL} tier from (select *, {S.SCORE_SQL} score from ({FINDINGS})))"


def scored(spark, sf_dir):
    return findings(spark, sf_dir).withColumn("score", S.score()).withColumn("tier", S.tier(F.col("score")))


@query(f"select fid, {S.IMPACT_SQL} impact, {S.LIKELIHOOD_SQL} likelihood from ({FINDINGS})")
def score_parts(spark, sf_dir):
    return findings(spark, sf_dir).select("fid", S.impact().alias("impact"), S.likelihood().alias("likelihood"))


@query(f"select fid, score, tier from {SCORED}")
def risk_tier(spark, sf_dir):
    return scored(spark, sf_dir).select("fid", "score", "tier")


@query(f"select fid, 'Category: ' || category || '. Severity: ' || severity || '. Confidence: ' || confidence || '. Tier: ' || tier reasoning from {SCORED}")
def risk_reasoning(spark, sf_dir):
    parts = F.concat_ws(". ", *(F.concat(F.lit(f"{n}: "), F.col(c)) for n, c in (("Category", "category"), ("Severity", "severity"), ("Confidence", "confidence"), ("Tier", "tier"))))
    return scored(spark, sf_dir).select("fid", parts.alias("reasoning"))


@query(f"select coalesce(severity, '') severity, coalesce(category, '') category, coalesce(tier, '') tier, count(*) n from {SCORED} group by grouping sets ((severity), (category), (tier), ())")
def summary_grouping_sets(spark, sf_dir):
    d = scored(spark, sf_dir)
    names = ("severity", "category", "tier")
    g = d.groupingSets([[F.col("severity")], [F.col("category")], [F.col("tier")], []], *names).agg(F.count("*").alias("n"))
    return g.select(*(F.coalesce(c, F.lit("")).alias(c) for c in names), "n")


@query(f"select s severity, count(fid) n from (select unnest({list(S.SEVERITIES)}) s) left join ({FINDINGS}) f on f.severity = s and category = 'domain' group by s")
def summary_zero_filled(spark, sf_dir):
    """Counts by severity with zeros for those that do not occur."""
    dim = spark.createDataFrame([(s,) for s in S.SEVERITIES], "severity string")
    n = findings(spark, sf_dir).filter("category = 'domain'").groupBy("severity").count()
    return dim.join(n, "severity", "left").select("severity", F.coalesce("count", F.lit(0)).alias("n"))


@query(f"select fid, confidence from ({FINDINGS}) where {S.rank_sql('confidence', S.CONFIDENCES)} >= 1")
def min_confidence(spark, sf_dir):
    return findings(spark, sf_dir).filter(S.rank(F.col("confidence"), S.CONFIDENCES) >= 1).select("fid", "confidence")


@query(f"select fid, severity, t tier from (select *, case when category = 'flag' then null else tier end t from {SCORED}) where {S.rank_sql('severity', S.SEVERITIES)} >= 2 and (t is null or t <= 'P2')")
def output_filter(spark, sf_dir):
    """A floor on severity and a ceiling on tier; findings without a tier pass the ceiling."""
    t = F.when(F.col("category") != "flag", F.col("tier"))
    d = scored(spark, sf_dir).withColumn("tier", t)
    return d.filter((S.rank(F.col("severity"), S.SEVERITIES) >= 2) & (F.col("tier").isNull() | (F.col("tier") <= "P2"))).select("fid", "severity", "tier")


@query(f"select category, max({S.rank_sql('severity', S.SEVERITIES)})::int worst, bool_or({S.rank_sql('severity', S.SEVERITIES)} >= 3) fails from ({FINDINGS}) group by category")
def fail_on_gate(spark, sf_dir):
    r = S.rank(F.col("severity"), S.SEVERITIES)
    return findings(spark, sf_dir).groupBy("category").agg(F.max(r).alias("worst"), F.bool_or(r >= 3).alias("fails"))


@query(f"select fid from ({FINDINGS}) where category in ('secret', 'sink', 'domain')")
def enabled_categories(spark, sf_dir):
    return findings(spark, sf_dir).filter(F.col("category").isin("secret", "sink", "domain")).select("fid")


RULE_NUMBERS = {"secret": "001", "endpoint": "002", "domain": "003", "flag": "004", "debug": "005", "sink": "006", "upload": "007"}
CUSTOM = "my.custom rule"


@query(f"select fid, case severity when 'critical' then 'error' when 'high' then 'error' when 'medium' then 'warning' else 'note' end level, case when rule_id <> '{CUSTOM}' then 'RULE' || {S.sql_case('category', RULE_NUMBERS, repr('002'))} else 'CUSTOM-' || trim(regexp_replace(upper(rule_id), '[^A-Z0-9._-]+', '-', 'g'), '-._') end rule from ({FINDINGS})")
def sarif_level(spark, sf_dir):
    level = S.pick(F.col("severity"), {"critical": "error", "high": "error", "medium": "warning"}, "note")
    custom = F.concat(F.lit("CUSTOM-"), F.btrim(F.regexp_replace(F.upper("rule_id"), "[^A-Z0-9._-]+", "-"), F.lit("-._")))
    rule = F.when(F.col("rule_id") != CUSTOM, F.concat(F.lit("RULE"), S.pick(F.col("category"), RULE_NUMBERS, "002"))).otherwise(custom)
    return findings(spark, sf_dir).select("fid", level.alias("level"), rule.alias("rule"))


@query(f"select fid, left(sha256(rule_id || '|' || file_url || '||' || line || '|' || col || '|' || value_type || '|' || value), 32) fingerprint from ({FINDINGS})")
def fingerprint(spark, sf_dir):
    key = F.concat_ws("|", "rule_id", "file_url", F.lit(""), "line", "col", "value_type", "value")
    return findings(spark, sf_dir).select("fid", F.substring(F.sha2(key, 256), 1, 32).alias("fingerprint"))


@query(f"select fid, left(sha256(value), 16) value_hash from ({FINDINGS})")
def value_hash(spark, sf_dir):
    return findings(spark, sf_dir).select("fid", F.substring(F.sha2("value", 256), 1, 16).alias("value_hash"))


@query(f"select fid, case when length(value) <= 8 then repeat('*', length(value)) else left(value, least(4, length(value) // 4)) || repeat('*', length(value) - 2 * least(4, length(value) // 4)) || right(value, least(4, length(value) // 4)) end masked from ({FINDINGS}) where category = 'secret'")
def mask_values(spark, sf_dir):
    return findings(spark, sf_dir).filter("category = 'secret'").select("fid", T.mask(F.col("value")).alias("masked"))


ORDER = ("file_url", "line", "col", "category", "rule_id", "severity", "confidence", "value", "value_type", "fid")


@query(f"select fid, file_url, r from (select fid, file_url, row_number() over (partition by file_url order by {', '.join(ORDER)})::int r from ({FINDINGS}))")
def finding_order(spark, sf_dir):
    """Findings in their total order, numbered within each file."""
    return findings(spark, sf_dir).select("fid", "file_url", F.row_number().over(W.partitionBy("file_url").orderBy(*ORDER)).alias("r"))


@query(f"select fid, score from {SCORED} order by score desc, fid limit 25 offset 50")
def page_slice(spark, sf_dir):
    """One page of a report: a top-k with an offset."""
    return scored(spark, sf_dir).orderBy(F.desc("score"), "fid").offset(50).limit(25).select("fid", "score")


@query(f"select fid from (select fid, row_number() over (partition by file_url, value order by {S.rank_sql('severity', S.SEVERITIES)} desc, {S.rank_sql('confidence', S.CONFIDENCES)} desc, fid) r from ({FINDINGS})) where r = 1")
def strongest_occurrence(spark, sf_dir):
    w = W.partitionBy("file_url", "value").orderBy(S.rank(F.col("severity"), S.SEVERITIES).desc(), S.rank(F.col("confidence"), S.CONFIDENCES).desc(), "fid")
    return findings(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r = 1").select("fid")


SIGNALS = "case when contains(file_url, 'chunk-1') then -0.5 else 0.0 end + case when value_type = 'generic_secret' then -1.0 else 0.0 end + case when regexp_matches(value, '^[0-9]') then -1.0 else 0.0 end + case when regexp_matches(value, '[a-f]{4}') then 1.0 else 0.0 end"


@query(f"select fid, signal::double signal, case when value_type in ('aws_access_key', 'github_pat') and signal < -0.3 then 'low' when signal < -0.3 then 'low' when signal > 0.3 then 'high' else confidence end confidence, value_type in ('aws_access_key', 'github_pat') or signal >= -1.5 kept from (select *, {SIGNALS} signal from ({FINDINGS}) where category = 'secret')")
def context_signals(spark, sf_dir):
    """Signals move the confidence; a known provider's secret is demoted, never dropped."""
    v = F.col("value")
    s = (
        F.when(F.contains("file_url", F.lit("chunk-1")), -0.5).otherwise(0.0)
        + F.when(F.col("value_type") == "generic_secret", -1.0).otherwise(0.0)
        + F.when(v.rlike("^[0-9]"), -1.0).otherwise(0.0)
        + F.when(v.rlike("[a-f]{4}"), 1.0).otherwise(0.0)
    )
    d = findings(spark, sf_dir).filter("category = 'secret'").withColumn("signal", s)
    known = F.col("value_type").isin("aws_access_key", "github_pat")
    return d.select("fid", "signal", F.when(F.col("signal") < -0.3, "low").when(F.col("signal") > 0.3, "high").otherwise(F.col("confidence")).alias("confidence"), (known | (F.col("signal") >= -1.5)).alias("kept"))


@query(f"select fid, case when category = 'secret' and contains(file_url, 'chunk-2') and confidence <> 'high' then 'secret-in-vendor' end reason from ({FINDINGS}) where category in ('secret', 'sink')")
def fp_annotation(spark, sf_dir):
    hit = (F.col("category") == "secret") & F.contains("file_url", F.lit("chunk-2")) & (F.col("confidence") != "high")
    return findings(spark, sf_dir).filter(F.col("category").isin("secret", "sink")).select("fid", F.when(hit, "secret-in-vendor").alias("reason"))


EXPLAIN_TYPE = {"aws_access_key": "rotate the key", "dom_attr_sink": "encode the value", "internal_domain": "hide internal names"}
EXPLAIN_CATEGORY = {"secret": "move it to the server", "endpoint": "check access control", "upload": "validate on the server"}


@query(f"select fid, coalesce({S.sql_case('value_type', EXPLAIN_TYPE, 'null')}, {S.sql_case('category', EXPLAIN_CATEGORY, 'null')}, 'review') fix from ({FINDINGS})")
def explain_fix(spark, sf_dir):
    """Advice by value type, else by category, else general: two lookups of fixed size."""
    t = spark.createDataFrame(list(EXPLAIN_TYPE.items()), "value_type string, by_type string")
    c = spark.createDataFrame(list(EXPLAIN_CATEGORY.items()), "category string, by_category string")
    d = findings(spark, sf_dir).join(F.broadcast(t), "value_type", "left").join(F.broadcast(c), "category", "left")
    return d.select("fid", F.coalesce("by_type", "by_category", F.lit("review")).alias("fix"))


@query("select p_brand, floor(median(p_retailprice) * 100 + 0.5)::bigint p50, floor(quantile_cont(p_retailprice, 0.95) * 100 + 0.25)::bigint p95, count(*) n from part group by p_brand")
def latency_percentiles(spark, sf_dir):
    """Interpolated percentiles, in hundredths (engines differ in a double's last digit)."""
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(F.floor(F.percentile("p_retailprice", 0.5) * 100 + 0.5).alias("p50"), F.floor(F.percentile("p_retailprice", 0.95) * 100 + 0.25).alias("p95"), F.count("*").alias("n"))


@query("select code, stage, sum(affected)::bigint affected, count(*) n, 'partial' status from (select case o_orderstatus when 'F' then 'parse' else 'fetch' end code, o_orderpriority stage, o_custkey % 5 affected from orders) group by code, stage")
def issue_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "parse").otherwise("fetch").alias("code"), F.col("o_orderpriority").alias("stage"), (F.col("o_custkey") % 5).alias("affected"))
    return o.groupBy("code", "stage").agg(F.sum("affected").alias("affected"), F.count("*").alias("n")).withColumn("status", F.lit("partial"))
