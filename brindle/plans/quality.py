"""Label and prediction quality: matching, precision and recall, Wilson bounds, gates, regressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.plans.registry import query
from brindle.sources.tables import table

#: A prediction: a long document is of good quality.
PAIRS = "select l.doc_id, l.quality = 1 label, d.n_chars > 1000 guess, d.lang, l.toxic from labels l join documents d using (doc_id)"
COUNTS = f"select lang, count(*) filter (label and guess) tp, count(*) filter (not label and guess) fp, count(*) filter (label and not guess) fn, count(*) filter (not label and not guess) tn from ({PAIRS}) group by lang"


def _pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 1000).alias("guess"))
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("label"), "toxic").join(d, "doc_id")


def _counts(spark, sf_dir):
    n = lambda c: F.count(F.when(c, 1))
    a, b = F.col("label"), F.col("guess")
    return _pairs(spark, sf_dir).groupBy("lang").agg(n(a & b).alias("tp"), n(~a & b).alias("fp"), n(a & ~b).alias("fn"), n(~a & ~b).alias("tn"))


@query(f"select lang, tp, fp, fn, tn, case when tp + fp > 0 then tp / (tp + fp) end as prec, case when tp + fn > 0 then tp / (tp + fn) end as rec, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) end f1 from ({COUNTS})")
def prf_metrics(spark, sf_dir):
    """Precision, recall and F1; null where the denominator is zero."""
    c = _counts(spark, sf_dir)
    ratio = lambda x, y: F.when(y > 0, x / y)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", ratio(tp, tp + fp).alias("prec"), ratio(tp, tp + fn).alias("rec"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


Z = 1.959963984540054


@query(f"select lang, case when n > 0 then (p + {Z * Z} / (2 * n) - {Z} * sqrt((p * (1 - p) + {Z * Z} / (4 * n)) / n)) / (1 + {Z * Z} / n) end lower from (select lang, (tp + fp)::double n, tp / (tp + fp) p from ({COUNTS}))")
def wilson_lower(spark, sf_dir):
    c = _counts(spark, sf_dir).withColumn("n", (F.col("tp") + F.col("fp")).cast("double"))
    n, p = F.col("n"), F.try_divide("tp", "n")
    low = (p + Z * Z / (2 * n) - Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    return c.select("lang", F.when(n > 0, low).alias("lower"))


@query(f"select lang, tp + fn >= 5 and tp / greatest(tp + fp, 1) >= 0.7 passed, tp + fn >= 5 enough from ({COUNTS})")
def gate_evaluation(spark, sf_dir):
    enough = F.col("tp") + F.col("fn") >= 5
    return _counts(spark, sf_dir).select("lang", (enough & (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)) >= 0.7)).alias("passed"), enough.alias("enough"))


EXPECTED = "select l_orderkey % 200 case_id, 'v' || cast(l_partkey % 9 as string) v, l_linenumber k from lineitem where l_orderkey % 2 = 0"
PREDICTED = "select l_orderkey % 200 case_id, 'v' || cast(l_suppkey % 9 as string) v, l_linenumber k from lineitem where l_orderkey % 2 = 1"


@query(f"select case_id + 0 as case_id, v, least(a, b) matched, a - least(a, b) missed, b - least(a, b) extra from (select coalesce(x.case_id, y.case_id + 0 * 1) case_id, coalesce(x.v, y.v) v, coalesce(x.n, 0) a, coalesce(y.n, 0) b from (select case_id // 4 case_id, v, count(*) n from ({EXPECTED}) group by all) x full join (select case_id // 4 case_id, v, count(*) n from ({PREDICTED}) group by all) y on x.case_id = y.case_id and x.v = y.v)")
def label_matching(spark, sf_dir):
    """Maximum matching of labels and predictions with equal keys: per key as many as the smaller side has."""
    t = table(spark, sf_dir, "lineitem")
    side = lambda mod, c, name: t.filter(F.col("l_orderkey") % 2 == mod).groupBy(F.expr("l_orderkey % 200 div 4").alias("case_id"), F.concat(F.lit("v"), (F.col(c) % 9).cast("string")).alias("v")).agg(F.count("*").alias(name))
    m = side(0, "l_partkey", "a").join(side(1, "l_suppkey", "b"), ["case_id", "v"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return m.select("case_id", "v", F.least(a, b).alias("matched"), (a - F.least(a, b)).alias("missed"), (b - F.least(a, b)).alias("extra"))


@query(f"with n as ({COUNTS}), o as (select lang, tp - (tp % 3) tp, fp from n where lang <> 'es') select coalesce(n.lang, o.lang) lang, coalesce(n.tp, 0) - coalesce(o.tp, 0) d_tp, n.fp > o.fp worse from n full join o on n.lang = o.lang")
def baseline_compare(spark, sf_dir):
    n = _counts(spark, sf_dir)
    o = n.filter("lang <> 'es'").select("lang", (F.col("tp") - F.col("tp") % 3).alias("tp0"), F.col("fp").alias("fp0"))
    return n.join(o, "lang", "full").select("lang", (F.coalesce("tp", F.lit(0)) - F.coalesce("tp0", F.lit(0))).alias("d_tp"), (F.col("fp") > F.col("fp0")).alias("worse"))


@query(f"select lang, label, guess, count(*) n, sum(toxic)::bigint toxic from ({PAIRS}) group by lang, label, guess")
def confusion(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("lang", "label", "guess").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))


@query("select r.r_name region, sum(round(o.o_totalprice * 100)::bigint)::bigint cents, count(distinct c.c_custkey) customers from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by r.r_name")
def region_totals(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    dim = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(dim, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("r_name").alias("region")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.countDistinct("c_custkey").alias("customers"))


@query("select p_brand, p_partkey, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) r from part) where r <= 3")
def top_by_group(spark, sf_dir):
    """Three per group: the rank filter prunes before the shuffle."""
    w = W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("p_brand", "p_partkey", "p_retailprice")
