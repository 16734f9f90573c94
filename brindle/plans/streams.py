"""Limits, windows, sessions and dedup over events, in batch form; the streaming forms are in brindle.streaming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.plans.registry import query
from brindle.sources.tables import table
from brindle.streaming import limits


@query("select event_id, epoch_us(ts) - lag(epoch_us(ts)) over w gap_us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over w >= 60000000, true) ok from events window w as (partition by user_id order by ts, event_id)")
def rate_limit_min_gap(spark, sf_dir):
    """Time since the user's event before, and whether it is a minute at least."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = us - F.lag(us).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", gap.alias("gap_us"), F.coalesce(gap >= 60_000_000, F.lit(True)).alias("ok"))


@query("select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3600000000 preceding and current row) n from events")
def rate_limit_sliding(spark, sf_dir):
    """Events of the user in the hour up to each."""
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("n"))


@query("""with recursive e as (select user_id, event_type = 'error' bad, row_number() over (partition by user_id order by ts, event_id) r from events),
  s(user_id, r, v) as (select distinct user_id, 0::bigint, 1.0::double from events union all select s.user_id, e.r, case when bad then least(60.0, v * 2.0) else greatest(1.0, v * 0.9) end from s join e on e.user_id = s.user_id and e.r = s.r + 1)
  select user_id, arg_max(v, r) as "interval", max(r) n from s group by user_id""")
def rate_limit_adaptive(spark, sf_dir):
    """The adaptive interval of each user after all events."""
    return limits.adaptive_batch(table(spark, sf_dir, "events"))


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n, sum(round(value * 100)::bigint)::bigint cents from events group by 1, 2")
def hourly_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "cents")


@query("""with g as (select user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 1800000000 then 0 else 1 end new from events),
  s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, min(ts) as start, count(*) n from s group by user_id, k""")
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("select user_id, event_type, min(event_id) first_id from events group by user_id, event_type")
def first_events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


@query("select event_id, (props->>'$.k')::bigint k from events")
def event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
