"""Tables and the finding-shaped views derived from them.

The derived views are plain SQL that Spark and DuckDB both run, so a query and its oracle start from the
same rows: orders become endpoint findings, suppliers secrets, parts sinks, flags, uploads and domains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ENDPOINTS = """
select 'o' || cast(o_orderkey as string) fid, 'endpoint-detector' rule_id, 'endpoint' category,
  case o_orderstatus when 'F' then 'info' when 'O' then 'low' else 'high' end severity,
  case o_orderkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end confidence,
  'api_endpoint' value_type,
  case o_orderkey % 9
    when 0 then '/api/v1/orders/' || cast(o_orderkey as string)
    when 1 then 'https://api' || cast(o_custkey % 3 as string) || '.example.com/v2/customers/' || cast(o_custkey as string) || '?page=' || cast(o_orderkey % 4 as string) || '&sort=asc'
    when 2 then '/rest/items/' || cast(o_custkey % 50 as string) || '/reviews#top'
    when 3 then '/users/$' || '{id}/profile'
    when 4 then 'HTTPS://Shop.Example.com:443/cart/' || md5(cast(o_custkey % 9 as string))
    when 5 then '/admin/users/' || cast(o_custkey % 13 as string)
    when 6 then '/uploads/' || substr(md5(cast(o_custkey % 7 as string)), 1, 8) || '-aaaa-bbbb-cccc-' || substr(md5(cast(o_custkey % 7 as string)), 1, 12)
    when 7 then 'http://shop.example.com:8080/billing/checkoutSession?token=' || cast(o_custkey % 5 as string) || '&next=%2Fhome'
    else '//cdn' || cast(o_custkey % 2 as string) || '.example.net/assets/app.' || cast(o_orderkey % 5 as string) || '.js'
  end value,
  case substr(o_orderpriority, 1, 1) when '1' then 'GET' when '2' then 'POST' when '3' then 'PUT' when '4' then 'DELETE' else 'PATCH' end method,
  'https://app' || cast(o_custkey % 5 as string) || '.example.com/static/js/chunk-' || cast(o_custkey % 31 as string) || '.js' file_url,
  cast(o_orderkey % 400 + 1 as int) line, cast(o_custkey % 80 as int) col, o_custkey % 2 = 0 first_party, cast(o_orderkey as bigint) ord
from orders"""

SECRETS = """
select 's' || cast(s_suppkey as string) fid, 'secret-detector' rule_id, 'secret' category,
  case s_suppkey % 3 when 0 then 'critical' when 1 then 'high' else 'medium' end severity,
  case s_nationkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end confidence,
  case s_nationkey % 4 when 0 then 'aws_access_key' when 1 then 'github_pat' when 2 then 'jwt_token' else 'generic_secret' end value_type,
  md5(s_name) value, cast(null as string) method,
  'https://app' || cast(s_suppkey % 5 as string) || '.example.com/static/js/chunk-' || cast(s_suppkey % 31 as string) || '.js' file_url,
  cast(s_suppkey % 400 + 1 as int) line, cast(s_nationkey % 80 as int) col, s_nationkey % 2 = 0 first_party, cast(s_suppkey as bigint) ord
from supplier"""

PARTS = """
select 'p' || cast(p_partkey as string) fid,
  case p_size % 4 when 0 then 'sink-detector' when 1 then 'flag-detector' when 2 then 'upload-detector' else 'my.custom rule' end rule_id,
  case p_size % 4 when 0 then 'sink' when 1 then 'flag' when 2 then 'upload' else 'domain' end category,
  case p_partkey % 5 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' else 'info' end severity,
  case p_size % 3 when 0 then 'high' when 1 then 'medium' else 'low' end confidence,
  case p_size % 4 when 0 then 'dom_attr_sink' when 1 then 'feature_flag' when 2 then 'file_upload' else 'internal_domain' end value_type,
  case p_size % 4 when 0 then 'img.src = ' || p_name when 1 then lower(p_type) || '_enabled' when 2 then '.' || p_brand
    else 'svc' || cast(p_partkey % 19 as string) || '.corp.internal' end value,
  cast(null as string) method,
  'https://app' || cast(p_partkey % 5 as string) || '.example.com/static/js/chunk-' || cast(p_partkey % 31 as string) || '.js' file_url,
  cast(p_partkey % 400 + 1 as int) line, cast(p_size % 80 as int) col, p_size % 2 = 0 first_party, cast(p_partkey as bigint) ord
from part"""

FINDINGS = f"{ENDPOINTS} union all {SECRETS} union all {PARTS}"

#: Requests seen at run time: method (null: unknown) and URL.
OBSERVED = """
select case event_type when 'view' then 'GET' when 'signup' then 'POST' when 'click' then null when 'purchase' then 'DELETE' else 'PUT' end method,
  case event_id % 6
    when 0 then '/api/v1/orders/' || cast(event_id as string)
    when 1 then 'https://api' || cast(user_id % 2 as string) || '.example.com/v2/customers/' || cast(event_id as string)
    when 2 then '/admin/users/' || cast(user_id as string)
    when 3 then 'https://app0.example.com/internal/jobs/' || cast(user_id % 4 as string)
    when 4 then 'https://shop.example.com:443/cart/0'
    else 'wss://live.example.com/feed/' || cast(user_id % 3 as string)
  end url
from events"""

#: Imports between files: a source file, what it imports, the target file's number.
IMPORTS = """
select distinct 'https://app.example.com/js/mod' || cast(l_partkey % 60 as string) || '.js' file_url,
  './mod' || cast((l_partkey % 60 + 1 + l_suppkey % 3) % 60 as string) source,
  'https://app.example.com/js/mod' || cast((l_partkey % 60 + 1 + l_suppkey % 3) % 60 as string) || '.js' target_url,
  l_suppkey % 3 = 1 is_dynamic
from lineitem"""

_TABLES = ("orders", "supplier", "part", "events", "lineitem", "customer")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived view; only the tables that it names are read."""
    for t in _TABLES:
        if f"from {t}" in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, FINDINGS)


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ENDPOINTS)
