"""Predicates and orders over findings and URLs: addresses, credentials in URLs, parameters, paths, call chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import urls as U
from brindle.operators import graph as G
from brindle.plans.registry import query
from brindle.sources.tables import ENDPOINTS, FINDINGS, IMPORTS, OBSERVED, derived, endpoints, findings, table

HEX_IP = "select c_custkey, case c_custkey % 4 when 0 then cast(c_custkey * 7919 as string) when 1 then '0x' || lower(hex(c_custkey * 104729)) when 2 then '10.0.' || cast(c_custkey % 300 as string) || '.1' else '0177.0.0.' || cast(c_custkey % 8 as string) end host from customer"


@query(
    f"""select c_custkey, case when regexp_full_match(host, '[1-9][0-9]{{0,9}}') and host::bigint < 4294967296 then host::bigint
      when regexp_full_match(host, '0x[0-9a-f]{{1,8}}') then ('0x' || substr(host, 3))::bigint
      when regexp_full_match(host, '([0-9]{{1,4}}\\.){{3}}[0-9]{{1,4}}') then
        case when list_max(ps) <= 255 then ((ps[1] * 256 + ps[2]) * 256 + ps[3]) * 256 + ps[4] end end address
      from (select *, list_transform(string_split(host, '.'), lambda x: case when regexp_full_match(x, '0[0-7]+') then list_reduce(list_prepend(0::bigint, list_transform(string_split(x, ''), lambda d: try_cast(d as bigint))), lambda a, d: a * 8 + d) else try_cast(x as bigint) end) ps from ({HEX_IP}))"""
)
def ip_literals(spark, sf_dir):
    """IPv4 literals in decimal, hexadecimal and dotted form (parts with a leading zero are octal) as numbers; null if out of range."""
    return derived(spark, sf_dir, HEX_IP).select("c_custkey", U.ip_literal(F.col("host")).alias("address"))


@query(f"select fid, regexp_matches(value, '^([a-z]+:)?//[^/?#]*@') or len(list_filter(string_split(regexp_extract(value, '^[^?#]*'), '/'), lambda s: regexp_full_match(s, '[A-Za-z0-9]{{16,}}') and regexp_matches(s, '[0-9]') and regexp_matches(s, '[A-Za-z]'))) > 0 carries from ({ENDPOINTS})")
def url_credential(spark, sf_dir):
    """Whether a URL has user info, or a path segment of 16 or more letters and digits with both."""
    v = F.col("value")
    token = lambda s: s.rlike("^[A-Za-z0-9]{16,}$") & s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    found = F.exists(F.split(F.regexp_extract(v, "^[^?#]*", 0), "/"), token)
    return endpoints(spark, sf_dir).select("fid", (v.rlike("^([a-z]+:)?//[^/?#]*@") | found).alias("carries"))


@query("select page_id, name, case when regexp_matches(name, '(^|_)(uuid|guid)$') then 'uuid' when regexp_matches(name, 'email|mail$') then 'email' when regexp_matches(name, '(^|_)(id|num|page|count|limit|offset)$') then 'numeric' else 'dynamic' end kind from (select page_id, lower(split_part(kv, '=', 1)) as name from (select page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) kv from pages) where kv <> '')")
def param_name_type(spark, sf_dir):
    """The type that a parameter's name suggests."""
    kv = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&")).alias("kv")).filter("kv <> ''")
    n = kv.select("page_id", F.lower(F.split("kv", "=")[0]).alias("name"))
    c = F.col("name")
    kind = F.when(c.rlike("(^|_)(uuid|guid)$"), "uuid").when(c.rlike("email|mail$"), "email").when(c.rlike("(^|_)(id|num|page|count|limit|offset)$"), "numeric").otherwise("dynamic")
    return n.select("page_id", "name", kind.alias("kind"))


JOINED = "select 'o' || cast(o_orderkey as string) fid, case o_orderkey % 4 when 0 then 'https://api.example.com/' when 1 then 'https://api.example.com/v1' when 2 then '' else '/base//' end base, case o_custkey % 4 when 0 then '/users/' || cast(o_custkey as string) when 1 then 'items' when 2 then 'https://other.example.com/x' else '//cdn.example.com/y' end rel from orders"


@query(f"select fid, case when base = '' or regexp_matches(rel, '^([a-z]+:)?//') then rel else regexp_replace(base, '/+$', '') || '/' || regexp_replace(rel, '^/+', '') end as joined from ({JOINED})")
def join_base_path(spark, sf_dir):
    """A client's base and a call's path as one URL; absolute paths stand for themselves."""
    base, rel = F.col("base"), F.col("rel")
    whole = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(rel, "^/+", ""))
    return derived(spark, sf_dir, JOINED).select("fid", F.when((base == "") | rel.rlike("^([a-z]+:)?//"), rel).otherwise(whole).alias("joined"))


@query(f"select method, url, n, place::int place from (select *, row_number() over (order by n desc, url, method nulls first) place from (select method, url, count(*) n from ({OBSERVED}) group by all)) where place <= 100")
def busiest_requests(spark, sf_dir):
    """The hundred requests seen most often, ties by URL: a top-k."""
    from pyspark.sql import Window as W

    n = derived(spark, sf_dir, OBSERVED).groupBy("method", "url").agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("url"), F.asc_nulls_first("method")]
    return n.orderBy(*order).limit(100).withColumn("place", F.row_number().over(W.orderBy(*order)))


@query(f"select route, string_agg(distinct method, ',' order by method) methods, count(*) n from (select method, regexp_replace(regexp_extract(value, '^(?:(?:[a-zA-Z]+:)?//[^/?#]*)?([^?#]*)', 1), '[0-9]+', '#', 'g') route from ({ENDPOINTS})) group by route")
def contract_groups(spark, sf_dir):
    """Declared requests by path shape: distinct verbs and how many."""
    shape = F.regexp_replace(F.regexp_extract("value", "^(?:(?:[a-zA-Z]+:)?//[^/?#]*)?([^?#]*)", 1), "[0-9]+", "#")
    g = endpoints(spark, sf_dir).groupBy(shape.alias("route")).agg(F.array_sort(F.collect_set("method")).alias("m"), F.count("*").alias("n"))
    return g.select("route", F.array_join("m", ",").alias("methods"), "n")


CONTEXTS = "select distinct 'ctx' || cast(o_orderkey % 5 as string) ctx, 'https://app.example.com/js/mod' || cast(o_custkey % 60 as string) || '.js' file_url from orders where o_orderkey % 60 = o_custkey % 60"


@query(
    f"""with recursive c as ({CONTEXTS}), e as (select distinct file_url x, target_url y from ({IMPORTS})),
    walk(ctx, node, hops) as (select ctx, file_url, 0 from c union select ctx, y, hops + 1 from walk join e on node = x where hops < 4)
    select ctx, node, min(hops)::int hops from walk group by all"""
)
def load_context_imports(spark, sf_dir):
    """Files that a load context reaches by imports, four deep, with the least number of steps: one join a step, all contexts at once."""
    return G.reach(derived(spark, sf_dir, CONTEXTS), derived(spark, sf_dir, IMPORTS).select("file_url", "target_url"), 4)


@query(
    f"""with recursive c as ({CONTEXTS}), e as (select distinct file_url x, target_url y from ({IMPORTS})),
    walk(ctx, node, hops) as (select ctx, file_url, 0 from c union select ctx, y, hops + 1 from walk join e on node = x where hops < 2),
    near as (select ctx, node, min(hops) hops from walk group by all), f as (select *, regexp_extract(file_url, 'chunk-([0-9]+)', 1) chunk from ({FINDINGS}) where category = 'secret')
    select ctx, fid, hops::int hops from near join f on regexp_extract(node, 'mod([0-9]+)', 1) = chunk"""
)
def load_context_secrets(spark, sf_dir):
    """Secrets in files that a load context reaches within two imports."""
    near = G.reach(derived(spark, sf_dir, CONTEXTS), derived(spark, sf_dir, IMPORTS).select("file_url", "target_url"), 2)
    f = findings(spark, sf_dir).filter("category = 'secret'").select("fid", F.regexp_extract("file_url", "chunk-([0-9]+)", 1).alias("chunk"))
    return near.withColumn("chunk", F.regexp_extract("node", "mod([0-9]+)", 1)).join(f, "chunk").select("ctx", "fid", "hops")
