"""Pages and URLs: links, inline scripts, normal forms, scope, clusters by origin and prefix."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions import urls as U
from brindle.plans.registry import query
from brindle.sources.tables import ENDPOINTS, endpoints, table

# The URL parts in SQL for the oracles.
HAS_HOST = "regexp_matches(lower(u), '^(https?:)?//')"
NETLOC = "regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
HOST = f"lower(regexp_replace(regexp_replace({NETLOC}, '^.*@', ''), ':[0-9]*$', ''))"
PATH = "regexp_extract(regexp_replace(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', ''), '^([^?#]*)', 1)"
SCHEME = "lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
PORT = f"regexp_extract({NETLOC}, ':([0-9]+)$', 1)"
QUERY = r"regexp_extract(u, '^[^?#]*\?([^#]*)', 1)"


def _links(spark, sf_dir):
    links = F.expr(r"regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(links).alias("pos", "href"))


LINKS = """select page_id, url, unnest(hrefs) href, generate_subscripts(hrefs, 1) - 1 pos
  from (select page_id, url, regexp_extract_all(html, '<a href="([^"]+)"', 1) hrefs from pages)"""


@query(f"select page_id, pos::int pos, href from ({LINKS})")
def page_links(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", "href")


@query(
    f"""select page_id, pos::int pos, {SCHEME} || '://' || {NETLOC} || case when starts_with(href, '/') then href else '/' || href end target
    from (select page_id, pos, href, url u from ({LINKS}))"""
)
def link_targets(spark, sf_dir):
    u = F.col("url")
    rel = F.when(F.col("href").startswith("/"), F.col("href")).otherwise(F.concat(F.lit("/"), F.col("href")))
    return _links(spark, sf_dir).select("page_id", "pos", F.concat(U.scheme(u), F.lit("://"), U.netloc(u), rel).alias("target"))


SCRIPTS = """select page_id, url, unnest(bodies) body, generate_subscripts(bodies, 1) - 1 pos
  from (select page_id, url, regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1) bodies from pages)"""


def _scripts(spark, sf_dir):
    bodies = F.expr("regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(bodies).alias("pos", "body"))


@query(f"select page_id, pos::int pos, body, length(body)::int size from ({SCRIPTS})")
def inline_scripts(spark, sf_dir):
    return _scripts(spark, sf_dir).select("page_id", "pos", "body", F.length("body").alias("size"))


@query(f"select page_id, url || case when contains(url, '?') then '&' else '?' end || '__inline=' || pos || '&__inline_hash=' || left(sha1(body), 8) asset_url from ({SCRIPTS})")
def inline_asset_url(spark, sf_dir):
    mark = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    return _scripts(spark, sf_dir).select(
        "page_id", F.concat("url", mark, F.lit("__inline="), F.col("pos").cast("string"), F.lit("&__inline_hash="), F.substring(F.sha1("body"), 1, 8)).alias("asset_url")
    )


@query("select page_id, regexp_matches(lower(left(html, 4096)), '^\\s*<(!doctype html|html|head|body)') is_html from pages")
def html_sniff(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.substring("html", 1, 4096)).rlike(r"^\s*<(!doctype html|html|head|body)").alias("is_html"))


DEDUP = f"""{SCHEME} || '://' || case when {SCHEME} = 'http' then regexp_replace(lower({NETLOC}), ':80$', '')
  when {SCHEME} = 'https' then regexp_replace(lower({NETLOC}), ':443$', '') else lower({NETLOC}) end
  || regexp_replace({PATH}, '/+$', '') || case when {QUERY} <> '' then '?' || {QUERY} else '' end"""


@query(f"select page_id, {DEDUP} key from (select page_id, url u from pages)")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.dedup_key(F.col("url")).alias("key"))


@query(f"select key, min(page_id) first_page, count(*) n from (select page_id, {DEDUP} key from (select page_id, url u from pages)) group by key")
def url_dedup(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.dedup_key(F.col("url")).alias("key")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


def prefix_sql(p: str) -> str:
    known = f"regexp_extract({p}, '^(/(?:api|v[0-9]+|rest|graphql)[^/]*)', 1)"
    return f"case when {known} <> '' then {known} else regexp_extract({p}, '^(/[a-zA-Z0-9_-]+)', 1) end"


PREFIX = prefix_sql("p")
PREFIX_PATH = f"case when {HAS_HOST} then case when {PATH} = '' then '/' else {PATH} end else u end"


@query(f"select prefix, count(*) n, min(page_id) first_page from (select page_id, {PREFIX} prefix from (select page_id, {PREFIX_PATH} p from (select page_id, href u from ({LINKS})))) where prefix <> '' group by prefix having count(*) >= 2")
def prefix_cluster(spark, sf_dir):
    links = _links(spark, sf_dir).select("page_id", U.api_prefix(F.col("href")).alias("prefix")).filter("prefix <> ''")
    return links.groupBy("prefix").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).filter("n >= 2")


ORIGIN = f"""case when {HAS_HOST} and {HOST} <> '' then case when {SCHEME} <> '' then {SCHEME} || ':' else '' end || '//' || regexp_replace({HOST}, '\\.+$', '')
  || case when {PORT} <> '' and not ({SCHEME} = 'http' and {PORT} = '80') and not ({SCHEME} = 'https' and {PORT} = '443') then ':' || {PORT} else '' end else '' end"""


@query(f"select origin, count(*) n, string_agg(fid, ',' order by fid) members from (select fid, {ORIGIN} origin from (select fid, value u from ({ENDPOINTS}))) where origin <> '' group by origin having count(*) >= 2")
def origin_cluster(spark, sf_dir):
    e = endpoints(spark, sf_dir).select("fid", U.origin(F.col("value")).alias("origin")).filter("origin <> ''")
    return e.groupBy("origin").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("fid")), ",").alias("members")).filter("n >= 2")


#: Keyword sets of functional areas, in order of precedence (fixed values).
AREAS = {
    "auth": ["auth", "authenticate", "authentication", "authorization", "login", "logout", "oauth", "session", "sessions", "token", "tokens"],
    "user": ["user", "users", "profile", "profiles", "account", "accounts", "member", "members"],
    "admin": ["admin", "admins", "manage", "management", "dashboard", "internal"],
    "payment": ["payment", "payments", "checkout", "billing", "subscription", "subscriptions", "stripe"],
    "upload": ["upload", "uploads", "file", "files", "media", "image", "images", "attachment", "attachments"],
    "notification": ["notification", "notifications", "email", "emails", "sms", "push", "alert", "alerts"],
    "api": ["graphql", "rest", "rpc"],
}


def area_tokens(value):
    """Lower-case words of a value's path, query and fragment, decoded and split at camel humps."""
    rest = F.when(U.has_host(value), F.regexp_replace(value, U.AUTHORITY, "")).otherwise(value)
    humps = F.regexp_replace(F.try_url_decode(F.regexp_replace(rest, r"\+", "%2B")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.transform(F.regexp_extract_all(humps, F.lit("([A-Za-z0-9]+)"), F.lit(1)), F.lower)


def area(value):
    tokens = area_tokens(value)
    out = F.lit(None).cast("string")
    for name, words in reversed(AREAS.items()):
        out = F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), name).otherwise(out)
    return out


AREA_SQL = (
    "case "
    + " ".join(f"when list_has_any(tokens, [{', '.join(repr(w) for w in ws)}]) then '{n}'" for n, ws in AREAS.items())
    + " end"
)
TOKENS_SQL = f"""list_transform(regexp_extract_all(regexp_replace(url_decode(case when {HAS_HOST} then regexp_replace(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', '') else u end),
  '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x))"""


@query(f"select area, count(*) n, min(fid) first_id from (select fid, {AREA_SQL} area from (select fid, {TOKENS_SQL} tokens from (select fid, value u from ({ENDPOINTS})))) where area is not null group by area having count(*) >= 2")
def functionality_cluster(spark, sf_dir):
    e = endpoints(spark, sf_dir).select("fid", area(F.col("value")).alias("area")).filter("area is not null")
    return e.groupBy("area").agg(F.count("*").alias("n"), F.min("fid").alias("first_id")).filter("n >= 2")


@query(
    f"""with e as (select fid, {ORIGIN} origin, {prefix_sql('pp')} prefix, {AREA_SQL} area from (select fid, u, {TOKENS_SQL} tokens, {PREFIX_PATH} pp from (select fid, value u from ({ENDPOINTS})))),
    c as (select 'base_url:' || origin cluster, fid, 1 rank from e where origin <> '' union all select 'prefix:' || prefix, fid, 2 from e where prefix <> '' union all select 'func:' || area, fid, 3 from e where area is not null),
    big as (select cluster from c group by cluster having count(*) >= 2)
    select fid, arg_min(cluster, rank) cluster from c join big using (cluster) group by fid"""
)
def first_cluster_assignment(spark, sf_dir):
    """The first cluster of each endpoint: by origin, then prefix, then area; clusters have two members at least."""
    v = F.col("value")
    e = endpoints(spark, sf_dir).select("fid", U.origin(v).alias("o"), U.api_prefix(v).alias("p"), area(v).alias("a"))
    c = e.select(
        "fid",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("rank"), F.when(F.col("o") != "", F.concat(F.lit("base_url:"), "o")).alias("cluster")),
                F.struct(F.lit(2).alias("rank"), F.when(F.col("p") != "", F.concat(F.lit("prefix:"), "p")).alias("cluster")),
                F.struct(F.lit(3).alias("rank"), F.concat(F.lit("func:"), "a").alias("cluster")),
            )
        ).alias("c"),
    ).select("fid", "c.*").filter("cluster is not null")
    big = c.groupBy("cluster").count().filter("count >= 2").select("cluster")
    return c.join(big, "cluster").groupBy("fid").agg(F.min_by("cluster", "rank").alias("cluster"))


JS_PATTERNS = (r"\.(js|mjs|cjs|jsx)$", r"/static/js/[^/]+\.js", r"/_next/static/chunks/[^/]+\.js", r"\.(chunk|bundle)\.(js|mjs|cjs)$", r"/(chunk|bundle)[-.][a-z0-9_.-]*\.(js|mjs|cjs)$", r"/assets/.*\.[a-f0-9]+\.js")


JS_SQL = " or ".join(f"regexp_matches(lower({PATH}), '{p}')" for p in JS_PATTERNS)


@query(f"select fid, {JS_SQL} is_js from (select fid, value u from ({ENDPOINTS}))")
def js_url_predicate(spark, sf_dir):
    p = F.lower(U.path(F.col("value")))
    hit = F.lit(False)
    for x in JS_PATTERNS:
        hit |= p.rlike(x)
    return endpoints(spark, sf_dir).select("fid", hit.alias("is_js"))


@query(f"select fid, case when regexp_matches(lower({PATH}), '\\.(ts|mts|cts)$') then 'ts' when ends_with(lower({PATH}), '.tsx') then 'tsx' when ends_with(lower({PATH}), '.jsx') then 'jsx' else 'js' end hint from (select fid, file_url u from ({ENDPOINTS}))")
def language_hint(spark, sf_dir):
    p = F.lower(U.path(F.col("file_url")))
    return endpoints(spark, sf_dir).select("fid", F.when(p.rlike(r"\.(ts|mts|cts)$"), "ts").when(p.endswith(".tsx"), "tsx").when(p.endswith(".jsx"), "jsx").otherwise("js").alias("hint"))


ALLOWED, DENIED, CDN = ["*.example.com"], ["api1.*.com"], ["*cdn*.example.net", "*.cloudfront.net"]


@query(
    rf"""select fid, case when regexp_matches(h, '(?i)^[a-zA-Z0-9._:-]*\.example\.com$') then 'first_party'
      when regexp_matches(h, '(?i)^[a-zA-Z0-9._:-]*cdn[a-zA-Z0-9_:-]*\.example\.net$') or regexp_matches(h, '(?i)^[a-zA-Z0-9._:-]*\.cloudfront\.net$') then 'cdn' else 'third_party' end tag
    from (select fid, {HOST} h from (select fid, value u from ({ENDPOINTS})))"""
)
def scope_tag(spark, sf_dir):
    h = U.host(F.col("value"))
    return endpoints(spark, sf_dir).select("fid", F.when(U.matches_any(h, ALLOWED), "first_party").when(U.matches_any(h, CDN), "cdn").otherwise("third_party").alias("tag"))


@query(
    rf"""select fid, h <> '' and not regexp_matches(h, '(?i)^api1\.[a-zA-Z0-9_:-]*\.com$') and not (p = '/billing' or starts_with(p, '/billing/'))
      and (regexp_matches(h, '(?i)^[a-zA-Z0-9._:-]*\.example\.com$') and (p = '/v2' or starts_with(p, '/v2/') or p = '/cart' or starts_with(p, '/cart/'))) allowed
    from (select fid, {HOST} h, {PATH} p from (select fid, value u from ({ENDPOINTS})))"""
)
def scope_allowed(spark, sf_dir):
    """Deny wins, then host, then path at a segment's edge; third parties are skipped."""
    h, p = U.host(F.col("value")), U.path(F.col("value"))
    under = lambda x: (p == x) | p.startswith(x + "/")
    ok = (h != "") & ~U.matches_any(h, DENIED) & ~under("/billing") & U.matches_any(h, ALLOWED) & (under("/v2") | under("/cart"))
    return endpoints(spark, sf_dir).select("fid", ok.alias("allowed"))


#: IPv4 ranges that requests must not reach (fixed values), and those of them that are merely private.
BLOCKED = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32"]
PRIVATE = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10"]


def _ranges():
    nets = [ipaddress.ip_network(x) for x in BLOCKED]
    return [(str(n), int(n.network_address), int(n.broadcast_address), str(n) in PRIVATE) for n in nets]


IPS = "select c_custkey, case c_custkey % 6 when 0 then '10' when 1 then '172' when 2 then '192' when 3 then '169' when 4 then '8' else '224' end || '.' || case c_custkey % 4 when 0 then '168' when 1 then '254' when 2 then '20' else '300' end || '.' || cast(c_custkey % 251 as string) || '.' || cast(c_custkey % 13 as string) ip from customer"
IP_SQL = "case when p[1] <= 255 and p[2] <= 255 and p[3] <= 255 and p[4] <= 255 then ((p[1] * 256 + p[2]) * 256 + p[3]) * 256 + p[4] end"


@query(
    f"""with ips as (select c_custkey, ip, {IP_SQL} n from (select c_custkey, ip, list_transform(string_split(ip, '.'), lambda x: x::bigint) p from ({IPS}))),
    r as (select * from (values {', '.join(f"('{c}', {a}::bigint, {b}::bigint, {str(p).lower()})" for c, a, b, p in _ranges())}) r(cidr, lo, hi, private))
    select c_custkey, ip, min(cidr) cidr, bool_or(cidr is not null) blocked, bool_or(cidr is not null and not private) blocked_with_private from ips left join r on n between lo and hi group by c_custkey, ip"""
)
def ssrf_range_join(spark, sf_dir):
    """Addresses against blocked ranges: a range join with a table of fixed size."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    ips = spark.sql(IPS).withColumn("n", U.ip_number(F.col("ip")))
    r = spark.createDataFrame(_ranges(), "cidr string, lo long, hi long, private boolean")
    hit = ips.join(F.broadcast(r), F.col("n").between(F.col("lo"), F.col("hi")), "left")
    got = F.col("cidr").isNotNull()
    return hit.groupBy("c_custkey", "ip").agg(F.min("cidr").alias("cidr"), F.bool_or(got).alias("blocked"), F.bool_or(got & ~F.coalesce("private", F.lit(False))).alias("blocked_with_private"))


@query(
    f"""with recursive nodes as (select href node, min(page_id) page from ({LINKS}) group by href),
    edges as (select distinct a.href src, b.href dst from ({LINKS}) a join ({LINKS}) b on a.page_id = b.page_id and b.pos = a.pos + 1),
    seeds as (select min(href) node from ({LINKS})),
    walk(node, depth) as (select node, 0 from seeds union select dst, depth + 1 from walk join edges on src = node where depth < 3)
    select node, min(depth)::int depth from walk group by node"""
)
def crawl_bfs(spark, sf_dir):
    """Pages reached from the first link within three steps, each with its least depth; visited pages are left out by an anti-join."""
    links = _links(spark, sf_dir)
    edges = links.alias("a").join(links.alias("b"), F.expr("a.page_id = b.page_id and b.pos = a.pos + 1")).select(F.col("a.href").alias("src"), F.col("b.href").alias("dst")).distinct()
    seen = front = links.agg(F.min("href").alias("node")).withColumn("depth", F.lit(0))
    for d in range(1, 4):
        front = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


@query(f"select host, count(*) n, count(distinct p) paths from (select {HOST} host, {PATH} p from (select url u from pages)) group by host")
def host_counts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").groupBy(U.host(u).alias("host")).agg(F.count("*").alias("n"), F.countDistinct(U.path(u)).alias("paths"))


@query(f"select page_id, k, v from (select page_id, split_part(kv, '=', 1) k, split_part(kv, '=', 2) v from (select page_id, unnest(string_split({QUERY}, '&')) kv from (select page_id, url u from pages)) where kv <> '')")
def url_parameters(spark, sf_dir):
    kv = F.split("kv", "=")
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split(U.url_query(F.col("url")), "&")).alias("kv")).filter("kv <> ''")
    return p.select("page_id", kv[0].alias("k"), F.coalesce(F.get(kv, 1), F.lit("")).alias("v"))


@query(rf"select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^([a-z]+://)[^/@]*@', '\1'), '#.*$', ''), '=[^&]*', '=REDACTED', 'g') safe from pages")
def uri_redaction(spark, sf_dir):
    u = F.regexp_replace(F.regexp_replace("url", "^([a-z]+://)[^/@]*@", "$1"), "#.*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(u, "=[^&]*", "=REDACTED").alias("safe"))


@query("select page_id, url, provenance, n from (select min(page_id) page_id, url, string_agg(page_id::varchar, ',' order by page_id) provenance, count(*) n from pages group by url)")
def ref_coalesce(spark, sf_dir):
    """One row per URL with where it was met."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), ids.alias("provenance"), F.count("*").alias("n")).select("page_id", "url", "provenance", "n")


@query("select page_id, url, r::int r from (select page_id, url, row_number() over (order by case when contains(url, '?') then 1 else 0 end, url, page_id) r from pages) where r <= 100")
def ref_order_limit(spark, sf_dir):
    """The first hundred references, plain URLs before those with a query: a top-k."""
    top = table(spark, sf_dir, "pages").select("page_id", "url").orderBy(F.contains("url", F.lit("?")).cast("int"), "url", "page_id").limit(100)
    return top.withColumn("r", F.row_number().over(W.orderBy(F.contains("url", F.lit("?")).cast("int"), "url", "page_id")))
