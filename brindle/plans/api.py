"""API reconstruction: routes, parameters, dormant and run-time endpoints, word lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import urls as U
from brindle.plans.pages import HOST, NETLOC, PATH, PORT, QUERY
from brindle.plans.registry import query
from brindle.sources.tables import ENDPOINTS, FINDINGS, OBSERVED, derived, endpoints, findings

T_ = r"regexp_replace(value, '\$\{[^}]*\}', '{param}', 'g')"
ABS = "regexp_matches(u, '^(https?:)?//')"
PARTS = f"""select *, case when {ABS} and {NETLOC} <> '' then {NETLOC} else '(relative)' end domain,
  case when {ABS} then case when {PATH} = '' then '/' else {PATH} end when starts_with(u, '/') then regexp_extract(u, '^([^?]*)', 1) else '/' || regexp_extract(u, '^([^?]*)', 1) end p,
  case when {ABS} then {QUERY} else regexp_extract(u, '^[^?]*\\?(.*)$', 1) end q
  from (select *, {T_} u from ({ENDPOINTS}))"""
ROUTE = """'/' || array_to_string(list_transform(list_filter(string_split(p, '/'), lambda s: s <> ''), lambda s:
  case when starts_with(s, '$') or (starts_with(s, '{') and ends_with(s, '}')) or regexp_matches(s, '^[0-9]+$') then '{id}'
  when regexp_matches(s, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') then '{uuid}'
  when regexp_matches(s, '^[0-9a-fA-F]{24,}$') then '{id}' when s = 'FUZZ' then '{param}' else s end), '/')"""
ROUTES = f"(select *, {ROUTE} route from ({PARTS}))"


def routed(spark, sf_dir):
    d, p, q = U.endpoint_parts(F.col("value"))
    return endpoints(spark, sf_dir).select("*", d.alias("domain"), p.alias("p"), q.alias("q")).withColumn("route", U.route(F.col("p")))


@query(f"select fid, domain, route, q from {ROUTES}")
def endpoint_parse(spark, sf_dir):
    return routed(spark, sf_dir).select("fid", "domain", "route", "q")


@query(f"select domain, route, string_agg(distinct method, ',' order by method) methods, count(*) n, array_to_string(list_sort(list(distinct file_url))[1:5], ' ') sources from {ROUTES} where route <> '/' group by domain, route")
def api_map_routes(spark, sf_dir):
    r = routed(spark, sf_dir).filter("route <> '/'").groupBy("domain", "route")
    return r.agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"), F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("file_url")), 1, 5), " ").alias("sources"))


@query(f"select domain, count(distinct route) total_endpoints from {ROUTES} where route <> '/' group by domain")
def api_map_totals(spark, sf_dir):
    return routed(spark, sf_dir).filter("route <> '/'").groupBy("domain").agg(F.countDistinct("route").alias("total_endpoints"))


@query(f"""select domain, prefix, depth, count(*) n from (select domain, unnest(range(1, len(s) + 1))::int depth, '/' || array_to_string(s[1:unnest(range(1, len(s) + 1))], '/') prefix
  from (select domain, list_filter(string_split(route, '/'), lambda x: x <> '') s from {ROUTES})) group by domain, prefix, depth""")
def api_map_tree(spark, sf_dir):
    """Every node of the route tree with the endpoints below it."""
    s = U.segments(F.col("route"))
    nodes = routed(spark, sf_dir).select("domain", s.alias("s")).select("domain", F.explode(F.transform("s", lambda x, i: F.struct((i + 1).alias("depth"), F.concat(F.lit("/"), F.array_join(F.slice("s", F.lit(1), i + 1), "/")).alias("prefix")))).alias("n"))
    return nodes.groupBy("domain", "n.prefix", "n.depth").agg(F.count("*").alias("n"))


@query(f"select domain, route, name, min(example) example, count(*) n from (select domain, route, split_part(kv, '=', 1) name, split_part(kv, '=', 2) example from (select domain, route, unnest(string_split(q, '&')) kv from {ROUTES} where q <> '') where kv <> '') group by domain, route, name")
def api_parameters(spark, sf_dir):
    kv = F.split("kv", "=")
    r = routed(spark, sf_dir).filter("q <> ''").select("domain", "route", F.explode(F.split("q", "&")).alias("kv")).filter("kv <> ''")
    return r.groupBy("domain", "route", kv[0].alias("name")).agg(F.min(F.coalesce(F.get(kv, 1), F.lit(""))).alias("example"), F.count("*").alias("n"))


NAME_TYPE = "case when contains(n, 'uuid') or contains(n, 'guid') then 'uuid' when contains(n, 'mail') then 'email' when ends_with(n, 'id') or contains(n, 'num') or contains(n, 'count') or contains(n, 'index') then 'numeric' else 'dynamic' end"
SEG_KIND = r"""case when regexp_matches(seg, '\$\{[^}]*\}') then 'template' when regexp_matches(seg, '^:[A-Za-z_]') then 'named'
  when regexp_matches(seg, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') then 'uuid' when regexp_matches(seg, '^[0-9a-fA-F]{24}$') then 'objectid'
  when regexp_matches(seg, '^[^@/]+@[^@/]+\.[^@/]+$') then 'email' when regexp_matches(seg, '^[0-9]+$') then 'numeric' end"""
SEGS = f"select fid, severity, unnest(string_split(ep, '/')) seg, generate_subscripts(string_split(ep, '/'), 1)::int - 1 pos from (select fid, severity, regexp_extract(regexp_replace(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', ''), '^([^?#]*)', 1) ep from (select fid, severity, value u from ({ENDPOINTS})))"


def _path_params(spark, sf_dir):
    seg = F.col("seg")
    kind = (
        F.when(seg.rlike(r"\$\{[^}]*\}"), "template")
        .when(seg.rlike("^:[A-Za-z_]"), "named")
        .when(seg.rlike(U.UUID), "uuid")
        .when(seg.rlike("^[0-9a-fA-F]{24}$"), "objectid")
        .when(seg.rlike(r"^[^@/]+@[^@/]+\.[^@/]+$"), "email")
        .when(seg.rlike("^[0-9]+$"), "numeric")
    )
    return endpoints(spark, sf_dir).select("fid", "severity", F.posexplode(F.split(U.path(F.col("value")), "/")).alias("pos", "seg")).withColumn("kind", kind).filter("kind is not null")


@query(f"select fid, pos, seg, kind from (select *, {SEG_KIND} kind from ({SEGS})) where kind is not null")
def path_params(spark, sf_dir):
    return _path_params(spark, sf_dir).select("fid", "pos", "seg", "kind")


@query(f"select fid, case min(case kind when 'uuid' then 1 when 'objectid' then 2 when 'email' then 3 when 'numeric' then 4 else 5 end) when 1 then 'uuid' when 2 then 'objectid' when 3 then 'email' when 4 then 'numeric' else 'dynamic' end inferred, min(case when severity = 'info' then 'low' else severity end) severity from (select *, {SEG_KIND} kind from ({SEGS})) where kind is not null group by fid")
def idor_candidates(spark, sf_dir):
    """Endpoints with id-like path segments: the strongest type, and info raised to low."""
    order = F.array(*map(F.lit, ("uuid", "objectid", "email", "numeric")))
    r = F.when(F.array_contains(order, F.col("kind")), F.array_position(order, F.col("kind"))).otherwise(5)
    g = _path_params(spark, sf_dir).groupBy("fid").agg(F.min(r).alias("r"), F.first("severity").alias("s"))
    return g.select("fid", F.coalesce(F.get(order, (F.col("r") - 1).cast("int")), F.lit("dynamic")).alias("inferred"), F.when(F.col("s") == "info", "low").otherwise(F.col("s")).alias("severity"))


VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


@query(f"select route, array_to_string(list_filter({list(VERBS)}, lambda v: not list_contains(seen, v)), ',') untried from (select route, list(distinct method) seen from {ROUTES} group by route)")
def method_flip(spark, sf_dir):
    """Verbs not seen on a path."""
    g = routed(spark, sf_dir).groupBy("route").agg(F.collect_set("method").alias("seen"))
    return g.select("route", F.array_join(F.array_except(F.array(*map(F.lit, VERBS)), "seen"), ",").alias("untried"))


DORM = r"""select *, case when regexp_matches(u, '^((https?|wss?):)?//') then lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) else '' end host,
  '/' || array_to_string(list_transform(list_filter(string_split(case when regexp_matches(u, '^((https?|wss?):)?//') then regexp_extract(regexp_replace(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', ''), '^([^?#]*)', 1) else regexp_extract(u, '^([^?#]*)', 1) end, '/'), lambda s: s <> ''),
  lambda s: case when regexp_matches(s, '^[${]') or s = 'FUZZ' or regexp_matches(s, '^[0-9]+$') or regexp_matches(s, '^[0-9a-fA-F]{24,}$') or regexp_matches(s, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') then '{id}' else s end), '/') np"""
DECL = f"(select fid, upper(coalesce(method, '')) m, host, np from ({DORM} from (select *, regexp_replace(trim(value), '\\$\\{{[^}}]*\\}}', '{{id}}', 'g') u from ({ENDPOINTS}))) where np <> '/')"
OBS = f"(select distinct upper(coalesce(method, '')) m, host, np from ({DORM} from (select *, regexp_replace(trim(url), '\\$\\{{[^}}]*\\}}', '{{id}}', 'g') u from ({OBSERVED}))))"
FIRST_PARTY = ("app0.example.com", "app1.example.com", "")


def _declared(spark, sf_dir):
    h, p = U.dormancy_parts(F.col("value"))
    return endpoints(spark, sf_dir).select("fid", F.upper(F.coalesce("method", F.lit(""))).alias("m"), h.alias("host"), p.alias("np")).filter("np <> '/'")


def _observed(spark, sf_dir):
    h, p = U.dormancy_parts(F.col("url"))
    return derived(spark, sf_dir, OBSERVED).select(F.upper(F.coalesce("method", F.lit(""))).alias("m"), h.alias("host"), p.alias("np")).distinct()


@query(
    f"""with d as {DECL}, o as {OBS} select fid, host, np, m method from d
    where (host = '' or host in (select host from o))
    and not exists (select 1 from o where o.np = d.np and (case when d.host = '' then o.host in {FIRST_PARTY} else o.host = d.host end)
      and (d.m in ('', 'GET') or o.m in ('', d.m)))"""
)
def dormant_endpoints(spark, sf_dir):
    """Declared but never requested. GET and unknown verbs match by path alone; others need their verb or an
    unknown one. Absolute endpoints count only if their host was met. Each case is its own equi anti-join."""
    d, o = _declared(spark, sf_dir), _observed(spark, sf_dir)
    hosts = o.filter("host <> ''").select("host").distinct()
    rel = d.filter("host = ''")
    abs_ = d.filter("host <> ''").join(hosts, "host", "left_semi")
    own = o.filter(F.col("host").isin(*FIRST_PARTY)).select("m", "np")
    loose = F.col("m").isin("", "GET")
    any_rel, any_abs = own.select("np").distinct(), o.select("host", "np").distinct()
    verb_rel, verb_abs = own.distinct(), o
    bare_rel, bare_abs = own.filter("m = ''").select("np").distinct(), o.filter("m = ''").select("host", "np").distinct()
    parts = [
        rel.filter(loose).join(any_rel, "np", "left_anti"),
        rel.filter(~loose).join(verb_rel, ["m", "np"], "left_anti").join(bare_rel, "np", "left_anti"),
        abs_.filter(loose).join(any_abs, ["host", "np"], "left_anti"),
        abs_.filter(~loose).join(verb_abs, ["host", "m", "np"], "left_anti").join(bare_abs, ["host", "np"], "left_anti"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("fid", "host", "np", F.col("m").alias("method"))


@query(
    f"""with d as (select case when m = '' then 'GET' else m end m, host, np from {DECL}), o as (select distinct case when m = '' then 'GET' else m end m, host, np from {OBS})
    select host, m method, np, case when regexp_matches(np, '(admin|internal|debug|manage|token|key|config)') then 'medium' else 'low' end severity from o
    where np <> '/' and host in {FIRST_PARTY} and not exists (select 1 from d where d.m = o.m and d.np = o.np and (d.host = '' or d.host = o.host))"""
)
def runtime_surface(spark, sf_dir):
    """First-party requests met at run time that no static finding has; a relative finding covers all hosts."""
    m = F.when(F.col("m") == "", "GET").otherwise(F.col("m"))
    d, o = _declared(spark, sf_dir).withColumn("m", m), _observed(spark, sf_dir).withColumn("m", m).distinct()
    o = o.filter((F.col("np") != "/") & F.col("host").isin(*FIRST_PARTY))
    left = o.join(d.filter("host = ''").select("m", "np").distinct(), ["m", "np"], "left_anti").join(d.filter("host <> ''").select("host", "m", "np").distinct(), ["host", "m", "np"], "left_anti")
    return left.select("host", F.col("m").alias("method"), "np", F.when(F.col("np").rlike("(admin|internal|debug|manage|token|key|config)"), "medium").otherwise("low").alias("severity"))


@query(f"select m method, host, count(*) n from {OBS} group by m, host")
def observed_index(spark, sf_dir):
    return _observed(spark, sf_dir).groupBy(F.col("m").alias("method"), "host").agg(F.count("*").alias("n"))


W_ABS = "regexp_matches(u, '^(https?:)?//')"
W_FUZZ = r"regexp_replace({}, '\$\{{[^}}]*\}}', 'FUZZ', 'g')"
W_IN = f"(select value u from ({ENDPOINTS}))"
WL_ENDPOINTS = f"""select {W_FUZZ.format(PATH)} w from {W_IN} where {W_ABS} and {PATH} not in ('', '/')
  union select case when {PATH} = '' then '/' else {PATH} end || '?' || {QUERY} from {W_IN} where {W_ABS} and {QUERY} <> ''
  union select {W_FUZZ.format('u')} from {W_IN} where not {W_ABS} and starts_with(u, '/')
  union select w from (select regexp_extract({W_FUZZ.format('u')}, '^([^?]*)', 1) w from {W_IN} where not {W_ABS} and starts_with(u, '/') and contains(u, '?')) where w not in ('', '/')"""
BARE = f"case when {W_ABS} then {PATH} else regexp_extract(u, '^([^?]*)', 1) end"
ASSETS = "js css html map json xml png jpg svg ico woff woff2 ttf eot".split()
SEG_LIST = f"(select list_filter(string_split({BARE}, '/'), lambda s: s <> '') s from {W_IN} where {BARE} not in ('', '/'))"
UNTIL = "s[1:coalesce(list_position(list_transform(s, lambda x: contains(x, '{')), true), len(s) + 1) - 1]"
WL_PATHS = f"""select w from (select unnest(s) w from {SEG_LIST}) where not contains(w, '{{') and not regexp_matches(w, '^[0-9]+$') and not regexp_matches(w, '\\.({'|'.join(ASSETS)})$')
  union select '/' || array_to_string(t[1:unnest(range(1, len(t) + 1))], '/') from (select {UNTIL} t from {SEG_LIST})"""
WL_PARAMS = f"select distinct split_part(kv, '=', 1) w from (select unnest(string_split(q, '&')) kv from (select {QUERY} q from {W_IN}) where q <> '') where contains(kv, '=') and split_part(kv, '=', 2) <> ''"
WL_DOMAINS = f"""select {HOST} w from {W_IN} where {W_ABS} and {HOST} <> '' union select {HOST} || ':' || {PORT} from {W_IN} where {W_ABS} and {PORT} <> ''
  union select lower(value) from ({FINDINGS}) where category = 'domain'"""
WL_DIRS = f"""with d as (select '/' || array_to_string(t[1:unnest(range(1, len(t) + 1))], '/') w from (select {UNTIL} t from (select s from (select list_filter(string_split({BARE}, '/'), lambda s: s <> '') s from {W_IN} where starts_with({BARE}, '/'))))) select w from d union select ltrim(w, '/') from d"""


def _bare(v):
    return F.when(v.rlike("^(https?:)?//"), U.path(v)).otherwise(F.regexp_extract(v, "^([^?]*)", 1))


def _prefixes(s):
    """Progressive prefixes of a list of segments, up to the first placeholder."""
    stop = F.array_position(F.transform(s, lambda x: F.contains(x, F.lit("{"))), True)
    n = F.when(stop > 0, stop - 1).otherwise(F.size(s)).cast("int")
    return F.transform(F.filter(F.transform(s, lambda x, i: i + 1), lambda i: i <= n), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(s, F.lit(1), i), "/")))


def endpoint_words(v):
    """Paths with placeholders as FUZZ, with and without their query."""
    fuzz = lambda c: U.templates_to(c, "FUZZ")
    abs_ = v.rlike("^(https?:)?//")
    p, q = U.path(v), U.url_query(v)
    bare = F.regexp_extract(fuzz(v), "^([^?]*)", 1)
    rel = ~abs_ & v.startswith("/")
    return F.array_compact(
        F.array(
            F.when(abs_ & ~p.isin("", "/"), fuzz(p)),
            F.when(abs_ & (q != ""), F.concat(F.when(p == "", "/").otherwise(p), F.lit("?"), q)),
            F.when(rel, fuzz(v)),
            F.when(rel & F.contains(v, F.lit("?")) & ~bare.isin("", "/"), bare),
        )
    )


def path_words(v):
    """Segments that are no ids, placeholders or files, and progressive prefixes."""
    s = U.segments(_bare(v))
    asset = rf"\.({'|'.join(ASSETS)})$"
    own = F.filter(s, lambda x: ~F.contains(x, F.lit("{")) & ~x.rlike("^[0-9]+$") & ~x.rlike(asset))
    return F.concat(own, _prefixes(s))


def param_words(v):
    kv = F.filter(F.split(U.url_query(v), "&"), lambda x: x.rlike("^[^=]*=[^=]"))
    return F.transform(kv, lambda x: F.split(x, "=")[0])


def domain_words(v):
    h, p = U.host(v), U.port(v)
    abs_ = v.rlike("^(https?:)?//")
    return F.array_compact(F.array(F.when(abs_ & (h != ""), h), F.when(abs_ & (p != ""), F.concat(h, F.lit(":"), p))))


def dir_words(v):
    below = _prefixes(U.segments(_bare(v)))
    both = F.concat(below, F.transform(below, lambda x: F.ltrim(x, F.lit("/"))))
    return F.when(_bare(v).startswith("/"), both).otherwise(F.array().cast("array<string>"))


def _words(spark, sf_dir, *lists):
    """Distinct words of the lists: one pass over the endpoints and one shuffle, whatever the number of lists."""
    v = F.col("value")
    return endpoints(spark, sf_dir).select(F.explode(F.array_distinct(F.concat(*(f(v) for f in lists)))).alias("w")).distinct()


def _named_domains(spark, sf_dir):
    return findings(spark, sf_dir).filter("category = 'domain'").select(F.lower("value").alias("w"))


@query(WL_ENDPOINTS)
def wordlist_endpoints(spark, sf_dir):
    return _words(spark, sf_dir, endpoint_words)


@query(WL_PATHS)
def wordlist_paths(spark, sf_dir):
    return _words(spark, sf_dir, path_words)


@query(WL_PARAMS)
def wordlist_params(spark, sf_dir):
    return _words(spark, sf_dir, param_words)


@query(WL_DOMAINS)
def wordlist_domains(spark, sf_dir):
    return _words(spark, sf_dir, domain_words).union(_named_domains(spark, sf_dir)).distinct()


@query(WL_DIRS)
def wordlist_dirs(spark, sf_dir):
    return _words(spark, sf_dir, dir_words)


@query(f"select w from ({WL_ENDPOINTS}) union select w from ({WL_PATHS}) union select w from ({WL_PARAMS}) union select w from ({WL_DOMAINS}) union select w from ({WL_DIRS})")
def wordlist_all(spark, sf_dir):
    all_ = _words(spark, sf_dir, endpoint_words, path_words, param_words, domain_words, dir_words)
    return all_.union(_named_domains(spark, sf_dir)).distinct()


@query(f"select fid, case when regexp_matches(lower(q), '(^|&)(token|access_token|api_key|apikey|auth|key)=') then 'apikey' when method in ('PUT', 'DELETE') then 'bearer' else 'none' end auth, case when regexp_matches(lower(q), '(^|&)(token|access_token|api_key|apikey|auth|key)=') then 'query' when method in ('PUT', 'DELETE') then 'header' else '' end place from (select fid, method, {QUERY} q from (select *, value u from ({ENDPOINTS})))")
def contract_auth(spark, sf_dir):
    """Kind and place of an endpoint's credentials, before anything is redacted."""
    in_query = F.lower(U.url_query(F.col("value"))).rlike("(^|&)(token|access_token|api_key|apikey|auth|key)=")
    header = F.col("method").isin("PUT", "DELETE")
    return endpoints(spark, sf_dir).select("fid", F.when(in_query, "apikey").when(header, "bearer").otherwise("none").alias("auth"), F.when(in_query, "query").when(header, "header").otherwise("").alias("place"))


STATIC = r"\.(js|css|png|jpg|svg|woff2?)$"


@query(f"select fid, regexp_matches(lower({PATH}), '{STATIC}') is_static, regexp_matches({PATH}, '^/(uploads|files|download|export)(/|$)') is_download from (select fid, value u from ({ENDPOINTS}))")
def static_and_download(spark, sf_dir):
    p = U.path(F.col("value"))
    return endpoints(spark, sf_dir).select("fid", F.lower(p).rlike(STATIC).alias("is_static"), p.rlike("^/(uploads|files|download|export)(/|$)").alias("is_download"))
