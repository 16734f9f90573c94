"""Script detectors, checked by generator duality: sources are built from rows, and the oracle computes the
expected findings from the rows alone. Decoys in comments and strings must not match."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.operators.scripts import read_sources
from brindle.functions import vlq as V
from brindle.plans.registry import query
from brindle.sources.tables import ENDPOINTS, derived, endpoints

LINES = """select 'bundle-' || cast(o_custkey % 40 as string) || '.js' file_url, o_orderkey k, o_orderkey % 13 shape,
  cast(o_orderkey as string) n from orders"""

SHAPES = [
    "concat('fetch(\"/api/orders/', n, '\", {method: \"DELETE\", headers: {a: \"b\"}});')",
    "concat('axios.post(', char(39), '/v2/items/', n, char(39), ', body);')",
    "concat('// fetch(\"/api/commented/', n, '\")')",
    "concat('const s', n, ' = \"fetch(/api/string/', n, ')\";')",
    "concat('el.innerHTML = location.hash + x', n, ';')",
    "concat('debugger; console.log(\"token\", t', n, ');')",
    "concat('client.variation(\"checkout_', n, '_enabled\", false);')",
    "concat('const r', n, ' = {path: \"/route/', n, '\", component: C};')",
    "concat('new WebSocket(`wss://live.example.com/', n, '`);')",
    "concat('import(/* webpackChunkName: \"chunk-', n, '\" */ \"./pages/p', n, '.js\");')",
    "concat('/* el.outerHTML = y; */ el.outerHTML = y', n, ';')",
    "concat('const b', n, ' = \"/base/', n, '\"; fetch(b', n, ' + \"/x\");')",
    "concat('x = a / b / c; y = /fetch(\"q', n, '\")/g; el.innerHTML = \"static\";')",
]
NUMBERED = f"(select *, row_number() over (partition by file_url order by k)::int line from ({LINES}))"


def _rows(spark, sf_dir):
    line = F.coalesce(*(F.when(F.col("shape") == i, F.expr(s)) for i, s in enumerate(SHAPES)))
    src = derived(spark, sf_dir, LINES).groupBy("file_url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("t")))), lambda x: x["t"]), "\n").alias("source"))
    return read_sources(src)


def _kind(name: str, value_types: tuple[str, ...], sql: str, method: bool = False):
    cols = ["file_url", "value", "line", *(["method"] if method else [])]

    def run(spark, sf_dir):
        return _rows(spark, sf_dir).filter(F.col("value_type").isin(*value_types)).select(*cols)

    run.__name__ = name
    return query(sql)(run)


js_http_calls = _kind(
    "js_http_calls",
    ("api_endpoint",),
    f"select file_url, case shape when 0 then '/api/orders/' || n when 1 then '/v2/items/' || n else '/base/' || n || '/x' end as value, line, case shape when 0 then 'DELETE' when 1 then 'POST' else 'GET' end as method from {NUMBERED} where shape in (0, 1, 11)",
    method=True,
)
js_html_sinks = _kind("js_html_sinks", ("dom_html_sink",), f"select file_url, case shape when 4 then 'el.innerHTML' else 'el.outerHTML' end as value, line from {NUMBERED} where shape in (4, 10)")
js_taint_confirmed = _kind("js_taint_confirmed", ("taint_flow",), f"select file_url, 'location.hash' as value, line, 'confirmed' as method from {NUMBERED} where shape = 4", method=True)
js_debug = _kind("js_debug", ("debugger_statement", "console_sensitive"), f"select file_url, unnest(['debugger', 'console.log']) as value, line from {NUMBERED} where shape = 5")
js_flags = _kind("js_flags", ("feature_flag",), f"select file_url, 'checkout_' || n || '_enabled' as value, line from {NUMBERED} where shape = 6")
js_routes = _kind("js_routes", ("client_route",), f"select file_url, '/route/' || n as value, line from {NUMBERED} where shape = 7")
js_websockets = _kind("js_websockets", ("websocket_url",), f"select file_url, 'wss://live.example.com/' || n as value, line from {NUMBERED} where shape = 8")
js_chunks = _kind("js_chunks", ("webpack_named_chunk",), f"select file_url, 'chunk-' || n as value, line from {NUMBERED} where shape = 9")

LITERALS = f"""select file_url, line, unnest(case shape when 0 then ['/api/orders/' || n, 'DELETE', 'b'] when 1 then ['/v2/items/' || n] when 3 then ['fetch(/api/string/' || n || ')']
  when 5 then ['token'] when 6 then ['checkout_' || n || '_enabled'] when 7 then ['/route/' || n] when 8 then ['wss://live.example.com/' || n] when 9 then ['./pages/p' || n || '.js']
  when 11 then ['/base/' || n, '/x'] when 12 then ['static'] else []::varchar[] end) as value from {NUMBERED}"""
js_literals = _kind("js_literals", ("string", "template"), LITERALS)


@query(f"select value, count(*) n, count(distinct file_url) files from ({LITERALS}) group by value")
def js_string_table(spark, sf_dir):
    lit = _rows(spark, sf_dir).filter("category = 'literal'")
    return lit.groupBy("value").agg(F.count("*").alias("n"), F.countDistinct("file_url").alias("files"))


@query(f"""select category, count(*) n from (select 'endpoint' category from {NUMBERED} where shape in (0, 1, 7, 8, 11) union all select 'sink' from {NUMBERED} where shape in (4, 10) union all select 'sink' from {NUMBERED} where shape = 4
  union all select 'debug' from {NUMBERED} where shape = 5 union all select 'debug' from {NUMBERED} where shape = 5 union all select 'flag' from {NUMBERED} where shape = 6 union all select 'chunk' from {NUMBERED} where shape = 9) group by category""")
def js_findings_by_category(spark, sf_dir):
    return _rows(spark, sf_dir).filter("category <> 'literal'").groupBy("category").agg(F.count("*").alias("n"))


VLQ_ROWS = "select l_orderkey map_id, l_linenumber seg, cast(max(l_partkey) % 3000 as int) d_col, cast(max(l_suppkey) % 1000 - 400 as int) d_line from lineitem group by l_orderkey, l_linenumber"


@query(f"select map_id, seg, (sum(d_col) over w)::int gen_col, (sum(d_line) over w)::int src_line from ({VLQ_ROWS}) window w as (partition by map_id order by seg)")
def vlq_decode(spark, sf_dir):
    """Mapping segments: encoded to base-64 digits, decoded, and summed along the line."""
    enc = derived(spark, sf_dir, VLQ_ROWS).select("map_id", "seg", F.concat(V.encoded(F.col("d_col")), V.encoded(F.col("d_line"))).alias("text"))
    dec = enc.select("map_id", "seg", V.numbers(F.col("text")).alias("x"))
    w = W.partitionBy("map_id").orderBy("seg").rowsBetween(W.unboundedPreceding, 0)
    return dec.select("map_id", "seg", F.sum(F.col("x")[0]).over(w).cast("int").alias("gen_col"), F.sum(F.col("x")[1]).over(w).cast("int").alias("src_line"))


RULES = [
    {"id": "bulk", "field": "value", "contains": "/orders/", "method": ["DELETE", "PUT"], "severity": "high"},
    {"id": "session", "field": "value", "regex": "(?i)session|login", "severity": "medium"},
    {"id": "relative", "field": "value", "not_regex": "^(https?:)?//", "any_method": ["GET"], "severity": "low"},
]


def compile_rule(rule: dict):
    """A declarative rule as a Column predicate."""
    c = F.col(rule["field"])
    out = F.lit(True)
    if "contains" in rule:
        out &= F.contains(c, F.lit(rule["contains"]))
    if "regex" in rule:
        out &= c.rlike(rule["regex"])
    if "not_regex" in rule:
        out &= ~c.rlike(rule["not_regex"])
    for key in ("method", "any_method"):
        if key in rule:
            out &= F.col("method").isin(*rule[key])
    return out


@query(
    f"with f as (select * from ({ENDPOINTS})) select fid, 'bulk' rule, 'high' severity from f where contains(value, '/orders/') and method in ('DELETE', 'PUT') union all select fid, 'session', 'medium' from f where regexp_matches(value, '(?i)session|login') union all select fid, 'relative', 'low' from f where not regexp_matches(value, '^(https?:)?//') and method in ('GET')"
)
def custom_rules(spark, sf_dir):
    """Declarative rules compiled to predicates: all rules in one pass over the findings."""

    hits = F.array(*(F.when(compile_rule(r), F.struct(F.lit(r["id"]).alias("rule"), F.lit(r["severity"]).alias("severity"))) for r in RULES))
    return endpoints(spark, sf_dir).select("fid", F.explode(F.array_compact(hits)).alias("h")).select("fid", "h.rule", "h.severity")
