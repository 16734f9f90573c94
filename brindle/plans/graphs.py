"""The correlation graph: edges, closures, caps, clusters and chains."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions import scores as S
from brindle.functions import urls as U
from brindle.operators import graph as G
from brindle.plans.pages import ORIGIN
from brindle.plans.registry import query
from brindle.sources.tables import ENDPOINTS, FINDINGS, IMPORTS, derived, endpoints, findings

RANK = S.rank_sql("severity", S.SEVERITIES)
KEY = "line, col, category, rule_id, severity, confidence, value, value_type, fid"
SAME_FILE = f"""with r as (select fid, file_url, row_number() over (partition by file_url order by {RANK} desc, {KEY}) i from ({FINDINGS}))
  select file_url, a, b, number from (select a.file_url, a.fid a, b.fid b, row_number() over (partition by a.file_url order by a.i, b.i) number from r a join r b on a.file_url = b.file_url and a.i < b.i) where number <= 50"""


def _same_file(spark, sf_dir):
    order = [S.rank(F.col("severity"), S.SEVERITIES).desc(), *KEY.split(", ")]
    return G.first_pairs(findings(spark, sf_dir), "file_url", order, 50)


@query(SAME_FILE)
def same_file_edges(spark, sf_dir):
    """The first fifty pairs of each file, most severe first."""
    return _same_file(spark, sf_dir)


CONFIG = f"""with r as (select fid, origin, row_number() over (partition by origin order by file_url, {KEY}) i from (select *, {ORIGIN} origin from (select *, value u from ({ENDPOINTS}))) where origin <> '')
  select origin, a, b, number from (select a.origin, a.fid a, b.fid b, row_number() over (partition by a.origin order by a.i, b.i) number from r a join r b on a.origin = b.origin and a.i < b.i and a.i <= 31 and b.i <= 31) where number <= 30"""


@query(CONFIG)
def config_edges(spark, sf_dir):
    """The first thirty pairs of each origin."""
    e = endpoints(spark, sf_dir).withColumn("origin", U.origin(F.col("value"))).filter("origin <> ''")
    return G.first_pairs(e, "origin", ["file_url", *KEY.split(", ")], 30)


@query(f"""with f as (select * from ({FINDINGS})) select s.fid source, e.fid target, s.confidence, abs(s.line - e.line)::int gap from f s join f e on s.file_url = e.file_url and s.category = 'secret' and e.category = 'endpoint' and abs(s.line - e.line) < 20""")
def secret_endpoint_edges(spark, sf_dir):
    """Secrets and endpoints of one file within twenty lines: a band join on (file, block of lines), not on the file alone."""
    f = findings(spark, sf_dir)
    s = f.filter("category = 'secret'").select(F.col("fid").alias("source"), "file_url", "confidence", F.col("line").alias("l"), F.explode(F.expr("array(line div 20 - 1, line div 20, line div 20 + 1)")).alias("block"))
    e = f.filter("category = 'endpoint'").select(F.col("fid").alias("target"), "file_url", F.col("line").alias("r"), F.expr("line div 20").alias("block"))
    return s.join(e, ["file_url", "block"]).filter("abs(l - r) < 20").select("source", "target", "confidence", F.abs(F.col("l") - F.col("r")).alias("gap"))


def _imports(spark, sf_dir):
    return derived(spark, sf_dir, IMPORTS)


@query(f"select file_url, target_url, source, case when is_dynamic then 'dynamic:' || source else source end reasoning from ({IMPORTS})")
def import_edges(spark, sf_dir):
    """Imports resolved against file aliases (path without suffix); an alias that names several files gives no edge."""
    i = _imports(spark, sf_dir)
    files = i.select("file_url").union(i.select("target_url")).distinct().withColumn("alias", F.regexp_extract("file_url", r"/js/([^/]+)\.js$", 1))
    one = files.groupBy("alias").agg(F.min("file_url").alias("found"), F.count("*").alias("n")).filter("n = 1")
    named = i.withColumn("alias", F.regexp_replace("source", r"^\./", ""))
    label = F.when(F.col("is_dynamic"), F.concat(F.lit("dynamic:"), "source")).otherwise(F.col("source"))
    return named.join(one, "alias").select("file_url", F.col("found").alias("target_url"), "source", label.alias("reasoning"))


WALK = f"""with recursive e as (select distinct file_url x, target_url y from ({IMPORTS})),
  walk(src, dst, hops) as (select x, y, 1 from e where x <> y union select src, y, hops + 1 from walk join e on dst = x where hops < {{depth}} and y <> src)
  select src, dst, min(hops)::int hops from walk group by src, dst"""


@query(WALK.format(depth=4))
def import_closure(spark, sf_dir):
    return G.closure(_imports(spark, sf_dir), "file_url", "target_url", 4)


@query(f"select src, dst, hops from ({WALK.format(depth=5)}) where hops >= 2")
def transitive_imports(spark, sf_dir):
    return G.closure(_imports(spark, sf_dir), "file_url", "target_url", 5).filter("hops >= 2")


PATHS = f"""with recursive e as (select distinct file_url x, target_url y from ({IMPORTS})),
  walk(src, dst, path) as (select x, y, [x, y] from e where x <> y union all select src, y, list_append(path, y) from walk join e on dst = x where len(path) < 4 and not list_contains(path, y))
  select src, dst, array_to_string(path, ' > ') path from (select *, row_number() over (partition by src, dst order by len(path), path) r from walk) where r <= 3"""


@query(PATHS)
def shortest_chains(spark, sf_dir):
    """Up to three shortest import chains to each target."""
    return G.chains(_imports(spark, sf_dir), "file_url", "target_url", 3).select("src", "dst", F.array_join("path", " > ").alias("path"))


CONTEXT = f"select *, 'ctx' || cast(ord % 6 as string) ctx from ({FINDINGS})"


@query(
    f"""with f as ({CONTEXT}), r as (select fid, ctx, file_url, row_number() over (partition by ctx order by file_url, {KEY}) i from f),
    pairs as (select a.ctx, a.fid source, b.fid target, row_number() over (partition by a.ctx order by a.i, b.i) turn from r a join r b on a.ctx = b.ctx and a.file_url < b.file_url)
    select source, target, ctx, turn::int turn from (select *, row_number() over (order by turn, ctx) place from pairs where turn <= 50) where place <= 50"""
)
def runtime_edges(spark, sf_dir):
    """Pairs of findings of different files that load together, fifty in turns over the contexts."""
    pairs = G.first_pairs_across(derived(spark, sf_dir, CONTEXT), "ctx", "file_url", KEY.split(", "), 50)
    top = G.fair_cap(pairs, "ctx", ["number"], 50)
    return top.select(F.col("a").alias("source"), F.col("b").alias("target"), "ctx", F.col("turn").cast("int").alias("turn"))


CALLS = "select distinct l_orderkey % 40 file_no, 'f' || cast(l_partkey % 12 as string) caller, 'f' || cast(l_suppkey % 12 as string) callee from lineitem"


@query(f"""with recursive e as (select distinct file_no || ':' || caller x, file_no || ':' || callee y from ({CALLS})),
  walk(src, dst, hops) as (select x, y, 1 from e where x <> y union select src, y, hops + 1 from walk join e on dst = x where hops < 5 and y <> src) select src, dst, min(hops)::int hops from walk group by src, dst""")
def call_graph_closure(spark, sf_dir):
    """Scopes that a scope reaches by calls inside its file, five deep."""
    e = derived(spark, sf_dir, CALLS).select(F.concat_ws(":", "file_no", "caller").alias("x"), F.concat_ws(":", "file_no", "callee").alias("y"))
    return G.closure(e, "x", "y", 5)


@query(f"select file_url, a, b, turn::int turn, place::int place from (select *, row_number() over (order by turn, file_url) place from (select *, number turn from ({SAME_FILE})) where turn <= 50) where place <= 50")
def fair_cap(spark, sf_dir):
    """Fifty edges in turns over the files."""
    return G.fair_cap(_same_file(spark, sf_dir), "file_url", ["number"], 50).select("file_url", "a", "b", "turn", "place")


EDGES = f"select a source, b target, 'same_file' edge_type, file_url reasoning from ({SAME_FILE}) union all select b, a, 'same_file', file_url from ({SAME_FILE}) where number <= 10 union all select a, b, 'import', 'x' from ({SAME_FILE}) where number <= 5 union all select b, a, 'import', 'x' from ({SAME_FILE}) where number <= 5"


def _edges(spark, sf_dir):
    s = _same_file(spark, sf_dir)
    e = lambda a, b, t, r: s.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(t).alias("edge_type"), r.alias("reasoning"), "number")
    file, x = F.col("file_url"), F.lit("x")
    out = e("a", "b", "same_file", file).union(e("b", "a", "same_file", file).filter("number <= 10"))
    return out.union(e("a", "b", "import", x).filter("number <= 5")).union(e("b", "a", "import", x).filter("number <= 5")).drop("number")


@query(f"select distinct case when edge_type = 'same_file' then least(source, target) else source end source, case when edge_type = 'same_file' then greatest(source, target) else target end target, edge_type, reasoning from ({EDGES})")
def edge_dedup(spark, sf_dir):
    return G.dedup_edges(_edges(spark, sf_dir))


@query(f"select fid, string_agg(distinct other, ',' order by other) others from (select source fid, target other from ({EDGES}) union all select target, source from ({EDGES})) where fid <> other group by fid")
def neighbors(spark, sf_dir):
    return G.neighbours(_edges(spark, sf_dir)).select("fid", F.array_join("others", ",").alias("others"))


@query(f"select edge_type, count(*) attempts, count(distinct (case when edge_type = 'same_file' then least(source, target) else source end, case when edge_type = 'same_file' then greatest(source, target) else target end, reasoning)) emitted from ({EDGES}) group by edge_type")
def graph_telemetry(spark, sf_dir):
    e = _edges(spark, sf_dir)
    n = e.groupBy("edge_type").agg(F.count("*").alias("attempts"))
    return n.join(G.dedup_edges(e).groupBy("edge_type").agg(F.count("*").alias("emitted")), "edge_type")


@query(f"select file_url, greatest(n * (n - 1) // 2 - 50, 0)::bigint truncated from (select file_url, count(*) n from ({FINDINGS}) group by file_url)")
def truncated_pairs(spark, sf_dir):
    n = findings(spark, sf_dir).groupBy("file_url").agg(F.count("*").alias("n"))
    return n.select("file_url", F.greatest(F.expr("n * (n - 1) div 2 - 50"), F.lit(0)).alias("truncated"))


@query(f"""with f as (select * from ({FINDINGS})), src as (select file_url, fid, category, row_number() over (partition by file_url order by case category when 'upload' then 0 else 1 end, {KEY}) r from f where category = 'upload' or (category = 'endpoint' and contains(lower(value), 'upload')))
  select src.fid source, k.fid target, src.category source_category from f k join src on k.file_url = src.file_url and r = 1 where k.category = 'sink' and k.value_type = 'dom_attr_sink' and contains(k.value, 'img')""")
def upload_sink_edges(spark, sf_dir):
    """One representative upload source a file (an upload surface before an upload endpoint) to each of its image sinks."""
    f = findings(spark, sf_dir)
    up = f.filter((F.col("category") == "upload") | ((F.col("category") == "endpoint") & F.contains(F.lower("value"), F.lit("upload"))))
    w = W.partitionBy("file_url").orderBy(F.when(F.col("category") == "upload", 0).otherwise(1), *KEY.split(", "))
    src = up.withColumn("r", F.row_number().over(w)).filter("r = 1").select("file_url", F.col("fid").alias("source"), F.col("category").alias("source_category"))
    sinks = f.filter((F.col("value_type") == "dom_attr_sink") & F.contains("value", F.lit("img"))).select("file_url", F.col("fid").alias("target"))
    return sinks.join(src, "file_url").select("source", "target", "source_category")


@query(f"""with f as (select * from ({FINDINGS})), n as (select file_url, count(*) filter (category = 'sink') sinks, count(*) filter (category = 'upload') uploads, count(*) filter (category = 'endpoint') eps, count(*) filter (category = 'secret') secrets, max({RANK})::int worst from f group by file_url)
  select file_url, sinks, uploads, eps, secrets, worst from n where sinks > 0 and eps > 0""")
def attack_chains(spark, sf_dir):
    """Files whose findings can chain, from one aggregate a file."""
    n = lambda c: F.count(F.when(F.col("category") == c, 1))
    g = findings(spark, sf_dir).groupBy("file_url").agg(n("sink").alias("sinks"), n("upload").alias("uploads"), n("endpoint").alias("eps"), n("secret").alias("secrets"), F.max(S.rank(F.col("severity"), S.SEVERITIES)).alias("worst"))
    return g.filter("sinks > 0 and eps > 0")


@query(f"with s as (select * from ({FINDINGS}) where category = 'secret') select e.fid from ({ENDPOINTS}) e where not exists (select 1 from s where s.file_url = e.file_url)")
def files_without_secret(spark, sf_dir):
    f = findings(spark, sf_dir)
    return f.filter("category = 'endpoint'").join(f.filter("category = 'secret'").select("file_url").distinct(), "file_url", "left_anti").select("fid")


RANGES = "select l_orderkey % 50 file_no, l_orderkey || '-' || l_linenumber fn, cast(l_partkey % 300 as int) lo, cast(l_partkey % 300 + 3 + l_suppkey % 40 as int) hi from lineitem"
POINTS = "select o_orderkey % 50 file_no, o_orderkey, cast(o_custkey % 340 as int) line from orders"


@query(
    f"""with p as (select distinct file_no, line from ({POINTS})),
    best as (select p.file_no, p.line, arg_min(fn, (hi - lo, lo, fn)) fn from p join ({RANGES}) r on p.file_no = r.file_no and p.line between lo and hi group by all)
    select o_orderkey, fn from ({POINTS}) x join best on x.file_no = best.file_no and x.line = best.line"""
)
def enclosing_scope(spark, sf_dir):
    """The innermost function range that holds a line: distinct lines meet the ranges in blocks, the least width of each is
    aggregated, and findings join their line's."""
    points = derived(spark, sf_dir, POINTS)
    r = derived(spark, sf_dir, RANGES).withColumn("block", F.explode(F.expr("sequence(lo div 32, hi div 32)")))
    p = points.select("file_no", "line").distinct().withColumn("block", F.expr("line div 32"))
    hit = p.join(r, ["file_no", "block"]).filter("line between lo and hi")
    best = hit.groupBy("file_no", "line").agg(F.min_by("fn", F.struct(F.col("hi") - F.col("lo"), "lo", "fn")).alias("fn"))
    return points.join(best, ["file_no", "line"]).select("o_orderkey", "fn")


@query(f"select p.o_orderkey, max(lo)::int mapped from ({POINTS}) p join ({RANGES}) r on p.file_no = r.file_no and r.lo <= p.line group by p.o_orderkey union all select o_orderkey, null from ({POINTS}) p where not exists (select 1 from ({RANGES}) r where p.file_no = r.file_no and r.lo <= p.line)")
def line_map_asof(spark, sf_dir):
    """The latest mapped line at or before each line, by one ordered union a file."""
    r = derived(spark, sf_dir, RANGES).select("file_no", F.col("lo").alias("line"), F.col("lo").alias("mapped"))
    return G.asof(derived(spark, sf_dir, POINTS), r, "file_no", "line", "mapped").select("o_orderkey", "mapped")


@query(f"with g as (select fid, file_url, line, value from ({FINDINGS}) where category in ('flag', 'sink')) select e.fid, count(g.fid) guards from ({ENDPOINTS}) e left join g on e.file_url = g.file_url and g.line <= e.line and e.line <= g.line + 4 group by e.fid")
def guard_interval_join(spark, sf_dir):
    """Guards whose five lines hold an endpoint."""
    f = findings(spark, sf_dir)
    g = f.filter("category in ('flag', 'sink')").select("file_url", F.col("fid").alias("g"), F.explode(F.sequence(F.col("line"), F.col("line") + 4)).alias("line"))
    e = f.filter("category = 'endpoint'").select("fid", "file_url", "line")
    return e.join(g, ["file_url", "line"], "left").groupBy("fid").agg(F.count("g").alias("guards"))
