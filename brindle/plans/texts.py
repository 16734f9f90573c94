"""Text operators over documents and string tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions import texts as T
from brindle.functions import urls as U
from brindle.plans.registry import query
from brindle.sources.tables import ENDPOINTS, FINDINGS, PARTS, derived, endpoints, findings, table

SECRET = r"""(password|secret|token|api_key) *[:=] *["']?([A-Za-z0-9+/_.=-]{8,128})"""
SECRETS_SQL = rf"""select doc_id, generate_subscripts(v, 1) - 1 pos, unnest(v) v from (select doc_id, regexp_extract_all(text, '{SECRET.replace("'", "''")}', 2) v from documents where contains(lower(text), 'token') or contains(lower(text), 'secret') or contains(lower(text), 'password') or contains(lower(text), 'api_key'))"""


def _assigned(spark, sf_dir):
    """Assigned values; a literal keyword must be there before the pattern is tried."""
    low = F.lower("text")
    near = F.contains(low, F.lit("token")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("password")) | F.contains(low, F.lit("api_key"))
    hit = F.regexp_extract_all(F.col("text"), F.lit(SECRET), F.lit(2))
    return table(spark, sf_dir, "documents").filter(near).select("doc_id", F.posexplode(hit).alias("pos", "v"))


@query(f"select doc_id, pos::int pos, sha256(v) value_hash, length(v)::int size from ({SECRETS_SQL})")
def secret_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir).select("doc_id", "pos", F.sha2("v", 256).alias("value_hash"), F.length("v").alias("size"))


@query(
    f"""select doc_id, pos::int pos, h::bigint h, case when h >= 3500 then 'secret' else 'low' end verdict from (
    select doc_id, pos, floor(-list_sum(list_transform(list_sort(list_distinct(string_split(v, ''))), lambda c: len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v)::double * log2(len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v)::double))) * 1000 + 0.5) h
    from ({SECRETS_SQL}))"""
)
def secret_entropy(spark, sf_dir):
    h = T.entropy_milli(F.col("v"))
    return _assigned(spark, sf_dir).select("doc_id", "pos", h.alias("h"), F.when(h >= 3500, "secret").otherwise("low").alias("verdict"))


@query(f"""select doc_id, pos::int pos, case when length(v) <= 8 then repeat('*', length(v)) else left(v, least(4, length(v) // 4)) || repeat('*', length(v) - 2 * least(4, length(v) // 4)) || right(v, least(4, length(v) // 4)) end masked from ({SECRETS_SQL})""")
def secret_mask(spark, sf_dir):
    return _assigned(spark, sf_dir).select("doc_id", "pos", T.mask(F.col("v")).alias("masked"))


def _redact_sql(v: str) -> str:
    for t in T.TOKENS:
        v = f"regexp_replace({v}, '{t}', '[REDACTED]', 'g')"
    return v


@query(f"select doc_id, md5({_redact_sql('text')}) safe_md5, {_redact_sql('text')} <> text changed from documents")
def text_redact(spark, sf_dir):
    safe = T.redact(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(safe.cast("binary")).alias("safe_md5"), (safe != F.col("text")).alias("changed"))


IP = r"(?:^|[^0-9A-Za-z_.])([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?:$|[^0-9A-Za-z_.])"
IP_KIND = """case when ip = '169.254.169.254' then 'cloud_metadata_ip' when p[1] = 169 and p[2] = 254 then 'link_local_ip' when p[1] = 10 then 'private_ip_10'
  when p[1] = 172 and p[2] between 16 and 31 then 'private_ip_172' when p[1] = 192 and p[2] = 168 then 'private_ip_192' when p[1] = 127 then 'loopback_ip' else 'public' end"""


@query(
    rf"""select doc_id, ip, {IP_KIND} kind from (select doc_id, ip, list_transform(string_split(ip, '.'), lambda x: x::int) p
    from (select distinct doc_id, unnest(regexp_extract_all(text, '{IP}', 1)) ip from documents)) where list_max(p) <= 255"""
)
def private_ip(spark, sf_dir):
    hit = F.regexp_extract_all(F.col("text"), F.lit(IP), F.lit(1))
    ips = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"[0-9]\.[0-9]")).select("doc_id", F.explode(hit).alias("ip")).distinct()
    ips = ips.withColumn("p", F.transform(F.split("ip", r"\."), lambda x: x.cast("int"))).filter(F.array_max("p") <= 255)
    return ips.select("doc_id", "ip", F.expr(re.sub(r"p\[(\d)\]", r"element_at(p, \1)", IP_KIND)).alias("kind"))


#: Patterns of internal hosts, the first that matches wins (fixed values; word edges spelled out).
HOST_KINDS = (
    (r"(^|[^a-z0-9_])(dev|development|staging|stg|stage|test|qa|uat|preprod|pre-prod|sandbox)[-.]", "staging_domain"),
    (r"[-.](dev|development|staging|stg|stage|test|qa|uat|preprod|pre-prod|sandbox)\.", "staging_domain"),
    (r"(^|[^a-z0-9_])metadata\.google\.internal($|[^a-z0-9_])", "gcp_metadata_host"),
    (r"\.(svc\.cluster\.local|pod\.cluster\.local)", "k8s_service"),
    (r"(kubernetes|k8s)[-.]", "k8s_reference"),
    (r"\.(compute\.internal|ec2\.internal)", "aws_internal"),
    (r"\.(amazonaws\.com/internal|aws\.internal)", "aws_internal"),
    (r"\.(internal|local|localhost|corp|intranet|private|lan)($|[^a-z0-9_])", "internal_domain"),
    (r"(docker|container)[-.](host|internal)", "docker_internal"),
)


@query("select fid, kind from (select fid, case " + " ".join(f"when regexp_matches(lower(value), '{p}') then '{k}'" for p, k in HOST_KINDS) + f" end kind from ({FINDINGS})) where kind is not null")
def internal_domain(spark, sf_dir):
    v, kind = F.lower("value"), F.lit(None).cast("string")
    for p, k in reversed(HOST_KINDS):
        kind = F.when(v.rlike(p), k).otherwise(kind)
    return findings(spark, sf_dir).select("fid", kind.alias("kind")).filter("kind is not null")


BUCKETS = "select p_partkey, case p_partkey % 5 when 0 then 'https://' || lower(p_brand) || '.s3.eu-west-1.amazonaws.com/x' when 1 then 's3://data-' || cast(p_size as string) || '/a' when 2 then 'https://storage.googleapis.com/b_' || cast(p_size as string) || '/o' when 3 then 'https://acc' || cast(p_size as string) || '.blob.core.windows.net/c' else 'https://example.com/s3' end v from part"
BUCKET_KINDS = (
    (r"(?:https?://)?([a-z0-9.#-]{1,253})\.s3\.(?:[a-z0-9-]{1,63}\.)?amazonaws\.com", "s3_bucket"),
    (r"s3://([a-z0-9.-]+)", "s3_bucket"),
    (r"(?:https?://)?storage\.googleapis\.com/([a-z0-9._-]+)", "gcs_bucket"),
    (r"(?:https?://)?([a-z0-9]{1,63})\.blob\.core\.windows\.net", "azure_blob"),
)


@query("select p_partkey, kind, bucket from (select p_partkey, case " + " ".join(f"when regexp_matches(v, '{p}') then '{k}'" for p, k in BUCKET_KINDS) + " end kind, case " + " ".join(f"when regexp_matches(v, '{p}') then regexp_extract(v, '{p}', 1)" for p, _ in BUCKET_KINDS) + f" end bucket from ({BUCKETS})) where kind is not null")
def cloud_storage(spark, sf_dir):
    kind = bucket = F.lit(None).cast("string")
    for p, k in reversed(BUCKET_KINDS):
        hit = F.col("v").rlike(p)
        kind, bucket = F.when(hit, k).otherwise(kind), F.when(hit, F.regexp_extract("v", p, 1)).otherwise(bucket)
    return derived(spark, sf_dir, BUCKETS).select("p_partkey", kind.alias("kind"), bucket.alias("bucket")).filter("kind is not null")


#: Debug paths: pattern, kind, severity; the first that matches wins (fixed values).
DEBUG = (
    ("^/debug(/|$)", "debug_endpoint", "high"),
    ("^/admin(/|$)", "admin_endpoint", "high"),
    ("^/internal(/|$)", "internal_endpoint", "high"),
    ("^/test(/|$)", "test_endpoint", "medium"),
    ("^/dev(/|$)", "dev_endpoint", "medium"),
    ("^/health(/|$)", "health_endpoint", "low"),
    ("^/status(/|$)", "status_endpoint", "low"),
    ("^/metrics(/|$)", "metrics_endpoint", "low"),
    ("^/info(/|$)", "info_endpoint", "low"),
    ("^/actuator(/|$)", "actuator_endpoint", "medium"),
    ("^/swagger(/|$)", "swagger_endpoint", "low"),
    ("^/api-docs(/|$)", "api_docs_endpoint", "low"),
    ("^/graphql(/|$)", "graphql_endpoint", "info"),
    ("^/playground(/|$)", "playground_endpoint", "medium"),
    ("^/console(/|$)", "console_endpoint", "high"),
    ("^/shell(/|$)", "shell_endpoint", "critical"),
    ("^/eval(/|$)", "eval_endpoint", "critical"),
    ("^/exec(/|$)", "exec_endpoint", "critical"),
    ("(^|/)phpinfo(/|$)", "phpinfo_endpoint", "high"),
    ("(^|/)server-status(/|$)", "server_status_endpoint", "medium"),
    ("(^|/)trace(/|$)", "trace_endpoint", "medium"),
    ("(^|/)dump(/|$)", "dump_endpoint", "high"),
    ("(^|/)profil(er|ing)(/|$)", "profiler_endpoint", "medium"),
)
DEBUG_PATHS = "select l_orderkey, l_linenumber, case l_partkey % 9 when 0 then '/debug/vars' when 1 then '/admin' when 2 then '/_next/static' when 3 then '/_hidden/x' when 4 then '/devices/1' when 5 then '/a/phpinfo' when 6 then '/profile/7' when 7 then '/x/profiler/y' else '/health' end v from lineitem"


def _first(v, rules, at):
    out = F.when(v.rlike("^/_") & ~v.rlike("^/_(next|nuxt)[/-]"), ("hidden_endpoint", "medium")[at])
    for r in reversed(rules):
        out = F.when(v.rlike(r[0]), r[1 + at]).otherwise(out)
    return out


def _first_sql(at):
    return "case " + " ".join(f"when regexp_matches(v, '{r[0]}') then '{r[1 + at]}'" for r in DEBUG) + f" when starts_with(v, '/_') and not regexp_matches(v, '^/_(next|nuxt)[/-]') then '{('hidden_endpoint', 'medium')[at]}' end"


@query(f"select l_orderkey, l_linenumber, {_first_sql(0)} kind, {_first_sql(1)} severity from ({DEBUG_PATHS}) where {_first_sql(0)} is not null")
def debug_path(spark, sf_dir):
    d = derived(spark, sf_dir, DEBUG_PATHS)
    return d.select("l_orderkey", "l_linenumber", _first(F.col("v"), DEBUG, 0).alias("kind"), _first(F.col("v"), DEBUG, 1).alias("severity")).filter("kind is not null")


@query(f"select value, count(*) n, min(line) first_line, max(line) last_line, count(distinct file_url) files from ({FINDINGS}) group by value")
def string_table(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("value").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.countDistinct("file_url").alias("files"))


@query(f"select count(*) total, count(distinct value) n_unique from ({FINDINGS})")
def string_counts(spark, sf_dir):
    return findings(spark, sf_dir).agg(F.count("*").alias("total"), F.countDistinct("value").alias("n_unique"))


@query(f"select distinct value from ({FINDINGS}) where regexp_matches(value, '(?i)^(https?:)?//') and length(value) between 10 and 200")
def string_urls(spark, sf_dir):
    return findings(spark, sf_dir).select("value").filter(F.col("value").rlike("(?i)^(https?:)?//") & F.length("value").between(10, 200)).distinct()


@query(f"select distinct value from ({FINDINGS}) where regexp_matches(value, '^[A-Za-z0-9+/]{{20,}}={{0,2}}$') or regexp_matches(value, '^[0-9a-fA-F]{{32,}}$') or regexp_matches(lower(value), '(password|secret|token|api_?key)')")
def string_secret_like(spark, sf_dir):
    v = F.col("value")
    return findings(spark, sf_dir).select("value").filter(v.rlike("^[A-Za-z0-9+/]{20,}={0,2}$") | v.rlike("^[0-9a-fA-F]{32,}$") | F.lower(v).rlike("(password|secret|token|api_?key)")).distinct()


@query("select min(doc_id) doc_id, sha256(text) content_hash, count(*) n from documents group by sha256(text)")
def content_dedup(spark, sf_dir):
    """One row per content; the first document stands for it."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("select doc_id, count(*) n_lines, max(length(line))::int longest, count(*) filter (trim(line) = '') blank from (select doc_id, unnest(string_split(text, chr(10))) line from documents) group by doc_id")
def line_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"), F.count(F.when(F.trim("line") == "", 1)).alias("blank"))


@query("""select doc_id, hit, md5(array_to_string(lines[greatest(1, hit - 3):hit + 3], chr(10))) snippet from (
    select doc_id, lines, list_position(list_transform(lines, lambda x: contains(x, 'token = ')), true)::int hit from (select doc_id, string_split(text, chr(10)) lines from documents)) where hit > 0""")
def snippet_window(spark, sf_dir):
    """Three lines before and after the first hit."""
    d = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("token = "))).select("doc_id", F.split("text", "\n", -1).alias("lines"))
    d = d.withColumn("hit", F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("token = "))), True).cast("int"))
    lo = F.greatest(F.lit(1), F.col("hit") - 3)
    hi = F.least(F.col("hit") + 3, F.size("lines"))
    return d.select("doc_id", "hit", F.md5(F.array_join(F.slice("lines", lo, hi - lo + 1), "\n").cast("binary")).alias("snippet"))


@query("select doc_id, hit, length(p) - length(replace(p, chr(10), '')) + 1 line, length(list_last(string_split(p, chr(10))))::int col from (select doc_id, hit, left(text, hit - 1) p from (select doc_id, text, strpos(text, 'token = ')::int hit from documents) where hit > 0)")
def line_of_offset(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.locate("token = ", "text").alias("hit")).filter("hit > 0")
    p = F.expr("left(text, hit - 1)")
    return d.select("doc_id", "hit", (F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line"), F.length(F.element_at(F.split(p, "\n", -1), -1)).alias("col"))


@query("select doc_id, mail from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+[A-Za-z]')) mail from documents)")
def email_literals(spark, sf_dir):
    hit = F.regexp_extract_all(F.col("text"), F.lit(r"([A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+[A-Za-z])"), F.lit(1))
    return table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@"))).select("doc_id", F.explode(hit).alias("mail"))


#: Flag words: a run of tokens inside the key (fixed values).
FLAG_WORDS = ("feature", "flag", "toggle", "experiment", "enabled", "beta", "rollout")


@query(f"select fid, case when regexp_matches(value, '^[a-z][a-z0-9_ ]*$') and ({' or '.join(f'''contains('_' || replace(value, ' ', '_') || '_', '_{w}_')''' for w in FLAG_WORDS)}) then 'feature_flag' else 'other' end kind from ({PARTS}) where category = 'flag'")
def flag_key(spark, sf_dir):
    run = F.concat(F.lit("_"), F.replace("value", F.lit(" "), F.lit("_")), F.lit("_"))
    hit = F.lit(False)
    for w in FLAG_WORDS:
        hit |= F.contains(run, F.lit(f"_{w}_"))
    p = derived(spark, sf_dir, PARTS).filter("category = 'flag'")
    return p.select("fid", F.when(F.col("value").rlike("^[a-z][a-z0-9_ ]*$") & hit, "feature_flag").otherwise("other").alias("kind"))


@query(f"select fid, list_has_any(string_split(trim(regexp_replace(value, '[?#].*$', ''), '/'), '/'), ['config', 'settings', 'v2', 'rest']) is_config from ({ENDPOINTS})")
def config_endpoint(spark, sf_dir):
    parts = F.split(F.btrim(F.regexp_replace("value", "[?#].*$", ""), F.lit("/")), "/")
    return endpoints(spark, sf_dir).select("fid", F.arrays_overlap(parts, F.array(*map(F.lit, ("config", "settings", "v2", "rest")))).alias("is_config"))


LIBS = (("jquery", ["jquery"]), ("cold-widget", ["cold", "widget"]), ("small-bolt", ["small", "bolt"]), ("gear", ["gear"]))


@query(
    "with libs as (select * from (values " + ", ".join(f"('{n}', {p})" for n, p in LIBS) + ") l(lib, parts)), t as (select p_partkey, string_split(p_name, ' ') tokens from part) select p_partkey, arg_min(lib, len(parts) * -100 + strpos('jquery cold-widget small-bolt gear', lib)) lib from t join libs on list_has_all(tokens, parts) group by p_partkey"
)
def vendor_subset_join(spark, sf_dir):
    """A library is met if all its name's parts are tokens of the file name; longer names first. The library table has a fixed size."""
    libs = spark.createDataFrame([(n, p, -100 * len(p) + "jquery cold-widget small-bolt gear".index(n)) for n, p in LIBS], "lib string, parts array<string>, rank int")
    t = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("tokens"))
    return t.join(F.broadcast(libs), F.size(F.array_except("parts", "tokens")) == 0).groupBy("p_partkey").agg(F.min_by("lib", "rank").alias("lib"))


@query("select role, count(*) n, count(distinct text) n_unique, sum(length(text))::bigint chars from conversations group by role")
def conversation_literals(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_unique"), F.sum(F.length("text")).alias("chars"))


@query("select doc_id, line_no, text_hash from (select doc_id, line_no, md5(line) text_hash, row_number() over (partition by line order by doc_id, line_no) r, trim(line) t from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1)::int - 1 line_no from documents)) where r = 1 and t <> ''")
def first_line_occurrence(spark, sf_dir):
    """Each distinct line at its first place."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).filter(F.trim("line") != "")
    first = lines.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("at"))
    return first.select("at.doc_id", "at.line_no", F.md5(F.col("line").cast("binary")).alias("text_hash"))


@query("select doc_id, case when r = 1 then 'keep' else 'drop' end verdict from (select doc_id, row_number() over (partition by text order by doc_id) r from documents)")
def occurrence_dedup(spark, sf_dir):
    w = W.partitionBy(F.xxhash64("text"), F.sha2("text", 256)).orderBy("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.row_number().over(w) == 1, "keep").otherwise("drop").alias("verdict"))


@query(f"select fid, u_host host, count(*) over (partition by u_host) n from (select fid, lower(regexp_extract(value, '^(?:[A-Za-z]+:)?//([^/:?#]*)', 1)) u_host from ({ENDPOINTS})) where u_host <> ''")
def endpoint_hosts(spark, sf_dir):
    e = endpoints(spark, sf_dir).select("fid", U.host(F.col("value")).alias("host")).filter("host <> ''")
    return e.withColumn("n", F.count("*").over(W.partitionBy("host")))
