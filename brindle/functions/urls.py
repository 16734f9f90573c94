"""URL functions, Column in, Column out: all stay inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What has a host: scheme, optional user, host, optional port, and the rest.
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def netloc(u: Column) -> Column:
    return F.regexp_extract(u, AUTHORITY, 1)


def host(u: Column) -> Column:
    """Host in lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(u), r"^.*@", ""), r":[0-9]*$", ""))


def port(u: Column) -> Column:
    return F.regexp_extract(netloc(u), r":([0-9]+)$", 1)


def has_host(u: Column) -> Column:
    return F.lower(u).rlike(r"^(https?:)?//")


def path(u: Column) -> Column:
    """Path of a URL or of a relative reference."""
    return F.regexp_extract(F.regexp_replace(u, AUTHORITY, ""), r"^([^?#]*)", 1)


def url_query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def _known_port(s: Column, h: Column) -> Column:
    return F.when(s == "http", F.regexp_replace(h, ":80$", "")).when(s == "https", F.regexp_replace(h, ":443$", "")).otherwise(h)


def dedup_key(u: Column) -> Column:
    """Scheme and host in lower case, no default port, no slashes at the path's end, no fragment."""
    s = scheme(u)
    p, q = F.regexp_replace(path(u), "/+$", ""), url_query(u)
    return F.concat(s, F.lit("://"), _known_port(s, F.lower(netloc(u))), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def origin(u: Column) -> Column:
    """Canonical origin of a URL with an ASCII host; empty without one."""
    s, p = scheme(u), port(u)
    h = F.regexp_replace(host(u), r"\.+$", "")
    keep = (p != "") & ~((s == "http") & (p == "80")) & ~((s == "https") & (p == "443"))
    full = F.concat(F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""), F.lit("//"), h, F.when(keep, F.concat(F.lit(":"), p)).otherwise(""))
    return F.when(has_host(u) & (h != ""), full).otherwise("")


def api_prefix(u: Column) -> Column:
    """/api..., /v1..., /rest..., /graphql..., else the first path segment."""
    p = F.when(has_host(u), F.when(path(u) == "", "/").otherwise(path(u))).otherwise(u)
    known = F.regexp_extract(p, r"^(/(?:api|v[0-9]+|rest|graphql)[^/]*)", 1)
    return F.when(known != "", known).otherwise(F.regexp_extract(p, r"^(/[a-zA-Z0-9_-]+)", 1))


def templates_to(u: Column, to: str) -> Column:
    return F.regexp_replace(u, r"\$\{[^}]{0,1024}\}", to)


UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
LONG_HEX = r"^[0-9a-fA-F]{24,}$"


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def route(p: Column) -> Column:
    """A path with its ids as placeholders."""
    one = lambda s: (
        F.when(s.startswith("$") | (s.startswith("{") & s.endswith("}")), "{id}")
        .when(s.rlike("^[0-9]+$"), "{id}")
        .when(s.rlike(UUID), "{uuid}")
        .when(s.rlike(LONG_HEX), "{id}")
        .when(s == "FUZZ", "{param}")
        .otherwise(s)
    )
    return F.concat(F.lit("/"), F.array_join(F.transform(segments(p), one), "/"))


def endpoint_parts(value: Column) -> tuple[Column, Column, Column]:
    """(domain, path, query) of an endpoint value; ``(relative)`` without a host."""
    v = templates_to(value, "{param}")
    abs_ = v.rlike("^(https?:)?//")
    domain = F.when(abs_ & (netloc(v) != ""), netloc(v)).otherwise("(relative)")
    bare = F.regexp_extract(v, r"^([^?]*)", 1)
    p = F.when(abs_, F.when(path(v) == "", "/").otherwise(path(v))).when(v.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    q = F.when(abs_, url_query(v)).otherwise(F.regexp_extract(v, r"^[^?]*\?(.*)$", 1))
    return domain, p, q


def dormancy_parts(value: Column) -> tuple[Column, Column]:
    """(host, path with ids as {id}) of a declared or an observed URL; the host is empty for relative ones."""
    v = templates_to(F.trim(value), "{id}")
    abs_ = v.rlike("^((https?|wss?):)?//")
    h = F.when(abs_, F.lower(netloc(v))).otherwise("")
    p = F.when(abs_, path(v)).otherwise(F.regexp_extract(v, r"^([^?#]*)", 1))
    one = lambda s: F.when(s.rlike(r"^[${]") | (s == "FUZZ") | s.rlike("^[0-9]+$") | s.rlike(UUID) | s.rlike(LONG_HEX), "{id}").otherwise(s)
    return h, F.concat(F.lit("/"), F.array_join(F.transform(segments(p), one), "/"))


#: The characters that a wildcard may cross with dots, without dots, and that a single one stands for.
WIDE, NARROW, ONE = "[a-zA-Z0-9._:-]*", "[a-zA-Z0-9_:-]*", "[a-zA-Z0-9_-]"


def glob_regex(pattern: str) -> str:
    """A domain glob as a pattern: a leading * and ** cross dots, another * does not, ? is one character."""

    def piece(m: re.Match) -> str:
        match m.lastgroup:
            case "any":
                return WIDE if m.start() == 0 or m[0] == "**" else NARROW
            case "one":
                return ONE
        return re.escape(m[0])

    return "(?i)^" + re.sub(r"(?P<any>[*]{1,2})|(?P<one>[?])|(?P<text>[^*?]+)", piece, pattern) + "$"


def matches_any(h: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out |= h.rlike(glob_regex(g))
    return (F.length(h) <= 255) & out


def ip_number(text: Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else."""
    parts = F.split(text, r"\.")
    whole = text.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$")
    n = [F.try_element_at(parts, F.lit(i)).cast("long") for i in range(1, 5)]
    good = whole & (F.greatest(*n) <= 255)
    return F.when(good, ((n[0] * 256 + n[1]) * 256 + n[2]) * 256 + n[3])


def ip_literal(text: Column) -> Column:
    """An IPv4 literal in decimal, hexadecimal (0x) or dotted form, whose parts are octal after a leading zero, as a number."""
    part = lambda s: F.when(s.rlike("^0[0-7]+$"), F.conv(s, 8, 10)).otherwise(s).try_cast("long")
    parts = F.transform(F.split(text, r"\."), part)
    number = ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]
    whole = text.try_cast("long")
    return (
        F.when(text.rlike("^[1-9][0-9]{0,9}$"), F.when(whole < 1 << 32, whole))
        .when(text.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(text, 3, 8), 16, 10).try_cast("long"))
        .when(text.rlike(r"^([0-9]{1,4}\.){3}[0-9]{1,4}$"), F.when(F.array_max(parts) <= 255, number))
    )
