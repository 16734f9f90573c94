"""Risk scores and ordinals as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights (fixed values).
IMPACT = {"secret": 1.0, "sink": 0.85, "debug": 0.8, "domain": 0.6, "upload": 0.6, "endpoint": 0.5, "flag": 0.3}
MULTIPLIER = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.3, "info": 0.1}
CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.4}
LIKELY_TYPES = ("aws_access_key", "stripe_secret_key", "github_pat", "jwt_token", "database_url", "private_key")
SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")


def pick(c: Column, values: dict, default) -> Column:
    return reduce(lambda acc, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(acc), reversed(values.items()), F.lit(default))


def rank(c: Column, order: tuple) -> Column:
    return pick(c, {x: i for i, x in enumerate(order)}, -1).cast("int")


def impact() -> Column:
    return pick(F.col("category"), IMPACT, 0.5) * pick(F.col("severity"), MULTIPLIER, 0.5)


def likelihood(idor: Column | None = None) -> Column:
    base = F.lit(0.5) + F.when(F.col("first_party"), 0.1).otherwise(0.0) + F.when(F.col("value_type").isin(*LIKELY_TYPES), 0.2).otherwise(0.0)
    if idor is not None:
        base += F.when(idor, 0.15).otherwise(0.0)
    return F.least(base, F.lit(1.0))


def score(idor: Column | None = None) -> Column:
    """Unrounded: rounding modes differ between engines at ties."""
    return impact() * likelihood(idor) * pick(F.col("confidence"), CONFIDENCE, 0.5) * 10


def tier(s: Column) -> Column:
    top = (F.col("category") == "secret") & (F.col("severity") == "critical") & (F.col("confidence") == "high")
    return F.when(top | (s >= 7), "P0").when((s >= 5) | (F.col("severity") == "critical"), "P1").when(s >= 3, "P2").otherwise("P3")


def sql_case(c: str, values: dict, default) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then {v!r}" if isinstance(v, str) else f"when '{k}' then {v}::double" for k, v in values.items()) + f" else {default} end"


IMPACT_SQL = f"({sql_case('category', IMPACT, 0.5)} * {sql_case('severity', MULTIPLIER, 0.5)})"
LIKELIHOOD_SQL = "least(1.0::double, 0.5::double + case when first_party then 0.1::double else 0.0::double end + case when value_type in (" + ", ".join(map(repr, LIKELY_TYPES)) + ") then 0.2::double else 0.0::double end)"
SCORE_SQL = f"({IMPACT_SQL} * {LIKELIHOOD_SQL} * {sql_case('confidence', CONFIDENCE, 0.5)} * 10)"
TIER_SQL = "case when (category = 'secret' and severity = 'critical' and confidence = 'high') or score >= 7 then 'P0' when score >= 5 or severity = 'critical' then 'P1' when score >= 3 then 'P2' else 'P3' end"


def rank_sql(c: str, order: tuple) -> str:
    return f"list_position([{', '.join(map(repr, order))}], {c}) - 1"
