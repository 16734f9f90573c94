"""Base-64 VLQ numbers of source maps, Column in, Column out.

A digit holds five bits, lowest first; its sixth says that another follows. The lowest bit of a number is its sign.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the digits.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Digits of a number of 32 bits.
MOST = 7


def encoded(n: Column) -> Column:
    v = F.abs(n.cast("long")) * 2 + F.when(n < 0, 1).otherwise(0)
    out = []
    for k in range(MOST):
        rest = F.shiftright(v, 5 * k)
        digit = rest.bitwiseAND(F.lit(31)) + F.when(F.shiftright(v, 5 * k + 5) > 0, 32).otherwise(0)
        out.append(F.when((rest > 0) | F.lit(k == 0), F.substr(F.lit(DIGITS), digit.cast("int") + 1, F.lit(1))).otherwise(""))
    return F.concat(*out)


def numbers(text: Column) -> Column:
    """The numbers of a segment, as an array of longs; null if a character is no digit or the last number is cut off."""
    start = F.struct(F.lit(0).alias("shift"), F.lit(0).cast("long").alias("value"), F.array().cast("array<bigint>").alias("out"))

    def step(state: Column, c: Column) -> Column:
        digit = (F.call_function("instr", F.lit(DIGITS), c) - 1).cast("long")
        value = state["value"] + F.call_function("shiftleft", digit.bitwiseAND(F.lit(31)), state["shift"])
        more = digit.bitwiseAND(F.lit(32)) != 0
        number = F.when(value % 2 == 1, -F.shiftright(value, 1)).otherwise(F.shiftright(value, 1))
        return F.struct(
            F.when(more, state["shift"] + 5).otherwise(0).alias("shift"),
            F.when(more, value).otherwise(F.lit(0).cast("long")).alias("value"),
            F.when(more, state["out"]).otherwise(F.concat(state["out"], F.array(number))).alias("out"),
        )

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    whole = F.aggregate(chars, start, step)
    return F.when(text.rlike("^[A-Za-z0-9+/]*$") & (whole["shift"] == 0), whole["out"])
