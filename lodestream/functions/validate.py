"""Typed validation of raw text values: what does not fit its type becomes null.

The text "None" and blanks count as null for every type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _present(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.isin("", "None"), t)


def boolean(c: Column) -> Column:
    t = F.lower(_present(c))
    return F.when(t == "true", True).when(t == "false", False)


def whole(c: Column) -> Column:
    """Digits with an optional sign, in full."""
    t = _present(c)
    return F.when(t.rlike(r"^-?\d+$"), t.try_cast("bigint"))


def number(c: Column) -> Column:
    """A decimal number without exponent, in full."""
    t = _present(c)
    return F.when(t.rlike(r"^-?\d+(\.\d+)?$"), t.try_cast("double"))


def categorical(c: Column, domain: list[str]) -> Column:
    t = _present(c)
    return F.when(t.isin(*domain), t) if domain else F.lit(None).cast("string")


def multi_categorical(c: Column, domain: list[str]) -> Column:
    """A JSON list of members of the domain, else null."""
    values = F.from_json(_present(c), "array<string>")
    allowed = F.array(*[F.lit(x) for x in domain]).cast("array<string>")
    return F.when(F.size(F.array_except(values, allowed)) == 0, values)


def warnings(checks: dict[str, Column]) -> Column:
    """The messages whose condition holds, in order."""
    return F.filter(F.array(*(F.when(cond, F.lit(m)) for m, cond in checks.items())), lambda x: x.isNotNull())
