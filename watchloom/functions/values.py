"""Column functions: identities, two-valued comparisons, time text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sized(value: Column) -> Column:
    """``<utf8 byte length>:<bytes>``, the unit of length-prefixed identities."""
    text = value.cast("string")
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def stable_id(prefix: str, tag: str, *parts: Column) -> Column:
    """prefix:sha256 over length-prefixed tag and parts; null if a part is null."""
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat(*[sized(x) for x in (F.lit(tag), *parts)]).cast("binary"), 256))


def piped_id(prefix: str, *parts: Column) -> Column:
    """prefix:sha256 over parts joined by a pipe (event, quarantine and finding identities)."""
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat_ws("|", *parts), 256))


def iso_offset(ts: Column) -> Column:
    """2026-10-12T00:00:00+00:00, as it stands in finding identities."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def iso_z(ts: Column) -> Column:
    """2026-10-12T00:00:00Z, as it stands in business keys."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def text_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def business_key(*parts: Column) -> Column:
    """Parts joined by a pipe; a part that holds a pipe makes the key null."""
    clean = reduce(lambda a, b: a & b, [F.instr(p.cast("string"), "|") == 0 for p in parts])
    return F.when(clean, F.concat_ws("|", *parts))


def matches(value: Column, op: str, other) -> Column:
    """Two-valued comparison: rows without a value match nothing, but != matches them."""
    right = other if isinstance(other, Column) else F.lit(other)
    if op == "!=":
        return ~value.eqNullSafe(right)
    got = {"=": value == right, ">": value > right, ">=": value >= right, "<": value < right, "<=": value <= right}[op]
    return F.coalesce(got, F.lit(False))


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests])


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def negate(test: Column) -> Column:
    return ~F.coalesce(test, F.lit(False))


def first_failing(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that fails; a rule is (what must hold, code), an unknown answer is a failure."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for ok, code in rules])
