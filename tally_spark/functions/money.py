"""Amounts are whole cents in BIGINT; no expression here goes through a floating-point number but the one for DOUBLE sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = r"^-?[0-9]+(\.[0-9]+)?$"


def plain_amount(text: Column) -> Column:
    """The text without separators and one leading plus sign, for AMOUNT."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), ",", ""), r"^\+", "")


def cents_from_text(text: Column) -> Column:
    """Cents, half a cent away from zero; null if the text isn't an amount or has too many digits for BIGINT."""
    plain = plain_amount(text)
    whole = F.regexp_extract(plain, r"^-?([0-9]+)", 1)
    part = F.rpad(F.regexp_extract(plain, r"\.([0-9]+)$", 1), 3, "0")
    cents = F.try_add(F.try_multiply(whole.try_cast("bigint"), F.lit(100).cast("bigint")), F.substring(part, 1, 2).try_cast("bigint") + F.when(F.substring(part, 3, 1) >= "5", 1).otherwise(0))
    return F.when(plain.rlike(AMOUNT), F.when(plain.startswith("-"), -cents).otherwise(cents))


def cents_from_number(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def _whole(cents: Column) -> Column:
    return F.call_function("div", F.abs(cents), F.lit(100).cast("bigint"))


def _rest(cents: Column) -> Column:
    return F.lpad((F.abs(cents) % 100).cast("string"), 2, "0")


def money(cents: Column) -> Column:
    """-1234.56"""
    return F.concat(F.when(cents < 0, "-").otherwise(""), _whole(cents).cast("string"), F.lit("."), _rest(cents))


def humane(cents: Column) -> Column:
    """-$1,234.56"""
    return F.concat(F.when(cents < 0, "-$").otherwise("$"), F.format_number(_whole(cents), 0), F.lit("."), _rest(cents))


def within(a: Column, b: Column, tolerance: int) -> Column:
    return F.abs(a - b) <= F.lit(tolerance)


def money_text(cents: int) -> str:
    return f"{'-' if cents < 0 else ''}{abs(cents) // 100}.{abs(cents) % 100:02d}"


def humane_text(cents: int) -> str:
    return f"{'-' if cents < 0 else ''}${abs(cents) // 100:,}.{abs(cents) % 100:02d}"
