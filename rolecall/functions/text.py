"""Text matching and display formats, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Currency prefix, range dash and the mark for a missing value.
CURRENCY = "S$"
DASH = "–"
MISSING = "-"


def fold_case(text: Column) -> Column:
    """Lower case letter by letter.

    Spark's ``lower`` turns a dotted capital I into two characters and a final
    sigma into its word-end form; both are mapped first.
    """
    return F.lower(
        F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ"))
    )


def matches_keyword(text: Column, keyword: str, wildcards: bool = False) -> Column:
    """Case-insensitive containment of ``keyword``.

    With ``wildcards`` the characters ``%`` and ``_`` stand for any run and any one
    character; a backslash is always an ordinary character.
    """
    if not wildcards:
        return F.contains(fold_case(text), F.lit(keyword.lower()))
    pattern = keyword.lower().replace("\\", "\\\\")
    return fold_case(text).like(f"%{pattern}%")


def _whole(amount: Column) -> Column:
    return F.format_number(amount.cast("long"), 0)


def money_text(amount: Column) -> Column:
    return F.coalesce(F.concat(F.lit(CURRENCY), _whole(amount)), F.lit(MISSING))


def cell_text(amount: Column) -> Column:
    """As ``money_text``, but nothing where the amount is missing."""
    return F.coalesce(F.concat(F.lit(CURRENCY), _whole(amount)), F.lit(""))


def money_range_text(low: Column, high: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit(CURRENCY), _whole(low), F.lit(DASH), _whole(high)),
        F.lit(MISSING),
    )


def one_decimal_text(value: Column) -> Column:
    """One decimal, no thousands separator, exact halves to even."""
    return F.coalesce(
        F.call_function("format_number", value, F.lit("0.0")), F.lit(MISSING)
    )
