"""Column types found from all cells of a raw table, rather than from a sample or a schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rolecall.sources.ingest import MALFORMED_ROW, MALFORMED_TEXT, SOURCE_FILE, read_csv

# What counts as a whole and as any number.
WHOLE = r"^[+-]?[0-9]{1,18}$"
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# Numeric formats only: a letter stands for one digit.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")
TRUTH = r"^(?i)(true|false)$"
_TRUTH_STARTS = "tTfF"

_BOOKKEEPING = {MALFORMED_ROW, MALFORMED_TEXT, SOURCE_FILE}
_INT = (-(2**31), 2**31 - 1)


# The widest cell that any number, date or truth value is looked for in.
_LONGEST = 40


def _misfit_bits(cell: Column, date_formats: tuple[str, ...]) -> Column:
    """One bit for each candidate type that a cell doesn't fit; 0 for an empty cell.

    A pattern is slow, so a cell's first character is looked at first: most text
    meets no pattern, and most other cells one or two.
    """
    kinds = _kinds(date_formats)
    every = (1 << len(kinds)) - 1

    def but(*fitting: str) -> Column:
        return F.lit(every - sum(1 << kinds.index(kind) for kind in fitting))

    first = F.substring(cell, 1, 1)
    starts = set("0123456789+-.") | set(_TRUTH_STARTS)
    starts |= {f[0] for f in date_formats if not f[0].isalpha()}
    dates = F.lit(every)
    for date_format in date_formats:
        bit = 1 << kinds.index(f"date:{date_format}")
        dates = dates - F.when(_date(cell, date_format).isNotNull(), bit).otherwise(0)
    return (
        F.when(cell.isNull(), 0)
        .when(F.length(cell) > _LONGEST, every)
        .when(~first.isin(*sorted(starts)), every)
        .when(first.isin(*_TRUTH_STARTS), F.when(cell.rlike(TRUTH), but("boolean")).otherwise(dates))
        .when(
            cell.rlike(WHOLE),
            F.when(cell.try_cast("bigint").between(*_INT), but("int", "bigint", "double"))
            .otherwise(but("bigint", "double")),
        )
        .when(cell.rlike(NUMBER), but("double"))
        .otherwise(dates)
    )


def _kinds(date_formats: tuple[str, ...]) -> list[str]:
    """Candidate types, narrowest first."""
    return ["boolean", "int", "bigint", "double", *[f"date:{f}" for f in date_formats]]


def _date(cell: Column, date_format: str) -> Column:
    """The date in a cell. A failed parse is slow, so the cell's shape is looked at first."""
    shape = "".join("[0-9]" if c.isalpha() else re.escape(c) for c in date_format)
    # A pattern's end also lies before a last line break, of two characters at most.
    long_enough = F.length(cell).between(len(date_format), len(date_format) + 2)
    return F.when(long_enough & cell.rlike(f"^{shape}$"), F.try_to_date(cell, date_format))


def detect_types(
    raw: DataFrame,
    place: Column | None = None,
    date_formats: tuple[str, ...] = DATE_FORMATS,
) -> DataFrame:
    """One row for each column: (column, type, date_format, cells, empty, nearest, misfits,
    odd_cell, odd_place).

    The type is the first of boolean, int, bigint, double and date (in one of the formats)
    that every cell fits, else string; blanks around a cell don't count, empty cells
    fit all, and a column of these only is a string. ``nearest`` is the type that fits
    some cells but not all and has the fewest ``misfits`` (ties by name); ``odd_cell`` is
    the least of these, and ``odd_place`` its least ``place``: a column or an expression,
    or the source file if there is one.

    One scan gives all of it, however many columns there are: cells are counted by column
    and by the types they misfit, and these partial counts are combined from all tasks, so a single odd cell anywhere changes the type.
    """
    names = [f.name for f in raw.schema.fields if f.name not in _BOOKKEEPING]
    if place is None:
        place = F.col(SOURCE_FILE) if SOURCE_FILE in raw.columns else F.lit(None).cast("string")
    kinds = _kinds(date_formats)
    cells = [
        F.nullif(F.trim(F.col(f"`{name}`").cast("string")), F.lit("")) for name in names
    ]
    each = F.array(
        *[F.struct(F.lit(i).alias("at"), cell.alias("cell")) for i, cell in enumerate(cells)]
    )
    rows = raw.select(place.cast("string").alias("place"), F.inline(each))
    rows = rows.withColumn("bits", _misfit_bits(F.col("cell"), date_formats))
    # A few groups for each column. Least structs alone would be found by sorting all
    # cells; beside a set they are hashed (up to 128 groups a task, then sorted). The
    # set is never empty, but would be left out if nothing asked for it.
    shapes = rows.groupBy("at", "bits").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("cell", "place")).alias("least"),
        F.collect_set("bits").alias("hashed"),
    )

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    counts = []
    for i in range(len(names)):
        here = F.col("at") == i
        counts.append(total(here & (F.col("bits") != 0)).alias(f"cells_{i}"))
        for j in range(len(kinds)):
            odd = here & (F.col("bits").bitwiseAND(1 << j) != 0)
            least = F.min(F.when(odd, F.col("least")))
            counts += [total(odd).alias(f"odd_{i}_{j}"), least.alias(f"least_{i}_{j}")]
    one = shapes.filter(F.size("hashed") > 0).agg(total(F.col("at") == 0).alias("rows"), *counts)

    def misfit(i: int, j: int) -> Column:
        return F.struct(
            F.lit(kinds[j]).alias("type"),
            F.col(f"odd_{i}_{j}").alias("cells"),
            F.col(f"least_{i}_{j}")["cell"].alias("example"),
            F.col(f"least_{i}_{j}")["place"].alias("place"),
        )

    columns = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"cells_{i}").alias("cells"),
                (F.col("rows") - F.col(f"cells_{i}")).alias("empty"),
                F.array(*[misfit(i, j) for j in range(len(kinds))]).alias("tests"),
            )
            for i, name in enumerate(names)
        ]
    )
    each = one.select(F.inline(columns))
    fitting = F.filter("tests", lambda t: (t["cells"] == 0) & (F.col("cells") > 0))
    kind = F.coalesce(F.try_element_at(fitting, F.lit(1))["type"], F.lit("string"))
    partly = F.array_sort(
        F.transform(
            F.filter("tests", lambda t: (t["cells"] > 0) & (t["cells"] < F.col("cells"))),
            lambda t: F.struct(t["cells"], t["type"], t["example"], t["place"]),
        )
    )
    each = each.withColumns({"_kind": kind, "_partly": partly})
    nearest = F.try_element_at("_partly", F.lit(1))
    is_date = F.col("_kind").startswith("date:")
    return each.select(
        "column",
        F.when(is_date, "date").otherwise(F.col("_kind")).alias("type"),
        F.when(is_date, F.substring("_kind", 6, 100)).alias("date_format"),
        "cells",
        "empty",
        nearest["type"].alias("nearest"),
        nearest["cells"].alias("misfits"),
        nearest["example"].alias("odd_cell"),
        nearest["place"].alias("odd_place"),
    )


def apply_types(raw: DataFrame, types: DataFrame) -> DataFrame:
    """``raw`` with each column cast to the type that ``detect_types`` found for it.

    One row for each column passes through the driver.
    """
    found = {row["column"]: row for row in types.collect()}
    columns = []
    for name in raw.columns:
        row = found.get(name)
        cell = F.col(f"`{name}`")
        if row is None or row["type"] == "string":
            columns.append(cell)
            continue
        text = F.nullif(F.trim(cell.cast("string")), F.lit(""))
        if row["type"] == "date":
            columns.append(_date(text, row["date_format"]).alias(name))
        else:
            columns.append(text.try_cast(row["type"]).alias(name))
    return raw.select(*columns)


def read_csv_detected(
    spark: SparkSession, path: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(table, types): a CSV with a header, its columns typed by all their cells."""
    raw = read_csv(spark, path, multi_line, with_source=True)
    types = detect_types(raw)
    return apply_types(raw, types), types
