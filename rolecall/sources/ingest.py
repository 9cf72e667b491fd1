"""From raw postings to the clean, typed table that the reports read."""

from __future__ import annotations

import gc
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rolecall.functions.derive import category_list, primary_category
from rolecall.model import CATEGORY_LIST_TYPE, CLEAN_SCHEMA, POSTING_SCHEMA

MALFORMED_ROW = "malformed_row"
MALFORMED_TEXT = "malformed_text"
SOURCE_FILE = "source_file"


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    multi_line: bool = True,
    with_source: bool = False,
    names: list[str] | None = None,
) -> DataFrame:
    """Raw CSV with a header, every column as text, empty cells as null.

    Files whose headers differ, in names or order, fail the read. A row of too few or
    too many cells is marked in ``malformed_row``, which ``clean`` counts; with
    ``with_source`` its whole text stands in ``malformed_text``, and every row's file in
    ``source_file``. Quotes inside a cell are doubled. ``multi_line`` is needed where a
    cell may hold a line break; a file is then read by one task, so deliver a large
    feed as many files, or switch it off where no cell holds one. ``names`` is what all
    headers must be; otherwise that is the first file's.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    reader = reader.option("multiLine", multi_line).option("emptyValue", "")
    names = names or reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, MALFORMED_ROW]])
    raw = (
        reader.schema(schema)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", MALFORMED_ROW)
        .csv(path)
    )
    source = [
        F.col(MALFORMED_ROW).alias(MALFORMED_TEXT),
        F.col("_metadata.file_path").alias(SOURCE_FILE),
    ]
    return raw.select(
        *[F.nullif(F.col(f"`{name}`"), F.lit("")).alias(name) for name in names],
        F.col(MALFORMED_ROW).isNotNull().alias(MALFORMED_ROW),
        *(source if with_source else []),
    )


def _typed(source: Column, kind: T.DataType, date_format: str | None) -> Column:
    text = source.cast("string")
    if isinstance(kind, T.DateType) and date_format:
        return F.try_to_date(text, date_format)
    if isinstance(kind, T.IntegerType):
        # "3.0" is a whole number; "2.7" is not one and counts as rejected.
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("int"))
    if isinstance(kind, T.DoubleType):
        return _finite(text.try_cast(kind))
    return text.try_cast(kind)


def _finite(number: Column) -> Column:
    """NaN and infinities are no salaries, and would spoil every mean."""
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def typed_cells(
    raw: DataFrame, date_format: str | None = None
) -> tuple[list[Column], dict[str, Column]]:
    """The typed columns, and for each column whether a cell was rejected."""
    typed, rejected = [], {}
    for field in POSTING_SCHEMA.fields:
        source = F.col(field.name)
        if raw.schema[field.name].dataType != field.dataType:
            value = _typed(source, field.dataType, date_format)
        elif isinstance(field.dataType, T.DoubleType):
            value = _finite(source)
        else:
            typed.append(source)
            continue
        typed.append(value.alias(field.name))
        rejected[field.name] = source.isNotNull() & value.isNull()
    if MALFORMED_ROW in raw.columns:
        rejected[MALFORMED_ROW] = F.col(MALFORMED_ROW)
    return typed, rejected


def clean(
    raw: DataFrame, date_format: str | None = None, with_category_list: bool = False
) -> DataFrame:
    """Typed columns plus ``primary_category`` and the number of rejected cells.

    A cell whose text does not fit its type becomes null and is counted in
    ``rejected_cells``; a malformed row counts as one more. Columns already typed are
    taken as they are, but for numbers that aren't finite.
    """
    typed, rejected = typed_cells(raw, date_format)
    return raw.select(
        *typed,
        primary_category(F.col("categories")).alias("primary_category"),
        sum((flag.cast("int") for flag in rejected.values()), F.lit(0))
        .cast("int")
        .alias("rejected_cells"),
        *([category_list(F.col("categories")).alias("category_list")] * with_category_list),
    )


def write_postings(
    postings: DataFrame,
    path: str,
    by_month: bool = False,
    files: int | None = None,
    compression: str | None = None,
    add: bool = False,
) -> None:
    """Writes the clean table as Parquet, each file sorted by industry and date.

    The sort is local to a task, so it adds no shuffle, and lets a scan skip row groups
    and pages of other industries. ``by_month`` partitions the folder by posting month;
    the rows are then rebalanced by month, with large months split over several
    files. ``files`` fixes the number of files, for small tables; ``compression`` is the
    session's where none is given. With ``add``, what the folder holds is kept.
    """
    order = ["primary_category", "metadata_originalPostingDate"]
    if files:
        postings = postings.repartition(files)
    if by_month:
        month = F.trunc("metadata_originalPostingDate", "month")
        postings = postings.withColumn("posting_month", month)
        postings = postings.hint("rebalance", "posting_month")
        order = ["posting_month", *order]
    writer = postings.sortWithinPartitions(*order).write.mode("append" if add else "overwrite")
    if compression:
        writer = writer.option("compression", compression)
    if by_month:
        writer = writer.partitionBy("posting_month")
    writer.parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def write_csv_by_month(
    spark: SparkSession, pattern: str, path: str, rounds: int = 8, least: int = 128 << 20
) -> None:
    """All CSV files of a pattern, cleaned and written as ``write_postings`` does by month.

    Their rows are shuffled in as many as ``rounds`` rounds, of ``least`` bytes of files at
    least, and each round's shuffle is removed before the next: so that not all rows lie on
    disk once more beside the files and the table. A month gets a file or more from
    each round. A load that fails leaves some rounds' rows; the next one overwrites them.
    """
    names = read_csv(spark, pattern).columns[:-1]
    for k, files in enumerate(_rounds(_files_of(spark, pattern), rounds, least)):
        raw = read_csv(spark, files, names=names)
        write_postings(clean(raw), path, by_month=True, add=k > 0)
        del raw
        release_shuffles(spark)


def _files_of(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """The files that Spark reads for a pattern, with their bytes, by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    files = [(s.getPath().getName(), s.getPath().toString(), s.getLen()) for s in found]
    return sorted((path, size) for name, path, size in files if name[0] not in "._")


def _rounds(files: list[tuple[str, int]], rounds: int, least: int) -> list[list[str]]:
    """The files' names, in order, in lists of about equal bytes."""
    share = max(least, 1, -(-sum(size for _, size in files) // rounds))
    lists: dict[int, list[str]] = {}
    before = 0
    for path, size in files:
        # A file belongs where its middle lies.
        lists.setdefault((before + size // 2) // share, []).append(path)
        before += size
    return list(lists.values())


def open_postings(
    spark: SparkSession, path: str, with_category_list: bool = False
) -> DataFrame:
    """The clean table, with its schema declared rather than inferred.

    ``with_category_list`` is for a table that was cleaned with it.
    """
    schema = T.StructType(list(CLEAN_SCHEMA.fields))
    if with_category_list:
        schema = schema.add("category_list", T.DataType.fromDDL(CATEGORY_LIST_TYPE))
    return spark.read.schema(schema).parquet(path)


def load_month_files(postings: DataFrame, path: str, load: str) -> DataFrame:
    """Adds one delivery of clean postings to a table split by month and delivery.

    Rewrites this delivery's part of the months it holds, and removes its part of months
    that it held before and no longer does; nothing else is touched or read. So
    loading a delivery twice, or a corrected one later, gives the same table as loading
    the last version once, and a lost job is simply run again. Months are evened out as
    in ``write_postings``. Returns the delivery's months and rows:
    (posting_month, rows), a row without a date under null.
    """
    if not re.fullmatch(r"[\w.-]+", load):
        raise ValueError(f"a delivery's name is part of a folder's: {load!r}")
    spark = postings.sparkSession
    month = F.trunc("metadata_originalPostingDate", "month")
    rows = postings.withColumn("posting_month", month).withColumn("load", F.lit(load))
    held = _months_of(spark, path, load)
    stale = sorted(set(held) - _months_in(rows)) if held else []
    order = ["posting_month", "primary_category", "metadata_originalPostingDate"]
    (
        rows.hint("rebalance", "posting_month")
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("posting_month", "load")
        .parquet(path)
    )
    for name in stale:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/posting_month={name}/load={load}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    loaded = open_months(spark, path).filter(F.col("load") == load)
    return loaded.groupBy("posting_month").agg(F.count(F.lit(1)).alias("rows"))


_NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


def _months_in(rows: DataFrame) -> set[str]:
    """The names of the month folders that rows go to: one for each month there is."""
    found = rows.select(F.col("posting_month").cast("string").alias("m")).distinct().collect()
    return {row["m"] or _NO_MONTH for row in found}


def _months_of(spark: SparkSession, path: str, load: str) -> list[str]:
    """The month folders that hold a part of a delivery, from the names alone."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/posting_month=*/load={load}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    names = [status.getPath().getParent().getName() for status in found or []]
    return [name.split("=", 1)[1] for name in names]


def open_months(spark: SparkSession, path: str) -> DataFrame:
    """A table made by ``load_month_files``: the clean columns, posting_month and load."""
    schema = T.StructType(
        [*CLEAN_SCHEMA.fields, T.StructField("posting_month", T.DateType()),
         T.StructField("load", T.StringType())]
    )
    return spark.read.schema(schema).parquet(path)
