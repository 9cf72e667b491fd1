"""A stand-in postings table over order, part, supplier and customer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rolecall.functions.derive import primary_category
from rolecall.model import POSTING_SCHEMA
from rolecall.sources.ingest import MALFORMED_ROW


def _every(key: str, n: int):
    return F.col(key) % n == 0


def star_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per order line, with the derived columns of the clean table.

    Text is put together, and the category found, on the dimension rows before they
    are joined: once per part rather than once per order line. Customers are
    joined to orders before these meet the far more numerous lines. Lines are shuffled
    as they are stored: amounts are worked out after the last join, and parts, whose
    text is widest, are joined last. No join is hinted, so a side is broadcast only where its known size is small, and
    a hot key is split at run time.
    """

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    first = F.concat(
        F.lit('{"id":'), F.col("p_size").cast("string"),
        F.lit(',"category":"'), F.col("p_brand"), F.lit('"}'),
    )
    second = F.concat(F.lit(',{"id":0,"category":"'), F.col("p_type"), F.lit('"}'))
    categories = (
        F.when(_every("p_partkey", 53), F.lit(None))
        .when(_every("p_partkey", 59), "[]")
        .when(_every("p_partkey", 3), F.concat(F.lit("["), first, second, F.lit("]")))
        .otherwise(F.concat(F.lit("["), first, F.lit("]")))
    )
    parts = read("part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("title"),
        categories.alias("categories"),
        primary_category(categories).alias("primary_category"),
    )
    companies = read("supplier").select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.when(~_every("s_suppkey", 37), F.col("s_name")).alias("postedCompany_name"),
    )
    segments = read("customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment"
    )
    orders = read("orders").join(segments, "o_custkey").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.when(~_every("o_orderkey", 71), F.col("o_orderpriority"))
        .alias("positionLevels"),
        F.when(~_every("o_orderkey", 67), F.col("c_mktsegment"))
        .alias("employmentTypes"),
        F.when(~_every("o_orderkey", 251), F.col("o_orderdate").cast("date"))
        .alias("metadata_originalPostingDate"),
    )

    lines = read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.floor(F.col("l_extendedprice") / 3).alias("_base"),
        F.when(~_every("l_partkey", 89), F.col("l_quantity"))
        .cast("int").alias("metadata_totalNumberJobApplication"),
    )

    def salary(step: int):
        amount = F.col("_base").cast("double") + step * F.col("l_linenumber")
        return (
            F.when(_every("l_orderkey", 263), F.lit(None))
            .when(_every("l_orderkey", 61), F.lit(0.0))
            .otherwise(amount)
            .cast("double")
        )

    joined = (
        lines.join(orders, "l_orderkey")
        .join(companies, "l_suppkey")
        .join(parts, "l_partkey")
    )
    return joined.select(
        "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber",
        salary(0).alias("salary_minimum"),
        salary(100).alias("salary_maximum"),
        salary(50).alias("average_salary"),
        F.when(~_every("l_orderkey", 257), F.col("l_linenumber") - 1)
        .cast("int").alias("metadata_repostCount"),
        "metadata_totalNumberJobApplication", "title", "categories", "primary_category",
        "postedCompany_name", "positionLevels", "employmentTypes",
        "metadata_originalPostingDate", F.lit(0).alias("rejected_cells"),
    )


def as_delivered(postings: DataFrame) -> DataFrame:
    """The stand-in table as text, as a CSV would hand it over, with faults at some keys."""

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    pay = text("average_salary")
    applications = text("metadata_totalNumberJobApplication")
    planted = {
        "salary_minimum": F.when(_every("l_orderkey", 17), "n/a"),
        "average_salary": F.when(_every("l_orderkey", 19), "NaN")
        .when(_every("l_orderkey", 23), "Infinity")
        .when(_every("l_orderkey", 29), F.concat(F.lit(" "), pay)),
        "metadata_originalPostingDate": F.when(_every("l_orderkey", 43), "soon"),
        "metadata_repostCount": F.when(_every("l_partkey", 29), "2.7"),
        "metadata_totalNumberJobApplication": F.when(
            _every("l_partkey", 31), F.concat(applications, F.lit(".0"))
        ),
    }
    cells = [
        (planted[name].otherwise(text(name)) if name in planted else text(name)).alias(name)
        for name in POSTING_SCHEMA.names
    ]
    return postings.select(*cells, _every("l_suppkey", 41).alias(MALFORMED_ROW))


# Rows of one CSV file, some 20 MB: a file with line breaks in its cells is read by one task.
_ROWS_PER_FILE = 100_000


def write_as_csv(
    delivered: DataFrame,
    path: str,
    files: int | None = None,
    rows: int = _ROWS_PER_FILE,
    compression: str = "none",
) -> None:
    """The delivered table as CSV files with a header; malformed rows get a cell too many.

    Cells with quotes, commas or blanks at their ends come back as they are. Each task
    writes what it holds, in files of at most ``rows`` rows, without a shuffle unless
    ``files`` asks for so many tasks. A file without rows holds the header of an empty table.
    ``compression`` is a codec of Spark's text files, named in the files' endings.
    """
    if files:
        delivered = delivered.repartition(files)
    names = [name for name in delivered.columns if name != MALFORMED_ROW]
    cells = [F.col(name) for name in names]
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}
    line = F.to_csv(F.struct(*cells), options)
    line = F.when(F.col(MALFORMED_ROW), F.concat(line, F.lit(",surplus"))).otherwise(line)
    head = F.lit(",".join(names))
    # The lower 33 bits number a task's rows from 0; the writer begins a file at the same rows.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    line = F.when(place % rows == 0, F.concat(head, F.lit("\n"), line)).otherwise(line)
    alone = delivered.sparkSession.range(0, 1, 1, 1).select(head.alias("value"))
    whole = delivered.select(line.alias("value")).unionByName(alone)
    writer = whole.write.mode("overwrite").option("maxRecordsPerFile", rows)
    writer.option("compression", compression).text(f"{path}/lines")
