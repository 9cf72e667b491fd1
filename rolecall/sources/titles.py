"""A dictionary of titles, so that a keyword is looked up once per title, not per posting.

Three tables: the different titles with an id each; their trigrams (runs of three
characters, in lower case), each with the ids of the titles that hold it; and the
postings with their title's id, in the order of these ids. A keyword's trigrams give
the few titles that may hold it, which are then tested; their ids are pushed into the
scan of the postings, where row groups of other ids are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rolecall.functions.text import fold_case, matches_keyword

_GRAM = 3


def _title_id(title: Column) -> Column:
    """A hash. Should two titles share one, the scan finds both, and the title is tested."""
    return F.xxhash64(title)


def _grams(text: Column) -> Column:
    places = F.sequence(F.lit(1), F.char_length(text) - (_GRAM - 1))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(_GRAM))))


def write_title_index(postings: DataFrame, path: str) -> None:
    """Writes the three tables below ``path``; postings without a title are kept too.

    The postings are dealt by ranges of title ids, one title's over several files if
    they are many, as the sort is by further columns too.
    """
    spark = postings.sparkSession
    numbered = postings.withColumn("title_id", _title_id(F.col("title")))
    order = ["title_id", "primary_category", "metadata_originalPostingDate", "average_salary"]
    ranged = numbered.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.schema(numbered.schema).parquet(f"{path}/postings")
    titles = stored.filter(F.col("title").isNotNull()).select("title_id", "title").distinct()
    titles.write.mode("overwrite").parquet(f"{path}/titles")
    titles = spark.read.schema(titles.schema).parquet(f"{path}/titles")
    folded = titles.select("title_id", fold_case(F.col("title")).alias("folded"))
    long = folded.filter(F.char_length("folded") >= _GRAM)
    grams = long.select(F.explode(_grams(F.col("folded"))).alias("gram"), "title_id")
    grams = grams.repartitionByRange("gram", "title_id").sortWithinPartitions("gram", "title_id")
    grams.write.mode("overwrite").parquet(f"{path}/grams")


def matching_titles(
    spark: SparkSession, path: str, keyword: str, wildcards: bool = False
) -> DataFrame:
    """(title_id, title) of the titles that hold the keyword.

    Keywords under three characters, and patterns, are tested on all titles.
    """
    titles = spark.read.parquet(f"{path}/titles")
    lower = keyword.lower()
    grams = sorted({lower[i : i + _GRAM] for i in range(len(lower) - _GRAM + 1)})
    if grams and not wildcards:
        held = spark.read.parquet(f"{path}/grams").filter(F.col("gram").isin(grams))
        all_of = held.groupBy("title_id").agg(F.count(F.lit(1)).alias("n"))
        maybe = all_of.filter(F.col("n") >= len(grams)).select("title_id")
        titles = titles.join(maybe, "title_id", "left_semi")
    return titles.filter(matches_keyword(F.col("title"), keyword, wildcards))


def postings_with(
    spark: SparkSession, path: str, keyword: str, wildcards: bool = False, most: int = 1000
) -> DataFrame:
    """The postings whose title holds the keyword, without a look at all others.

    Up to ``most`` ids go into the scan as a list; more are joined, as a table. The
    result is the same, and is what a test of every posting's title gives.
    """
    stored = spark.read.parquet(f"{path}/postings")
    found = matching_titles(spark, path, keyword, wildcards)
    ids = [row["title_id"] for row in found.select("title_id").distinct().limit(most + 1).collect()]
    if len(ids) <= most:
        near = stored.filter(F.col("title_id").isin(ids)) if ids else stored.limit(0)
    else:
        near = stored.join(found.select("title_id").distinct(), "title_id", "left_semi")
    return near.filter(matches_keyword(F.col("title"), keyword, wildcards)).drop("title_id")
