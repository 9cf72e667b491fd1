"""Ids of documents where rows may share one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rolecall.llm.positions import numbered


def distinct_ids(docs: DataFrame, id_col: str, text_col: str, into: str) -> DataFrame:
    """``docs`` with ``into``, an id that rows share only if id and text are equal.

    It is the id itself unless rows of different texts share one. Then it is the row's
    place among all different pairs of id and text, in this order (texts by their
    digest), so that smaller ids stay smaller. Rows without an id have none; a null text
    is an empty one.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    named = docs.where(docs[id_col].isNotNull())
    texts = named.select(docs[id_col].alias("id"), F.xxhash64(text).alias("h"))
    shared = texts.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b")
    own = docs[id_col].cast("long").alias(into)
    if shared.isEmpty():
        return docs.select(*[docs[c] for c in docs.columns if c != into], own)
    pairs = named.select(
        docs[id_col].cast("long").alias("_of"), F.sha2(text, 256).alias("_digest")
    ).distinct()
    places = numbered(pairs, ["_of", "_digest"], into, "_total").drop("_total")
    row = F.struct(*[docs[c] for c in docs.columns if c != into]).alias("_row")
    keyed = docs.select(
        row, docs[id_col].cast("long").alias("_id"), F.sha2(text, 256).alias("_text")
    )
    same = (F.col("_id") == F.col("_of")) & (F.col("_text") == F.col("_digest"))
    found = keyed.where("_id IS NOT NULL").join(places, same)
    nameless = keyed.where("_id IS NULL").withColumn(into, F.lit(None).cast("long"))
    return found.select("_row.*", into).unionByName(nameless.select("_row.*", into))
