"""Shards that all have the mixture of sources of the whole, with DataFrame functions.

Proportional stratified interleaving: within each source, rows are shuffled by a seeded
hash and ranked; the rank as a fraction of the source's size puts the sources into one
sequence in which each is spread evenly; the sequence is cut into shards of equal
counts (the law ``rows``: counts differ by one at most).

Ranks come from range partitions and sums of their counts (see ``positions``), so a
source that holds a third of all rows is sorted by as many tasks as its size asks for.

Defined results: a null source is a source of its own; a null text has no bytes; equal
rows take neighbouring places; an empty table gives an empty result; further columns
are carried only where ``carry`` names them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rolecall.llm.positions import numbered


def stratified_shards(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, size, text_crc32, source, shard, slot, and ``carry`` as columns of their own.

    To write the shards, carry the text and partition the output by ``shard``; ``slot``
    is the place in the shard.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    body = F.struct(
        docs[id_col].alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.struct(F.lit(True).alias("_"), *[docs[c] for c in carry]).alias("more"),
    )
    shuffled = F.md5(F.concat_ws("-", F.lit(str(seed)), docs[id_col].cast("string")))
    rows = docs.select(
        docs[source_col].alias("stratum"),
        shuffled.alias("draw"),
        docs[id_col].alias("id"),
        body["text_crc32"].alias("crc"),
        body.alias("row"),
    )
    order = ["stratum", "draw", "id", "crc"]
    ranked = numbered(rows, order, "place", "all_rows").drop("all_rows")
    strata = ranked.groupBy(F.col("stratum").alias("name")).agg(
        F.min("place").alias("begin"), F.count("*").alias("members")
    )
    spread = ranked.join(
        strata, ranked["stratum"].eqNullSafe(strata["name"])
    ).withColumn(
        "fraction",
        (2 * (F.col("place") - F.col("begin")) + 1).cast("double")
        / (2 * F.col("members")),
    )
    spread = spread.select("fraction", *order, "row")
    placed = numbered(spread, ["fraction", *order], "place", "all_rows")
    shard = F.expr(f"(place * {shards}) div all_rows")
    begin = F.expr(f"(shard * all_rows + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "row.doc_id",
        "row.size",
        "row.text_crc32",
        F.col("stratum").alias("source"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - begin).alias("slot"),
        *[F.col("row.more")[c].alias(c) for c in carry],
    )
