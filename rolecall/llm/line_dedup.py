"""Line deduplication over all documents, with DataFrame functions only.

Every line of a document gets a key: the line without ASCII white space at its ends,
A-Z lower-cased. A key of at least ``min_chars`` code points that several documents
hold loses its lines everywhere but in the smallest document id.

Hashes of keys are range-partitioned with a secondary sort by document and position,
and the first holder is read off the sorted stream. That runs twice, since one line may
stand in a third of all documents: first among the documents of one salt, then among
the first holders of all salts. A line that is not first in its salt is not first at
all, so every line is decided, and no task sees more than one salt of a hot key. What
comes back for a document is not text but a bitmap of the lines to keep, 64 lines to a
word, without the words that keep all.

Defined results: a null text is one empty line; a row without id keeps all its lines
and decides nothing; rows that share an id are one document, so they don't take lines
from each other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rolecall.llm.text import UPPER, LOWER, WHITE


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(WHITE))
    # lower() changes letters beyond A-Z too, so it serves for ASCII lines only.
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _not_first(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of the first document of each group of ``keys``, and the others."""
    stream = Window.partitionBy(*keys).orderBy("id", "version", "pos")
    placed = rows.repartitionByRange(*keys).withColumn(
        "first_id", F.first("id").over(stream)
    )
    first = F.col("id") == F.col("first_id")
    return placed.where(first).drop("first_id"), placed.where(~first).drop("first_id")


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10
) -> DataFrame:
    """id, version (hash of the text), words: {word, bits} with 1 for a line to keep.

    Words that are absent keep all their lines; so do absent documents.
    """
    text = docs[text_col]
    lines = docs.where(docs[id_col].isNotNull()).select(
        docs[id_col].alias("id"),
        F.xxhash64(text).alias("version"),
        F.posexplode(_lines(text)).alias("pos", "line"),
    )
    key = line_key(F.col("line"))
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.where(F.char_length(key) >= min_chars).select(
        F.xxhash64(key).alias("hash_a"),
        F.xxhash64(F.lit("second half"), key).alias("hash_b"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"),
        "id",
        "version",
        "pos",
    )
    led, lost = _not_first(rows, ["hash_a", "hash_b", "salt"])
    _, beaten = _not_first(led.drop("salt"), ["hash_a", "hash_b"])
    where = ["id", "version"]
    dropped = lost.select(*where, "pos").unionByName(beaten.select(*where, "pos"))
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    return (
        dropped.groupBy(*where, F.expr("pos div 64").alias("word"))
        .agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
        .groupBy(*where)
        .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    )


def _flags() -> Column:
    """words, spread to one 0 or 1 for each line up to the last word."""
    dense = F.expr(
        """flatten(transform(words, (w, i) -> concat(
             array_repeat(-1L, cast(w.word - if(i = 0, -1L, words[i - 1].word) - 1 as int)),
             array(w.bits))))"""
    )
    bits = F.sequence(F.lit(0), F.lit(63))
    return F.flatten(
        F.transform(
            dense,
            lambda w: F.transform(bits, lambda b: F.getbit(w, b)),
        )
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    into: str = "lines",
) -> DataFrame:
    """``docs`` with a column ``into`` of {n_lines, n_dropped, kept}.

    All columns of ``docs`` stay as they are, but one named ``into`` is replaced.
    """
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns if c != into]).alias("row"),
        docs[id_col].alias("doc"),
        F.xxhash64(docs[text_col]).alias("hash"),
        docs[text_col].alias("body"),
    )
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars)
    joined = rows.join(
        bitmaps,
        (rows["doc"] == bitmaps["id"]) & (rows["hash"] == bitmaps["version"]),
        "left",
    )
    lines = _lines(F.col("body"))
    kept = F.filter(
        F.arrays_zip(lines.alias("line"), _flags().alias("flag")),
        lambda z: z["line"].isNotNull() & (F.coalesce(z["flag"], F.lit(1)) == 1),
    )
    kept = F.transform(kept, lambda z: z["line"])
    kept = F.when(F.col("words").isNull(), lines).otherwise(kept)
    return joined.select(
        "row.*",
        F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"),
            F.array_join(kept, "\n").alias("kept"),
        ).alias(into),
    )
