"""A training corpus from raw documents: five stages, each over all that the last kept.

Every stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
documents. A stage first removes the working tables of the stage before, whose result
is written by then. An empty table goes through all stages and gives no pieces. Columns
beyond those of documents go along in all but the last, whatever their names, but for
the five that begin with an underscore here.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rolecall.llm.decontamination import decontaminate
from rolecall.llm.identity import distinct_ids
from rolecall.llm.language_id import UNDETERMINED, has_letter, learn, with_language
from rolecall.llm.line_dedup import dedup_lines
from rolecall.llm.ngram_join import ngram_components
from rolecall.llm.packing import pack_documents
from rolecall.llm.scratch import forget, written


# What a task hands to its Python worker at a time: whole texts are large rows.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def _begin(spark: SparkSession) -> None:
    """Remove the last stage's working tables, and bound the session's Arrow batches."""
    forget(spark)
    for name, value in BATCH.items():
        spark.conf.set(name, value)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without text, go; missing labels are filled in.

    If no language could be learnt, all documents with a letter stay, labels as they are.
    """
    _begin(spark)
    network = learn(docs)
    if not network.languages:
        return docs.where(has_letter(docs["text"]))
    found = with_language(docs, network, into="_language")
    kept = found.where(F.col("_language.lang_pred") != UNDETERMINED)
    lang = F.coalesce("lang", "_language.lang_pred")
    return kept.withColumn("lang", lang).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document id holds go; the text's length follows."""
    _begin(spark)
    found = dedup_lines(docs, into="_lines").withColumn("text", F.col("_lines.kept"))
    length = F.char_length("text").cast("long")
    return found.withColumn("n_chars", length).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of linked documents stays; so do rows without id.

    Documents link when their sets of five-word shingles are similar by 0.8 or more;
    op9's four words and 85 % are that query's own. Of rows equal in id and text, the
    least by its other columns stays; rows that share an id but not the text are
    documents of their own, in the order of their texts' digests.
    """
    _begin(spark)
    named = distinct_ids(docs.where("doc_id IS NOT NULL"), "doc_id", "text", "_document")
    groups = ngram_components(named, "_document", size=5, percent=80)
    stay = groups.where("component_id = doc_id").select(F.col("doc_id").alias("_stays"))
    kept = named.join(stay, F.col("_document") == F.col("_stays"), "left_semi")
    row = F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("_row")
    kept = kept.groupBy("_document").agg(row).select("_row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    _begin(spark)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, bench, into="_hits")
    return found.where("_hits.n_hit = 0").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids."""
    _begin(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(docs, path, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Training, similarity and tokens are beyond SQL; tests hold the stages against
# brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}", lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
