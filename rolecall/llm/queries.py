"""The queries of this subpackage and their SQL, for the registry at the top."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rolecall.llm.decontamination import decontaminate
from rolecall.llm.filter_audit import filter_audit
from rolecall.llm.language_id import held_out, learn, with_language
from rolecall.llm.line_dedup import dedup_lines
from rolecall.llm.ngram_join import ngram_components
from rolecall.llm.packing import pack_documents
from rolecall.llm.pii import KINDS, with_personal_data
from rolecall.llm.scratch import written
from rolecall.llm.sharding import stratified_shards
from rolecall.llm.substring_dedup import dedup_passages
from rolecall.llm.suffix_dedup import dedup_substrings
from rolecall.llm.token_output import packed_matrices
from rolecall.llm.topk_search import exact_top_k
from rolecall.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_documents(spark, sf_dir)).select(
        "doc_id",
        "lines.n_lines",
        "lines.n_dropped",
        F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"),
    )


def _sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(_documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = _table(spark, sf_dir, "benchmark")
    found = decontaminate(_documents(spark, sf_dir), bench)
    items = F.array_join("contamination.items", ",").cast("binary")
    return found.select(
        "doc_id",
        "contamination.n_words",
        "contamination.n_hit",
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (F.col("contamination.n_hit") > 0).alias("contaminated"),
    )


def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(_documents(spark, sf_dir), path, keep_ids=False)


def _token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    matrices = written(packed_matrices(_documents(spark, sf_dir), path), "matrices")
    segments = matrices.select(
        "sequence_id",
        "ids",
        F.posexplode(F.arrays_zip("doc_ids", "starts", "doc_tokens")).alias("i", "piece"),
        F.expr("cu_seqlens[i]").alias("offset"),
        F.expr("cu_seqlens[i + 1] - cu_seqlens[i]").alias("length"),
    )
    ids = F.expr("substring(ids, cast(4 * offset + 1 as int), cast(4 * length as int))")
    return segments.select(
        F.col("piece.doc_ids").alias("doc_id"),
        F.col("piece.starts").alias("start"),
        "length",
        F.crc32(ids).alias("ids_crc32"),
        F.col("piece.doc_tokens").alias("doc_tokens"),
        "sequence_id",
        "offset",
    )


def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return with_language(docs, learn(docs)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "language.lang_pred",
        "language.score",
    )


def _ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_documents(spark, sf_dir))


def _substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(_documents(spark, sf_dir)).select(
        "doc_id",
        "passages.n_words",
        "passages.n_removed",
        F.sha2(F.col("passages.kept").cast("binary"), 256).alias("kept_sha256"),
    )


def _top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def _personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_personal_data(_documents(spark, sf_dir))
    base = F.filter("personal", lambda s: s["base"])

    def listed(spans):
        texts = F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])
        )
        return F.array_join(texts, ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("personal")).alias("spans"),
    )


def _suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_documents(spark, sf_dir)).select(
        "doc_id",
        "substrings.n_bytes",
        "substrings.n_removed",
        "substrings.n_spans",
        F.sha2("substrings.kept", 256).alias("kept_sha256"),
    )


def _whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(_table(spark, sf_dir, "embeddings"), into="white")
    each = white.select("vec_id", "white", F.explode("white.components").alias("one"))
    return each.select(
        "vec_id",
        "one.component",
        "white.n",
        "white.deviation",
        "one.whitened",
        "one.explained",
        "white.identity_error",
    )


def _filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": _line_dedup,
    "op2_exact_top_k": _top_k,
    "op3_substring_dedup": _substring_dedup,
    "op4_personal_data": _personal_data,
    "op5_stratified_sharding": _sharding,
    "op6_hilbert_packing": _packing,
    "op7_decontamination": _decontamination,
    "op8_language_id": _language,
    "op9_ngram_join": _ngram_join,
    "op10_token_matrices": _token_output,
    "op11_suffix_dedup": _suffix_dedup,
    "op12_whitening": _whitening,
    "op13_filter_audit": _filter_audit,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH split AS (
          SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), lines AS (
          SELECT doc_id, unnest(lines) AS line,
                 unnest(range(1, len(lines) + 1)) AS pos FROM split
        ), keyed AS (
          SELECT *, translate(
                   trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM lines
        ), firsts AS (
          SELECT key, MIN(doc_id) AS first_doc FROM keyed
          WHERE length(key) >= 10 GROUP BY key
        ), judged AS (
          SELECT k.doc_id, k.pos, k.line,
                 f.first_doc IS NULL OR f.first_doc = k.doc_id AS kept
          FROM keyed k LEFT JOIN firsts f ON k.key = f.key
        )
        SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE NOT kept) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                               FILTER (WHERE kept), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    # crc32 from its definition: the table of 256 remainders, then one step a byte.
    "op5_stratified_sharding": r"""
        WITH steps AS (
          SELECT list(CAST(list_reduce(
                   [i, 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384)
                                     ELSE c // 2 END) AS BIGINT) ORDER BY i) AS remainders
          FROM range(0, 256) t(i)
        ), sized AS (
          SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
                 xor(list_reduce(
                   list_prepend(4294967295, list_transform(
                     regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                     lambda h: CAST('0x' || h AS BIGINT))),
                   lambda c, b: xor(c // 256,
                     steps.remainders[xor(c % 256, b) + 1])), 4294967295) AS text_crc32
          FROM documents, steps
        ), ranked AS (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY source
                   ORDER BY md5('42-' || doc_id), doc_id) AS place,
                 COUNT(*) OVER (PARTITION BY source) AS members,
                 md5('42-' || doc_id) AS draw
          FROM sized
        ), placed AS (
          SELECT *, ROW_NUMBER() OVER (
                   ORDER BY CAST(2 * place - 1 AS DOUBLE) / (2 * members),
                            source NULLS FIRST, draw, doc_id) - 1 AS idx,
                 COUNT(*) OVER () AS total
          FROM ranked
        )
        SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
               CAST(idx * 8 // total AS INT) AS shard,
               idx - (idx * 8 // total * total + 7) // 8 AS slot,
               CAST(NULL AS INT) AS grown_shard, source
        FROM placed""",
    "op7_decontamination": r"""
        WITH doc_words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
        ), item_words AS (
          SELECT CAST(item_id AS VARCHAR) AS item,
                 regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
        ), windows AS (
          SELECT DISTINCT item, size,
                 array_to_string(words[pos : pos + size - 1], ' ') AS run
          FROM (SELECT item, words, least(len(words), 10) AS size,
                       unnest(range(1, len(words) - least(len(words), 10) + 2)) AS pos
                FROM item_words WHERE len(words) > 0)
        ), places AS (
          SELECT doc_id, size, pos,
                 array_to_string(words[pos : pos + size - 1], ' ') AS run
          FROM (SELECT doc_id, words, size,
                       unnest(range(1, len(words) - size + 2)) AS pos
                FROM doc_words, (SELECT DISTINCT size FROM windows)
                WHERE len(words) >= size)
        ), hits AS (
          SELECT doc_id, pos, size, item FROM places JOIN windows USING (size, run)
        ), words_hit AS (
          SELECT doc_id, COUNT(DISTINCT word) AS n_hit FROM (
            SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM hits)
          GROUP BY doc_id
        ), items_hit AS (
          SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
               coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)""",
    "op9_ngram_join": r"""
        WITH RECURSIVE worded AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS words FROM documents
        ), shingled AS (
          SELECT DISTINCT doc_id, array_to_string(words[pos : pos + 3], ' ') AS shingle
          FROM (SELECT doc_id, words,
                       unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS pos
                FROM worded WHERE len(words) > 0)
        ), sized AS (
          SELECT doc_id, COUNT(*) AS n FROM shingled GROUP BY doc_id
        ), meetings AS (
          SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS shared
          FROM shingled x JOIN shingled y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
          GROUP BY 1, 2
        ), links AS (
          SELECT a, b FROM meetings
          JOIN sized s ON s.doc_id = a JOIN sized t ON t.doc_id = b
          WHERE 100 * shared >= 85 * (s.n + t.n - shared)
        ), both_ways AS (
          SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reached AS (
          SELECT doc_id AS a, doc_id AS b FROM sized
          UNION SELECT r.a, w.b FROM reached r JOIN both_ways w ON r.b = w.a
        )
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles,
               coalesce(MIN(r.b), d.doc_id) AS component_id,
               (SELECT COUNT(*) FROM both_ways w WHERE w.a = d.doc_id) AS n_links
        FROM documents d LEFT JOIN sized s USING (doc_id)
        LEFT JOIN reached r ON r.a = d.doc_id
        GROUP BY d.doc_id, s.n""",
    "op3_substring_dedup": r"""
        WITH worded AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
          FROM documents
        ), places AS (
          SELECT doc_id, pos, array_to_string(words[pos : pos + 19], ' ') AS run
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos
                FROM worded WHERE len(words) >= 20)
        ), later AS (
          SELECT doc_id, pos FROM places
          QUALIFY ROW_NUMBER() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1
        ), removed AS (
          SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM later
        ), single AS (
          SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos
          FROM worded
        ), kept AS (
          SELECT doc_id, COUNT(*) AS n, string_agg(word, ' ' ORDER BY pos) AS body
          FROM single ANTI JOIN removed USING (doc_id, pos) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
               len(words) - coalesce(n, 0) AS n_removed,
               sha256(coalesce(body, '')) AS kept_sha256
        FROM worded LEFT JOIN kept USING (doc_id)""",
    "op2_exact_top_k": r"""
        WITH scaled AS (
          SELECT vec_id, list_transform(embedding,
                   lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.v, c.v),
                   lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM scaled q JOIN scaled c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(ROW_NUMBER() OVER best AS INT) AS rank, vec_id, score
        FROM scored
        WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY ROW_NUMBER() OVER best <= 5""",
    "op13_filter_audit": r"""
        WITH texts AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
        ), worded AS (
          SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'),
                                lambda w: w <> '') AS words FROM texts
        ), judged AS (
          SELECT doc_id, part,
            CAST(len(words) < 200 AS INT)
            + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
            + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g'))
                       > 3 * length(t) AS INT)
            + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
            + 16 * CAST(coalesce(doc_id > MIN(doc_id) OVER (PARTITION BY t), FALSE) AS INT)
            AS fails FROM worded
        ), told AS (
          SELECT doc_id, MAX(CAST(quality = 1 AS INT)) AS good,
                 MAX(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
        ), patterns AS (
          SELECT part, fails, COUNT(*) AS n, SUM(coalesce(good, 0)) AS good,
                 SUM(coalesce(toxic, 0)) AS toxic
          FROM judged LEFT JOIN told USING (doc_id) GROUP BY part, fails
        ), letters AS (
          SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit
        ), orders AS (
          SELECT a.name || b.name || c.name || d.name || e.name AS filter_order,
                 [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
          FROM letters a, letters b, letters c, letters d, letters e
          WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
        ), steps AS (
          SELECT filter_order, unnest(range(1, 6)) AS step, unnest(bits) AS bit,
                 bits FROM orders
        ), prefixed AS (
          SELECT filter_order, step, bit,
                 CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM steps
        ), counted AS (
          SELECT part, filter_order, step, bit,
            SUM(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
            SUM(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN n ELSE 0 END)
              AS removed,
            SUM(CASE WHEN fails & bit <> 0 AND fails & before <> 0 THEN n ELSE 0 END)
              AS redundant,
            SUM(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
            SUM(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN good ELSE 0 END)
              AS good_lost,
            SUM(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN toxic ELSE 0 END)
              AS toxic_lost
          FROM patterns, prefixed GROUP BY part, filter_order, step, bit
        )
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept,
               CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(SUM(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM counted""",
}
