"""The pipeline's stages, each against a brute-force version on its own input."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rolecall.llm.language_id import held_out
from test_llm_operators import _brute_components, _brute_hits, _brute_lines, _sentence


def _rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_take_effect_and_lose_nothing_else(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    extra = spark.createDataFrame(
        [(10_001, None, None), (10_002, "12 34 !", "en")], "doc_id long, text string, lang string"
    ).selectExpr("doc_id", "text", "lang", "cast(null as string) source", "7L n_chars")
    docs = docs.unionByName(extra)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = _rows(docs)
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after = _rows(docs)
            assert docs.count() == len(after)
        texts = [(i, r.text) for i, r in before.items()]
        if name == "language_id":
            assert before.keys() - after.keys() == {10_001, 10_002}
        elif name == "line_dedup":
            want = {i: kept for i, _, _, kept in _brute_lines(texts)}
            assert {i: r.text for i, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "ngram_join":
            want = {doc for doc, _, group, _ in _brute_components(texts) if doc == group}
            assert after.keys() == want and all(after[i] == before[i] for i in after)
        elif name == "decontamination":
            want = {i for i, text in texts if not _brute_hits(text, bench, 10)[1]}
            assert after.keys() == want and all(after[i] == before[i] for i in after)
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            total = {}
            for r in docs.collect():
                total[r.doc_id] = total.get(r.doc_id, 0) + r.length
            for i, text in texts:
                ids = tokenizer.encode(text or "", add_special_tokens=False).ids
                assert total.pop(i) == len(ids) + 1
            assert not total


def _five_word_components(rows):
    sets = {}
    for doc, text in rows:
        words = text.lower().split()
        size = min(5, len(words))
        sets[doc] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    group = {doc: doc for doc in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return group


def test_near_copies_go_by_five_words_and_four_fifths(spark, small):
    rng = random.Random(8)
    rows = []
    for _ in range(30):
        base = _sentence(rng, 104)
        rows += [base, base + " " + _sentence(rng, rng.choice([15, 18, 20, 25, 26, 40]))]
        words = base.split()
        for at in rng.sample(range(104), rng.randint(1, 3)):
            words[at] = "edited"
        rows.append(" ".join(words))
    rows = list(enumerate(rows))
    assert any(len(text.split()) == 124 for _, text in rows)  # 100 of 120 shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, small).collect()}
    groups = _five_word_components(rows)
    assert got == {doc for doc, group in groups.items() if doc == group}


def test_documents_stay_if_no_language_was_learnt(spark, small):
    rows = [(i, t) for i, t in enumerate([None, "", "12 !?", "ß", "the end", "x1"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bare = docs.selectExpr("*", "cast(null as string) lang")
    out = corpus_pipeline.keep_known_languages(spark, bare, small)
    assert out.columns == bare.columns
    assert sorted((r.doc_id, r.lang) for r in out.collect()) == [(i, None) for i in (3, 4, 5)]
    # Labels on held-out rows alone teach nothing, and stay.
    label = F.when(held_out(F.col("doc_id")), F.lit("zz"))
    many = spark.range(40).selectExpr("id doc_id", "'some text' text").withColumn("lang", label)
    kept = corpus_pipeline.keep_known_languages(spark, many, small)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, many.collect()))


def test_near_copies_among_rows_that_share_an_id(spark, small):
    rng = random.Random(9)
    a, b, c = (_sentence(rng, 60) for _ in range(3))
    rows = [(1, a, "x"), (5, a + " more", "x"), (5, b, "y"), (5, b, "x"), (7, b, "x"), (9, None, "z"),
            (9, "", "a"), (None, c, "x"), (None, c, "x"), (8, c, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.drop_near_copies(spark, docs, small)
    assert out.columns == docs.columns
    got = sorted((str(r.doc_id), r.text or "", r.source) for r in out.collect())
    assert got == sorted([("1", a, "x"), ("5", b, "x"), ("9", "", "z"), ("None", c, "x"),
                          ("None", c, "x"), ("8", c, "x")])


def test_no_documents_and_clashing_names(spark, small, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the cat sat on the mat", "en", "s", 22), (1, "der hund", "de", "s", 8),
            (1, "der hund", "de", "s", 8), (None, None, None, None, None)]
    for k, table in enumerate(([], rows)):
        docs = spark.createDataFrame(table, schema)
        docs = docs.selectExpr("*", "1 AS holder", "'w' AS word", "2 AS doc", "3 AS n", "4 AS key")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            if name != "packing":
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        assert {r.doc_id for r in docs.collect()} == ({1} if table else set())


def test_run_equals_the_stages(spark, small):
    pieces = corpus_pipeline.run(spark, small).collect()
    assert pieces and {r.sequence_id for r in pieces} == set(
        range(1 + max(r.sequence_id for r in pieces))
    )
