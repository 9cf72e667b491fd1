"""Edge cases of every operator, and results against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from rolecall.llm import language_id, pii, queries
from rolecall.llm.components import components
from rolecall.llm.decontamination import decontaminate
from rolecall.llm.line_dedup import dedup_lines
from rolecall.llm.ngram_join import linked, ngram_components
from rolecall.llm.sharding import stratified_shards
from rolecall.llm.substring_dedup import dedup_passages
from rolecall.llm.text import Words
from rolecall.llm.topk_search import Best, Queries, distances, exact_top_k, scores

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def connection(medium):
    with duckdb.connect() as open_connection:
        for name in ("documents", "embeddings", "benchmark", "labels"):
            open_connection.execute(
                f"CREATE VIEW {name} AS SELECT * FROM '{medium}/{name}.parquet'"
            )
        yield open_connection


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_oracle(spark, medium, connection, name):
    frame = queries.QUERIES[name](spark, medium)
    assert compare.differences(frame, connection, queries.ORACLES[name]) is None


def _docs(spark, texts, ids=None, **more):
    """Documents with columns whose names could clash with an operator's own."""
    rows = list(zip(ids or range(len(texts)), texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clash = {"id": 7, "hash": "x", "pos": 1, "doc": 2, "row": 3, "key": 4, "n": 5}
    clash |= {"words": 1, "source": None, "lang": None, "body": "b", "t": 1} | more
    return frame.withColumns({k: F.lit(v) for k, v in clash.items()})


def _sentence(rng, n, words=WORDS):
    return " ".join(rng.choices(words, k=n))


EDGES = [None, "", "\n", " \n\t\n", "A" * 40, "a" * 40 + "  ", "x\n" * 3000, "é" * 12]


def _brute_lines(rows, least=10):
    def key(line):
        bare = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in bare)

    firsts = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least:
                firsts[key(line)] = min(doc, firsts.get(key(line), doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or firsts.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    pool = [_sentence(rng, 4) for _ in range(40)] + ["short", "ÉTÉ long enough", "été long enough"]
    texts = EDGES + ["\n".join(rng.choices(pool, k=rng.randint(1, 200))) for _ in range(60)]
    ids = [*range(len(texts) - 1), None]
    rows = list(zip(ids, texts)) + [(3, texts[3]), (20, texts[20])]
    frame = _docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = dedup_lines(frame).selectExpr(
        "doc_id", "lines.n_lines", "lines.n_dropped", "lines.kept"
    )
    assert sorted(map(tuple, got.collect()), key=str) == _brute_lines(rows)
    assert set(frame.columns) <= set(dedup_lines(frame).columns)


def test_shards_are_even_and_mixed(spark):
    texts = [None, "", *(f"text {i % 7}" for i in range(998))]
    docs = _docs(spark, texts).withColumn(
        "source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.expr("if(doc_id % 5 = 0, null, 'b')"))
    )
    docs = docs.unionByName(docs.where("doc_id < 4"))
    rows = stratified_shards(docs, carry=["text", "hash"]).collect()
    assert len(rows) == 1004 and rows[0].hash == "x"
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.size == len((r.text or "").encode()) + 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    mixed = Counter((r.shard, r.source) for r in rows)
    for source in ("hot", "b", None):
        each = [mixed[shard, source] for shard in range(8)]
        assert max(each) - min(each) <= 2
    assert stratified_shards(docs.where("false")).count() == 0


def _brute_passages(rows, window):
    seen, out = set(), []
    cover = defaultdict(set)
    for doc, text in sorted(r for r in rows if r[0] is not None):
        words = (text or "").split()
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if run in seen:
                cover[doc].update(range(i, i + window))
            seen.add(run)
    for doc, text in rows:
        words = (text or "").split()
        kept = [w for i, w in enumerate(words) if doc is None or i not in cover[doc]]
        out.append((doc, len(words), len(words) - len(kept), " ".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, base", [(8, 4), (8, 2), (20, 10)])
def test_passages_against_brute_force(spark, window, base):
    rng = random.Random(window + base)
    passages = [_sentence(rng, rng.randint(5, 60)) for _ in range(12)]
    texts = [None, "", "a " * 300, "a " * 300, _sentence(rng, 7), passages[0], passages[0]]
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else _sentence(rng, 30) for _ in range(4)]
        texts.append(" \n".join(parts))
    texts += texts[10:14]
    rows = list(zip([*range(len(texts) - 1), None], texts))
    frame = _docs(spark, texts, [i for i, _ in rows])
    got = dedup_passages(frame, window=window, base=base).selectExpr(
        "doc_id", "passages.n_words", "passages.n_removed", "passages.kept"
    )
    assert sorted(map(tuple, got.collect()), key=str) == _brute_passages(rows, window)


def test_hashes_tell_words_apart():
    morse = [bin(i).count("1") & 1 for i in range(4096)]
    words = [f"{a}{i}{b}" for i in range(20_000) for a, b in [("", ""), ("é", "x" * 9), ("x" * 40, "")]]
    for size in (8, 16, 24, 32, 33, 64, 1024, 4096):
        words += ["".join("ab"[m ^ flip] for m in morse[:size]) for flip in (0, 1)]
    found = Words(" ".join(words)).hashes
    assert len(set(found.tolist())) == len(set(words)) == len(words)
    # A word's hash is its own, wherever it stands.
    again = Words("  ".join(reversed(words)) + "\n")
    assert (again.hashes[::-1] == found).all()
    assert len(Words(None)) == len(Words("")) == len(Words(" \t")) == 0


def _brute_components(rows, percent=85):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        size = min(4, len(words))
        sets[doc] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    group, links = {doc: doc for doc in sets}, Counter()
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                links.update([a, b])
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return sorted((doc, len(sets[doc]), group[doc], links[doc]) for doc in sets)


def test_ngram_components_against_brute_force(spark, monkeypatch):
    from rolecall.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # so that clusters are cut
    rng = random.Random(5)
    common = _sentence(rng, 30)
    texts = [None, "", " ", "one", "ONE", "one two", "a b c d", "A B C D e"]
    for _ in range(12):
        base = (common + " " + _sentence(rng, rng.randint(5, 150))).split()
        for _ in range(rng.randint(1, 20)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += texts[3:12]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    frame = _docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = sorted(map(tuple, ngram_components(frame).collect()))
    assert got == _brute_components(rows)
    empty = ngram_components(frame.where("false"))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert empty.count() == 0


def test_links_of_shared_and_missing_ids(spark):
    a = " ".join(WORDS[:40])
    b, other = a + " x", " ".join(WORDS[100:140])
    rows = [(1, a), (1, a), (2, b), (3, b), (3, other), (4, other), (None, a), (5, None), (6, "lone")]
    frame = _docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = ngram_components(frame).collect()
    # A row without id has a class, but is nobody's link.
    found = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.n_links) for r in got)
    assert found == [
        ("1", 37, 1, 3),
        ("1", 37, 1, 3),
        ("2", 38, 1, 3),
        ("3", 37, 3, 1),
        ("3", 38, 1, 3),
        ("4", 37, 3, 1),
        ("5", 0, 5, 0),
        ("6", 1, 6, 0),
        ("None", 37, 1, None),
    ]


def test_block_search_finds_what_links_join():
    rng = np.random.default_rng(3)

    def joined(n, links):
        group = list(range(n))
        for a, b in links:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
        return group

    for _ in range(30):
        bases = [rng.integers(0, 400, rng.integers(1, 60)) for _ in range(6)]
        sets = []
        for _ in range(50):
            base = bases[rng.integers(6)].copy()
            base[rng.integers(0, len(base), rng.integers(0, 4))] = rng.integers(0, 400)
            sets.append(np.unique(base.astype(np.uint64)))
        blocks = rng.integers(0, 2, len(sets))
        true = [
            (i, j)
            for i in range(len(sets))
            for j in range(i)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))
        ]
        across = [(i, j) for i, j in true if blocks[i] != blocks[j]]
        for want, cut in [(true, None), (across, blocks)]:
            links, spanning = (x.tolist() for x in linked(sets, 85, cut))
            assert sorted(sorted(x) for x in links) == sorted(sorted(x) for x in want)
            assert joined(50, want) == joined(50, spanning)


def test_components_of_paths_stars_and_nothing(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 400)]
    links = spark.createDataFrame([*path, *star, (5, 5), (140, 7)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert set(found) == {7, *range(100, 141), *range(200, 400)}
    assert set(found.values()) == {7}
    assert components(links.where("false")).count() == 0


def _brute_hits(text, items, window):
    def words(x):
        lowered = (x or "").translate({i: i + 32 for i in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    mine, hit, names = words(text), set(), set()
    for item, body in items:
        theirs = words(body)
        size = min(window, len(theirs))
        for i in range(len(theirs) - size + 1) if size and item is not None else ():
            for j in range(len(mine) - size + 1):
                if mine[j : j + size] == theirs[i : i + size]:
                    hit.update(range(j, j + size))
                    names.add(str(item))
    return len(mine), len(hit), sorted(names)


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    from rolecall.llm import decontamination

    def few_hashes(hashes, length):
        return np.full(max(0, len(hashes) - length + 1), length, np.uint64)

    monkeypatch.setattr(decontamination, "runs", few_hashes)
    items = [("1", "a b c d"), ("2", "x y"), ("3", "b c d e f g"), ("4", "A-b, c D")]
    texts = ["a b c d e", "x", "q x Y z a b c", "b c d e f g b c d e f g h", "", None]
    index = decontamination.Index(items, 4)
    index.choose_prefixes({})
    for text in texts:
        n, spans, names = index.hits(text)
        n_hit = int((spans[:, 1] - spans[:, 0]).sum())
        assert (n, n_hit, names) == _brute_hits(text, items, 4)


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_decontamination_against_brute_force(spark, block_bytes):
    rng = random.Random(9)
    few = WORDS[:6]
    items = [(i, _sentence(rng, rng.randint(1, 25), few if i % 3 else WORDS)) for i in range(20)]
    items += [(3, items[5][1]), (None, items[1][1]), (77, None), (78, "?!"), (79, "é X-ray 9")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [None, "", "É é X, ray 9 x RAY", items[0][1].upper()]
    for _ in range(60):
        item = rng.choice(items[:20])[1].split()
        cut = item[rng.randint(0, 3) :]
        texts.append(_sentence(rng, 20, few) + "; " + " ".join(cut) + "\n" + _sentence(rng, 9))
    frame = _docs(spark, [*texts, texts[5]], [*range(len(texts)), 5])
    got = decontaminate(frame, bench, window=10, block_bytes=block_bytes).selectExpr(
        "doc_id", "contamination.n_words", "contamination.n_hit", "contamination.items"
    )
    want = [(i, *_brute_hits(t, items, 10)) for i, t in enumerate(texts)]
    want.append((5, *want[5][1:]))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    none = decontaminate(frame, bench.where("false"))
    assert none.where("contamination.n_hit > 0").count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_against_brute_force(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8) * scale]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 330)]  # a common vector
    rows += [(400, None), (450, [1.0, None]), (500, [float("nan")] * 8), (None, rows[0][1])]
    rows += [(550, [float("inf")] * 8), (600, []), (650, [1.5, -2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    frame = frame.withColumns({"id": F.lit(1), "v": F.lit(2), "pivot": F.lit(3)})
    used = {
        i: [int(np.floor(256 * x)) for x in v] + [0] * (8 - len(v))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    }
    want = []
    for q in (i for i in used if i % 50 == 0):
        score = {c: sum(a * b for a, b in zip(used[q], used[c])) for c in used if c != q}
        best = sorted(score, key=lambda c: (-score[c], c))[:5]
        want += [(q, rank + 1, c, min(score[c], (1 << 63) - 1)) for rank, c in enumerate(best)]
    got = exact_top_k(frame, pivots=16, block=3).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    for none in (frame.where("false"), frame.where("vec_id = 7")):  # no row, and no query
        empty = exact_top_k(none)
        assert empty.columns == got.columns and empty.count() == 0


def test_groups_of_vectors_are_not_all_scored():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32)) * 60
    rows = np.floor(centres[rng.integers(0, 60, 30_000)] + rng.normal(size=(30_000, 32)) * 5)
    ids, pivots = np.arange(len(rows)), rows[:128]
    far = distances(rows, pivots)
    order = np.lexsort((ids, far.min(axis=1), far.argmin(axis=1)))
    pivot, distance = far.argmin(axis=1)[order], far.min(axis=1)[order]
    ids, rows, squares = ids[order], rows[order], (rows[order] ** 2).sum(axis=1)
    most = np.array([squares[pivot == p].max(initial=-1) for p in range(len(pivots))])
    asked = np.flatnonzero(ids % 50 == 0)
    asked = asked[np.argsort(pivot[asked], kind="stable")][:100]  # neighbours, as in a block
    product = rows[asked] @ rows.T
    product[np.arange(len(asked)), asked] = -np.inf
    fifth = np.sort(product, axis=1)[:, -5].astype(np.int64)
    for to_beat, share in [(None, 0.2), (fifth, 0.1)]:
        best = Best(Queries(ids[asked], rows[asked], pivots, 5, to_beat))
        best.search(pivot, distance, ids, squares, rows)
        assert best.scored < share * len(asked) * len(rows)
        assert (best.scores[:, -1] == fifth).all()
    read = np.zeros(len(rows), bool)
    for p, low, high in Queries(ids[asked], rows[asked], pivots, 5, fifth).ranges(most):
        read |= (pivot == p) & (low <= distance) & (distance <= high)
    assert read.mean() < 0.5 and read[(product >= fifth[:, None]).any(axis=0)].all()


def test_top_k_of_vectors_beyond_squares(spark):
    rows = [(50, [0.0, 1.0]), (1, [1e300, 2.0]), (2, [0.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_top_k(frame).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == [(50, 1, 2, 768 << 8), (50, 2, 1, 512 << 8)]


def test_scores_beyond_64_bits_raise():
    rows = np.full((2, 3), 1e12)
    with pytest.raises(OverflowError):
        scores(rows, rows)
    assert scores(np.full((1, 3), 1e9), np.full((2, 3), -1e9)).tolist() == [[-3 * 10**18] * 2]
    assert scores(rows, rows[:0]).shape == (2, 0)


_PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _brute_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(_PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(2)
    alphabet = "ab1279.@+-() %é\n"
    cases = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(4000)]
    cases += [None, "", "a@b.c_d@e.f@g.h.i", "1.2.3.4.5.6.7.8", "0300.1.1.1 256.1.1.1", "é" * 9 + "x@y.zz"]
    cases += ["4539 1488 0343 6467", "+1 (017) 555-7713", "4539148803436467 4539148803436467"]
    for text in cases:
        assert pii.base_spans(text) == _brute_spans(text), text


def test_long_runs_are_read_in_linear_time():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "1 " * 200_000, "+" * 400_000, "a@" * 200_000):
        pii.added_spans(text, pii.base_spans(text))


def test_the_model_labels_repeats_and_leaves_others_alone():
    text = "call +1 (017) 555-7713 or 10175557713 now; order 8812345, card 4539148803436467 2024"
    base = pii.base_spans(text)
    added = [(text[a:b], pii.KINDS[k]) for a, k, b in pii.added_spans(text, base)]
    assert added == [("10175557713", "phone")]
    assert pii.added_spans("lone number 10175557713", []) == []


@pytest.mark.parametrize("copies", [1, 3, 4, 5, 13, 40, 100, 1000])
@pytest.mark.parametrize(
    "base, form",
    [
        ("+1 (017) 555-7713", "10175557713"),
        ("+1 (017) 555-7713", "5557713"),
        ("+1 (017) 555-7713", "555 7713"),
        ("+1 (017) 555-7713", "(017) 555 7713"),
        ("+1 (017) 555-7713", "017 555 - 7713"),
        ("4539148803436467", "4539  1488  0343 6467"),
        ("jo.doe@some-site.org", "jo_doe@some-site/org"),
    ],
)
def test_all_repeats_of_a_base_span_are_labelled(base, form, copies):
    for between in ("; ", "; or 24, in 2024, ", " or "):
        text = base + between + between.join([form] * copies)
        found = pii.base_spans(text)
        assert [text[a:b] for a, _, b in found] == [base]
        added = pii.added_spans(text, found)
        assert [text[a:b] for a, _, b in added] == [form] * copies
        assert {kind for _, kind, _ in added} == {found[0][1]}


def test_repeats_without_a_base_span_stay_unlabelled():
    text = "+1 (017) 555-7713; " + "order 881 2345, 8812345; " * 50
    assert pii.added_spans(text, pii.base_spans(text)) == []


def test_message_passing_equals_enumeration_on_a_tree():
    rng = np.random.default_rng(0)
    unary, edges = rng.normal(size=(4, 5)), np.array([[0, 1], [1, 2], [1, 3]])
    weights = np.array([0.5, 1.5, 2.0])
    total = np.zeros((4, 5))
    for labels in np.ndindex(5, 5, 5, 5):
        same = np.array([labels[a] == labels[b] for a, b in edges])
        chance = np.exp(sum(unary[i, x] for i, x in enumerate(labels)) + weights @ same)
        for i, x in enumerate(labels):
            total[i, x] += chance
    total /= total.sum(axis=1, keepdims=True)
    assert np.allclose(pii.beliefs(unary, edges, weights), total, atol=1e-3)


def test_personal_data_query_against_brute_force(spark, medium):
    texts = {r.doc_id: r.text for r in queries._documents(spark, medium).collect()}
    kinds = [k for k, _ in _PLAIN]
    for r in queries.QUERIES["op4_personal_data"](spark, medium).collect():
        base = _brute_spans(texts.pop(r.doc_id))
        listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(k == i for _, k, _ in base) for i in range(4)
        ]
        assert not listed or set(listed.split(",")) <= set(r.spans.split(","))
    assert not texts


def test_language_of_held_out_documents(spark, medium):
    docs = queries._documents(spark, medium).select("doc_id", "lang")
    rows = queries.QUERIES["op8_language_id"](spark, medium).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 0.15 < len(held) / len(rows) < 0.35
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    samples = [("the of and this " * 20, "en"), ("der die das und " * 20, "de")] * 60
    network = language_id.train(samples)
    texts = [None, "", "12 !?", "ß", "the of and this", "der das und " * 9000]
    docs = _docs(spark, texts)
    got = language_id.with_language(docs, network).orderBy("doc_id").collect()
    assert [r.language.lang_pred for r in got[:3]] == ["und"] * 3
    assert [r.language.lang_pred for r in got[4:]] == ["en", "de"]
    assert language_id.learn(docs).languages == []  # no labels at all
    nothing = language_id.with_language(docs, language_id.learn(docs)).collect()
    assert {r.language.lang_pred for r in nothing} == {"und"}
    # Labels of held-out rows are never read.
    secret = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "zz"))
    assert language_id.learn(secret).languages == []


def test_every_label_is_learnt_however_many_there_are(spark):
    rows = [(i, f"{'abcdefghij'[i % 7] * 9} {i % 70} " * 5, f"l{i % 70}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language_id.learn(docs, docs_per_language=3)
    assert network.languages == sorted({f"l{k}" for k in range(70)})
    few = language_id.learn(docs, max_docs=10)  # at least one row of each label
    assert few.languages == network.languages


def test_training_pieces_come_from_all_over_a_text(spark):
    text = "".join(chr(0x100 + i // 8) for i in range(8000))
    docs = spark.createDataFrame([(k, text) for k in range(40)] + [(99, "short")], "doc_id long, text string")
    pieces = docs.select("doc_id", language_id._stretches(F.col("text"), F.col("doc_id"), 5, 1).alias("p"))
    found = {r.doc_id: r.p for r in pieces.collect()}
    assert found.pop(99) == ["short"]
    places = [text.index(p) for ps in found.values() for p in ps]
    assert all(len(p) == 192 for ps in found.values() for p in ps) and len(places) == 200
    assert min(places) < 800 and max(places) > 7000


def test_passages_of_rows_that_share_an_id(spark):
    rng = random.Random(12)
    a, b, c = (_sentence(rng, 40) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b + " x"), (None, c), (8, c), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS holder", "2 AS _document_", "'p' AS passages")
    out = dedup_passages(docs)
    assert out.columns == ["doc_id", "text", "holder", "_document_", "passages"]
    got = sorted((str(r.doc_id), r.text or "", r.passages.n_removed) for r in out.collect())
    # The copy of 1 goes; what only 5 holds stays there, and goes where it stands later.
    want = [("1", a, 0), ("5", a, 40), ("5", b, 0), ("5", b, 0), ("7", b + " x", 40),
            ("None", c, 0), ("8", c, 0), ("5", "", 0)]
    assert got == sorted(want)
