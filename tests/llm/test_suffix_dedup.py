"""Suffix sorting and substring removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rolecall.llm import queries
from rolecall.llm.suffix_dedup import anchors, dedup_substrings, repeated_windows, sliding_minimum
from rolecall.llm.suffix_sort import common_prefixes, smaller_than_successor, two_stage_order


def brute_substrings(texts, window=200):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    bodies = [(t or "").encode() for t in texts]
    often = Counter(b[i : i + window] for b in bodies for i in range(len(b) - window + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if often[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def _text(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 9))) for _ in range(n))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=200))
def test_two_stage_order_is_the_suffix_order(symbols):
    text = np.array([*symbols, 0], np.uint8)
    raw = text.tobytes()
    want = sorted(range(len(raw)), key=lambda i: raw[i:])
    assert two_stage_order(text, len(raw)).tolist() == want
    small = smaller_than_successor(text)
    assert all(small[i] == (raw[i:] < raw[i + 1 :]) for i in range(len(raw) - 1))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 2), max_size=40), max_size=8), st.integers(1, 12))
def test_order_to_a_depth_keeps_equal_beginnings_together(parts, depth):
    text = np.array([x for p in parts for x in [*p, 0]], np.uint8)
    raw = text.tobytes()
    keys = [raw[i : i + depth] for i in two_stage_order(text, depth).tolist()]
    assert keys == sorted(keys)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=80), st.integers(1, 40))
def test_common_prefixes(data, most):
    text = np.frombuffer(data, np.uint8)
    pairs = [(i, j) for i in range(len(data)) for j in range(i + 1, len(data))]
    left, right = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
    for (i, j), got in zip(pairs, common_prefixes(np.append(text, 0), left, right, most)):
        n = 0
        while n < most and j + n < len(data) and data[i + n] == data[j + n]:
            n += 1
        # A zero byte after the text may match a zero in it.
        assert got == n or (j + n >= len(data) and data[i + n] == 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60), st.integers(1, 60))
def test_sliding_minimum(values, width):
    values = np.array(values, np.uint64)
    width = min(width, len(values))
    want = [values[i : i + width].min() for i in range(len(values) - width + 1)]
    assert sliding_minimum(values, width).tolist() == want


@pytest.mark.parametrize("stretch", [7, 64, 1 << 16])
def test_equal_windows_have_equal_anchors(monkeypatch, stretch):
    monkeypatch.setattr("rolecall.llm.suffix_dedup._STRETCH", stretch)
    one = _text(60, 1)
    data = np.frombuffer((_text(20, 2) + one + _text(30, 3) + one + "z" * 90).encode(), np.uint8)
    window, base = 40, 12
    hashes, first, last = anchors(data, window, base)
    assert first[0] == 0 and last[-1] == len(data) - window and (first[1:] == last[:-1] + 1).all()
    owner = {s: (h, s - f) for h, f, l in zip(hashes, first, last) for s in range(f, l + 1)}
    seen = {}
    for s, (h, _) in owner.items():
        assert seen.setdefault(data[s : s + window].tobytes(), h) == h


def test_repeated_windows_of_slices():
    slices = [b"abcabcabcabc", b"xxabcabcab", b"pqrstuvw", b"pqrstuvwx", b"aaaaaaaaaa", b"12345678"]
    counts = [1, 1, 1, 1, 1, 2]
    often = Counter(s[i : i + 8] for s, n in zip(slices, counts) for _ in range(n) for i in range(len(s) - 7))
    want = [[i for i in range(len(s) - 7) if often[s[i : i + 8]] > 1] for s in slices]
    assert [f.tolist() for f in repeated_windows(slices, counts, 8)] == want


def _rows(frame):
    return [(r.row, (s.n_bytes, s.n_removed, s.n_spans, bytes(s.kept))) for r in frame.collect() for s in [r.substrings]]


SHARED, OTHER = _text(70, 10), _text(90, 11)
TEXTS = [
    None, "", " ", "short", SHARED, SHARED, SHARED + "!", "x" + OTHER[5:] + "y", OTHER,
    _text(50, 12) + SHARED[20:400] + _text(50, 13) + SHARED[30:300], "a" * 1000, "b" * 199,
    "b" * 201, "c" * 200, "c" * 200, "é" * 150, "中文" * 60 + _text(20, 14), _text(20, 15) + "中文" * 60,
    _text(3000, 16) + SHARED, _text(40, 17), _text(40, 17)[:210], "\0" * 300, "\0" * 220 + "q", "d\0" * 101,
]


@pytest.mark.parametrize("most_slices", [4096, 1])
def test_equals_brute_force_on_odd_texts(spark, most_slices):
    ids = [None, 1, 1, 2, None, None, 3, 4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19]
    rows = [(i, k, t) for k, (i, t) in enumerate(zip(ids, TEXTS))]
    # Extra columns that have the names used inside.
    frame = spark.createDataFrame(rows, "doc_id long, row long, text string")
    frame = frame.selectExpr("*", "1 AS doc", "2 AS holder", "'s' AS substrings", "3 AS spans")
    found = dedup_substrings(frame.repartition(3), most_slices=most_slices)
    assert found.columns == ["doc_id", "row", "text", "doc", "holder", "spans", "substrings"]
    got, want = dict(_rows(found)), brute_substrings(TEXTS)
    assert [got[k] for k in range(len(TEXTS))] == want


def test_equals_brute_force_on_templates(spark):
    rng = random.Random(3)
    base = _text(120, 20).split()
    texts = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"{rng.randrange(10**6)}"
        texts.append(" ".join(words[rng.randrange(20) :]))
    frame = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    frame = frame.selectExpr("row", "row AS doc_id", "text")
    for options in ({}, {"most_slices": 3}, {"window": 64, "base": 16}):
        got = dict(_rows(dedup_substrings(frame, **options)))
        want = brute_substrings(texts, options.get("window", 200))
        assert [got[k] for k in range(60)] == want


def test_one_passage_in_most_documents(spark):
    texts = [f"{k} {_text(30, 100 + k % 400)} {SHARED if k % 3 else OTHER} {k}" for k in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = dict(_rows(dedup_substrings(frame.selectExpr("*", "row AS doc_id"))))
    assert [got[k] for k in range(1500)] == brute_substrings(texts)


def test_nothing_repeated_and_no_documents(spark):
    schema = "doc_id long, row long, text string"
    alone = spark.createDataFrame([(1, 1, SHARED), (2, 2, None)], schema)
    assert dict(_rows(dedup_substrings(alone))) == {
        1: (len(SHARED.encode()), 0, 0, SHARED.encode()), 2: (0, 0, 0, b"")
    }
    assert dedup_substrings(spark.createDataFrame([], schema)).collect() == []


def test_query_equals_brute_force(spark, small):
    rows = queries.QUERIES["op11_suffix_dedup"](spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = {
        d.doc_id: (*found[:3], hashlib.sha256(found[3]).hexdigest())
        for d, found in zip(docs, brute_substrings([d.text for d in docs]))
    }
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
    assert len(rows) == len(docs)
