"""Passages that stand earlier in the corpus, removed word by word.

A window is ``window`` consecutive words of a document. Each word covered by a window
whose words also start earlier (in a smaller document id, or earlier in the same
document) is removed. All windows are judged on the input.

Level-wise doubling: windows of ``base`` words are looked at first, and only where one
is repeated is it extended to twice that length, until ``window`` is reached. At the
base level not every place need be sent: of the base windows inside a full window, the
one of least hash stands for it (as in winnowing), so equal full windows choose equal
base windows at equal places, and about one place in six is sent. At each longer level,
the windows that survive are those whose part from the level before is repeated; none
is left where nothing is repeated. At the last level the first place of each window is
found, and all others are marked.

Documents of equal words needn't go through the last levels: all but the first lose
every word, if there are ``window`` of them, and no first place is ever in a copy.

Windows have 64-bit hashes. Defined results: a null text has no words; documents of
fewer words than a window lose none; a row without id loses none and takes none; rows
equal in id and text are one document; rows that share an id but not the text are
documents of their own, in the order of their texts' digests; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rolecall.llm.identity import distinct_ids
from rolecall.llm.scratch import written
from rolecall.llm.text import Words, runs

_PLACES = "hash long, doc long, pos int"


def chosen_bases(hashes: np.ndarray, base: int, window: int) -> np.ndarray:
    """For each full window, where its base window of least hash starts."""
    found = runs(hashes, base)
    inside = window - base + 1
    if len(found) < inside:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(found, inside)
    return np.arange(len(views)) + views.argmin(axis=1)


def _batch(hashes: list, docs: list, places: list) -> pa.RecordBatch:
    flat = np.concatenate([*hashes, np.zeros(0, np.uint64)]).view(np.int64)
    ids = np.repeat(np.array(docs, np.int64), [len(p) for p in places])
    at = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(flat), pa.array(ids), pa.array(at)], names=["hash", "doc", "pos"]
    )


def _base_places(texts: DataFrame, base: int, window: int) -> DataFrame:
    """hash, doc, pos of the base windows that stand for full windows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                hashes, places = [], []
                for text in part.column(1):
                    words = Words(text.as_py()).hashes
                    at = np.unique(chosen_bases(words, base, window))
                    hashes.append(runs(words, base)[at] if len(at) else words[:0])
                    places.append(at)
                yield _batch(hashes, part.column(0).to_pylist(), places)

    return texts.mapInArrow(read, _PLACES)


def _repeated(places: DataFrame) -> DataFrame:
    """doc and the sorted places of windows that stand more than once."""
    often = places.groupBy("hash").count().where("count > 1")
    often = often.select(F.col("hash").alias("known"))
    return (
        places.join(often, F.expr("hash = known"))
        .groupBy(F.col("doc").alias("holder"))
        .agg(F.sort_array(F.collect_list("pos")).alias("places"))
    )


def _extended(
    texts: DataFrame, repeated: DataFrame, base: int, length: int, window: int
) -> DataFrame:
    """Windows of ``length`` words over repeated parts half as long.

    For the full windows, a part is the base window that stands for it; in between, a
    part is extended to both sides.
    """
    half = length // 2

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                hashes, places = [], []
                for text, known in zip(part.column(1), part.column(2)):
                    words = Words(text.as_py()).hashes
                    known = known.values.to_numpy()
                    if length == window:
                        owner = chosen_bases(words, base, window)
                        at = np.flatnonzero(_is_in(owner, known))
                    else:
                        at = np.unique(np.r_[known, known - half])
                        at = at[(at >= 0) & (at + length <= len(words))]
                    hashes.append(runs(words, length)[at] if len(at) else words[:0])
                    places.append(at)
                yield _batch(hashes, part.column(0).to_pylist(), places)

    joined = texts.join(repeated, F.expr("doc = holder")).select("doc", "t", "places")
    return joined.mapInArrow(read, _PLACES)


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(0, bool)
    marks = np.zeros(int(values.max()) + 1, bool)
    marks[known[known < len(marks)]] = True
    return marks[values]


def _keys(texts: DataFrame, window: int) -> DataFrame:
    """doc, and a key of its words for documents of at least one window."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().split()
                if len(words) >= window:
                    plain = b" ".join(words)
                    ids.append(doc)
                    keys.append(hashlib.blake2b(plain, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary())],
                names=["doc", "key"],
            )

    return texts.mapInArrow(read, "doc long, key binary")


def _copies(texts: DataFrame, window: int) -> DataFrame:
    """Ids of documents whose words are all those of a smaller id."""
    keys = written(_keys(texts, window), "keys")
    firsts = keys.groupBy(F.col("key").alias("class")).agg(F.min("doc").alias("first"))
    return (
        keys.join(firsts, F.expr("key = class AND doc > first"))
        .select(F.col("doc").alias("copy"))
        .distinct()
    )


def dedup_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    base: int = 10,
    into: str = "passages",
) -> DataFrame:
    """``docs`` with a column ``into`` of {n_words, n_removed, kept}.

    ``kept`` holds the other words, joined by one space. ``window`` is ``base`` doubled
    once or more. All columns of ``docs`` stay, but one named ``into`` is replaced.
    """
    levels = [base]
    while levels[-1] < window:
        levels.append(2 * levels[-1])
    if levels[-1] != window or len(levels) < 2:
        raise ValueError("window must be base doubled once or more")
    columns = [c for c in docs.columns if c != into]
    docs = distinct_ids(docs, id_col, text_col, "_document")
    texts = docs.where("_document IS NOT NULL").select(
        F.col("_document").alias("doc"), docs[text_col].alias("t")
    )
    copies = written(_copies(texts, window), "copies")
    bases = written(_repeated(_base_places(texts, base, window)), "repeated")
    bases = bases.join(copies, F.expr("holder = copy"), "left_anti")
    repeated = bases
    for length in levels[1:-1]:
        longer = written(_extended(texts, repeated, base, length, window), "windows")
        repeated = written(_repeated(longer), "repeated")
        bases = written(_surviving(bases, repeated, length), "repeated")
    windows = written(_extended(texts, bases, base, window, window), "windows")
    place = F.struct("doc", "pos")
    firsts = windows.groupBy("hash").agg(
        F.min(place).alias("first"), F.max(place).alias("last")
    )
    firsts = firsts.where("first != last").select(F.col("hash").alias("known"), "first")
    later = windows.join(firsts, F.expr("hash = known")).where(place != F.col("first"))
    marks = later.groupBy(F.col("doc").alias("holder")).agg(
        F.collect_list("pos").alias("places")
    )
    marks = written(marks, "marks")
    return _applied(docs, columns, marks, copies, text_col, window, into)


def _surviving(bases: DataFrame, repeated: DataFrame, length: int) -> DataFrame:
    """Base places inside a repeated window of ``length`` words."""
    inside = F.expr(
        f"filter(places, p -> exists(longer, q -> q <= p AND p < q + {length}))"
    )
    longer = repeated.select(F.col("holder").alias("also"), F.col("places").alias("longer"))
    return (
        bases.join(longer, F.expr("holder = also"))
        .select("holder", inside.alias("places"))
        .where("size(places) > 0")
    )


def _applied(docs, columns, marks, copies, text_col, window, into) -> DataFrame:
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for row in batch:
                words = (row["body"].as_py() or "").encode().split()
                counts.append(len(words))
                if row["whole"].as_py() and len(words) >= window:
                    words = []
                elif row["places"].is_valid:
                    places = row["places"].values.to_numpy()
                    places = places[places + window <= len(words)]
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, places, 1)
                    np.add.at(depth, places + window, -1)
                    stay = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
                    words = [words[i] for i in stay.tolist()]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.StructArray.from_arrays(
                [
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                names=["n_words", "n_removed", "kept"],
            )

    apply.__annotations__ = {
        "batches": Iterator[pa.Array],
        "return": Iterator[pa.Array],
    }
    udf = F.arrow_udf(
        apply, returnType="struct<n_words: long, n_removed: long, kept: string>"
    )
    rows = docs.select(
        F.struct(*[docs[c] for c in columns]).alias("row"),
        docs["_document"].alias("doc"),
        docs[text_col].alias("body"),
    )
    what = marks.select("holder", "places", F.lit(False).alias("whole")).unionByName(
        copies.select(
            F.col("copy").alias("holder"),
            F.lit(None).cast("array<int>").alias("places"),
            F.lit(True).alias("whole"),
        )
    )
    joined = rows.join(what, F.expr("doc = holder"), "left")
    whole = F.coalesce("whole", F.lit(False)).alias("whole")
    return joined.select("row.*", udf(F.struct("body", "places", whole)).alias(into))
