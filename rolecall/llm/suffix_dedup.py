"""Byte strings that stand more than once in the corpus, removed by suffix arrays.

Each byte covered by a string of ``window`` bytes that also starts anywhere else, in
another document or elsewhere in the same, is removed; so are all copies, the
first included. Strings are judged on the input and don't cross documents.

One suffix array over the corpus would be one sort over all its bytes. Instead, places
that can hold equal windows are brought together first. Of the runs of ``base`` bytes
inside a window, the one of least hash stands for it, its anchor; equal windows have
equal anchors at equal places. Only anchors whose hash stands at several places go
on, each with the slice of text that its windows span. Equal slices are counted before
and after a shuffle, so a passage held by a third of all documents arrives once. The
slices of an anchor meet in one task, which joins those of many anchors into one text,
sorts its suffixes in two stages (see ``suffix_sort``), and computes the common
prefixes of neighbours; a window is repeated if it shares ``window`` bytes with a
neighbour, or if its whole slice stands more than once. Bytes are compared, not
hashes. The windows found are joined back to the places of their slices.

An anchor with more than ``most_slices`` different slices isn't gathered in one task: the
digests of its windows are counted instead, which gives the same result.

Texts, not rows, are what is compared: rows of equal text are one text that stands as often.
Defined results: a null text is empty; texts shorter than a window lose nothing; rows
that share an id, and rows without one, are documents of their own; of equal texts long
enough, each loses all; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rolecall.llm.groups import join_groups
from rolecall.llm.scratch import written
from rolecall.llm.suffix_sort import common_prefixes, two_stage_order
from rolecall.llm.text import mixed, runs

_STRETCH = 1 << 16
_BLOCK_BYTES = 1 << 19
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_LOW = np.uint64((1 << 32) - 1)


# -- anchors ------------------------------------------------------------------------------


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, window: int, base: int) -> tuple[np.ndarray, ...]:
    """(hash, first, last): each anchor's hash, and the first and last start of the
    windows that it stands for."""
    starts = len(data) - window + 1
    if starts <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, owners, firsts = [], [], []
    for at in range(0, starts, _STRETCH):
        n = min(_STRETCH, starts - at)
        found = runs(_BYTES[data[at : at + n + window - 1]], base)
        # Of equal hashes the leftmost counts.
        place = np.arange(len(found), dtype=np.uint64)
        least = sliding_minimum((found & ~_LOW) | place, window - base + 1)
        owner = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        hashes.append(found[owner[first]])
        owners.append(owner[first] + at)
        firsts.append(first + at)
    hash_, owner, first = map(np.concatenate, (hashes, owners, firsts))
    new = np.r_[True, owner[1:] != owner[:-1]]  # one anchor may stand in two stretches
    hash_, first = hash_[new], first[new]
    return hash_, first, np.r_[first[1:] - 1, starts - 1]


def _bytes_of(value: pa.Scalar) -> np.ndarray:
    buffer = value.as_buffer()
    return np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _places(texts: DataFrame, window: int, base: int) -> DataFrame:
    """hash, doc, first: every anchor of every text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                found = [anchors(_bytes_of(t), window, base)[:2] for t in part.column(1)]
                rows = np.repeat(np.arange(len(found)), [len(h) for h, _ in found])
                hashes = np.concatenate([h for h, _ in found]).view(np.int64)
                firsts = np.concatenate([f for _, f in found]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), part.column(0).take(pa.array(rows)), pa.array(firsts)],
                    names=["hash", "doc", "first"],
                )

    return texts.mapInArrow(read, "hash long, doc binary, first int")


def _repeated(places: DataFrame) -> DataFrame:
    """doc and firsts: the anchors whose hash stands at more than one place."""
    place = F.xxhash64("doc", "first")
    groups = places.groupBy(F.col("hash").alias("known")).agg(
        F.count("*").alias("n"), F.min(place).alias("least"), F.max(place).alias("most")
    )
    # Rows of equal text have the same doc, and so the same places.
    groups = written(groups.where("least != most").drop("least", "most"), "anchors")
    return (
        join_groups(places, "hash", groups, "known", "n")
        .groupBy(F.col("doc").alias("holder"))
        .agg(F.collect_set("first").alias("firsts"))
    )


# -- slices ---------------------------------------------------------------------------------


def _slices(chosen: DataFrame, window: int, base: int) -> DataFrame:
    """hash, slice, its digest, doc, start and weight, from doc, body, firsts and weight."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                columns = [[], [], [], [], [], []]
                for doc, body, known, weight in zip(*part.columns):
                    data = _bytes_of(body)
                    hashes, first, last = anchors(data, window, base)
                    at = np.searchsorted(first, np.sort(known.values.to_numpy()))
                    raw = data.tobytes()
                    for k in at.tolist():
                        piece = raw[first[k] : last[k] + window]
                        columns[1].append(piece)
                        columns[2].append(_digest(piece))
                    columns[0].append(hashes[at])
                    columns[3] += [doc.as_py()] * len(at)
                    columns[4].append(first[at])
                    columns[5] += [weight.as_py()] * len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(columns[0]).view(np.int64)),
                        pa.array(columns[1], pa.binary()),
                        pa.array(columns[2], pa.binary()),
                        pa.array(columns[3], pa.binary()),
                        pa.array(np.concatenate(columns[4]).astype(np.int32)),
                        pa.array(columns[5], pa.int64()),
                    ],
                    names=["hash", "slice", "sid", "doc", "start", "weight"],
                )

    return chosen.mapInArrow(
        read, "hash long, slice binary, sid binary, doc binary, start int, weight long"
    )


def _spans(starts: np.ndarray, window: int) -> np.ndarray:
    """The merged byte ranges that windows at sorted ``starts`` cover, one a row."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(starts[1:] > starts[:-1] + window)
    return np.column_stack([starts[np.r_[0, cut + 1]], starts[np.r_[cut, -1]] + window])


def repeated_windows(slices: list[bytes], counts: list[int], window: int) -> list[np.ndarray]:
    """For each slice, the starts of its windows that stand more than once.

    ``counts`` says how often each slice stands; the slices differ.
    """
    sizes = np.array([len(s) for s in slices])
    # Bytes of UTF-8 text end at 0xF4, so there is room for a separator below them.
    text = np.frombuffer(b"".join(s + b"\xff" for s in slices), np.uint8) + np.uint8(1)
    begins = np.cumsum(sizes + 1) - sizes - 1
    is_start = np.zeros(len(text) + 1, np.int64)
    np.add.at(is_start, begins, 1)
    np.add.at(is_start, begins + sizes - window + 1, -1)
    is_start = np.cumsum(is_start[:-1]) > 0
    order = two_stage_order(text, window)
    order = order[is_start[order]]
    shared = common_prefixes(text, order[:-1], order[1:], window) >= window
    again = np.zeros(len(text), bool)
    again[order[:-1][shared]] = again[order[1:][shared]] = True
    found = []
    for begin, size, count in zip(begins.tolist(), sizes.tolist(), counts):
        starts = size - window + 1
        if count > 1:
            found.append(np.arange(starts))
        else:
            found.append(np.flatnonzero(again[begin : begin + starts]))
    return found


_MARKS = "same binary, n long, spans array<struct<begin: int, end: int>>"


def _mark_batch(sids: list, counts: list, starts: list, window: int) -> pa.RecordBatch:
    kept = [k for k, s in enumerate(starts) if len(s)]
    spans = [_spans(starts[k], window) for k in kept]
    ends = np.cumsum([0, *map(len, spans)], dtype=np.int32)
    flat = np.concatenate([*spans, np.zeros((0, 2), np.int64)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays(
        [pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], names=["begin", "end"]
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array([sids[k] for k in kept], pa.binary()),
            pa.array([counts[k] for k in kept], pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), pairs),
        ],
        names=["same", "n", "spans"],
    )


def _sorted_marks(distinct: DataFrame, window: int) -> DataFrame:
    """The repeated windows of each slice, by suffix arrays of a few anchors' slices."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        """Slices and counts of whole anchors, some _BLOCK_BYTES at a time."""
        slices, counts, size, last = [], [], 0, None
        for batch in batches:
            for hash_, piece, n in zip(*(c.to_pylist() for c in batch.columns)):
                if hash_ != last and size >= _BLOCK_BYTES:
                    yield slices, counts
                    slices, counts, size = [], [], 0
                last = hash_
                slices.append(piece)
                counts.append(n)
                size += len(piece) + 1
        if slices:
            yield slices, counts

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slices, counts in blocks(batches):
            starts = repeated_windows(slices, counts, window)
            yield _mark_batch([_digest(s) for s in slices], counts, starts, window)

    rows = distinct.select("hash", "slice", "n")
    return rows.repartition("hash").sortWithinPartitions("hash").mapInArrow(mark, _MARKS)


def _counted_marks(distinct: DataFrame, window: int) -> DataFrame:
    """The same by counting the digests of all windows: for anchors of too many slices."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                rows = [
                    (sid, at, _digest(piece[at : at + window]), n)
                    for piece, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                    for sid in [_digest(piece)]
                    for at in range(len(piece) - window + 1)
                ]
                kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    names=["sid", "at", "content", "n"],
                )

    windows = written(
        distinct.select("slice", "n").mapInArrow(
            explode, "sid binary, at int, content binary, n long"
        ),
        "windows",
    )
    groups = windows.groupBy(F.col("content").alias("known")).agg(
        F.sum("n").alias("stands"), F.count("*").alias("rows")
    )
    groups = written(groups.where("stands > 1"), "repeated-windows")
    found = join_groups(windows, "content", groups, "known", "rows")
    pair = F.struct(F.col("at").alias("begin"), (F.col("at") + window).alias("end"))
    return found.groupBy(F.col("sid").alias("same")).agg(
        F.max("n").alias("n"), F.collect_list(pair).alias("spans")
    )


def _marks(distinct: DataFrame, window: int, most_slices: int) -> DataFrame:
    """same (a slice's digest), n (how often it stands), spans (what is repeated in it)."""
    per_anchor = distinct.groupBy(F.col("hash").alias("crowded")).agg(F.count("*").alias("d"))
    crowded = written(per_anchor.where(F.col("d") > most_slices), "crowded")
    if crowded.isEmpty():
        return _sorted_marks(distinct, window)
    split = join_groups(distinct, "hash", crowded, "crowded", "d", "left")
    few = _sorted_marks(split.where("crowded IS NULL"), window)
    return few.unionByName(_counted_marks(split.where("crowded IS NOT NULL"), window))


# -- the operator ---------------------------------------------------------------------------


def _text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 200,
    base: int = 48,
    most_slices: int = 4096,
    into: str = "substrings",
) -> DataFrame:
    """``docs`` with a column ``into`` of {n_bytes, n_removed, n_spans, kept}.

    ``kept`` holds the remaining bytes, which need not be whole characters; ``n_spans``
    counts the maximal runs removed. All columns of ``docs`` stay, but one named ``into``
    is replaced.
    """
    if not 8 <= base < window:
        raise ValueError("base must be at least 8 and below window")
    body = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    texts = docs.select(docs[id_col].cast("string").alias("id"), body.alias("body"))
    long = texts.where(F.octet_length("body") >= window).withColumn("doc", _text_key(F.col("body")))
    rows = written(long.select("doc", "id"), "texts")
    groups = rows.groupBy(F.col("doc").alias("text")).agg(
        F.count("*").alias("n"), F.min("id").alias("one")
    )
    copied = written(groups.where("n > 1"), "copied")

    places = written(_places(long.select("doc", "body"), window, base), "places")
    # One row of each text is read again: the one of least id, or any without.
    one = groups.select("text", "one", F.least("n", F.lit(2).cast("long")).alias("weight"))
    repeated = _repeated(places).join(one, F.col("holder") == F.col("text"))
    same = (F.col("doc") == F.col("holder")) & F.col("id").eqNullSafe(F.col("one"))
    chosen = long.join(repeated, same).select("doc", "body", "firsts", "weight")
    slices = written(_slices(chosen, window, base), "slices")
    distinct = slices.groupBy("hash", "slice").agg(F.sum("weight").alias("n"))
    distinct = written(distinct, "distinct-slices")
    marks = written(_marks(distinct, window, most_slices), "marks")

    at = slices.where("weight = 1").select("sid", "doc", "start")
    shifted = F.transform(
        "spans",
        lambda s: F.struct(
            (s["begin"] + F.col("start")).alias("begin"), (s["end"] + F.col("start")).alias("end")
        ),
    )
    found = join_groups(at, "sid", marks, "same", "n").select("doc", shifted.alias("spans"))
    found = found.groupBy(F.col("doc").alias("holder")).agg(
        F.flatten(F.collect_list("spans")).alias("spans")
    )
    # A text that stands once has one row; of copies, each row loses all.
    single = found.join(one, F.col("holder") == F.col("text")).select("holder", "one", "spans")
    whole = join_groups(rows, "doc", copied, "text", "n").select(
        F.col("doc").alias("holder"), F.col("id").alias("one")
    )
    removed = single.withColumn("whole", F.lit(False)).unionByName(
        whole.distinct().withColumn("whole", F.lit(True)), allowMissingColumns=True
    )
    return _applied(docs, written(removed, "removed"), id_col, text_col, into)


def _applied(docs, removed, id_col, text_col, into) -> DataFrame:
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, gone, runs_, kept = [], [], [], []
            for row in batch:
                data = _bytes_of(row["body"])
                sizes.append(len(data))
                if row["whole"].as_py():
                    runs_.append(1)
                    left = b""
                elif row["spans"].is_valid:
                    pairs = row["spans"].values
                    depth = np.zeros(len(data) + 1, np.int64)
                    np.add.at(depth, pairs.field("begin").to_numpy(), 1)
                    np.add.at(depth, pairs.field("end").to_numpy(), -1)
                    stay = np.cumsum(depth[:-1]) == 0
                    runs_.append(int((~stay & np.r_[True, stay[:-1]]).sum()))
                    left = data[stay].tobytes()
                else:
                    runs_.append(0)
                    left = data.tobytes()
                gone.append(len(data) - len(left))
                kept.append(left)
            yield pa.StructArray.from_arrays(
                [
                    pa.array(sizes, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(runs_, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                names=["n_bytes", "n_removed", "n_spans", "kept"],
            )

    apply.__annotations__ = {
        "batches": Iterator[pa.Array],
        "return": Iterator[pa.Array],
    }
    udf = F.arrow_udf(
        apply, returnType="struct<n_bytes: long, n_removed: long, n_spans: long, kept: binary>"
    )
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns if c != into]).alias("row"),
        docs[id_col].cast("string").alias("id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("body"),
    ).withColumn("doc", _text_key(F.col("body")))
    same = (F.col("doc") == F.col("holder")) & F.col("id").eqNullSafe(F.col("one"))
    joined = rows.join(removed, same, "left")
    return joined.select("row.*", udf(F.struct("body", "spans", "whole")).alias(into))
