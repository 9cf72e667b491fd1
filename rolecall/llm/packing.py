"""Documents packed into token sequences along a space-filling curve.

Each document's ids are hashed into a vector of counts, projected to few dimensions, and
given a Hilbert key, so that documents of like words have near keys. Documents are
range-sorted by that key, and their ids, laid end to end along the curve, are cut every
``length`` ids. Only the very last sequence can be short.

Ids are made once and written. The order is made from narrow rows (key, number of ids):
range partitions, a running sum in each, and the sums of the partitions before it. A
document then meets its place in a join by row, which no hot key can slow.

Defined results: a null text is empty, and has the closing id only; documents of equal
keys follow their id, then their row; rows that share an id are packed each on its own;
an empty table gives no pieces; a document of any length is cut without loss.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rolecall.llm.scratch import written
from rolecall.llm.tokens import WordTokenizer, read_vocabulary, word_tokenizer

DIMENSIONS, BITS, BUCKETS = 3, 16, 256


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of whole numbers below 2 ** bits.

    By the transposed form of the axes (Skilling, 2004), for all rows at once.
    """
    axes = [column.astype(np.int64) for column in points.T]
    for bit in range(bits - 1, 0, -1):
        high, low = 1 << bit, (1 << bit) - 1
        for i, axis in enumerate(axes):
            inside = (axis & high) != 0
            swap = np.where(inside, 0, (axes[0] ^ axis) & low)
            axes[0] = np.where(inside, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(points), np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] & (1 << bit), (1 << bit) - 1, 0)
    key = np.zeros(len(points), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ flip) >> bit) & 1)
    return key


class Projection:
    """Hashed counts of ids to a few whole-number coordinates."""

    def __init__(self, seed: int):
        self.seed = np.uint32(2 * seed + 1)
        directions = np.random.default_rng(seed).normal(size=(BUCKETS, DIMENSIONS))
        self.directions = directions

    def keys(self, documents: list[np.ndarray]) -> np.ndarray:
        sizes = [len(ids) for ids in documents]
        ids = np.concatenate(documents).astype(np.uint32)
        bucket = (ids * np.uint32(2654435761) * self.seed) >> np.uint32(24)
        cell = np.repeat(np.arange(len(sizes)), sizes) * BUCKETS + bucket
        counts = np.bincount(cell, minlength=len(sizes) * BUCKETS)
        vectors = counts.reshape(-1, BUCKETS).astype(np.float64)
        # Without the common part, which all documents share, directions tell more.
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)
        vectors -= vectors.mean(axis=1, keepdims=True)
        spread = np.tanh(vectors @ self.directions)
        cells = np.floor((spread + 1) / 2 * (1 << BITS))
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def _tokenized(docs, id_col, text_col, vocabulary, end_id, seed, by_words) -> DataFrame:
    """doc, n, key, ids; written, with a row number of its own."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(shared.value, by_words)
        projection = Projection(seed)
        end = np.array([end_id], tokenizer.dtype).tobytes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = (value.as_py() or "" for value in part.column(1))
                ids = [tokenizer.ids(text) + end for text in texts]
                arrays = [np.frombuffer(x, tokenizer.dtype) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in arrays], pa.int64()),
                        pa.array(projection.keys(arrays)),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc", "n", "key", "ids"],
                )

    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("t"))
    rows = rows.mapInArrow(tokenize, "doc long, n long, key long, ids binary")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "ids")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row and n become row, n, and the sum of n before it in the partition."""
    total = 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        before = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(before)],
            names=["row", "n", "before"],
        )


def _places(tokens: DataFrame) -> DataFrame:
    """row, and how many ids stand before it along the curve."""
    order = ["key", "doc", "row"]
    placed = written(
        tokens.select(*order, "n")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("row", "n")
        .mapInArrow(_running, "row long, n long, before long")
        .withColumn("part", F.spark_partition_id()),
        "places",
    )
    parts = placed.groupBy("part").agg(F.sum("n").alias("ids"))
    parts = parts.select(
        "part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base")
    )
    # One row for each partition of the order, however many documents there are.
    return placed.join(F.broadcast(parts), "part").select(
        "row", (F.col("base") + F.col("before")).alias("begin")
    )


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = 4096,
    end_id: int = 2,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    by_words: bool = True,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece of a document; with ``keep_ids`` its ids, 32 bits each.

    ``by_words``: see ``WordTokenizer``. A sequence is all pieces of one sequence_id, by
    offset; the last one is to be padded to ``length``.
    """
    vocabulary = read_vocabulary(tokenizer_path)
    tokens = _tokenized(docs, id_col, text_col, vocabulary, end_id, seed, by_words)
    wide = np.dtype(WordTokenizer(vocabulary).dtype).str

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows = []
                for doc, ids, place in zip(*(c.to_pylist() for c in part.columns)):
                    ids = np.frombuffer(ids, wide).astype("<u4")
                    start = 0
                    while start < len(ids):
                        sequence, offset = divmod(place + start, length)
                        piece = ids[start : start + length - offset].tobytes()
                        rows.append(
                            (doc, start, len(piece) // 4, zlib.crc32(piece), len(ids))
                            + (sequence, offset, piece if keep_ids else None)
                        )
                        start += len(piece) // 4
                columns = zip(*rows) if rows else [[]] * 8
                types = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    names=[field.split()[0] for field in PIECES.split(", ")],
                )

    pieces = (
        tokens.join(_places(tokens), "row")
        .select("doc", "ids", "begin")
        .mapInArrow(cut, PIECES)
    )
    return pieces if keep_ids else pieces.drop("ids")
