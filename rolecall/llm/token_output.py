"""Token ids packed into fixed matrices, as written for a trainer to read.

Each task packs what it reads, in pools of ``pool_ids`` ids: documents longer than a
sequence are cut into whole sequences and a rest, and the pieces of the pool are packed
by best fit, longest first. A segment tree over the free room of the open sequences
finds the fullest that still takes a piece. Nothing is shuffled, and nothing is held
beyond one pool. Only a task's last pool can leave more than a little room.

A sequence has its ids (padded with ``pad_id``), the cumulative lengths of its segments,
positions that start anew at each segment, and the document and start of each segment.

Defined results: a null text is empty, and has the closing id only; a null document id
stays null; equal rows are packed each on its own; an empty table gives no sequences;
columns but id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rolecall.llm.tokens import read_vocabulary, word_tokenizer

SEQUENCES = (
    "n_tokens long, ids binary, cu_seqlens array<long>, positions binary, "
    "doc_ids array<long>, starts array<long>, doc_tokens array<long>"
)
_LONGS = pa.list_(pa.int64())
_TYPES = [pa.int64(), pa.binary(), _LONGS, pa.binary(), _LONGS, _LONGS, _LONGS]


class Room:
    """Open sequences by free room: a segment tree finds the least room that suffices."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of least room that is at least ``need``; None if none is."""
        at = need + self.leaves
        if not self.count[at]:
            # Climb until a right neighbour has something, then go down to its least.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Which sizes go together into each sequence of ``length``; all are at most that."""
    room, sequences = Room(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = room.take(sizes[i])
        if found is None:
            found = length, len(sequences)
            sequences.append([])
        sequences[found[1]].append(i)
        room.add(found[0] - sizes[i], found[1])
    return sequences


def packed_matrices(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = 4096,
    end_id: int = 2,
    pad_id: int = 0,
    pool_ids: int = 1 << 21,
    id_col: str = "doc_id",
    text_col: str = "text",
    by_words: bool = True,
) -> DataFrame:
    """sequence_id and the columns of ``SEQUENCES``, one row per sequence.

    ``ids`` holds ``length`` little-endian unsigned numbers of 32 bits, ``positions`` as
    many of 16 bits (32 beyond 65,536). The pad has position 0 and no segment.
    Sequence numbers are distinct, but have gaps between tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path))
    place = "<u2" if length <= 1 << 16 else "<u4"

    def sequence_rows(pool: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = []
        for members in best_fit_decreasing([len(ids) for *_, ids in pool], length):
            ids, positions = np.full(length, pad_id, "<u4"), np.zeros(length, place)
            ends = [0]
            for i in members:
                piece = pool[i][-1]
                begin, end = ends[-1], ends[-1] + len(piece)
                ids[begin:end] = piece
                positions[begin:end] = np.arange(len(piece))
                ends.append(end)
            docs_in, starts, totals = zip(*(pool[i][:3] for i in members))
            rows.append(
                (ends[-1], ids.tobytes(), ends, positions.tobytes())
                + (docs_in, starts, totals)
            )
        columns = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, _TYPES)],
            names=[field.split()[0] for field in SEQUENCES.split(", ")],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(shared.value, by_words)
        end = np.array([end_id], tokenizer.dtype).tobytes()
        pool, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = tokenizer.ids(text.as_py() or "") + end
                ids = np.frombuffer(raw, tokenizer.dtype)
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    pool.append((doc, start, len(ids), piece))
                    size += len(piece)
                    if size >= pool_ids:
                        yield from sequence_rows(pool)
                        pool, size = [], 0
        if pool:
            yield from sequence_rows(pool)

    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("t"))
    return rows.mapInArrow(pack, SEQUENCES).withColumn(
        "sequence_id", F.monotonically_increasing_id()
    )


def write_matrices(sequences: DataFrame, path: str) -> None:
    """The sequences as Parquet: one binary row of the id matrix per sequence."""
    sequences.write.option("compression", "zstd").parquet(path)
