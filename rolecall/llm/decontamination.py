"""Words of documents that stand inside windows of benchmark items.

A prefix-filtered set join. A window is a run of ``window`` words of an item (or the
whole of a shorter one); its set are its shingles of up to five words. A document that
holds a window holds all its shingles, so the necessary prefix is one shingle, and the
rarest is taken: how often each shingle of the benchmark stands in the documents is
counted over all of them first. A document's shingles are looked up among the
prefixes; the prefix's place in the window gives the only place where the window could
start (positional bound), which must leave room for its length (length bound); where
the hash of the whole window agrees as well, its words are compared one with another.

The benchmark is read in blocks of at most ``block_bytes`` of text, so that what each
task holds is bounded. Usually there is one block, and it is applied in a single pass
without a shuffle. With more, each block's hits are written and merged by document.

Defined results: null text has no words; an item without an id or without words takes
no part; items of equal id count once; each row of the documents gets a result of its
own; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rolecall.llm.scratch import written
from rolecall.llm.text import Words, runs

SHINGLE = 5
_FILTER_BITS = 20
_SPAN_LIST = "array<struct<begin: long, end: long>>"
_HITS = (
    f"struct<n_words: long, spans: {_SPAN_LIST}, items: array<string>>"
)
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_HITS_ARROW = pa.struct(
    [("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))]
)


class Keys:
    """A sorted set of hashes with a bitmap before it."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` of known ones, and which key each is."""
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _FILTER_BITS)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0], maybe[:0]
        which = np.searchsorted(self.keys, hashes[maybe])
        which[which == len(self.keys)] = 0
        known = self.keys[which] == hashes[maybe]
        return maybe[known], which[known]


def _joined_words(words: Words, start: int, size: int) -> bytes:
    ends = zip(words.starts[start : start + size], words.ends[start : start + size])
    return b" ".join([words.data[i:j] for i, j in ends])


class Index:
    """One block of the benchmark: its distinct windows, and a prefix for each."""

    def __init__(self, block: list[tuple[str, str]], window: int):
        self.windows: dict[bytes, int] = {}  # words, joined by a blank
        sizes, wholes = [], []
        shingles: list[tuple[int, np.ndarray]] = []  # length, its hashes in order
        items: list[set[str]] = []
        for item, text in block:
            words = Words(text, letters=True)
            hashes = words.hashes
            size = min(window, len(hashes))
            if not size:
                continue
            part = min(SHINGLE, size)
            parts = runs(hashes, part)
            for start, whole in enumerate(runs(hashes, size).tolist()):
                at = self.windows.setdefault(_joined_words(words, start, size), len(items))
                if at == len(items):
                    items.append(set())
                    sizes.append(size)
                    wholes.append(whole)
                    shingles.append((part, parts[start : start + size - part + 1]))
                items[at].add(item)
        self.items = [sorted(names) for names in items]
        self.shingles = shingles
        self.sizes, self.wholes = np.array(sizes, np.int64), np.array(wholes, np.uint64)
        self.by_length: dict[int, Keys] = {}
        for length in {length for length, _ in shingles}:
            mine = [parts for size, parts in shingles if size == length]
            self.by_length[length] = Keys(np.concatenate(mine))

    def counts(self, texts: Iterator[str | None]) -> dict[int, np.ndarray]:
        """How often each shingle of the benchmark stands in the texts."""
        found = {n: np.zeros(len(k.keys), np.int64) for n, k in self.by_length.items()}
        for text in texts:
            hashes = Words(text, letters=True).hashes
            for length, keys in self.by_length.items():
                _, which = keys.find(runs(hashes, length))
                if len(which):
                    found[length] += np.bincount(which, minlength=len(keys.keys))
        return found

    def choose_prefixes(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep the rarest shingle of each window; ties by hash, then by place."""
        chosen = defaultdict(list)
        for at, (length, parts) in enumerate(self.shingles):
            rarest = min(
                range(len(parts)),
                key=lambda i: (counts.get((length, int(parts[i])), 0), int(parts[i]), i),
            )
            chosen[length].append((int(parts[rarest]), at, rarest))
        self.prefixes = {}
        for length, rows in chosen.items():
            rows.sort()
            prefix = np.array([r[0] for r in rows], np.uint64)
            keys = Keys(prefix)
            self.prefixes[length] = (
                keys,
                np.searchsorted(prefix, keys.keys, "left"),
                np.searchsorted(prefix, keys.keys, "right"),
                np.array([r[1] for r in rows], np.int64),
                np.array([r[2] for r in rows], np.int64),
            )
        self.texts = list(self.windows)
        del self.windows, self.shingles, self.by_length

    def hits(self, text: str | None) -> tuple[int, np.ndarray, list[str]]:
        """Number of words, the spans of words hit, and the items that occur."""
        words = Words(text, letters=True)
        hashes = words.hashes
        starts, found = [], []
        for length, (keys, low, high, window, offset) in self.prefixes.items():
            place, which = keys.find(runs(hashes, length))
            if not len(place):
                continue
            many = high[which] - low[which]
            place = np.repeat(place, many)
            row = np.repeat(low[which] - np.cumsum(many) + many, many) + np.arange(
                many.sum()
            )
            start, at = place - offset[row], window[row]
            fits = (start >= 0) & (start + self.sizes[at] <= len(hashes))
            start, at = start[fits], at[fits]
            for size in np.unique(self.sizes[at]).tolist():
                mine = self.sizes[at] == size
                mine[mine] = runs(hashes, size)[start[mine]] == self.wholes[at[mine]]
                pairs = zip(start[mine].tolist(), at[mine].tolist())
                same = [_joined_words(words, i, size) == self.texts[j] for i, j in pairs]
                starts.append(start[mine][same])
                found.append(at[mine][same])
        if not starts:
            return len(hashes), np.zeros((0, 2), np.int64), []
        start, at = np.concatenate(starts), np.concatenate(found)
        depth = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + self.sizes[at], -1)
        hit = np.zeros(len(hashes) + 2, bool)
        hit[1:-1] = np.cumsum(depth[:-1]) > 0
        spans = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
        names = {name for i in np.unique(at).tolist() for name in self.items[i]}
        return len(hashes), spans, sorted(names)


def _blocks(
    bench: DataFrame, id_col: str, text_col: str, block_bytes: int
) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of at most ``block_bytes`` of text (or one longer item)."""
    rows = bench.where(bench[id_col].isNotNull() & bench[text_col].isNotNull()).select(
        bench[id_col].cast("string").alias("item"), bench[text_col].alias("body")
    )
    block, size = [], 0
    for item, body in rows.toLocalIterator():
        if block and size + len(body) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, body))
        size += len(body)
    if block:
        yield block


def _counted(docs: DataFrame, text_col: str, index: Index) -> dict:
    """Occurrences of the block's shingles over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        found = block.counts(
            value.as_py() for batch in batches for value in batch.column(0)
        )
        for length, numbers in found.items():
            used = np.flatnonzero(numbers)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), length)),
                    pa.array(block.by_length[length].keys[used].view(np.int64)),
                    pa.array(numbers[used]),
                ],
                names=["length", "hash", "n"],
            )

    rows = (
        docs.select(docs[text_col].alias("body"))
        .mapInArrow(count, "length long, hash long, n long")
        .groupBy("length", "hash")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return {(r["length"], r["hash"] % (1 << 64)): r["n"] for r in rows}


def _hits_udf(spark, index: Index):
    shared = spark.sparkContext.broadcast(index)

    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = shared.value
        for batch in batches:
            rows = []
            for value in batch:
                n, spans, items = block.hits(value.as_py())
                pairs = [{"begin": a, "end": b} for a, b in spans.tolist()]
                rows.append({"n_words": n, "spans": pairs, "items": items})
            yield pa.array(rows, _HITS_ARROW)

    hits.__annotations__ = {
        "batches": Iterator[pa.Array],
        "return": Iterator[pa.Array],
    }
    return F.arrow_udf(hits, returnType=_HITS)


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 1 << 24,
    into: str = "contamination",
) -> DataFrame:
    """``docs`` with a column ``into`` of {n_words, n_hit, spans, items}.

    Spans count words, from 0, end exclusive. All columns of ``docs`` stay, but one
    named ``into`` is replaced.
    """
    spark = docs.sparkSession
    rest = [docs[c] for c in docs.columns if c != into]
    rows = docs.select(
        F.struct(*rest).alias("row"),
        docs[id_col].alias("doc"),
        docs[text_col].alias("body"),
    )
    blocks = _blocks(bench, item_col, item_text_col, block_bytes)
    first, second = next(blocks, []), next(blocks, None)

    def block_hits(block: list[tuple[str, str]]):
        index = Index(block, window)
        index.choose_prefixes(_counted(docs, text_col, index))
        return _hits_udf(spark, index)

    if second is None:
        found = rows.withColumn("found", block_hits(first)("body"))
    else:
        found = _merged(rows, [first, second], blocks, block_hits)
    n_hit = F.aggregate(
        "found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"]
    )
    return found.select(
        "row.*",
        F.struct(
            "found.n_words", n_hit.alias("n_hit"), "found.spans", "found.items"
        ).alias(into),
    )


def _merged(rows: DataFrame, begun: list, blocks: Iterator, block_hits) -> DataFrame:
    """The hits of many blocks: each is written, then all are merged by text."""
    keyed = rows.withColumn("text_hash", F.sha2(F.coalesce("body", F.lit("")), 256))
    parts = None
    for block in chain(begun, blocks):
        hit = keyed.select("text_hash", block_hits(block)("body").alias("found"))
        hit = written(hit.where(F.size("found.spans") > 0), "block-hits")
        parts = hit if parts is None else parts.unionByName(hit)
    merged = (
        parts.select("text_hash", "found.spans", "found.items")
        .distinct()
        .groupBy("text_hash")
        .agg(
            F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(
                "items"
            ),
        )
        .withColumnRenamed("text_hash", "hit_hash")
    )
    words = block_hits([])
    joined = keyed.join(merged, F.col("text_hash") == F.col("hit_hash"), "left")
    return joined.select(
        "row",
        F.struct(
            words("body")["n_words"].alias("n_words"),
            F.coalesce(
                F.aggregate("spans", F.expr(f"cast(array() as {_SPAN_LIST})"), _joined),
                F.expr(f"cast(array() as {_SPAN_LIST})"),
            ).alias("spans"),
            F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        ).alias("found"),
    )


def _joined(spans, span):
    """``spans`` (sorted, apart) and one that begins no earlier than the last."""
    last = F.try_element_at(spans, F.lit(-1))
    wider = F.struct(
        last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end")
    )
    return F.when(
        (F.size(spans) > 0) & (span["begin"] <= last["end"]),
        F.concat(
            F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(wider)
        ),
    ).otherwise(F.concat(spans, F.array(span)))
