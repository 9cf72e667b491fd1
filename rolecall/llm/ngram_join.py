"""Documents linked by the Jaccard similarity of their word shingles.

A document's set holds its distinct shingles of four words, A-Z lower-cased. Two
documents link when 100 * |X and Y| >= 85 * |X or Y|. Each document gets its class:
the smallest id that links lead to.

1. Equal word sequences become one class; from here on its smallest id stands for it.
2. Which documents can link at all. By the order of their hashes, a set of n keeps its
   first n - t + l shingles, where t = ceil(0.85 n) is the least overlap and l about
   5 % of n. Linked sets share at least l' of those (l' is l for the smallest partner
   allowed). By the order of frequency among these rows, rarest first, all but the last
   l' - 1 must then still hold a common one. So a set without enough repeated shingles
   is out, and shingles that stand everywhere seldom lead anywhere.
3. What is left falls into clusters, joined by common shingles. No link crosses them.
   Clusters are told apart once more by the same rule over whole sets.
4. In each cluster a T-occurrence search answers each set's query: DivideSkip sets its
   longest inverted lists aside, merges the short ones, and probes the long ones by
   binary search for those that can still reach T. A large cluster is cut into blocks,
   and every pair of blocks is a task of its own. Every candidate is verified. A task
   hands on each class's number of linked documents, and enough links to join all
   that they join.
5. These give the components, and with the sizes of the classes each document's links.

Nothing is capped, and shingles have 64-bit hashes. Classes of the same smallest id, which
only rows that share an id can bring about, are one class in steps 2 to 5. Defined
results: a null text or one without words has an empty set and links with nothing, not
even with its copies; a text of fewer words has its whole sequence as its one shingle; a
row without id has a null class unless other rows link to it, no number of links, and
counts as nobody's link; repeated rows get equal results and are links of each other; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rolecall.llm.components import components
from rolecall.llm.scratch import written
from rolecall.llm.text import Words, runs

PERCENT = 85
SLACK = 5  # percent of a set that the first filter asks to be repeated
BLOCK = 128  # documents of a cluster in one block
MU = 1.0  # DivideSkip's weight of a probe against a merge step
_STEPS = 1 << 20  # merge steps at a time


def shingles(words: Words, size: int) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(runs(words.hashes, min(size, len(words))))


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _slack(n: int) -> int:
    return max(1, SLACK * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + _slack(n)


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int):
    """doc, key of its word sequence, n, spare (l' - 1), first shingles; written."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                keys, sizes, spare, heads = [], [], [], []
                for text in part.column(1):
                    words = Words(text.as_py(), lower=True)
                    found = shingles(words, size)
                    n = len(found)
                    plain = b" ".join(words.data.split())
                    keys.append(hashlib.blake2b(plain, digest_size=16).digest())
                    sizes.append(n)
                    spare.append(_slack(least_overlap(n, percent)) - 1)
                    heads.append(found[: prefix_length(n, percent) if n else 0])
                ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
                flat = np.concatenate([*heads, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(keys, pa.binary()),
                        pa.array(sizes, pa.int64()),
                        pa.array(spare, pa.int64()),
                        pa.ListArray.from_arrays(ends, flat),
                    ],
                    names=["doc", "key", "n", "spare", "head"],
                )

    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("t"))
    schema = "doc long, key binary, n long, spare long, head array<long>"
    return written(rows.mapInArrow(read, schema), "sets")


def _clusters(classes: DataFrame) -> DataFrame:
    """node and component: classes that may link, by common shingles."""
    heads = classes.select("rep", "spare", F.explode("head").alias("h"))
    often = heads.groupBy("h").count().where("count > 1")
    rows = heads.join(often.withColumnRenamed("h", "shingle"), F.expr("h = shingle"))
    kept = (
        rows.groupBy("rep", "spare")
        .agg(F.sort_array(F.collect_list(F.struct("count", "h"))).alias("found"))
        .where("size(found) > spare")
        .select("rep", F.explode(F.expr("slice(found, 1, size(found) - int(spare)).h")))
        .toDF("rep", "h")
    )
    kept = written(kept, "candidates")
    hubs = kept.groupBy(F.col("h").alias("shingle")).agg(F.min("rep").alias("hub"))
    stars = kept.join(hubs, kept["h"] == hubs["shingle"])
    return components(stars.select(F.col("rep").alias("a"), F.col("hub").alias("b")))


def _merged(inverted, start, length, n: int, x: int) -> np.ndarray:
    """How often each rank below ``x`` stands in the lists, by parts of bounded size."""
    met = np.zeros(x, np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(length) // _STEPS)) + 1
    for begin, steps in zip(np.split(start, cuts), np.split(length, cuts)):
        at = np.repeat(begin - np.cumsum(steps) + steps, steps) + np.arange(steps.sum())
        met += np.bincount(inverted[at] % n, minlength=x)[:x]
    return met


def linked(
    sets: list[np.ndarray], percent: int, blocks: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """All links, and enough of them to join all that they join; as rows of two places.

    With ``blocks``, only links between different blocks.
    """
    order = np.array(sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)))
    size = np.array([len(sets[i]) for i in order], np.int64)
    n = len(order)
    flat = np.concatenate([sets[i] for i in order])
    _, token = np.unique(flat, return_inverse=True)
    # Inverted lists, one after another: token * n + rank, in order.
    inverted = np.sort(token * n + np.repeat(np.arange(n), size))
    begins = np.r_[0, np.cumsum(size)]
    parent, links, spanning = np.arange(n), [], []
    for x in range(1, n):
        least = least_overlap(int(size[x]), percent)
        low = int(np.searchsorted(size, least))
        if not size[x] or low >= x:
            continue
        mine = token[begins[x] : begins[x + 1]].astype(np.int64)
        start = np.searchsorted(inverted, mine * n + low)
        length = np.searchsorted(inverted, mine * n + x) - start
        need = -(-percent * (int(size[x]) + least) // (100 + percent))
        by_length = np.argsort(-length, kind="stable")
        longest = max(2, int(length[by_length[0]]))
        aside = int(min(need - 1, need / (MU * np.log2(longest) + 1)))
        long, short = by_length[:aside], by_length[aside:]
        # Merge the short lists: how often each candidate stands in them.
        met = _merged(inverted, start[short], length[short], n, x)
        chosen = np.flatnonzero(met >= max(1, need - aside))
        if blocks is not None:
            chosen = chosen[blocks[order[chosen]] != blocks[order[x]]]
        if not len(chosen):
            continue
        # Probe the long lists by binary search.
        both = met[chosen]
        for probed in np.array_split(long, len(long) * len(chosen) // _STEPS + 1):
            wanted = mine[probed][:, None] * n + chosen
            place = np.minimum(np.searchsorted(inverted, wanted), len(inverted) - 1)
            both = both + (inverted[place] == wanted).sum(axis=0)
        found = chosen[100 * both >= percent * (size[chosen] + size[x] - both)]
        links.append(np.stack([np.full(len(found), order[x]), order[found]], axis=1))
        roots, first = np.unique(parent[found], return_index=True)
        new = roots != parent[x]
        if new.any():
            parts = order[found[first[new]]]
            spanning.append(np.stack([np.full(len(parts), order[x]), parts], axis=1))
            parent[np.isin(parent, roots[new])] = parent[x]
    none = np.zeros((0, 2), np.int64)
    return np.concatenate([none, *links]), np.concatenate([none, *spanning])


def _members(docs, clusters, id_col, text_col, size) -> DataFrame:
    """node, cluster, set of all that may link; written."""
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("t"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                found = [
                    shingles(Words(text.as_py(), lower=True), size)
                    for text in part.column(2)
                ]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
                sets = pa.ListArray.from_arrays(ends, flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), sets],
                    names=["node", "cluster", "set"],
                )

    # What may link grows with the corpus, so it is never broadcast.
    joined = texts.join(clusters.hint("merge"), texts["id"] == clusters["node"])
    rows = joined.select("node", F.col("component").alias("cluster"), "t").mapInArrow(
        read, "node long, cluster long, set array<long>"
    )
    return written(rows, "members")


def _sized(clusters: DataFrame) -> DataFrame:
    members = clusters.groupBy(F.col("cluster").alias("name")).agg(
        F.count("*").alias("members")
    )
    return clusters.join(members, F.expr("cluster = name")).drop("name")


def _split(members: DataFrame, percent: int) -> DataFrame:
    """node, cluster, members: clusters are told apart further.

    Inside a cluster whole sets are ordered, rarest first. Linked sets share at least
    t, so all but the last t - 1 of a set's repeated shingles hold a common one.
    """
    least = F.expr(f"({percent} * size(set) + 99) div 100").alias("least")
    rows = members.select("node", "cluster", least, F.explode("set").alias("h"))
    often = rows.groupBy(F.col("cluster").alias("c"), F.col("h").alias("shingle")).count()
    often = often.where("count > 1")
    kept = (
        rows.join(often, F.expr("cluster = c AND h = shingle"))
        .groupBy("node", "cluster", "least")
        .agg(F.sort_array(F.collect_list(F.struct("count", "h"))).alias("found"))
        .where("size(found) >= least")
        .select(
            "node",
            "cluster",
            F.explode(F.expr("slice(found, 1, int(size(found) - least + 1)).h")).alias("h"),
        )
    )
    kept = written(kept, "candidates")
    hubs = kept.groupBy(F.col("cluster").alias("c"), F.col("h").alias("shingle"))
    hubs = hubs.agg(F.min("node").alias("hub"))
    stars = kept.join(hubs, F.expr("cluster = c AND h = shingle"))
    parts = components(stars.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    parts = parts.select("node", F.col("component").alias("cluster"))
    return written(_sized(parts), "clusters")


def _links(members: DataFrame, weights: DataFrame, percent: int) -> DataFrame:
    """a and b: links between classes, enough of them to join all that link.

    And a and n without b: numbers of documents linked to class a, to be added up;
    ``weights`` has the number of documents of each class.
    """
    sized = _split(members, percent)
    bins = max(1, sized.count() // (2 * BLOCK))
    # Small clusters share a task by their hash; a large one has a task for each pair
    # of its blocks, and each document goes to all pairs that its block is in.
    blocks = F.expr(f"cast((members + {BLOCK - 1}) div {BLOCK} as int)")
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    sized = sized.withColumn("blocks", blocks).withColumn("block", block)
    other = F.explode(F.expr("if(blocks = 1, array(0), sequence(0, blocks - 1))"))
    share = F.when(
        F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))
    ).otherwise(F.col("cluster"))
    sized = sized.join(weights, sized["node"] == weights["rep"])
    sets = members.select(F.col("node").alias("id"), "set")
    rows = (
        sets.join(sized.hint("merge"), F.expr("id = node"))
        .withColumn("other", other)
        .select(
            "node",
            "cluster",
            "block",
            "set",
            "weight",
            (F.col("blocks") > 1).alias("large"),
            share.alias("share"),
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
        )
    )

    def search(table: pa.Table) -> pa.Table:
        cluster = table["cluster"].to_numpy()
        node, block = table["node"].to_numpy(), table["block"].to_numpy()
        column = table["set"].combine_chunks()
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
        sets = [flat[x:y] for x, y in zip(ends[:-1], ends[1:])]
        cross = bool(len(block)) and block.min() != block.max() and table["large"][0].as_py()
        weight = table["weight"].to_numpy()
        joins, ends_of, adds = [], [], []
        order = np.lexsort((node, cluster))
        cuts = np.flatnonzero(np.diff(cluster[order])) + 1
        for mine in np.split(order, cuts):
            links, spanning = linked(
                [sets[i] for i in mine], percent, block[mine] if cross else None
            )
            joins.append(node[mine[spanning]])
            # Rows that share an id are one node, and a link counts once.
            names, first, place = np.unique(
                node[mine], return_index=True, return_inverse=True
            )
            pairs = np.unique(np.sort(place[links], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            many = weight[mine][first]
            total = np.zeros(len(names), np.int64)
            np.add.at(total, pairs[:, 0], many[pairs[:, 1]])
            np.add.at(total, pairs[:, 1], many[pairs[:, 0]])
            used = np.flatnonzero(total)
            ends_of.append(names[used])
            adds.append(total[used])
        none = np.zeros(0, np.int64)
        joined = np.concatenate([np.zeros((0, 2), np.int64), *joins])
        ends_of, adds = np.concatenate([none, *ends_of]), np.concatenate([none, *adds])
        left, right = pa.nulls(len(joined), pa.int64()), pa.nulls(len(adds), pa.int64())
        return pa.table(
            {
                "a": pa.chunked_array([joined[:, 0], ends_of], pa.int64()),
                "b": pa.chunked_array([pa.array(joined[:, 1]), right], pa.int64()),
                "n": pa.chunked_array([left, pa.array(adds)], pa.int64()),
            }
        )

    found = rows.groupBy("large", "share", "i", "j").applyInArrow(
        search, "a long, b long, n long"
    )
    return written(found, "found")


def ngram_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4,
    percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row for each row of ``docs``.

    ``n_links`` counts the other rows that a document links to, equal texts among them.
    """
    sets = _sets(docs, id_col, text_col, size, percent)
    classes = sets.where("n > 0 AND doc IS NOT NULL").groupBy("key").agg(
        F.min("doc").alias("rep"),
        F.first("spare").alias("spare"),
        F.first("head").alias("head"),
    )
    members = _members(docs, _clusters(classes), id_col, text_col, size)
    weights = (
        sets.where("n > 0 AND doc IS NOT NULL")
        .groupBy("key")
        .agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
        .groupBy("rep")
        .agg(F.sum("copies").alias("weight"))
    )
    links = _links(members, weights, percent)
    joined = components(links.where("b IS NOT NULL").select("a", "b"))
    others = links.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("others"))
    reps = (
        sets.where("n > 0")
        .groupBy(F.col("key").alias("class"))
        .agg(F.min("doc").alias("rep"), F.count("doc").alias("copies"))
        .join(joined, F.expr("rep = node"), "left")
        .join(others, F.expr("rep = a"), "left")
        .select(
            "class",
            F.coalesce("component", "rep").alias("joined"),
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
        )
    )
    return sets.join(reps, (F.col("key") == F.col("class")) & (F.col("n") > 0), "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("joined", "doc").alias("component_id"),
        F.when(F.col("doc").isNotNull(), F.coalesce("links", F.lit(0))).alias("n_links"),
    )
