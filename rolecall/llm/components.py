"""Connected components of a table of links, by stars (Kiveris et al., 2014).

Every node learns the least node it is joined to, in turns over larger and smaller
neighbours, until nothing changes; the number of rounds grows with the logarithm of
the longest path. Minima are aggregated before the shuffle, and neighbours are never
gathered, so a node with very many links is no task's burden. Each round is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rolecall.llm.scratch import written


def _rewired(links: DataFrame, larger: bool) -> DataFrame:
    """Point neighbours to the least: the larger ones, or node and smaller ones."""
    if larger:
        links = links.unionByName(links.selectExpr("b AS a", "a AS b"))
    least = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    least = least.withColumn("m", F.least("node", "m"))
    moved = links.join(least, links["a"] == least["node"])
    if larger:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a != b").distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node of it), from links of columns a and b.

    Nodes without a link to another node, and null nodes, are absent.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = written(links.where("a != b").distinct(), "links")
    mark = _mark(links)
    while True:
        links = written(_rewired(_rewired(links, True), False), "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
