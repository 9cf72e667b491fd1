"""What each filter of a cleaning chain removes, in every order of the filters.

Each filter's failing rows are stored as a relation of row ids. The rows that fail
anything are put once under every set of filters that may come before a step (a
prefix; 2 to the number of filters), and a left-anti join with each relation takes away
those that a filter of the prefix has removed. A left-semi join of these survivors with
the relations gives what a next filter removes, with the labels lost. What a
filter would have removed alone, less what it removes after a prefix, is redundant
there. Only then, over one row for each part, prefix and filter, are the orders spelled
out. Rows that fail nothing are counted, not joined.

Rows have ids of their own, so rows that share an id, or are equal, each count. Defined
results: a null text is an empty one; a null part is the part ''; a row without id
repeats nothing (it has no smaller id), but rows with an id don't repeat it either;
of rows with equal text and equal id, none has a smaller one; a document is good, or toxic,
if any label row of its id says so; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rolecall.llm.groups import join_groups
from rolecall.llm.scratch import written

Test = Callable[[Column], Column]

_SPLITS = 16


def words_of(text: Column) -> Column:
    """The words between ASCII white space."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def too_short(text: Column) -> Column:
    return F.size(words_of(text)) < 200


def too_repetitive(text: Column) -> Column:
    words = words_of(text)
    return 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)


def too_loud(text: Column) -> Column:
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return 100 * capitals.cast("long") > 3 * F.char_length(text)


def has_symbols(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


TESTS: dict[str, Test] = {
    "A": too_short,
    "B": too_repetitive,
    "C": too_loud,
    "D": has_symbols,
}


def _judged(
    docs: DataFrame, tests: dict[str, Test], id_col: str, text_col: str, part_col: str
) -> DataFrame:
    """uid, id, part, a digest of the text, and one flag for each test."""
    rows = docs.select(
        docs[id_col].cast("long").alias("id"),
        F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs[text_col], F.lit("")).alias("body"),
    )
    flags = [test(F.col("body")).alias(f"fails_{k}") for k, test in enumerate(tests.values())]
    judged = rows.select(
        F.monotonically_increasing_id().alias("uid"),
        "id",
        "part",
        F.unhex(F.sha2("body", 256)).alias("digest"),
        *flags,
    )
    # Written, so that each row keeps its uid.
    return written(judged, "judged")


def _by_merge(ids: DataFrame) -> DataFrame:
    """``ids``, never broadcast: files of row ids are far smaller than the rows in memory.

    Spark goes by the files, of a byte or two for a row, and copies of labels count as
    one; the driver would build tables of millions of rows.
    """
    return ids.hint("merge")


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Adds good and toxic; a frequent id, or rows without one, are split."""

    def says(name: str) -> Column:
        return F.max(F.coalesce(labels[name] == 1, F.lit(False)))

    known = (
        labels.groupBy(labels[id_col].cast("long").alias("labelled"))
        .agg(says("quality").alias("good"), says("toxic").alias("toxic"))
        .where("labelled IS NOT NULL AND (good OR toxic)")
        .withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(_SPLITS - 1))))
    )
    split = F.pmod(F.xxhash64("uid"), F.lit(_SPLITS))
    same = (F.col("id") == F.col("labelled")) & (split == F.col("split"))
    joined = rows.join(_by_merge(known), same, "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return joined.select(*[rows[c] for c in rows.columns], *flags)


def failing_relations(
    docs: DataFrame,
    labels: DataFrame,
    tests: dict[str, Test] = TESTS,
    repeats: str = "E",
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All judged rows, and for each filter a table (uid, part, good, toxic) of those failing.

    The filter ``repeats`` fails rows whose text stands under a smaller id.
    """
    rows = _judged(docs, tests, id_col, text_col, part_col)
    keep = ["uid", "id", "part"]
    groups = rows.groupBy(F.col("digest").alias("same_text")).agg(
        F.count("*").alias("n"), F.min("id").alias("first")
    )
    groups = written(groups.where("n > 1"), "repeated-texts")
    later = join_groups(rows, "digest", groups, "same_text", "n").where("id > first")
    failing = {
        name: rows.where(f"fails_{k}").select(*keep) for k, name in enumerate(tests)
    }
    failing[repeats] = later.select(*keep)
    stored = {
        name: written(_labelled(table, labels, id_col).drop("id"), f"failing-{k}")
        for k, (name, table) in enumerate(failing.items())
    }
    return rows, stored


def _survivors(failing: dict[str, DataFrame]) -> DataFrame:
    """(uid, part, good, toxic, prefix) of failing rows that outlive a prefix's filters."""
    union = None
    for table in failing.values():
        union = table if union is None else union.unionByName(table)
    one = [F.first(c).alias(c) for c in ("part", "good", "toxic")]
    rows = union.groupBy("uid").agg(*one)
    prefixes = F.sequence(F.lit(0), F.lit((1 << len(failing)) - 1))
    rows = rows.withColumn("prefix", F.explode(prefixes))
    for k, table in enumerate(failing.values()):
        gone = table.select(F.col("uid").alias("gone"))
        held = (F.col("uid") == F.col("gone")) & (F.col("prefix").bitwiseAND(1 << k) != 0)
        rows = rows.join(_by_merge(gone), held, "left_anti")
    return rows


def _removals(survivors: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """(part, prefix, next, removed, good_lost, toxic_lost)."""
    relations = None
    for k, table in enumerate(failing.values()):
        ids = table.select(F.col("uid").alias("fails"), F.lit(1 << k).alias("by"))
        relations = ids if relations is None else relations.unionByName(ids)
    bits = F.array(*[F.lit(1 << k) for k in range(len(failing))])
    unused = F.filter(bits, lambda bit: F.col("prefix").bitwiseAND(bit) == 0)
    each = survivors.withColumn("next", F.explode(unused))
    # By uid alone, as the rows already lie; the filter is a further condition.
    same = (F.col("uid") == F.col("fails")) & (F.col("next").bitwiseAND(F.col("by")) != 0)
    return (
        each.join(_by_merge(relations), same, "left_semi")
        .groupBy("part", "prefix", "next")
        .agg(
            F.count("*").alias("removed"),
            F.count_if("good").alias("good_lost"),
            F.count_if("toxic").alias("toxic_lost"),
        )
    )


def _orders(spark: SparkSession, names: list[str]) -> DataFrame:
    """(prefix, next, filter_order, step): every step of every order."""
    rows = []
    for order in permutations(range(len(names))):
        prefix, label = 0, "".join(names[k] for k in order)
        for step, k in enumerate(order, 1):
            rows.append((prefix, 1 << k, label, step))
            prefix |= 1 << k
    return spark.createDataFrame(rows, "prefix int, next int, filter_order string, step int")


def _steps(names: list[str]) -> Column:
    """Each prefix and next filter, with the number of orders that have this step."""
    pairs = []
    for prefix in range(1 << len(names)):
        used = prefix.bit_count()
        ways = factorial(used) * factorial(len(names) - used - 1) if used < len(names) else 0
        for k in range(len(names)):
            if not prefix >> k & 1:
                pairs.append(f"struct({prefix} AS prefix, {1 << k} AS next, {ways}L AS ways)")
    return F.expr(f"inline(array({', '.join(pairs)}))")


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    tests: dict[str, Test] = TESTS,
    repeats: str = "E",
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """One row for each part, order of the filters and step.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (the filter's removals summed over all orders).
    Filters have names of one letter; their number should stay small, as orders grow
    with its factorial.
    """
    rows, failing = failing_relations(
        docs, labels, tests, repeats, id_col, text_col, part_col
    )
    names = list(failing)
    survivors = _survivors(failing)
    # Both have at most one row for each part, prefix and filter.
    removals = written(_removals(survivors, failing), "removals")
    left = survivors.groupBy("part", "prefix").agg(F.count("*").alias("left"))
    left = written(left, "survivors")

    failing_any = left.where("prefix = 0").select("part", F.col("left").alias("failing_any"))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.join(failing_any, "part", "left").fillna(0, ["failing_any"])
    grid = parts.select("part", "n", "failing_any", _steps(names))
    grid = grid.withColumn("after", F.col("prefix").bitwiseOR(F.col("next")))
    left = left.withColumnRenamed("prefix", "after")
    table = (
        grid.join(removals, ["part", "prefix", "next"], "left")
        .join(left, ["part", "after"], "left")
        .fillna(0, ["removed", "good_lost", "toxic_lost", "left"])
    )
    # One part's window holds a filter's prefixes only, sixteen for five filters.
    window = Window.partitionBy("part", "next")
    alone = F.when(F.col("prefix") == 0, F.col("removed"))
    others = (1 << len(names)) - 1 - F.col("next")
    unique = F.when(F.col("prefix") == others, F.col("removed"))
    table = table.select(
        "part",
        "prefix",
        "next",
        (F.col("n") - F.col("failing_any") + F.col("left")).alias("kept"),
        "removed",
        (F.max(alone).over(window) - F.col("removed")).alias("redundant"),
        F.max(unique).over(window).alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        F.sum(F.col("removed") * F.col("ways")).over(window).alias("shapley"),
    )
    # As many rows as the orders have steps, whatever the data.
    orders = F.broadcast(_orders(docs.sparkSession, names))
    found = table.join(orders, ["prefix", "next"]).drop("prefix", "next")
    first = ["part", "filter_order", "step"]
    return found.select(*first, *[c for c in found.columns if c not in first])
