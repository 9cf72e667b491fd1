"""The filter audit against a brute-force version."""

import re
from itertools import permutations

import pytest

from rolecall.llm import filter_audit as audit
from rolecall.llm.filter_audit import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _fails(rows):
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    out = []
    for doc, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        out.append({
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc is not None and least[text] < doc,
        })
    return out


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    fails = _fails(rows)
    good = {d for d, quality, _ in labels if d is not None and quality == 1}
    toxic = {d for d, _, bad in labels if d is not None and bad == 1}
    parts = {p or "" for _, _, p in rows}
    out, removed_by = [], {}
    for part in parts:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            alive = list(range(len(mine)))
            for step, name in enumerate(order, 1):
                gone = [i for i in alive if mine[i][1][name]]
                before = set(range(len(mine))) - set(alive)
                alive = [i for i in alive if not mine[i][1][name]]
                removed_by[part, name] = removed_by.get((part, name), 0) + len(gone)
                out.append([
                    part, "".join(order), step, len(alive), len(gone),
                    sum(mine[i][1][name] for i in before),
                    sum(f[name] and sum(f.values()) == 1 for _, f in mine),
                    sum(mine[i][0] in good for i in gone),
                    sum(mine[i][0] in toxic for i in gone),
                ])
    return sorted((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


LONG = " ".join(f"word{i}" for i in range(220))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "de"), (3, LONG + " #", "en"),
    (4, LONG.upper(), "de"), (5, "a " * 300, "de"), (6, "a\x0b\x0ca\t\r\n" * 120, "en"),
    (7, None, "en"), (8, "", None), (9, "   ", None), (None, LONG, "en"),
    (None, None, None), (10, "A" * 3 + "b" * 97, ""), (11, "A" * 4 + "é" * 96, ""),
    (12, LONG + " é x", "fr"), (13, "x " * 100_000, "fr"), (1, LONG + " again", "en"),
    (14, LONG + " $", "fr"), (15, LONG + " $", "fr"), (16, LONG + " $", "fr"),
    (17, " ".join(["a"] * 100 + [f"b{i}" for i in range(100)]), "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, 1, 1), (7, 0, 1), (7, 1, 0), (None, 1, 1),
          (13, None, 1), (16, 1, None), (99, 1, 1)]


def _audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # Extra columns that have the names used inside.
    docs = docs.selectExpr("*", "1 AS uid", "2 AS prefix", "lang AS part", "3 AS n", "4 AS good")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    told = told.selectExpr("*", "5 AS uid", "6 AS split", "'x' AS lang")
    frame = filter_audit(docs.repartition(3), told)
    assert frame.columns == ["part", "filter_order", "step", "kept", "removed", "redundant",
                             "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("rows", [ROWS, ROWS[:2], [(1, LONG, "en")], [(None, None, None)]])
def test_equals_brute_force(spark, rows):
    assert _audited(spark, rows, LABELS) == brute_audit(rows, LABELS)


def test_no_labels_and_no_documents(spark):
    assert _audited(spark, ROWS, []) == brute_audit(ROWS, [])
    assert _audited(spark, [], LABELS) == []


def test_one_text_may_hold_a_third_of_all_rows(spark):
    rows = [(i, LONG if i % 3 else LONG + f" {i}", "en") for i in range(3000)]
    got = {r[1:3]: r for r in _audited(spark, rows, []) if r[2] == 1}
    assert got["EABCD", 1][4] == 1999 and got["EABCD", 1][3] == 1001


def test_every_order_removes_the_same_in_all(spark):
    per_order = {}
    for r in _audited(spark, ROWS, LABELS):
        per_order.setdefault((r[0], r[1]), []).append(r)
    totals = {}
    for (part, _), steps in per_order.items():
        last = max(steps, key=lambda r: r[2])
        totals.setdefault(part, set()).add((sum(r[4] for r in steps), last[3]))
    assert all(len(found) == 1 for found in totals.values())


def test_the_driver_holds_no_row_ids(spark):
    """Their files are small at any number of rows, so Spark would broadcast them."""

    def plan(frame):
        frame.collect()
        return frame._jdf.queryExecution().executedPlan().toString()

    ids = "id AS uid, 'en' AS part, id % 2 = 0 AS good, id % 3 = 0 AS toxic"
    failing = {name: spark.range(k, 40, k).selectExpr(*ids.split(", ")) for k, name in
               ((2, "A"), (3, "B"), (5, "C"))}
    survivors = audit._survivors(failing)
    found = sorted(tuple(r) for r in audit._removals(survivors, failing).collect())
    want = {}
    for uid in range(2, 40):
        fails = sum(1 << k for k, n in enumerate((2, 3, 5)) if uid % n == 0)
        for prefix in range(8):
            for bit in (1, 2, 4):
                if fails & bit and not prefix & bit and not fails & prefix:
                    row = want.setdefault(("en", prefix, bit), [0, 0, 0])
                    for k, one in enumerate((True, uid % 2 == 0, uid % 3 == 0)):
                        row[k] += one
    assert found == sorted((*key, *row) for key, row in want.items())
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    labelled = audit._labelled(spark.range(9).selectExpr("id AS uid", "id"), labels, "doc_id")
    for frame in (audit._removals(survivors, failing), labelled):
        assert "SortMergeJoin" in plan(frame) and "Broadcast" not in plan(frame)
