"""Types from all cells, rows kept aside with their reasons, and loads by month."""

from datetime import date

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from frames import postings, rows
from rolecall.model import CLEAN_SCHEMA, POSTING_SCHEMA
from rolecall.sources import detect, ingest, quarantine
from rolecall.sources.star import write_as_csv


def _types(spark, **columns):
    names, cells = list(columns), list(columns.values())
    frame = spark.createDataFrame(list(zip(*cells)), ", ".join(f"`{n}` string" for n in names))
    found = detect.detect_types(frame.repartition(3)).collect()
    return {r["column"]: r for r in found}


def test_narrowest_type_that_all_cells_fit(spark):
    found = _types(
        spark,
        whole=["1", "-2", "+3", " 4 "],
        long=["1", "2147483648", None, ""],
        decimal=["1", "2.5", "1e3", "-.5"],
        truth=["true", "FALSE", "True", None],
        day=["2023-01-31", "1999-12-01", "2024-02-29", ""],
        european=["31/01/2023", "01/02/2023", None, None],
        american=["01/31/2023", "02/01/2023", "", None],
        either=["01/02/2023", "03/04/2023", "05/06/2023", None],
        words=["a", "b", "1", "2023-01-01"],
        nothing=[None, "", "  ", None],
        impossible=["2023-02-30", "2023-01-01", "2023-01-02", "2023-01-03"],
        huge=["1234567890123456789012", "1", "2", "3"],
    )
    kinds = {name: (r["type"], r["date_format"]) for name, r in found.items()}
    assert kinds == {
        "whole": ("int", None), "long": ("bigint", None), "decimal": ("double", None),
        "truth": ("boolean", None), "day": ("date", "yyyy-MM-dd"),
        "european": ("date", "dd/MM/yyyy"), "american": ("date", "MM/dd/yyyy"),
        "either": ("date", "dd/MM/yyyy"), "words": ("string", None),
        "nothing": ("string", None), "impossible": ("string", None), "huge": ("double", None),
    }
    assert (found["long"]["cells"], found["long"]["empty"]) == (2, 2)
    odd = found["impossible"]
    assert (odd["nearest"], odd["misfits"], odd["odd_cell"]) == ("date:yyyy-MM-dd", 1, "2023-02-30")
    assert (found["decimal"]["nearest"], found["decimal"]["misfits"]) == ("bigint", 3)


def test_one_late_odd_cell_changes_the_type(spark):
    cells = spark.range(20_000).selectExpr("cast(id as string) pay", "cast(id as string) place")
    assert rows(detect.detect_types(cells).filter("column = 'pay'"))[0][1] == "int"
    odd = cells.withColumn("pay", F.when(F.col("place") == "19999", "n/a").otherwise(F.col("pay")))
    found = detect.detect_types(odd, F.col("place")).filter("column = 'pay'").first()
    assert (found["type"], found["nearest"], found["misfits"]) == ("string", "bigint", 1)
    assert (found["odd_cell"], found["odd_place"]) == ("n/a", "19999")


def test_odd_shapes_and_the_least_of_them(spark):
    found = _types(
        spark,
        breaks=["12\n", "7", None, None],
        truths=["tRuE", "faLSe\n", "t", None],
        dates=["31/01/2023", "01/02/2023\r\n", "2023-01-31", None],
        mixed=["5", "2.5", "true", "x"],
        wide=["9" * 41, "3000000000", "1", None],
        codes=["1-URGENT", "2-HIGH", "-", "+"],
    )
    told = {n: (r["type"], r["nearest"], r["misfits"], r["odd_cell"]) for n, r in found.items()}
    assert told == {
        "breaks": ("int", None, None, None),
        "truths": ("string", "boolean", 1, "t"),
        "dates": ("string", "date:dd/MM/yyyy", 2, "01/02/2023\r\n"),
        "mixed": ("string", "double", 2, "true"),
        "wide": ("string", "bigint", 1, "9" * 41),
        "codes": ("string", None, None, None),
    }


def test_cells_are_hashed_not_sorted(spark):
    cells = spark.range(1000).selectExpr("cast(id as string) pay", "'a' name")
    text = detect.detect_types(cells)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate(keys=[at#" in text
    below = text[text.index("ObjectHashAggregate(keys=[at#") :]
    assert "SortAggregate" not in below and "Sort [" not in below


def test_no_rows_and_odd_names(spark):
    empty = spark.createDataFrame([], "`a.b` string, place string, cell_0 string")
    found = detect.detect_types(empty).collect()
    assert [(r["column"], r["type"], r["cells"]) for r in found] == [
        ("a.b", "string", 0), ("place", "string", 0), ("cell_0", "string", 0)
    ]
    assert detect.apply_types(empty, detect.detect_types(empty)).columns == empty.columns


def test_csv_with_detected_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,pay,day,note\n1,10,31/12/2023,x\n2,,01/02/2024,\n")
    (tmp_path / "b.csv").write_text('id,pay,day,note\n3,2.5,,"a, ""b"""\n4,7,05/06/2024,z,surplus\n')
    table, types = detect.read_csv_detected(spark, str(tmp_path))
    assert [f"{n} {t}" for n, t in table.dtypes[:4]] == ["id int", "pay double", "day date", "note string"]
    kept = sorted(rows(table.select("id", "pay", "day", "note", "malformed_row", "malformed_text")))
    assert kept == [
        (1, 10.0, date(2023, 12, 31), "x", False, None),
        (2, None, date(2024, 2, 1), None, False, None),
        (3, 2.5, None, 'a, "b"', False, None),
        (4, 7.0, date(2024, 6, 5), "z", True, "4,7,05/06/2024,z,surplus"),
    ]
    pay = types.filter("column = 'pay'").first()
    assert (pay["nearest"], pay["misfits"], pay["odd_place"].rsplit("/", 1)[1]) == ("bigint", 1, "b.csv")
    assert {r[0].rsplit("/", 1)[1] for r in rows(table.select("source_file"))} == {"a.csv", "b.csv"}


def _raw(spark, *changes):
    usual = {
        "title": "Clerk", "categories": '[{"category":"Admin"}]', "postedCompany_name": "Acme",
        "positionLevels": "Manager", "employmentTypes": "Contract", "salary_minimum": "1",
        "salary_maximum": "3", "average_salary": "2", "metadata_originalPostingDate": "2023-01-31",
        "metadata_repostCount": "0", "metadata_totalNumberJobApplication": "4", "malformed_row": False,
    }
    schema = ", ".join(f"{n} {'boolean' if n == 'malformed_row' else 'string'}" for n in usual)
    return spark.createDataFrame([tuple({**usual, **c}.values()) for c in changes], schema)


def test_every_row_is_clean_or_in_quarantine(spark, tmp_path):
    raw = _raw(
        spark, {}, {"title": "b", "average_salary": "much"}, {"title": "c", "average_salary": None},
        {"title": "d", "average_salary": "NaN", "metadata_repostCount": "2.5"}, {"title": None},
        {"title": "e", "malformed_row": True}, {},
    )
    kept, held = quarantine.split_postings(raw, str(tmp_path / "out"))
    assert kept.schema.names == CLEAN_SCHEMA.names and kept.count() == 3
    assert {r.rejected_cells for r in kept.collect()} == {0}
    assert held.columns == [*raw.columns, "reasons"]
    reasons = {r.title: r.reasons for r in held.collect()}
    assert reasons == {
        "b": ["average_salary"], "c": ["no average_salary"],
        "d": ["average_salary", "metadata_repostCount"], "e": ["malformed_row"],
    }
    as_came = raw.filter("title IN ('b', 'c', 'd', 'e')")
    assert sorted(held.drop("reasons").collect(), key=str) == sorted(as_came.collect(), key=str)
    counts = {r.reason: (r.rows, r.example) for r in quarantine.reason_counts(held).collect()}
    assert counts["average_salary"] == (2, "b") and counts["no average_salary"] == (1, "c")
    none, every = quarantine.split_postings(raw.limit(0), str(tmp_path / "none"))
    assert none.count() == every.count() == 0


def test_rows_are_not_sorted_into_the_two_folders(spark, tmp_path, monkeypatch):
    writers, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    write = DataFrameWriter.parquet

    def watched(self, *args, **options):
        seen.append(spark.conf.get(writers, None))
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    quarantine.split_postings(_raw(spark, {}, {"average_salary": "x"}), str(tmp_path / "a"))
    # Spark sorts from as many folders on as the setting says.
    assert int(seen[0]) > 2 and spark.conf.get(writers, None) is None
    spark.conf.set(writers, "1")
    try:
        quarantine.split_postings(_raw(spark, {}), str(tmp_path / "b"))
        assert int(seen[1]) > 2 and spark.conf.get(writers) == "1"
    finally:
        spark.conf.unset(writers)


def test_nothing_required_keeps_empty_salaries(spark, tmp_path):
    raw = _raw(spark, {"average_salary": None}, {"salary_minimum": "x"})
    kept, held = quarantine.split_postings(raw, str(tmp_path / "out"), required=())
    assert [r.average_salary for r in kept.collect()] == [None]
    assert [r.reasons for r in held.collect()] == [["salary_minimum"]]


def test_surplus_cells_and_files_stay_in_quarantine(spark, tmp_path):
    lines = ["1,x,,A,B,C,1,2,3,2023-01-01,0,1", "2,y,,A,B,C,1,2,3,2023-01-01,0,1,more"]
    (tmp_path / "in.csv").write_text("\n".join([",".join(["id", *POSTING_SCHEMA.names]), *lines]))
    raw = ingest.read_csv(spark, str(tmp_path / "in.csv"), with_source=True)
    kept, held = quarantine.split_postings(raw, str(tmp_path / "out"))
    assert kept.count() == 1
    row = held.first()
    assert row.malformed_text == lines[1] and row.source_file.endswith("in.csv") and row.id == "2"
    assert rows(quarantine.reason_counts(held)) == [("malformed_row", 1, 1, "y")]


def test_typed_salaries_that_are_no_numbers_are_rejected(spark):
    values = [(float("nan"),), (float("inf"),), (1500.0,), (None,)]
    raw = spark.createDataFrame(values, "average_salary double")
    others = [f"cast(null as {f.dataType.simpleString()}) {f.name}"
              for f in POSTING_SCHEMA if f.name != "average_salary"]
    table = ingest.clean(raw.selectExpr("average_salary", *others))
    got = sorted(rows(table.select("average_salary", "rejected_cells")), key=str)
    assert got == [(1500.0, 0), (None, 0), (None, 1), (None, 1)]


def test_csv_round_trip_keeps_every_cell(spark, tmp_path):
    odd = ['a "quoted" one', "a, b", " blanks ", "é ß", None, 'x""y']
    raw = _raw(spark, *[{"title": t, "malformed_row": k == 1} for k, t in enumerate(odd)])
    write_as_csv(raw, str(tmp_path / "csv"), files=2)
    back = ingest.read_csv(spark, f"{tmp_path}/csv/*/*.txt")
    got = sorted(rows(back.select("title", "malformed_row")), key=str)
    assert got == sorted(((t, k == 1) for k, t in enumerate(odd)), key=str)


def test_csv_files_are_of_bounded_size(spark, tmp_path):
    raw = _raw(spark, *[{"title": f"t\n{k}", "malformed_row": k % 5 == 0} for k in range(45)])
    write_as_csv(raw.repartition(2), str(tmp_path / "csv"), rows=10)
    back = ingest.read_csv(spark, f"{tmp_path}/csv/*/*.txt", with_source=True)
    got = sorted(rows(back.select("title", "malformed_row")))
    assert got == sorted((f"t\n{k}", k % 5 == 0) for k in range(45))
    sizes = [n for _, n in rows(back.groupBy("source_file").count())]
    assert max(sizes) == 10 and len(sizes) >= 5
    write_as_csv(raw.limit(0), str(tmp_path / "none"))
    none = ingest.read_csv(spark, f"{tmp_path}/none/*/*.txt")
    assert none.columns == raw.columns and none.count() == 0


def _loaded(spark, path):
    table = ingest.open_months(spark, path)
    return sorted(
        ((r.title, r.load, str(r.posting_month)) for r in table.collect()), key=str
    )


def test_a_late_delivery_rewrites_its_months_only(spark, tmp_path):
    path = str(tmp_path / "table")
    def made(*pairs):
        return postings(spark, *[
            {"title": t, "metadata_originalPostingDate": d} for t, d in pairs
        ])
    january, february, march = date(2023, 1, 9), date(2023, 2, 3), date(2023, 3, 3)
    first = made(("a", january), ("b", february), ("c", None))
    assert sorted(rows(ingest.load_month_files(first, path, "one")), key=str) == [
        (None, 1), (date(2023, 1, 1), 1), (date(2023, 2, 1), 1)
    ]
    ingest.load_month_files(made(("d", january)), path, "two")
    once = _loaded(spark, path)
    other = sorted((tmp_path / "table" / "posting_month=2023-01-01" / "load=two").iterdir())
    ingest.load_month_files(first, path, "one")
    assert _loaded(spark, path) == once
    # A corrected delivery leaves a month and the undated rows, and enters another.
    ingest.load_month_files(made(("a2", january), ("m", march)), path, "one")
    assert _loaded(spark, path) == [
        ("a2", "one", "2023-01-01"), ("d", "two", "2023-01-01"), ("m", "one", "2023-03-01")
    ]
    assert sorted((tmp_path / "table" / "posting_month=2023-01-01" / "load=two").iterdir()) == other
    assert ingest.open_months(spark, path).columns == [*CLEAN_SCHEMA.names, "posting_month", "load"]


def test_no_rows_and_unfit_delivery_names(spark, tmp_path):
    empty = postings(spark).limit(0)
    assert rows(ingest.load_month_files(empty, str(tmp_path / "t"), "none")) == []
    with pytest.raises(ValueError):
        ingest.load_month_files(empty, str(tmp_path / "t"), "a/b")
