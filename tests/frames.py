"""Small postings tables for tests: give only the columns that matter."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from rolecall.model import POSTING_SCHEMA
from rolecall.sources.ingest import clean

_DEFAULTS = {
    "title": "Clerk",
    "categories": '[{"id":1,"category":"Admin"}]',
    "postedCompany_name": "Acme",
    "positionLevels": "Executive",
    "employmentTypes": "Permanent",
    "salary_minimum": 3000.0,
    "salary_maximum": 5000.0,
    "average_salary": 4000.0,
    "metadata_originalPostingDate": date(2023, 2, 3),
    "metadata_repostCount": 0,
    "metadata_totalNumberJobApplication": 10,
}


def postings(spark: SparkSession, *rows: dict) -> DataFrame:
    names = POSTING_SCHEMA.names
    values = [tuple({**_DEFAULTS, **row}[name] for name in names) for row in rows]
    return clean(spark.createDataFrame(values, POSTING_SCHEMA))


def named(industry: str) -> str:
    return f'[{{"id":1,"category":"{industry}"}}]'


def rows(frame: DataFrame) -> list[tuple]:
    return [tuple(row) for row in frame.collect()]
