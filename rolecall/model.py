"""The postings table: column types and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per posting, as delivered. Salaries are monthly amounts.
POSTING_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("categories", T.StringType()),
        T.StructField("postedCompany_name", T.StringType()),
        T.StructField("positionLevels", T.StringType()),
        T.StructField("employmentTypes", T.StringType()),
        T.StructField("salary_minimum", T.DoubleType()),
        T.StructField("salary_maximum", T.DoubleType()),
        T.StructField("average_salary", T.DoubleType()),
        T.StructField("metadata_originalPostingDate", T.DateType()),
        T.StructField("metadata_repostCount", T.IntegerType()),
        T.StructField("metadata_totalNumberJobApplication", T.IntegerType()),
    ]
)

# The cleaned table adds what is derived once at ingest.
CLEAN_SCHEMA = T.StructType(
    POSTING_SCHEMA.fields
    + [
        T.StructField("primary_category", T.StringType()),
        T.StructField("rejected_cells", T.IntegerType()),
    ]
)

CATEGORY_LIST_TYPE = "array<struct<id:int,category:string>>"

# The levels in order of seniority, and the employment types.
LEVELS = [
    "Fresh/entry level",
    "Junior Executive",
    "Non-executive",
    "Executive",
    "Senior Executive",
    "Professional",
    "Manager",
    "Middle Management",
    "Senior Management",
]
EMPLOYMENT_TYPES = [
    "Permanent",
    "Full Time",
    "Contract",
    "Part Time",
    "Temporary",
    "Internship/Attachment",
    "Freelance",
]
