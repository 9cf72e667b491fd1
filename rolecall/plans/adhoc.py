"""Free SQL text over the postings table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame


def ask(postings: DataFrame, text: str, **parameters: Any) -> DataFrame:
    """Runs SQL text in which ``{postings}`` is the table and ``:name`` a parameter.

    Values are bound as literals, never put into the text.
    """
    return postings.sparkSession.sql(text, args=parameters, postings=postings)
