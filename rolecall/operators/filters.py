"""The optional-clause filter shared by the filtered reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class PostingFilter:
    """A salary range, always applied, and choices that apply when not empty.

    A lower bound of 0 means 1, so that unpaid postings never pass. Null salaries
    never pass either. ``salary_to=None`` sets no upper bound. ``extra`` is any further
    condition.
    """

    salary_from: float = 0
    salary_to: float | None = 30000
    industries: tuple[str, ...] = ()
    employment_types: tuple[str, ...] = ()
    levels: tuple[str, ...] = ()
    extra: Column | None = None

    def condition(self) -> Column:
        lowest = self.salary_from if self.salary_from > 0 else 1
        salary = F.col("average_salary")
        clauses = [salary >= lowest]
        if self.salary_to is not None:
            clauses.append(salary <= self.salary_to)
        for name, chosen in (
            ("primary_category", self.industries),
            ("employmentTypes", self.employment_types),
            ("positionLevels", self.levels),
        ):
            if chosen:
                clauses.append(F.col(name).isin(*chosen))
        if self.extra is not None:
            clauses.append(self.extra)
        return reduce(and_, clauses)

    def apply(self, postings: DataFrame) -> DataFrame:
        return postings.filter(self.condition())


# The reports' range where no other is asked for: salaries from 1 to 30,000.
USUAL_SALARIES = PostingFilter()
