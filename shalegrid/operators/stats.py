"""Statistics of column chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_stats(df: DataFrame, rg, columns: list[str]) -> DataFrame:
    """(rg, n, and for each column min_, max_, nulls_, distinct_): one pass. Strings compare by their bytes, NaN is greatest."""
    made = [f(c) for c in columns for f in (lambda c: F.min(c).alias(f"min_{c}"), lambda c: F.max(c).alias(f"max_{c}"), lambda c: F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"))]
    return df.groupBy(rg.alias("rg")).agg(F.count("*").alias("n"), *made)


def distinct_counts(df: DataFrame, rg, columns: list[str]) -> DataFrame:
    """(rg, distinct_<column>...) exactly; nulls do not count."""
    return df.groupBy(rg.alias("rg")).agg(*(F.count_distinct(c).alias(f"distinct_{c}") for c in columns))
