"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round every double column, for comparison with another engine."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def union_all(*selects: str) -> str:
    return "\nUNION ALL\n".join(selects)


def per_column_sql(columns: list[str], template: str) -> str:
    """One SELECT per column, glued together."""
    return union_all(*[template.format(c=c) for c in columns])
