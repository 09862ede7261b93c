"""Joins and set operations. Rows are aligned by key, never by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.operators.ordering import global_rank


SALTS = 64
HOT_KEYS = 128


def lookup_join(rows: DataFrame, table: DataFrame, key: str, hot: list, spread_by: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Left join of ``rows`` with a unique-key ``table``, safe for keys that hold a large share of the rows.

    Rows of a hot key are spread over salts and its table entry is repeated once per salt. ``hot`` is the short
    list of the largest keys (see :func:`largest_keys`). Spark still broadcasts the table instead of shuffling
    when its size is under the broadcast limit. With ``also`` these columns belong to the key, of which ``key`` may then be
    a hash.
    """
    if not hot:
        return rows.join(table, [key, *also], "left")
    is_hot = F.col(key).isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = table.withColumn("__salt", F.explode(copies))
    return rows.withColumn("__salt", salt).join(salted, [key, *also, "__salt"], "left").drop("__salt")


def largest_keys(tables: dict[str, DataFrame], key: str, weight: str) -> dict[str, list]:
    """The keys with the most rows behind them, per table, in one job.

    A key outside the list holds less than one part in ``HOT_KEYS`` of the rows.
    """
    tops = [
        t.orderBy(F.col(weight).desc()).limit(HOT_KEYS).select(F.lit(name).alias("name"), F.col(key).alias("key"))
        for name, t in tables.items()
    ]
    found: dict[str, list] = {name: [] for name in tables}
    for row in reduce(DataFrame.unionByName, tops).collect():
        found[row["name"]].append(row["key"])
    return found


def hot_lookup_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None, weight: str = "__n") -> DataFrame:
    """:func:`lookup_join` with the largest keys taken from ``counts`` (key, weight), or counted in ``rows``.

    Rows of a large key are told apart by all their columns.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias(weight))
    hot = [v for v in largest_keys({"rows": counts}, key, weight)["rows"] if v is not None]
    spread = rows.withColumn("__spread", F.xxhash64(*rows.columns))
    return lookup_join(spread, table, key, hot, "__spread").drop("__spread")


def join_scores(tables: dict[str, DataFrame], row_id: str, score: str = "score") -> DataFrame:
    """One row per id present in every table, with each score named after its model."""
    renamed = [t.select(row_id, F.col(score).alias(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.join(b, row_id), renamed)


def concat_columns(blocks: list[DataFrame], row_id: str) -> DataFrame:
    """Feature blocks side by side."""
    return reduce(lambda a, b: a.join(b, row_id), blocks)


def concat_rows(tables: list[DataFrame]) -> DataFrame:
    """Append tables by column name; a column that one of them lacks becomes NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def unseen_rows(rows: DataFrame, other: DataFrame, column: str, seen: bool = False) -> DataFrame:
    """Rows whose ``column`` value is absent from ``other`` (or present, with ``seen``)."""
    values = other.select(column).where(F.col(column).isNotNull()).distinct().withColumn("__seen", F.lit(True))
    joined = hot_lookup_join(rows, values, column)
    return joined.where(F.col("__seen").isNotNull() if seen else F.col("__seen").isNull()).select(*rows.columns)


def common_values(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).intersect(right.select(column))


def only_left_values(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).distinct().exceptAll(right.select(column).distinct())


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def lookup_map(rows: DataFrame, table: DataFrame, key: str, value: str, out: str, default: Column | None = None) -> DataFrame:
    """Map ``key`` through a small (key, value) table; a key without an entry gets ``default`` or NULL."""
    small = table.select(key, F.col(value).alias(out))
    joined = hot_lookup_join(rows, small, key)
    return joined if default is None else joined.withColumn(out, F.coalesce(out, default))


def rank_pairs(left: DataFrame, right: DataFrame, row_id: str, score: str, out: str) -> DataFrame:
    """Give the i-th smallest left row the i-th smallest right score; all left rows stay."""
    a = global_rank(left.select(row_id, score), score, row_id)
    b = global_rank(right.select(row_id, score), score, row_id).select("rank", F.col(score).alias(out))
    return a.join(b, "rank", "left").select(row_id, "rank", score, out)
