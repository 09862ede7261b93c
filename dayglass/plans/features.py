"""The two feature builds: dense features for networks, and features for clustering and neighbours.

Both put the tables into one, tagged by ``split``, fit every statistic on the train rows and apply it to all rows
as column expressions with fitted literals. The result is one scan with lookup joins, not one plan per split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.functions import scalar
from dayglass.operators import cleaning as B
from dayglass.operators import encoders as D
from dayglass.operators import scaling as S
from dayglass.operators.splits import tag_split
from dayglass.roles import Roles
from dayglass.session import cut_lineage

SIGMAS = 4
SPARSE_SHARE = 0.95


def _train(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def _stats_for_all(df: DataFrame, cats: list[str], label: str, roles: Roles, ordered_train: bool) -> DataFrame:
    """Categories as target statistics: of the whole train part, or of the earlier rows for train rows."""
    train = _train(df)
    stats, prior = D.fit_target_stats(train, cats, label), D.label_rate(train, label)
    if not ordered_train:
        return D.apply_target_stats(df, stats, cats, prior, roles.row_id)
    rest = D.apply_target_stats(df.where(F.col("split") != "train"), stats, cats, prior, roles.row_id)
    ordered = D.ordered_target_stats(train, cats, label, roles.day, roles.row_id, prior)
    return ordered.unionByName(rest)


def nn_features(
    train_val: DataFrame,
    test: DataFrame,
    roles: Roles,
    threshold: int | None,
    label: str = "is_installed",
    ordered_train: bool = False,
) -> DataFrame:
    """(row id, split, categories as target statistics, binaries as 0/1, scaled numerics, label)."""
    cats, counters, plain = list(roles.categorical), list(roles.counter), list(roles.numeric)
    nums = counters + plain
    wanted = [roles.row_id, roles.day, *cats, *roles.binary, *nums]
    labelled = tag_split(train_val.select(*wanted, F.col(label).cast("int").alias(label)), roles.day, threshold)
    unlabelled = test.select(*wanted, F.lit(None).cast("int").alias(label), F.lit("test").alias("split"))
    # Written once: every fit below reads a few columns of it.
    df = cut_lineage(B.bools_to_int(labelled.unionByName(unlabelled), list(roles.binary)))

    raw = S.fit_zscore(_train(df), nums)
    df = S.remove_outliers(B.fill(df, raw.center), nums, SIGMAS, raw, roles.row_id, by="split")
    df = df.withColumns({c: scalar.log_positive(F.col(c)) for c in counters})
    for columns, fit in ((counters, S.fit_minmax), (plain, S.fit_standard), (plain, S.fit_minmax)):
        if columns:
            df = S.apply_spread(df, columns, fit(_train(df), columns))

    if threshold is not None:
        df = D.align_tagged(df, cats, roles.row_id)
    return _stats_for_all(df, cats, label, roles, ordered_train).drop(roles.day)


def cluster_features(
    train: DataFrame, val: DataFrame, roles: Roles, label: str = "is_installed", fill_counters: bool = True
) -> DataFrame:
    """(row id, split, label, sin/cos of the weekday, binaries, counters, numerics, categories as statistics)."""
    cats, counters, nums = list(roles.categorical), list(roles.counter), list(roles.numeric)
    wanted = [roles.row_id, roles.day, *cats, *roles.binary, *counters, *nums]

    def tagged(df: DataFrame, name: str) -> DataFrame:
        labels = F.col(label).cast("int") if label in df.columns else F.lit(None).cast("int")
        return df.select(*wanted, labels.alias(label), F.lit(name).alias("split"))

    both = reduce(DataFrame.unionByName, [tagged(train, "train"), tagged(val, "val")])
    df = cut_lineage(B.bools_to_int(B.fill_const(both, cats), list(roles.binary)))
    df = B.add_trig_date(df, roles.day)
    if counters:
        df = S.apply_spread(df, counters, S.fit_counters(_train(df), counters))
        if fill_counters:
            df = B.fill(df, B.column_modes(_train(df), counters))
        df = B.log_or_binarise(df, B.zero_shares(_train(df), counters), SPARSE_SHARE)
    if nums:
        df = S.remove_outliers(df, nums, SIGMAS, S.fit_zscore(_train(df), nums), roles.row_id, by="split")
        df = B.fill(S.apply_spread(df, nums, S.fit_zscore(_train(df), nums)), {c: 0.0 for c in nums})
    if cats:
        df = D.align_tagged(df, cats, roles.row_id)
        df = _stats_for_all(df, cats, label, roles, ordered_train=True)
    return df
