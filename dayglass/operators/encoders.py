"""Categorical encoders. ``fit_*`` returns a table per column and value; ``apply_*`` joins it back.

Fitted tables are in long form (``column``, ``value`` as string, statistics), are computed for all columns in
one pass and are written once, so that applying them to many tables does not read the training rows again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayglass.operators.joins import largest_keys, lookup_join
from dayglass.operators.ordering import add_range, cut_points
from dayglass.session import chunk_count, cut_lineage

_NULL = "\u0000"


def to_long(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(kept columns, column, value): one row per column, values as strings."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("pair")).select(*keep, "pair.column", "pair.value")


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def _label(label: str) -> Column:
    return F.col(label).cast("double")


def _sort_key(text_columns: list[str]) -> Column:
    """Numbers sort as numbers, texts (and false before true) as texts."""
    if not text_columns:
        return F.col("value").try_cast("double")
    return F.when(~F.col("column").isin(text_columns), F.col("value").try_cast("double"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) over all columns at once; NULL is a value."""
    return to_long(df, columns, []).groupBy("column", "value").agg(F.count("*").alias("n"))


def _top_value(counts: DataFrame, text_columns: list[str]) -> DataFrame:
    """Most frequent non-NULL value per column, ties to the smallest value."""
    ranked = counts.where(F.col("value").isNotNull()).withColumn("key", _sort_key(text_columns))
    best = F.min_by(
        F.struct("value"),
        F.struct((-F.col("n")).alias("a"), F.col("key").alias("b"), F.col("value").alias("c")),
    )
    return ranked.groupBy("column").agg(best["value"].alias("top"))


def fit_label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, code): dense codes 0..k-1 in value order, NULL last.

    Codes are numbered inside value ranges and shifted by the sizes of the earlier ranges, so a column with
    very many values is not numbered in one task.
    """
    texts = [c for c in columns if _is_text(df, c)]
    counts = cut_lineage(value_counts(df, columns).withColumn("key", _sort_key(texts)))
    parts = chunk_count(df.sparkSession)
    shares = [i / parts for i in range(1, parts)]
    numeric_cuts = counts.where(F.col("key").isNotNull()).groupBy("column").agg(
        F.array_distinct(F.percentile_approx("key", shares, 10000)).alias("cuts")
    )
    # Text limits: an evenly hashed choice of values per column, at most `parts` of them.
    hashed = Window.partitionBy("column", "slot").orderBy("hash", "value")
    text_cuts = (
        counts.where(F.col("column").isin(texts) & F.col("value").isNotNull())
        .select("column", "value", F.xxhash64("value").alias("hash"))
        .withColumn("slot", F.pmod("hash", F.lit(parts)))
        .withColumn("pick", F.row_number().over(hashed))
        .where("pick = 1")
        .groupBy("column")
        .agg(F.collect_list("value").alias("text_cuts"))
    )
    # One row per column, each with at most `parts` limits.
    limits = numeric_cuts.join(text_cuts, "column", "full")
    number = F.when(F.col("value").isNull(), F.lit(parts + 1)).otherwise(
        F.coalesce(
            F.size(F.filter("cuts", lambda e: e <= F.col("key"))),
            F.size(F.filter("text_cuts", lambda e: e <= F.col("value"))),
        )
    )
    ranged = counts.join(F.broadcast(limits), "column", "left").withColumn("range", number).drop("cuts", "text_cuts")
    sizes = ranged.groupBy("column", "range").agg(F.count("*").alias("size"))
    before = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("column", "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("column", "range").orderBy("key", "value")
    coded = (
        ranged.withColumn("local", F.row_number().over(inside) - 1)
        .join(shifts, ["column", "range"])
        .select("column", "value", "n", "key", (F.col("local") + F.col("shift")).cast("int").alias("code"))
    )
    return cut_lineage(coded)


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(_NULL))


def _entries(fitted: DataFrame, column: str) -> DataFrame:
    one = fitted.where(F.col("column") == column)
    return one.withColumn("__key", F.coalesce("value", F.lit(_NULL))).drop("column", "value")


def _hot(fitted: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Per column the values whose rows are spread in a join; the NULL entry is always among them."""
    found = largest_keys({c: _entries(fitted, c) for c in columns}, "__key", "n")
    return {c: sorted({*keys, _NULL}) for c, keys in found.items()}


def _attach(
    df: DataFrame, fitted: DataFrame, column: str, row_id: str, values: dict[str, str], hot: list[str]
) -> DataFrame:
    """Join the fitted figures of one column to the rows; NULL categories match the NULL entry."""
    one = _entries(fitted, column).select("__key", *[F.col(source).alias(out) for source, out in values.items()])
    return lookup_join(df.withColumn("__key", _key(column)), one, "__key", hot, row_id).drop("__key")


def apply_label_codes(
    df: DataFrame, codes: DataFrame, columns: list[str], row_id: str, unseen_to_mode: bool = False
) -> DataFrame:
    """Replace categories by their codes. Unseen ones become NULL, or the code of the most frequent value."""
    modes: dict[str, int] = {}
    if unseen_to_mode:
        best = F.min_by("code", F.struct((-F.col("n")).alias("a"), F.col("code").alias("b")))
        modes = dict(codes.where(F.col("value").isNotNull()).groupBy("column").agg(best).collect())
    hot = _hot(codes, columns)
    for c in columns:
        df = _attach(df, codes, c, row_id, {"code": "__code"}, hot[c])
        code = F.coalesce("__code", F.lit(modes[c])) if unseen_to_mode else F.col("__code")
        df = df.withColumn(c, code.cast("int")).drop("__code")
    return df


def label_encode_union(
    left: DataFrame, right: DataFrame, columns: list[str], row_id: str
) -> tuple[DataFrame, DataFrame]:
    """Codes fitted on the values of both tables."""
    codes = fit_label_codes(left.select(*columns).unionByName(right.select(*columns)), columns)
    return apply_label_codes(left, codes, columns, row_id), apply_label_codes(right, codes, columns, row_id)


def label_encode_train(
    train: DataFrame, test: DataFrame, columns: list[str], row_id: str
) -> tuple[DataFrame, DataFrame]:
    """Codes fitted on train; test values that train lacks are read as the train mode."""
    codes = fit_label_codes(train, columns)
    return (
        apply_label_codes(train, codes, columns, row_id),
        apply_label_codes(test, codes, columns, row_id, unseen_to_mode=True),
    )


def align_tagged(df: DataFrame, columns: list[str], row_id: str, split: str = "split") -> DataFrame:
    """Keep values known to both the train and the val rows; others become -1 in train and the commonest shared
    value in val. Rows of any other split stay as they are."""
    texts = [c for c in columns if _is_text(df, c)]
    sides = to_long(df.where(F.col(split).isin("train", "val")), columns, [split])
    counted = sides.where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count_if(F.col(split) == "train").alias("n"), F.count_if(F.col(split) == "val").alias("n_val")
    )
    shared = cut_lineage(counted.where("n > 0 AND n_val > 0"))
    top, hot = dict(_top_value(shared, texts).collect()), _hot(shared, columns)
    for c in columns:
        kind = df.schema[c].dataType
        other = F.when(F.col(split) == "train", F.lit("-1").cast(kind)).when(
            F.col(split) == "val", F.lit(top.get(c, "-1")).cast(kind)
        )
        seen = _attach(df, shared, c, row_id, {"n": "__seen"}, hot[c])
        kept = F.col("__seen").isNotNull() | ~F.col(split).isin("train", "val")
        df = seen.withColumn(c, F.when(kept, F.col(c)).otherwise(other)).drop("__seen")
    return df


def align_categories(
    train: DataFrame, val: DataFrame, columns: list[str], row_id: str
) -> tuple[DataFrame, DataFrame]:
    """As :func:`align_tagged`, for two tables."""
    both = train.withColumn("__split", F.lit("train")).unionByName(val.withColumn("__split", F.lit("val")))
    aligned = align_tagged(both, columns, row_id, "__split")
    return tuple(aligned.where(F.col("__split") == part).drop("__split") for part in ("train", "val"))


def label_rate(df: DataFrame, label: str) -> float:
    return df.agg(F.avg(_label(label))).first()[0]


def fit_target_stats(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, value, n, s): rows and label sum per category, NULL categories left out."""
    stats = (
        to_long(df.withColumn("__y", _label(label)), columns, ["__y"])
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"), F.sum("__y").alias("s"))
    )
    return cut_lineage(stats)


def apply_target_stats(
    df: DataFrame, stats: DataFrame, columns: list[str], prior: float, row_id: str, strength: float = 1.0
) -> DataFrame:
    """(s + prior * strength) / (n + strength); the prior for categories seen once, unseen or NULL."""
    p, hot = F.lit(prior), _hot(stats, columns)
    for c in columns:
        df = _attach(df, stats, c, row_id, {"n": "__count", "s": "__sum"}, hot[c])
        value = F.when(F.col("__count") > 1, (F.col("__sum") + p * strength) / (F.col("__count") + strength))
        df = df.withColumn(c, F.coalesce(value, p)).drop("__count", "__sum")
    return df


def apply_smoothed_stats(
    df: DataFrame,
    stats: DataFrame,
    columns: list[str],
    prior: float,
    row_id: str,
    min_samples: float = 20.0,
    smoothing: float = 10.0,
) -> DataFrame:
    """Mean of the category mixed with the prior by a logistic weight of the category size."""
    p, hot = F.lit(prior), _hot(stats, columns)
    for c in columns:
        df = _attach(df, stats, c, row_id, {"n": "__count", "s": "__sum"}, hot[c])
        weight = 1 / (1 + F.exp(-(F.col("__count") - min_samples) / smoothing))
        mixed = weight * F.col("__sum") / F.col("__count") + (1 - weight) * p
        df = df.withColumn(c, F.coalesce(mixed, p)).drop("__count", "__sum")
    return df


def ordered_target_stats(
    df: DataFrame, columns: list[str], label: str, day: str, row_id: str, prior: float, strength: float = 1.0
) -> DataFrame:
    """Target statistic of the earlier rows (by day, row id) of the same category, for the training rows.

    A hot category is cut into (day, row-id range) chunks: chunk totals are accumulated per category, and the
    row-level window only runs inside a chunk. All columns go through one shuffle in long form.
    """
    parts = chunk_count(df.sparkSession)
    cuts = cut_points(df, [row_id], parts)[row_id]
    rows = add_range(df.withColumn("__y", _label(label)), row_id, cuts, "__range")
    long = to_long(rows, columns, [row_id, day, "__range", "__y"]).withColumn(
        "value", F.coalesce("value", F.lit(_NULL))
    )
    chunk = ["column", "value", day, "__range"]
    totals = long.groupBy(*chunk).agg(F.count("*").alias("n"), F.sum("__y").alias("s"))
    earlier_chunks = (
        Window.partitionBy("column", "value").orderBy(day, "__range").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = totals.select(
        *chunk,
        F.coalesce(F.sum("n").over(earlier_chunks), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("s").over(earlier_chunks), F.lit(0.0)).alias("s0"),
    )
    earlier_rows = Window.partitionBy(*chunk).orderBy(row_id).rowsBetween(Window.unboundedPreceding, -1)
    encoded = (
        long.withColumn("n1", F.count("__y").over(earlier_rows))
        .withColumn("s1", F.coalesce(F.sum("__y").over(earlier_rows), F.lit(0.0)))
        .join(before, chunk)
        .withColumn("stat", (F.col("s0") + F.col("s1") + F.lit(prior * strength)) / (F.col("n0") + F.col("n1") + strength))
    )
    wide = encoded.groupBy(row_id).agg(
        *[F.max(F.when(F.col("column") == c, F.col("stat"))).alias(c) for c in columns]
    )
    return df.drop(*columns).join(wide, row_id).select(*df.columns)


def day_out_scores(
    df: DataFrame,
    models: dict[str, str],
    label: str,
    day: str,
    row_id: str,
    keep: tuple[str, ...] = (),
    last_day: int | None = None,
) -> DataFrame:
    """Score every row by the target statistic of its category over all other days.

    ``models`` maps a score name to its category. Rows of ``last_day`` (the unlabelled day) are scored with all
    days before it. One pass per column gives (category, day) totals; a day's complement is total minus own.
    """
    train = df if last_day is None else df.where(F.col(day) < last_day)
    y = _label(label)
    # At most one row per day: the rate of all other days.
    own = train.groupBy(day).agg(F.count("*").alias("n"), F.sum(y).alias("s")).collect()
    rows, hits = sum(r["n"] for r in own), sum(r["s"] for r in own)
    others = [(r[day], (hits - r["s"]) / (rows - r["n"])) for r in own if rows > r["n"]]
    rate = F.lit(hits / rows)
    if others:
        rate = F.coalesce(F.create_map(*[F.lit(x) for pair in others for x in pair])[F.col(day)], rate)
    columns = list(dict.fromkeys(models.values()))
    cells = (
        to_long(train.withColumn("__y", y), columns, [day, "__y"])
        .where(F.col("value").isNotNull())
        .groupBy("column", "value", day)
        .agg(F.count("*").alias("n"), F.sum("__y").alias("s"))
    )
    # One row per category with its totals and a map of its days (at most one entry per day).
    fitted = cut_lineage(
        cells.groupBy("column", "value").agg(
            F.sum("n").alias("n"),
            F.sum("s").alias("s"),
            F.map_from_entries(F.collect_list(F.struct(F.col(day), F.struct("n", "s")))).alias("days"),
        )
    )
    hot = _hot(fitted, columns)
    out = df.select(row_id, day, *keep, *columns).withColumn("__prior", rate)
    for name, c in models.items():
        joined = _attach(out, fitted, c, row_id, {"n": "__n", "s": "__s", "days": "__days"}, hot[c])
        own_day = F.col("__days")[F.col(day)]
        n = F.col("__n") - F.coalesce(own_day["n"], F.lit(0))
        s = F.col("__s") - F.coalesce(own_day["s"], F.lit(0.0))
        score = F.coalesce(F.when(n > 1, (s + F.col("__prior")) / (n + 1)), F.col("__prior"))
        out = joined.withColumn(name, score).drop("__n", "__s", "__days")
    return out.select(row_id, day, *keep, *models)


def earlier_day_stats(
    df: DataFrame, columns: list[str], label: str, day: str, row_id: str, base_rate: float = 0.145
) -> DataFrame:
    """Replace categories by their target statistic over all earlier days, for every row at once.

    A row of day d never sees labels of day d or later, so one table serves all walk-forward folds. Unlabelled
    rows add nothing to the sums. Only (category, day) totals are accumulated.
    """
    y = _label(label)
    cells = (
        to_long(df.withColumn("__y", y), columns, [day, "__y"])
        .groupBy("column", F.coalesce("value", F.lit(_NULL)).alias("value"), day)
        .agg(F.count("*").alias("rows"), F.count("__y").alias("n"), F.sum("__y").alias("s"))
    )
    earlier = Window.partitionBy("column", "value").orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    fitted = cut_lineage(
        cells.select(
            "column",
            F.concat_ws("|", "value", F.col(day).cast("string")).alias("value"),
            F.col("rows").alias("n"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
            F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("s0"),
        )
    )
    # One row per day.
    days = df.groupBy(day).agg(F.count(y).alias("n"), F.sum(y).alias("s")).orderBy(day).collect()
    rates, n, s = [], 0, 0.0
    for r in days:
        rates += [r[day], s / n if n else base_rate]
        n, s = n + r["n"], s + (r["s"] or 0.0)
    prior = F.create_map(*[F.lit(v) for v in rates])[F.col(day)]
    hot = _hot(fitted, columns)
    for c in columns:
        keyed = df.withColumn("__key", F.concat_ws("|", _key(c), F.col(day).cast("string")))
        one = _entries(fitted, c).select("__key", "n0", "s0")
        joined = lookup_join(keyed, one, "__key", hot[c], row_id)
        df = joined.withColumn(c, (F.col("s0") + prior) / (F.col("n0") + 1)).drop("__key", "n0", "s0")
    return df


def one_hot(df: DataFrame, column: str, values: list, keep_original: bool = False) -> DataFrame:
    """One 0/1 column per listed value, named ``<column>_<value>``; unknown values give all zeros."""
    flags = [F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int").alias(f"{column}_{v}") for v in values]
    kept = df.columns if keep_original else [c for c in df.columns if c != column]
    return df.select(*kept, *flags)


def small_domains(df: DataFrame, columns: list[str], limit: int) -> dict[str, list]:
    """Sorted distinct values of the columns that have at most ``limit`` of them."""
    sizes = cardinalities(df, columns)
    small = [c for c in columns if sizes[c] <= limit]
    if not small:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in small]).first()
    return {c: row[c] for c in small}


def one_hot_small(df: DataFrame, columns: list[str], limit: int = 10) -> DataFrame:
    """One-hot encode the columns with at most ``limit`` values."""
    for c, values in small_domains(df, columns, limit).items():
        df = one_hot(df, c, values)
    return df


def binary_encode(df: DataFrame, codes: DataFrame, column: str, row_id: str) -> DataFrame:
    """Ordinal code (from 1) of the category in base 2, one column per bit, highest bit first; unseen is 0."""
    known = codes.where(F.col("column") == column)
    width = max(1, int(known.agg(F.max("code")).first()[0] + 1).bit_length())
    coded = _attach(df, codes, column, row_id, {"code": "__code"}, _hot(codes, [column])[column])
    ordinal = F.coalesce(F.col("__code") + 1, F.lit(0))
    bits = [
        F.shiftright(ordinal, width - 1 - i).bitwiseAND(F.lit(1)).cast("int").alias(f"{column}_{i}") for i in range(width)
    ]
    return coded.select(*[c for c in df.columns if c != column], *bits)


def cardinalities(df: DataFrame, columns: list[str], approximate: bool = False) -> dict[str, int]:
    """Distinct non-NULL values per column, from one aggregation."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    row = df.agg(*[count(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def columns_below(df: DataFrame, columns: list[str], limit: int, approximate: bool = False) -> list[str]:
    """Columns that have fewer than ``limit`` distinct values."""
    sizes = cardinalities(df, columns, approximate)
    return [c for c in columns if sizes[c] < limit]


def encode_by_cardinality(
    df: DataFrame, columns: list[str], label: str, row_id: str, limit: int = 10, small: str = "one_hot"
) -> DataFrame:
    """Columns with at most ``limit`` values go to one-hot or binary encoding, the others to smoothed statistics."""
    sizes = cardinalities(df, columns)
    large = [c for c in columns if sizes[c] > limit]
    low = [c for c in columns if sizes[c] <= limit]
    if large:
        df = apply_smoothed_stats(df, fit_target_stats(df, large, label), large, label_rate(df, label), row_id)
    if low and small == "binary":
        codes = fit_label_codes(df, low)
        return reduce(lambda d, c: binary_encode(d, codes, c, row_id), low, df)
    return one_hot_small(df, low, limit) if low else df
