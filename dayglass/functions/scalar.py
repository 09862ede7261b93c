"""Column expressions without state."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code of the weekly category for day % 7, in the raw and in the label-encoded table.
WEEKDAY_CODES_RAW = {3: "6675", 4: "14659", 5: "9638", 6: "23218", 0: "869", 1: "21533", 2: "31372"}
WEEKDAY_CODES_ENCODED = {3: "1", 4: "2", 5: "3", 6: "4", 0: "5", 1: "6", 2: "0"}
# Limits of the piecewise rescale.
RESCALE_LOW, RESCALE_HIGH = 0.0012233892209209916, 1.0060693574363284
# Weights of the final blend.
BLEND_WEIGHTS = {"cat": 0.46, "light_hybrid": 0.28, "hist_hybrid": 0.08, "light": 0.14, "hist": 0.04}
# Unit of each group of counter columns.
COUNTER_UNITS = {
    **{f"f_{n}": 0.038564 for n in (42, 52, 53, 54, 55, 56, 57, 74, 75, 76)},
    **{f"f_{n}": 0.57112145 for n in (44, 45, 46, 47, 48, 49, 50, 71, 72, 73)},
    **{f"f_{n}": 37.384575 for n in (77, 78, 79)},
    "f_60": 8.079460,
    "f_61": 0.147851,
    "f_62": 0.129300,
    "f_63": 0.355221,
}


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def bool_to_int(c: Column) -> Column:
    return c.cast("int")


def canonical_code(c: Column) -> Column:
    """"0" and "0.0" become 0, "1" and "1.0" become 1, missing, unreadable or out of range becomes -2."""
    return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(-2))


def weekday_code(day: Column, old: Column, codes: dict[int, str], first_day: int = 45, last_day: int = 67) -> Column:
    """The code of the weekday for known days, the old value for others."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.when(day.between(first_day, last_day), table[(day % 7).cast("int")]).otherwise(old.cast("string"))


def sin_date(day: Column) -> Column:
    return F.sin((day % 7) * F.lit(2.0 * math.pi / 7.0))


def cos_date(day: Column) -> Column:
    return F.cos((day % 7) * F.lit(2.0 * math.pi / 7.0))


def products(columns: dict[str, str], prefix: str = "f_new") -> list[Column]:
    """Products of all pairs; ``columns`` maps a short name to the column."""
    return [
        (F.col(columns[a]).cast("double") * F.col(columns[b]).cast("double")).alias(f"{prefix}{a}-{b}")
        for a, b in combinations(columns, 2)
    ]


def bits(columns: list[str]) -> Column:
    """The binaries as one category: a text of 0 and 1, NULL if any is NULL."""
    return F.concat(*[F.col(c).cast("int").cast("string") for c in columns])


def log_positive(c: Column) -> Column:
    return F.when(c > 0, F.ln(c)).otherwise(c)


def log_shift(c: Column, shift: float = 0.5) -> Column:
    return F.when(c > -shift, F.ln(c + shift))


def sample_key(row_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", row_id.cast("string"), F.lit(str(seed))))


def blend(weights: dict[str, float]) -> Column:
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError("blend weights must sum to 1")
    return sum((F.lit(w) * F.col(name) for name, w in weights.items()), F.lit(0.0))


def piecewise_rescale(c: Column, low: float = RESCALE_LOW, high: float = RESCALE_HIGH) -> Column:
    """Clip to [low, high], then stretch to [0, 1]; NULL stays NULL."""
    clipped = F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)
    return (clipped - low) / (high - low)


def threshold_class(p: Column, limit: float = 0.5) -> Column:
    return (p > limit).cast("int")


def sigmoid(raw: Column, offset: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-(raw + F.lit(offset))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns; NULL when one of them has length zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size)
