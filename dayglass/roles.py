"""Column roles of an impression table. Operators take names from here, never positions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    row_id: str
    day: str
    categorical: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    counter: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    label: tuple[str, ...] = ()

    def columns(self, *names: str) -> list[str]:
        """Columns of the named roles, in the order the roles are given."""
        found: list[str] = []
        for name in names:
            value = getattr(self, name)
            found += [value] if isinstance(value, str) else list(value)
        return found

    def without(self, dropped: list[str]) -> "Roles":
        gone = set(dropped)
        return replace(
            self,
            **{
                name: tuple(c for c in getattr(self, name) if c not in gone)
                for name in ("categorical", "binary", "counter", "numeric", "label")
            },
        )


def _f(*numbers: int) -> tuple[str, ...]:
    return tuple(f"f_{n}" for n in numbers)


# Which numeric columns are not counters, and the sets of weak columns that are dropped.
NON_COUNTERS = _f(43, 51, 58, 59, 64, 65, 66, 67, 68, 69, 70)
WEAK_COLUMNS = {
    "base": _f(7, 23, 24, 25, 26, 27, 28, 29) + _f(59, 64, 66),
    "cat": _f(7, 9, 11, 23, 24, 25, 26, 27, 28, 29) + _f(55, 59, 64, 65, 66),
    "light": _f(7, 11, 27, 28, 29),
    "clusters": _f(7, 27, 28, 29),
}


def impression_roles(labelled: bool = True) -> Roles:
    """Roles of the raw log: f_0 id, f_1 day, then categories, binaries and numerics."""
    numeric = _f(*range(42, 80))
    return Roles(
        row_id="f_0",
        day="f_1",
        categorical=_f(*range(2, 33)),
        binary=_f(*range(33, 42)),
        counter=tuple(c for c in numeric if c not in NON_COUNTERS),
        numeric=NON_COUNTERS,
        label=("is_clicked", "is_installed") if labelled else (),
    )


def impression_schema(labelled: bool = True) -> T.StructType:
    """Types of the raw log: long id, int day, string categories, booleans, floats at rest."""
    roles = impression_roles(labelled)
    fields = [T.StructField(roles.row_id, T.LongType()), T.StructField(roles.day, T.IntegerType())]
    fields += [T.StructField(c, T.StringType()) for c in roles.categorical]
    fields += [T.StructField(c, T.BooleanType()) for c in roles.binary]
    fields += [T.StructField(c, T.FloatType()) for c in _f(*range(42, 80))]
    fields += [T.StructField(c, T.BooleanType()) for c in roles.label]
    return T.StructType(fields)


def columns_of_type(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
