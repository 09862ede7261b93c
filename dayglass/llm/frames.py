"""Running a function over the texts of a table, batch by batch, with every other column carried along."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def give_back() -> None:
    """Hands freed memory back to the system; workers and the driver go on to other steps in the same process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def crc_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; NULL ids count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(quoted(column)).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def with_text_columns(
    docs: DataFrame,
    text: str,
    fields: str | T.StructType,
    start: Callable[[], Callable[[pa.Array], list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with the columns ``fields``, which a function computes from the texts of one Arrow batch.

    ``start`` runs once per task and returns the function; it gets the text column as strings (NULLs included) and
    returns one list or array per field. ``keep`` names the input columns that stay (all when None). An input column
    that has the name of a new one is replaced. Narrow: no shuffle, one batch in memory.
    """
    new = T._parse_datatype_string(fields) if isinstance(fields, str) else fields
    names = {f.name.lower() for f in new}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    source = "__text"
    wide = docs.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(text)).cast("string").alias(source))
    out = T.StructType([wide.schema[c] for c in kept] + list(new))
    kinds = [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = work(batch.column(batch.num_columns - 1))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [m if isinstance(m, pa.Array) else pa.array(m, k) for m, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return wide.mapInArrow(run, out)
