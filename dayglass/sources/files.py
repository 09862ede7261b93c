"""Reading and writing the log, score, metric and cluster files. Any Hadoop path is accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayglass.functions.scalar import nan_to_null
from dayglass.roles import columns_of_type

SCORE_SCHEMA = "RowId LONG, is_clicked DOUBLE, is_installed DOUBLE"
METRIC_SCHEMA = "feature STRING, accuracy DOUBLE, f1 DOUBLE, tn LONG, fp LONG, fn LONG, tp LONG"


def read_impressions(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All ``*.csv`` files below a folder, tab separated with a header; NaN is read as missing."""
    raw = (
        spark.read.schema(schema)
        .options(sep="\t", header=True, recursiveFileLookup=True, pathGlobFilter="*.csv", enforceSchema=False)
        .csv(folder)
    )
    floats = columns_of_type(raw, T.FloatType, T.DoubleType)
    return raw.withColumns({c: nan_to_null(F.col(c).cast("double")).cast(raw.schema[c].dataType) for c in floats})


def write_impressions_tsv(df: DataFrame, folder: str) -> None:
    df.write.options(sep="\t", header=True).csv(folder)


def write_log(df: DataFrame, path: str, day: str) -> None:
    """Typed Parquet, one folder per day. Rebalancing gathers the rows of a day into few files and lets Spark
    split a day that is larger than the others over several writers."""
    df.hint("rebalance", day).write.partitionBy(day).parquet(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_scores(df: DataFrame, path: str) -> None:
    df.select("RowId", "is_clicked", "is_installed").write.options(sep="\t", header=True).csv(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORE_SCHEMA).options(sep="\t", header=True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric rows joined by a comma and a blank, under a header line."""
    names = [f.name for f in T._parse_datatype_string(METRIC_SCHEMA).fields]
    line = F.concat_ws(", ", *[F.col(c).cast("string") for c in names])
    df.select(line.alias("value")).write.text(path)


def read_metrics(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).options(sep=", ", header=header).csv(path)


def write_cluster_scores(df: DataFrame, path: str, row_id: str, model: str, as_tsv: bool = False) -> None:
    """(row id, cluster, distance) under the model's name."""
    named = df.select(row_id, F.col("cluster").alias(model), F.col("distance").alias(f"{model}_distance"))
    if as_tsv:
        named.write.options(sep="\t", header=True).csv(path)
    else:
        named.write.parquet(path)
