"""Small helpers around the running session: lineage cuts, scratch folders, chunk counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="dayglass-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    A written table survives lost executors, and unlike a checkpointed plan it carries no constraints over from
    the plan it came from, which would pile up in loops. With ``by`` (a day) later reads are pruned to its folders.
    """
    path = scratch_path(df.sparkSession, "stage")
    writer = df.write if by is None else df.hint("rebalance", by).write.partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def chunk_count(spark: SparkSession) -> int:
    """How many pieces an ordered or hot group is cut into: one per shuffle partition, at least 8."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
