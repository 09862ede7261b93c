"""Bounded samples of labelled texts for fitting classifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.frames import quoted

#: Longest text that is used for fitting. Scoring has no such bound.
LONGEST = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, doc_id: str = "doc_id", text: str = "text") -> tuple[list[str], list[int], float]:
    """At most ``per_class`` texts of label 0 and of label 1, in the order of a hash of their ids.

    Only rows with ``learn`` are drawn, no NULL text, and no text over LONGEST characters. An id that is there several
    times gives one text. The driver gets at most 2 * per_class texts. Third comes the log of the odds of label 1 among
    all such labels less that among the texts drawn, to be added to the log-odds of what is learned from these.
    """
    ids = labels.where(learn & F.col(quoted(label)).isin(0, 1)).select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(label)).cast("int").alias("label"))
    ids = ids.groupBy("id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("id"))
    parts = [ids.where(F.col("label") == k).orderBy("order", "id").limit(per_class) for k in (0, 1)]
    chosen = parts[0].union(parts[1])
    texts = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    texts = texts.where(F.col("text").isNotNull() & (F.length("text") <= LONGEST))
    # The broadcast side has at most 2 * per_class rows.
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label", "order").agg(F.min("text").alias("text")).toArrow()
    found = sorted(zip(rows["order"].to_pylist(), rows["id"].to_pylist(), rows["text"].to_pylist(), rows["label"].to_pylist()))
    all_rows = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = [sum(r[3] == k for r in found) for k in (0, 1)]
    shift = math.log(all_rows[1] / all_rows[0] * drawn[0] / drawn[1]) if min(drawn) else 0.0
    return [r[2] for r in found], [r[3] for r in found], shift
