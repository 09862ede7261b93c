"""The corpus pipeline: cleaning stages over ``documents``, each on what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Every stage takes
NULL ids and texts, empty texts, repeated rows and an empty table, and works on whole texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayglass.llm.decontamination import find_passages
from dayglass.llm.frames import table
from dayglass.llm.jaccard_join import jaccard_components
from dayglass.llm.pieces import encode_pieces
from dayglass.llm.secrets import fit_scanner, scan_secrets
from dayglass.llm.toxicity import fit_toxicity, score_toxicity
from dayglass.session import cut_lineage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learned from all ``labels`` of the documents at hand, is below one half.

    NULL and empty texts have no toxic word and stay; equal texts have equal scores, so repeated rows stay or go together.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("score < 0.5").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity links lead to each other, the one with the smallest id; NULL ids come last.

    Documents with one id and different texts are different documents; of equal rows (id and text) one stays.
    Documents without words have no links.
    """
    name = F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("text"))
    named = docs.withColumn("__name", name)
    grouped = jaccard_components(named, doc_id="__name")
    first = grouped.where("doc_id = component_id").select(F.col("doc_id").alias("__name")).distinct()
    kept = named.join(first, "__name", "left_semi")
    # The window needs no shuffle after the join; a name has as many rows as there are equal documents with one id.
    number = F.row_number().over(Window.partitionBy("__name").orderBy("__name"))
    return kept.withColumn("__number", number).where("__number = 1").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of an item of ``benchmark``. NULL and empty texts have none and stay; equal texts go together."""
    found = find_passages(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and n_chars counted anew. NULL texts stay NULL, empty ones empty."""
    scanned = scan_secrets(docs, fit_scanner(docs)).withColumn("text", F.col("redacted"))
    if "n_chars" in docs.columns:
        scanned = scanned.withColumn("n_chars", F.length("text").cast("long"))
    return scanned.select(*docs.columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of the ids and of their decoded text, a row per document; NULL counts as empty."""
    encoded = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("pieces", as_pieces),
]

#: SQL cannot state learned scores or learned pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Every other stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
