"""URL rules by hashed host-suffix and path-prefix expressions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that the join compares before the whole digest is looked at.
PREFIX_DIGITS = 8


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty when it is NULL or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return _lower(host), F.regexp_extract(after, r"^([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and each rest after one of its dots."""
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))),
    )


def hashed_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digests; a rule given twice counts once and block wins over allow."""
    name = F.concat(_lower(F.col("host")), F.coalesce(F.col("path"), F.lit("")))
    return (
        rules.where(F.col("host").isNotNull())
        .select(
            name.alias("rule"),
            F.sha2(F.concat_ws("\n", _lower(F.col("host")), F.coalesce(F.col("path"), F.lit(""))), 256).alias("rule_digest"),
            F.length(F.col("host")).alias("host_length"),
            F.length(F.coalesce(F.col("path"), F.lit(""))).alias("path_length"),
            F.col("verdict"),
        )
        .groupBy("rule", "rule_digest", "host_length", "path_length")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("short", F.substring("rule_digest", 1, PREFIX_DIGITS))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, the ``rule`` that decides (or NULL) and the ``verdict``.

    Each url becomes expressions: every host suffix at a dot, with every path prefix of a length that some rule has.
    They meet the rules in an equi-join on the first digits of their digests; the whole digest confirms; of the
    confirmed rules the longest wins (host and path together, then the longer host, then block over allow). A url
    without a fitting rule gets ``default``. Rules of a NULL host fit nothing.

    Repeated rows are counted before the join and come out as often as they went in; NULL ids and urls stay.
    One shuffle on (id, host, path) serves both the counting and the choice of the winner. The driver gets the
    distinct lengths of rule paths (at most as many as the longest rule has characters), never rules or urls. Spark
    broadcasts the rules only below its size limit; beyond it the join shuffles and adaptive execution splits hot
    expressions such as a top-level domain.
    """
    fixed = hashed_rules(rules)
    lengths = sorted(r[0] for r in fixed.select("path_length").distinct().collect())
    host, path = url_parts(F.col(f"`{url}`"))
    counted = (
        pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
        .groupBy("page_id", "host", "path")
        .agg(F.count("*").alias("copies"))
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    expressions = (
        counted.withColumn("__prefix", F.explode_outer(prefixes))
        .withColumn("__suffix", F.explode(host_suffixes(F.col("host"))))
        .withColumn("digest", F.sha2(F.concat(F.col("__suffix"), F.lit("\n"), F.col("__prefix")), 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
        .drop("__prefix", "__suffix")
    )
    confirmed = F.when(
        F.col("digest") == F.col("rule_digest"),
        F.struct((F.col("host_length") + F.col("path_length")).alias("length"), "host_length", F.col("verdict"), F.col("rule")),
    )
    best = (
        expressions.join(fixed, "short", "left")
        .groupBy("page_id", "host", "path")
        .agg(F.max(confirmed).alias("best"), F.max("copies").alias("copies"))
    )
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy"),
    ).drop("__copy")
