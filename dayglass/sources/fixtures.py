"""Impression-shaped views over the star-schema tables, used by the registered queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass.operators.encoders import day_out_scores
from dayglass.roles import Roles

FIRST_DAY, LAST_DAY, SPLIT_DAY = 45, 67, 63

IMP = Roles(
    row_id="row_id",
    day="day",
    categorical=("c_user", "c_hour", "c_k"),
    binary=("b_even", "b_pm", "b_high"),
    counter=("n_cnt",),
    numeric=("n_val",),
    label=("is_clicked", "is_installed"),
)
ORD = Roles(
    row_id="row_id",
    day="day",
    categorical=("c_segment", "c_priority", "c_nation", "c_cust"),
    binary=("b_returned",),
    counter=("n_lines", "n_qty", "n_disc"),
    numeric=("n_total", "n_bal"),
    label=("is_clicked", "is_installed"),
)
MODELS = ("cat", "light", "hist", "light_hybrid", "hist_hybrid")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def imp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One impression per event. The 30 calendar days are spread over day numbers 45..67."""
    offset = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    k = F.get_json_object("props", "$.k").cast("int")
    hour = F.hour("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.least(F.lit(LAST_DAY), F.lit(FIRST_DAY) + F.floor(offset * 23 / 30)).cast("int").alias("day"),
        F.col("user_id").alias("c_user"),
        hour.alias("c_hour"),
        k.alias("c_k"),
        (F.col("user_id") % 2 == 0).alias("b_even"),
        (hour >= 12).alias("b_pm"),
        (F.col("value") > 50).alias("b_high"),
        (k * F.lit(0.5).cast("double")).alias("n_cnt"),
        F.when(F.col("event_id") % 20 != 0, F.col("value")).alias("n_val"),
        (F.col("event_type") == "click").alias("is_clicked"),
        (F.col("event_type") == "purchase").alias("is_installed"),
    )


def ord_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; line-item figures are NULL for orders that have no lines."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.count("*").cast("double").alias("n_lines"),
            F.sum("l_quantity").alias("n_qty"),
            F.round(F.sum("l_discount"), 2).alias("n_disc"),
            F.max(F.col("l_returnflag") == "R").alias("b_returned"),
        )
    )
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return (
        table(spark, sf_dir, "orders")
        .join(lines, "o_orderkey", "left")
        .join(customer, "o_custkey")
        .select(
            F.col("o_orderkey").alias("row_id"),
            (F.lit(FIRST_DAY) + F.pmod(days, F.lit(23))).cast("int").alias("day"),
            F.col("c_mktsegment").alias("c_segment"),
            F.col("o_orderpriority").alias("c_priority"),
            F.col("c_nationkey").alias("c_nation"),
            F.col("o_custkey").alias("c_cust"),
            "n_lines",
            "n_qty",
            "n_disc",
            F.col("o_totalprice").alias("n_total"),
            F.col("c_acctbal").alias("n_bal"),
            "b_returned",
            (F.col("o_orderstatus") == "O").alias("is_clicked"),
            (F.col("o_orderstatus") == "F").alias("is_installed"),
        )
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five score columns per impression, from target statistics of all other days."""
    base = day_out_scores(
        imp(spark, sf_dir),
        {"cat": "c_k", "light": "c_user", "hist": "c_hour"},
        label="is_installed",
        day="day",
        row_id="row_id",
        keep=("is_clicked", "is_installed"),
        last_day=LAST_DAY,
    )
    return base.select(
        "*",
        ((F.col("cat") + F.col("light")) / 2).alias("light_hybrid"),
        ((F.col("cat") + F.col("hist")) / 2).alias("hist_hybrid"),
    )


# The same views as DuckDB SQL.
IMP_SQL = """
imp AS (
  SELECT event_id AS row_id,
         CAST(least(67, 45 + floor(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 23 / 30.0)) AS INTEGER) AS day,
         user_id AS c_user,
         CAST(hour(ts) AS INTEGER) AS c_hour,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS c_k,
         user_id % 2 = 0 AS b_even,
         hour(ts) >= 12 AS b_pm,
         value > 50 AS b_high,
         CAST(json_extract_string(props, '$.k') AS INTEGER) * CAST(0.5 AS DOUBLE) AS n_cnt,
         CASE WHEN event_id % 20 <> 0 THEN value END AS n_val,
         event_type = 'click' AS is_clicked,
         event_type = 'purchase' AS is_installed
  FROM events)"""
ORD_SQL = """
lines AS (
  SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS n_qty,
         round(sum(l_discount), 2) AS n_disc, bool_or(l_returnflag = 'R') AS b_returned
  FROM lineitem GROUP BY l_orderkey),
ord AS (
  SELECT o_orderkey AS row_id,
         CAST(45 + datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 23 AS INTEGER) AS day,
         c_mktsegment AS c_segment, o_orderpriority AS c_priority, c_nationkey AS c_nation, o_custkey AS c_cust,
         n_lines, n_qty, n_disc, o_totalprice AS n_total, c_acctbal AS n_bal, b_returned,
         o_orderstatus = 'O' AS is_clicked, o_orderstatus = 'F' AS is_installed
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lines ON l_orderkey = o_orderkey)"""


def _score_sql(name: str, column: str) -> str:
    """Target statistic of `column` over all other days (all train days for the last day)."""
    return f"""
{name}_parts AS (
  SELECT {column} AS v, day, CAST(count(*) AS DOUBLE) AS n, sum(CAST(is_installed AS INTEGER)) AS s
  FROM imp WHERE day < {LAST_DAY} GROUP BY ALL),
{name}_totals AS (SELECT v, sum(n) AS n, sum(s) AS s FROM {name}_parts GROUP BY v),
{name}_scores AS (
  SELECT i.row_id,
         CASE WHEN coalesce(t.n, 0) - coalesce(p.n, 0) > 1
              THEN (t.s - coalesce(p.s, 0) + r.prior) / (t.n - coalesce(p.n, 0) + 1) ELSE r.prior END AS {name}
  FROM imp i JOIN priors r ON r.day = i.day
  LEFT JOIN {name}_totals t ON t.v = i.{column}
  LEFT JOIN {name}_parts p ON p.v = i.{column} AND p.day = i.day)"""


SCORES_SQL = (
    f"""
day_rates AS (
  SELECT day, count(*) AS n, sum(CAST(is_installed AS INTEGER)) AS s FROM imp WHERE day < {LAST_DAY} GROUP BY day),
priors AS (
  SELECT d.day, ((SELECT sum(s) FROM day_rates) - coalesce(r.s, 0)) * 1.0
              / ((SELECT sum(n) FROM day_rates) - coalesce(r.n, 0)) AS prior
  FROM (SELECT DISTINCT day FROM imp) d LEFT JOIN day_rates r ON r.day = d.day),"""
    + ",".join(_score_sql(n, c) for n, c in (("cat", "c_k"), ("light", "c_user"), ("hist", "c_hour")))
    + """,
scores AS (
  SELECT i.row_id, i.day, i.is_clicked, i.is_installed, cat, light, hist,
         (cat + light) / 2 AS light_hybrid, (cat + hist) / 2 AS hist_hybrid
  FROM imp i JOIN cat_scores USING (row_id) JOIN light_scores USING (row_id) JOIN hist_scores USING (row_id))"""
)

_VIEWS = {"imp": [IMP_SQL], "ord": [ORD_SQL], "scores": [IMP_SQL, SCORES_SQL]}


def with_views(names: str, body: str) -> str:
    """Prefix `body` with the named views; `body` may start with more CTEs ("x AS (...) SELECT")."""
    parts: list[str] = []
    for name in names.split():
        parts += [p for p in _VIEWS[name] if p not in parts]
    body = body.strip()
    starts_with_cte = not body.upper().startswith(("SELECT", "("))
    return "WITH RECURSIVE " + ",".join(parts) + ("," if starts_with_cte else "") + "\n" + body
