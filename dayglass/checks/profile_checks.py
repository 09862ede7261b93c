"""Registered queries: profiling."""

from pyspark.sql import functions as F

from dayglass.operators import profiling as P
from dayglass.sources.fixtures import IMP, ORD, imp, ord_, table, with_views
from dayglass.checks.helpers import per_column_sql, rounded, union_all

QUERIES, SQL = {}, {}

CATS = list(IMP.categorical)
ORD_CATS = list(ORD.categorical)
ORD_NUMS = list(ORD.counter + ORD.numeric)

QUERIES["null_profile"] = lambda s, d: P.null_profile(ord_(s, d), ORD.columns("categorical", "binary", "counter", "numeric"))
SQL["null_profile"] = with_views(
    "ord",
    per_column_sql(
        ORD.columns("categorical", "binary", "counter", "numeric"),
        "SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) - count({c}) AS nulls FROM ord",
    ),
)

QUERIES["describe"] = lambda s, d: rounded(P.describe(ord_(s, d), ORD_NUMS), 6)
SQL["describe"] = with_views(
    "ord",
    per_column_sql(
        ORD_NUMS,
        "SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        "round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
        "round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM ord",
    ),
)

QUERIES["cardinality_profile"] = lambda s, d: P.cardinality_profile(ord_(s, d), ORD_CATS + ["row_id"])
SQL["cardinality_profile"] = with_views(
    "ord",
    per_column_sql(ORD_CATS + ["row_id"], "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM ord"),
)

QUERIES["top_categories"] = lambda s, d: P.top_categories(ord_(s, d), ORD_CATS, 10)
SQL["top_categories"] = with_views(
    "ord",
    "long AS ("
    + per_column_sql(ORD_CATS, "SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM ord")
    + """),
counts AS (SELECT "column", value, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY ALL)
SELECT "column", position, value, count, cardinality FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS position,
         count(*) OVER (PARTITION BY "column") AS cardinality FROM counts) WHERE position <= 10""",
)

QUERIES["rows_per_day"] = lambda s, d: P.rows_per_day(imp(s, d), "day")
SQL["rows_per_day"] = with_views("imp", "SELECT day, count(*) AS rows FROM imp GROUP BY day ORDER BY day")

QUERIES["melt_counts"] = lambda s, d: P.melt_counts(imp(s, d), list(IMP.binary))
SQL["melt_counts"] = with_views(
    "imp",
    "SELECT variable, value, count(*) AS count FROM ("
    + per_column_sql(list(IMP.binary), "SELECT '{c}' AS variable, {c} AS value FROM imp")
    + ") GROUP BY ALL",
)

QUERIES["day_category_coverage"] = lambda s, d: P.day_category_coverage(imp(s, d), "day", "c_user")
SQL["day_category_coverage"] = with_views(
    "imp",
    """SELECT day, day_categories, all_categories FROM (
  SELECT day, count(DISTINCT c_user) AS day_categories, (SELECT count(DISTINCT c_user) FROM imp) AS all_categories
  FROM imp GROUP BY day) WHERE day_categories <> all_categories""",
)

_ZERO = ["l_discount", "l_tax", "l_quantity"]
QUERIES["zero_share_profile"] = lambda s, d: rounded(
    P.zero_share_profile(table(s, d, "lineitem"), _ZERO).unionByName(P.zero_share_profile(imp(s, d), ["n_cnt", "b_even", "b_high"])), 6
)
SQL["zero_share_profile"] = with_views(
    "imp",
    union_all(
        per_column_sql(
            _ZERO,
            "SELECT '{c}' AS \"column\", round(avg(CAST({c} = 0 AS INTEGER)), 6) AS zero_share, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean FROM lineitem",
        ),
        per_column_sql(
            ["n_cnt", "b_even", "b_high"],
            "SELECT '{c}', round(avg(CAST(CAST({c} AS DOUBLE) = 0 AS INTEGER)), 6), round(max(CAST({c} AS DOUBLE)), 6), round(avg(CAST({c} AS DOUBLE)), 6) FROM imp",
        ),
    ),
)

QUERIES["value_histogram"] = lambda s, d: P.value_histogram(table(s, d, "lineitem"), "l_discount", 0.01)
SQL["value_histogram"] = "SELECT round(l_discount / CAST(0.01 AS DOUBLE), 6) AS value, count(*) AS count FROM lineitem GROUP BY 1"

_STEPS = ["l_discount", "l_quantity", "l_tax"]
QUERIES["step_detection"] = lambda s, d: rounded(P.step_detection(table(s, d, "lineitem"), _STEPS), 6)
SQL["step_detection"] = (
    "WITH v AS (SELECT DISTINCT * FROM ("
    + per_column_sql(_STEPS, "SELECT '{c}' AS \"column\", {c} AS value FROM lineitem")
    + """)),
u AS (SELECT "column", min(CASE WHEN value > 0 THEN value END) AS unit FROM v GROUP BY "column"),
m AS (SELECT v."column", value, unit, round(value / unit, 6) AS multiple FROM v JOIN u ON u."column" = v."column")
SELECT "column", round(value, 6) AS value, round(unit, 6) AS unit, multiple,
       round(avg(CAST(multiple = floor(multiple) AS INTEGER)) OVER (PARTITION BY "column"), 6) AS whole_share FROM m"""
)

QUERIES["frequent_combinations"] = lambda s, d: rounded(
    P.frequent_combinations(ord_(s, d), ["c_segment", "b_returned"], 0.05), 9
)
SQL["frequent_combinations"] = with_views(
    "ord",
    """SELECT c_segment, b_returned, count, round(share, 9) AS share FROM (
  SELECT c_segment, b_returned, count(*) AS count, count(*) / CAST((SELECT count(*) FROM ord) AS DOUBLE) AS share
  FROM ord GROUP BY ALL) WHERE share > 0.05""",
)

QUERIES["conditional_label_rate"] = lambda s, d: rounded(
    P.conditional_label_rate(
        imp(s, d), F.col("b_pm") & ~F.col("b_high") & (F.col("n_cnt") > 10), ["is_clicked", "is_installed"]
    ),
    9,
)
SQL["conditional_label_rate"] = with_views(
    "imp",
    """SELECT count(*) AS rows, CAST(sum(CAST(is_clicked AS INTEGER)) AS BIGINT) AS is_clicked_count,
  CAST(sum(CAST(is_installed AS INTEGER)) AS BIGINT) AS is_installed_count,
  round(avg(CAST(is_clicked AS INTEGER)), 9) AS is_clicked_rate, round(avg(CAST(is_installed AS INTEGER)), 9) AS is_installed_rate
  FROM imp WHERE b_pm AND NOT b_high AND n_cnt > 10""",
)

QUERIES["label_counts"] = lambda s, d: P.label_counts(imp(s, d), ~(F.col("b_pm") & F.col("b_even")), "is_installed")
SQL["label_counts"] = with_views(
    "imp", "SELECT is_installed, count(*) AS count FROM imp WHERE NOT (b_pm AND b_even) GROUP BY ALL"
)


def _six_bits(s, d):
    i = imp(s, d)
    return i.withColumns(
        {
            "b_k": F.col("c_k") % 2 == 0,
            "b_low": F.coalesce(F.col("n_val") < 10, F.lit(False)),
            "b_rare": (F.col("c_k") < 2) & F.col("b_even"),
        }
    )


_BITS = ["b_even", "b_pm", "b_high", "b_k", "b_low", "b_rare"]
QUERIES["pure_combinations"] = lambda s, d: P.pure_combinations(_six_bits(s, d), _BITS, "is_installed")
SQL["pure_combinations"] = with_views(
    "imp",
    """six AS (SELECT CAST(b_even AS INTEGER) AS b_even, CAST(b_pm AS INTEGER) AS b_pm, CAST(b_high AS INTEGER) AS b_high,
    CAST(c_k % 2 = 0 AS INTEGER) AS b_k, CAST(coalesce(n_val < 10, false) AS INTEGER) AS b_low,
    CAST(c_k < 2 AND b_even AS INTEGER) AS b_rare, CAST(is_installed AS INTEGER) AS y FROM imp),
g AS (SELECT b_even, b_pm, b_high, b_k, b_low, b_rare, count(*) AS n, min(y) AS low, max(y) AS high FROM six GROUP BY ALL),
b AS (SELECT * FROM (VALUES (0), (1)) t(v)),
grid AS (SELECT b1.v AS b_even, b2.v AS b_pm, b3.v AS b_high, b4.v AS b_k, b5.v AS b_low, b6.v AS b_rare FROM b b1, b b2, b b3, b b4, b b5, b b6)
SELECT grid.*, coalesce(n, 0) AS rows, low, high, coalesce(low = high, false) AS pure
FROM grid LEFT JOIN g USING (b_even, b_pm, b_high, b_k, b_low, b_rare)""",
)

QUERIES["all_true_all_false"] = lambda s, d: P.all_true_all_false(imp(s, d), list(IMP.binary))
SQL["all_true_all_false"] = with_views(
    "imp",
    """SELECT count(*) FILTER (b_even AND b_pm AND b_high) AS all_true,
  count(*) FILTER (NOT b_even AND NOT b_pm AND NOT b_high) AS all_false FROM imp""",
)

QUERIES["category_counts_per_day"] = lambda s, d: P.category_counts_per_day(imp(s, d), "day", "c_hour")
SQL["category_counts_per_day"] = with_views("imp", "SELECT day, c_hour, count(*) AS count FROM imp GROUP BY ALL")

QUERIES["density_per_day"] = lambda s, d: rounded(P.density_per_day(imp(s, d), "day", "n_val", points=50, skip_zeros=True), 9)
SQL["density_per_day"] = with_views(
    "imp",
    """x AS (SELECT day, n_val AS x FROM imp WHERE n_val IS NOT NULL AND n_val <> 0),
g AS (SELECT day, count(*) AS n, stddev_samp(x) * pow(count(*), CAST(-0.2 AS DOUBLE)) AS h,
        min(x) - (max(x) - min(x)) / 2 AS start, 2 * (max(x) - min(x)) / 49 AS gap
      FROM x GROUP BY day HAVING count(DISTINCT x) > 1),
p AS (SELECT CAST(unnest(range(50)) AS INTEGER) AS point)
SELECT g.day, point, round(start + point * gap, 9) AS at,
  round(sum(exp(-pow(start + point * gap - x, 2) / (2 * h * h))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
FROM g JOIN x USING (day), p GROUP BY g.day, point, start, gap""",
)

QUERIES["series_per_day"] = lambda s, d: P.series_per_day(imp(s, d), "day", "row_id", "n_val")
SQL["series_per_day"] = with_views(
    "imp", "SELECT day, row_id, n_val, row_number() OVER (PARTITION BY day ORDER BY row_id) AS position FROM imp"
)
