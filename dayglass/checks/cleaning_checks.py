"""Registered queries: cleaning, derived columns, splits and filters."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dayglass.functions import scalar
from dayglass.operators import cleaning as B
from dayglass.operators import splits as C
from dayglass.sources.fixtures import IMP, SPLIT_DAY, imp, ord_, with_views
from dayglass.checks.helpers import rounded

QUERIES, SQL = {}, {}

QUERIES["drop_useless"] = lambda s, d: B.drop_useless(imp(s, d), ["c_hour", "b_high", "n_cnt"])
SQL["drop_useless"] = with_views("imp", "SELECT * EXCLUDE (c_hour, b_high, n_cnt) FROM imp")

QUERIES["select_by_role"] = lambda s, d: B.select_by_role(imp(s, d), IMP, "row_id", "categorical", "label")
SQL["select_by_role"] = with_views("imp", "SELECT row_id, c_user, c_hour, c_k, is_clicked, is_installed FROM imp")

QUERIES["bool_to_int"] = lambda s, d: B.bools_to_int(imp(s, d), IMP.columns("binary", "label")).select(
    "row_id", *IMP.columns("binary", "label")
)
SQL["bool_to_int"] = with_views(
    "imp",
    "SELECT row_id, "
    + ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in IMP.columns("binary", "label"))
    + " FROM imp",
)


def _mixed_codes(s, d):
    odd = F.col("c_hour") % 2
    mixed = (
        F.when(F.col("c_hour") % 5 == 4, F.lit(None).cast("string"))
        .when(F.col("c_k") % 2 == 0, odd.cast("string"))
        .otherwise(odd.cast("double").cast("string"))
    )
    return imp(s, d).select("row_id", scalar.canonical_code(mixed).alias("code"))


QUERIES["canonicalise_codes"] = _mixed_codes
SQL["canonicalise_codes"] = with_views(
    "imp",
    """SELECT row_id, coalesce(CAST(TRY_CAST(CASE WHEN c_hour % 5 = 4 THEN NULL WHEN c_k % 2 = 0 THEN CAST(c_hour % 2 AS VARCHAR)
  ELSE CAST(CAST(c_hour % 2 AS DOUBLE) AS VARCHAR) END AS DOUBLE) AS INTEGER), -2) AS code FROM imp""",
)

QUERIES["weekday_recode"] = lambda s, d: imp(s, d).select(
    "row_id",
    scalar.weekday_code(F.col("day"), F.col("c_k"), scalar.WEEKDAY_CODES_RAW, last_day=60).alias("raw_code"),
    scalar.weekday_code(F.col("day"), F.col("c_k"), scalar.WEEKDAY_CODES_ENCODED).alias("encoded_code"),
)


def _weekday_sql(codes: dict, last: int) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.items())
    return f"CASE WHEN day BETWEEN 45 AND {last} THEN CASE day % 7 {cases} END ELSE CAST(c_k AS VARCHAR) END"


SQL["weekday_recode"] = with_views(
    "imp",
    f"SELECT row_id, {_weekday_sql(scalar.WEEKDAY_CODES_RAW, 60)} AS raw_code, "
    f"{_weekday_sql(scalar.WEEKDAY_CODES_ENCODED, 67)} AS encoded_code FROM imp",
)

QUERIES["trig_date_encoding"] = lambda s, d: rounded(
    B.add_trig_date(imp(s, d), "day").select("row_id", "day", "sin_date", "cos_date"), 9
)
SQL["trig_date_encoding"] = with_views(
    "imp",
    "SELECT row_id, day, round(sin(2 * pi() * (day % 7) / 7), 9) AS sin_date, round(cos(2 * pi() * (day % 7) / 7), 9) AS cos_date FROM imp",
)

_PAIRS = {"43": "n_total", "51": "n_bal", "66": "n_qty", "70": "n_disc"}
QUERIES["pairwise_products"] = lambda s, d: rounded(ord_(s, d).select("row_id", *scalar.products(_PAIRS)), 4)
SQL["pairwise_products"] = with_views(
    "ord",
    """SELECT row_id, round(n_total * n_bal, 4) AS "f_new43-51", round(n_total * n_qty, 4) AS "f_new43-66",
  round(n_total * n_disc, 4) AS "f_new43-70", round(n_bal * n_qty, 4) AS "f_new51-66",
  round(n_bal * n_disc, 4) AS "f_new51-70", round(n_qty * n_disc, 4) AS "f_new66-70" FROM ord""",
)

QUERIES["collapse_binary"] = lambda s, d: B.collapse_binary(
    imp(s, d).select("row_id", *IMP.binary), {"b_all": list(IMP.binary), "b_two": ["b_even", "b_pm"]}
)
SQL["collapse_binary"] = with_views(
    "imp",
    """SELECT row_id, concat(CAST(b_even AS INTEGER), CAST(b_pm AS INTEGER), CAST(b_high AS INTEGER)) AS b_all,
  concat(CAST(b_even AS INTEGER), CAST(b_pm AS INTEGER)) AS b_two FROM imp""",
)


def _fill_mean(s, d):
    rows, columns = ord_(s, d), ["n_lines", "n_qty", "n_disc"]
    means = B.column_means(rows.where(F.col("day") < SPLIT_DAY), columns)
    return rounded(B.fill(rows.select("row_id", *columns), means), 6)


QUERIES["fill_mean"] = _fill_mean
SQL["fill_mean"] = with_views(
    "ord",
    "m AS (SELECT avg(n_lines) AS a, avg(n_qty) AS b, avg(n_disc) AS c FROM ord WHERE day < 63) "
    "SELECT row_id, round(coalesce(n_lines, a), 6) AS n_lines, round(coalesce(n_qty, b), 6) AS n_qty, "
    "round(coalesce(n_disc, c), 6) AS n_disc FROM ord, m",
)


def _fill_mode(s, d):
    rows, columns = ord_(s, d), ["n_lines", "n_qty", "n_disc"]
    modes = B.column_modes(rows.where(F.col("day") < SPLIT_DAY), columns)
    return B.fill(rows.select("row_id", *columns), modes)


QUERIES["fill_mode"] = _fill_mode
SQL["fill_mode"] = with_views(
    "ord",
    ", ".join(
        f"m_{c} AS (SELECT {c} AS m FROM ord WHERE day < 63 AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        for c in ("n_lines", "n_qty", "n_disc")
    )
    + "\nSELECT row_id, "
    + ", ".join(f"coalesce({c}, (SELECT m FROM m_{c})) AS {c}" for c in ("n_lines", "n_qty", "n_disc"))
    + " FROM ord",
)

QUERIES["fill_const"] = lambda s, d: B.fill_const(
    ord_(s, d).select("row_id", F.when(~F.col("b_returned"), F.col("c_nation")).alias("c_nation")), ["c_nation"]
)
SQL["fill_const"] = with_views(
    "ord", "SELECT row_id, coalesce(CASE WHEN NOT b_returned THEN c_nation END, -100) AS c_nation FROM ord"
)

QUERIES["log_positive"] = lambda s, d: rounded(
    imp(s, d).select("row_id", scalar.log_positive(F.col("n_val") - 5).alias("n_val"), scalar.log_positive(F.col("n_cnt")).alias("n_cnt")), 9
)
SQL["log_positive"] = with_views(
    "imp",
    """SELECT row_id, round(CASE WHEN n_val - 5 > 0 THEN ln(n_val - 5) ELSE n_val - 5 END, 9) AS n_val,
  round(CASE WHEN n_cnt > 0 THEN ln(n_cnt) ELSE n_cnt END, 9) AS n_cnt FROM imp""",
)

QUERIES["log_shift"] = lambda s, d: rounded(imp(s, d).select("row_id", scalar.log_shift(F.col("n_cnt") - 1).alias("n_cnt")), 9)
SQL["log_shift"] = with_views(
    "imp", "SELECT row_id, round(CASE WHEN n_cnt - 1 > -0.5 THEN ln(n_cnt - 1 + 0.5) END, 9) AS n_cnt FROM imp"
)


def _binarise(s, d):
    rows = ord_(s, d).select("row_id", "day", "n_disc", "n_lines", F.when(F.col("n_qty") > 300, F.col("n_qty")).otherwise(0.0).alias("n_big"))
    shares = B.zero_shares(rows.where(F.col("day") < SPLIT_DAY), ["n_disc", "n_lines", "n_big"])
    return rounded(B.log_or_binarise(rows, shares), 9)


QUERIES["binarise_sparse_counters"] = _binarise
SQL["binarise_sparse_counters"] = with_views(
    "ord",
    """r AS (SELECT row_id, day, n_disc, n_lines, CASE WHEN n_qty > 300 THEN n_qty ELSE 0 END AS n_big FROM ord),
z AS (SELECT count(*) FILTER (n_disc = 0) / count(*) AS a, count(*) FILTER (n_lines = 0) / count(*) AS b,
             count(*) FILTER (n_big = 0) / count(*) AS c FROM r WHERE day < 63)
SELECT row_id, day,
  round(CASE WHEN a > 0.95 THEN CAST(n_disc <> 0 AS DOUBLE) WHEN n_disc > -0.5 THEN ln(n_disc + 0.5) END, 9) AS n_disc,
  round(CASE WHEN b > 0.95 THEN CAST(n_lines <> 0 AS DOUBLE) WHEN n_lines > -0.5 THEN ln(n_lines + 0.5) END, 9) AS n_lines,
  round(CASE WHEN c > 0.95 THEN CAST(n_big <> 0 AS DOUBLE) WHEN n_big > -0.5 THEN ln(n_big + 0.5) END, 9) AS n_big
FROM r, z""",
)

QUERIES["rescale_units"] = lambda s, d: rounded(
    B.rescale_units(imp(s, d).select("row_id", "n_cnt", "n_val"), {"n_cnt": 0.5, "n_val": scalar.COUNTER_UNITS["f_42"]}), 6
)
SQL["rescale_units"] = with_views(
    "imp",
    "SELECT row_id, round(n_cnt / CAST(0.5 AS DOUBLE), 6) AS n_cnt, round(n_val / CAST(0.038564 AS DOUBLE), 6) AS n_val FROM imp",
)

QUERIES["seeded_shuffle_sample"] = lambda s, d: B.sample_rows(imp(s, d).select("row_id", "day", "c_user"), "row_id", 7, n=1000)
SQL["seeded_shuffle_sample"] = with_views(
    "imp", "SELECT row_id, day, c_user FROM imp ORDER BY md5(concat(row_id, '|', 7)), row_id LIMIT 1000"
)

QUERIES["assemble_vector"] = lambda s, d: rounded(
    B.assemble(imp(s, d).select("row_id", "c_hour", "n_cnt", F.coalesce("n_val", F.lit(0.0)).alias("n_val"), F.col("b_pm").cast("int").alias("b_pm")), ["c_hour", "n_cnt", "n_val", "b_pm"])
    .select("row_id", F.posexplode(vector_to_array("features")).alias("position", "value")),
    6,
)
SQL["assemble_vector"] = with_views(
    "imp",
    """SELECT row_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS position, round(unnest(v), 6) AS value FROM (
  SELECT row_id, [CAST(c_hour AS DOUBLE), n_cnt, coalesce(n_val, 0), CAST(b_pm AS DOUBLE)] AS v FROM imp)""",
)

QUERIES["head_sorted"] = lambda s, d: B.head_sorted(imp(s, d), "day", "row_id", 500)
SQL["head_sorted"] = with_views("imp", "SELECT * FROM imp ORDER BY day, row_id LIMIT 500")

QUERIES["split_by_day"] = lambda s, d: C.tag_split(imp(s, d), "day", SPLIT_DAY).select("row_id", "day", "split")
SQL["split_by_day"] = with_views(
    "imp", "SELECT row_id, day, CASE WHEN day < 63 THEN 'train' ELSE 'val' END AS split FROM imp"
)

QUERIES["walk_forward_splits"] = lambda s, d: C.walk_forward(imp(s, d), "day", start=48).select("row_id", "day", "fold", "part")
SQL["walk_forward_splits"] = with_views(
    "imp",
    """folds AS (SELECT CAST(unnest(range(52, 67)) AS INTEGER) AS fold)
SELECT row_id, day, fold, CASE WHEN day < fold THEN 'train' ELSE 'val' END AS part
FROM imp JOIN folds ON day >= 48 AND day < fold + 1""",
)

QUERIES["leave_one_day_out"] = lambda s, d: rounded(
    C.other_days(
        imp(s, d).where(F.col("day") < 67),
        "day",
        {"rows": F.count("*"), "installs": F.sum(F.col("is_installed").cast("long")), "value": F.sum("n_val")},
    ),
    4,
)
SQL["leave_one_day_out"] = with_views(
    "imp",
    """d AS (SELECT day, count(*) AS n, CAST(sum(CAST(is_installed AS INTEGER)) AS BIGINT) AS s, sum(n_val) AS v FROM imp WHERE day < 67 GROUP BY day)
SELECT a.day AS fold, a.n AS own_rows, a.s AS own_installs, round(a.v, 4) AS own_value,
  CAST(sum(b.n) AS BIGINT) AS other_rows, CAST(sum(b.s) AS BIGINT) AS other_installs, round(sum(b.v), 4) AS other_value
FROM d a JOIN d b ON a.day <> b.day GROUP BY ALL""",
)

QUERIES["exclude_days"] = lambda s, d: C.exclude_days(imp(s, d), "day").select("row_id", "day")
SQL["exclude_days"] = with_views("imp", "SELECT row_id, day FROM imp WHERE day NOT IN (48, 50, 52)")

_PATTERN = {"b_even": False, "b_pm": True, "b_high": False}

QUERIES["boolean_pattern_filter"] = lambda s, d: imp(s, d).where(C.boolean_pattern(_PATTERN)).select("row_id", "is_clicked", "is_installed")
SQL["boolean_pattern_filter"] = with_views(
    "imp", "SELECT row_id, is_clicked, is_installed FROM imp WHERE NOT b_even AND b_pm AND NOT b_high"
)
QUERIES["boolean_pattern_rest"] = lambda s, d: imp(s, d).where(~C.boolean_pattern(_PATTERN)).select("row_id", "is_clicked", "is_installed")
SQL["boolean_pattern_rest"] = with_views(
    "imp", "SELECT row_id, is_clicked, is_installed FROM imp WHERE NOT (NOT b_even AND b_pm AND NOT b_high)"
)

QUERIES["value_filter"] = lambda s, d: imp(s, d).where((F.col("n_val") > 38) & (F.col("day") == 46)).select("row_id", "day", "n_val", "c_k")
SQL["value_filter"] = with_views("imp", "SELECT row_id, day, n_val, c_k FROM imp WHERE n_val > 38 AND day = 46")
