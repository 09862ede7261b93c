"""Registered queries: encoders and numeric transforms."""

from pyspark.sql import functions as F

from dayglass.operators import encoders as D
from dayglass.operators import scaling as S
from dayglass.sources.fixtures import LAST_DAY, SPLIT_DAY, imp, ord_, table, with_views
from dayglass.checks.helpers import per_column_sql, rounded

QUERIES, SQL = {}, {}


def _parts(s, d, split=LAST_DAY):
    """Train and later rows, with a category pair that the later rows know only in part."""
    rows = imp(s, d).withColumn("c_pair", F.col("c_user") * 100 + F.col("c_k"))
    rows = rows.select("row_id", "day", "c_user", "c_k", "c_pair", F.col("c_hour").cast("string").alias("c_text"), "is_installed")
    return rows.where(F.col("day") < split), rows.where(F.col("day") >= split)


_PARTS_SQL = """r AS (SELECT row_id, day, c_user, c_k, c_user * 100 + c_k AS c_pair, CAST(c_hour AS VARCHAR) AS c_text, is_installed FROM imp),
tr AS (SELECT * FROM r WHERE day < {split}), te AS (SELECT * FROM r WHERE day >= {split})"""
_CODED = ["c_user", "c_pair", "c_text"]


def _both(train, test, columns):
    return train.select("row_id", *columns).unionByName(test.select("row_id", *columns))


def _label_train(s, d):
    train, test = _parts(s, d)
    return _both(*D.label_encode_train(train, test, _CODED, "row_id"), _CODED)


QUERIES["label_encode_train"] = _label_train
SQL["label_encode_train"] = with_views(
    "imp",
    _PARTS_SQL.format(split=LAST_DAY)
    + "".join(
        f""",
k_{c} AS (SELECT {c} AS v, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code FROM tr GROUP BY {c}),
m_{c} AS (SELECT {c} AS v FROM tr GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
        for c in _CODED
    )
    + " SELECT r.row_id"
    + "".join(f", coalesce(k_{c}.code, (SELECT code FROM k_{c} WHERE v = (SELECT v FROM m_{c}))) AS {c}" for c in _CODED)
    + " FROM r"
    + "".join(f" LEFT JOIN k_{c} ON k_{c}.v = r.{c}" for c in _CODED),
)


def _label_union(s, d):
    train, test = _parts(s, d)
    return _both(*D.label_encode_union(train, test, _CODED, "row_id"), _CODED)


QUERIES["label_encode_union"] = _label_union
SQL["label_encode_union"] = with_views(
    "imp",
    _PARTS_SQL.format(split=LAST_DAY)
    + " SELECT row_id"
    + "".join(f", CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}" for c in _CODED)
    + " FROM r",
)


def _align(s, d):
    train, val = _parts(s, d, SPLIT_DAY)
    return _both(*D.align_categories(train, val, ["c_user", "c_pair"], "row_id"), ["c_user", "c_pair"])


QUERIES["align_categories"] = _align


def _align_sql(c: str) -> str:
    return f"""b_{c} AS (SELECT {c} AS v, count(*) AS n FROM tr WHERE {c} IN (SELECT {c} FROM te) GROUP BY {c}),
m_{c} AS (SELECT coalesce((SELECT v FROM b_{c} ORDER BY n DESC, v LIMIT 1), -1) AS m)"""


SQL["align_categories"] = with_views(
    "imp",
    _PARTS_SQL.format(split=SPLIT_DAY)
    + ",\n"
    + ",\n".join(_align_sql(c) for c in ("c_user", "c_pair"))
    + """
SELECT row_id, CASE WHEN bu.v IS NOT NULL THEN c_user WHEN day < 63 THEN -1 ELSE mu.m END AS c_user,
  CASE WHEN bp.v IS NOT NULL THEN c_pair WHEN day < 63 THEN -1 ELSE mp.m END AS c_pair
FROM r LEFT JOIN b_c_user bu ON bu.v = c_user LEFT JOIN b_c_pair bp ON bp.v = c_pair, m_c_user mu, m_c_pair mp""",
)


def _nullable(s, d):
    """Orders of the train days, with a NULL category for orders without lines."""
    rows = ord_(s, d).withColumn("c_nation", F.when(F.col("b_returned").isNotNull(), F.col("c_nation")))
    return rows.select("row_id", "day", "c_nation", "c_priority", "c_cust", "is_installed")


_NULLABLE_SQL = """r AS (SELECT row_id, day, CASE WHEN b_returned IS NOT NULL THEN c_nation END AS c_nation, c_priority, c_cust,
  CAST(is_installed AS INTEGER) AS y FROM ord), tr AS (SELECT * FROM r WHERE day < 63), p AS (SELECT avg(y) AS p FROM tr)"""
_STATS = ["c_nation", "c_priority", "c_cust"]


def _ordered(s, d):
    train = _nullable(s, d).where(F.col("day") < SPLIT_DAY)
    prior = D.label_rate(train, "is_installed")
    return rounded(D.ordered_target_stats(train, _STATS, "is_installed", "day", "row_id", prior).select("row_id", *_STATS), 9)


QUERIES["ordered_target_stats"] = _ordered
SQL["ordered_target_stats"] = with_views(
    "ord",
    _NULLABLE_SQL
    + " SELECT row_id"
    + "".join(
        f", round((coalesce(sum(y) OVER w_{c}, 0) + p) / (count(*) OVER w_{c} + 1), 9) AS {c}" for c in _STATS
    )
    + " FROM tr, p WINDOW "
    + ", ".join(
        f"w_{c} AS (PARTITION BY {c} ORDER BY day, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for c in _STATS
    ),
)


def _stats_apply(s, d):
    rows = _nullable(s, d)
    train = rows.where(F.col("day") < SPLIT_DAY)
    stats, prior = D.fit_target_stats(train, _STATS, "is_installed"), D.label_rate(train, "is_installed")
    return rounded(D.apply_target_stats(rows, stats, _STATS, prior, "row_id").select("row_id", *_STATS), 9)


QUERIES["target_stats_apply"] = _stats_apply


def _stats_sql(value: str) -> str:
    return with_views(
        "ord",
        _NULLABLE_SQL
        + "".join(f", t_{c} AS (SELECT {c} AS v, count(*) AS n, sum(y) AS s FROM tr GROUP BY {c})" for c in _STATS)
        + " SELECT row_id"
        + "".join(f", round({value.format(t=f't_{c}')}, 9) AS {c}" for c in _STATS)
        + " FROM r"
        + "".join(f" LEFT JOIN t_{c} ON t_{c}.v = r.{c}" for c in _STATS)
        + ", p",
    )


SQL["target_stats_apply"] = _stats_sql("CASE WHEN {t}.n > 1 THEN ({t}.s + p) / ({t}.n + 1) ELSE p END")


def _smoothed(s, d):
    rows = _nullable(s, d)
    train = rows.where(F.col("day") < SPLIT_DAY)
    stats, prior = D.fit_target_stats(train, _STATS, "is_installed"), D.label_rate(train, "is_installed")
    return rounded(D.apply_smoothed_stats(rows, stats, _STATS, prior, "row_id").select("row_id", *_STATS), 9)


QUERIES["smoothed_target_encode"] = _smoothed
SQL["smoothed_target_encode"] = _stats_sql(
    "coalesce({t}.s / {t}.n / (1 + exp(-({t}.n - 20) / 10.0)) + (1 - 1 / (1 + exp(-({t}.n - 20) / 10.0))) * p, p)"
)

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
QUERIES["one_hot"] = lambda s, d: D.one_hot(
    D.one_hot(ord_(s, d).select("row_id", "c_segment", "c_nation"), "c_segment", _SEGMENTS[:4]), "c_nation", list(range(10))
)
SQL["one_hot"] = with_views(
    "ord",
    "SELECT row_id"
    + "".join(f", CAST(c_segment = '{v}' AS INTEGER) AS c_segment_{v}" for v in _SEGMENTS[:4])
    + "".join(f", CAST(c_nation = {v} AS INTEGER) AS c_nation_{v}" for v in range(10))
    + " FROM ord",
)


def _binary(s, d):
    rows = imp(s, d).select("row_id", "day", "c_hour")
    codes = D.fit_label_codes(rows.where((F.col("day") < SPLIT_DAY) & (F.col("c_hour") != 7)), ["c_hour"])
    return D.binary_encode(rows, codes, "c_hour", "row_id").select("row_id", *[f"c_hour_{i}" for i in range(5)])


QUERIES["binary_encode"] = _binary
SQL["binary_encode"] = with_views(
    "imp",
    """k AS (SELECT c_hour AS v, CAST(dense_rank() OVER (ORDER BY c_hour) AS INTEGER) AS o FROM imp WHERE day < 63 AND c_hour <> 7 GROUP BY c_hour)
SELECT row_id"""
    + "".join(f", CAST((coalesce(o, 0) >> {4 - i}) & 1 AS INTEGER) AS c_hour_{i}" for i in range(5))
    + " FROM imp LEFT JOIN k ON v = c_hour",
)


def _by_cardinality(s, d):
    rows = ord_(s, d).select("row_id", "c_segment", "c_nation", "is_installed")
    return rounded(D.encode_by_cardinality(rows, ["c_segment", "c_nation"], "is_installed", "row_id").drop("is_installed"), 9)


QUERIES["encode_by_cardinality"] = _by_cardinality
SQL["encode_by_cardinality"] = with_views(
    "ord",
    """p AS (SELECT avg(CAST(is_installed AS INTEGER)) AS p FROM ord),
t AS (SELECT c_nation AS v, count(*) AS n, avg(CAST(is_installed AS INTEGER)) AS m FROM ord GROUP BY c_nation)
SELECT row_id, round(m / (1 + exp(-(n - 20) / 10.0)) + (1 - 1 / (1 + exp(-(n - 20) / 10.0))) * p, 9) AS c_nation"""
    + "".join(f", CAST(c_segment = '{v}' AS INTEGER) AS c_segment_{v}" for v in _SEGMENTS)
    + " FROM ord JOIN t ON v = c_nation, p",
)

_WIDE = ["c_segment", "c_priority", "c_nation", "c_cust"]


def _cardinality_filter(s, d):
    """The kept columns in long form, so that the schema does not depend on the data."""
    rows = ord_(s, d)
    return D.to_long(rows, D.columns_below(rows, _WIDE, 229), ["row_id"])


QUERIES["cardinality_filter"] = _cardinality_filter
SQL["cardinality_filter"] = with_views(
    "ord",
    "l AS ("
    + per_column_sql(_WIDE, "SELECT row_id, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM ord")
    + """), k AS (SELECT "column" FROM l GROUP BY "column" HAVING count(DISTINCT value) < 229)
SELECT row_id, "column", value FROM l WHERE "column" IN (SELECT "column" FROM k)""",
)


def _outliers(s, d):
    rows = ord_(s, d).select("row_id", "day", "n_total", "n_bal", "n_qty")
    columns = ["n_total", "n_bal", "n_qty"]
    spread = S.fit_zscore(rows.where(F.col("day") < SPLIT_DAY), columns)
    return rounded(S.remove_outliers(rows, columns, 1.5, spread, "row_id", percentage=0.01), 6)


QUERIES["remove_outliers"] = _outliers
SQL["remove_outliers"] = with_views(
    "ord",
    "s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ("n_total", "n_bal", "n_qty"))
    + " FROM ord WHERE day < 63), o AS (SELECT count(*) AS n, "
    + ", ".join(f"avg({c}) AS a_{c}" for c in ("n_total", "n_bal", "n_qty"))
    + " FROM ord)"
    + "".join(
        f""", x_{c} AS (SELECT row_id, row_number() OVER (ORDER BY abs({c} - m_{c}) / s_{c} DESC, row_id) AS r
  FROM ord, s WHERE abs({c} - m_{c}) / s_{c} > 1.5)"""
        for c in ("n_total", "n_bal", "n_qty")
    )
    + " SELECT ord.row_id, day"
    + "".join(
        f", round(CASE WHEN x_{c}.r <= floor(o.n * 0.01) THEN a_{c} ELSE {c} END, 6) AS {c}" for c in ("n_total", "n_bal", "n_qty")
    )
    + " FROM ord"
    + "".join(f" LEFT JOIN x_{c} ON x_{c}.row_id = ord.row_id" for c in ("n_total", "n_bal", "n_qty"))
    + ", o",
)


def _counters(s, d):
    rows = imp(s, d).select("row_id", "day", "n_cnt", "n_val")
    spread = S.fit_counters(rows.where(F.col("day") < SPLIT_DAY), ["n_cnt", "n_val"])
    return rounded(S.apply_spread(rows, ["n_cnt", "n_val"], spread), 4)


QUERIES["encode_counters"] = _counters
SQL["encode_counters"] = with_views(
    "imp",
    """v AS (SELECT DISTINCT 'a' AS c, round(n_cnt, 9) AS x FROM imp WHERE day < 63 UNION SELECT 'b', round(n_val, 9) FROM imp WHERE day < 63),
g AS (SELECT c, x, x - lag(x) OVER (PARTITION BY c ORDER BY x) AS gap FROM v WHERE x IS NOT NULL),
f AS (SELECT min(x) FILTER (c = 'a') AS ma, min(gap) FILTER (c = 'a') AS sa, min(x) FILTER (c = 'b') AS mb, min(gap) FILTER (c = 'b') AS sb FROM g)
SELECT row_id, day, round((n_cnt - ma) / sa, 4) AS n_cnt, round((n_val - mb) / sb, 4) AS n_val FROM imp, f""",
)

_NUMS = ["n_total", "n_bal", "n_lines"]


def _scaled(fit):
    def query(s, d):
        rows = ord_(s, d).select("row_id", "day", *_NUMS)
        return rounded(S.apply_spread(rows, _NUMS, fit(rows.where(F.col("day") < SPLIT_DAY), _NUMS)), 9)

    return query


def _scaled_sql(center: str, width: str) -> str:
    return with_views(
        "ord",
        "f AS (SELECT "
        + ", ".join(f"{center.format(c=c)} AS a_{c}, {width.format(c=c)} AS b_{c}" for c in _NUMS)
        + " FROM ord WHERE day < 63) SELECT row_id, day"
        + "".join(f", round(({c} - a_{c}) / b_{c}, 9) AS {c}" for c in _NUMS)
        + " FROM ord, f",
    )


QUERIES["zscore"] = _scaled(S.fit_zscore)
SQL["zscore"] = _scaled_sql("avg({c})", "stddev_samp({c})")
QUERIES["standard_scale"] = _scaled(S.fit_standard)
SQL["standard_scale"] = _scaled_sql("avg({c})", "stddev_pop({c})")
QUERIES["minmax_scale"] = _scaled(S.fit_minmax)
SQL["minmax_scale"] = _scaled_sql("min({c})", "(max({c}) - min({c}))")


def _covariance(s, d):
    rows = table(s, d, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    return rounded(S.covariance(rows, rows.columns), 9)


QUERIES["covariance_matrix"] = _covariance
SQL["covariance_matrix"] = """WITH e AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i FROM embeddings)
SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 9) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i"""
