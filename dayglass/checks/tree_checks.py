"""Registered queries: leaf-wise trees, day-out models and stacked models, quantile sketches and borders."""

from pyspark.sql import functions as F

from dayglass.checks.helpers import rounded
from dayglass.operators import boosting
from dayglass.operators import joins as G
from dayglass.operators import trees as T
from dayglass.operators.ordering import exact_quantiles
from dayglass.operators.sketches import sketched_quantiles
from dayglass.plans import models as J
from dayglass.session import cut_lineage
from dayglass.sources.fixtures import LAST_DAY, imp, with_views

QUERIES, SQL = {}, {}

FEATURES = ["n_cnt", "n_val", "c_hour", "c_k", "c_user"]
_BINS = 16


def _exact_borders(rows, features, bins=_BINS):
    """Interpolated quantiles at equal shares, which SQL can state; the jobs themselves take them from sketches."""
    found = exact_quantiles(rows, features, [i / bins for i in range(1, bins)])
    return {c: sorted({v for v in values if v is not None}) for c, values in found.items()}


def _borders_sql(source, features, bins=_BINS):
    shares = ", ".join(f"{i}.0 / {bins}" for i in range(1, bins))
    return ", ".join(f"list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [{shares}]))) AS q_{c}" for c in features) + f" FROM {source}"


def _bin_sql(c):
    return f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 + len(list_filter(q_{c}, lambda q: q < CAST({c} AS DOUBLE))) END"


def tree_sql(name, source, features, folds, learns, scored, settings, bins=_BINS):
    """One boosting round of best-first trees as CTEs that end in ``{name}(row_id, day, score)``.

    ``folds`` is a query for (fold); ``learns`` and ``scored`` are conditions on fold and day.
    """
    values = " ".join(f"WHEN {i} THEN b_{i}" for i in range(len(features)))
    parts = [
        f"{name}_q AS (SELECT {_borders_sql(source, features, bins)})",
        f"{name}_b AS (SELECT row_id, day, CAST(is_installed AS INTEGER) AS y, "
        + ", ".join(f"{_bin_sql(c)} AS b_{i}" for i, c in enumerate(features))
        + f" FROM {source}, {name}_q)",
        f"{name}_f AS ({folds})",
        f"{name}_p AS (SELECT fold, CAST(sum(y) AS DOUBLE) / count(*) AS p FROM {name}_b JOIN {name}_f ON {learns} GROUP BY fold)",
        f"{name}_t0 AS (SELECT fold, p, p - y AS g, p * (1 - p) AS h, b.*, 0 AS node, ({learns}) AS learn, ({scored}) AS wanted FROM {name}_b b, {name}_p WHERE ({learns}) OR ({scored}))",
    ]
    for i in range(settings.leaves - 1):
        long = " UNION ALL ".join(f"SELECT fold, node, {f} AS f, b_{f} AS b, g, h FROM {name}_t{i} WHERE learn" for f in range(len(features)))
        cumulated = ", ".join(f"sum({x}) OVER (PARTITION BY fold, node, f ORDER BY b) AS {x}l, sum({x}) OVER (PARTITION BY fold, node, f) AS {x}a" for x in "ghn")
        parts += [
            f"{name}_l{i} AS (SELECT fold, node, f, b, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({long}) GROUP BY ALL)",
            f"{name}_c{i} AS (SELECT fold, node, f, b, {cumulated} FROM {name}_l{i})",
            f"""{name}_s{i} AS (SELECT fold, node, f, b FROM (
  SELECT fold, node, f, b, round(gl * gl / (hl + {settings.l2}) + (ga - gl) * (ga - gl) / (ha - hl + {settings.l2}) - ga * ga / (ha + {settings.l2}), 9) AS gain
  FROM {name}_c{i} WHERE nl >= {settings.min_leaf} AND na - nl >= {settings.min_leaf}) WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gain DESC, node, f, b) = 1)""",
            f"""{name}_t{i + 1} AS (SELECT t.* REPLACE (CASE WHEN t.node = s.node THEN CASE WHEN CASE s.f {values} END <= s.b THEN {2 * i + 1} ELSE {2 * i + 2} END ELSE t.node END AS node)
  FROM {name}_t{i} t LEFT JOIN {name}_s{i} s ON s.fold = t.fold)""",
        ]
    last = f"{name}_t{settings.leaves - 1}"
    parts += [
        f"{name}_v AS (SELECT fold, node, -{settings.rate} * sum(g) / (sum(h) + {settings.l2}) AS v FROM {last} WHERE learn GROUP BY fold, node)",
        f"{name} AS (SELECT row_id, day, 1 / (1 + exp(-(ln(p / (1 - p)) + v))) AS score FROM {last} t JOIN {name}_v v ON v.fold = t.fold AND v.node = t.node WHERE wanted)",
    ]
    return ",\n".join(parts)


_ALL_DAYS = "SELECT DISTINCT day AS fold FROM imp"
_LEARNS, _SCORED = f"day < {LAST_DAY} AND day <> fold", "day = fold"

# Day-out models: one model per day, and the test day by a model of all other days

_OOF = J.TreeSettings(1, 63, 0.1, _BINS, 20, leaves=3)


def _rows(s, d):
    return imp(s, d).select("row_id", "day", "is_installed", *FEATURES)


def _day_out(rows, features, settings):
    days = J.days_before(rows, "day", LAST_DAY)
    return J.day_out_model_scores(rows, features, "row_id", "day", days, settings, test_day=LAST_DAY, borders=_exact_borders(rows, features))


QUERIES["oof_model_scores"] = lambda s, d: rounded(_day_out(_rows(s, d), FEATURES, _OOF), 9)
SQL["oof_model_scores"] = with_views(
    "imp", tree_sql("oof", "imp", FEATURES, _ALL_DAYS, _LEARNS, _SCORED, _OOF) + " SELECT row_id, day, round(score, 9) AS score FROM oof"
)

# A tree of six leaves on all days before the test day, scoring it

_SIX = J.TreeSettings(1, 63, 0.3, _BINS, 20, leaves=6)


def _leafwise(s, d):
    rows = _rows(s, d)
    model = T.Model(tuple(J.days_before(rows, "day", LAST_DAY)))
    grown = J.grow_leafwise(rows, FEATURES, "row_id", "day", "is_installed", [model], _SIX, _exact_borders(rows, FEATURES))
    return rounded(J.own_model_scores(grown, "row_id", "day", {LAST_DAY: 0}), 9)


QUERIES["leafwise_model"] = _leafwise
SQL["leafwise_model"] = with_views(
    "imp", tree_sql("six", "imp", FEATURES, f"SELECT {LAST_DAY} AS fold", _LEARNS, _SCORED, _SIX) + " SELECT row_id, day, round(score, 9) AS score FROM six"
)

# Stacked models: day-out scores of two models are features of a third

_FIRST = {"light": ["n_cnt", "n_val", "c_user"], "hist": ["c_hour", "c_k"]}


def _stacked(s, d):
    rows = _rows(s, d)
    first = {}
    for name, features in _FIRST.items():
        found = _day_out(rows.select("row_id", "day", "is_installed", *features), features, _OOF)
        first[name] = cut_lineage(found.select("row_id", F.round("score", 9).alias("score")))
    scores = cut_lineage(G.join_scores(first, "row_id"))
    joined = rows.join(scores, "row_id")
    borders = _exact_borders(joined, [*FEATURES, *_FIRST])
    return rounded(J.stacked_scores(rows, FEATURES, "row_id", "day", LAST_DAY, scores, list(_FIRST), _OOF, borders=borders), 9)


QUERIES["stacked_hybrid"] = _stacked
SQL["stacked_hybrid"] = with_views(
    "imp",
    ",\n".join(tree_sql(name, "imp", features, _ALL_DAYS, _LEARNS, _SCORED, _OOF) for name, features in _FIRST.items())
    + ",\nwide AS (SELECT imp.*, round(light.score, 9) AS light, round(hist.score, 9) AS hist FROM imp JOIN light USING (row_id) JOIN hist USING (row_id)),\n"
    + tree_sql("top", "wide", [*FEATURES, *_FIRST], f"SELECT {LAST_DAY} AS fold", f"{_LEARNS} AND day NOT IN {J.EXCLUDED_DAYS}", _SCORED, _OOF)
    + " SELECT row_id, round(score, 9) AS score FROM top",
)

# Sketches: the rank of each sketched value is within the stated error


def _sketch(s, d):
    rows = _rows(s, d).select(*FEATURES)
    found = sketched_quantiles(rows, FEATURES, [i / 32 for i in range(1, 32)])
    values = rows.unpivot([], [F.col(c).cast("double").alias(c) for c in FEATURES], "column", "x").where("x IS NOT NULL")
    sizes = values.groupBy("column").agg(F.count("*").alias("n"))
    # 31 cuts per feature: few rows.
    cuts = F.broadcast(found)
    ranks = values.join(cuts, "column").groupBy("column", "share", "value", "error").agg(
        F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto")
    )
    target, slack = F.ceil(F.col("share") * F.col("n")), F.col("error") * F.col("n")
    ranks = ranks.join(F.broadcast(sizes), "column")
    return ranks.select("column", "share", ((F.col("below") < target + slack) & (F.col("upto") >= target - slack) & (F.col("error") < 0.01)).alias("within_error"))


QUERIES["quantile_sketch"] = _sketch
SQL["quantile_sketch"] = (
    "SELECT c AS column, i / 32.0::DOUBLE AS share, true AS within_error FROM (SELECT unnest(["
    + ", ".join(f"'{c}'" for c in FEATURES)
    + "]) AS c), (SELECT unnest(range(1, 32)) AS i)"
)

# A boosting round of DataFrame expressions on quantile borders

_BOOST = boosting.BoostParams(depth=2, learning_rate=0.3, l2=1.0, min_rows=50)
_SOME = ["n_cnt", "n_val", "c_hour"]


def _border_round(s, d):
    rows = imp(s, d).select("row_id", "is_installed", *_SOME)
    state = boosting.start_state(rows, "row_id", _SOME, "is_installed", _BOOST, -0.5, _exact_borders(rows, _SOME))
    scored, _, _ = boosting.boosting_round(state, _SOME, "is_installed", _BOOST)
    return rounded(scored.select("row_id", F.col("node").cast("int").alias("node"), "raw"), 9)


QUERIES["quantile_boosting_round"] = _border_round


def _border_round_sql():
    values = " ".join(f"WHEN '{c}' THEN bin_{c}" for c in _SOME)
    parts = [
        f"q AS (SELECT {_borders_sql('imp', _SOME)})",
        "n0 AS (SELECT row_id, 1 AS node, 1 / (1 + exp(0.5)) - CAST(is_installed AS INTEGER) AS g, exp(0.5) / (1 + exp(0.5)) ** 2 AS h, "
        + ", ".join(f"{_bin_sql(c)} AS bin_{c}" for c in _SOME)
        + " FROM imp, q)",
    ]
    for i in range(2):
        long = " UNION ALL ".join(f"SELECT node, '{c}' AS f, bin_{c} AS b, g, h FROM n{i}" for c in _SOME)
        cumulated = ", ".join(f"sum({x}) OVER (PARTITION BY node, f ORDER BY b) AS {x}l, sum({x}) OVER (PARTITION BY node, f) AS {x}a" for x in "ghn")
        parts += [
            f"l{i} AS (SELECT node, f, b, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({long}) GROUP BY ALL)",
            f"s{i} AS (SELECT node, f, b, {cumulated} FROM l{i})",
            f"""b{i} AS (SELECT node, f, b FROM (SELECT node, f, b, round(gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1), 9) AS gain
  FROM s{i} WHERE nl >= 50 AND na - nl >= 50) QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1)""",
            f"n{i + 1} AS (SELECT n.* REPLACE (n.node * 2 + CASE WHEN CASE s.f {values} END > s.b THEN 1 ELSE 0 END AS node) FROM n{i} n LEFT JOIN b{i} s ON s.node = n.node)",
        ]
    parts.append("v AS (SELECT node, -0.3 * sum(g) / (sum(h) + 1) AS v FROM n2 GROUP BY node)")
    return with_views("imp", ",\n".join(parts) + " SELECT row_id, CAST(n2.node AS INTEGER) AS node, round(-0.5 + v, 9) AS raw FROM n2 JOIN v ON v.node = n2.node")


SQL["quantile_boosting_round"] = _border_round_sql()
