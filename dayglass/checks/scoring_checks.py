"""Registered queries: joins, set operations, scoring and metrics."""

from pyspark.sql import functions as F

from dayglass.functions import scalar
from dayglass.operators import joins as G
from dayglass.operators import metrics as I
from dayglass.operators import scoring as H
from dayglass.session import cut_lineage
from dayglass.sources.fixtures import LAST_DAY, MODELS, imp, ord_, scores, table, with_views
from dayglass.checks.helpers import per_column_sql, rounded, union_all

QUERIES, SQL = {}, {}


def _score_tables(s, d):
    all_scores = scores(s, d)
    return {m: all_scores.select("row_id", F.col(m).alias("score")) for m in ("cat", "light", "hist")}


QUERIES["join_scores"] = lambda s, d: rounded(G.join_scores(_score_tables(s, d), "row_id"), 9)
SQL["join_scores"] = with_views(
    "scores", "SELECT row_id, round(cat, 9) AS cat, round(light, 9) AS light, round(hist, 9) AS hist FROM scores"
)


def _concat_columns(s, d):
    i = imp(s, d)
    return G.concat_columns([i.select("row_id", "c_user", "c_hour"), i.select("row_id", "b_pm"), i.select("row_id", "n_val")], "row_id")


QUERIES["concat_columns"] = _concat_columns
SQL["concat_columns"] = with_views("imp", "SELECT row_id, c_user, c_hour, b_pm, n_val FROM imp")


def _concat_rows(s, d):
    i = imp(s, d)
    train, test = i.where(F.col("day") < LAST_DAY), i.where(F.col("day") >= LAST_DAY).drop("is_clicked", "is_installed")
    return G.concat_rows([train, test]).select("row_id", "day", "is_clicked", "is_installed")


QUERIES["concat_rows"] = _concat_rows
SQL["concat_rows"] = with_views(
    "imp",
    "SELECT row_id, day, is_clicked, is_installed FROM imp WHERE day < 67 UNION ALL SELECT row_id, day, NULL, NULL FROM imp WHERE day >= 67",
)


def _train_test(s, d):
    i = imp(s, d).withColumn("c_pair", F.col("c_k") * 24 + F.col("c_hour"))
    return i.where(F.col("day") < 46), i.where(F.col("day") >= 46)


QUERIES["unseen_values"] = lambda s, d: G.unseen_rows(_train_test(s, d)[1], _train_test(s, d)[0], "c_pair").select("row_id", "c_pair")
SQL["unseen_values"] = with_views(
    "imp",
    """p AS (SELECT row_id, day, c_k * 24 + c_hour AS c_pair FROM imp)
SELECT row_id, c_pair FROM p WHERE day >= 46 AND c_pair NOT IN (SELECT c_pair FROM p WHERE day < 46)""",
)
QUERIES["seen_values"] = lambda s, d: G.unseen_rows(_train_test(s, d)[1], _train_test(s, d)[0], "c_pair", seen=True).select("row_id", "c_pair")
SQL["seen_values"] = SQL["unseen_values"].replace("c_pair NOT IN", "c_pair IN")


def _set_ops(s, d):
    a, b = _train_test(s, d)
    return G.common_values(a, b, "c_pair").withColumn("side", F.lit("both")).unionByName(
        G.only_left_values(a, b, "c_pair").withColumn("side", F.lit("left"))
    )


QUERIES["set_ops_on_columns"] = _set_ops
SQL["set_ops_on_columns"] = with_views(
    "imp",
    """p AS (SELECT day, c_k * 24 + c_hour AS c_pair FROM imp),
a AS (SELECT c_pair FROM p WHERE day < 46), b AS (SELECT c_pair FROM p WHERE day >= 46)
SELECT c_pair, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT c_pair, 'left' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)

QUERIES["lookup_map"] = lambda s, d: G.lookup_map(
    ord_(s, d).select("row_id", F.col("c_nation").alias("n_nationkey")), table(s, d, "nation"), "n_nationkey", "n_name", "nation_name"
)
SQL["lookup_map"] = with_views(
    "ord", "SELECT row_id, c_nation AS n_nationkey, n_name AS nation_name FROM ord LEFT JOIN nation ON n_nationkey = c_nation"
)


def _kept_scores(s, d):
    """The score table, written once: ranking reads it several times."""
    return cut_lineage(scores(s, d))


def _rank_pairs(s, d):
    x = _kept_scores(s, d)
    # The reference is shorter than the left side: its last ranks stay NULL.
    return rounded(
        G.rank_pairs(
            x.select("row_id", F.round("light", 9).alias("score")),
            x.where("day < 67").select("row_id", F.round("cat", 9).alias("score")),
            "row_id", "score", "value",
        ),
        9,
    )


QUERIES["rank_pair_join"] = _rank_pairs
SQL["rank_pair_join"] = with_views(
    "scores",
    """a AS (SELECT row_id, round(light, 9) AS score, row_number() OVER (ORDER BY round(light, 9), row_id) AS rank FROM scores),
b AS (SELECT round(cat, 9) AS value, row_number() OVER (ORDER BY round(cat, 9), row_id) AS rank FROM scores WHERE day < 67)
SELECT row_id, rank, score, value FROM a LEFT JOIN b USING (rank)""",
)

_BLEND_SQL = "0.46 * cat + 0.28 * light_hybrid + 0.08 * hist_hybrid + 0.14 * light + 0.04 * hist"
QUERIES["weighted_blend"] = lambda s, d: rounded(H.weighted_blend(scores(s, d)).select("row_id", "score"), 9)
SQL["weighted_blend"] = with_views("scores", f"SELECT row_id, round({_BLEND_SQL}, 9) AS score FROM scores")


def _rerank(s, d):
    x = _kept_scores(s, d)
    light = x.select("row_id", F.round("light", 9).alias("score"))
    cat = x.select("row_id", F.round("cat", 9).alias("score"))
    return rounded(H.rerank(light, cat, "row_id", "score"), 9)


QUERIES["rerank"] = _rerank
SQL["rerank"] = with_views(
    "scores",
    """a AS (SELECT row_id, row_number() OVER (ORDER BY round(light, 9), row_id) AS rank FROM scores),
b AS (SELECT round(cat, 9) AS value, row_number() OVER (ORDER BY round(cat, 9), row_id) AS rank FROM scores)
SELECT row_id, CAST(0.33 AS DOUBLE) AS is_clicked, value AS is_installed FROM a LEFT JOIN b USING (rank)""",
)

QUERIES["piecewise_rescale"] = lambda s, d: rounded(
    scores(s, d).select("row_id", scalar.piecewise_rescale(F.col("cat") * 8 - 1).alias("score")), 9
)
_PIECEWISE_SQL = "(least(greatest({x}, 0.0012233892209209916), 1.0060693574363284) - 0.0012233892209209916) / (1.0060693574363284 - 0.0012233892209209916)"
SQL["piecewise_rescale"] = with_views("scores", f"SELECT row_id, round({_PIECEWISE_SQL.format(x='cat * 8 - 1')}, 9) AS score FROM scores")

QUERIES["submission"] = lambda s, d: rounded(
    H.submission(imp(s, d).where(F.col("day") == LAST_DAY), scores(s, d), "row_id", "cat", clicked=0.11), 9
)
SQL["submission"] = with_views(
    "scores",
    "SELECT row_id AS RowId, CAST(0.11 AS DOUBLE) AS is_clicked, round(cat, 9) AS is_installed FROM imp LEFT JOIN scores USING (row_id) WHERE imp.day = 67",
)


def _cluster_rates(s, d):
    i = imp(s, d).withColumn("cluster", F.col("c_k") % 7 + F.when(F.col("day") > 64, F.lit(1)).otherwise(0))
    rates = H.cluster_rates(i.where(F.col("day") < 63), "cluster", "is_installed")
    val = i.where(F.col("day") >= 63).select("row_id", "cluster")
    return rounded(H.cluster_rate_predict(val, rates, "cluster", weight=0.8), 9)


QUERIES["cluster_rate_predict"] = _cluster_rates
SQL["cluster_rate_predict"] = with_views(
    "imp",
    """i AS (SELECT *, c_k % 7 + CASE WHEN day > 64 THEN 1 ELSE 0 END AS cluster FROM imp),
r AS (SELECT cluster, count(*) AS n, avg(CAST(is_installed AS INTEGER)) AS r FROM i WHERE day < 63 GROUP BY cluster)
SELECT i.cluster, row_id, round(CASE WHEN r IS NULL THEN 0.145
  ELSE least(1, greatest(0, 0.145 + (r - 0.145) * (0.8 * n / (SELECT max(n) FROM r)))) END, 9) AS prediction
FROM i LEFT JOIN r ON r.cluster = i.cluster WHERE day >= 63""",
)

QUERIES["threshold_class"] = lambda s, d: I.long_scores(scores(s, d), list(MODELS), ["row_id"]).groupBy("model").agg(
    F.sum(scalar.threshold_class(F.col("p"), 0.2).cast("long")).alias("positives"), F.count("*").alias("rows")
)
SQL["threshold_class"] = with_views(
    "scores",
    per_column_sql(list(MODELS), "SELECT '{c}' AS model, count(*) FILTER ({c} > 0.2) AS positives, count(*) AS rows FROM scores"),
)

QUERIES["sigmoid_with_offset"] = lambda s, d: rounded(
    imp(s, d).select("row_id", scalar.sigmoid(F.col("n_cnt") / 10 - 2, -1.38).alias("p")), 9
)
SQL["sigmoid_with_offset"] = with_views(
    "imp", "SELECT row_id, round(1 / (1 + exp(-(-1.38 + (n_cnt / 10 - 2)))), 9) AS p FROM imp"
)

_LONG = "m AS (" + per_column_sql(list(MODELS), "SELECT '{c}' AS model, day, CAST(is_installed AS INTEGER) AS y, {c} AS p FROM scores") + ")"
_LL = "-CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END"
# The same rows with every eleventh score and every thirteenth label missing.
_GAPS = "m AS (" + per_column_sql(
    list(MODELS),
    "SELECT '{c}' AS model, day, CASE WHEN row_id % 13 <> 0 THEN CAST(is_installed AS INTEGER) END AS y, CASE WHEN row_id % 11 <> 0 THEN {c} END AS p FROM scores",
) + "), k AS (SELECT * FROM m WHERE y IS NOT NULL AND p IS NOT NULL)"


def _long(s, d):
    return I.long_scores(scores(s, d), list(MODELS), ["day", "is_installed"])


def _with_gaps(s, d):
    long = I.long_scores(scores(s, d), list(MODELS), ["row_id", "day", "is_installed"])
    return long.withColumns(
        {"p": F.when(F.col("row_id") % 11 != 0, F.col("p")), "is_installed": F.when(F.col("row_id") % 13 != 0, F.col("is_installed"))}
    )


QUERIES["log_loss"] = lambda s, d: rounded(I.log_loss(_with_gaps(s, d), "is_installed", "p", ["model", "day"]), 9)
SQL["log_loss"] = with_views(
    "scores", f"{_GAPS} SELECT model, day, count(*) AS rows, round(avg({_LL}), 9) AS log_loss FROM k GROUP BY ALL"
)

QUERIES["normalized_cross_entropy"] = lambda s, d: rounded(
    I.normalized_cross_entropy(_long(s, d), "is_installed", "p", 0.2, ["model"]), 9
)
SQL["normalized_cross_entropy"] = with_views(
    "scores",
    f"""{_LONG} SELECT model, count(*) AS rows, round(avg({_LL}), 9) AS log_loss,
  round(avg({_LL}) / -(0.2 * ln(0.2) + 0.8 * ln(0.8)), 9) AS nce FROM m GROUP BY ALL""",
)

_PT = "CASE WHEN y = 1 THEN p ELSE 1 - p END"
_AT = "CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END"
QUERIES["focal_loss"] = lambda s, d: rounded(I.focal_loss(_with_gaps(s, d), "is_installed", "p", 2.0, 0.25, ["model"]), 9)
SQL["focal_loss"] = with_views(
    "scores",
    f"{_GAPS} SELECT model, count(*) AS rows, round(avg(-({_AT}) * pow(1 - ({_PT}), 2) * ln({_PT})), 9) AS focal_loss FROM k GROUP BY ALL",
)

QUERIES["focal_grad_hess"] = lambda s, d: rounded(
    I.focal_grad_hess(scores(s, d).select("row_id", "is_installed", F.col("cat").alias("p")), "is_installed", "p", 2.0, 0.25).select("row_id", "grad", "hess"), 9
)
SQL["focal_grad_hess"] = with_views(
    "scores",
    """q AS (SELECT row_id, is_installed AS y, cat AS p, 1 - cat AS n FROM scores)
SELECT row_id, round(CASE WHEN y THEN 0.25 * n * n * (2 * p * ln(p) - n) ELSE 0.75 * p * p * (p - 2 * n * ln(n)) END, 9) AS grad,
  round(CASE WHEN y THEN 0.25 * p * n * n * (5 * n + 2 * ln(p) * (1 - 3 * p)) ELSE 0.75 * n * p * p * (5 * p + 2 * ln(n) * (3 * p - 2)) END, 9) AS hess FROM q""",
)

QUERIES["focal_init_score"] = lambda s, d: rounded(I.focal_init_score(imp(s, d), "is_installed", 2.0, 0.25), 9)
SQL["focal_init_score"] = with_views(
    "imp",
    """c AS (SELECT count(*) FILTER (is_installed) AS n1, count(*) FILTER (NOT is_installed) AS n0 FROM imp),
g AS (SELECT i / 1000.0::DOUBLE AS p FROM range(1, 1000) t(i)),
l AS (SELECT p, n1 * 0.25 * pow(1 - p, 2) * -ln(p) + n0 * 0.75 * pow(p, 2) * -ln(1 - p) AS loss FROM g, c)
SELECT p, round(ln(p / (1 - p)), 9) AS init_score FROM l ORDER BY loss, p LIMIT 1""",
)


def _classes(s, d):
    return _long(s, d).withColumn("predicted", scalar.threshold_class(F.col("p"), 0.2))


_CELLS = """count(*) FILTER (y = 0 AND p <= 0.2) AS tn, count(*) FILTER (y = 0 AND p > 0.2) AS fp,
  count(*) FILTER (y = 1 AND p <= 0.2) AS fn, count(*) FILTER (y = 1 AND p > 0.2) AS tp"""
QUERIES["confusion_matrix"] = lambda s, d: I.confusion_matrix(_classes(s, d), "is_installed", "predicted", ["model"])
SQL["confusion_matrix"] = with_views("scores", f"{_LONG} SELECT model, {_CELLS} FROM m GROUP BY model")

QUERIES["accuracy_f1"] = lambda s, d: rounded(
    I.accuracy_f1(I.confusion_matrix(_classes(s, d), "is_installed", "predicted", ["model"])), 9
)
SQL["accuracy_f1"] = with_views(
    "scores",
    f"""{_LONG}, c AS (SELECT model, {_CELLS} FROM m GROUP BY model)
SELECT model, tn, fp, fn, tp, round(100.0 * (tn + tp) / (tn + fp + fn + tp), 9) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM c""",
)

QUERIES["balanced_class_weights"] = lambda s, d: rounded(I.class_weights(table(s, d, "labels"), "quality"), 9)
SQL["balanced_class_weights"] = """SELECT quality, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 9) AS weight FROM labels GROUP BY quality"""


def _multi_label(s, d):
    rows = table(s, d, "labels").select(
        F.array_compact(
            F.array(F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("toxic")))
        ).alias("tags")
    )
    return rounded(I.multi_label_weights(rows, "tags", ["quality", "toxic", "never"]), 9)


QUERIES["multi_label_weights"] = _multi_label
SQL["multi_label_weights"] = union_all(
    "SELECT 'quality' AS label, round(count(*) / (3.0 * sum(quality)), 9) AS weight FROM labels",
    "SELECT 'toxic', round(count(*) / (3.0 * sum(toxic)), 9) FROM labels",
    "SELECT 'never', CAST(1 AS DOUBLE)",
)

QUERIES["class_ratio"] = lambda s, d: rounded(I.class_ratio(imp(s, d), "is_installed"), 9)
SQL["class_ratio"] = with_views(
    "imp", "SELECT round(count(*) FILTER (NOT is_installed) / count(*) FILTER (is_installed), 9) AS ratio FROM imp"
)

_EMB = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"


def _indices(s, d):
    return rounded(I.cluster_indices(table(s, d, "embeddings"), "label", "embedding"), 6)


QUERIES["calinski_harabasz"] = lambda s, d: _indices(s, d).select("clusters", "calinski_harabasz")
QUERIES["davies_bouldin"] = lambda s, d: _indices(s, d).select("clusters", "davies_bouldin")
_INDICES_SQL = f"""WITH {_EMB},
c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM e GROUP BY label, i),
g AS (SELECT i, avg(x) AS m FROM e GROUP BY i),
b AS (SELECT sum(n * pow(c.m - g.m, 2)) AS between_ss FROM c JOIN g USING (i)),
r AS (SELECT e.vec_id, e.label, sum(pow(x - m, 2)) AS sq FROM e JOIN c ON c.label = e.label AND c.i = e.i GROUP BY ALL),
s AS (SELECT label, avg(sqrt(sq)) AS s, sum(sq) AS sq, count(*) AS n FROM r GROUP BY label),
d AS (SELECT a.label AS la, z.label AS lb, sqrt(sum(pow(a.m - z.m, 2))) AS d FROM c a JOIN c z ON a.i = z.i AND a.label <> z.label GROUP BY ALL),
w AS (SELECT la, max((x.s + y.s) / d) AS r FROM d JOIN s x ON x.label = la JOIN s y ON y.label = lb GROUP BY la)
SELECT (SELECT count(*) FROM s) AS clusters,
  round(((SELECT between_ss FROM b) / ((SELECT count(*) FROM s) - 1)) / ((SELECT sum(sq) FROM s) / ((SELECT sum(n) FROM s) - (SELECT count(*) FROM s))), 6) AS calinski_harabasz,
  round((SELECT avg(r) FROM w), 6) AS davies_bouldin"""

SQL["calinski_harabasz"] = f"SELECT clusters, calinski_harabasz FROM ({_INDICES_SQL})"
SQL["davies_bouldin"] = f"SELECT clusters, davies_bouldin FROM ({_INDICES_SQL})"


def _rebuilt(s, d):
    return table(s, d, "embeddings").withColumn(
        "rebuilt", F.transform("embedding", lambda x, i: F.round(x.cast("double"), 1) + i * F.lit(0.001).cast("double"))
    )


QUERIES["cosine_similarity_by_label"] = lambda s, d: rounded(I.cosine_by_label(_rebuilt(s, d), "embedding", "rebuilt", "label"), 9)
SQL["cosine_similarity_by_label"] = f"""WITH {_EMB},
r AS (SELECT *, round(x, 1) + (i - 1) * CAST(0.001 AS DOUBLE) AS y FROM e),
c AS (SELECT vec_id, label, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS c FROM r GROUP BY ALL)
SELECT label, round(avg(c), 9) AS mean_similarity, round(stddev_pop(c), 9) AS std_similarity FROM c GROUP BY label"""

QUERIES["baseline_beaten"] = lambda s, d: I.baseline_beaten(
    I.normalized_cross_entropy(_long(s, d), "is_installed", "p", 0.2, ["model", "day"]), "nce"
)
SQL["baseline_beaten"] = with_views(
    "scores",
    f"""{_LONG}, e AS (SELECT model, day, avg({_LL}) / -(0.2 * ln(0.2) + 0.8 * ln(0.8)) AS nce FROM m GROUP BY ALL)
SELECT count(*) FILTER (nce < 0.9607) AS below, count(*) FILTER (nce > 0.9607) AS above FROM e""",
)


def _report(s, d):
    """Target statistics per day -> blend -> rerank -> rescale -> normalised cross-entropy per day."""
    x = _kept_scores(s, d)
    blended = x.select(
        "row_id", F.round(scalar.blend({"cat": 0.5, "light": 0.3, "hist": 0.2}), 9).alias("score")
    )
    reranked = H.rerank(blended, x.select("row_id", F.round("cat", 9).alias("score")), "row_id", "score")
    final = reranked.select("row_id", scalar.piecewise_rescale(F.col("is_installed")).alias("p"))
    joined = final.join(x.select("row_id", "day", "is_installed"), "row_id")
    return rounded(I.normalized_cross_entropy(joined, "is_installed", "p", 0.2, ["day"]), 9)


QUERIES["prediction_report"] = _report
SQL["prediction_report"] = with_views(
    "scores",
    f"""a AS (SELECT row_id, row_number() OVER (ORDER BY round(0.5 * cat + 0.3 * light + 0.2 * hist, 9), row_id) AS rank FROM scores),
b AS (SELECT round(cat, 9) AS value, row_number() OVER (ORDER BY round(cat, 9), row_id) AS rank FROM scores),
m AS (SELECT day, CAST(is_installed AS INTEGER) AS y, {_PIECEWISE_SQL.format(x='value')} AS p
      FROM a JOIN b USING (rank) JOIN scores USING (row_id))
SELECT day, count(*) AS rows, round(avg({_LL}), 9) AS log_loss, round(avg({_LL}) / -(0.2 * ln(0.2) + 0.8 * ln(0.8)), 9) AS nce FROM m GROUP BY day""",
)
