"""Registered queries: model jobs that have an exact SQL twin, and those checked by properties only."""

from pyspark.sql import functions as F

from dayglass.operators import boosting, centres, dbscan, neighbours, scaling, trials
from dayglass.operators import encoders as D
from dayglass.sources.fixtures import LAST_DAY, SPLIT_DAY, imp, ord_, scores, table, with_views
from dayglass.checks.helpers import rounded

QUERIES, SQL = {}, {}

QUERIES["oof_scores"] = lambda s, d: rounded(scores(s, d).where(F.col("day") < LAST_DAY).select("row_id", "light", "hist"), 9)
SQL["oof_scores"] = with_views("scores", "SELECT row_id, round(light, 9) AS light, round(hist, 9) AS hist FROM scores WHERE day < 67")

_K, _ROUNDS = 4, 3


def _kmeans(s, d):
    rows = table(s, d, "embeddings").withColumn("positive", F.col("label") == 3)
    return rounded(centres.kmeans(rows, "vec_id", "embedding", _K, _ROUNDS, "positive", 5.0)[0], 6)


QUERIES["kmeans_weighted"] = _kmeans


def _kmeans_sql() -> str:
    parts = [
        """e AS (SELECT vec_id, CASE WHEN label = 3 THEN 5.0::DOUBLE ELSE 1.0 END AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)""",
        f"""c0 AS (SELECT CAST(dense_rank() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cluster, i, x AS m FROM e
  WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT {_K}))""",
    ]
    for r in range(_ROUNDS + 1):
        parts.append(f"""d{r} AS (SELECT vec_id, cluster, sum((x - m) * (x - m)) AS sq FROM e JOIN c{r} USING (i) GROUP BY ALL)""")
        parts.append(f"""a{r} AS (SELECT vec_id, cluster, sq FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sq, cluster) = 1)""")
        if r < _ROUNDS:
            parts.append(f"""n{r} AS (SELECT cluster, i, sum(w * x) / sum(w) AS m FROM e JOIN a{r} USING (vec_id) GROUP BY ALL)""")
            parts.append(f"""c{r + 1} AS (SELECT c{r}.cluster, c{r}.i, coalesce(n{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN n{r} ON n{r}.cluster = c{r}.cluster AND n{r}.i = c{r}.i)""")
    return "WITH " + ",\n".join(parts) + f" SELECT vec_id, cluster, round(sqrt(sq), 6) AS distance FROM a{_ROUNDS}"


SQL["kmeans_weighted"] = _kmeans_sql()

_SEED_ROUNDS, _OVER = 2, 8


def _seeding(s, d):
    rows = table(s, d, "embeddings").withColumn("positive", F.col("label") == 3)
    found = centres.seed_centres(rows, "vec_id", "embedding", _K, "positive", 5.0, rounds=_SEED_ROUNDS, oversampling=_OVER)
    return s.createDataFrame([(i, j, x) for i, c in enumerate(found) for j, x in enumerate(c)], "centre int, axis int, x double")


QUERIES["kmeans_seeding"] = _seeding


def _seeding_sql() -> str:
    def draw(seed):
        return f"((CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)"

    nearest = "(SELECT min(list_distance(r.x, c.x) ** 2) FROM {c} c)"
    parts = [
        "r AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label = 3 THEN 5.0::DOUBLE ELSE 1.0 END AS w FROM embeddings)",
        f"s0 AS (SELECT id, x FROM r ORDER BY {draw(1)}, id LIMIT 1)",
    ]
    for i in range(1, _SEED_ROUNDS + 1):
        parts += [
            f"e{i} AS (SELECT r.id, r.x, w * min(list_distance(r.x, c.x) ** 2) AS cost FROM r, s{i - 1} c GROUP BY r.id, r.x, w)",
            f"s{i} AS (SELECT id, x FROM s{i - 1} UNION SELECT id, x FROM e{i} WHERE {draw(1 + i)} * (SELECT sum(cost) FROM e{i}) < {_OVER} * cost)",
        ]
    parts += [
        f"""near AS (SELECT r.id, w, c.id AS at FROM r, s{_SEED_ROUNDS} c
  QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY list_distance(r.x, c.x), c.id) = 1)""",
        f"c AS (SELECT s.id, s.x, sum(w) AS w FROM s{_SEED_ROUNDS} s JOIN near ON near.at = s.id GROUP BY s.id, s.x)",
        f"k0 AS (SELECT id, x, 0 AS n FROM c ORDER BY -ln({draw(_SEED_ROUNDS + 2)}) / w LIMIT 1)",
    ]
    for turn in range(1, _K):
        parts.append(
            f"""k{turn} AS (SELECT * FROM k{turn - 1} UNION ALL (SELECT id, x, {turn} AS n FROM (
  SELECT c.id, c.x, w * min(list_distance(c.x, k.x) ** 2) AS chance FROM c, k{turn - 1} k GROUP BY c.id, c.x, w)
  WHERE chance > 0 ORDER BY -ln({draw(_SEED_ROUNDS + 2 + turn)}) / chance LIMIT 1))"""
        )
    last = f"k{_K - 1}"
    return "WITH " + ",\n".join(parts) + f" SELECT n AS centre, CAST(i - 1 AS INTEGER) AS axis, x[i] AS x FROM {last}, unnest(range(1, len(x) + 1)) AS u(i)"


SQL["kmeans_seeding"] = _seeding_sql()

_CATS, _NUMS = ["c_segment", "c_priority", "c_nation"], ["n_total", "n_bal"]


def _kmodes(by_frequency):
    return lambda s, d: rounded(
        centres.kmodes(ord_(s, d).select("row_id", *_CATS), "row_id", _CATS, 4, 2, by_frequency)[0], 6
    )


QUERIES["kmodes"], QUERIES["kmodes_by_frequency"] = _kmodes(False), _kmodes(True)


def _prototypes(s, d):
    rows = ord_(s, d).select("row_id", *_CATS, *_NUMS)
    rows = scaling.apply_spread(rows, _NUMS, scaling.fit_zscore(rows, _NUMS))
    return rounded(centres.kprototypes(rows, "row_id", _CATS, _NUMS, 4, 2, gamma=0.5)[0], 6)


QUERIES["kprototypes"] = _prototypes


def _mixed_sql(nums: list[str], gamma: float, by_frequency: bool) -> str:
    rows = "r AS (SELECT row_id, " + ", ".join(_CATS)
    rows += "".join(f", ({c} - (SELECT avg({c}) FROM ord)) / (SELECT stddev_samp({c}) FROM ord) AS {c}" for c in nums) + " FROM ord)"
    parts = [
        rows,
        "c0 AS (SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS INTEGER) AS cluster, "
        + ", ".join(f"{c} AS m_{c}" for c in _CATS + nums)
        + "".join(f", 1.0::DOUBLE AS f_{c}" for c in _CATS)
        + " FROM (SELECT * FROM r ORDER BY row_id LIMIT 4))",
    ]
    for i in range(3):
        match = "(1 - f_{c})" if by_frequency else "0"
        cost = " + ".join(f"{gamma} * CASE WHEN {c} = m_{c} THEN {match.format(c=c)} ELSE 1 END" for c in _CATS)
        cost += "".join(f" + ({c} - m_{c}) * ({c} - m_{c})" for c in nums)
        parts.append(
            f"""a{i} AS (SELECT r.*, cluster, round({cost}, 9) AS cost FROM r, c{i}
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round({cost}, 9), cluster) = 1)"""
        )
        if i < 2:
            for c in _CATS:
                parts.append(
                    f"""t{i}_{c} AS (SELECT cluster, {c} AS m, n::DOUBLE / s AS f FROM (
  SELECT cluster, {c}, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster) AS s FROM a{i} GROUP BY cluster, {c})
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, {c}) = 1)"""
                )
            means = "".join(f", avg({c}) AS {c}" for c in nums)
            parts.append(f"u{i} AS (SELECT cluster{means} FROM a{i} GROUP BY cluster)")
            parts.append(
                f"c{i + 1} AS (SELECT c{i}.cluster, "
                + ", ".join(f"coalesce(t{i}_{c}.m, m_{c}) AS m_{c}" for c in _CATS)
                + "".join(f", coalesce(u{i}.{c}, m_{c}) AS m_{c}" for c in nums)
                + "".join(f", coalesce(t{i}_{c}.f, f_{c}) AS f_{c}" for c in _CATS)
                + f" FROM c{i} LEFT JOIN u{i} ON u{i}.cluster = c{i}.cluster"
                + "".join(f" LEFT JOIN t{i}_{c} ON t{i}_{c}.cluster = c{i}.cluster" for c in _CATS)
                + ")"
            )
    return with_views("ord", ",\n".join(parts) + " SELECT row_id, cluster, CAST(round(cost, 6) AS DOUBLE) AS cost FROM a2")


SQL["kmodes"], SQL["kmodes_by_frequency"] = _mixed_sql([], 1.0, False), _mixed_sql([], 1.0, True)
SQL["kprototypes"] = _mixed_sql(_NUMS, 0.5, False)


def _points(s, d):
    return imp(s, d).select(
        "row_id", "day", "is_installed", (F.col("c_k") / 100).alias("x"), (F.col("c_hour") / 24).alias("y"),
        (F.coalesce("n_val", F.lit(0.0)) / 100).alias("z"),
    )


_POINTS_SQL = "pt AS (SELECT row_id, day, CAST(is_installed AS INTEGER) AS l, c_k / 100.0::DOUBLE AS x, c_hour / 24.0::DOUBLE AS y, coalesce(n_val, 0) / 100 AS z FROM imp)"


def _knn(weights, metric):
    def query(s, d):
        rows = _points(s, d)
        train, val = rows.where(F.col("day") < SPLIT_DAY), rows.where(F.col("day") >= SPLIT_DAY)
        return rounded(neighbours.knn_regress(train, val, "row_id", ["x", "y", "z"], "is_installed", 5, weights, metric), 6)

    return query


def _knn_sql(weights, metric):
    distance = {
        "euclidean": "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)",
        "manhattan": "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z)",
        "cosine": "1 - (a.x * b.x + a.y * b.y + a.z * b.z) / (sqrt(a.x ** 2 + a.y ** 2 + a.z ** 2) * sqrt(b.x ** 2 + b.y ** 2 + b.z ** 2))",
    }[metric]
    value = "avg(l)" if weights == "uniform" else (
        "coalesce(avg(l) FILTER (d = 0), sum(l / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0))"
    )
    return with_views(
        "imp",
        f"""{_POINTS_SQL},
n AS (SELECT a.row_id, b.l, round({distance}, 9) AS d FROM pt a, pt b WHERE a.day >= 63 AND b.day < 63
      QUALIFY row_number() OVER (PARTITION BY a.row_id ORDER BY round({distance}, 9), b.row_id) <= 5)
SELECT row_id, round({value}, 6) AS prediction FROM n GROUP BY row_id""",
    )


for _w, _m in (("uniform", "euclidean"), ("distance", "manhattan"), ("uniform", "cosine")):
    _name = "knn_regress" if _m == "euclidean" else f"knn_regress_{_m}"
    QUERIES[_name], SQL[_name] = _knn(_w, _m), _knn_sql(_w, _m)


def _dbscan(s, d):
    rows = table(s, d, "events").select(
        "event_id", (F.col("value") / 100).alias("x"), (F.get_json_object("props", "$.k").cast("int") / 100).alias("y")
    )
    return dbscan.dbscan(rows, "event_id", ["x", "y"], eps=0.0157, min_samples=5)


QUERIES["dbscan"] = _dbscan
SQL["dbscan"] = """WITH RECURSIVE p AS (SELECT event_id AS id, value / 100 AS x, CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS y FROM events),
g AS (SELECT *, CAST(floor(x / 0.0157) AS BIGINT) AS cx, CAST(floor(y / 0.0157) AS BIGINT) AS cy FROM p),
o AS (SELECT a.v AS ox, b.v AS oy FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v)),
q AS (SELECT id, x, y, cx + ox AS cx, cy + oy AS cy FROM g, o),
e AS MATERIALIZED (SELECT q.id AS a, g.id AS b FROM q JOIN g ON g.cx = q.cx AND g.cy = q.cy WHERE sqrt((q.x - g.x) ** 2 + (q.y - g.y) ** 2) <= 0.0157),
core AS MATERIALIZED (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 5),
ce AS MATERIALIZED (SELECT a, b FROM e WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
cc(id, label) USING KEY (id) AS (
  SELECT id, id AS label FROM core
  UNION
  SELECT n.id, n.label FROM (SELECT ce.b AS id, min(cc.label) AS label FROM cc JOIN ce ON ce.a = cc.id GROUP BY ce.b) n
  JOIN recurring.cc old ON old.id = n.id WHERE n.label < old.label),
bd AS (SELECT e.a AS id, min(cc.label) AS label FROM e JOIN cc ON cc.id = e.b WHERE e.a NOT IN (SELECT id FROM core) GROUP BY e.a)
SELECT p.id AS event_id, coalesce(cc.label, bd.label, -1) AS cluster FROM p LEFT JOIN cc ON cc.id = p.id LEFT JOIN bd ON bd.id = p.id"""


_AXES, _EPS = 6, 0.135


def _dbscan_axes(s, d):
    rows = table(s, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(_AXES)])
    return dbscan.dbscan(rows, "vec_id", [f"x{i}" for i in range(_AXES)], eps=_EPS, min_samples=3)


QUERIES["dbscan_six_axes"] = _dbscan_axes
SQL["dbscan_six_axes"] = f"""WITH RECURSIVE p AS (SELECT vec_id AS id, {", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(_AXES))} FROM embeddings),
e AS MATERIALIZED (SELECT q.id AS a, g.id AS b FROM p q, p g WHERE sqrt({" + ".join(f"(q.x{i} - g.x{i}) ** 2" for i in range(_AXES))}) <= {_EPS}),
core AS MATERIALIZED (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 3),
ce AS MATERIALIZED (SELECT a, b FROM e WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
cc(id, label) USING KEY (id) AS (
  SELECT id, id AS label FROM core
  UNION
  SELECT n.id, n.label FROM (SELECT ce.b AS id, min(cc.label) AS label FROM cc JOIN ce ON ce.a = cc.id GROUP BY ce.b) n
  JOIN recurring.cc old ON old.id = n.id WHERE n.label < old.label),
bd AS (SELECT e.a AS id, min(cc.label) AS label FROM e JOIN cc ON cc.id = e.b WHERE e.a NOT IN (SELECT id FROM core) GROUP BY e.a)
SELECT p.id AS vec_id, coalesce(cc.label, bd.label, -1) AS cluster FROM p LEFT JOIN cc ON cc.id = p.id LEFT JOIN bd ON bd.id = p.id"""


_BOOST = boosting.BoostParams(bins=16, depth=2, learning_rate=0.3, l2=1.0, min_rows=50, gamma=2.0, alpha=0.25)
_FEATURES = ["n_cnt", "n_val", "c_hour"]


def _boosting(s, d):
    rows = imp(s, d).select("row_id", "is_installed", *_FEATURES)
    state = boosting.start_state(rows, "row_id", _FEATURES, "is_installed", _BOOST, -0.5)
    scored, levels, leaves = boosting.boosting_round(state, _FEATURES, "is_installed", _BOOST)
    return rounded(scored.select("row_id", F.col("node").cast("int").alias("node"), "raw"), 9)


QUERIES["histogram_boosting_round"] = _boosting


def _boosting_sql() -> str:
    def bin_sql(c):
        return f"CASE WHEN {c} IS NULL THEN 0 ELSE greatest(1, least(16, 1 + floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * 16))) END"

    limits = ", ".join(f"min({c})::DOUBLE AS lo_{c}, max({c})::DOUBLE AS hi_{c}" for c in _FEATURES)
    parts = [
        f"lim AS (SELECT {limits} FROM imp)",
        "r0 AS (SELECT row_id, CAST(is_installed AS INTEGER) AS y, 1 / (1 + exp(0.5)) AS p, "
        + ", ".join(f"CAST({bin_sql(c)} AS INTEGER) AS bin_{c}" for c in _FEATURES)
        + " FROM imp, lim)",
        """n0 AS (SELECT row_id, 1 AS node, """
        + ", ".join(f"bin_{c}" for c in _FEATURES)
        + """, CASE WHEN y = 1 THEN 0.25 * (1 - p) ** 2 * (2 * p * ln(p) - (1 - p)) ELSE 0.75 * p * p * (p - 2 * (1 - p) * ln(1 - p)) END AS g,
  CASE WHEN y = 1 THEN 0.25 * p * (1 - p) ** 2 * (5 * (1 - p) + 2 * ln(p) * (1 - 3 * p)) ELSE 0.75 * (1 - p) * p * p * (5 * p + 2 * ln(1 - p) * (3 * p - 2)) END AS h FROM r0)""",
    ]
    for i in range(2):
        long = " UNION ALL ".join(f"SELECT node, '{c}' AS f, bin_{c} AS b, g, h FROM n{i}" for c in _FEATURES)
        parts.append(f"l{i} AS (SELECT node, f, b, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({long}) GROUP BY ALL)")
        cum = ", ".join(f"sum({x}) OVER (PARTITION BY node, f ORDER BY b) AS {x}l, sum({x}) OVER (PARTITION BY node, f) AS {x}a" for x in "ghn")
        parts.append(f"s{i} AS (SELECT node, f, b, {cum} FROM l{i})")
        parts.append(
            f"""b{i} AS (SELECT node, f, b FROM (SELECT node, f, b, round(gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1), 9) AS gain
  FROM s{i} WHERE nl >= 50 AND na - nl >= 50) QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1)"""
        )
        value = " ".join(f"WHEN '{c}' THEN bin_{c}" for c in _FEATURES)
        parts.append(
            f"n{i + 1} AS (SELECT row_id, n.node * 2 + CASE WHEN CASE s.f {value} END > s.b THEN 1 ELSE 0 END AS node, "
            + ", ".join(f"bin_{c}" for c in _FEATURES)
            + f", g, h FROM n{i} n LEFT JOIN b{i} s ON s.node = n.node)"
        )
    parts.append("v AS (SELECT node, -0.3 * sum(g) / (sum(h) + 1) AS v FROM n2 GROUP BY node)")
    return with_views("imp", ",\n".join(parts) + " SELECT row_id, CAST(n2.node AS INTEGER) AS node, round(-0.5 + v, 9) AS raw FROM n2 JOIN v ON v.node = n2.node")


SQL["histogram_boosting_round"] = _boosting_sql()


def _trials(s, d):
    """One trial per customer: two objectives taken from its orders."""
    return ord_(s, d).groupBy(F.col("c_cust").alias("trial")).agg(
        F.round(F.avg("n_total"), 2).alias("davies_bouldin"), F.count("*").cast("double").alias("calinski_harabasz")
    )


_TRIALS_SQL = "tr AS (SELECT c_cust AS trial, round(avg(n_total), 2) AS davies_bouldin, CAST(count(*) AS DOUBLE) AS calinski_harabasz FROM ord GROUP BY c_cust)"
QUERIES["best_trials"] = lambda s, d: trials.pareto_front(_trials(s, d), "davies_bouldin", "calinski_harabasz")
SQL["best_trials"] = with_views(
    "ord",
    _TRIALS_SQL
    + """ SELECT * FROM tr a WHERE NOT EXISTS (SELECT 1 FROM tr b WHERE b.davies_bouldin <= a.davies_bouldin AND b.calinski_harabasz >= a.calinski_harabasz
  AND (b.davies_bouldin < a.davies_bouldin OR b.calinski_harabasz > a.calinski_harabasz))""",
)
QUERIES["best_trial"] = lambda s, d: trials.best_trial(_trials(s, d), "davies_bouldin", "trial")
SQL["best_trial"] = with_views("ord", _TRIALS_SQL + " SELECT * FROM tr ORDER BY davies_bouldin, trial LIMIT 1")
