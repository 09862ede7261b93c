"""Registered queries: the two feature builds."""

from pyspark.sql import functions as F

from dayglass.plans.features import cluster_features, nn_features
from dayglass.roles import Roles
from dayglass.sources.fixtures import IMP, LAST_DAY, SPLIT_DAY, imp, with_views
from dayglass.checks.helpers import rounded

QUERIES, SQL = {}, {}

_ROLES = Roles(
    row_id="row_id", day="day", categorical=("c_user", "c_k"), binary=IMP.binary, counter=IMP.counter, numeric=IMP.numeric
)


def _nn(s, d):
    rows = imp(s, d)
    built = nn_features(rows.where(F.col("day") < LAST_DAY), rows.where(F.col("day") >= LAST_DAY), _ROLES, SPLIT_DAY)
    return rounded(built, 6)


QUERIES["nn_features"] = _nn


def _align(c: str) -> str:
    return f"""b_{c} AS (SELECT {c} AS v, count(*) AS n FROM r WHERE split = 'train' AND {c} IN (SELECT {c} FROM r WHERE split = 'val') GROUP BY {c}),
m_{c} AS (SELECT coalesce((SELECT v FROM b_{c} ORDER BY n DESC, v LIMIT 1), -1) AS m)"""


def _stats(c: str, source: str) -> str:
    return f"t_{c} AS (SELECT {c} AS v, count(*) AS n, sum(y) AS s FROM {source} WHERE split = 'train' GROUP BY {c})"


_ALIGNED = """al AS (SELECT r.* REPLACE (
    CASE split WHEN 'test' THEN r.c_user WHEN 'train' THEN coalesce(bu.v, -1) ELSE coalesce(bu.v, mu.m) END AS c_user,
    CASE split WHEN 'test' THEN r.c_k WHEN 'train' THEN coalesce(bk.v, -1) ELSE coalesce(bk.v, mk.m) END AS c_k)
  FROM r LEFT JOIN b_c_user bu ON bu.v = r.c_user LEFT JOIN b_c_k bk ON bk.v = r.c_k, m_c_user mu, m_c_k mk)"""
_D5 = "CASE WHEN {t}.n > 1 THEN ({t}.s + p) / ({t}.n + 1) ELSE p END"

SQL["nn_features"] = with_views(
    "imp",
    f"""r AS (SELECT *, CAST(is_installed AS INTEGER) AS y, CASE WHEN day < 63 THEN 'train' WHEN day < 67 THEN 'val' ELSE 'test' END AS split FROM imp),
{_align('c_user')}, {_align('c_k')}, {_ALIGNED},
{_stats('c_user', 'al')}, {_stats('c_k', 'al')},
p AS (SELECT avg(y) AS p FROM r WHERE split = 'train'),
s AS (SELECT avg(n_cnt) AS mc, stddev_samp(n_cnt) AS sc, avg(n_val) AS mv, stddev_samp(n_val) AS sv FROM r WHERE split = 'train'),
f AS (SELECT r.row_id, split, coalesce(n_cnt, mc) AS c, coalesce(n_val, mv) AS v, abs(coalesce(n_cnt, mc) - mc) / sc AS dc, abs(coalesce(n_val, mv) - mv) / sv AS dv FROM r, s),
o AS (SELECT split, floor(count(*) * 0.001) AS l, avg(c) AS ac, avg(v) AS av FROM f GROUP BY split),
k AS (SELECT f.*, row_number() OVER (PARTITION BY split, dc > 4 ORDER BY dc DESC, row_id) AS rc, row_number() OVER (PARTITION BY split, dv > 4 ORDER BY dv DESC, row_id) AS rv FROM f),
x AS (SELECT row_id, k.split, CASE WHEN dc > 4 AND rc <= l THEN ac ELSE c END AS c, CASE WHEN dv > 4 AND rv <= l THEN av ELSE v END AS v FROM k JOIN o ON o.split = k.split),
g AS (SELECT row_id, split, CASE WHEN c > 0 THEN ln(c) ELSE c END AS c, v FROM x),
q AS (SELECT min(c) AS lo, max(c) AS hi, avg(v) AS m, stddev_pop(v) AS sd FROM g WHERE split = 'train'),
z AS (SELECT row_id, split, (c - lo) / (hi - lo) AS c, (v - m) / sd AS v FROM g, q),
w AS (SELECT min(v) AS lo, max(v) AS hi FROM z WHERE split = 'train')
SELECT al.row_id, al.split, round({_D5.format(t='tu')}, 6) AS c_user, round({_D5.format(t='tk')}, 6) AS c_k,
  CAST(b_even AS INTEGER) AS b_even, CAST(b_pm AS INTEGER) AS b_pm, CAST(b_high AS INTEGER) AS b_high,
  CASE WHEN al.split <> 'test' THEN y END AS is_installed, round(z.c, 6) AS n_cnt, round((z.v - lo) / (hi - lo), 6) AS n_val
FROM al JOIN z USING (row_id) LEFT JOIN t_c_user tu ON tu.v = al.c_user LEFT JOIN t_c_k tk ON tk.v = al.c_k, p, w""",
)


def _cluster(s, d):
    rows = imp(s, d)
    built = cluster_features(rows.where(F.col("day") < SPLIT_DAY), rows.where(F.col("day") >= SPLIT_DAY), _ROLES)
    return rounded(built, 6)


QUERIES["cluster_features"] = _cluster
SQL["cluster_features"] = with_views(
    "imp",
    f"""r AS (SELECT *, CAST(is_installed AS INTEGER) AS y, CASE WHEN day < 63 THEN 'train' ELSE 'val' END AS split FROM imp),
{_align('c_user')}, {_align('c_k')}, {_ALIGNED},
{_stats('c_user', 'al')}, {_stats('c_k', 'al')},
p AS (SELECT avg(y) AS p FROM r WHERE split = 'train'),
dv AS (SELECT DISTINCT n_cnt AS x FROM r WHERE split = 'train'),
st AS (SELECT min(x) AS lo, min(gap) AS step FROM (SELECT x, x - lag(x) OVER (ORDER BY x) AS gap FROM dv)),
c AS (SELECT row_id, ln((n_cnt - lo) / step + 0.5) AS c FROM r, st),
s AS (SELECT avg(n_val) AS mv, stddev_samp(n_val) AS sv FROM r WHERE split = 'train'),
f AS (SELECT row_id, split, n_val AS v, abs(n_val - mv) / sv AS dv FROM r, s),
o AS (SELECT split, floor(count(*) * 0.001) AS l, avg(v) AS av FROM f GROUP BY split),
k AS (SELECT f.*, row_number() OVER (PARTITION BY split, coalesce(dv > 4, false) ORDER BY dv DESC, row_id) AS rv FROM f),
x AS (SELECT row_id, k.split, CASE WHEN dv > 4 AND rv <= l THEN av ELSE v END AS v FROM k JOIN o ON o.split = k.split),
q AS (SELECT avg(v) AS m, stddev_samp(v) AS sd FROM x WHERE split = 'train'),
wu AS (SELECT row_id, count(*) OVER e AS n, coalesce(sum(y) OVER e, 0) AS s FROM al WHERE split = 'train'
       WINDOW e AS (PARTITION BY c_user ORDER BY day, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wk AS (SELECT row_id, count(*) OVER e AS n, coalesce(sum(y) OVER e, 0) AS s FROM al WHERE split = 'train'
       WINDOW e AS (PARTITION BY c_k ORDER BY day, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT al.row_id, al.day, al.split, y AS is_installed,
  round(CASE WHEN al.split = 'train' THEN (wu.s + p) / (wu.n + 1) ELSE {_D5.format(t='tu')} END, 6) AS c_user,
  round(CASE WHEN al.split = 'train' THEN (wk.s + p) / (wk.n + 1) ELSE {_D5.format(t='tk')} END, 6) AS c_k,
  CAST(b_even AS INTEGER) AS b_even, CAST(b_pm AS INTEGER) AS b_pm, CAST(b_high AS INTEGER) AS b_high,
  round(sin(2 * pi() * (al.day % 7) / 7), 6) AS sin_date, round(cos(2 * pi() * (al.day % 7) / 7), 6) AS cos_date,
  round(c.c, 6) AS n_cnt, round(coalesce((x.v - m) / sd, 0), 6) AS n_val
FROM al JOIN c USING (row_id) JOIN x USING (row_id) LEFT JOIN wu USING (row_id) LEFT JOIN wk USING (row_id)
LEFT JOIN t_c_user tu ON tu.v = al.c_user LEFT JOIN t_c_k tk ON tk.v = al.c_k, p, q""",
)
