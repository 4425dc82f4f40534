"""Queries on the signals of large houses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hustings.operators import signalboard
from hustings.registry import Registry
from hustings.sources import houses

REGISTRY = Registry()

HOUSES = """WITH c AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'AE' ELSE 'GE' END AS arena, n_name AS s, 1995 + 2 * ((CAST(year(o_orderdate) AS INTEGER) - 1995) // 2) AS y, CAST(1 + l_orderkey % 40 AS INTEGER) AS n, p_type AS p, CAST(sum(l_quantity) AS BIGINT) AS votes FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
k AS (SELECT *, CASE WHEN arena = 'AE' THEN s ELSE 'all' END AS scope FROM c),
h AS (SELECT arena, scope, s, y, n, p, q, CAST(votes AS DOUBLE) * 100 / total AS v, CAST(votes - qv AS DOUBLE) * 100 / total AS m, CASE n % 5 WHEN 0 THEN 'SC' WHEN 1 THEN 'ST' ELSE 'GEN' END AS r FROM (SELECT *, row_number() OVER w AS rk, lead(p) OVER w AS q, lead(votes) OVER w AS qv, sum(votes) OVER (PARTITION BY arena, s, y, n) AS total FROM k WINDOW w AS (PARTITION BY arena, s, y, n ORDER BY votes DESC, p)) WHERE rk = 1),
act AS (SELECT * FROM h WHERE (arena, y) IN (SELECT (arena, max(y)) FROM h GROUP BY arena)),
won AS (SELECT arena, scope, p, count(*) AS w, sum(count(*)) OVER (PARTITION BY arena, scope) AS size, row_number() OVER (PARTITION BY arena, scope ORDER BY count(*) DESC, p) AS nth, count(*) OVER (PARTITION BY arena, scope) AS parties FROM act GROUP BY arena, scope, p),
pv AS (SELECT arena, scope, y, p, CAST(sum(votes) AS DOUBLE) * 100 / sum(sum(votes)) OVER (PARTITION BY arena, scope, y) AS v FROM k GROUP BY arena, scope, y, p),
led AS (SELECT arena, scope, p, parties, size, w - CAST(size // 2 AS BIGINT) - 1 AS cushion FROM won WHERE nth = 1 AND size >= 30)
"""

BOARD = """, gaps AS (SELECT arena, scope, p, coalesce(w, 0) * 100.0 / (SELECT max(size) FROM won x WHERE x.arena = pv.arena AND x.scope = pv.scope) - v AS gap FROM pv LEFT JOIN won USING (arena, scope, p) WHERE v >= 2 AND (arena, scope, y) IN (SELECT (arena, scope, max(y)) FROM pv GROUP BY arena, scope)),
eff AS (SELECT arena, scope, arg_min(p, (gap, p)) AS party, max(gap) - min(gap) AS d, count(*) AS lines FROM gaps GROUP BY ALL HAVING count(*) >= 2 AND max(gap) - min(gap) >= 8),
thin AS (SELECT *, count(*) OVER (PARTITION BY arena, scope) AS lines, row_number() OVER (PARTITION BY arena, scope ORDER BY t DESC, p) AS nth FROM (SELECT arena, scope, p, count(*) AS w, count(*) FILTER (m < 5) AS t FROM act GROUP BY ALL HAVING count(*) >= 5 AND count(*) FILTER (m < 5) > 0)),
fld AS (SELECT arena, scope, count(*) AS decided, count(*) FILTER (v < 40) AS under FROM act GROUP BY ALL HAVING count(*) >= 30 AND count(*) FILTER (v < 40) >= greatest(4, 0.08 * count(*))),
fp AS (SELECT arena, scope, p, count(*) OVER (PARTITION BY arena, scope) AS lines, row_number() OVER (PARTITION BY arena, scope ORDER BY count(*) DESC, p) AS nth FROM act WHERE v < 40 GROUP BY arena, scope, p),
ero AS (SELECT arena, scope, p, count(*) AS n, sum(count(*)) OVER (PARTITION BY arena, scope) AS whole, count(*) OVER (PARTITION BY arena, scope) AS lines, row_number() OVER (PARTITION BY arena, scope ORDER BY count(*) DESC, p) AS nth FROM (SELECT *, lag(p) OVER w AS p1, lag(p, 2) OVER w AS p2, lag(m) OVER w AS m1, max(y) OVER (PARTITION BY arena, scope) AS last FROM h WINDOW w AS (PARTITION BY arena, s, n ORDER BY y)) WHERE y = last AND p = p1 AND p = p2 AND m < m1 - 5 GROUP BY arena, scope, p),
px AS (SELECT *, dense_rank() OVER (PARTITION BY arena, scope ORDER BY y) AS x FROM pv),
fit AS (SELECT arena, scope, p, regr_slope(v, x) AS slope, regr_r2(v, x) AS r2 FROM px GROUP BY ALL HAVING count(*) >= 3 AND arg_max(v, y) >= 3),
mom AS (SELECT *, count(*) OVER (PARTITION BY arena, scope) AS lines, row_number() OVER (PARTITION BY arena, scope ORDER BY slope DESC, p) AS nth FROM fit),
cat AS (SELECT a.arena, a.scope, won.p, a.r, floor(count(*) FILTER (a.p = won.p) * 100.0 / count(*) + 0.5) AS pct FROM act a JOIN won ON won.arena = a.arena AND won.scope = a.scope AND won.nth = 1 GROUP BY ALL HAVING count(*) >= 8),
sig AS (SELECT arena, scope, 'efficiency' AS signal, 'momentum' AS theme, 'watch' AS severity, party, 60 + least(35, d) AS score, lines FROM eff
UNION ALL SELECT arena, scope, 'thinbook', 'soft', CASE WHEN floor(t * 100.0 / w + 0.5) >= 30 THEN 'critical' ELSE 'watch' END, p, CASE WHEN floor(t * 100.0 / w + 0.5) >= 30 THEN 100 ELSE 60 END + floor(t * 100.0 / w + 0.5), lines FROM thin WHERE nth = 1 AND w >= 10 AND t >= 0.12 * w
UNION ALL SELECT arena, scope, 'divided', 'soft', 'watch', p, 60 + floor(under * 100.0 / decided + 0.5), lines FROM fp JOIN fld USING (arena, scope) WHERE nth = 1
UNION ALL SELECT arena, scope, 'eroding', 'soft', 'watch', p, 60 + 2 * n, lines FROM ero WHERE nth = 1 AND n >= 3
UNION ALL SELECT arena, scope, 'tipping', 'control', CASE WHEN cushion BETWEEN 0 AND greatest(3, 0.03 * size) THEN 'critical' ELSE 'note' END, p, CASE WHEN cushion BETWEEN 0 AND greatest(3, 0.03 * size) THEN 110 WHEN cushion >= 0 THEN 40 ELSE 50 END, parties FROM led
UNION ALL SELECT arena, scope, 'momentum', 'momentum', 'note', p, 30 + least(25, slope * 5), lines FROM mom WHERE nth = 1 AND lines >= 2 AND slope >= 1 AND r2 >= 0.5
UNION ALL SELECT arena, scope, 'reservation', 'coalition', 'note', p, 30 + (max(pct) - min(pct)) / 4, count(*) FROM cat GROUP BY arena, scope, p HAVING count(*) >= 2 AND max(pct) - min(pct) >= 25)
SELECT arena, scope, signal, theme, severity, party, round(CAST(score AS DOUBLE), 6) AS score, lines, row_number() OVER (PARTITION BY arena, scope ORDER BY round(CAST(score AS DOUBLE), 6) DESC, signal) AS place, greatest(0, lines - 8) AS more FROM sig"""


def board_of_houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = houses.candidates(spark, sf_dir).persist()  # small beside order lines, and read by every signal
    history = houses.history(cand)
    return signalboard.signal_board(houses.active(history), history, houses.parties(cand, history))


REGISTRY.add("signals_of_houses", board_of_houses, HOUSES + BOARD)
REGISTRY.add("seats_a_house_turns_on", lambda spark, d: signalboard.turning_seats(houses.active(houses.history(houses.candidates(spark, d)))), HOUSES + "SELECT arena, scope, leader, cushion, nth, s, n, p, q, round(m, 6) AS m FROM (SELECT a.arena, a.scope, l.p AS leader, l.cushion, row_number() OVER (PARTITION BY a.arena, a.scope ORDER BY a.m, a.s, a.n) AS nth, a.s, a.n, a.p, a.q, a.m FROM act a JOIN led l USING (arena, scope) WHERE a.m IS NOT NULL AND CASE WHEN l.cushion >= 0 THEN a.p = l.p ELSE a.q = l.p END) WHERE nth <= abs(cushion) + 4")
