"""The DuckDB SQL that all queries on contests begin with."""

#: What the SQL of all queries begins with: the same tables, told anew.
PREFIX = """WITH lines AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'AE' ELSE 'GE' END AS arena, n_name AS s, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(1 + c_custkey % 6 AS INTEGER) AS n, p_type AS p, o_orderpriority = '1-URGENT' AS urgent, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
cand AS (SELECT arena, s, y, n, p, CAST(sum(quantity) AS BIGINT) AS votes FROM lines GROUP BY ALL),
bycand AS (SELECT arena, s, y, n, p, CAST(sum(quantity) AS BIGINT) AS votes FROM lines WHERE urgent AND n <= 3 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER w AS rank, lead(p) OVER w AS q, lead(votes) OVER w AS qv, first_value(votes) OVER w AS top, CAST(sum(votes) OVER (PARTITION BY arena, s, y, n) AS BIGINT) AS total, CAST(votes AS DOUBLE) * 100 / sum(votes) OVER (PARTITION BY arena, s, y, n) AS share FROM cand WINDOW w AS (PARTITION BY arena, s, y, n ORDER BY votes DESC, p)),
bysums AS (SELECT *, row_number() OVER w AS rank, lead(p) OVER w AS q, lead(votes) OVER w AS qv, CAST(sum(votes) OVER (PARTITION BY arena, s, y, n) AS BIGINT) AS total FROM bycand WINDOW w AS (PARTITION BY arena, s, y, n ORDER BY votes DESC, p)),
seats AS (SELECT arena, s, y, n, p, share AS v, q, CAST(votes - qv AS DOUBLE) * 100 / total AS m, total, votes AS wv,
  CASE WHEN arena = 'AE' AND s IN ('NATION_3', 'NATION_7') AND y >= 1998 THEN n + 119 ELSE n END AS j, s || '-' || n AS c, CASE WHEN n <= 2 THEN 'SC' WHEN n = 3 THEN 'ST' ELSE 'GEN' END AS r,
  CASE WHEN p IN ('STANDARD', 'ECONOMY') THEN 'A Alliance (X)' WHEN p IN ('MEDIUM', 'PROMO') THEN 'B Alliance (Y)' ELSE 'Unaligned' END AS a, CAST(50 + total % 40 AS DOUBLE) AS t FROM ranked WHERE rank = 1),
prev AS (SELECT *, CASE WHEN prev_y IS NULL THEN 'no-previous' WHEN arena = 'AE' AND s IN ('NATION_5', 'NATION_9') AND (prev_y < 1998) <> (y < 1998) THEN 'not-comparable' WHEN prev_p = p THEN 'held' ELSE 'flipped' END AS status
  FROM (SELECT *, lag(y) OVER w AS prev_y, lag(p) OVER w AS prev_p, lag(m) OVER w AS prev_m FROM seats WINDOW w AS (PARTITION BY arena, s, j ORDER BY y))),
act AS (SELECT * FROM seats WHERE y <= 2000 QUALIFY y = max(y) OVER (PARTITION BY arena, s)),
chg AS (SELECT * FROM prev WHERE y <= 2000 QUALIFY y = max(y) OVER (PARTITION BY arena, s)),
comp AS (SELECT * FROM chg WHERE status IN ('held', 'flipped')),
summ AS (SELECT arena, s, y, p, count(DISTINCT n) AS f, count(*) FILTER (rank = 1) AS wo, CAST(sum(votes) AS BIGINT) AS votes, CAST(sum(votes) AS DOUBLE) * 100 / sum(sum(votes)) OVER (PARTITION BY arena, s, y) AS v FROM ranked GROUP BY arena, s, y, p),
nat AS (SELECT arena, y, p, CAST(sum(f) AS BIGINT) AS f, CAST(sum(wo) AS BIGINT) AS wo, CAST(sum(votes) AS BIGINT) AS votes, CAST(sum(votes) AS DOUBLE) * 100 / sum(sum(votes)) OVER (PARTITION BY arena, y) AS v FROM summ GROUP BY arena, y, p),
byp AS (SELECT b.arena, b.s, b.y, b.n, b.p, x.p AS prev, CASE WHEN x.p IS NULL THEN NULL WHEN x.p = b.p THEN 'Y' ELSE 'N' END AS ret, 1 + b.n % 12 AS mo FROM bysums b LEFT JOIN seats x ON b.arena = x.arena AND b.s = x.s AND b.y = x.y AND b.n = x.n WHERE b.rank = 1),
roles AS (SELECT arena, s, j, m, p, 'won' AS role FROM act UNION ALL SELECT arena, s, j, m, q, 'second' FROM act WHERE q IS NOT NULL),
house AS (SELECT arena, CAST(floor(count(*) / 2) AS BIGINT) + 1 AS majority FROM act GROUP BY ALL),
par AS (SELECT n_name AS s, r_name AS pc FROM nation JOIN region ON n_regionkey = r_regionkey),
el AS (SELECT *, CAST(floor(e * 0.52) AS BIGINT) AS men, e - CAST(floor(e * 0.52) AS BIGINT) - CASE WHEN n = 4 THEN 200 ELSE 0 END AS women FROM (SELECT arena, s, y, n, j, total * 2 + CASE WHEN n = 6 THEN 0 ELSE n * 10 END AS e, total * CASE WHEN n = 5 THEN 3 ELSE 1 END AS voters FROM seats)),
wins AS (SELECT arena, s, p, count(*) AS won, row_number() OVER (PARTITION BY arena, s ORDER BY count(*) DESC, p) AS rn FROM act GROUP BY arena, s, p)
"""
