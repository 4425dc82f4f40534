"""Queries on the placement of units in seats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.operators import extents, overlay, placement
from hustings.plans.placement import Placement
from hustings.registry import Registry
from hustings.sources import shapes
from hustings.sources.directory import Directory

REGISTRY = Registry()

#: The directory, told anew; then the placement, tier after tier, each only for what earlier ones have left.
DIRECTORY = """WITH places AS (SELECT k, b, n_name AS s, k % 4 AS d, k % 12 AS sub, 1000 + b * 2 + k % 2 AS t FROM (SELECT CAST(c_custkey AS BIGINT) AS k, CAST((c_custkey // 10) % 25 AS BIGINT) AS b FROM customer) JOIN nation ON n_nationkey = b),
units AS (SELECT k AS unit, b AS state, s, d AS district, sub AS subdistrict, CASE WHEN k % 3 <> 0 THEN 'village' WHEN k % 9 = 0 THEN 'town' WHEN k % 6 = 3 THEN 'og' ELSE 'ct' END AS route, t AS town, CASE WHEN k % 2 = 0 THEN 'nation' ELSE 'nationeast' END AS town_name, 200 + (k * 37) % 900 AS pop, CASE WHEN k % 3 = 0 AND k % 9 <> 0 AND k % 6 = 3 THEN k - 1 ELSE k END AS code FROM places),
own AS (SELECT k AS village, s || '|' || (1 + k % 6) AS seat FROM places WHERE k % 5 IN (1, 2, 3) UNION SELECT k, s || '|' || (1 + (k + 1) % 6) FROM places WHERE k % 5 = 2),
insub AS (SELECT k AS village, s || '|' || (1 + sub % 6) AS seat FROM places WHERE (b + sub) % 3 = 0 AND k % 5 NOT IN (1, 2, 3)),
indis AS (SELECT k AS village, s || '|' || (1 + d) AS seat FROM places WHERE (b + d) % 2 = 0 AND k % 5 NOT IN (1, 2, 3) AND (b + sub) % 3 <> 0),
vill AS (SELECT CASE WHEN village % 7 = 1 AND village % 10 <> 0 THEN village - 1 ELSE village END AS census, seat, count(*) AS c FROM (FROM own UNION ALL FROM insub UNION ALL FROM indis) GROUP BY ALL),
vseat AS (SELECT census, seat, c / sum(c) OVER (PARTITION BY census) AS w FROM vill),
wards AS (SELECT t + 5000 AS body, s || '|' || (1 + (k // 9) % 6) AS seat, count(DISTINCT k) AS c FROM places WHERE k % 9 = 0 AND t % 4 <> 1 GROUP BY ALL),
towns AS (SELECT DISTINCT b, s, t FROM places WHERE k % 9 = 0),
bshare AS (SELECT body, seat, c / sum(c) OVER (PARTITION BY body) AS w FROM wards UNION ALL SELECT t + 5000, s || '|' || (1 + b % 6), CASE WHEN t % 8 = 1 THEN 1.0 ELSE 0.5 END FROM towns WHERE t % 4 = 1 UNION ALL SELECT t + 5000, s || '|' || (1 + (b + 1) % 6), 0.5 FROM towns WHERE t % 8 = 5),
allowed AS (SELECT n_name || '|' || n AS seat, d AS district FROM nation, range(1, 6) x(n), range(0, 4) y(d) WHERE (d + n) % 4 <> 3)
"""

TIERS = """, t1 AS (SELECT unit, seat, w, route || '-code' AS method FROM units JOIN vseat ON census = code WHERE route <> 'town' UNION ALL SELECT unit, seat, w, 'town-code' FROM units JOIN bshare ON body = town + 5000 WHERE route = 'town' AND town % 5 < 2),
t2 AS (SELECT unit, seat, w, 'town-alias' AS method FROM units JOIN towns ON t = town JOIN bshare ON body = CASE WHEN t % 2 = 0 THEN t + 5001 ELSE t + 4999 END WHERE route = 'town' AND town % 5 = 3),
named AS (SELECT b, CASE WHEN t % 2 = 0 THEN 'nation' ELSE 'nationeast' END AS nm, min(t + 5000) AS body FROM towns WHERE t % 5 < 3 AND t + 5000 IN (SELECT body FROM bshare) GROUP BY ALL),
t3 AS (SELECT unit, seat, w, 'town-name' AS method FROM units JOIN named ON b = state AND nm = town_name JOIN bshare USING (body) WHERE route = 'town' AND unit NOT IN (SELECT unit FROM t1) AND unit NOT IN (SELECT unit FROM t2)),
t4 AS (SELECT unit, s || CASE WHEN state % 2 = 0 THEN '|4' ELSE '|5' END AS seat, 1.0 AS w, 'town-namesake' AS method FROM units WHERE route = 'town' AND town_name = 'nationeast' AND (state % 2 = 0) <> (state % 3 = 0) AND unit NOT IN (SELECT unit FROM t1 UNION SELECT unit FROM t2 UNION SELECT unit FROM t3)),
told AS (FROM t1 UNION ALL FROM t2 UNION ALL FROM t3 UNION ALL FROM t4),
guarded AS (SELECT unit, seat, w / sum(w) OVER (PARTITION BY unit) AS weight, method FROM told JOIN units USING (unit) WHERE right(seat, 1) = '6' OR (seat, district) IN (SELECT (seat, district) FROM allowed)),
area AS (SELECT s, district, subdistrict, seat, sum(pop * weight) AS p FROM guarded JOIN units USING (unit) GROUP BY ALL),
ashare AS (SELECT *, p / sum(p) OVER w AS share, row_number() OVER (PARTITION BY s, district, subdistrict ORDER BY p DESC, seat) AS nth, max(p) OVER w / sum(p) OVER w AS top FROM area WINDOW w AS (PARTITION BY s, district, subdistrict)),
rest AS (SELECT unit, seat, 1.0 AS weight, 'subdistrict' AS method FROM units JOIN ashare USING (s, district, subdistrict) WHERE top >= 0.95 AND nth = 1 AND unit NOT IN (SELECT unit FROM guarded)
  UNION ALL SELECT unit, seat, share / sum(share) OVER (PARTITION BY unit), 'subdistrict-split' FROM units JOIN ashare USING (s, district, subdistrict) WHERE top < 0.95 AND share >= 0.02 AND route <> 'town' AND unit NOT IN (SELECT unit FROM guarded)),
over_ward AS (SELECT unit, s || '|' || n AS seat, 0.5 AS weight, 'city-ward' AS method FROM units, range(2, 4) x(n) WHERE unit % 90 = 0),
over_town AS (SELECT unit, s || '|4' AS seat, 1.0 AS weight, 'order-town' AS method FROM units WHERE route = 'town' AND town % 7 = 6 AND unit % 90 <> 0),
over_sub AS (SELECT unit, s || '|6' AS seat, 1.0 AS weight, 'order-subdistrict' AS method FROM units WHERE route <> 'town' AND state % 5 = 0 AND subdistrict = 7),
overs AS (FROM over_ward UNION ALL FROM over_town UNION ALL FROM over_sub),
placed AS (SELECT * FROM (FROM guarded UNION ALL FROM rest) WHERE unit NOT IN (SELECT unit FROM overs) UNION ALL FROM overs),
everyone AS (FROM placed UNION ALL SELECT unit, NULL, NULL, 'none' FROM units WHERE unit NOT IN (SELECT unit FROM placed))
"""

SHARED = """, el AS (SELECT n_name || '|' || n AS seat, 1000 + (n_nationkey * 700 + n * 1300) % 9000 AS e FROM nation, range(1, 7) x(n)),
r AS (SELECT p.*, u.state, u.pop, CASE WHEN route = 'town' AND starts_with(method, 'town') THEN town END AS town FROM placed p JOIN units u USING (unit)),
sp AS (SELECT town FROM r WHERE town IS NOT NULL GROUP BY town HAVING count(DISTINCT seat) > 1),
parts AS (SELECT state, town, seat, max(weight) AS was FROM r WHERE town IN (FROM sp) GROUP BY ALL),
others AS (SELECT state, seat, sum(pop * weight) AS p FROM r WHERE town IS NULL OR town NOT IN (FROM sp) GROUP BY ALL),
ratio AS (SELECT state, median(e / p) AS ratio FROM others JOIN el USING (seat) WHERE e > 0 AND p > 0 AND seat NOT IN (SELECT seat FROM parts) GROUP BY state),
resid AS (SELECT t.town, t.seat, t.was, greatest(0, coalesce(e, 0) - coalesce(ratio, 0.65) * coalesce(o.p, 0)) * t.was / sum(t.was) OVER (PARTITION BY t.seat) AS x FROM parts t LEFT JOIN el USING (seat) LEFT JOIN others o USING (seat) LEFT JOIN ratio ra ON ra.state = t.state),
tshare AS (SELECT town, seat, CASE WHEN sum(x) OVER (PARTITION BY town) > 0 THEN x / sum(x) OVER (PARTITION BY town) ELSE was END AS share FROM resid),
final AS (SELECT unit, seat, weight, method FROM r WHERE town IS NULL OR town NOT IN (FROM sp) UNION ALL SELECT unit, seat, coalesce(share / nullif(sum(share) OVER (PARTITION BY unit), 0), 0), method FROM r JOIN tshare USING (town, seat))
"""


def plan(spark: SparkSession, sf_dir: str) -> Placement:
    return Placement(Directory(spark, sf_dir))


def unit_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir)
    return placement.with_unplaced(p.directory.units, p.placed)


def units_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir)
    return placement.method_report(p.directory.units, p.placed, ["s"])


def people_of_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir)
    rows = p.shared.join(p.directory.units, "unit")
    return rows.groupBy("seat").agg(F.sum(F.col("pop") * F.col("weight")).alias("people"), F.count_distinct("unit").alias("units"))


REGISTRY.add("village_seats", lambda spark, d: plan(spark, d).villages.select(F.col("key").cast("long").alias("census"), "seat", "weight"), DIRECTORY + "SELECT census, seat, round(w, 6) AS weight FROM vseat")
REGISTRY.add("town_body_seats", lambda spark, d: plan(spark, d).bodies, DIRECTORY + "SELECT body, seat, round(w, 6) AS weight FROM bshare")
REGISTRY.add("unit_seats", unit_seats, DIRECTORY + TIERS + "SELECT unit, seat, round(weight, 6) AS weight, method FROM everyone")
REGISTRY.add("units_by_method", units_by_method, DIRECTORY + TIERS + "SELECT s, method, count(*) AS units, CAST(sum(pop) AS BIGINT) AS people, round(CAST(sum(pop) AS DOUBLE) * 100 / sum(sum(pop)) OVER (PARTITION BY s), 6) AS share FROM (SELECT DISTINCT unit, method FROM everyone) JOIN units USING (unit) GROUP BY s, method")
REGISTRY.add("units_shared_by_electors", lambda spark, d: plan(spark, d).shared, DIRECTORY + TIERS + SHARED + "SELECT unit, seat, round(weight, 6) AS weight, method FROM final")
REGISTRY.add("people_of_seats", people_of_seats, DIRECTORY + TIERS + SHARED + "SELECT seat, round(sum(pop * weight), 6) AS people, count(DISTINCT unit) AS units FROM final JOIN units USING (unit) GROUP BY seat")


def named(directory: Directory) -> DataFrame:
    return extents.towns_named(directory.extents, directory.town_list, ["s"], "seat", "extent", "town", "name")


def towns_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a hundred times the people, so that towns are large enough."""
    p = plan(spark, sf_dir)
    units = p.directory.units.withColumn("pop", F.col("pop") * 100)
    return extents.spread_towns(p.placed, units, named(p.directory), p.directory.allowed)


#: Extents, and the towns that they name by a search of each text for each name of its state.
EXTENTS = """, ext AS (SELECT n_name AS s, n_name || '|' || n AS seat, CASE (n_nationkey + n) % 3 WHEN 0 THEN 'Ward 1 of ' || n_name || ' (M Corp)' WHEN 1 THEN n_name || ' East (M Cl) and Part villages' ELSE 'Old ' || n_name || ' Town' END || CASE WHEN n % 2 = 0 THEN ', ' || n_name || ' East (NAC) (Part)' ELSE '' END AS extent FROM nation, range(1, 7) x(n)),
hits AS (SELECT e.s, e.seat, t.t AS town FROM ext e JOIN towns t USING (s) WHERE regexp_matches(lower(e.extent), '(^|[^a-z0-9])' || lower(t.s) || CASE WHEN t.t % 2 = 0 THEN '' ELSE ' east' END || '\\s*\\((m|cb|np|nac|tp|nn)'))
"""

SPREAD = """, big AS (SELECT town, min(seat) AS one, arg_min(district, unit) AS district FROM placed JOIN units USING (unit) WHERE route = 'town' AND starts_with(method, 'town') GROUP BY town HAVING count(DISTINCT seat) = 1 AND sum(pop * 100 * weight) >= 150000),
ok AS (SELECT town, seat, count(*) OVER (PARTITION BY town) AS c FROM big JOIN hits USING (town) WHERE right(seat, 1) = '6' OR (seat, district) IN (SELECT (seat, district) FROM allowed)),
spread AS (SELECT p.unit, ok.seat, p.weight / c AS weight, 'town-order-seats' AS method FROM placed p JOIN units u USING (unit) JOIN ok ON ok.town = u.town AND c >= 2 WHERE u.route = 'town')
SELECT unit, seat, round(weight, 6) AS weight, method FROM (SELECT * FROM placed WHERE unit NOT IN (SELECT unit FROM spread) UNION ALL FROM spread)"""

REGISTRY.add("towns_named_in_extents", lambda spark, d: named(Directory(spark, d)), DIRECTORY + EXTENTS + "FROM hits")
REGISTRY.add("towns_spread_by_extents", towns_spread, DIRECTORY + TIERS + EXTENTS + SPREAD)
REGISTRY.add("extent_classes", lambda spark, d: Directory(spark, d).extents.join(Directory(spark, d).places.select("s", "k"), "s").select("k", "seat", extents.extent_class(F.col("extent")).alias("class")), DIRECTORY + EXTENTS + "SELECT k, seat, CASE WHEN extent LIKE 'Ward%' THEN 'C' WHEN extent LIKE '%villages%' THEN 'B' WHEN extent LIKE '%(Part)' THEN 'B2' ELSE 'A' END AS class FROM ext JOIN places USING (s)")


def seats_in_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.overlay(overlay.as_edges(shapes.seats(spark, sf_dir)), overlay.as_edges(shapes.districts(spark, sf_dir)), shapes.HEIGHT, shapes.STRETCH)


#: A seat is two boxes, a district one; their edges lie on rows' edges, so areas are exact.
REGISTRY.add("seats_in_districts", seats_in_districts, """WITH k AS (SELECT CAST(c_custkey AS BIGINT) AS a, CAST(c_custkey % 40 * 7 + c_custkey % 3 AS DOUBLE) AS x, CAST(c_custkey // 40 * 7 AS DOUBLE) AS y FROM customer),
boxes AS (SELECT a, x AS x1, y AS y1, x + 8 AS x2, y + 3 AS y2 FROM k UNION ALL SELECT a, x, y + 3, x + 3, y + 9 FROM k),
d AS (SELECT CAST(s_suppkey AS BIGINT) AS b, CAST(s_suppkey % 10 * 28 AS DOUBLE) AS x1, CAST(s_suppkey // 10 * 28 AS DOUBLE) AS y1 FROM supplier),
o AS (SELECT a, b, sum(greatest(0, least(x2, d.x1 + 28) - greatest(boxes.x1, d.x1)) * greatest(0, least(y2, d.y1 + 30) - greatest(boxes.y1, d.y1))) AS overlap FROM boxes JOIN d ON boxes.x1 < d.x1 + 28 AND boxes.x2 > d.x1 AND boxes.y1 < d.y1 + 30 AND boxes.y2 > d.y1 GROUP BY ALL HAVING overlap > 0),
p AS (SELECT *, overlap / sum(overlap) OVER (PARTITION BY a) AS part, row_number() OVER (PARTITION BY a ORDER BY overlap DESC, b) AS nth FROM o)
SELECT a, b, round(overlap, 6) AS overlap, round(part / sum(part) OVER (PARTITION BY a), 6) AS share, round(overlap / (42 + 840 - overlap), 6) AS iou FROM p WHERE part >= 0.1 OR nth = 1""")


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("EAST & WEST", 7), ("EAST & WEST", 8), ("NATION", 9)], "name string, code int")
    return extents.noted_districts(Directory(spark, sf_dir).notes, "k", "note", names, spark.range(35).select(F.col("id").alias("code")))


REGISTRY.add("noted_districts", noted, DIRECTORY + """, n AS (SELECT k, k % 30 AS code FROM places WHERE k % 7 = 0 UNION SELECT k, k % 40 FROM places WHERE k % 7 = 0 UNION SELECT k, k % 50 FROM places WHERE k % 7 = 1 UNION SELECT k, k % 60 FROM places WHERE k % 7 = 2 UNION SELECT k, k % 20 FROM places WHERE k % 7 = 3 UNION SELECT k, k % 25 FROM places WHERE k % 7 = 3
UNION SELECT k, 9 FROM places WHERE k % 7 = 4 UNION SELECT k, unnest([7, 8, k % 9]) FROM places WHERE k % 7 = 5) SELECT k, CAST(code AS INTEGER) AS code FROM n WHERE code < 35""")
