"""Queries on lists of seats: likeness of names, the crosswalk, neighbours' fill and new numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.operators import crosswalk, renumber
from hustings.registry import Registry
from hustings.sources import seatlists

REGISTRY = Registry()

#: The two lists, told anew; their keys; and ratios by common blocks: of a stretch the longest block (first in a, then in b),
#: then what stands before and after it.
LISTS = """WITH RECURSIVE nm AS (SELECT 1 AS u),
known AS (SELECT c_custkey % 25 AS block, CAST(c_custkey AS BIGINT) AS seat, c_custkey AS k, translate(substr(md5('seat' || c_custkey), 1, 9), '0123456789abcdef', 'kanirutosemaludi') AS nm, translate(substr(md5('parent' || (c_custkey % 10)), 1, 9), '0123456789abcdef', 'kanirutosemaludi') AS parent FROM customer),
kn AS (SELECT block, seat, [nm] || CASE k % 7 WHEN 0 THEN ['N'] WHEN 3 THEN ['CANTT'] ELSE [] END AS w FROM known UNION ALL SELECT block, seat, ['OLD', translate(substr(md5('old' || k), 1, 9), '0123456789abcdef', 'kanirutosemaludi')] FROM known WHERE k % 3 = 0),
listed AS (SELECT s_suppkey % 25 AS block, CAST(s_suppkey AS BIGINT) AS code, s_suppkey AS k, translate(substr(md5('seat' || s_suppkey), 1, 9), '0123456789abcdef', 'kanirutosemaludi') AS nm FROM supplier),
li AS (SELECT block, code, [CASE k % 6 WHEN 1 THEN replace(replace(nm[1:1], 'A', 'a') || replace(replace(nm[2:], 'a', 'aa'), 't', 'th'), '~', '') WHEN 2 THEN nm[1:8] WHEN 3 THEN nm[1:2] || nm[4:4] || nm[3:3] || nm[5:] WHEN 4 THEN translate(substr(md5('other' || k), 1, 9), '0123456789abcdef', 'kanirutosemaludi') WHEN 5 THEN nm[1:3] || nm[6:] ELSE nm END] || CASE k % 7 WHEN 0 THEN ['N'] WHEN 3 THEN ['CANTT'] ELSE [] END AS w FROM listed),
l2 AS (SELECT block, code, list_transform(w, lambda x: upper(x)) AS w FROM li), k2 AS (SELECT block, seat, list_transform(w, lambda x: upper(x)) AS w FROM kn),
met AS (SELECT l2.block, code, seat, array_to_string(l2.w, '') AS lf, array_to_string(k2.w, '') AS rf, array_to_string(list_sort(l2.w), '') AS ls, array_to_string(list_sort(k2.w), '') AS rs FROM l2 JOIN k2 USING (block)),
snd AS (SELECT f, array_to_string(list_filter(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i = 1 OR x[i] <> x[i - 1] THEN x[i] ELSE '' END), lambda c: c <> ''), '') AS sound FROM (SELECT f, SOUNDS AS x FROM (SELECT lf AS f FROM met UNION SELECT rf FROM met))),
asked AS (SELECT DISTINCT a, b FROM (SELECT lf AS a, rf AS b FROM met UNION ALL SELECT ls, rs FROM met UNION ALL SELECT x.sound, y.sound FROM met JOIN snd x ON x.f = lf JOIN snd y ON y.f = rf)),
seg AS (SELECT a AS a0, b AS b0, a, b, 0 AS m FROM asked UNION ALL
  SELECT a0, b0, unnest([a[1:i - 1], a[i + size:]]), unnest([b[1:j - 1], b[j + size:]]), unnest([size, 0]) FROM (SELECT *, -best.minus AS i, best.size AS size, position(a[-best.minus:best.size - best.minus - 1] IN b) AS j FROM (
    SELECT *, list_max(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(list_filter(range(1, len(a) - i + 2), lambda n: contains(b, a[i:i + n - 1])), lambda n: {'size': n, 'minus': -i})))) AS best FROM seg WHERE a <> '' AND b <> '') WHERE best IS NOT NULL)),
ratio AS (SELECT a0, b0, CAST(2 * sum(m) AS DOUBLE) / (len(a0) + len(b0)) AS r FROM seg GROUP BY a0, b0),
sim AS (SELECT block, code, seat, max(round(greatest(r1.r, r2.r, r3.r), 3)) AS similarity FROM met JOIN snd x ON x.f = lf JOIN snd y ON y.f = rf JOIN ratio r1 ON r1.a0 = lf AND r1.b0 = rf JOIN ratio r2 ON r2.a0 = ls AND r2.b0 = rs JOIN ratio r3 ON r3.a0 = x.sound AND r3.b0 = y.sound GROUP BY ALL)
"""


def sounds_sql() -> str:
    found = "f"
    for a, b in (*crosswalk.RENAMED, *crosswalk.SOUNDS):
        found = f"replace({found}, '{a}', '{b}')"
    return found


def like_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listed and known seats of one block whose names are like."""
    return crosswalk.like_seats(seatlists.listed(spark, sf_dir), seatlists.known(spark, sf_dir))


REGISTRY.add("like_names", like_names, LISTS.replace("SOUNDS", sounds_sql()) + f"SELECT block, code, seat, similarity FROM sim WHERE similarity >= {crosswalk.WITH_EVIDENCE}")
REGISTRY.add("crosswalk", lambda spark, d: crosswalk.crosswalk(seatlists.listed(spark, d), seatlists.known(spark, d)), None)


def fill_sql() -> str:
    """Three passes, each row after row with the four rows before it at hand; what stands above is of the pass before."""
    text = """WITH RECURSIVE nn AS (SELECT 1 AS u), p0 AS (SELECT block, n, min(side) AS v FROM (SELECT c_custkey % 25 AS block, CAST(c_custkey // 25 AS BIGINT) AS n, CASE WHEN md5('side' || (c_custkey // 3))[1] IN ('0', '1', '2', '3') THEN 'TG' WHEN md5('side' || (c_custkey // 3))[1] IN ('4', '5') THEN 'AP' END AS side FROM customer WHERE c_custkey % 11 <> 5) GROUP BY ALL)"""
    for k in range(1, renumber.PASSES + 1):
        low = lambda d: "CASE " + " ".join(f"WHEN r.n{i} = h.n - {d} THEN r.v{i}" for i in range(1, 5)) + " END"
        pick = ", ".join(f"CASE WHEN ({low(d)}) <> h.h{d} THEN NULL ELSE coalesce({low(d)}, h.h{d}) END" for d in range(1, 5))
        text += f""", h{k} AS (SELECT p.block, p.n, p.v, row_number() OVER (PARTITION BY p.block ORDER BY p.n) AS rn, {", ".join(f"a{d}.v AS h{d}" for d in range(1, 5))} FROM p{k - 1} p {" ".join(f"LEFT JOIN p{k - 1} a{d} ON a{d}.block = p.block AND a{d}.n = p.n + {d}" for d in range(1, 5))}),
r{k} AS (SELECT block, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS n1, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS BIGINT) AS n2, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS BIGINT) AS n3, CAST(NULL AS VARCHAR) AS v3, CAST(NULL AS BIGINT) AS n4, CAST(NULL AS VARCHAR) AS v4 FROM (SELECT DISTINCT block FROM p0)
  UNION ALL SELECT h.block, h.rn, h.n, coalesce(h.v, {pick}), r.n1, r.v1, r.n2, r.v2, r.n3, r.v3 FROM r{k} r JOIN h{k} h ON h.block = r.block AND h.rn = r.rn + 1),
p{k} AS (SELECT block, n1 AS n, v1 AS v FROM r{k} WHERE rn > 0)"""
    return text + f" SELECT block, n, v AS side FROM p{renumber.PASSES}"


RENUMBER = """WITH src AS (SELECT c_custkey % 25 AS block, CAST(1 + (c_custkey // 25) % 35 AS BIGINT) AS n, CASE WHEN c_custkey % 13 = 0 THEN 25 * ((c_custkey // 25) % 35) + c_custkey % 25 ELSE c_custkey END AS id, c_custkey AS nth FROM customer),
seats AS (SELECT block, n, id, min(nth) AS first FROM src GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY block, n ORDER BY first, id) AS rn FROM seats),
off AS (SELECT c_custkey % 25 AS block, CAST(c_custkey AS BIGINT) AS id, CAST(1 + c_custkey // 25 + 2 * (c_custkey % 2) AS BIGINT) AS o FROM customer WHERE c_custkey % 3 = 0 AND (1 + c_custkey // 25 + 2 * (c_custkey % 2)) % 7 <> 0),
claim AS (SELECT r.*, o FROM ranked r JOIN off USING (block, id) LEFT JOIN ranked k ON k.block = r.block AND k.n = o AND k.rn = 1 WHERE r.rn > 1 AND (k.id IS NULL OR k.id = r.id)),
moved AS (SELECT * FROM claim c WHERE NOT EXISTS (SELECT 1 FROM claim e WHERE e.block = c.block AND e.o = c.o AND e.id <> c.id AND (e.first < c.first OR e.first = c.first AND e.id < c.id))),
held AS (SELECT block, n FROM ranked WHERE rn = 1 UNION SELECT block, o FROM moved),
rest AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n, first, id) AS k FROM ranked r WHERE rn > 1 AND NOT EXISTS (SELECT 1 FROM moved m WHERE m.block = r.block AND m.n = r.n AND m.id = r.id)),
free AS (SELECT block, f, row_number() OVER (PARTITION BY block ORDER BY f) AS place FROM (SELECT block, unnest(range(1, 1 + max(n) + (SELECT count(*) FROM customer))) AS f FROM held GROUP BY block) x WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.block = x.block AND h.n = x.f)),
own AS (SELECT r.block, r.n, r.id, r.k, min(f.place) AS place FROM rest r JOIN free f ON f.block = r.block AND f.f >= r.n GROUP BY ALL),
got AS (SELECT *, k + max(place - k) OVER (PARTITION BY block ORDER BY k) AS at FROM own)
SELECT block, n, 'Seat no ' || id AS name, n AS new_number, 'kept' AS how FROM ranked WHERE rn = 1 UNION ALL SELECT block, n, 'Seat no ' || id, o, 'official' FROM moved UNION ALL SELECT got.block, got.n, 'Seat no ' || id, f.f, 'next' FROM got JOIN free f ON f.block = got.block AND f.place = got.at"""

REGISTRY.add("sides_filled", lambda spark, d: renumber.neighbour_fill(seatlists.sided(spark, d), ["block"], "n", "side"), fill_sql())
REGISTRY.add("seats_renumbered", lambda spark, d: renumber.renumbered(seatlists.numbered(spark, d), seatlists.official_numbers(spark, d), ["block"], "n", "name", "nth"), RENUMBER)


def shifted_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed seats, of which those of every fifth block have the numbers of the seat after."""
    return seatlists.listed(spark, sf_dir).withColumn("code", F.col("code") + F.when(F.col("block") % 5 == 0, 25).otherwise(0))


CLOSER = """, k AS (SELECT block, code + CASE WHEN block % 5 = 0 THEN 25 ELSE 0 END AS code, seat, similarity FROM sim),
same AS (SELECT s.block, s.code, s.similarity AS same FROM k s WHERE s.seat = s.code AND NOT EXISTS (SELECT 1 FROM met m WHERE m.block = s.block AND m.code = s.code - CASE WHEN s.block % 5 = 0 THEN 25 ELSE 0 END AND m.seat = s.seat AND m.lf = m.rf)),
close AS (SELECT block, code, seat, same, similarity AS best, CASE WHEN seat = code THEN 'spelling' ELSE 'closer' END AS verdict FROM k JOIN same USING (block, code) WHERE seat = code OR similarity >= 0.55 QUALIFY row_number() OVER (PARTITION BY block, code ORDER BY similarity DESC, seat = code DESC, seat) = 1)
"""

REGISTRY.add("closer_names", lambda spark, d: crosswalk.closer_names(shifted_list(spark, d), seatlists.known(spark, d)), LISTS.replace("SOUNDS", sounds_sql()) + CLOSER + "FROM close")
REGISTRY.add("row_shifts", lambda spark, d: crosswalk.row_shifts(crosswalk.closer_names(shifted_list(spark, d), seatlists.known(spark, d))), LISTS.replace("SOUNDS", sounds_sql()) + CLOSER + """, o AS (SELECT block, seat - code AS shift, count(*) AS rows FROM close WHERE verdict = 'closer' GROUP BY ALL), t AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY block ORDER BY rows DESC, abs(shift), shift) = 1)
SELECT t.*, mismatches, rows >= 3 AND 2 * rows >= mismatches AS shifted FROM t JOIN (SELECT block, count(*) AS mismatches FROM close GROUP BY block) USING (block)""")
