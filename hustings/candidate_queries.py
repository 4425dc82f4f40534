"""Queries from candidate rows to seats, parties and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.contest_sql import PREFIX
from hustings.operators import candidates, resolve
from hustings.plans.contests import Contests
from hustings.registry import Registry
from hustings.sources.contests import table

REGISTRY = Registry()
SEAT = ["arena", "s", "y", "n"]


def seats_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as seats of their nation, numbered by their first order."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("state"), F.col("c_name").alias("seat"), "o_orderkey")
    return candidates.first_seen_numbers(rows, ["state"], "seat", "o_orderkey")


def told_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some candidates a second time in another case, some with other votes, some without."""
    rows = Contests(spark, sf_dir).cand.select(*SEAT, F.concat(F.lit("Cand "), "p").alias("name"), "p", "votes", F.lit(0).alias("nth"))
    again = rows.where("votes % 3 = 0").select(*SEAT, F.upper("name").alias("name"), F.lower("p").alias("p"), F.expr("case when votes % 2 = 0 then votes when votes % 5 = 0 then null else votes + 1 end").alias("votes"), F.lit(1).alias("nth"))
    return candidates.distinct_candidates(rows.unionByName(again), SEAT, "name", "p", "votes", "nth")


def winners_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Contests(spark, sf_dir)
    lacks = F.col("arena") == "GE"
    winners = c.seats.select(*SEAT, "p", F.col("wv").alias("votes"), F.round(F.col("m") * F.col("total") / 100).cast("long").alias("lead"), F.when(~lacks, F.round("v", 2)).alias("share"), F.when(~(lacks & (F.col("n") % 2 == 0)), F.round("m", 2)).alias("margin"))
    known = c.cand.where("n != 3").groupBy(*SEAT).agg(F.sum("votes").alias("valid"))
    return candidates.with_known_votes(winners, known, SEAT)


def parties_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Contests(spark, sf_dir)
    seats = c.seats.where("n != 5").join(c.parents, "s").select(*SEAT, "pc", "p")
    named = lambda rows: rows.withColumn("seat", F.concat_ws("-", "s", "n"))
    return candidates.parties_by_seats(named(c.cand), named(seats), ["arena", "y"], "seat", "pc")


def national_segments(c: Contests) -> DataFrame:
    """Told for years before 2000, from candidates after."""
    ranked = resolve.ranked(c.cand.where("arena = 'GE'"))
    direct = ranked.where("y < 2000 and rank = 1").select("s", "n", "y", "p", F.col("q").alias("tp"), (F.col("votes") - F.col("qv")).alias("mg"), F.col("total").alias("sv"))
    return candidates.segments(direct, ranked.withColumnRenamed("rank", "position"), ["s", "n"])


def leads_of_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Contests(spark, sf_dir)
    shift = F.when(F.col("s").isin("NATION_3", "NATION_7"), 119).otherwise(0)
    return candidates.segment_leads(c.active.where("arena = 'AE'").select("s", "j", "p"), national_segments(c), shift, F.col("s").isin("NATION_5", "NATION_9"))


def turnout_overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Contests(spark, sf_dir).seats.groupBy("arena", "s", "y").agg(F.max("t").alias("t"))
    return candidates.overlaid(rows.where("arena = 'AE'").drop("arena"), rows.where("arena = 'GE' and (y + length(s)) % 2 = 0").drop("arena"), ["s", "y"], "t")


def elections_of_winners_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Contests(spark, sf_dir)
    lacking = (F.col("y") == 1998) & (F.length("s") == 8)
    parties = c.summary.withColumn("v", F.when(~lacking & ~((F.col("y") == 1999) & (F.col("p") == "LARGE")), F.col("v")))
    return candidates.winners_only(parties, c.cand.where("y != 1997"), ["arena", "s", "y"])


REGISTRY.add("seats_first_seen", seats_seen, "SELECT c_nationkey AS state, c_name AS seat, row_number() OVER (PARTITION BY c_nationkey ORDER BY min(o_orderkey), c_name) AS number FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, c_name")
REGISTRY.add("distinct_candidates", told_twice, PREFIX + """, a AS (SELECT arena, s, y, n, 'Cand ' || p AS name, p, votes, 0 AS nth FROM cand UNION ALL SELECT arena, s, y, n, upper('Cand ' || p), lower(p), CASE WHEN votes % 5 = 0 THEN NULL ELSE votes + 1 END, 1 FROM cand WHERE votes % 3 = 0 AND votes % 2 <> 0)
SELECT arena, s, y, n, row_number() OVER w AS rank, name, p, votes FROM a WINDOW w AS (PARTITION BY arena, s, y, n ORDER BY votes DESC NULLS LAST, nth, upper(name)) QUALIFY row_number() OVER w <= 5""")
REGISTRY.add("winners_filled", winners_filled, PREFIX + "SELECT arena, s, y, n, p, wv AS votes, CAST(round(m * total / 100) AS BIGINT) AS lead, CASE WHEN arena = 'GE' THEN CASE WHEN n <> 3 THEN round(wv * 100.0 / total, 2) END ELSE round(v, 2) END AS share, CASE WHEN arena = 'GE' AND n % 2 = 0 THEN CASE WHEN round(m * total / 100) > 0 THEN round(round(m * total / 100) * 100 / total, 2) END ELSE round(m, 2) END AS margin FROM seats")
REGISTRY.add("parties_of_regions", parties_of_regions, PREFIX + """, c AS (SELECT arena, y, pc, p, count(*) AS fought, CAST(sum(votes) AS BIGINT) AS votes FROM cand JOIN par USING (s) WHERE n <> 5 GROUP BY ALL), w AS (SELECT arena, y, pc, p, count(*) AS won FROM seats JOIN par USING (s) WHERE n <> 5 GROUP BY ALL)
SELECT arena, y, pc, p, fought, votes, coalesce(won, 0) AS won, round(CAST(votes AS DOUBLE) * 100 / sum(votes) OVER (PARTITION BY arena, y, pc), 6) AS share FROM c LEFT JOIN w USING (arena, y, pc, p)""")
REGISTRY.add("national_segments", lambda spark, d: national_segments(Contests(spark, d)), PREFIX + "SELECT s, n, y, p, q AS tp, votes - qv AS mg, total AS sv FROM ranked WHERE arena = 'GE' AND rank = 1")
REGISTRY.add("seats_with_segment_leads", leads_of_segments, PREFIX + """SELECT a.s, a.j, a.p, g.p AS segment_lead FROM act a LEFT JOIN (SELECT s, CASE WHEN s IN ('NATION_3', 'NATION_7') THEN n + 119 ELSE n END AS j, p FROM ranked WHERE arena = 'GE' AND rank = 1 AND y = (SELECT max(y) FROM cand WHERE arena = 'GE') AND s NOT IN ('NATION_5', 'NATION_9')) g USING (s, j) WHERE a.arena = 'AE'""")
REGISTRY.add("turnout_overlaid", turnout_overlaid, PREFIX + ", t AS (SELECT arena, s, y, max(t) AS t FROM seats GROUP BY ALL) SELECT s, y, coalesce(g.t, a.t) AS t FROM (SELECT s, y, t FROM t WHERE arena = 'AE') a FULL JOIN (SELECT s, y, t FROM t WHERE arena = 'GE' AND (y + length(s)) % 2 = 0) g USING (s, y)")
REGISTRY.add("elections_of_winners_only", elections_of_winners_only, PREFIX + "SELECT arena, s, y, count(*) AS parties, y = 1998 AND length(s) = 8 OR y = 1999 AND count(*) = count(*) FILTER (p = 'LARGE') AS winners_only, y <> 1997 AS with_candidates FROM summ GROUP BY arena, s, y")
