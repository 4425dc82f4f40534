"""Queries on party names and alliances told by rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.operators import rules
from hustings.plans.contests import Contests
from hustings.contest_sql import PREFIX
from hustings.registry import Registry

REGISTRY = Registry()

#: Fixed values of the made-up source: other names of parties, overrides and other names of alliances.
ALIASES = [("name", None, f"the {p.lower()} party", p) for p in ("STANDARD", "ECONOMY", "MEDIUM")] + [("name", None, "standard front", "STD"), ("name", None, "independents", "IND"), ("code", None, "STD", "STDX"), ("code", None, "STDX", "STANDARD")]
ALIASES += [("extra", None, "the large party", "LARGE"), ("extra", None, "economy front", "ECONOMY"), ("epoch", 1997, "SMALL", "SM97"), ("epoch", 1998, "Promo\x96Front", "PR98")]
OVERRIDES = [("NATION_2", 1999, "MEDIUM", "X Alliance (Two)"), ("NATION_2", 1998, "SM97", "never")]
FOLDS = [("kutami", "STANDARD Alliance (K)")]
EPOCH = [("AE", "NATION_1", "PROMO", "Left"), ("GE", None, "PROMO", "First"), (None, "NATION_1", "LARGE", "Second"), (None, None, "LARGE", "Third"), (None, None, "PROMO", "Fourth")]


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arena, s, y, name, a: parties of every election by names and alliances as sources write them."""
    rows = Contests(spark, sf_dir).cand.select("arena", "s", "y", "p").distinct()
    p, kind = F.col("p"), (F.col("y") + F.length("s")) % 4
    name = F.when(kind == 0, p).when(kind == 1, F.concat(F.lit("The "), F.initcap(p), F.lit(" Party[12]"))).when(kind == 2, F.concat(F.lit("  "), p, F.lit(" [a] "))).otherwise(F.concat(F.initcap(p), F.lit("\x96Front")))
    n = F.regexp_extract("s", r"(\d+)", 1).cast("int") % 7
    a = F.when(n == 0, F.lit(" Kutami ")).when(n == 1, name).when(n == 2, F.lit("STANDARD Alliance (Q)")).when(n == 3, F.lit("ECONOMY")).when(n == 4, F.lit("Independents[3]")).when(n == 5, F.lit(" "))
    return rows.select("arena", "s", "y", name.alias("name"), a.alias("a"))


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "step string, epoch int, key string, code string")


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.standard_parties(told(spark, sf_dir), "name", aliases(spark), "y").withColumnRenamed("code", "party")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rules.alliance_rules(spark, OVERRIDES, FOLDS, anchors=("STANDARD", "ECONOMY"))
    return rules.standard_alliances(coded(spark, sf_dir), table, aliases(spark))


#: The same names; what each step makes of them is written out for each party.
TOLD = """, raw AS (SELECT DISTINCT arena, s, y, p, (y + length(s)) % 4 AS kind, CAST(regexp_extract(s, '(\\d+)', 1) AS INTEGER) % 7 AS nn FROM cand),
told AS (SELECT *, CASE kind WHEN 0 THEN p WHEN 1 THEN 'The ' || p[1] || lower(p[2:]) || ' Party[12]' WHEN 2 THEN '  ' || p || ' [a] ' ELSE p[1] || lower(p[2:]) || chr(150) || 'Front' END AS name FROM raw),
coded AS (SELECT *, CASE WHEN kind = 3 AND p = 'PROMO' AND y = 1998 THEN 'PR98' WHEN kind = 0 AND p = 'SMALL' AND y = 1997 THEN 'SM97' WHEN kind IN (0, 2) THEN p WHEN kind = 1 AND p IN ('STANDARD', 'ECONOMY', 'MEDIUM', 'LARGE') THEN p WHEN kind = 1 THEN 'The ' || p[1] || lower(p[2:]) || ' Party' WHEN p IN ('STANDARD', 'ECONOMY') THEN p ELSE p[1] || lower(p[2:]) || ' Front' END AS party FROM told),
parties AS (SELECT *, CASE nn WHEN 0 THEN ' Kutami ' WHEN 1 THEN name WHEN 2 THEN 'STANDARD Alliance (Q)' WHEN 3 THEN 'ECONOMY' WHEN 4 THEN 'Independents[3]' WHEN 5 THEN ' ' END AS a,
  CASE WHEN nn <> 1 THEN NULL WHEN kind IN (0, 2) THEN p WHEN kind = 1 AND p IN ('STANDARD', 'ECONOMY', 'MEDIUM', 'LARGE') THEN p WHEN kind = 1 THEN 'The ' || p[1] || lower(p[2:]) || ' Party' WHEN p IN ('STANDARD', 'ECONOMY') THEN p ELSE p[1] || lower(p[2:]) || ' Front' END AS own FROM coded)
"""

REGISTRY.add("party_codes", coded, PREFIX + TOLD + "SELECT arena, s, y, name, a, party FROM parties")
REGISTRY.add("alliance_labels", labelled, PREFIX + TOLD + """SELECT arena, s, y, name, a, party, CASE WHEN s = 'NATION_2' AND y = 1999 AND party = 'MEDIUM' THEN 'X Alliance (Two)' WHEN nn = 0 THEN 'STANDARD Alliance (K)'
WHEN party = 'STANDARD' OR own = 'STANDARD' THEN CASE WHEN nn = 2 THEN trim(a) ELSE 'STANDARD Alliance (STANDARD)' END WHEN party = 'ECONOMY' OR own = 'ECONOMY' OR nn = 3 THEN 'ECONOMY Alliance (ECONOMY)' WHEN nn = 4 THEN 'Independent/Unaligned' WHEN own = party THEN 'Unaligned' ELSE nullif(trim(a), '') END AS label FROM parties""")
REGISTRY.add("epoch_alliance_labels", lambda spark, d: rules.epoch_alliances(coded(spark, d).select("arena", "s", "y", "party"), rules.table(spark, "arena string, s string, party string, label string", EPOCH)), PREFIX + TOLD + "SELECT arena, s, y, party, CASE WHEN party = 'PROMO' THEN CASE WHEN arena = 'AE' AND s = 'NATION_1' THEN 'Left' WHEN arena = 'GE' THEN 'First' ELSE 'Fourth' END WHEN party = 'LARGE' THEN CASE WHEN s = 'NATION_1' THEN 'Second' ELSE 'Third' END ELSE 'Unaligned' END AS label FROM parties")
