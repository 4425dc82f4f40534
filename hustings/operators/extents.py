"""Towns named in legal extents of seats, found by an index of words, and towns spread over the seats that name them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How the bracket after a town's name begins, by its kind of council.
MARKS = ("M", "CB", "NP", "NAC", "TP", "NN")
#: What tells the class of an extent: wards or blocks, units below a sub-district, parts of units.
WARDS = r"(?i)\bward|\be\.?\s?b\.?\s?no|enumeration block|block no"
BELOW = r"(?i)gram panchayat|\bg\.?p\.?s?\b|village|mouza|\bkcs?\b|\bpcs?\b|ilrc|circle|hobli|revenue inspector|\bri\b|patwar|kanungo|\bgpu\b|panchayat|saza|halqa|nyaya"
PARTS = r"(?i)\(part|partly|\bexcluding\b|\bexcept\b"
#: People from whom on a town that lies in one seat is held against extents.
LARGE = 150_000


def extent_class(extent: Column) -> Column:
    """The smallest unit that an extent names: C wards, B units below a sub-district, B2 parts, A whole sub-districts and towns."""
    return F.when(extent.rlike(WARDS), "C").when(extent.rlike(BELOW), "B").when(extent.rlike(PARTS), "B2").otherwise("A")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def plain_town(name: Column) -> Column:
    """Words of a town's name up to its first bracket."""
    return F.array_join(words(F.regexp_replace(name, r"\s*\(.*$", "")), " ")


def towns_named(extents: DataFrame, towns: DataFrame, keys: Sequence[str], seat: str, extent: str, town: str, name: str) -> DataFrame:
    """(keys, seat, town), each once: a town's name stands in a seat's extent, before a bracket with a mark of its kind.

    Extents are cut at such brackets; the last one, two, ... words before each are looked up among names, up to as many as the
    longest name has. So an extent meets the towns that it names, not all of its state. Names of less than three letters and
    digits are left out; null extents and names name nothing.
    """
    known = towns.select(*keys, town, plain_town(F.coalesce(name, F.lit(""))).alias("named")).where("char_length(named) >= 3").distinct()
    longest = known.agg(F.max(F.size(F.split("named", " ")))).first()[0] or 0  # one number
    cut = F.split(F.lower(F.coalesce(extent, F.lit(""))), rf"\s*\((?={'|'.join(MARKS).lower()})")
    before = extents.select(*keys, seat, F.explode(F.slice(cut, 1, F.greatest(F.lit(0), F.size(cut) - 1))).alias("before"))
    ends = before.select(*keys, seat, words(F.col("before")).alias("w"))
    upto = F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w")))
    grams = ends.where(F.size("w") > 0).select(*keys, seat, F.explode(F.transform(upto, lambda n: F.array_join(F.slice("w", -n, n), " "))).alias("named"))
    return grams.distinct().join(known, [*keys, "named"]).select(*keys, seat, town).distinct()


def spread_towns(placed: DataFrame, units: DataFrame, named: DataFrame, districts: DataFrame, least: int = LARGE) -> DataFrame:
    """placed (unit, seat, weight, method), where a town of so many people that lies in one seat, though several seats' extents
    name it (named: seat, town), is spread over these in equal parts.

    units: unit, district, route, town, pop. Seats whose list of districts (seat, district) lacks the town's are left out;
    seats without a list are not. Towns with less than two such seats stay.
    """
    rows = placed.where(F.col("method").startswith("town")).join(units.where("route = 'town'"), "unit")
    large = rows.groupBy("town").agg(F.count_distinct("seat").alias("seats"), F.sum(F.col("pop") * F.col("weight")).alias("people"), F.min_by("district", "unit").alias("district")).where((F.col("seats") == 1) & (F.col("people") >= least))
    hits = named.select("seat", "town").distinct().join(large.select("town", "district"), "town")
    hits = hits.join(districts.select("seat").distinct().withColumn("listed", F.lit(True)), "seat", "left").join(districts.select("seat", "district").distinct().withColumn("in_list", F.lit(True)), ["seat", "district"], "left").where("listed is null or in_list")
    counted = hits.groupBy("town").agg(F.count(F.lit(1)).alias("of")).where("of >= 2")
    to = hits.join(counted, "town").select("town", F.col("seat").alias("new_seat"), "of")
    moved = placed.join(units.where("route = 'town'").select("unit", "town"), "unit").join(to, "town").select("unit", F.col("new_seat").alias("seat"), (F.col("weight") / F.col("of")).alias("weight"), F.lit("town-order-seats").alias("method"))
    return placed.join(moved.select("unit").distinct(), "unit", "left_anti").unionByName(moved)


def noted_districts(notes: DataFrame, key: str, note: str, names: DataFrame, known: DataFrame) -> DataFrame:
    """(key, code), each once: further districts that notes on a seat's extent give it, by their tags; only known codes count.

    also_2011=11;12 (not where the note calls it a sliver), possible_2011=13, ALSO_DISTRICT=NAME(14), "2011 codes 15 + 16", and
    also_in_district_2008=NAME, whose codes are those of names (name in upper case, code). known: code.
    """
    text = F.coalesce(F.col(note), F.lit(""))
    lists = lambda tag: F.flatten(F.transform(F.regexp_extract_all(text, F.lit(rf"{tag}=([\d;]+)"), F.lit(1)), lambda x: F.split(x, ";")))
    also = F.when(text.contains("a sliver"), F.array().cast("array<string>")).otherwise(lists("also_2011"))
    pair = F.regexp_extract_all(text, F.lit(r"2011 codes (\d+) \+ \d+"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"2011 codes \d+ \+ (\d+)"), F.lit(1))
    told = F.flatten(F.array(also, lists("possible_2011"), F.regexp_extract_all(text, F.lit(r"ALSO_DISTRICT=[^(;]*\((\d+)\)"), F.lit(1)), *pair))
    codes = notes.select(key, F.explode(told).alias("code")).select(key, F.col("code").try_cast("int").alias("code"))
    named = notes.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"also_in_district_2008=([A-Za-z &.]+)"), F.lit(1))).alias("name")).withColumn("name", F.upper(F.trim("name")))
    by_name = named.join(names.select("name", F.col("code").cast("int").alias("code")), "name").select(key, "code")
    return codes.unionByName(by_name).join(known.select(F.col("code").cast("int").alias("code")).distinct(), "code", "left_semi").select(key, "code").distinct()
