"""Placement by tiers of keys, on literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hustings.operators import extents, placement

COVERAGE = "level string, code string, seat string, whole boolean"
UNITS = "unit long, state long, s string, district long, subdistrict long, route string, town long, pop long"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_the_deepest_level_covers(spark):
    villages = spark.createDataFrame([(1, "c1", "S", "D"), (2, "c1", "S", "D"), (3, "c3", "S", "D"), (4, "c4", "T", "D"), (5, "c5", "U", "E"), (6, None, "S", "D")], "village long, census string, sub string, dist string")
    coverage = spark.createDataFrame([("V", "1", "A", False), ("V", "1", "B", False), ("V", "1", "B", False), ("S", "S", "C", True), ("D", "D", "E", True), ("D", "D", "F", True), ("S", "U", "G", False)], COVERAGE)
    got = rows_of(placement.deepest_coverage(villages, coverage, [("V", "village"), ("S", "sub"), ("D", "dist")]), "key", "seat", "weight")
    # Two villages of now are one of the census: three placements. A sub-district that is covered in part says nothing.
    assert got == [("c1", "A", pytest.approx(1 / 3)), ("c1", "B", pytest.approx(1 / 3)), ("c1", "C", pytest.approx(1 / 3)), ("c3", "C", 1.0), ("c4", "E", 0.5), ("c4", "F", 0.5)]


def test_town_bodies(spark):
    wards = spark.createDataFrame([(1, 10, "A"), (1, 11, "A"), (1, 11, "A"), (1, 12, "B")], "body long, ward long, seat string")
    coverage = spark.createDataFrame([(1, "Z", True), (2, "A", True), (2, "B", False), (3, "A", False), (3, "B", False)], "body long, seat string, whole boolean")
    shares = placement.body_shares(wards, coverage)
    assert rows_of(shares, "body", "seat", "weight") == [(1, "A", pytest.approx(2 / 3)), (1, "B", pytest.approx(1 / 3)), (2, "A", 1.0), (3, "A", 0.5), (3, "B", 0.5)]
    lists = spark.createDataFrame([("t", "1; 2;77"), ("u", "77")], "key string, bodies string")
    assert rows_of(placement.listed_bodies(lists, shares), "key", "seat", "weight") == [("t", "A", pytest.approx(5 / 6)), ("t", "B", pytest.approx(1 / 6))]


def test_tiers_guard_neighbours_and_overrides(spark):
    units = spark.createDataFrame([(i, 1, "s", d, sub, route, 9, 100) for i, d, sub, route in [(1, 1, 1, "village"), (2, 1, 1, "village"), (3, 2, 2, "village"), (4, 2, 2, "town"), (5, 2, 2, "village"), (6, 1, 1, "village"), (7, 3, 3, "village")]], UNITS)
    known = placement.lookups(code=spark.createDataFrame([("1", "A", 0.5), ("1", "B", 0.5), ("3", "A", 0.9), ("3", "B", 0.1), (None, "X", 1.0)], "key string, seat string, weight double"), name=spark.createDataFrame([("s", "C", 1.0)], "key string, seat string, weight double"))
    tiers = [("code", "code", F.col("unit")), ("name", "name", F.when(F.col("unit") == 6, F.col("s")))]
    first = placement.by_first_tier(units, known, tiers)
    assert rows_of(first, "unit", "seat", "weight", "method") == [(1, "A", 0.5, "code"), (1, "B", 0.5, "code"), (3, "A", 0.9, "code"), (3, "B", 0.1, "code"), (6, "C", 1.0, "name")]
    allowed = spark.createDataFrame([("A", 1), ("A", 2), ("C", 2), ("B", 2)], "seat string, district long")
    guarded = placement.guarded(first, units, allowed)
    assert rows_of(guarded, "unit", "seat", "weight") == [(1, "A", 1.0), (3, "A", 0.9), (3, "B", 0.1)]
    more = placement.by_neighbours(units, guarded, ["s", "district", "subdistrict"])
    # Nearly all placed people of sub-district 1 are A's; of 2 they are parted, which a town is not.
    assert rows_of(more, "unit", "seat", "weight", "method") == [(2, "A", 1.0, "subdistrict"), (5, "A", 0.9, "subdistrict-split"), (5, "B", 0.1, "subdistrict-split"), (6, "A", 1.0, "subdistrict")]
    whole = placement.overridden(guarded.unionByName(more), spark.createDataFrame([(2, "Z", 1.0, "ward")], "unit long, seat string, weight double, method string"))
    assert rows_of(whole.where("unit = 2"), "seat", "method") == [("Z", "ward")]
    sums = {r.unit: r.w for r in placement.with_unplaced(units, whole).groupBy("unit").agg(F.sum("weight").alias("w")).collect()}
    assert sums == {1: 1.0, 2: 1.0, 3: 1.0, 4: None, 5: 1.0, 6: 1.0, 7: None}
    report = {r.method: (r.units, r.people) for r in placement.method_report(units, whole, ["s"]).collect()}
    assert report == {"code": (2, 200), "subdistrict": (1, 100), "subdistrict-split": (1, 100), "ward": (1, 100), "none": (2, 200)}


def test_towns_are_shared_by_electors(spark):
    units = spark.createDataFrame([(1, 1, "s", 1, 1, "town", 9, 100), (2, 1, "s", 2, 1, "town", 9, 100), (3, 1, "s", 1, 1, "village", 0, 100), (4, 1, "s", 1, 1, "village", 0, 200)], UNITS)
    placed = spark.createDataFrame([(1, "A", 0.1, "town-code"), (1, "B", 0.9, "town-code"), (2, "A", 1.0, "town-code"), (3, "C", 1.0, "village-code"), (4, "A", 1.0, "village-code")], "unit long, seat string, weight double, method string")
    electors = spark.createDataFrame([("A", 200), ("B", 100), ("C", 50)], "seat string, e long")
    got = rows_of(placement.by_electors(placed, units, electors), "unit", "seat", "weight")
    # Half of C's people are electors. A has 200 electors, 100 of them elsewhere; B's 100 are all in town: equal parts, whatever the weights.
    assert got == [(1, "A", 0.5), (1, "B", 0.5), (2, "A", 1.0), (3, "C", 1.0), (4, "A", 1.0)]
    none = rows_of(placement.by_electors(placed, units, electors.limit(0)), "unit", "seat", "weight")
    assert none[:2] == [(1, "A", pytest.approx(1 / 1.9)), (1, "B", pytest.approx(0.9 / 1.9))]


def test_nothing_to_place(spark):
    units = spark.createDataFrame([], UNITS)
    known = placement.lookups(code=spark.createDataFrame([], "key string, seat string, weight double"))
    placed = placement.by_first_tier(units, known, [("code", "code", F.col("unit"))])
    assert placement.with_unplaced(units, placement.overridden(placed, placed)).count() == 0


def test_extents_name_towns_by_whole_words(spark):
    texts = [("X", "1", "Ludhiana (M Corp.) - Ward No. 1 to 9, Ramnagar (MCl)"), ("X", "2", "LUDHIANA(M) and Jalgaon Jamod (M Cl)"), ("X", "3", "Ludhiana Tehsil (Part), nagar"), ("Y", "4", "Ludhiana (NAC)"), ("X", "5", None), ("X", "6", "(M Corp) St. Mary's-Town (CB)")]
    towns = [("X", 1, "Ludhiana (M Corp.)"), ("X", 2, "Nagar"), ("X", 3, "Jalgaon (M Cl)"), ("X", 4, "Jalgaon Jamod"), ("X", 5, "Jo"), ("X", 6, None), ("X", 7, "St Mary S Town")]
    got = extents.towns_named(spark.createDataFrame(texts, "s string, seat string, extent string"), spark.createDataFrame(towns, "s string, town int, name string"), ["s"], "seat", "extent", "town", "name")
    assert rows_of(got, "seat", "town") == [("1", 1), ("2", 1), ("2", 4), ("6", 7)]
    assert extents.towns_named(spark.createDataFrame([], "s string, seat string, extent string"), spark.createDataFrame([], "s string, town int, name string"), ["s"], "seat", "extent", "town", "name").count() == 0


def test_large_towns_of_one_seat_are_spread(spark):
    units = spark.createDataFrame([(i, 1, "s", d, 1, route, t, 100_000) for i, d, route, t in [(1, 1, "town", 7), (2, 1, "town", 7), (3, 1, "town", 8), (4, 1, "village", 0), (5, 1, "town", 9), (6, 1, "town", 9)]], UNITS)
    placed = spark.createDataFrame([(1, "A", 1.0, "town-code"), (2, "A", 1.0, "town-code"), (3, "A", 1.0, "town-code"), (4, "A", 1.0, "village-code"), (5, "A", 1.0, "town-code"), (6, "B", 1.0, "town-code")], "unit long, seat string, weight double, method string")
    named = spark.createDataFrame([("A", 7), ("B", 7), ("C", 7), ("A", 8), ("B", 8), ("A", 9), ("B", 9)], "seat string, town long")
    districts = spark.createDataFrame([("C", 2), ("B", 1)], "seat string, district long")
    got = rows_of(extents.spread_towns(placed, units, named, districts), "unit", "seat", "weight")
    # 8 is too small, 9 lies in two seats already; C has no part in district 1.
    assert got == [(1, "A", 0.5), (1, "B", 0.5), (2, "A", 0.5), (2, "B", 0.5), (3, "A", 1.0), (4, "A", 1.0), (5, "A", 1.0), (6, "B", 1.0)]


def test_extent_classes(spark):
    rows = spark.createDataFrame([("Ward No. 1 and village x",), ("Patwar circle y (Part)",), ("Tehsil z (Part)",), ("Tehsils a and b",), ("E.B.No 7",)], "e string")
    assert [r[0] for r in rows.select(extents.extent_class(F.col("e"))).collect()] == ["C", "B", "B2", "A", "C"]


def test_notes_name_further_districts(spark):
    rows = [(1, "also_2011=101;102; more"), (2, "also_2011=101 - a sliver; possible_2011=103;104"), (3, "ALSO_DISTRICT=SERCHHIP(105) ALSO_DISTRICT=X Y (106)"), (4, "Bihar: 2011 codes 107 + 108"), (5, "also_in_district_2008=West Sikkim; also_2011=999"), (6, None), (7, "also_2011=;")]
    names = spark.createDataFrame([("WEST SIKKIM", 109), ("WEST SIKKIM", 110)], "name string, code int")
    known = spark.createDataFrame([(i,) for i in range(101, 111)], "code int")
    got = rows_of(extents.noted_districts(spark.createDataFrame(rows, "k int, note string"), "k", "note", names, known), "k", "code")
    assert got == [(1, 101), (1, 102), (2, 103), (2, 104), (3, 105), (3, 106), (4, 107), (4, 108), (5, 109), (5, 110)]
