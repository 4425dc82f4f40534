"""A directory of places and what it says of seats, derived from customers and nations, with the gaps and slips of real ones:
villages parted since the census, towns without a code, renamed towns, seats in districts they have no part in."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.functions.canon import town_name
from hustings.sources.contests import table


def seat_of(state: str, number: str) -> Column:
    return F.concat(F.col(state), F.lit("|"), F.expr(f"cast({number} as string)"))


class Directory:
    """The derived tables of one folder; each is a lazy plan. k is the customer's number, b the nation's."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("b"), F.col("n_name").alias("s"))
        numbers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")).withColumn("b", F.expr("(k div 10) % 25"))
        self.places = numbers.join(self.nations, "b").withColumns({"d": F.expr("k % 4"), "sub": F.expr("k % 12"), "t": F.expr("1000 + b * 2 + k % 2")})

    @cached_property
    def units(self) -> DataFrame:
        """unit, state, s, district, subdistrict, route, key, town, town_name, pop: what a census counts."""
        route = F.expr("case when k % 3 != 0 then 'village' when k % 9 = 0 then 'town' when k % 6 = 3 then 'og' else 'ct' end")
        key = F.expr("case when k % 3 = 0 and k % 9 != 0 and k % 6 = 3 then k - 1 when k % 9 = 0 then t else k end").cast("string")
        name = F.concat("s", F.expr("case when k % 2 = 0 then ' Municipal Corporation' else ' East (M Cl)' end"))
        return self.places.select(F.col("k").alias("unit"), F.col("b").alias("state"), "s", F.col("d").alias("district"), F.col("sub").alias("subdistrict"), route.alias("route"), key.alias("key"), F.col("t").alias("town"), town_name(name).alias("town_name"), F.expr("200 + (k * 37) % 900").alias("pop"))

    @cached_property
    def villages(self) -> DataFrame:
        """village, census, and the codes of what it lies in; some villages were one with another at the census."""
        return self.places.select(F.col("k").alias("village"), F.expr("case when k % 7 = 1 and k % 10 != 0 then k - 1 else k end").alias("census"), F.concat_ws("|", "s", "sub").alias("subdistrict"), F.concat_ws("|", "s", "d").alias("district"))

    @cached_property
    def coverage(self) -> DataFrame:
        """level, code, seat, whole."""
        village = lambda n, where: self.places.where(where).select(F.lit("Village").alias("level"), F.col("k").cast("string").alias("code"), seat_of("s", n).alias("seat"), F.lit(False).alias("whole"))
        subs = self.nations.select("b", "s", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("sub")).where("(b + sub) % 3 != 2")
        districts = self.nations.select("b", "s", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("d")).where("(b + d) % 2 = 0")
        return (
            village("1 + k % 6", "k % 5 in (1, 2, 3)")
            .unionByName(village("1 + (k + 1) % 6", "k % 5 = 2"))
            .unionByName(subs.select(F.lit("SubDistrict").alias("level"), F.concat_ws("|", "s", "sub").alias("code"), seat_of("s", "1 + sub % 6").alias("seat"), F.expr("(b + sub) % 3 = 0").alias("whole")))
            .unionByName(districts.select(F.lit("District").alias("level"), F.concat_ws("|", "s", "d").alias("code"), seat_of("s", "1 + d").alias("seat"), F.lit(True).alias("whole")))
        )

    @cached_property
    def towns(self) -> DataFrame:
        """b, s, t: the towns that have wards."""
        return self.places.where("k % 9 = 0").select("b", "s", "t").distinct()

    @cached_property
    def bodies(self) -> DataFrame:
        """body, census (some null), state, town_name (some renamed)."""
        name = F.expr("case t % 5 when 3 then concat('Renamed ', s) when 4 then concat('Gone ', s) else concat(s, if(t % 2 = 0, '', ' East'), ' Nagar Palika') end")
        return self.towns.select((F.col("t") + 5000).alias("body"), F.expr("if(t % 5 in (2, 3, 4), null, t)").alias("census"), F.col("b").alias("state"), town_name(name).alias("town_name"))

    @cached_property
    def ward_seats(self) -> DataFrame:
        return self.places.where("k % 9 = 0 and t % 4 != 1").select((F.col("t") + 5000).alias("body"), F.col("k").alias("ward"), seat_of("s", "1 + (k div 9) % 6").alias("seat"))

    @cached_property
    def body_coverage(self) -> DataFrame:
        rows = self.towns.where("t % 4 = 1").withColumn("nth", F.explode(F.array(F.lit(0), F.lit(1))))
        return rows.select((F.col("t") + 5000).alias("body"), seat_of("s", "1 + (b + nth) % 6").alias("seat"), F.expr("nth = 0 and t % 8 = 1").alias("whole"))

    @cached_property
    def aliases(self) -> DataFrame:
        """key (a town's census code) and the bodies that it is now."""
        return self.towns.where("t % 5 = 3").select(F.col("t").cast("string").alias("key"), F.expr("concat(if(t % 2 = 0, t + 1, t - 1) + 5000, '; 9999')").alias("bodies"))

    @cached_property
    def seat_names(self) -> DataFrame:
        """state, seat, town_name: seats with a town's name, some names twice."""
        east = F.concat("s", F.lit(" East"))
        rows = self.nations.where("b % 2 = 0").select("b", seat_of("s", "4").alias("seat"), town_name(east).alias("town_name"))
        return rows.unionByName(self.nations.where("b % 3 = 0").select("b", seat_of("s", "5").alias("seat"), town_name(east).alias("town_name"))).withColumnRenamed("b", "state")

    @cached_property
    def allowed(self) -> DataFrame:
        """seat, district: of seats 1 to 5 the districts that they have a part in."""
        rows = self.nations.select("s", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n")).select("s", "n", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("d"))
        return rows.where("(d + n) % 4 != 3").select(seat_of("s", "n").alias("seat"), F.col("d").cast("long").alias("district"))

    @cached_property
    def overrides(self) -> DataFrame:
        """kind, key, seat, weight of official lists: wards, towns, sub-districts."""
        key = lambda *c: F.concat_ws("|", *[F.col(x).cast("string") for x in c])
        wards = self.places.where("k % 90 = 0").withColumn("n", F.explode(F.array(F.lit(2), F.lit(3)))).select(F.lit("ward").alias("kind"), key("s", "d", "t", "k").alias("key"), seat_of("s", "n").alias("seat"), F.lit(0.5).alias("weight"))
        towns = self.towns.where("t % 7 = 6").select(F.lit("town").alias("kind"), key("s", "t").alias("key"), seat_of("s", "4").alias("seat"), F.lit(1.0).alias("weight"))
        subs = self.nations.where("b % 5 = 0").select(F.lit("sub").alias("kind"), F.concat_ws("|", "s", F.lit("7")).alias("key"), seat_of("s", "6").alias("seat"), F.lit(1.0).alias("weight"))
        return wards.unionByName(towns).unionByName(subs)

    @cached_property
    def electors(self) -> DataFrame:
        """seat, e."""
        return self.nations.select("b", "s", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n")).select(seat_of("s", "n").alias("seat"), F.expr("1000L + (b * 700 + n * 1300) % 9000").alias("e"))

    @cached_property
    def extents(self) -> DataFrame:
        """s, seat, extent: the legal text of every seat."""
        rows = self.nations.select("b", "s", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n"))
        first = F.expr("case (b + n) % 3 when 0 then concat('Ward 1 of ', s, ' (M Corp)') when 1 then concat(s, ' East (M Cl) and Part villages') else concat('Old ', s, ' Town') end")
        return rows.select("s", seat_of("s", "n").alias("seat"), F.concat(first, F.expr("if(n % 2 = 0, concat(', ', s, ' East (NAC) (Part)'), '')")).alias("extent"))

    @cached_property
    def town_list(self) -> DataFrame:
        """s, town, name of every town that has wards."""
        return self.towns.select("s", F.col("t").alias("town"), F.concat("s", F.expr("if(t % 2 = 0, ' (M Corp.)', ' East (M Cl)')")).alias("name"))

    @cached_property
    def notes(self) -> DataFrame:
        """k and note: what parsers of legal texts have noted on a seat."""
        text = "case k % 7 when 0 then concat('also_2011=', k % 30, ';', k % 40) when 1 then concat('x; also_2011=', k % 30, ' - a sliver; possible_2011=', k % 50) when 2 then concat('ALSO_DISTRICT=Some Name(', k % 60, ')') when 3 then concat('see 2011 codes ', k % 20, ' + ', k % 25) when 4 then concat('also_in_district_2008=nation', b % 3, ';') when 5 then concat('also_in_district_2008=East & West; possible_2011=', k % 9) end"
        return self.places.select("k", F.expr(text).alias("note"))
