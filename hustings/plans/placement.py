"""Which seats the units of a directory lie in: all tiers of placement, one after the other.

What later tiers read several times is persisted: on disk where memory ends, made again from its lineage where an executor
is lost.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.operators import linkage, placement
from hustings.sources.directory import Directory

LEVELS = (("Village", "village"), ("SubDistrict", "subdistrict"), ("District", "district"))


class Placement:
    def __init__(self, directory: Directory):
        self.directory = directory

    @cached_property
    def villages(self) -> DataFrame:
        return placement.deepest_coverage(self.directory.villages, self.directory.coverage, LEVELS)

    @cached_property
    def bodies(self) -> DataFrame:
        return placement.body_shares(self.directory.ward_seats, self.directory.body_coverage).persist()

    @cached_property
    def known(self) -> DataFrame:
        """What units are looked up in: villages by code; towns by code, by list, by name; seats by a town's name."""
        d, named = self.directory, F.concat_ws("|", F.col("state").cast("string"), "town_name")
        coded = placement.first_of(d.bodies.where("census is not null"), "census", "body").select(F.col("census").alias("key"), "body").join(self.bodies, "body")
        by_name = placement.first_of(d.bodies.join(self.bodies.select("body").distinct(), "body").withColumn("key", named), "key", "body").select("key", "body").join(self.bodies, "body")
        namesake = linkage.unambiguous(d.seat_names.withColumn("key", named), ["key"], "seat").withColumn("weight", F.lit(1.0))
        return placement.lookups(village=self.villages, town=coded, alias=placement.listed_bodies(d.aliases, self.bodies), name=by_name, namesake=namesake)

    @cached_property
    def by_directory(self) -> DataFrame:
        """By code, list, name or namesake, without seats that have no part in the unit's district."""
        town = lambda key: F.when(F.col("route") == "town", key)
        named = F.concat_ws("|", F.col("state").cast("string"), "town_name")
        rural = [(f"{route}-code", "village", F.when(F.col("route") == route, F.col("key"))) for route in ("village", "og", "ct")]
        tiers = [*rural, ("town-code", "town", town(F.col("key"))), ("town-alias", "alias", town(F.col("key"))), ("town-name", "name", town(named)), ("town-namesake", "namesake", town(named))]
        return placement.guarded(placement.by_first_tier(self.directory.units, self.known, tiers), self.directory.units, self.directory.allowed).persist()

    @cached_property
    def placed(self) -> DataFrame:
        """With units that only their sub-district tells of, and with official lists in place of all else."""
        units = self.directory.units
        whole = self.by_directory.unionByName(placement.by_neighbours(units, self.by_directory, ["s", "district", "subdistrict"]))
        key = lambda *c: F.concat_ws("|", *[F.col(x).cast("string") for x in c])
        ward = F.when(F.col("route") == "town", key("s", "district", "town", "unit"))
        tiers = [("city-ward", "ward", ward), ("order-town", "town", F.when(F.col("route") == "town", key("s", "town"))), ("order-subdistrict", "sub", F.when(F.col("route") != "town", key("s", "subdistrict")))]
        return placement.overridden(whole, placement.by_first_tier(units, self.directory.overrides, tiers)).persist()

    @cached_property
    def shared(self) -> DataFrame:
        """Towns in several seats shared by electors."""
        return placement.by_electors(self.placed, self.directory.units, self.directory.electors)
