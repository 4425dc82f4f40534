"""The tables that contest queries start from, each a lazy plan over one folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.operators import resolve, rollup
from hustings.sources import contests as source
from hustings.sources import units as unit_source

#: The year of active snapshots, and the one before.
YEAR = 2000
BEFORE = 1999


class Contests:
    """The derived tables of one folder; each is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def cand(self) -> DataFrame:
        return source.candidates(self.spark, self.sf_dir)

    @cached_property
    def seats(self) -> DataFrame:
        return source.labelled(resolve.contests(self.cand))

    @cached_property
    def active(self) -> DataFrame:
        return resolve.active(self.seats, YEAR)

    @cached_property
    def history(self) -> DataFrame:
        return resolve.with_previous(self.seats)

    @cached_property
    def changed(self) -> DataFrame:
        return resolve.changes(self.seats, YEAR)

    @cached_property
    def summary(self) -> DataFrame:
        return rollup.party_summary(self.cand)

    @cached_property
    def national(self) -> DataFrame:
        return rollup.national_summary(self.summary)

    @cached_property
    def bypolls(self) -> DataFrame:
        """By-elections with the seat's recorded winner of the same year as previous holder."""
        by = source.labelled(resolve.contests(source.bypoll_candidates(self.spark, self.sf_dir)))
        held = self.seats.select("arena", "s", "y", "n", F.col("p").alias("prev"))
        kept = F.when(F.col("prev").isNotNull(), F.when(F.col("prev") == F.col("p"), "Y").otherwise("N"))
        return by.join(held, ["arena", "s", "y", "n"], "left").withColumn("ret", kept).withColumn("mo", 1 + F.col("n") % 12)

    @cached_property
    def parents(self) -> DataFrame:
        return source.parents(self.spark, self.sf_dir)

    @cached_property
    def electors(self) -> DataFrame:
        """Electors and voters of every contest, with counts by gender that don't always add up."""
        e = F.col("total") * 2 + F.when(F.col("n") == 6, 0).otherwise(F.col("n") * 10)
        rows = self.seats.select("arena", "s", "y", "n", "j", e.alias("e"), (F.col("total") * F.when(F.col("n") == 5, 3).otherwise(1)).alias("voters"))
        return rows.withColumn("men", F.floor(F.col("e") * 0.52).cast("long")).withColumn("women", F.col("e") - F.floor(F.col("e") * 0.52).cast("long") - F.when(F.col("n") == 4, 200).otherwise(0))

    @cached_property
    def units(self) -> DataFrame:
        """Small places with their seats."""
        return unit_source.units(self.spark, self.sf_dir)

    @cached_property
    def frame(self) -> DataFrame:
        """Electors of the seats in one year: those that placed people are held against."""
        return self.electors.where("arena = 'AE' and y = 1997").groupBy("s", "n").agg(F.sum("e").alias("e"))
