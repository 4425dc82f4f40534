"""Numbers and names of seats that collide or are missing: fill from neighbours, new numbers for displaced seats."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.operators.board import plain

PASSES, REACH = 3, 4


def fill_in_order(known: dict[int, str | None], passes: int, reach: int) -> dict[int, str | None]:
    """Values by number, those that are None filled from neighbours, lowest number first; known is changed."""
    for _ in range(passes):
        for n in sorted(n for n, v in known.items() if v is None):
            for d in range(1, reach + 1):
                near = {v for v in (known.get(n - d), known.get(n + d)) if v is not None}
                if len(near) == 1:
                    known[n] = near.pop()
                    break
    return known


def neighbour_fill(rows: DataFrame, keys: Sequence[str], number: str, value: str, passes: int = PASSES, reach: int = REACH) -> DataFrame:
    """rows (keys, number, value) with null values filled from the nearest numbers, in order, so many times over.

    A seat takes the value of the seats d below and above it, for the least d where they don't disagree, up to `reach`; seats
    below may have been filled in the same pass. What is filled depends on numbers within reach only, so open numbers more
    than that apart are filled independently: stretches of open numbers go to tasks, with the known values around them, not
    whole states. Of a repeated number the smallest value counts.
    """
    one = rows.groupBy(*keys, number).agg(F.min(value).alias(value))
    unfilled = one.where(F.col(value).isNull()).select(*keys, number)
    in_order = Window.partitionBy(*keys).orderBy(number)
    starts = F.coalesce((F.col(number) - F.lag(number).over(in_order) > reach).cast("int"), F.lit(1))
    stretches = unfilled.withColumn("starts", starts).withColumn("stretch", F.sum("starts").over(in_order)).select(*keys, number, "stretch")
    around = stretches.select(*keys, "stretch", F.explode(F.sequence(F.col(number) - reach, F.col(number) + reach)).alias(number)).distinct()
    parts = around.join(one, [*keys, number])

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        was = {int(n): None if pd.isna(v) else v for n, v in zip(part[number], part[value], strict=True)}
        done = fill_in_order(dict(was), passes, reach)
        filled = part[[was[int(n)] is None for n in part[number]]]
        return filled[[*keys, number]].assign(filled=[done[int(n)] for n in filled[number]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in one.select(*keys, number).schema.fields)
    filled = parts.groupBy(*keys, "stretch").applyInPandas(fill, f"{fields}, filled string")
    return one.join(filled, [*keys, number], "left").select(*keys, number, F.coalesce(value, "filled").alias(value))


def running(rows: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, inclusive: bool) -> DataFrame:
    """rows with `before`: how many marks of their keys lie below `at` (or at it, if inclusive)."""
    order = F.when(F.col("mark"), 0 if inclusive else 1).otherwise(1 if inclusive else 0)
    both = rows.withColumn("mark", F.lit(False)).unionByName(marks.select(*keys, at).withColumn("mark", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("before", F.count_if("mark").over(w)).where("not mark").drop("mark")


def renumbered(rows: DataFrame, official: DataFrame, keys: Sequence[str], number: str, name: str, order: str) -> DataFrame:
    """keys, number, name, new_number and how (kept, official, next) of every seat of rows, a seat being a number and a plain name.

    The first seat at a number keeps it. Others go to the number that `official` (keys, name, number) has for their name, if it
    has one only and no other seat holds that; else to the next free number above their own, in the order of numbers. The
    k-th of these takes, in the row of free numbers, the place after the (k-1)-th's, or that of its own number if that is
    later: a running maximum of places less k. Places turn into numbers by counting held numbers below. So no two seats have
    one number, and no number is tried.
    """
    seats = rows.withColumn("plain", plain(name)).groupBy(*keys, number, "plain").agg(F.min_by(name, order).alias(name), F.min(order).alias("first"))
    at = Window.partitionBy(*keys, number).orderBy("first", "plain")
    ranked = seats.withColumn("nth", F.row_number().over(at))
    kept = ranked.where("nth = 1").drop("nth").withColumn("new_number", F.col(number)).withColumn("how", F.lit("kept"))
    displaced = ranked.where("nth > 1").drop("nth")
    only = official.withColumn("plain", plain(name)).groupBy(*keys, "plain").agg(F.count_distinct(number).alias("numbers"), F.min(number).alias("new_number")).where("numbers = 1 and plain != ''").drop("numbers")
    holder = kept.select(*keys, F.col(number).alias("new_number"), F.col("plain").alias("holder"))
    claims = displaced.join(only, [*keys, "plain"]).join(holder, [*keys, "new_number"], "left").where("holder is null or holder = plain")
    first = F.first("plain").over(Window.partitionBy(*keys, "new_number").orderBy("first", "plain"))
    moved = claims.withColumn("winner", first).where("plain = winner").drop("winner", "holder").withColumn("how", F.lit("official"))
    rest = displaced.join(moved.select(*keys, number, "plain"), [*keys, number, "plain"], "left_anti")
    held = kept.select(*keys, F.col("new_number").alias(number)).unionByName(moved.select(*keys, F.col("new_number").alias(number))).distinct()
    in_order = Window.partitionBy(*keys).orderBy(number, "first", "plain")
    asking = running(rest, held, keys, number, inclusive=False).withColumn("k", F.row_number().over(in_order))
    place = F.col("k") + F.max(F.col(number) - F.col("before") - F.col("k")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = asking.withColumn("place", place.cast("long")).drop("before")
    gaps = held.select(*keys, (F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number)) + 1).cast("long").alias("place"))
    found = running(placed, gaps, keys, "place", inclusive=True)
    following = found.withColumn("new_number", (F.col("place") + F.col("before")).cast(dict(rows.dtypes)[number])).withColumn("how", F.lit("next"))
    columns = [*keys, number, name, "new_number", "how"]
    return kept.select(*columns).unionByName(moved.select(*columns)).unionByName(following.select(*columns))


def with_new_numbers(rows: DataFrame, seats: DataFrame, keys: Sequence[str], number: str, name: str) -> DataFrame:
    """rows with their seat's new number (seats: of renumbered())."""
    known = seats.withColumn("plain", plain(name)).select(*keys, number, "plain", "new_number")
    return rows.withColumn("plain", plain(name)).join(known, [*keys, number, "plain"], "left").drop("plain")
