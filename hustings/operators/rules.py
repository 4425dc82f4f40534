"""Ordered rules as tables: party names and alliances are told by the first row that fits.

A rule table has a priority, columns that a row must equal (null fits all) and a result. Rules that leave the same columns
open are one equality join, so a table costs as many joins as it has such kinds, whatever its length, and no row meets all
rules. Tables are small beside the rows; Spark broadcasts them by their size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Punctuation of code page 1252 that was read as Latin-1, and its proper forms; quotes are made plain, dashes spaces.
QUOTES = {"\x91": "'", "\x92": "'", "‘": "'", "’": "'", "\x93": '"', "\x94": '"', "“": '"', "”": '"'}
DASHES = "\x96\x97–—"
#: Parties that lead an alliance of their own, first first.
ANCHORS = ("BJP", "INC")
INDEPENDENT, INDEPENDENTS, ALONE = "IND", "Independent/Unaligned", "Unaligned"
KEEP = "="


def table(spark: SparkSession, columns: str, rows: Sequence[tuple]) -> DataFrame:
    """A rule table of literal rows, in order of priority."""
    return spark.createDataFrame([(nth, *row) for nth, row in enumerate(rows)], f"priority int, {columns}")


def first_match(rows: DataFrame, rules: DataFrame, on: Sequence[str], result: str) -> DataFrame:
    """rows with the result of the first rule, by priority, whose columns they equal; null if none fits. A null of a row fits open columns only."""
    kinds = [tuple(r) for r in rules.select(*[F.col(c).isNotNull() for c in on]).distinct().collect()]  # 2 ** len(on) at most
    found = []
    for nth, kind in enumerate(sorted(kinds)):
        keys = [c for c, told in zip(on, kind, strict=True) if told]
        of_kind = rules.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() if told else F.col(c).isNull() for c, told in zip(on, kind, strict=True)], F.lit(True)))
        first = of_kind.groupBy(*keys).agg(F.min(F.struct("priority", result)).alias(f"rule_{nth}"))
        rows = rows.join(first, keys, "left") if keys else rows.crossJoin(F.broadcast(first))  # one row: a rule that fits all
        found.append(f"rule_{nth}")
    best = F.least(*found) if len(found) > 1 else F.col(found[0]) if found else F.lit(None)
    return rows.withColumn(result, best[result] if found else F.lit(None).cast("string")).drop(*found)


def party_text(p: Column) -> Column:
    """A party's name without a footnote in brackets at the end, with plain quotes, spaces for dashes, single spaces."""
    bare = F.regexp_replace(F.trim(p), r"\s*\[[^\]]*\]\s*$", "")
    plain = F.translate(bare, "".join(QUOTES), "".join(QUOTES.values()))
    return F.trim(F.regexp_replace(F.translate(plain, DASHES, " " * len(DASHES)), r"\s+", " "))


def looked_up(rows: DataFrame, aliases: DataFrame, step: str, key: Column, epoch: str | None = None) -> DataFrame:
    """rows with `hit`: the code of the step's alias for the key."""
    of_step = aliases.where(F.col("step") == step)
    if epoch is None:
        return rows.withColumn("key", key).join(of_step.groupBy("key").agg(F.min("code").alias("hit")), "key", "left").drop("key")
    codes = of_step.where("epoch is not null").groupBy("key", F.col("epoch").alias(epoch)).agg(F.min("code").alias("hit"))
    return rows.withColumn("key", key).join(codes, ["key", epoch], "left").drop("key")


def standard_parties(rows: DataFrame, party: str, aliases: DataFrame, year: str | None = None) -> DataFrame:
    """rows with `code`, the party's standard code (aliases: step, epoch, key, code).

    Steps, in order: full names in lower case (name); variants of codes (code), twice, as one may stand for another; names
    of later sources (extra), by what is found so far, else by the name as it stands; codes of one year's source (epoch), by
    the name as it stands. A name that none knows stays, cleaned; null and empty stay.
    """
    columns = rows.columns
    told = rows.withColumn("code", party_text(F.col(party)))
    told = looked_up(told, aliases, "name", F.lower("code")).withColumn("code", F.coalesce("hit", "code")).drop("hit")
    for _ in range(2):
        told = looked_up(told, aliases, "code", F.col("code")).withColumn("code", F.coalesce("hit", "code")).drop("hit")
    told = looked_up(told, aliases, "extra", F.lower("code")).withColumnRenamed("hit", "by_code")
    told = looked_up(told, aliases, "extra", F.lower(F.trim(party))).withColumn("code", F.coalesce("by_code", "hit", "code")).drop("hit", "by_code")
    if year is not None:
        told = looked_up(told, aliases, "epoch", F.trim(party), year).withColumn("code", F.coalesce("hit", "code")).drop("hit")
    return told.select(*columns, "code")


def alliance_rules(spark: SparkSession, overrides: Sequence[tuple[str, int, str, str]], folds: Sequence[tuple[str, str]], anchors: Sequence[str] = ANCHORS) -> DataFrame:
    """The rules of standard_alliances(): overrides (s, y, party, label), other names of alliances (lower case, label), anchors."""
    rows: list[tuple] = [(s, y, p, None, None, None, None, label) for s, y, p, label in overrides]
    rows += [(None, None, None, fold, None, None, None, label) for fold, label in folds]
    for party in anchors:
        own = f"{party} Alliance ({party})"
        rows += [(None, None, party, None, None, party, None, KEEP), (None, None, None, None, party, party, None, KEEP), (None, None, party, None, None, None, None, own), (None, None, None, None, party, None, None, own)]
    rows += [(None, None, INDEPENDENT, None, None, None, None, INDEPENDENTS), (None, None, None, None, INDEPENDENT, None, None, INDEPENDENTS), (None, None, None, None, None, None, True, ALONE)]
    return table(spark, "s string, y int, party string, fold string, its_code string, leads string, own boolean, label string", rows)


def standard_alliances(rows: DataFrame, rules: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (s, y, party: a standard code, a: the alliance as told) with `label`.

    In order: overrides; other names of an alliance; an anchor, or what names one as its alliance, keeps an alliance that
    the anchor leads, else has the anchor's own; independents; a party's own name as alliance is none; else as told, empty
    being null.
    """
    columns = rows.columns
    told = standard_parties(rows.withColumn("a_text", F.trim(F.coalesce("a", F.lit("")))), "a_text", aliases).withColumnRenamed("code", "its_code")
    told = told.withColumn("its_code", F.when(F.col("its_code") != "", F.col("its_code"))).withColumn("fold", F.lower("a_text"))
    told = told.withColumn("leads", F.regexp_extract("a_text", r"^(\S+) Alliance", 1)).withColumn("own", F.col("its_code") == F.col("party"))
    found = first_match(told, rules, ["s", "y", "party", "fold", "its_code", "leads", "own"], "label")
    kept = F.when(F.col("a_text") != "", F.col("a_text"))
    return found.withColumn("label", F.when(F.col("label").isNull() | (F.col("label") == KEEP), kept).otherwise(F.col("label"))).select(*columns, "label")


def epoch_alliances(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (arena, s, party) with `label`: the alliance of one year's rules (arena, s, party, label), else none."""
    return first_match(rows, rules, ["arena", "s", "party"], "label").withColumn("label", F.coalesce("label", F.lit(ALONE)))


def junk(p: Column) -> Column:
    """Whether a name is no party: empty, totals and other rows of summaries, votes of all kinds, none of the above."""
    text = F.lower(party_text(F.coalesce(p, F.lit(""))))
    words = text.isin("", "oth", "nota", "others", "total", "other parties and independents")
    return words | text.rlike("valid votes|invalid|blank votes|registered voters|votes cast|vote statistics|turnout|abstention|tendered|none of the above|other parties")
