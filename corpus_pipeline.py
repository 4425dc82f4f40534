"""From raw documents to packed training sequences; each stage is an operator of the llm subpackage.

Every stage works on all that its predecessor kept. The first four return the columns of documents; n_chars follows the
text. Decisions are made row by row, so rows whose doc_id is null or repeated are documents like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.llm import language, packing, simhash, suffixes, toxicity
from hustings.llm.common import table, text_or_empty, written
from hustings.llm.queries import word_vocabulary
from hustings.shipping import ship

#: Documents whose language is told with a lower score go, as those without a letter do.
LEAST_LANGUAGE_SCORE = 0.5
#: Near copies: words of a shingle and least Jaccard similarity of their sets.
SHINGLE_WORDS, LEAST_SIMILARITY = 5, 0.8
#: Bytes of a repeated passage: those of 51 words of two letters and a space, about.
PASSAGE_BYTES = 150
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame) -> DataFrame:
    """(row: all columns of documents, text) for what decides by the text alone."""
    return docs.select(F.struct(*COLUMNS).alias("row"), text_or_empty().alias("text"))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written, so that it stays the same."""
    return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = language.train(docs.where(~language.held_out(F.col("doc_id"), 5, 0)).select("doc_id", "text", "lang"))
    told = language.predictions(_with_text(docs), model)
    return told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.predictions(_with_text(docs), model).where("predicted = 0").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that with the smallest doc_id, of these the first. A null doc_id stays only if all are null."""
    ship(spark)
    rows = _numbered(docs)
    most = rows.count()
    found = simhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), words=SHINGLE_WORDS, least=LEAST_SIMILARITY)
    named = rows.select("row", "doc_id").join(found.select(F.col("doc_id").alias("row"), "component_id"), "row")
    named = written(named, "named", most)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "row")).alias("first")).select("component_id", F.col("first.row").alias("stays"))
    others = written(named.join(first, "component_id").where("row != stays").select("row"), "copies", most)
    return rows.join(others, "row", "left_anti").select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; a character that loses some of its bytes goes with them. No document goes, even if nothing of it is left."""
    ship(spark)
    rows = _numbered(docs)
    kept = suffixes.remove(rows.select(F.col("row").alias("doc_id"), "text"), PASSAGE_BYTES).where("n_removed > 0").select(F.col("doc_id").alias("row"), F.try_validate_utf8("kept").alias("sound"), "kept")
    text = F.coalesce("sound", F.regexp_replace(F.make_valid_utf8("kept"), "\ufffd", ""))
    changed = written(kept.select("row", text.alias("left_text")), "shortened")
    joined = rows.join(changed, "row", "left").withColumn("text", F.coalesce("left_text", "text"))
    return joined.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, word_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffixes", suffix_stage),
    ("packing", packing_stage),
]

#: Language, toxicity and tokens can't be told in SQL. The tests hold the kept rows and texts of each stage against brute force, given the models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
