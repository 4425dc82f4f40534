"""Fill-in-middle transformation by counted quantifiers. DataFrame functions only.

A text is a row of units: a run of letters, or one other character. regexp_count tells how many, two hashes tell where the
middle begins and ends, and each row gets a pattern of its own, whose possessive counted groups take the units of prefix
and middle; one match gives all three parts. Possessive groups never step back, so long texts need no deep stack. No row
needs another one: there is no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import text_or_empty

#: One unit of a text.
UNIT = "(?:[A-Za-z]+|[^A-Za-z])"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Format:
    """Sentinels before prefix, suffix and middle (none may be the end of one and the start of another); of 100 texts,
    how many are transformed, and of 100 of these, how many have the suffix first; the seed of the hashes."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    transformed: int = 90
    suffix_first: int = 20
    seed: str = "1"


def hashed(key: Column, nth: int) -> Column:
    """The nth group of 8 hex digits (from 0) of the key's SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 1 + 8 * nth, 8), 16, 10).cast("long")


def literal(text: str) -> str:
    """The text as a pattern."""
    return f"\\Q{text}\\E"


def inserted(text: str) -> str:
    """The text as part of what a pattern is replaced by."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def transformed(docs: DataFrame, style: Format = Format()) -> DataFrame:
    """doc_id, text, n (units), form, prefix, middle, suffix (null if plain) and output of every document.

    A null text counts as empty, and empty texts are plain, as are texts that hold a sentinel. A null doc_id hashes like
    an empty one; repeated rows give repeated rows, other columns are ignored, an empty table gives an empty result.
    """
    key = F.concat(F.lit(f"{style.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    cut = lambda nth: hashed(key, nth) % (F.col("n") + 1)
    holds = F.col("text").contains(style.prefix) | F.col("text").contains(style.suffix) | F.col("text").contains(style.middle)
    plain = (F.col("text") == "") | holds | (hashed(key, 2) % 100 >= style.transformed)
    form = F.when(plain, PLAIN).when(hashed(key, 3) % 100 < style.suffix_first, SPM).otherwise(PSM)
    rows = texts.withColumns({"form": form, "begins": F.least(cut(0), cut(1)), "ends": F.greatest(cut(0), cut(1))})
    pattern = F.concat(F.lit(f"(?s)\\A({UNIT}{{"), F.col("begins"), F.lit(f"}}+)({UNIT}{{"), F.col("ends") - F.col("begins"), F.lit("}+)(.*)\\z"))
    # No text that gets here holds the sentinel, so it can part what the one match has found.
    parts = F.when(F.col("form") != PLAIN, F.split(F.regexp_replace("text", pattern, F.lit(f"$1{inserted(style.prefix)}$2{inserted(style.prefix)}$3")), literal(style.prefix), -1))
    rows = rows.withColumn("parts", parts).select("doc_id", "text", "n", "form", *[F.get("parts", F.lit(i)).alias(part) for i, part in enumerate(("prefix", "middle", "suffix"))])
    p, s, m = (F.lit(x) for x in (style.prefix, style.suffix, style.middle))
    output = F.when(F.col("form") == PSM, F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == SPM, F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("text"))
    return rows.withColumn("output", output)


def restored(output: Column, form: Column, style: Format = Format()) -> Column:
    """The text, from output and form alone."""
    p, s, m = (literal(x) for x in (style.prefix, style.suffix, style.middle))
    psm = F.regexp_replace(output, F.lit(f"(?s)\\A{p}(.*?){s}(.*?){m}(.*)\\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)\\A{s}(.*?){p}(.*?){m}(.*)\\z"), F.lit("$2$3$1"))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def digests(docs: DataFrame, style: Format = Format()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every document; see transformed()."""
    rows = transformed(docs, style)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    chars = lambda c: F.char_length(c).cast("long")
    return rows.select("doc_id", "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"), style)).alias("restored_sha256"))


def digests_sql() -> str:
    """The same rows in DuckDB SQL: units as a list, parts as its slices."""
    h = lambda nth: f"CAST(concat('0x', substr(h, {1 + 8 * nth}, 8)) AS BIGINT)"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('1:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, {h(0)} AS h1, {h(1)} AS h2, {h(2)} AS h3, {h(3)} AS h4 FROM t),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
b AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM c),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM b)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) WHEN 'spm' THEN concat('<S>', suffix, '<P>', prefix, '<M>', middle) ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
