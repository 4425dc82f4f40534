"""License scans: positional rare-token index. DataFrame functions only.

Templates are licence sentences with a mandatory key phrase. How many documents hold each word of the key phrases is
counted over the corpus; the two words of highest inverse document frequency of each key phrase are its index tokens. In
a file, all places of index tokens are looked up. Where one stands and the phrase's other one stands at the same
relative position, the postings meet: the place is a candidate, the whole key phrase is verified there, and the share of
the template's words that stand at their places is its score. Everything happens within a document's row; only the
counts, of fixed number, are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """words: a licence sentence, lower case; key: its mandatory phrase; base: whether the contract counts its places."""

    label: str
    words: str
    key: str
    base: bool = False

    @property
    def key_at(self) -> int:
        words, key = self.words.split(), self.key.split()
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


#: The contract's phrases, then sentences of public licences.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", "cc by nc", base=True),
    Template("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
)

#: Words are runs of these characters; A-Z are lower-cased first.
WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"


def lowered(word: Column) -> Column:
    """A-Z of an ASCII word lower-cased; a word with other characters matches no template and stays."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(word)


def in_words(docs: DataFrame) -> DataFrame:
    found = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("words"))


def key_words(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.key.split()})


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """How many documents hold each key word: a number for each of a fixed set of words."""
    words = key_words(templates)
    held = F.array_distinct(F.filter(F.transform("words", lowered), lambda w: w.isin(words)))
    counts = in_words(docs).select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return dict.fromkeys(words, 0) | {r["word"]: r["n"] for r in counts.collect()}


def index_tokens(t: Template, frequency: dict[str, int]) -> list[tuple[str, int]]:
    """The two words of the key phrase in the fewest documents, with their places in it; ties to the earlier one."""
    places = {w: i for i, w in reversed(list(enumerate(t.key.split())))}
    rare = sorted(places, key=lambda w: (frequency[w], places[w]))[:2]
    return [(w, places[w]) for w in rare]


def candidates(t: Template, frequency: dict[str, int]) -> Column:
    """array<struct<label, base, start, score>>: the verified places of one template. Needs words and hits."""
    (first, at), *other = index_tokens(t, frequency)
    word = lambda i: F.coalesce(lowered(F.get(F.col("words"), i)), F.lit(""))
    starts = F.transform(F.filter("hits", lambda h: h["word"] == first), lambda h: h["at"] - at)
    if other:
        (second, its_at), *_ = other
        starts = F.filter(starts, lambda s: (s >= 0) & (word(s + its_at) == second))
    whole = lambda s: reduce(lambda a, b: a & b, [word(s + i) == w for i, w in enumerate(t.key.split())])
    verified = F.filter(starts, lambda s: (s >= 0) & whole(s))
    total = t.words.split()
    matched = lambda s: reduce(lambda a, b: a + b, [F.when(word(s - t.key_at + i) == w, 1).otherwise(0) for i, w in enumerate(total)])
    return F.transform(verified, lambda s: F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), s.cast("long").alias("start"), (matched(s) / F.lit(len(total))).alias("score")))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest start. labels
    are those of all verified templates, distinct, sorted, comma-joined. score is the largest share of a verified
    template's words that stand at their places: 1 for a base phrase, 0 without any licence.

    A null text counts as empty: no words, empty labels, score 0. A null doc_id stays null, repeated rows give repeated
    rows, other columns are ignored, an empty table gives an empty result.
    """
    frequency = document_frequencies(docs, templates)
    wanted = sorted({w for t in templates for w, _ in index_tokens(t, frequency)[:1]})
    placed = F.transform("words", lambda w, i: F.struct(i.alias("at"), lowered(w).alias("word")))
    hits = in_words(docs).select("doc_id", "words", F.filter(placed, lambda h: h["word"].isin(wanted)).alias("hits"))
    every = F.flatten(F.array(*[candidates(t, frequency) for t in templates]))
    found = hits.select("doc_id", F.size("words").cast("long").alias("n_words"), every.alias("found"))
    base = found.select("*", F.filter("found", lambda x: x["base"]).alias("places"))
    starts = F.transform("places", lambda x: x["start"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    return base.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names("places").alias("base_labels"), names("found").alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def scan_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same rows in DuckDB SQL."""
    found = []
    for t in templates:
        key, words = t.key.split(), t.words.split()
        whole = " AND ".join(f"w[s + {i}] = '{w}'" for i, w in enumerate(key))
        share = " + ".join(f"CASE WHEN s + {i - t.key_at} >= 1 AND w[greatest(s + {i - t.key_at}, 1)] = '{w}' THEN 1 ELSE 0 END" for i, w in enumerate(words))
        found.append(f"SELECT rid, '{t.label}' AS label, {str(t.base).lower()} AS base, s - 1 AS start, CAST({share} AS DOUBLE) / {len(words)} AS score FROM starts WHERE {whole}")
    first = ", ".join(f"'{w}'" for w in sorted({t.key.split()[0] for t in templates}))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
starts AS (SELECT rid, w, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ({first}))) AS s FROM d),
found AS ({" UNION ALL ".join(found)}),
folded AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM found GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(f.n_base, 0) AS n_base, f.first_word, f.last_word, coalesce(f.base_labels, '') AS base_labels, coalesce(f.labels, '') AS labels, coalesce(f.score, 0.0) AS score FROM d LEFT JOIN folded f USING (rid)"""
