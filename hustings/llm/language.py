"""Language ID: word-first backoff.

Learnt are, for each language, log frequencies of its words and of its character n-grams, on all labelled documents.
A text is scored word by word: a known word by its log frequency in each language; an unseen one by the longest of its
n-grams that are known, falling back to ever shorter ones where they are not.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from hustings.llm.common import small_batches, text_or_empty

#: Words and n-grams of fewer places, or of less than this share of all places, are unknown. So the model, which is broadcast,
#: is bounded, whatever the number of documents; all places are counted.
LEAST_WORD = 2
LEAST_GRAM = 3
LEAST_SHARE = 1 / 4_000_000
LONGEST = 4
#: Different words that a task counts before it hands them on.
COUNTED_WORDS = 200_000
#: Words that a worker remembers the scores of; when they are more, it starts anew.
MEMO_WORDS = 300_000
#: So many words of evidence are full evidence: the score doesn't grow with longer texts.
EVIDENCE_WORDS = 20

#: Letters and numerals; what is no letter is taken out where a word is met first.
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


@dataclass
class Rows:
    """Rows of log probabilities by unit, a column for each language."""

    at: dict[str, int]
    table: np.ndarray

    def get(self, unit: str) -> np.ndarray | None:
        place = self.at.get(unit)
        return None if place is None else self.table[place]


@dataclass
class Model:
    """Log probabilities of words, and of n-grams by length, from 1 on."""

    languages: list[str]
    words: Rows
    grams: dict[int, Rows] = field(default_factory=dict)
    floor: float = -12.0

    def backoff(self, word: str) -> np.ndarray:
        """Of an unseen word: the mean over its places of the longest known n-gram that begins there."""
        marked = f"<{word}>"
        total, n = np.zeros(len(self.languages)), 0
        for i in range(len(marked) - 1):
            for length in range(min(LONGEST, len(marked) - i), 0, -1):
                row = self.grams[length].get(marked[i : i + length])
                if row is not None:
                    total += row
                    break
            else:
                total += self.floor
            n += 1
        return total / max(n, 1)

    def row(self, word: str) -> np.ndarray:
        """Of a word: its log frequencies, or what its n-grams say."""
        found = self.words.get(word)
        return self.backoff(word) if found is None else found

    def predict(self, text: str, memo: Memo) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        mean = memo.rows(words, self.row).mean(axis=0)
        weight = np.exp((mean - mean.max()) * min(len(words), EVIDENCE_WORDS))
        best = int(np.argmax(mean))  # ties: the first in alphabetical order
        return self.languages[best], float(weight[best] / weight.sum())


def letters_only(word: str) -> list[str]:
    """The runs of letters in a word that may hold numerals."""
    return "".join(c if c.isalpha() else " " for c in word).split()


def words_of(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    return words if "".join(words).isalpha() else [x for w in words for x in letters_only(w)]


class Memo:
    """Rows of words that a worker has met, in one array."""

    def __init__(self, width: int, most: int = MEMO_WORDS):
        self.table, self.at, self.most = np.empty((1024, width)), {}, most

    def rows(self, words: list[str], find: Callable[[str], np.ndarray]) -> np.ndarray:
        if len(self.at) > self.most:
            self.at.clear()
        places = list(map(self.at.get, words))
        if None in places:
            for i, place in enumerate(places):
                if place is None:
                    word = words[i]
                    place = self.at.setdefault(word, len(self.at))
                    if place == len(self.table):
                        self.table = np.concatenate([self.table, np.empty_like(self.table)])
                    if place == len(self.at) - 1:
                        self.table[place] = find(word)
                    places[i] = place
        return self.table[places]


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (lang, text) to (lang, unit, n), places of the words in part of the texts."""
    found: defaultdict[str, Counter] = defaultdict(Counter)

    def rows() -> pa.RecordBatch:
        tongues = [lang for lang, words in found.items() for _ in words]
        columns = [pa.array(tongues, pa.string()), pa.array([w for words in found.values() for w in words], pa.string()), pa.array([n for words in found.values() for n in words.values()], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "unit", "n"])

    for batch in small_batches(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[lang].update(words_of(text))
        if sum(map(len, found.values())) > COUNTED_WORDS:
            yield rows()
            found.clear()
    yield rows()


def train(docs: DataFrame) -> Model:
    """From all labelled documents (doc_id, text, lang). The counts are made by Spark; only the kept ones come to the driver."""
    texts = docs.where("lang is not null and text is not null").select("lang", "text")
    words = texts.mapInArrow(counted, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n")).cache()
    marked = F.concat(F.lit("<"), "unit", F.lit(">"))
    # Of a word and of n-grams by length, how many places there are.
    each = [F.sum(F.col("n") * F.greatest(F.lit(0), F.char_length(marked) - length + 1)).alias(f"places{length}") for length in range(1, LONGEST + 1)]
    totals = words.groupBy("lang").agg(F.sum("n").alias("places0"), *each).orderBy("lang").collect()
    model = Model(sorted(r["lang"] for r in totals), table_of(words, {r["lang"]: r["places0"] for r in totals}, LEAST_WORD))
    for length in range(1, LONGEST + 1):
        places = F.when(F.char_length(marked) >= length, F.sequence(F.lit(1), F.char_length(marked) - length + 1)).otherwise(F.array().cast("array<int>"))
        grams = _grams(words, marked, places, length).groupBy("lang", "unit").agg(F.sum("n").alias("n"))
        model.grams[length] = table_of(grams, {r["lang"]: r[f"places{length}"] for r in totals}, LEAST_GRAM)
    words.unpersist()
    return model


def _grams(words: DataFrame, marked: Column, places: Column, length: int) -> DataFrame:
    at = words.select("lang", marked.alias("word"), "n", F.explode(places).alias("at"))
    return at.select("lang", F.substring("word", F.col("at"), F.lit(length)).alias("unit"), "n")


def table_of(counts: DataFrame, totals: dict[str, int], least: int) -> Rows:
    """Log probabilities, with one added to each count, of the units that have `least` places and LEAST_SHARE of all places, over all languages."""
    by_unit = counts.groupBy("unit").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))
    kept = by_unit.where(F.col("all") >= max(least, LEAST_SHARE * sum(totals.values()))).select("unit", "by").toArrow().combine_chunks()
    languages = sorted(totals)
    column = {lang: i for i, lang in enumerate(languages)}
    table = np.zeros((kept.num_rows, len(languages)))
    if kept.num_rows:
        by = kept.column("by").combine_chunks()
        of = by.flatten()
        table[by.value_parent_indices().to_numpy(), [column[x] for x in of.field(0).to_pylist()]] = of.field(1).to_numpy()
    size = max(kept.num_rows, 1)
    table = np.log((table + 1) / (np.array([totals[x] for x in languages], "f8") + size))
    return Rows({unit: i for i, unit in enumerate(kept.column("unit").to_pylist())}, table)


def predictor(model: Model) -> Callable:
    """For mapInArrow: rows whose last column is the text to their other columns, lang_pred and score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(max(len(model.languages), 1))
        for batch in small_batches(batches):
            tongues, scores = zip(*(model.predict(text, memo) for text in batch.columns[-1].to_pylist()), strict=True)
            columns = [*batch.columns[:-1], pa.array(tongues, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predictions(rows: DataFrame, model: Model) -> DataFrame:
    """rows (other columns, then text) with lang_pred and score in place of the text."""
    kept = rows.drop(rows.columns[-1]).schema
    return rows.mapInArrow(predictor(model), StructType([*kept.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame, model: Model | None = None, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every document; learnt from the documents not held out.

    A text that is null, empty or without a letter is `und` with score 0, and so is every text if nothing was learnt. A
    null doc_id is not held out. Languages tie to the first in alphabetical order. Repeated rows give repeated rows;
    other columns are ignored; an empty table gives an empty result.
    """
    out = held_out(F.col("doc_id"), folds, fold)
    if model is None:
        model = train(docs.where(~out).select("doc_id", "text", "lang"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), text_or_empty().alias("text"))
    return predictions(rows, model)
