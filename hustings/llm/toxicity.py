"""Toxicity: noisy-channel deobfuscation.

Words that hide behind digits and symbols, spacing or repeated letters are restored before anything is scored: every
character of a suspicious token may stand for one of several letters or for none, at a channel cost; a Viterbi search
through this lattice finds the letters that a character language model and the channel together make likeliest. The
restored words are scored with a lexicon of words and word beginnings learnt from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from hustings.llm.common import discard, small_batches, text_or_empty, written
from hustings.llm.language import held_out

#: Letters of the shortest word that may be learnt, and of the shortest restored one that counts: of two letters, what is
#: behind a digit is anyone's guess.
LEAST_LETTERS, LEAST_RESTORED = 2, 3
#: Lengths of word beginnings, and the least probability of label 1 that a unit stands for.
PREFIXES = (4, 5, 6, 7)
LEAST_P = 0.8
#: A unit is learnt from so many toxic documents at least, and from more if by chance one of all units would have as many.
LEAST_SUPPORT = 5
#: Near copies speak once together: documents are counted by the least hash of their shingles, under so many hash functions.
SKETCHES = 3
SHINGLE_WORDS = 3
#: Letters that stand together less often, or at less than this share of all places, count as unseen. So what comes to the
#: driver is bounded, whatever the number of documents.
LEAST_GRAM = 2
LEAST_SHARE = 1 / 4_000_000
#: Score of a text without any evidence.
PRIOR = 0.02
PREDICT_AT = 0.7
#: Tokens that a worker remembers decoded.
MEMO_TOKENS = 200_000

#: What a character may stand for, besides itself.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
SEPARATORS = " .-_*'`~"
#: Log costs: a symbol for a letter, a separator for nothing, a letter for nothing after its like, a space for a word's end.
COST_LEET, COST_SKIP, COST_REPEAT, COST_BREAK = -0.7, -0.3, -0.5, -0.5

WORD = re.compile(r"[^\W\d_]+")
#: Within a token: letters beside symbols that may stand for letters, and single characters between separators.
MIXED = re.compile(r"[0-9@$!|+€][^\W\d_]|[^\W\d_][0-9@$!|+€]")
PARTED = re.compile(r"[^\W_@$!|+€]?(?:[.\-_*'`~]{1,2}(?:[^\W_]|[@$!|+€])){2,}")
REPEATED = re.compile(r"([^\W\d_])\1\1")
TRIPLES = tuple(3 * c for c in "abcdefghijklmnopqrstuvwxyzäöüßéèêëàâçîïôûñíóúá")
#: Taken off both ends of a token before it is looked at.
LEFT_EDGES = ".,?;:()[]{}<>\"#*%&'-_"
EDGES = LEFT_EDGES + "!$|"
#: So many characters alone in a row, between spaces, are read as one spaced word.
LEAST_SPACED = 3


@dataclass
class Model:
    """units: probability of label 1 by word ("idle") or word beginning ("idl*"); grams: letter counts by context."""

    units: dict[str, float] = field(default_factory=dict)
    grams: dict[str, float] = field(default_factory=dict)
    heads: set[str] = field(default_factory=set)
    single: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.heads = {u[:4] for u in self.units}
        self.single = {collapsed(u): p for u, p in self.units.items() if not u.endswith("*")}

    def letter(self, a: str, b: str, c: str) -> float:
        """Log probability of letter c after a and b: three letters' counts, smoothed by two letters' and one's."""
        n = self.grams.get
        one = (n(c, 0) + 0.5) / (n("", 0) + 50)
        two = (n(b + c, 0) + 5 * one) / (n(b + "_", 0) + 5)
        return math.log((n(a + b + c, 0) + 5 * two) / (n(a + b + "_", 0) + 5))

    def decode(self, token: str) -> str:
        """The likeliest words behind a token: Viterbi over its lattice; a state is the last two letters. Only a space may end a word."""
        states: dict[tuple[str, str], tuple[float, str]] = {("^", "^"): (0.0, "")}
        before = ""
        for char in token:
            options = [(x, COST_LEET) for x in LEET.get(char, "")] + ([(char, 0.0)] if char.isalpha() else [])
            skip = COST_SKIP if char in SEPARATORS else COST_REPEAT if char == before or not options else None
            after: dict[tuple[str, str], tuple[float, str]] = {}
            for (a, b), (score, word) in states.items():
                moves = [((b, x), score + cost + self.letter(a, b, x), word + x) for x, cost in options]
                moves += [((a, b), score + skip, word)] if skip is not None else []
                moves += [(("^", "^"), score + COST_BREAK + self.letter(a, b, "$"), word + " ")] if char == " " and b != "^" else []
                for state, total, out in moves:
                    if state not in after or total > after[state][0]:
                        after[state] = (total, out)
            states, before = after, char
        return max(((s + self.letter(a, b, "$"), w) for (a, b), (s, w) in states.items()), default=(0.0, ""))[1]

    def evidence(self, word: str) -> float:
        """The most that a word or its beginnings say."""
        return max([self.units.get(word, 0.0), *(self.units.get(word[:n] + "*", 0.0) for n in PREFIXES if len(word) >= n)])

    def look(self, text: str) -> tuple[set[str], set[str]]:
        """Of a lower-case text: its plain words that may be evidence, and its suspicious tokens."""
        heads, plain, odd = self.heads, set(), set()
        tokens = text.split()
        different = set(tokens)
        for token in different:
            bare = token.lstrip(LEFT_EDGES).rstrip(EDGES)
            if bare.isalpha():
                if bare[:4] in heads:
                    plain.add(bare)
            elif bare:
                plain.update(w for w in WORD.findall(bare) if w[:4] in heads)
                if MIXED.search(token) or PARTED.search(token):
                    odd.update((bare, token.strip(".,;:?()\"#%&*")))  # a symbol at the end may be a letter or a mark
        if any(x in text for x in TRIPLES):
            odd.update(t.strip(EDGES) for t in different if REPEATED.search(t))
        if sum(len(t) == 1 for t in different) >= LEAST_SPACED - 1:
            row: list[str] = []
            for token in [*tokens, "  "]:
                if len(token) == 1:
                    row.append(token)
                    continue
                if len(row) >= LEAST_SPACED:
                    odd.add(" ".join(row))
                row = []
        return plain, odd

    def restored(self, odd: set[str], memo: dict[str, str]) -> set[str]:
        """The words behind suspicious tokens."""
        for token in odd:
            if token not in memo:
                memo[token] = self.decode(token)
        return {w for t in odd for w in memo[t].split() if len(w) >= LEAST_RESTORED}

    def score(self, text: str, memo: dict[str, str]) -> float:
        """One minus the probability that no evidence is right, each different word being evidence of its own."""
        words, odd = self.look(text.lower())
        found = {w: self.evidence(w) for w in words}
        # Restoring may have lost one of two like letters.
        found |= {w: max(self.evidence(w), self.single.get(collapsed(w), 0.0)) for w in self.restored(odd, memo)}
        clean = 1 - PRIOR
        for p in sorted(found.values()):
            clean *= 1 - p
        return 1 - clean


def collapsed(word: str) -> str:
    """The word with single letters for doubled ones."""
    return re.sub(r"(.)\1+", r"\1", word)


def specific(units: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Units without those word beginnings of whose support nearly all comes from one kept word or longer beginning."""

    def covered(unit: str) -> bool:
        stem, most = unit[:-1], 0.8 * units[unit][1]
        finer = (n for u, (_, n) in units.items() if u.startswith(stem) and (len(u) > len(unit) or not u.endswith("*")))
        return any(n >= most for n in finer)

    return {u: p for u, (p, _) in units.items() if not (u.endswith("*") and covered(u))}


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, doc, toxic, words) of every labelled document not held out, with its whole text; doc tells texts apart."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out(F.col("doc_id"), 3, 1))
    # Labels grow with the documents, so they are not broadcast, whatever their number.
    texts = texts.join(known.where(~held_out(F.col("doc_id"), 3, 1)).hint("merge"), "doc_id")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    return texts.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("doc"), "toxic", words.alias("words"))


def sketches(words: DataFrame) -> DataFrame:
    """words with `c0`, `c1` and so on: the document's least shingle hash under each of SKETCHES hash functions. Near copies share most of them."""
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - SHINGLE_WORDS))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(SHINGLE_WORDS)]))
    hashed = words.withColumn("hashes", hashes)
    # A second parameter of the lambda would be the place in the array, even with a default.
    again = lambda k: F.transform("hashes", lambda h: F.xxhash64(h, F.lit(k)))
    return hashed.select(*words.columns, *[F.array_min(again(k)).alias(f"c{k}") for k in range(SKETCHES)])


def different(words: DataFrame) -> DataFrame:
    """words, written, which go, to each text once, with `shared`: (k, c) of those sketches that another text of its label has too; null if none."""
    sketched = [f"c{k}" for k in range(SKETCHES)]
    once = written(words.groupBy("doc", "toxic", *sketched).agg(F.min("row").alias("row")), "different")
    each = once.select("row", "toxic", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("c")) for k, c in enumerate(sketched)])).alias("x")).select("row", "toxic", "x.*")
    several = each.groupBy("toxic", "k", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = each.join(several, ["toxic", "k", "c"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("k", "c")).alias("shared"))
    found = written(words.select("row", "doc", "toxic", "words").join(once.select("row").join(copies, "row", "left").hint("merge"), "row"), "texts")
    discard(words, once)
    return found


def units_of(words: str):
    """The different words of a text and their beginnings, an array."""
    found = F.filter(F.array_distinct(words), lambda w: F.char_length(w) >= LEAST_LETTERS)

    def beginnings(n: int):
        return F.array_distinct(F.transform(F.filter(found, lambda w: F.char_length(w) >= n), lambda w: F.concat(F.left(w, F.lit(n)), F.lit("*"))))

    return F.concat(found, *map(beginnings, PREFIXES))


def _p(bad, good):
    return bad / (bad + good + 1)


def lexicon(texts: DataFrame) -> dict[str, tuple[float, int]]:
    """Units of different() texts that tell label 1: their probability, and how many toxic documents have them.

    A document speaks once for a unit, and near copies once together: as many as there are different sketches, under the
    hash function with the fewest. Most sketches are one text's own; so these are counted, and only the others are compared.
    """
    alone = [F.when(F.array_contains("shared.k", k), 0).otherwise(1).alias(f"s{k}") for k in range(SKETCHES)]
    placed = texts.select("toxic", *alone, F.explode(units_of("words")).alias("unit"))
    side = lambda value, of: F.sum(F.when(F.col("toxic") == value, of).otherwise(0))
    counts = placed.groupBy("unit").agg(
        *[side(value, F.lit(1)).alias(f"docs{value}") for value in (0, 1)],
        *[side(value, F.col(f"s{k}")).alias(f"s{value}{k}") for value in (0, 1) for k in range(SKETCHES)],
    )
    counts = written(counts, "units")
    all_of = counts.agg(F.count(F.lit(1)).alias("units"), F.sum("docs1").alias("bad"), F.sum("docs0").alias("good")).first()
    base = min(0.9, max(0.01, (all_of["bad"] or 0) / max(1, (all_of["bad"] or 0) + (all_of["good"] or 0))))
    least = max(LEAST_SUPPORT, math.log(max(1, all_of["units"])) / -math.log(base))
    # No unit has more support than toxic documents, or less against it than texts without a copy: the rest need not be compared.
    against = F.least(*[F.col(f"s0{k}") for k in range(SKETCHES)])
    may = written(counts.where((F.col("docs1") >= least) & (_p(F.col("docs1"), against) >= LEAST_P)), "candidates")
    shared = texts.where("shared is not null").select("toxic", "shared", F.explode(units_of("words")).alias("unit")).join(may.select("unit"), "unit", "left_semi")
    shared = shared.select("unit", "toxic", F.explode("shared").alias("x")).select("unit", "toxic", "x.*").distinct()
    more = shared.groupBy("unit").agg(*[F.count(F.when((F.col("toxic") == value) & (F.col("k") == k), 1)).alias(f"m{value}{k}") for value in (0, 1) for k in range(SKETCHES)])
    total = lambda value: F.least(*[F.col(f"s{value}{k}") + F.coalesce(f"m{value}{k}", F.lit(0)) for k in range(SKETCHES)])
    told = may.join(more, "unit", "left").select("unit", total(1).alias("bad"), total(0).alias("good"))
    kept = told.where((F.col("bad") >= least) & (_p(F.col("bad"), F.col("good")) >= LEAST_P)).select("unit", _p(F.col("bad"), F.col("good")).alias("p"), "bad").collect()
    discard(counts, may)
    return {r["unit"]: (r["p"], r["bad"]) for r in kept}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From all labelled documents not held out. Spark counts lexicon and letters; the driver gets the kept units and letter counts."""
    texts = different(written(sketches(labelled(docs, labels)), "labelled"))
    kept = lexicon(texts)
    model = Model(specific(kept))
    marked = F.concat(F.lit("^^"), "word", F.lit("$"))
    grams = texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).select(marked.alias("word"), "n")
    at = grams.select("word", "n", F.explode(F.sequence(F.lit(3), F.char_length("word"))).alias("at"))
    three = written(at.groupBy(F.substring("word", F.col("at") - 2, F.lit(3)).alias("gram")).agg(F.sum("n").alias("n")), "grams")
    seldom = max(LEAST_GRAM, LEAST_SHARE * (three.agg(F.sum("n")).first()[0] or 0))
    counts = [(r["gram"], float(r["n"])) for r in three.where(F.col("n") >= seldom).collect()]
    # The lexicon's whole words are counted once more: what is searched for must not look unlikely.
    for unit, (_, bad) in kept.items():
        if not unit.endswith("*"):
            w = f"^^{unit}$"
            counts += [(w[i : i + 3], 20.0 * bad) for i in range(len(w) - 2)]
    for gram, n in counts:
        a, b, c = gram
        for key in (gram, b + c, c, a + b + "_", b + "_", ""):
            model.grams[key] = model.grams.get(key, 0.0) + n
    discard(texts, three)
    return model


def scorer(model: Model) -> Callable:
    """For mapInArrow: rows whose last column is the text to their other columns, score and predicted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for batch in small_batches(batches):
            scores = []
            for text in batch.columns[-1].to_pylist():
                scores.append(model.score(text, memo))
                if len(memo) > MEMO_TOKENS:
                    memo.clear()
            columns = [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= PREDICT_AT) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score", "predicted"])

    return run


def predictions(rows: DataFrame, model: Model) -> DataFrame:
    """rows (other columns, then text) with score and predicted in place of the text."""
    kept = rows.drop(rows.columns[-1]).schema
    return rows.mapInArrow(scorer(model), StructType([*kept.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score at least PREDICT_AT) of every document.

    A null or empty text has the score of no evidence. A document with several labels is toxic if one says so; null labels
    and labels without a document teach nothing; a null doc_id is not held out. Repeated rows give repeated rows; other
    columns are ignored; an empty table gives an empty result, and without labels every score is that of no evidence.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), text_or_empty().alias("text"))
    return predictions(rows, model)
