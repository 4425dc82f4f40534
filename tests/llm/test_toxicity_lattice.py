"""The lattice against all its paths, the lexicon's counts against plain ones, and words of few letters."""

from __future__ import annotations

import itertools
import random

from hustings.llm import toxicity


def all_paths(model, token):
    """The likeliest words behind a token, every path tried."""
    best = (float("-inf"), "")
    choices = []
    for i, char in enumerate(token):
        options = [(x, toxicity.COST_LEET) for x in toxicity.LEET.get(char, "")] + ([(char, 0.0)] if char.isalpha() else [])
        if char in toxicity.SEPARATORS:
            skip = toxicity.COST_SKIP
        else:
            skip = toxicity.COST_REPEAT if (i and char == token[i - 1]) or not options else None
        choices.append(options + ([("", skip)] if skip is not None else []) + ([(" ", toxicity.COST_BREAK)] if char == " " else []))
    for path in itertools.product(*choices):
        total, a, b, out = 0.0, "^", "^", ""
        for letter, cost in path:
            if letter == " ":
                if b == "^":
                    break
                total, a, b, out = total + cost + model.letter(a, b, "$"), "^", "^", out + " "
            elif letter:
                total, a, b, out = total + cost + model.letter(a, b, letter), b, letter, out + letter
            else:
                total += cost
        else:
            best = max(best, (total + model.letter(a, b, "$"), out))
    return best[1]


def test_decoding_finds_the_best_of_all_paths():
    rnd = random.Random(3)
    words = ["zug", "idiot", "hall", "oil", "total", "sat"]
    grams = {}
    for w in words:
        for a, b, c in zip(f"^^{w}$", f"^{w}$", f"{w}$", strict=False):
            for key in (a + b + c, b + c, c, a + b + "_", b + "_", ""):
                grams[key] = grams.get(key, 0.0) + rnd.randint(1, 9)
    model = toxicity.Model({"zug": 0.9}, grams)
    tokens = ["1d10t", "z u g", "h4ll 0il", "zzuugg", "$at", "t0t4l", "z.u.9", "i d i o t", "!!", "a"] + ["".join(rnd.choice("zug1d0 .l!") for _ in range(rnd.randint(1, 7))).strip() for _ in range(80)]
    for token in tokens:
        assert model.decode(token) == all_paths(model, token), token


def corpus(rnd, insult, n=240):
    # Every third document is toxic by one word; no two documents are near copies.
    say = lambda k: [("".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 3)))) for _ in range(k)]
    docs, labels = [], []
    for i in range(n):
        words = say(40)
        toxic = i % 3 == 0
        if toxic:
            words.insert(rnd.randrange(len(words)), insult)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_an_insult_of_three_letters_is_learnt_and_found_in_disguise(spark):
    rnd = random.Random(11)
    for insult in ("zug", "zx"):
        docs, labels = corpus(rnd, insult)
        model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert insult in model.units
        memo = {}
        assert model.score(f"you {insult} there", memo) >= toxicity.PREDICT_AT > model.score("you there", memo)
    docs, labels = corpus(rnd, "zug")
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    for text in ("you z u g", "a zu9 it is", "what a z.u.g!", "ZUG", "such a zuuug", "Zug,"):
        assert model.score(text, {}) >= toxicity.PREDICT_AT, text
    for text in ("a b c d e", "1 2 3", "e.g. this u.s.a", "3rd of 7th", "zugo zu ug"):
        assert model.score(text, {}) < toxicity.PREDICT_AT, text


def test_the_lexicon_is_counted_by_documents(spark):
    rnd = random.Random(12)
    docs, labels = corpus(rnd, "zug", 90)
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = {r.doc_id for r in known.where(~toxicity.held_out(known.doc_id, 3, 1)).collect()}
    bad = sum("zug" in t.split() for i, t in docs if i in kept and dict(labels)[i])
    clean = sum("zug" in t.split() for i, t in docs if i in kept and not dict(labels)[i])
    model = toxicity.train(frame, known)
    # Near copies speak once; a least hash may fall together by chance in a few pairs of documents, so the count may be less.
    assert clean == 0 and (bad - 2) / (bad - 1) <= model.units["zug"] <= bad / (bad + 1)


def test_all_labelled_documents_are_learnt_from(spark):
    """More of each label than any bound that a sample had: every one counts, against the insult too."""
    rnd = random.Random(13)
    say = lambda k: " ".join("".join(rnd.choice("bcdfgklmnprst") for _ in range(7)) for _ in range(k))
    docs = [(i, f"{say(6)} {'zug' if i % 2 or i % 50 == 0 else 'fine'}") for i in range(15_000)]
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    kept = [r.doc_id for r in known.where(~toxicity.held_out(known.doc_id, 3, 1)).collect()]
    bad, good = sum(i % 2 for i in kept), sum(i % 50 == 0 for i in kept)
    assert abs(toxicity.train(frame, known).units["zug"] - bad / (bad + good + 1)) < 1e-5


def test_near_copies_speak_once_as_when_all_are_compared(spark):
    """Supports of the lexicon against sets of sketches for every unit."""
    rnd = random.Random(14)
    docs, labels = corpus(rnd, "zugzug", 120)
    for i, text in docs[:60:2]:
        words = text.split()
        for j in range(4):
            words[rnd.randrange(40)] = "vexed"
            docs.append((1000 + 10 * i + j, " ".join(words)))
            labels.append((1000 + 10 * i + j, int(i % 3 == 0)))
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    words = toxicity.written(toxicity.sketches(toxicity.labelled(frame, known)), "test")
    seen: dict = {}
    rows = words.collect()
    for r in rows:
        for unit in {u for w in r.words if len(w) >= toxicity.LEAST_LETTERS for u in [w, *(w[:n] + "*" for n in toxicity.PREFIXES if len(w) >= n)]}:
            for k in range(toxicity.SKETCHES):
                seen.setdefault((unit, r.toxic), [set() for _ in range(toxicity.SKETCHES)])[k].add(r[f"c{k}"])
    count = {x: min(map(len, sets)) for x, sets in seen.items()}
    texts = {(r.doc, r.toxic) for r in rows}
    assert sum(toxic for _, toxic in texts) > count["zugzug", 1]
    found = toxicity.lexicon(toxicity.different(words))
    assert found["zugzug"][1] == count["zugzug", 1]
    assert all(found[u] == (count[u, 1] / (count[u, 1] + count.get((u, 0), 0) + 1), count[u, 1]) for u in found)
