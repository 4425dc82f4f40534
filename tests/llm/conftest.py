"""Small documents with every awkward case, shared by the tests of all operators."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, g long, row string, n int, part string, key string"


def document(i, text, lang="en"):
    """The last columns clash with names that operators use inside."""
    return (i, text, lang, None, None if text is None else len(text), 0.5, "x", 1, "r", 2, "p", "k")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows and ids, copies, odd characters."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = say(120)
    texts = [say(rnd.randint(1, 150)) for _ in range(40)] + [f"{say(30)} {passage}\n{say(20)}" for _ in range(6)]
    rows = [document(i, t) for i, t in enumerate(texts)]
    rows += [document(100, None), document(101, ""), document(102, "   \n\t "), document(103, say(9000)), document(104, "x" * 3000), document(105, texts[3]), document(106, texts[3])]
    rows += [document(107, "Ünïcödé ǅ İ ſ 漢字 \U0001f600 é́ <|endoftext|> it's 12³ $$ a_b"), document(108, "\x1c \x85　"), document(None, texts[4]), document(None, None), document(7, texts[7]), document(7, texts[7])]
    rows += [document(109, "Licensed under the Apache License, Version 2.0. Released Under THE MIT license; CC BY-NC 4.0, cc by nc"), document(110, "gnu general public license")]
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
