"""Pieces of text to token ids, with a bounded memo in every Python worker.

White space ends every pre-token of the word-end BPE vocabulary, its normaliser never joins anything across a space and
its special tokens hold none. So the ids of a text are the ids of its space-separated pieces in a row, and a piece that
was encoded once needs no second encoding. Texts of Latin letters are lower-cased before they are cut and new pieces are
encoded as their pre-tokens; any other block is cut at spaces, and its new pieces go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that a worker remembers; when they are more, it starts anew.
MEMO_PIECES = 500_000
#: Longer pieces are encoded but not remembered.
MEMO_CHARS = 64
#: Characters of text that are cut into pieces at a time.
BLOCK_CHARS = 1 << 20

#: Outside these characters, and wherever a special token could begin, the whole tokenizer is asked.
BEYOND_LATIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]|<\\|")
#: The vocabulary's pre-tokens, for the characters above.
LATIN_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\w\s]|_)+")

_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for the vocabulary file at path."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def blocks(text: str, most: int = BLOCK_CHARS) -> Iterator[str]:
    """The text in blocks that end at a space, so that pieces stay whole; a longer piece is a block of its own."""
    at = 0
    while len(text) - at > most:
        cut = text.rfind(" ", at, at + most)
        if cut < 0:
            cut = text.find(" ", at + most)
            if cut < 0:
                break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def cut(block: str) -> list[str]:
    """What stands between spaces, tabs and newlines; empty strings are harmless, as they have no ids."""
    return block.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class PieceEncoder:
    """Token ids as the tokenizers library gives them, as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.words = Tokenizer.from_file(path)  # for pre-tokens that stand between spaces
        self.words.no_truncation()
        self.words.no_padding()
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.names = [self.whole.id_to_token(i) or "" for i in range(self.whole.get_vocab_size(with_added_tokens=True))]
        self.decimals = [str(i) for i in range(len(self.names))]
        self.last = np.array([name.endswith("</w>") for name in self.names])
        self.latin: dict[str, bytes] = {"": b""}
        self.other: dict[str, bytes] = {"": b""}

    def _learn_latin(self, new: set[str]) -> dict[str, bytes]:
        """Ids of lower-case Latin pieces."""
        found = {p: LATIN_PRE_TOKEN.findall(p) for p in new}
        memo = self.latin
        words = list({w for ws in found.values() for w in ws if w not in memo})
        known: dict[str, bytes] = {}
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            raw, start = ids.tobytes(), 0
            for word, end in zip(part, ends, strict=True):
                known[word] = raw[4 * start : 4 * end]
                start = end
        out = {p: b"".join([known[w] if w in known else memo[w] for w in ws]) for p, ws in found.items()}
        return known | out

    def _learn_other(self, new: set[str]) -> dict[str, bytes]:
        return {p: np.array(self.whole.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in new}

    def _block(self, block: str) -> bytes:
        latin = not BEYOND_LATIN.search(block)
        memo, learn = (self.latin, self._learn_latin) if latin else (self.other, self._learn_other)
        parts = cut(block.lower() if latin else block)
        got = list(map(memo.get, parts))
        if None in got:
            if len(memo) > MEMO_PIECES:
                memo.clear()
                memo[""] = b""
            holes = [i for i, v in enumerate(got) if v is None]
            new = learn({parts[i] for i in holes})
            for i in holes:
                got[i] = new[parts[i]]
            memo.update((p, v) for p, v in new.items() if len(p) <= MEMO_CHARS)
        return b"".join(got)

    def ids(self, text: str) -> bytes:
        """Of any text: its blocks' ids in a row."""
        return b"".join(map(self._block, blocks(text)))

    def decode(self, ids: list[int]) -> str:
        """As the tokenizer's decode(ids, skip_special_tokens=False): it has no decoder, so tokens stand between spaces."""
        return " ".join(map(self.names.__getitem__, ids))
