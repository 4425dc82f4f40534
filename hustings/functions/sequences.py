"""Likeness of strings by their longest common blocks, and distances by edits, for many pairs at once.

Of all pairs of two lists only those are cut into blocks that may be like: the characters in common blocks stand in both strings
in order, so there are no more of them than the longest common subsequence has, which bits of whole words tell for a string and
many others in few steps. The same holds for distances. Nothing is left out: bounds only spare work.
"""

from __future__ import annotations

from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Pairs that are worked on together; strings are names, so their tables stay small.
PAIRS_AT_ONCE = 2048
#: Strings whose bits are worked on together, each against all of the other side.
STRINGS_AT_ONCE = 16
#: Characters of a string that have a bit.
BITS = 64


def _sizes(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _coded(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """A row of numbers for each text, one number for each character, and how many characters there are; rows are filled up with
    two numbers more, one for each side."""
    points = [np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) for texts in (left, right)]
    found, numbers = np.unique(np.concatenate(points), return_inverse=True)
    kind = np.uint8 if len(found) < 254 else np.int32
    sides = []
    for texts, part, pad in zip((left, right), np.split(numbers, [len(points[0])]), (0, 1), strict=True):
        size = _sizes(texts)
        out = np.full((len(texts), max(1, size.max(initial=0))), len(found) + pad, dtype=kind)
        out[np.arange(out.shape[1]) < size[:, None]] = part
        sides.append(out)
    return *sides, len(found)


def _cut(codes: np.ndarray, pair: np.ndarray, low: np.ndarray, high: np.ndarray, pad: int) -> np.ndarray:
    """The stretches [low, high) of the pairs' rows, filled up with pad."""
    at = low[:, None] + np.arange(int((high - low).max()))
    inside = at < high[:, None]
    return np.where(inside, codes[pair[:, None], np.minimum(at, codes.shape[1] - 1)], pad)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and length of each row's longest common block; of several the first in a, of these the first in b."""
    rows = np.arange(len(a))
    best, best_end, best_at = (np.zeros(len(a), dtype=np.int64) for _ in range(3))
    run = np.zeros((len(b), b.shape[1] + 1), dtype=np.uint8 if b.shape[1] < 255 else np.int32)  # length of the block that ends here, one place to the right
    for i in range(a.shape[1]):
        run[:, 1:] = (run[:, :-1] + 1) * (a[:, i : i + 1] == b)
        at = run.argmax(axis=1)
        size = run[rows, at]
        longer = size > best
        best[longer], best_end[longer], best_at[longer] = size[longer], i + 1, at[longer]
    return best_end - best, best_at - best, best


def _matched(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, pad: int) -> np.ndarray:
    """Characters in common blocks of each row of a and the same row of b."""
    matched = np.zeros(len(a), dtype=np.int64)
    work = [np.arange(len(a)), np.zeros_like(a_size), a_size, np.zeros_like(b_size), b_size]
    while True:
        work = [x[(work[2] > work[1]) & (work[4] > work[3])] for x in work]
        pair, a_low, a_high, b_low, b_high = work
        if not len(pair):
            return matched
        i, j, size = _longest(_cut(a, pair, a_low, a_high, pad), _cut(b, pair, b_low, b_high, pad + 1))
        np.add.at(matched, pair, size)
        found = size > 0
        pair, a_low, a_high, b_low, b_high, i, j, size = (x[found] for x in (pair, a_low, a_high, b_low, b_high, i, j, size))
        before = (pair, a_low, a_low + i, b_low, b_low + j)
        after = (pair, a_low + i + size, a_high, b_low + j + size, b_high)
        work = [np.concatenate(x) for x in zip(before, after, strict=True)]


def block_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Twice the characters in common blocks over all characters: the longest common block, then the same on both its sides.

    Two empty strings are alike (1). No character is ignored for being common.
    """
    out = np.ones(len(left))
    for start in range(0, len(left), PAIRS_AT_ONCE):
        some = slice(start, start + PAIRS_AT_ONCE)
        a, b, pad = _coded(left[some], right[some])
        a_size, b_size = _sizes(left[some]), _sizes(right[some])
        total = a_size + b_size
        out[some] = np.where(total > 0, 2.0 * _matched(a, a_size, b, b_size, pad) / np.maximum(total, 1), 1.0)
    return out


def _bits(a: np.ndarray, a_size: np.ndarray, symbols: int) -> np.ndarray:
    """For each row and symbol the places where it stands, as bits."""
    kind = next(k for n, k in ((16, np.uint16), (32, np.uint32), (BITS, np.uint64)) if n >= min(BITS, a_size.max(initial=0)))
    out = np.zeros((len(a), symbols), dtype=kind)
    for place in range(min(BITS, a_size.max(initial=0))):
        rows = np.flatnonzero(a_size > place)
        out[rows, a[rows, place]] |= kind(1 << place)
    return out


def _by_bits(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, symbols: int, start, step, end):
    """(rows of a, what end() gives for them and all rows of b): start(), then step() for each character of b, where there is one."""
    longest_first = np.argsort(-b_size, kind="stable")
    back = np.argsort(longest_first)
    columns = np.ascontiguousarray(b[longest_first].T).astype(np.intp)
    reach = [int((b_size > place).sum()) for place in range(b.shape[1])]
    by_size = np.argsort(a_size, kind="stable")
    for low in range(0, len(a), STRINGS_AT_ONCE):
        rows = by_size[low : low + STRINGS_AT_ONCE]
        bits = _bits(a[rows], a_size[rows], symbols)
        state = start(bits.dtype, (len(rows), len(b)))
        for place, n in enumerate(reach):
            if n:
                step(bits.take(columns[place, :n], axis=1), *(x[:, :n] for x in state))
        yield rows, end(rows, *state)[:, back]


def subsequence_bounds(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, symbols: int):
    """(rows of a, for them and all rows of b the length of the longest common subsequence); for strings of more than BITS
    characters in a, no less than that."""

    def step(equal: np.ndarray, v: np.ndarray) -> None:
        equal &= v
        added = v + equal
        v -= equal
        v |= added

    beyond = np.maximum(a_size - BITS, 0)
    return _by_bits(a, a_size, b, b_size, symbols, lambda kind, shape: (np.full(shape, ~kind.type(0)),), step, lambda rows, v: np.bitwise_count(~v) + beyond[rows, None])


def like_pairs(left: list[list[str]], right: list[list[str]], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in left and right, and the largest of the block ratios, of all pairs in which it is `least` or more.

    Both have a list for each of several keys of their strings. A key that is in both strings as the first is not looked at again.
    """
    n, found = len(right[0]), []
    for nth, (one, other) in enumerate(zip(left, right, strict=True)):
        whole = np.arange(len(one)), np.arange(n)
        differ = [np.array([x != y for x, y in zip(side[0], side[nth], strict=True)], dtype=bool) for side in (left, right)]
        parts = [whole] if not nth else [(whole[0][differ[0]], whole[1]), (whole[0][~differ[0]], whole[1][differ[1]])]
        a, b, pad = _coded(one, other)
        a_size, b_size = _sizes(one), _sizes(other)
        enough = np.ceil(least * np.arange(a_size.max(initial=0) + b_size.max(initial=0) + 1) / 2 - 1e-9).astype(np.int64)
        may = [np.zeros((2, 0), dtype=np.int64)]
        for some, others in parts:
            for rows, most in subsequence_bounds(a[some], a_size[some], b[others], b_size[others], pad + 2) if len(some) and len(others) else ():
                i, j = np.nonzero(most >= enough[a_size[some[rows], None] + b_size[others]])
                may.append(np.stack([some[rows[i]], others[j]]))
        i, j = np.concatenate(may, axis=1)
        total = a_size[i] + b_size[j]
        ratio = np.ones(len(i))
        order = np.argsort(total, kind="stable")
        for start in range(0, len(order), PAIRS_AT_ONCE):
            at = order[start : start + PAIRS_AT_ONCE]
            ratio[at] = np.where(total[at] > 0, 2.0 * _matched(a[i[at]], a_size[i[at]], b[j[at]], b_size[j[at]], pad) / np.maximum(total[at], 1), 1.0)
        kept = ratio >= least
        found.append((i[kept] * n + j[kept], ratio[kept]))
    pair, ratio = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-ratio, pair))
    pair, ratio = pair[order], ratio[order]
    first = np.diff(pair, prepend=-1) > 0
    return pair[first] // max(n, 1), pair[first] % max(n, 1), ratio[first]


def _edits_of_long(a: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Edit distances of one string to all rows of b, a row of the table for each of its characters."""
    at = np.arange(b.shape[1] + 1)
    row = np.tile(at, (len(b), 1))
    for i, symbol in enumerate(a, 1):
        changed = np.minimum(row[:, :-1] + (b != symbol), row[:, 1:] + 1)
        row = np.minimum.accumulate(np.insert(changed, 0, i, axis=1) - at, axis=1) + at
    return row[np.arange(len(b)), b_size]


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Least number of characters inserted, deleted or replaced between each string of left (rows) and of right (columns)."""
    alike = len(commonprefix([min(left), max(left), min(right), max(right)])) if left and right else 0
    a, b, pad = _coded([x[alike:] for x in left], [x[alike:] for x in right])
    a_size, b_size = _sizes(left) - alike, _sizes(right) - alike
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    by_size = np.sort(b_size)[::-1]
    short, long = np.flatnonzero(a_size <= BITS), np.flatnonzero(a_size > BITS)

    def step(equal: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
        both = equal | down
        across = (((equal & up) + up) ^ up) | equal
        more = ((down | ~(across | up)) << 1) | 1
        fewer = (up & across) << 1
        np.bitwise_or(fewer, ~(both | more), out=up)
        np.bitwise_and(more, both, out=down)

    def end(rows: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        n = a_size[short[rows], None].astype(up.dtype)
        whole = np.where(n > 0, ~up.dtype.type(0) >> np.maximum(8 * up.dtype.itemsize - n, 0), 0).astype(up.dtype)
        return by_size + np.bitwise_count(up & whole) - np.bitwise_count(down & whole)

    for rows, found in _by_bits(a[short], a_size[short], b, b_size, pad + 2, lambda kind, shape: (np.full(shape, ~kind.type(0)), np.zeros(shape, dtype=kind)), step, end):
        out[short[rows]] = found
    for row in long:
        out[row] = _edits_of_long(a[row, : a_size[row]], b, b_size)
    return out


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """block_ratios() of two columns; null where one is null."""
    known = a.notna() & b.notna()
    out = pd.Series(np.nan, index=a.index)
    out[known] = block_ratios(a[known].tolist(), b[known].tolist())
    return out.astype(object).where(known, None)
