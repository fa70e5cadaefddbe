"""Partial ratio of two strings: the best normalised insert-delete similarity (0 to 100) of the shorter one with a
window of the longer one, windows at the ends may be shorter. Common subsequences are counted bit-parallel on whole
numbers. Where a cutoff is given, one bit-vector pass over the longer string tells which windows can reach it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(masks: dict[str, int], full: int, other: str) -> int:
    state = full
    for c in other:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return full.bit_length() - state.bit_count()


def near_ends(masks: dict[str, int], m: int, text: str, most: int) -> list[int]:
    """Ends in text of substrings that m signs (masks tells where each stands) become by at most so many edits: Myers'
    bit-vector search. An edit here also replaces, so no window of at most so many inserts and deletes is missed."""
    plus, minus, score, top = (1 << m) - 1, 0, m, 1 << (m - 1)
    full = plus
    ends = []
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        eq |= (((eq & plus) + plus) ^ plus)
        up = minus | ~(eq | plus) & full
        down = plus & eq
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score <= most:
            ends.append(at)
    return ends


def candidate_starts(masks: dict[str, int], m: int, text: str, cutoff: float) -> list[int] | range:
    """Starts of the windows that may reach the cutoff; windows at the ends of text are shorter."""
    most = int((1 - cutoff / 100) * 2 * m + 1e-9)
    if not cutoff or most >= m:
        return range(1 - m, len(text))
    ends = near_ends(masks, m, text, most)
    starts = [e - m + 1 for e in ends]
    if ends and ends[-1] == len(text) - 1:
        starts += range(max(0, len(text) - m + 1), len(text))
    return starts


def partial_ratio(a: str, b: str, cutoff: float = 0) -> float:
    """The best ratio if it is at least cutoff, else 0."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    m, best = len(short), 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    for start in candidate_starts(masks, m, long, cutoff):
        window = long[max(0, start) : max(0, start + m)]
        if window and 200 * min(m, len(window)) / (m + len(window)) > max(best, cutoff - 1e-9):
            best = max(best, 200 * common_length(masks, (1 << m) - 1, window) / (m + len(window)))
    if len(a) == len(b) and best < 100:  # either may be the one that slides
        other: dict[str, int] = {}
        for i, c in enumerate(long):
            other[c] = other.get(c, 0) | 1 << i
        for start in candidate_starts(other, m, short, cutoff):
            window = short[max(0, start) : max(0, start + m)]
            if window:
                best = max(best, 200 * common_length(other, (1 << m) - 1, window) / (m + len(window)))
    return best if best >= cutoff else 0.0


def ratio_column(a: Column, b: Column, cutoff: float = 0) -> Column:
    """Null where either side is null; such rows cost nothing in Python."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else partial_ratio(p, q, cutoff) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)
