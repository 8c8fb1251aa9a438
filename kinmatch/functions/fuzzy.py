"""String closeness for fuzzy keyword scoring."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def closeness(a: str, b: str) -> float:
    """Jaro similarity with a prefix bonus of 0.1 for up to four shared leading characters.

    The bonus has no threshold, and half transpositions count as halves.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    unpaired = list(b)
    paired_a, places_b = [], []
    for i, char in enumerate(a):
        try:
            place = unpaired.index(char, max(i - reach, 0), i + reach + 1)
        except ValueError:
            continue
        unpaired[place] = None
        paired_a.append(char)
        places_b.append(place)
    m = len(paired_a)
    if m == 0:
        return 0.0
    out_of_order = sum(x != b[p] for x, p in zip(paired_a, sorted(places_b)))
    jaro = (m / len(a) + m / len(b) + (m - out_of_order / 2) / m) / 3
    prefix = len(os.path.commonprefix([a[:4], b[:4]]))
    return jaro + prefix * 0.1 * (1 - jaro)


def closeness_of(a: Column, b: Column) -> Column:
    """``closeness`` of two text columns; worth applying to distinct pairs only."""

    def pairs(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([closeness(x, y) for x, y in zip(left, right)], dtype="float64")

    return F.pandas_udf(pairs, "double")(a, b)


class WordLengthGroups:
    """Words grouped by length, as character arrays, to compare one string with all."""

    # Characters are counted in so many places. Sharing a place can only raise the
    # overlap, so a bound made from it stays an upper bound.
    PLACES = 64

    def __init__(self, words: Sequence[str]):
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.groups = []
        for length in np.unique(lengths[lengths > 0]):
            members = np.nonzero(lengths == length)[0]
            joined = "".join(words[i] for i in members)
            chars = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
            chars = chars.reshape(len(members), length)
            flat = np.repeat(np.arange(len(members)), length) * self.PLACES
            counts = np.bincount(
                flat + chars.ravel() % self.PLACES, minlength=len(members) * self.PLACES
            ).reshape(len(members), self.PLACES)
            self.groups.append((int(length), members, chars, counts.astype(np.int32).T.copy()))

    def closer_than(self, text: str, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word indexes, closeness) of the words closer to ``text`` than ``limit``."""
        if not text:
            return
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        counts = np.bincount(codes % self.PLACES, minlength=self.PLACES)
        used = np.nonzero(counts)[0]
        for length, members, chars, group_counts in self.groups:
            overlap = np.zeros(len(members), dtype=np.int32)
            for place in used:
                overlap += np.minimum(group_counts[place], counts[place])
            start = min(4, length, len(codes))
            same = chars[:, :start] == codes[:start]
            prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1)
            best = (overlap / len(codes) + overlap / length + 1) / 3
            possible = np.nonzero(
                (overlap > 0) & (best + prefix * 0.1 * (1 - best) > limit - 1e-9)
            )[0]
            if len(possible):
                rows, value = _closer_words(codes, chars[possible], prefix[possible], limit)
                if len(rows):
                    yield members[possible[rows]], value


def _closer_words(codes: np.ndarray, words: np.ndarray, prefix: np.ndarray, limit: float):
    """(rows, closeness) of equally long words closer to one string than ``limit``."""
    n, length = words.shape
    reach = max(max(len(codes), length) // 2 - 1, 0)
    unpaired = np.ones((n, length), dtype=bool)
    paired = np.zeros((n, len(codes)), dtype=bool)
    for i, code in enumerate(codes):
        low, high = max(i - reach, 0), min(i + reach + 1, length)
        if low >= high:
            continue
        fits = (words[:, low:high] == code) & unpaired[:, low:high]
        rows = np.nonzero(fits.any(axis=1))[0]
        unpaired[rows, low + fits[rows].argmax(axis=1)] = False
        paired[rows, i] = True
    m = paired.sum(axis=1)
    # few stay within reach of the limit now; only those need the order of their pairs
    best = (m / len(codes) + m / length + 1) / 3
    rows = np.nonzero((m > 0) & (best + prefix * 0.1 * (1 - best) > limit - 1e-9))[0]
    m, prefix = m[rows], prefix[rows]
    # paired characters of both sides, each in its own order, side by side
    both = min(len(codes), length)
    left = codes[np.argsort(~paired[rows], axis=1, kind="stable")[:, :both]]
    order = np.argsort(unpaired[rows], axis=1, kind="stable")[:, :both]
    right = np.take_along_axis(words[rows], order, 1)
    out_of_order = ((left != right) & (np.arange(both) < m[:, None])).sum(axis=1)
    jaro = (m / len(codes) + m / length + (m - out_of_order / 2) / m) / 3
    value = jaro + prefix * 0.1 * (1 - jaro)
    above = value > limit
    return rows[above], value[above]
