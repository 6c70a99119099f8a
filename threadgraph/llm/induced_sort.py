"""Suffix arrays by recursive induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are classified by type, the leftmost smaller ones (LMS) are sorted by induction, named, and sorted in full by the same
algorithm on the string of their names; all others are induced from them. There are two ways to induce, with the same result.
Over a small alphabet (bytes) buckets are scanned in waves: all suffixes that a bucket holds hand their predecessors on in one
array operation, in order, and predecessors in the same bucket make up its next wave. Over the large alphabets of names, where
buckets hold few suffixes, suffixes are scanned one by one. Both are linear.

Common prefixes are found in text order. Where the letters before a suffix and before its predecessor are equal, the common
prefix is one less than that of the place before; only the other places, whose prefixes add up to O(n log n), are compared.
"""

from __future__ import annotations

import numpy as np

WAVE = 200  # suffixes a letter from which on buckets are scanned in waves


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is larger than the empty suffix."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    step[-1] = -1
    place = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(place[::-1])[::-1]  # the next place where letters differ
    return step[following] > 0


class _Buckets:
    """Suffixes by first letter, appended in order."""

    def __init__(self, size: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(size)]

    def add(self, letters: np.ndarray, suffixes: np.ndarray) -> None:
        if not len(suffixes):
            return
        order = np.argsort(letters, kind="stable")
        letters, suffixes = letters[order], suffixes[order]
        cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        for part, at in zip(np.split(suffixes, cuts), [0, *cuts.tolist()], strict=True):
            self.parts[letters[at]].append(part)

    def take(self, letter: int) -> np.ndarray:
        own = self.parts[letter]
        return np.concatenate(own) if own else np.zeros(0, np.int64)


def _induce_waves(text: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from LMS suffixes in order; a bucket at a time."""
    lms_by_letter = _by_letter(text, lms, size)
    large = _Buckets(size)
    n = len(text)
    large.add(text[n - 1 :], np.array([n - 1]))  # its successor is the empty suffix
    larges = []
    for letter in range(size):
        done, wave = [], large.take(letter)
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            letters = text[before]
            same = letters == letter
            wave = before[same]
            large.add(letters[~same], before[~same])
        larges.append(np.concatenate(done) if done else np.zeros(0, np.int64))
        own = lms_by_letter[letter]
        before = own[own > 0] - 1
        large.add(text[before], before)
    smalls = _Buckets(size)  # each bucket from its end on
    out: list[np.ndarray] = [None] * (2 * size)
    for letter in range(size - 1, -1, -1):
        done, wave = [], smalls.take(letter)
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            before = before[small[before]]
            letters = text[before]
            same = letters == letter
            wave = before[same]
            smalls.add(letters[~same], before[~same])
        own = np.concatenate(done)[::-1] if done else np.zeros(0, np.int64)
        out[2 * letter], out[2 * letter + 1] = larges[letter], own
        before = larges[letter][::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        smalls.add(text[before], before)
    return np.concatenate(out)


def _by_letter(text: np.ndarray, suffixes: np.ndarray, size: int) -> list[np.ndarray]:
    """Suffixes, in order, by their first letter."""
    buckets = _Buckets(size)
    buckets.add(text[suffixes], suffixes)
    return [buckets.take(k) for k in range(size)]


def _induce_each(text: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from LMS suffixes in order; a suffix at a time."""
    n = len(text)
    ends = np.cumsum(np.bincount(text, minlength=size))
    # Letter of the suffix before each one, if that is of the larger (smaller) type, or -1; the last entry is of no suffix.
    larger, smaller = np.full(n + 1, -1), np.full(n + 1, -1)
    larger[1:n] = np.where(small[:-1], -1, text[:-1])
    smaller[1:n] = np.where(small[:-1], text[:-1], -1)
    order = np.full(n, -1, np.int64)
    own = text[lms]
    by = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=size)
    order[np.arange(len(own)) + np.repeat(ends - np.cumsum(counts), counts)] = lms[by]  # at the ends of their buckets
    order = order.tolist()
    free = [0, *ends[:-1].tolist()]
    order[free[int(text[-1])]] = n - 1  # its successor is the empty suffix
    free[int(text[-1])] += 1
    letter_of = larger.tolist()
    for suffix in order:  # grows as it is read
        letter = letter_of[suffix]
        if letter >= 0:
            place = free[letter]
            order[place] = suffix - 1
            free[letter] = place + 1
    free = ends.tolist()
    letter_of = smaller.tolist()
    for suffix in reversed(order):
        letter = letter_of[suffix]
        if letter >= 0:
            free[letter] = place = free[letter] - 1
            order[place] = suffix - 1
    return np.array(order, np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` (non-negative integers) in order; a shorter suffix goes before one that it begins."""
    text = np.ascontiguousarray(text)
    n = len(text)
    if n < 2:
        return np.arange(n)
    size = int(text.max()) + 1
    induce = _induce_waves if n >= WAVE * size else _induce_each
    small = classify(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms):
        first = induce(text, small, lms, size)
        flag = np.zeros(n, bool)
        flag[lms] = True
        in_order = first[flag[first]]
        names = _names(text, small, lms, in_order)
        lms = in_order if names.max() + 1 == len(lms) else lms[suffix_array(names)]
    return induce(text, small, lms, size)


def _names(text: np.ndarray, small: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings, by place; equal substrings share one, and names rise in the order of the substrings."""
    n = len(text)
    index = np.zeros(n, np.int64)
    index[lms] = np.arange(len(lms))
    ends = np.append(lms[1:], n - 1)
    size = (ends - lms)[index[ordered]] + 1
    equal = np.zeros(len(ordered), bool)
    equal[1:] = size[1:] == size[:-1]
    equal[1:] &= ends[index[ordered[1:]]] < n - 1  # the last substring reaches the end, and equals no other
    equal[1:] &= ends[index[ordered[:-1]]] < n - 1
    open_ = np.flatnonzero(equal)
    step = 0
    while len(open_):
        a, b = ordered[open_] + step, ordered[open_ - 1] + step
        differ = (text[a] != text[b]) | (small[a] != small[b])
        equal[open_[differ]] = False
        open_ = open_[~differ]
        step += 1
        open_ = open_[size[open_] > step]
    names = np.zeros(len(lms), np.int64)
    names[index[ordered]] = np.cumsum(~equal) - 1
    return names


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, barrier: int = -1) -> np.ndarray:
    """By place in the text: how much a suffix has in common with the one before it in ``order``; prefixes end before ``barrier``."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)  # one less than at the place before
    follows[1:] = (before[1:] > 0) & (text[:-1] != barrier)
    follows[1:] &= text[:-1] == text[np.maximum(before[1:] - 1, 0)]
    length = np.zeros(n, np.int64)
    open_ = np.flatnonzero(~follows & (before >= 0))
    step = 0
    while len(open_):
        a, b = open_ + step, before[open_] + step
        fits = (a < n) & (b < n)
        open_, a, b = open_[fits], a[fits], b[fits]
        open_ = open_[(text[a] == text[b]) & (text[a] != barrier)]
        step += 1
        length[open_] = step
    place = np.arange(n)
    source = np.maximum.accumulate(np.where(follows, 0, place))
    return length[source] - (place - source)
