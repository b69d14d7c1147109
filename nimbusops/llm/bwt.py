"""Equal substrings of a minimum length by interval expansion on a Burrows-Wheeler transform.

Contexts (byte strings with an end mark each) are put in the order of their suffixes by prefix doubling
up to the minimum length, where only suffixes whose continuations differ are ordered anew. Breadth-first backward extension then starts from the interval of the empty
string: an interval of a string w splits by the characters in front of it into the intervals of cw.
The right end of an interval found at length n is a place where neighbours in suffix order share n - 1
characters, unless a shorter interval ended there; so common prefixes come by increasing value, and
the search stops at the minimum length. Suffixes that no end parts share at least that many characters.
"""

from __future__ import annotations

import numpy as np

PER_ROW = 64  # intervals up to this many rows are split row by row, larger ones character by character


def suffix_order(text: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Order of all suffixes by their first `length` symbols. text: symbols 0..256, 0 ends a context;
    room: symbols up to and including the context's end."""
    n, size = len(text), 7
    padded = np.concatenate([text, np.zeros(size, text.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(size):
        key = (key << np.uint64(9)) | np.where(room > i, padded[i:n + i], 0)
    order = np.argsort(key)
    new = _changes(key[order])
    rank = np.empty(n, np.int64)
    while size < length and not new.all():
        rank[order] = group = np.cumsum(new)
        after = np.zeros(n, np.int64)
        inside = np.flatnonzero(room > size)
        after[inside] = rank[inside + size]
        after = after[order]
        torn = np.zeros(group[-1] + 1, bool)
        torn[group[1:][~new[1:] & (after[1:] != after[:-1])]] = True
        rows = np.flatnonzero(torn[group])
        if not len(rows):  # suffixes that share `size` symbols share all that follow
            break
        both = (group[rows] << 32) | after[rows]
        place = np.argsort(both)
        order[rows] = order[rows[place]]
        new[rows] = _changes(both[place])
        size *= 2
    return order


def _changes(values: np.ndarray) -> np.ndarray:
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def ends_below(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place between suffix rows (and at both ends): do its neighbours share fewer than `length`
    symbols?"""
    n = len(text)
    before = text[order - 1]  # of the first suffix: the last end mark
    by_char = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)
    to[by_char] = np.arange(n)
    starts = np.searchsorted(before[by_char], np.arange(258))
    ended = np.zeros(n + 1, bool)
    ended[0] = ended[n] = True
    # Length 1: an interval per character. End marks are found here only, as no string goes across one.
    bounds = np.unique(starts)
    low, high = bounds[:-1], bounds[1:]
    for size in range(1, length + 1):
        fresh = ~ended[high]
        if size == 1:
            fresh |= True
        ended[high] = True
        low, high = low[fresh], high[fresh]
        if size == length or not len(low):
            break
        rows = high - low
        large = rows > PER_ROW
        found = [_by_row(before, to, low[~large], rows[~large])]
        if large.any():
            found.append(_by_character(before, by_char, starts, low[large], high[large]))
        low, high = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    return ended


def _by_row(before, to, low, rows):
    if not len(low):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    of = np.repeat(np.arange(len(low)), rows)
    row = np.arange(len(of)) + np.repeat(low - (np.cumsum(rows) - rows), rows)
    char = before[row]
    keep = char > 0
    of, row, char = of[keep], row[keep], char[keep]
    at = to[row]
    if len(of) == len(low) and (rows == 1).all():
        return at, at + 1
    order = np.argsort(of * 512 + char, kind="stable")
    of, char, at = of[order], char[order], at[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (char[1:] != char[:-1])
    first = np.flatnonzero(new)
    return at[first], at[first] + np.diff(np.append(first, len(of)))


def _by_character(before, by_char, starts, low, high):
    lows, highs = [], []
    for c in range(1, 257):
        own = by_char[starts[c]:starts[c + 1]]
        if len(own):
            a, b = np.searchsorted(own, low), np.searchsorted(own, high)
            some = a < b
            lows.append(starts[c] + a[some])
            highs.append(starts[c] + b[some])
    return (np.concatenate(lows), np.concatenate(highs)) if lows else (np.empty(0, np.int64), np.empty(0, np.int64))


def repeats(contexts: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, place and class of every substring of `length` bytes that lies in one context of the byte
    array; equal substrings, and no others, have equal class. Ordered by class."""
    sizes = np.diff(bounds)
    context = np.repeat(np.arange(len(sizes)), sizes + 1)
    at = bounds[:-1] + np.arange(len(sizes))  # contexts in the text with end marks
    place = np.arange(len(contexts) + len(sizes)) - np.repeat(at, sizes + 1)
    room = np.repeat(sizes + 1, sizes + 1) - place
    text = np.zeros(len(place), np.int16)
    text[room > 1] = contexts.astype(np.int16) + 1
    order = suffix_order(text, room, length)
    group = np.cumsum(ends_below(text, order, length)[:-1])
    whole = room[order] > length
    return context[order][whole], place[order][whole], group[whole]
