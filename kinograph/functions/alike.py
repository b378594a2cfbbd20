"""Similarity of many pairs of strings at once.

The ratio is twice the matched characters over both lengths. Matched are the longest common
substring (the earliest of equals, first on the left, then on the right) and, in the same way, what
stands to its left and to its right.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Kinds of characters told apart by the bound.
CHARS = 64
#: Pairs of ranges searched together.
_SLICE = 8192
#: From this length of the right string on, its frequent characters start no match.
LONG = 200


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text in a row, and lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    out = np.zeros((len(texts), int(size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def character_counts(text_codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Characters by code modulo ``CHARS``: what two strings share here is at least what they share."""
    out = np.zeros((len(size), CHARS), np.uint16)
    row, at = np.nonzero(np.arange(text_codes.shape[1]) < size[:, None])
    np.add.at(out, (row, text_codes[row, at] % CHARS), 1)
    return out


def _window(text_codes, rows, low, high, other):
    at = low[:, None] + np.arange(int((high - low).max()))
    inside = at < high[:, None]
    return np.where(inside, text_codes[rows[:, None], np.minimum(at, text_codes.shape[1] - 1)], np.uint32(other))


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and starts of the first longest run that each row of ``a`` shares with that of ``b``."""
    n, width = b.shape
    kind = np.uint8 if min(a.shape[1], width) < 255 else np.uint16
    runs, best, at_a, at_b = np.zeros((n, width + 1), kind), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(a.shape[1]):
        now = (runs[:, :-1] + kind(1)) * (a[:, k, None] == b)
        more = np.flatnonzero(now.max(axis=1) > best)
        if len(more):
            end = now[more].argmax(axis=1)
            size = now[more, end].astype(np.int64)
            best[more], at_a[more], at_b[more] = size, k + 1 - size, end + 1 - size
        runs[:, 1:] = now
    return best, at_a, at_b


def matched(left: tuple, right: tuple, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Matched characters of rows i of ``left`` and j of ``right`` (both from ``codes``). Pairs that
    cannot reach ``least`` are given up and return less."""
    done = np.zeros(len(i), np.int64)
    zero = np.zeros(len(i), np.int64)
    todo = [np.arange(len(i)), zero, left[1][i], zero, right[1][j]]
    while len(todo[0]):
        pair, a1, a2, b1, b2 = todo
        room = np.minimum(a2 - a1, b2 - b1)
        most = done + np.bincount(pair, room, minlength=len(i))
        live = np.flatnonzero((room > 0) & (most[pair] >= least[pair]))
        live = live[np.argsort(((a2 - a1) * (b2 - b1))[live], kind="stable")]
        after = []
        for k in range(0, len(live), _SLICE):
            p, x1, x2, y1, y2 = (c[live[k:k + _SLICE]] for c in todo)
            size, x, y = _longest(_window(left[0], i[p], x1, x2, 0xFFFFFFFF), _window(right[0], j[p], y1, y2, 0xFFFFFFFE))
            np.add.at(done, p, size)
            hit = size > 0
            p, x1, x2, y1, y2, size, x, y = (c[hit] for c in (p, x1, x2, y1, y2, size, x1 + x, y1 + y))
            after += [(p, x1, x, y1, y), (p, x + size, x2, y + size, y2)]
        todo = [np.concatenate(c) for c in zip(*after)] if after else [zero[:0]] * 5
    return done


def near_pairs(asked: list[str], need: np.ndarray, forms: list[str], lift: np.ndarray, scale: float = 0.9) -> tuple:
    """Pairs of ``asked`` and ``forms`` with ``scale * ratio + lift >= need``: places in both, and ratios.

    A ratio is at most twice the shared characters over both lengths; no other pair is left out.
    """
    left, right = codes(asked), codes(forms)
    have_left, have_right = character_counts(*left), character_counts(*right)
    i, j, floor = [], [], []
    for k, own in enumerate(have_left):
        total = left[1][k] + right[1]
        least = (need[k] - lift) / scale * total / 2 - 1e-9
        hits = np.flatnonzero(np.minimum(have_right, own).sum(axis=1) >= least)
        i.append(np.full(len(hits), k))
        j.append(hits)
        floor.append(least[hits])
    i, j, floor = np.concatenate(i), np.concatenate(j), np.concatenate(floor)
    same = _ratios(asked, left, forms, right, i, j, floor)
    total = left[1][i] + right[1][j]
    ok = same * total / 2 >= floor
    return i[ok], j[ok], same[ok]


def _ratios(asked, left, forms, right, i, j, floor):
    total = left[1][i] + right[1][j]
    out = np.ones(len(i))
    short = (right[1][j] < LONG) & (total > 0)
    out[short] = 2.0 * matched(left, right, i[short], j[short], floor[short]) / total[short]
    for k in np.flatnonzero((right[1][j] >= LONG) & (total > 0)).tolist():
        out[k] = SequenceMatcher(None, asked[i[k]], forms[j[k]]).ratio()
    return out


def pair_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The ratio of each a with the b beside it."""
    left, right, places = codes(a), codes(b), np.arange(len(a))
    return _ratios(a, left, b, right, places, places, np.zeros(len(a)))
