"""Hamming-radius self-join of codes of 64-bit words by a Gray-order hierarchy.

Codes are sorted by Gray rank, so that neighbours differ in few bits. Runs of
FAN codes form a node that keeps the bits all of its members share (mask) and
their value; nodes form higher nodes in the same way. A pair of nodes is
descended with the differences found so far: the bits that both sides of a
pair share, and that its parents did not, are compared once and their number
is added; beyond the radius the whole pair of groups is pruned.
"""

from __future__ import annotations

import numpy as np

FAN = 8
CHUNK = 1 << 19


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


def build_levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(value, mask) of the nodes, from the codes (leaves) up to at most FAN nodes."""
    value, mask = codes.astype(np.uint64), np.full(codes.shape, ~np.uint64(0), np.uint64)
    levels = [(value, mask)]
    while len(value) > FAN:
        starts = np.arange(0, len(value), FAN)
        first = np.repeat(value[starts], np.diff(np.append(starts, len(value))), axis=0)
        shared = np.bitwise_and.reduceat(mask & ~(value ^ first), starts, axis=0)
        value, mask = value[starts], shared
        levels.append((value, mask))
    return levels


class Labels:
    """Smallest member of each set, under unions of many pairs at a time."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        of = self.of
        while len(a):
            x, y = of[a], of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(of, np.maximum(x, y), np.minimum(x, y))
            while (of[of] != of).any():
                of[:] = of[of]


def link_within(codes: np.ndarray, radius: int, labels: Labels, at: np.ndarray) -> None:
    """Links at[i] and at[j] in labels for all codes i, j with at most radius differing bits.

    codes has a row of 64-bit words for each code, sorted by the Gray rank of
    the first word. Pairs of groups whose members are all
    linked to one another already are not descended again.
    """
    levels = build_levels(codes)
    top = len(levels) - 1
    a, b = np.triu_indices(len(levels[top][0]))
    far = a != b
    none = np.zeros((len(a), codes.shape[1]), np.uint64)
    stack = [(top, x, none[: len(x[0])], np.zeros(len(x[0]), np.int16)) for x in ((a[far], b[far]), (a[~far], b[~far]))]
    uniform = _uniform(labels.of[at], levels)
    while stack:
        level, (a, b), known, sofar = stack.pop()
        if not len(a):
            continue
        if len(a) > CHUNK:
            half = len(a) // 2
            stack.append((level, (a[half:], b[half:]), known[half:], sofar[half:]))
            stack.append((level, (a[:half], b[:half]), known[:half], sofar[:half]))
            continue
        value, mask = levels[level]
        shared = mask[a] & mask[b]
        sofar = sofar + np.bitwise_count((value[a] ^ value[b]) & shared & ~known).sum(axis=1, dtype=np.int16)
        keep = sofar <= radius
        one = uniform[level]
        keep &= ~((one[a] >= 0) & (one[a] == one[b]))
        if level == 0:
            keep &= a != b
            if keep.any():
                labels.link(at[a[keep]], at[b[keep]])
                uniform = _uniform(labels.of[at], levels)
            continue
        a, b, shared, sofar = a[keep], b[keep], shared[keep], sofar[keep]
        if not len(a):
            continue
        below = len(levels[level - 1][0])
        da, db = np.divmod(np.arange(FAN * FAN), FAN)
        x, y = (a[:, None] * FAN + da).ravel(), (b[:, None] * FAN + db).ravel()
        ok = (x < below) & (y < below) & (x <= y)
        x, y = x[ok], y[ok]
        shared, sofar = np.repeat(shared, FAN * FAN, axis=0)[ok], np.repeat(sofar, FAN * FAN)[ok]
        near = x == y
        for part in (~near, near):  # the diagonal is on top: it links most, and so prunes what follows
            stack.append((level - 1, (x[part], y[part]), shared[part], sofar[part]))


def _uniform(labels: np.ndarray, levels: list) -> list[np.ndarray]:
    """By level: the label of a node whose members all have it, else -1."""
    out = [labels.copy()]
    for value, _ in levels[1:]:
        low = out[-1]
        starts = np.arange(0, len(low), FAN)
        least, most = np.minimum.reduceat(low, starts), np.maximum.reduceat(low, starts)
        out.append(np.where(least == most, least, -1))
    return out
