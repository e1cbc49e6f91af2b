"""Binary trie self-join: all pairs of distinct 64-bit codes that differ in few bits.

A sorted array of codes is a binary trie: a node is a range of it, and its children are
the codes whose next bit is 0 or 1. The join walks pairs of nodes together, one bit per
level. A node paired with itself yields its children paired with themselves and, at the
cost of one bit, with each other; two different nodes yield four pairs. A pair whose
differing bits exceed the budget is dropped with everything below it.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS = 64
LEAD = 2


def segments(bits: tuple[int, ...], n: int) -> list[tuple[int, ...]]:
    """``bits`` cut into ``n`` runs of nearly equal length."""
    cuts = [round(i * len(bits) / n) for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def fan_out(radius: int) -> int:
    """Bit orders that ``orders`` makes from one path."""
    return (radius + LEAD) * (radius + LEAD - 1) // 2


@lru_cache(maxsize=100_000)
def free_bits(path: int, radius: int) -> tuple[int, ...]:
    """Bits (0 the highest) that may still differ below ``path``."""
    if path == 0:
        return tuple(range(BITS))
    base = fan_out(radius) + 1
    above, turn = free_bits(path // base, radius), path % base - 1
    fixed = {b for part in list(combinations(segments(above, radius + LEAD), LEAD))[turn] for b in part}
    return tuple(b for b in above if b not in fixed)


@lru_cache(maxsize=100_000)
def lead_mask(path: int, radius: int) -> int:
    """The bits above ``path`` in its trie, where no difference is allowed."""
    free = set(free_bits(path, radius))
    return sum(1 << (BITS - 1 - b) for b in range(BITS) if b not in free)


def orders(path: int, radius: int) -> list[int]:
    """Paths one step below: every choice of two segments to come first.

    The free bits are cut into ``radius + 2`` segments. Two codes within the radius agree
    in at least two of these, so in at least one of the tries they lie below one node at
    the depth where the budget is still untouched.
    """
    base = fan_out(radius) + 1
    return [path * base + 1 + i for i in range(fan_out(radius))]


def splittable(path: int, radius: int) -> bool:
    """False when so few bits are free that the group below cannot be large."""
    return len(free_bits(path, radius)) > 12


def joined(group: np.ndarray, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of codes in the same group that differ in at most ``radius`` bits.

    ``group`` and ``code`` (unsigned) are sorted by both; codes are distinct in a group.
    """
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    edge = np.flatnonzero(np.diff(group)) + 1
    lo, hi = np.r_[0, edge], np.r_[edge, len(group)]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    own_lo, own_hi = lo.astype(np.int64), hi.astype(np.int64)
    a_lo = a_hi = b_lo = b_hi = err = np.zeros(0, np.int64)
    for bit in range(BITS - 1, -1, -1):
        if not len(own_lo) and not len(a_lo):
            break
        ones = np.r_[0, np.cumsum((code >> np.uint64(bit)) & np.uint64(1))].astype(np.int64)
        own_mid = own_hi - (ones[own_hi] - ones[own_lo])
        a_mid = a_hi - (ones[a_hi] - ones[a_lo])
        b_mid = b_hi - (ones[b_hi] - ones[b_lo])
        pairs = [
            (own_lo, own_mid, own_mid, own_hi, np.ones(len(own_lo), np.int64)),
            (a_lo, a_mid, b_lo, b_mid, err),
            (a_mid, a_hi, b_mid, b_hi, err),
            (a_lo, a_mid, b_mid, b_hi, err + 1),
            (a_mid, a_hi, b_lo, b_mid, err + 1),
        ]
        own_lo, own_hi = np.r_[own_lo, own_mid], np.r_[own_mid, own_hi]
        more = own_hi - own_lo > 1
        own_lo, own_hi = own_lo[more], own_hi[more]
        a_lo, a_hi, b_lo, b_hi, err = (np.concatenate(x) for x in zip(*pairs))
        keep = (err <= radius) & (a_hi > a_lo) & (b_hi > b_lo)
        single = keep & (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        x, y = a_lo[single], b_lo[single]
        near = np.bitwise_count(code[x] ^ code[y]) <= radius
        found_a.append(x[near])
        found_b.append(y[near])
        keep &= ~single
        a_lo, a_hi, b_lo, b_hi, err = (v[keep] for v in (a_lo, a_hi, b_lo, b_hi, err))
    return np.concatenate(found_a), np.concatenate(found_b)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` items the smallest one reachable over the pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def linked(group: np.ndarray, code: np.ndarray, radius: int, work: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """For each code with a link in its group, the group's smallest code it reaches.

    Groups are taken together until the squares of their sizes add up to ``work``, which
    bounds the node pairs held at a time.
    """
    edge = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
    cost = np.cumsum(np.diff(edge).astype(np.int64) ** 2)
    out_a, out_b, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    while at < len(cost):
        spent = cost[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(cost, spent + work, "right")))
        part = slice(edge[at], edge[to])
        codes = code[part]
        a, b = joined(group[part], codes, radius)
        root = roots(len(codes), a, b)
        moved = root != np.arange(len(codes))
        out_a.append(codes[moved])
        out_b.append(codes[root[moved]])
        at = to
    return np.concatenate(out_a), np.concatenate(out_b)
