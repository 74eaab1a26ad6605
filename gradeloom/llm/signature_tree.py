"""Signature trees: hierarchical token bitmaps for exact set joins inside one bounded block.

A leaf holds one set: its size, the bitmap of its tokens and the *excess*, the number of tokens that
share a bit with another token of the set. An inner node holds the OR of its children's bitmaps, the
range of their sizes and the largest excess. For sets x under node A and y under node B

    |x & y| <= popcount(bitmap(A) & bitmap(B)) + min(excess(A), excess(B)),

so a dual traversal drops a node pair as soon as that bound, or the size ranges, rule out a link.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FAN_OUT = 8
MAX_BITS = 8192
MAX_EXACT_BITS = 1 << 30
PAIRS_AT_ONCE = 1 << 16


@dataclass
class Level:
    bits: np.ndarray  #: packed into 64-bit words, one row per node
    low: np.ndarray
    high: np.ndarray
    excess: np.ndarray
    label: np.ndarray  #: the component that all leaves below share, or -1


def shared_tokens(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Leaf and local number of every token that at least two of the sets hold, and how many there are."""
    tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, count = np.unique(tokens, return_inverse=True, return_counts=True)
    common = count > 1
    rank = np.cumsum(common) - 1
    keep = common[number]
    return owner[keep], rank[number[keep]], int(common.sum())


def _packed(owner: np.ndarray, number: np.ndarray, n: int, width: int) -> np.ndarray:
    """One bitmap row per set; token numbers are taken modulo the width, rounded up to whole words."""
    words = max(1, -(-width // 64))
    cells = np.unique(owner * (words * 64) + number % (words * 64))
    packed = np.zeros((n, words), np.uint64)
    np.bitwise_or.at(packed.reshape(-1), cells // 64, np.uint64(1) << (cells % 64).astype(np.uint64))
    return packed


def leaves(sets: list[np.ndarray], labels: np.ndarray) -> tuple[Level, np.ndarray | None]:
    """The leaf level, and exact bitmaps (a bit for every shared token) unless they would be too large."""
    owner, number, width = shared_tokens(sets)
    packed = _packed(owner, number, len(sets), min(width, MAX_BITS))
    if width <= MAX_BITS:
        exact = packed
    else:
        exact = _packed(owner, number, len(sets), width) if len(sets) * width <= MAX_EXACT_BITS else None
    sizes = np.array([len(s) for s in sets], np.int64)
    held = np.bincount(owner, minlength=len(sets))
    excess = held - np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
    return Level(packed, sizes, sizes, excess, labels), exact


def _overlaps(bits: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Common bits of the rows p and q, a bounded number of words at a time."""
    out = np.empty(len(p), np.int64)
    step = max(1, PAIRS_AT_ONCE * 16 // max(1, bits.shape[1]))
    for k in range(0, len(p), step):
        s = slice(k, k + step)
        out[s] = np.bitwise_count(bits[p[s]] & bits[q[s]]).sum(axis=1, dtype=np.int64)
    return out


def _parent(level: Level) -> Level:
    cuts = np.arange(0, len(level.low), FAN_OUT)
    same = np.minimum.reduceat(level.label, cuts)
    return Level(
        np.bitwise_or.reduceat(level.bits, cuts, axis=0),
        np.minimum.reduceat(level.low, cuts),
        np.maximum.reduceat(level.high, cuts),
        np.maximum.reduceat(level.excess, cuts),
        np.where(same == np.maximum.reduceat(level.label, cuts), same, -1),
    )


def _may_link(x: Level, y: Level, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which node pairs can hold sets a, b with den * |a & b| >= num * |a | b|."""
    fits = (x.high[i] * den >= y.low[j] * num) & (y.high[j] * den >= x.low[i] * num)
    fits &= (x.label[i] < 0) | (x.label[i] != y.label[j])
    fits = np.flatnonzero(fits)
    i, j = i[fits], j[fits]
    most = np.empty(len(i), np.int64)
    step = max(1, PAIRS_AT_ONCE * 16 // max(1, x.bits.shape[1]))
    for k in range(0, len(i), step):
        s = slice(k, k + step)
        most[s] = np.bitwise_count(x.bits[i[s]] & y.bits[j[s]]).sum(axis=1, dtype=np.int64)
    most += np.minimum(x.excess[i], y.excess[j])
    most = np.minimum(most, np.minimum(x.high[i], y.high[j]))
    return fits[(num + den) * most >= num * (x.low[i] + y.low[j])]


def _children(i: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    first = i * FAN_OUT
    return first, np.minimum(n - first, FAN_OUT)


def linked_pairs(sets: list[np.ndarray], num: int, den: int, labels: np.ndarray | None = None, side: np.ndarray | None = None):
    """Yield arrays of index pairs whose sets have Jaccard similarity of at least num/den, exactly.

    ``labels``: pairs that already share a component are skipped, whole node pairs at a time.
    ``side``: 0 or 1 for each set; only pairs across sides are looked for. Empty sets never link.
    """
    labels = np.arange(len(sets)) if labels is None else labels
    side = np.zeros(len(sets), np.int64) if side is None else side
    sizes = np.array([len(s) for s in sets], np.int64)
    parts = [np.flatnonzero((side == k) & (sizes > 0)) for k in (0, 1)]
    cross = len(parts[1]) > 0
    if not len(parts[0]):
        return
    order = np.concatenate([p[np.lexsort((labels[p], sizes[p]))] for p in parts])
    base, exact = leaves([sets[k] for k in order], labels[order])
    cut = len(parts[0])

    def tree(a: int, b: int) -> list[Level]:
        levels = [Level(base.bits[a:b], base.low[a:b], base.high[a:b], base.excess[a:b], base.label[a:b])]
        while len(levels[-1].low) > 1:
            levels.append(_parent(levels[-1]))
        return levels

    left = tree(0, cut)
    right = tree(cut, len(order)) if cross else left
    while len(left) < len(right):
        left.append(left[-1])
    while len(right) < len(left):
        right.append(right[-1])
    stack = [(len(left) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, i, j = stack.pop()
        if not cross:
            keep = i < j if depth == 0 else i <= j
            i, j = i[keep], j[keep]
        own = (i == j) if not cross else np.zeros(len(i), bool)
        fits = np.zeros(len(i), bool)
        fits[_may_link(left[depth], right[depth], i, j, num, den)] = True
        if depth:
            fits |= own & (left[depth].label[i] < 0)
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        if depth:
            below = depth - 1
            a, na = _children(i, len(left[below].low)) if len(left[below].low) > len(left[depth].low) else (i, np.ones_like(i))
            b, nb = _children(j, len(right[below].low)) if len(right[below].low) > len(right[depth].low) else (j, np.ones_like(j))
            for k in range(0, len(i), PAIRS_AT_ONCE // (FAN_OUT * FAN_OUT)):
                s = slice(k, k + PAIRS_AT_ONCE // (FAN_OUT * FAN_OUT))
                many = na[s] * nb[s]
                at = np.repeat(np.arange(len(many)), many)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                stack.append((below, a[s][at] + nth // nb[s][at], b[s][at] + nth % nb[s][at]))
            continue
        j = j + (cut if cross else 0)
        p, q = order[i], order[j]
        if exact is not None:
            hits = _overlaps(exact, i, j)
        else:
            hits = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(p, q)], np.int64)
        keep = (num + den) * hits >= num * (sizes[p] + sizes[q])
        p, q = p[keep], q[keep]
        if len(p):
            yield p, q


def join_labels(labels: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Components after adding the edges p-q: every label becomes the least one it is tied to."""
    while len(p):
        a, b = labels[p], labels[q]
        if not (a != b).any():
            return labels
        least = np.arange(labels.max() + 1)
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]
        labels = least[labels]
    return labels
