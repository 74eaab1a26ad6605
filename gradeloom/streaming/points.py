"""The points of one subject as questions arrive: nearest point, adaptive thresholds, fading and promotion.

A point's threshold is the median of its members' pairwise cosines less their median absolute deviation, a floor at
least. The pairs aren't kept: each point has counts of them in fine bins, which bound the threshold from both sides, and only a
similarity between the bounds has the cosines worked out again, block by block, to select the middle ones exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np

#: Equal bins over [-1, 1], what rounding may move a value by, and members of a block.
BINS = 8192
SLACK = 1e-9
BLOCK_MEMBERS = 256
TINY = 1e-10

Blocks = Callable[[str, int], Iterator[np.ndarray]]


def bin_of(cosines: np.ndarray) -> np.ndarray:
    return np.clip(((cosines + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def edges(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = bins * (2 / BINS) - 1
    return low - SLACK, low + 2 / BINS + SLACK


def middle_of(values: np.ndarray, counts: np.ndarray) -> float:
    """Median of values that occur ``counts`` times."""
    order = np.argsort(values, kind="stable")
    upto, n = np.cumsum(counts[order]), int(counts.sum())
    return float((values[order[np.searchsorted(upto, (n - 1) // 2, "right")]] + values[order[np.searchsorted(upto, n // 2, "right")]]) / 2)


def selected(chunks: Iterator[np.ndarray], low: float, high: float, n: int) -> float:
    """Median of n values that is known to lie in [low, high]; only values in there are kept."""
    below, kept = 0, []
    for x in chunks:
        below += int(np.count_nonzero(x < low))
        kept.append(x[(x >= low) & (x <= high)])
    x = np.sort(np.concatenate(kept))
    return float((x[(n - 1) // 2 - below] + x[n // 2 - below]) / 2)


def rank_range(low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Where the two middle values lie at least and at most, when each lies between its low and its high."""
    n = int(counts.sum())
    a, b = np.argsort(low, kind="stable"), np.argsort(high, kind="stable")
    return float(low[a[np.searchsorted(np.cumsum(counts[a]), (n - 1) // 2, "right")]]), float(high[b[np.searchsorted(np.cumsum(counts[b]), n // 2, "right")]])


def distances(bins: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of |x - m| for x in each bin and m in [low, high]."""
    a, b = edges(bins)
    return np.maximum(0, np.maximum(a - high, low - b)), np.maximum(b - low, high - a)


def unit_row(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) + TINY)


@dataclass
class Point:
    name: str
    centre: np.ndarray
    total: np.ndarray
    n: int = 0
    stable: bool = False
    bins: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    bounds: tuple[float, float] | None = None


class Members:
    """Unit vectors of points' members in blocks; ``read`` and ``write`` reach the state that outlasts a batch."""

    def __init__(self, read: Callable[[str, int], np.ndarray | None] = lambda name, k: None, write: Callable[[str, int, np.ndarray], None] = lambda name, k, rows: None):
        self.read, self.write = read, write
        self.held: dict[tuple[str, int], np.ndarray] = {}
        self.changed: set[tuple[str, int]] = set()

    def block(self, name: str, k: int) -> np.ndarray:
        if (name, k) not in self.held:
            found = self.read(name, k)
            self.held[name, k] = np.empty((0, 0)) if found is None else found
        return self.held[name, k]

    def blocks(self, name: str, n: int) -> Iterator[np.ndarray]:
        for k in range(-(-n // BLOCK_MEMBERS)):
            yield self.block(name, k)

    def append(self, name: str, n: int, row: np.ndarray) -> None:
        """Add member n."""
        k = n // BLOCK_MEMBERS
        rows = self.block(name, k) if n % BLOCK_MEMBERS else np.empty((0, len(row)))
        self.held[name, k] = np.concatenate([rows, row[None]])
        self.changed.add((name, k))

    def save(self) -> None:
        for name, k in self.changed:
            self.write(name, k, self.held[name, k])
        self.changed.clear()


class Points:
    """All points of a subject, in the order they came."""

    def __init__(self, floor: float = 0.50, spread: float = 1.0, least: int = 3, decay: float = 0.05, members: Members | None = None, points: Sequence[Point] = ()):
        self.floor, self.spread, self.least, self.decay = floor, spread, least, decay
        self.members = members or Members()
        self.points: dict[str, Point] = {}
        self.names: list[str] = []
        self.centres, self.norms = np.empty((0, 0)), np.empty(0)
        self.changed: set[str] = set()
        for p in points:
            self._put(p)
        self.changed.clear()

    def _put(self, p: Point) -> None:
        n = len(self.names)
        if n == len(self.centres):
            room = max(8, n)
            self.centres = np.concatenate([self.centres.reshape(n, len(p.centre)), np.zeros((room, len(p.centre)))])
            self.norms = np.concatenate([self.norms, np.zeros(room)])
        self.points[p.name] = p
        self.names.append(p.name)
        self._centre(n, p.centre)

    def _centre(self, at: int, centre: np.ndarray) -> None:
        p = self.points[self.names[at]]
        p.centre = self.centres[at] = centre
        self.norms[at] = np.linalg.norm(centre)
        self.changed.add(p.name)

    def give(self, name: str, centre: np.ndarray, stable: bool) -> None:
        """A point that was there before; one that is known stays as it is."""
        if name not in self.points:
            self._put(Point(name, centre, np.zeros_like(centre), stable=stable))

    def add_member(self, name: str, v: np.ndarray) -> None:
        """A member; the point's centre stays. A member of an unknown point is left out."""
        if (p := self.points.get(name)) is None:
            return
        row = unit_row(v)
        if p.n:
            bins, counts = np.unique(np.concatenate([bin_of(b @ row) for b in self.members.blocks(name, p.n)]), return_counts=True)
            all_, at = np.unique(np.concatenate([p.bins, bins]), return_inverse=True)
            summed = np.zeros(len(all_), np.int64)
            np.add.at(summed, at, np.concatenate([p.counts, counts]))
            p.bins, p.counts = all_, summed
        self.members.append(name, p.n, row)
        p.n, p.total, p.bounds = p.n + 1, p.total + v, None
        self.changed.add(name)

    def _pairs(self, p: Point) -> Iterator[np.ndarray]:
        for a, b in combinations_with_replacement(range(-(-p.n // BLOCK_MEMBERS)), 2):
            found = self.members.block(p.name, a) @ self.members.block(p.name, b).T
            yield found[np.triu_indices(len(found), 1)] if a == b else found.ravel()

    def threshold(self, p: Point) -> float:
        """Median less spread times MAD of the members' cosines, exactly."""
        n = p.n * (p.n - 1) // 2
        median = selected(self._pairs(p), *rank_range(*edges(p.bins), p.counts), n)
        away = rank_range(*distances(p.bins, median, median), p.counts)
        return median - self.spread * selected((np.abs(x - median) for x in self._pairs(p)), *away, n)

    def reaches(self, p: Point, cosine: float) -> bool:
        if cosine < self.floor or p.n < self.least:
            return cosine >= self.floor
        if p.bounds is None:
            low, high = rank_range(*edges(p.bins), p.counts)
            near, far = rank_range(*distances(p.bins, low, high), p.counts)
            p.bounds = (low - self.spread * far, high - self.spread * near)
        if p.bounds[0] <= cosine < p.bounds[1]:
            exact = self.threshold(p)
            p.bounds = (exact, exact)
        return cosine >= p.bounds[1]

    def place(self, id_: int, v: np.ndarray) -> tuple[str, str, float]:
        """Point, event and similarity of a question."""
        n = len(self.names)
        if n:
            cosines = self.centres[:n] @ v / (self.norms[:n] * np.linalg.norm(v) + TINY)
            at = int(np.argmax(cosines))
            p = self.points[self.names[at]]
            if self.reaches(p, float(cosines[at])):
                self.add_member(p.name, v)
                self._centre(at, p.total / p.n)
                return p.name, "assigned", float(cosines[at])
        name = f"kp_emb_{id_}"
        if name in self.points:  # a question that comes twice and is far from its own, faded or shifted point
            self.add_member(name, v)
            self._centre(self.names.index(name), v)
        else:
            self._put(Point(name, v, np.zeros_like(v)))
            self.add_member(name, v)
        return name, "created", 1.0

    def end_paper(self) -> tuple[list[tuple[str, str, float]], int]:
        """Young points fade or become stable: what happened to each, and how many stay young."""
        out, young = [], 0
        for at, name in enumerate(self.names):
            p = self.points[name]
            if p.stable:
                continue
            if p.n >= self.least:
                p.stable = True
                self.changed.add(name)
                out.append((name, "promoted", 1.0))
            else:
                young += 1
                self._centre(at, p.centre * (1.0 - self.decay))
                out.append((name, "faded", float(self.norms[at])))
        return out, young
