"""Boxes of a k-d partition, and the nearest points of one leaf; used inside tasks and, for a sample, on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHUNK = 4096
MOST_PAIRS = 1 << 18
"""Pairs of targets and boxes that are held at once; more targets are looked at in halves."""


def splitters(points: np.ndarray, depth: int) -> tuple[list[int], list[float]]:
    """Axis and value of the inner nodes of a complete tree of ``depth`` levels, by medians along the widest axis.

    Node 1 is the root, the children of node i are 2 i (below the value) and 2 i + 1 (others); entry 0 is not used.
    """
    axis, value, held = [0] * (1 << depth), [0.0] * (1 << depth), {1: points}
    for node in range(1, 1 << depth):
        own = held.pop(node)
        if len(own):
            axis[node] = int(np.ptp(own, axis=0).argmax())
            along = own[:, axis[node]]
            value[node] = float(np.partition(along, len(along) // 2)[len(along) // 2])
        below = own[:, axis[node]] < value[node]
        held[2 * node], held[2 * node + 1] = own[below], own[~below]
    return axis, value


@dataclass
class Boxes:
    """Bounding boxes and numbers of points of all nodes of a complete tree, numbered as in :func:`splitters`."""

    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    @classmethod
    def of_leaves(cls, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> Boxes:
        """From the leaves, whose number is a power of two; a leaf without points has a box from inf to -inf."""
        n = len(count)
        out = cls(np.full((2 * n, low.shape[1]), np.inf), np.full((2 * n, low.shape[1]), -np.inf), np.zeros(2 * n, np.int64))
        out.low[n:], out.high[n:], out.count[n:] = low, high, count
        for node in range(n - 1, 0, -1):
            a, b = 2 * node, 2 * node + 1
            out.low[node], out.high[node] = np.minimum(out.low[a], out.low[b]), np.maximum(out.high[a], out.high[b])
            out.count[node] = out.count[a] + out.count[b]
        return out

    @property
    def leaves(self) -> int:
        return len(self.count) // 2

    def near(self, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distance from each target to the nearest place of its box."""
        gap = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0.0)
        return (gap * gap).sum(1)

    def far(self, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.abs(self.low[node] - q), np.abs(self.high[node] - q))
        return (gap * gap).sum(1)

    def bound(self, q: np.ndarray, leaf: np.ndarray, k: int) -> np.ndarray:
        """A squared distance within which each target has ``k`` points, from the boxes above its leaf; inf if unknown."""
        node, out = leaf + self.leaves, np.full(len(q), np.inf)
        while node.any():
            enough = self.count[node] >= k
            out[enough] = np.minimum(out[enough], self.far(q[enough], node[enough]))
            node = node >> 1
            node[out < np.inf] = 0
        return out * (1 + 1e-12)

    def meeting(self, q: np.ndarray, r2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(target, leaf, squared distance of the leaf's box) of all leaves that may hold one of the ``k`` nearest points
        within ``r2``, and the bounds, which the boxes of each level make smaller; None if that is too many at once."""
        target, node, bound = np.arange(len(q)), np.ones(len(q), np.int64), r2.copy()
        near = self.near(q, node)
        while len(node) and node[0] < self.leaves:
            target, node = np.repeat(target, 2), np.repeat(2 * node, 2)
            node[1::2] += 1
            full = self.count[node] >= k
            np.minimum.at(bound, target[full], self.far(q[target[full]], node[full]) * (1 + 1e-12))
            near = self.near(q[target], node)
            keep = (self.count[node] > 0) & (near <= bound[target])
            target, node, near = target[keep], node[keep], near[keep]
            if len(node) > MOST_PAIRS and len(q) > 1:
                return None
        return target, node - self.leaves, near, bound


class Leaf:
    """The points of one leaf in buckets of a tree of their own."""

    def __init__(self, points: np.ndarray, rank: np.ndarray, k: int, low: np.ndarray | None = None, high: np.ndarray | None = None, lines: np.ndarray | None = None) -> None:
        """``rank`` orders points at equal distances. With ``lines`` (x1, y1, x2, y2) distances are those to the segments,
        of which the boxes from ``low`` to ``high`` hold the parts that the points stand for."""
        n, bucket = len(points), max(8, 2 * k)
        depth = max(0, int(np.ceil(np.log2(max(1.0, n / bucket)))))
        order, cuts = np.arange(n), [0, n]
        for _ in range(depth):
            finer = [0]
            for a, z in zip(cuts, cuts[1:], strict=False):
                own = points[order[a:z]]
                along = own[:, np.ptp(own, axis=0).argmax()]
                order[a:z] = order[a:z][np.argpartition(along, (z - a) // 2)]
                finer += [a + (z - a) // 2, z]
            cuts = finer
        sizes = np.diff(cuts)
        self.points, self.rank, self.lines, self.examined = points, rank, lines, 0
        low, high = points if low is None else low, points if high is None else high
        place = np.arange(sizes.max(initial=0))[None, :]
        self.members = np.where(place < sizes[:, None], order[np.minimum(np.array(cuts[:-1])[:, None] + place, max(n - 1, 0))], -1) if n else np.zeros((1, 0), np.int64)
        if n:
            low, high = np.minimum.reduceat(low[order], cuts[:-1]), np.maximum.reduceat(high[order], cuts[:-1])
            self.boxes = Boxes.of_leaves(low, high, sizes)

    def _distances(self, q: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        inside = self.members[bucket]
        out = np.zeros(inside.shape)
        for i in range(q.shape[1]) if self.lines is None else ():
            out += (q[:, i, None] - self.points[inside, i]) ** 2
        if self.lines is not None:
            x1, y1, x2, y2 = np.moveaxis(self.lines[inside], 2, 0)
            dx, dy, px, py = x2 - x1, y2 - y1, q[:, 0, None], q[:, 1, None]
            length = dx * dx + dy * dy
            t = np.clip(((px - x1) * dx + (py - y1) * dy) / np.where(length > 0, length, 1.0), 0.0, 1.0)
            out = (px - (x1 + t * dx)) ** 2 + (py - (y1 + t * dy)) ** 2
        self.examined += int((inside >= 0).sum())
        return np.where(inside >= 0, out, np.inf)

    def search(self, q: np.ndarray, k: int, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(target, point, squared distance) of the ``k`` nearest points within ``r2`` of every target, nearest first."""
        if not len(self.points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        found = [(a, *self._search(q[a : a + CHUNK], k, r2[a : a + CHUNK])) for a in range(0, len(q), CHUNK)]
        parts = [np.concatenate([x[i] + (x[0] if i == 1 else 0) for x in found]) if found else np.zeros(0) for i in (1, 2, 3)]
        return parts[0].astype(np.int64), parts[1].astype(np.int64), parts[2]

    def _search(self, q: np.ndarray, k: int, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        met = self.boxes.meeting(q, r2, k)
        if met is None:
            half = len(q) // 2
            a, b = self._search(q[:half], k, r2[:half]), self._search(q[half:], k, r2[half:])
            return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])
        target, bucket, near, r2 = met
        order = np.lexsort((near, target))
        target, bucket, near = target[order], bucket[order], near[order]
        if self.members.shape[1] >= k and len(target):
            first = np.flatnonzero(np.diff(target, prepend=-1))  # the nearest bucket gives a bound for the others
            d2 = self._distances(q[target[first]], bucket[first])
            r2[target[first]] = np.minimum(r2[target[first]], np.partition(d2, k - 1, axis=1)[:, k - 1])
            keep = near <= r2[target]
            target, bucket = target[keep], bucket[keep]
        d2 = self._distances(q[target], bucket)
        row, column = np.nonzero(d2 <= r2[target][:, None])
        row, point, d2 = target[row], self.members[bucket[row], column], d2[row, column]
        real = point >= 0
        row, point, d2 = row[real], point[real], d2[real]
        order = np.lexsort((self.rank[point], d2, row))
        row, point, d2 = row[order], point[order], d2[order]
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        return row[place < k], point[place < k], d2[place < k]
