"""A ball tree over sparse vectors of whole numbers, searched for the largest inner products.

Rows are kept in compressed form (starts, columns, values). Every node has a center (the mean of its
rows), a radius that reaches all of them, and the columns its rows use at all. For a query q and a
row x of the node

    q.x = q.c + q.(x - c) <= q.c + |q on the node's columns| * radius

since x - c is zero elsewhere. Bounds are computed in doubles and widened by more than any rounding
can take away; the scores of rows are whole numbers. Nodes are opened from the largest bound on, and
the search ends when no bound reaches the last of the k best rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

LEAF_ROWS = 64
# far above the relative error of a double sum of a million terms, and of a squared distance
WIDEN = 1e-8


@dataclass
class Rows:
    """Sparse rows, none of them empty. `ids` are what the search returns."""

    ids: np.ndarray
    starts: np.ndarray  # one more than rows
    columns: np.ndarray
    values: np.ndarray  # int64

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, rows: np.ndarray) -> Rows:
        lengths = (self.starts[1:] - self.starts[:-1])[rows]
        starts = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(self.starts[rows] - starts[:-1], lengths) + np.arange(starts[-1])
        return Rows(self.ids[rows], starts, self.columns[at], self.values[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """The inner product of each row with a vector over all columns."""
        return np.add.reduceat(self.values * dense[self.columns], self.starts[:-1])


@dataclass
class Node:
    columns: np.ndarray  # those its rows use, ascending
    center: np.ndarray  # doubles, one per column
    radius: float
    rows: Rows | None = None  # leaves
    children: tuple[Node, Node] | None = None

    def bound(self, query: np.ndarray) -> float:
        """No row of this node has a larger inner product with the query (doubles, 0 or more)."""
        q = query[self.columns]
        return (q @ self.center + np.sqrt(q @ q) * self.radius) * (1 + WIDEN) + 1.0


class BallTree:
    def __init__(self, rows: Rows, width: int, leaf_rows: int = LEAF_ROWS):
        self.width, self.leaf_rows = width, leaf_rows
        self.root = self._build(rows) if len(rows) else None
        self.scored = 0  # rows whose score was computed, over all searches

    def _build(self, rows: Rows) -> Node:
        # a split halves its rows, so the recursion is as deep as the logarithm of their number
        total = np.bincount(rows.columns, weights=rows.values, minlength=self.width)
        columns = np.flatnonzero(total)
        dense = total / len(rows)
        center = dense[columns]
        values = rows.values.astype(float)
        squares = np.add.reduceat(values * values, rows.starts[:-1])
        own = center @ center
        apart = squares - 2 * rows.dot(dense) + own
        # differences of large squares: widen by their rounding, not by that of the result
        radius = np.sqrt(max(apart.max(), 0.0) + WIDEN * (squares.max() + own))
        node = Node(columns, center, radius * (1 + WIDEN))
        if len(rows) <= self.leaf_rows:
            node.rows = rows
            return node
        one = self._dense(rows, int(apart.argmax()))
        from_one = squares - 2 * rows.dot(one)  # squared distance, but for a constant
        two = self._dense(rows, int(from_one.argmax()))
        nearer = np.argsort(from_one - (squares - 2 * rows.dot(two)), kind="stable")
        half = len(rows) // 2
        node.children = (self._build(rows.take(nearer[:half])), self._build(rows.take(nearer[half:])))
        return node

    def _dense(self, rows: Rows, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        part = slice(rows.starts[row], rows.starts[row + 1])
        out[rows.columns[part]] = rows.values[part]
        return out

    def search(
        self, columns: np.ndarray, weights: np.ndarray, k: int, floor: int = 1
    ) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k rows of the largest inner products, largest first and equal ones
        by ascending id; rows below `floor` are left out. Weights are whole numbers, 0 or more."""
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        if self.root is None:
            return ids, scores
        exact = np.zeros(self.width, np.int64)
        exact[columns] = weights
        query = exact.astype(float)
        least = floor
        heap = [(-self.root.bound(query), 0, self.root)]
        pushed = 0
        while heap:
            bound, _, node = heapq.heappop(heap)
            if -bound < least:
                break
            if node.rows is None:
                for child in node.children:
                    upper = child.bound(query)
                    if upper >= least:
                        pushed += 1
                        heapq.heappush(heap, (-upper, pushed, child))
                continue
            got = node.rows.dot(exact)
            self.scored += len(got)
            good = got >= least  # equal scores too: a smaller id goes first
            if good.any():
                ids = np.concatenate((ids, node.rows.ids[good]))
                scores = np.concatenate((scores, got[good]))
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
                if len(ids) == k:
                    least = max(least, int(scores[-1]))
        return ids, scores
