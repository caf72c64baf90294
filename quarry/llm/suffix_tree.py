"""Suffix trees of integer sequences and what they answer in constant time.

``build`` is Ukkonen's algorithm. ``Tree`` walks the finished tree once in symbol order (an
Euler tour, of which only the leaves and the shallowest node between two neighbouring
leaves are kept) and puts a sparse table over these depths: the longest common extension of two
suffixes is the string depth of their lowest common ancestor, two look-ups per query.
"""

from __future__ import annotations

import numpy as np

#: the end of a sequence, smaller than any symbol in every order
END = 0


def build(s: list[int], width: int):
    """Ukkonen's suffix tree of ``s``, whose last symbol is ``END`` and occurs once.

    Symbols are below ``width``. Returns edges as ``{node * width + first symbol: child}`` and
    per node the begin and end of its edge's label; node 0 is the root.
    """
    n = len(s)
    begin, end, link = [0], [0], [0]
    to: dict[int, int] = {}
    node = at = length = pending = 0
    for i, c in enumerate(s):
        pending += 1
        inner = 0  # the inner node made last, waiting for its suffix link
        while pending:
            if not length:
                at = i
            key = node * width + s[at]
            child = to.get(key)
            if child is None:
                to[key] = len(begin)
                begin.append(i)
                end.append(n)
                link.append(0)
                if inner:
                    link[inner] = node
                    inner = 0
            else:
                first = begin[child]
                span = end[child] - first
                if length >= span:  # walk down
                    node = child
                    at += span
                    length -= span
                    continue
                if s[first + length] == c:
                    length += 1
                    if inner:
                        link[inner] = node
                    break
                middle = len(begin)
                begin += (first, i)
                end += (first + length, n)
                link += (0, 0)
                to[key] = middle
                begin[child] = first + length
                to[middle * width + s[first + length]] = child
                to[middle * width + c] = middle + 1
                if inner:
                    link[inner] = middle
                inner = middle
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - pending + 1
    return to, begin, end


class Tree:
    """The suffix tree of ``symbols`` (each above ``END``) with constant-time extensions."""

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        self.s = [*symbols, END]
        self.width = max(self.s) + 1
        to, begin, end = build(self.s, self.width)
        self.size = len(begin)
        keys = np.fromiter(to, np.int64, len(to))
        self._child = np.fromiter(to.values(), np.int64, len(to))
        self._parent, self._symbol = keys // self.width, keys % self.width
        self._label = (np.array(end) - np.array(begin)).tolist()
        order, gap = self._tour(False)
        self.rank = np.empty(self.n + 1, np.int64)
        self.rank[order] = np.arange(self.n + 1)
        self._table = [np.array(gap, np.int32)]
        k = 1
        while 2 * k <= len(gap):
            t = self._table[-1]
            self._table.append(np.minimum(t[:-k], t[k:]))
            k *= 2

    def _tour(self, backwards: bool) -> tuple[list[int], list[int]]:
        """Suffixes in order of their leaves, and the depth of the lowest common ancestor of each
        two neighbours; ``backwards``: larger symbols first (``END`` stays first)."""
        sort = np.where(self._symbol == END, 0, self.width - self._symbol) if backwards else self._symbol
        place = np.lexsort((-sort, self._parent))  # last child first, as a stack gives them back
        child = self._child[place].tolist()
        bound = np.searchsorted(self._parent[place], np.arange(self.size + 1)).tolist()
        label, n = self._label, len(self.s)
        depth, above = [0] * self.size, [0] * self.size
        order, gap, stack, came = [], [], [0], False
        while stack:
            v = stack.pop()
            if came:  # the first node after a leaf hangs on the lowest common ancestor
                gap.append(above[v])
                came = False
            a, z = bound[v], bound[v + 1]
            d = depth[v]
            if a == z:
                order.append(n - d)
                came = True
            else:
                kids = child[a:z]
                for k in kids:
                    above[k] = d
                    depth[k] = d + label[k]
                stack += kids
        return order, gap

    def backward_rank(self) -> np.ndarray:
        """Ranks of the suffixes when larger symbols come first."""
        order, _ = self._tour(True)
        rank = np.empty(self.n + 1, np.int64)
        rank[order] = np.arange(self.n + 1)
        return rank

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension of the suffixes at ``i`` and ``j`` (unequal, up to ``n``)."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.zeros(len(lo), np.int64)
        for k, t in enumerate(self._table):
            at = np.nonzero(level == k)[0]
            if len(at):
                out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << k)])
        return out
