"""Suffix trees of number sequences, and longest common extensions in constant time."""

from __future__ import annotations

import numpy as np

#: Euler-tour entries of a block. Minima over whole blocks come from a sparse table over the blocks.
_BLOCK = 16


class SuffixTree:
    """Ukkonen's tree of `symbols`, numbers from 1 on; an end mark 0 is added.

    Node 0 is the root. `leaf[i]` is the leaf of the suffix that starts at i, `depth` the length of the text
    from the root to a node. Edges are kept in one dictionary, by node and first symbol.
    """

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        n = len(text)
        width = max(text) + 1
        edges: dict[int, int] = {}
        start, end, link, depth, leaf = [0], [0], [0], [0], []
        node = at = length = 0
        pending = 0
        for i, symbol in enumerate(text):
            inner = 0  # an inner node of this phase that still needs its suffix link
            pending += 1
            while pending:
                if not length:
                    at = i
                key = node * width + text[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    leaf.append(len(start))
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    depth.append(n - i + pending - 1)
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    first = start[child]
                    reach = min(end[child], i + 1) - first
                    if length >= reach:
                        node, at, length = child, at + reach, length - reach
                        continue
                    if text[first + length] == symbol:
                        length += 1
                        if inner:
                            link[inner] = node
                        break
                    split = len(start)
                    edges[key] = split
                    edges[split * width + text[first + length]] = child
                    edges[split * width + symbol] = split + 1
                    leaf.append(split + 1)
                    start += (first, i)
                    end += (first + length, n)
                    link += (0, 0)
                    depth += (depth[node] + length, n - i + pending - 1)
                    start[child] = first + length
                    if inner:
                        link[inner] = split
                    inner = split
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - pending + 1
        self.size = n - 1
        self.depth = np.array(depth, np.int32)
        self.leaf = np.array(leaf, np.int32)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        below = np.fromiter(edges.values(), np.int32, len(edges))
        order = np.argsort(keys)
        self._children = below[order].tolist()
        self._first_symbol = (keys[order] % width).tolist()
        self._from = np.searchsorted(keys[order] // width, np.arange(len(start) + 1)).tolist()

    def ranks(self, descending: bool = False) -> list[int]:
        """The place of every suffix in the order of the alphabet, or in that of the alphabet turned round.
        The end mark comes first in both."""
        children, first_symbol, begin = self._children, self._first_symbol, self._from
        rank_of_node = [0] * len(self.depth)
        stack, n = [0], 0
        while stack:
            node = stack.pop()
            low, high = begin[node], begin[node + 1]
            if low == high:
                rank_of_node[node] = n
                n += 1
            elif not descending:
                stack += children[low:high][::-1]
            elif first_symbol[low]:
                stack += children[low:high]
            else:
                stack += children[low + 1 : high]
                stack.append(children[low])
        return [rank_of_node[x] for x in self.leaf.tolist()]

    def euler_tour(self) -> tuple[np.ndarray, np.ndarray]:
        """The nodes in the order of a walk that comes back to a node after each of its children, and the
        place of every suffix's leaf in it."""
        children, begin = self._children, self._from
        tour: list[int] = []
        stack = [0]
        while stack:
            node = stack.pop()
            if node < 0:
                tour.append(~node)
                continue
            tour.append(node)
            low, high = begin[node], begin[node + 1]
            if low < high:
                back = ~node
                for child in children[high - 1 : low : -1]:
                    stack.append(child)
                    stack.append(back)
                stack.append(children[low])
        nodes = np.array(tour, np.int32)
        place = np.empty(len(self.depth), np.int64)
        place[nodes] = np.arange(len(nodes))
        return nodes, place[self.leaf]


class Extensions:
    """How far two suffixes agree: the depth of the lowest common ancestor of their leaves, which is the
    least depth between them in the Euler tour."""

    def __init__(self, tree: SuffixTree):
        nodes, self._place = tree.euler_tour()
        self._size = tree.size
        rows = -(-len(nodes) // _BLOCK)
        depth = np.full(rows * _BLOCK, np.iinfo(np.int32).max, np.int32)
        depth[: len(nodes)] = tree.depth[nodes]
        blocks = depth.reshape(rows, _BLOCK)
        self._depth = depth
        self._from_left = np.minimum.accumulate(blocks, axis=1).ravel()
        self._from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        table = [blocks.min(axis=1)]
        while 2 << (len(table) - 1) <= rows:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self._table = table

    def lengths(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the longest common prefix of the suffixes from i and from j, for arrays of different places;
        a place at the end or beyond has the empty suffix."""
        out = np.zeros(len(i), np.int64)
        asked = np.flatnonzero((i < self._size) & (j < self._size))
        a, b = self._place[i[asked]], self._place[j[asked]]
        out[asked] = self._least(np.minimum(a, b), np.maximum(a, b))
        return out

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        first, last = low // _BLOCK, high // _BLOCK
        out = np.minimum(self._from_right[low], self._from_left[high])
        same = np.flatnonzero(first == last)
        if len(same):
            near = self._depth[low[same]]
            for k in range(1, _BLOCK):
                at = low[same] + k
                inside = at <= high[same]
                near[inside] = np.minimum(near[inside], self._depth[at[inside]])
            out[same] = near
        far = np.flatnonzero(last - first > 1)
        if len(far):
            begin, count = first[far] + 1, last[far] - first[far] - 1
            level = np.frexp(count)[1] - 1
            between = np.empty(len(far), np.int32)
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                row = self._table[k]
                between[at] = np.minimum(row[begin[at]], row[begin[at] + count[at] - (1 << k)])
            out[far] = np.minimum(out[far], between)
        return out
