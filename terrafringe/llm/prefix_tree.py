"""A prefix tree over globally ordered sets, and the Jaccard links found by walking it."""

from __future__ import annotations

import numpy as np


class Forest:
    """Union-find over 0 .. n-1, smallest member as root."""

    def __init__(self, start: np.ndarray):
        first: dict[int, int] = {}
        self.up = [first.setdefault(c, i) for i, c in enumerate(start.tolist())]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = sorted((self.root(i), self.root(j)))
        self.up[j] = i
        return i != j


class PrefixTree:
    """Path-compressed tree of sorted integer sets.

    A node stands for the elements from the depth of its parent to its own
    depth, which all sets below it share; sets are kept in lexicographic
    order, so that a node's sets are a range of that order.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets = [sets[i] for i in self.order]
        n = len(sets)
        shared = [0] * n  # elements shared with the set before
        for k in range(1, n):
            a, b = self.sets[k - 1], self.sets[k]
            m = min(len(a), len(b))
            off = np.flatnonzero(a[:m] != b[:m])
            shared[k] = int(off[0]) if len(off) else m
        #: (from depth, to depth, first set, last set, smallest size, largest size, children)
        sizes = [len(s) for s in self.sets]

        def node(a: int, b: int, depth: int):
            deep = min((shared[k] for k in range(a + 1, b)), default=sizes[a])
            children = []
            if b - a > 1:
                cuts = [a, *(k for k in range(a + 1, b) if shared[k] == deep), b]
                children = [(x, y) for x, y in zip(cuts, cuts[1:], strict=False)]
            return [depth, deep, a, b, min(sizes[a:b]), max(sizes[a:b]), children]

        self.nodes: list[list] = []
        todo = [(0, n, 0, None)] if n else []
        while todo:
            a, b, depth, parent = todo.pop()
            made = node(a, b, depth)
            at = len(self.nodes)
            self.nodes.append(made)
            if parent is not None:
                self.nodes[parent][6].append(at)
            children, made[6] = made[6], []
            todo += [(x, y, made[1], at) for x, y in children]

    def link(self, forest: Forest, percent: int) -> list[tuple[int, int]]:
        """Pairs of set numbers with a Jaccard similarity of `percent` or more that connect parts of `forest` still apart.

        Each set walks the tree: an overlap counted for a node holds for all
        sets below it. A subtree is left where the overlap and the elements
        that remain on both sides can't reach the limit, or where all its sets
        are connected to the walking one already.
        """
        found = []
        top = max((int(s[-1]) for s in self.sets if len(s)), default=-1)
        mark = np.zeros(top + 2, np.int8)
        whole = 100 + percent
        for k, own in enumerate(self.sets):
            if not len(own):
                continue
            mark[own] = 1
            mine, size = self.order[k], len(own)
            todo = [(0, 0)]
            while todo:
                at, overlap = todo.pop()
                depth, deep, a, b, least, most, children = self.nodes[at]
                a = max(a, k + 1)
                if a >= b or whole * min(overlap + most - depth, size) < percent * (size + max(least, 1)):
                    continue
                root = forest.root(mine)
                if all(forest.root(self.order[j]) == root for j in range(a, b)):
                    continue
                part = self.sets[a][depth:deep]
                overlap += int(np.count_nonzero(mark[part]))
                # The walking set's elements beyond the last one of this node.
                rest = size - int(np.searchsorted(own, part[-1], "right")) if len(part) else size
                if whole * (overlap + min(most - deep, rest)) < percent * (size + max(least, 1)):
                    continue
                if not children:
                    if whole * overlap >= percent * (size + deep):
                        for j in range(a, b):
                            if forest.join(mine, self.order[j]):
                                found.append((mine, self.order[j]))
                    continue
                todo += [(c, overlap) for c in children]
            mark[own] = 0
        return found
