"""Prefix-tree join of n-gram sets, inside one task."""

from __future__ import annotations

import numpy as np


class _Node:
    __slots__ = ("tokens", "kids", "ends", "low", "high", "rest", "rep", "mixed")

    def __init__(self, tokens: np.ndarray, low: int, high: int, rest: int, rep: int):
        self.tokens, self.kids, self.ends = tokens, {}, []
        self.low, self.high, self.rest, self.rep, self.mixed = low, high, rest, rep, False


class TrieJoin:
    """Links between sets with 100 * common >= percent * union.

    Sets come as arrays of token numbers in one global order. They are stored in a tree whose paths share common
    beginnings; a search carries the overlap of its path, so that sets below a node share the work done above it. A
    subtree goes unvisited if the overlap so far plus the shorter of what remains cannot reach the least overlap that
    its sizes ask for, or if all its sets are in the component of the searching set already.
    """

    def __init__(self, tokens: int, percent: int = 75):
        self.percent, self.mark = percent, np.zeros(tokens, bool)
        self.parent: list[int] = []
        self.sizes: list[int] = []
        self.root = _Node(np.zeros(0, np.int64), 1 << 60, 0, 0, -1)
        self.visited = 0

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def register(self, size: int) -> int:
        self.parent.append(len(self.parent))
        self.sizes.append(size)
        return len(self.parent) - 1

    def _uniform(self, node: _Node) -> bool:
        if not node.mixed:
            return True
        roots = {self.find(s) for s in node.ends}
        for kid in node.kids.values():
            if kid.mixed or len(roots) > 1:
                return False
            roots.add(self.find(kid.rep))
        node.mixed = len(roots) > 1
        return not node.mixed

    def search(self, i: int, tokens: np.ndarray) -> list[tuple[int, int]]:
        """New links of set i to stored sets that were not yet in its component."""
        size, percent, found = self.sizes[i], self.percent, []
        self.mark[tokens] = True
        stack = [(self.root, 0)]
        while stack:
            node, common = stack.pop()
            self.visited += 1
            if self._uniform(node) and node.rep >= 0 and self.find(node.rep) == self.find(i):
                continue
            if 100 * node.high < percent * size or 100 * size < percent * node.low:
                continue
            left = len(tokens)
            if len(node.tokens):
                common += int(np.count_nonzero(self.mark[node.tokens]))
                left -= int(np.searchsorted(tokens, node.tokens[-1], side="right"))
            if (100 + percent) * (common + min(left, node.rest)) < percent * (size + node.low):
                continue
            for s in node.ends:
                if (100 + percent) * common >= percent * (size + self.sizes[s]) and self.find(s) != self.find(i):
                    found.append((i, s))
                    self.parent[max(self.find(s), self.find(i))] = min(self.find(s), self.find(i))
            at = len(tokens) - left
            likely = node.kids.get(int(tokens[at])) if at < len(tokens) else None
            stack.extend((kid, common) for kid in node.kids.values() if kid is not likely)
            if likely is not None:
                stack.append((likely, common))
        self.mark[tokens] = False
        return found

    def insert(self, i: int, tokens: np.ndarray) -> None:
        size, node, rest = self.sizes[i], self.root, tokens
        while True:
            if node.rep >= 0 and not node.mixed and self.find(node.rep) != self.find(i):
                node.mixed = True
            node.rep = i if node.rep < 0 else node.rep
            node.low, node.high, node.rest = min(node.low, size), max(node.high, size), max(node.rest, len(rest))
            if not len(rest):
                node.ends.append(i)
                return
            kid = node.kids.get(int(rest[0]))
            if kid is None:
                node.kids[int(rest[0])] = leaf = _Node(rest, size, size, 0, i)
                leaf.ends.append(i)
                return
            n = min(len(rest), len(kid.tokens))
            differ = np.flatnonzero(rest[:n] != kid.tokens[:n])
            same = int(differ[0]) if len(differ) else n
            if same < len(kid.tokens):  # split the edge
                top = _Node(kid.tokens[:same], kid.low, kid.high, kid.rest + len(kid.tokens) - same, kid.rep)
                top.mixed = kid.mixed
                kid.tokens = kid.tokens[same:]
                top.kids[int(kid.tokens[0])] = kid
                node.kids[int(rest[0])] = top
                kid = top
            node, rest = kid, rest[same:]


def links_within(sets: list[tuple[int, int, np.ndarray, np.ndarray]], side: list[int] | None = None, percent: int = 75) -> list[tuple[int, int]]:
    """Links that join the given sets as far as they are similar: (id, id), at most one fewer than there are sets.

    sets: (id, whole size, tokens, their frequencies). Tokens that no other set has may be left out; the size counts
    them. side: with 0 and 1, only pairs across are compared. Frequent tokens stand first, so that paths are shared.
    """
    if len(sets) < 2:
        return []
    tokens = np.concatenate([s[2] for s in sets])
    uses = np.concatenate([s[3] for s in sets]).astype(np.int64)
    names, first, inverse = np.unique(tokens, return_index=True, return_inverse=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, -uses[first]))] = np.arange(len(names))
    ranked = np.split(rank[inverse], np.cumsum([len(s[2]) for s in sets])[:-1])
    ranked = [np.sort(r) for r in ranked]
    join, out = TrieJoin(len(names), percent), []
    order = sorted(range(len(sets)), key=lambda i: (side[i] if side else 0, sets[i][1], sets[i][0]))
    for _ in sets:
        join.register(0)
    for i in order:
        join.sizes[i] = sets[i][1]
    for i in order:
        if not side or side[i] == 1:
            out += [(sets[a][0], sets[b][0]) for a, b in join.search(i, ranked[i])]
        if not side or side[i] == 0:
            join.insert(i, ranked[i])
    return out
