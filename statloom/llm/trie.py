"""Links between sets by a prefix tree over their globally ordered elements."""

from __future__ import annotations

import numpy as np


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class _Node:
    """A path of elements; below it, sets of ``low`` to ``high`` elements. ``one``: a member if all are of one group."""

    __slots__ = ("path", "depth", "kids", "ends", "low", "high", "one")

    def __init__(self, path: np.ndarray, depth: int, size: int, one: int):
        self.path, self.depth, self.kids, self.ends, self.low, self.high, self.one = path, depth, {}, [], size, size, one


class Trie:
    """Sets as increasing integers, frequent elements first so that near copies share long paths.

    ``num``/``den``: sets link when den * intersection >= num * union.
    """

    def __init__(self, groups: Union, universe: int, num: int = 3, den: int = 4):
        self.root, self.groups, self.mark = _Node(np.zeros(0, np.int64), 0, 0, -1), groups, np.zeros(universe, bool)
        self.root.low, self.num, self.both = 1 << 60, num, num + den

    def add(self, who: int, own: np.ndarray) -> None:
        node, at, n, find = self.root, 0, len(own), self.groups.find
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if node is not self.root and (node.one < 0 or find(node.one) != find(who)):
                node.one = -1
            if at == n:
                node.ends.append(who)
                return
            kid = node.kids.get(int(own[at]))
            if kid is None:
                kid = node.kids[int(own[at])] = _Node(own[at:], n, n, who)
                kid.ends.append(who)
                return
            m = min(len(kid.path), n - at)
            differ = np.flatnonzero(kid.path[:m] != own[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(kid.path):  # split the path
                top = _Node(kid.path[:same], kid.depth - len(kid.path) + same, kid.low, kid.one)
                top.low, top.high = kid.low, kid.high
                kid.path = kid.path[same:]
                top.kids[int(kid.path[0])] = kid
                node.kids[int(own[at])] = kid = top
            at += same
            node = kid

    def _settled(self, node: _Node) -> int:
        """The group of all sets below ``node``, or -1; from what its children know."""
        find = self.groups.find
        if node.one >= 0:
            return find(node.one)
        roots = {find(e) for e in node.ends} | {find(k.one) if k.one >= 0 else -1 for k in node.kids.values()}
        if len(roots) == 1 and -1 not in roots:
            node.one = roots.pop()
            return node.one
        return -1

    def link(self, who: int, own: np.ndarray) -> list[int]:
        """Join ``who`` with every group that holds a set it links with; the sets by which it was joined."""
        n, mark, num, both, find, out = len(own), self.mark, self.num, self.both, self.groups.find, []
        mark[own] = True
        stack = [(k, 0) for k in self.root.kids.values()]
        while stack:
            node, shared = stack.pop()
            if self._settled(node) == find(who):
                continue
            shared += int(np.count_nonzero(mark[node.path]))
            left = n - int(np.searchsorted(own, node.path[-1], "right"))
            most = shared + min(left, node.high - node.depth)
            if both * most < num * (n + max(node.low, most)):
                continue
            if both * shared >= num * (n + node.depth):
                for e in node.ends:
                    if self.groups.join(who, e):
                        out.append(e)
            stack.extend((k, shared) for k in node.kids.values())
        mark[own] = False
        return out


def ordered(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets with elements numbered from the most frequent one on, each increasing; and how many elements there are."""
    if not sets:
        return [], 0
    every, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -count))] = np.arange(len(every))
    at = np.cumsum([0] + [len(s) for s in sets])
    return [np.sort(rank[inverse[a:b]]) for a, b in zip(at, at[1:])], len(every)


def spanning_links(sets: list[np.ndarray], known: list[int] | None = None, asked: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that connect what the sets' links connect. known: groups already found; asked: only pairs with such a set."""
    groups = Union(len(sets))
    first: dict[int, int] = {}
    for i, k in enumerate(known or []):
        groups.join(first.setdefault(k, i), i)
    own, universe = ordered(sets)
    trie, out = Trie(groups, universe), []
    order = range(len(sets)) if asked is None else sorted(range(len(sets)), key=lambda i: asked[i])
    for i in order:
        if len(own[i]):
            if asked is None or asked[i]:
                out += [(i, e) for e in trie.link(i, own[i])]
            trie.add(i, own[i])
    return out
