"""Minimum cut of a small graph with two terminals, by blocking flows."""

from __future__ import annotations

from collections import deque


class Cut:
    """Nodes 0 .. n-1 between a source and a sink; capacities are integers."""

    def __init__(self, nodes: int):
        self.source, self.sink = nodes, nodes + 1
        self.out: list[list[int]] = [[] for _ in range(nodes + 2)]
        self.head: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, forth: int, back: int = 0) -> None:
        for start, end, room in ((a, b, forth), (b, a, back)):
            self.out[start].append(len(self.head))
            self.head.append(end)
            self.room.append(room)

    def terminals(self, node: int, from_source: int, to_sink: int) -> None:
        """Cost of taking ``node`` to the sink's side and to the source's side.

        What both sides would cost in any case is left out, which changes no cut.
        """
        both = min(from_source, to_sink)
        if from_source > both:
            self.edge(self.source, node, from_source - both)
        if to_sink > both:
            self.edge(node, self.sink, to_sink - both)

    def source_side(self) -> list[bool]:
        """For each node whether it is on the source's side of a minimum cut."""
        while True:
            level = self._levels()
            if level[self.sink] < 0:
                return [depth >= 0 for depth in level[:-2]]
            at = [0] * len(self.out)
            while self._push(level, at):
                pass

    def _levels(self) -> list[int]:
        level, queue = [-1] * len(self.out), deque([self.source])
        level[self.source] = 0
        while queue:
            node = queue.popleft()
            for e in self.out[node]:
                if self.room[e] > 0 and level[self.head[e]] < 0:
                    level[self.head[e]] = level[node] + 1
                    queue.append(self.head[e])
        return level

    def _push(self, level: list[int], at: list[int]) -> int:
        """One augmenting path along the levels, without recursion."""
        path: list[int] = []
        node = self.source
        while node != self.sink:
            edges = self.out[node]
            while at[node] < len(edges):
                e = edges[at[node]]
                if self.room[e] > 0 and level[self.head[e]] == level[node] + 1:
                    break
                at[node] += 1
            if at[node] < len(edges):
                path.append(edges[at[node]])
                node = self.head[path[-1]]
            elif path:
                back = path.pop()
                node = self.head[back ^ 1]
                at[node] += 1
            else:
                return 0
        flow = min(self.room[e] for e in path)
        for e in path:
            self.room[e] -= flow
            self.room[e ^ 1] += flow
        return flow
