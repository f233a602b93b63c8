"""Largest flow from a source to a sink (Dinic's method) for small integer networks."""

from __future__ import annotations

from collections import deque


class Network:
    def __init__(self, nodes: int) -> None:
        self.edges: list[list[int]] = []  # [to, capacity left]; edge i ^ 1 is its reverse
        self.at: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int) -> int:
        self.at[a].append(len(self.edges))
        self.edges.append([b, capacity])
        self.at[b].append(len(self.edges))
        self.edges.append([a, 0])
        return len(self.edges) - 2

    def flow_of(self, edge: int) -> int:
        return self.edges[edge ^ 1][1]

    def push(self, s: int, t: int) -> int:
        """Raises the flow from s to t as far as it goes; returns by how much."""
        total = 0
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                x = queue.popleft()
                for e in self.at[x]:
                    to, left = self.edges[e]
                    if left and to not in level:
                        level[to] = level[x] + 1
                        queue.append(to)
            if t not in level:
                return total
            nexts = [0] * len(self.at)
            while got := self._path(s, t, level, nexts):
                total += got

    def _path(self, s: int, t: int, level: dict[int, int], nexts: list[int]) -> int:
        path: list[int] = []
        x = s
        while x != t:
            while nexts[x] < len(self.at[x]):
                e = self.at[x][nexts[x]]
                to, left = self.edges[e]
                if left and level.get(to, -1) == level[x] + 1:
                    path.append(e)
                    x = to
                    break
                nexts[x] += 1
            else:
                if not path:
                    return 0
                x = self.edges[path.pop() ^ 1][0]
                nexts[x] += 1
        got = min(self.edges[e][1] for e in path)
        for e in path:
            self.edges[e][1] -= got
            self.edges[e ^ 1][1] += got
        return got
