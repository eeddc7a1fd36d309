"""Minimum-cost flow on a small network, by successive shortest paths."""

from __future__ import annotations

from collections import deque
from collections.abc import Hashable


class Network:
    def __init__(self):
        self.edges: list[list] = []  # [to, room, cost]; the edge back is the one with the last bit flipped
        self.out: dict[Hashable, list[int]] = {}

    def add(self, a: Hashable, b: Hashable, room: int, cost: int = 0) -> int:
        """Adds an edge; the number returned is good for :meth:`flow`."""
        number = len(self.edges)
        self.edges += [[b, room, cost], [a, 0, -cost]]
        self.out.setdefault(a, []).append(number)
        self.out.setdefault(b, []).append(number + 1)
        return number

    def flow(self, number: int) -> int:
        return self.edges[number ^ 1][1]

    def send(self, source: Hashable, sink: Hashable) -> int:
        """Sends as much as fits, always along the cheapest path left; returns the amount."""
        sent = 0
        while True:
            cost, came, queue, waiting = {source: 0}, {}, deque([source]), {source}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for number in self.out.get(a, ()):
                    b, room, price = self.edges[number]
                    if room and cost[a] + price < cost.get(b, float("inf")):
                        cost[b], came[b] = cost[a] + price, number
                        if b not in waiting:
                            waiting.add(b)
                            queue.append(b)
            if sink not in came:
                return sent
            path, node = [], sink
            while node != source:
                path.append(came[node])
                node = self.edges[came[node] ^ 1][0]
            amount = min(self.edges[n][1] for n in path)
            for n in path:
                self.edges[n][1] -= amount
                self.edges[n ^ 1][1] += amount
            sent += amount
