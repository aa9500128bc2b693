"""A keyed max-priority queue of doubles, for the exact propagation inside a task."""

from __future__ import annotations

import heapq


class PaintQueue:
    """Missing keys read as 0; the largest priority pops first, ties to the smaller key."""

    def __init__(self):
        self.of: dict[int, float] = {}
        self.heap: list[tuple[float, int]] = []

    def __len__(self) -> int:
        return len(self.of)

    def __getitem__(self, key: int) -> float:
        return self.of.get(key, 0.0)

    def __setitem__(self, key: int, priority: float) -> None:
        self.of[key] = priority
        heapq.heappush(self.heap, (-priority, key))

    def add(self, key: int, more: float) -> None:
        self[key] = self[key] + more

    def _settle(self) -> None:
        while self.heap and self.of.get(self.heap[0][1]) != -self.heap[0][0]:
            heapq.heappop(self.heap)

    def peek(self) -> tuple[int, float]:
        self._settle()
        if not self.heap:
            raise IndexError("the queue is empty")
        return self.heap[0][1], -self.heap[0][0]

    def pop(self) -> tuple[int, float]:
        key, priority = self.peek()
        heapq.heappop(self.heap)
        del self.of[key]
        return key, priority

    def items(self) -> list[tuple[int, float]]:
        """All keys, the largest priority first."""
        return sorted(self.of.items(), key=lambda x: (-x[1], x[0]))
