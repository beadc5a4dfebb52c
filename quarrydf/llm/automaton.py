"""A suffix-matching automaton over a vocabulary, resumable at any prefix."""

from __future__ import annotations

#: Over any character, so that a state and a character make one key.
WIDTH = 1 << 21


class Automaton:
    """All given texts that end at a position: one step a character, from any state reached before."""

    def __init__(self, tokens: list[tuple[str, tuple[int, int]]]):
        self.step: dict[int, int] = {}
        ends: dict[int, tuple[int, int]] = {}
        parents, states = [(0, 0)], 1
        for text, found in tokens:
            node = 0
            for c in text:
                key = node * WIDTH + ord(c)
                child = self.step.get(key)
                if child is None:
                    child = self.step[key] = states
                    parents.append((node, ord(c)))
                    states += 1
                node = child
            ends[node] = found
        depth = [0] * states
        for node in range(1, states):
            depth[node] = depth[parents[node][0]] + 1
        self.fail = [0] * states
        #: By state, the tokens that end there, longest first.
        self.hits: list[tuple[tuple[int, int], ...]] = [()] * states
        for node in sorted(range(1, states), key=depth.__getitem__):
            parent, c = parents[node]
            if parent:
                self.fail[node] = self.next(self.fail[parent], c)
            own, rest = ends.get(node), self.hits[self.fail[node]]
            self.hits[node] = (own, *rest) if own else rest

    def next(self, state: int, c: int) -> int:
        step = self.step
        while (found := step.get(state * WIDTH + c)) is None:
            if not state:
                return 0
            state = self.fail[state]
        return found
