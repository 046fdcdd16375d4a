"""Weighted finite-state transducers over short tapes of symbols.

A machine is a table of arcs: (state, symbol) -> (output, weight, next state), several where it has to guess. Weights add
up along a path and the best path counts. ``Cascade`` composes machines, each reading what the one before writes; pairs of
states are made when a tape first reaches them.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable

#: (output symbol, weight, next state)
Arc = tuple[str, float, Hashable]


class Machine:
    """All arcs from the states that ``rule`` reaches from ``start``; ``final`` tells where a tape may end."""

    def __init__(self, start: Hashable, symbols: str, rule: Callable[[Hashable, str], Iterable[Arc]], final: Callable[[Hashable], bool] = lambda s: True):
        self.start, self.arcs, self.ends = start, {}, set()
        todo = [start]
        seen = {start}
        while todo:
            state = todo.pop()
            if final(state):
                self.ends.add(state)
            for x in symbols:
                arcs = self.arcs[state, x] = tuple(rule(state, x))
                for _, _, to in arcs:
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
        self.states = seen


class Cascade:
    """The composition of machines over one alphabet."""

    def __init__(self, machines: list[Machine]):
        self.machines = machines
        self.start = tuple(m.start for m in machines)
        self.arcs: dict[tuple, tuple[Arc, ...]] = {}

    def step(self, states: tuple, symbol: str) -> tuple[Arc, ...]:
        known = self.arcs.get((states, symbol))
        if known is None:
            paths = [(symbol, 0.0, ())]
            for m, s in zip(self.machines, states):
                paths = [(y, w + v, (*to, n)) for x, w, to in paths for y, v, n in m.arcs[s, x]]
            known = self.arcs[states, symbol] = tuple(paths)
        return known

    def best(self, tape: list[tuple[str, float]], counts: str) -> float | None:
        """Weight of the best path over a tape of (symbol, weight): the weight of a symbol counts where it comes out as one
        of ``counts``. None if no path ends in a final state."""
        paths = {self.start: 0.0}
        for symbol, own in tape:
            new: dict[tuple, float] = {}
            for states, total in paths.items():
                for out, weight, to in self.step(states, symbol):
                    x = total + weight + (own if out in counts else 0.0)
                    if x > new.get(to, float("-inf")):
                        new[to] = x
            paths = new
        ends = [m.ends for m in self.machines]
        return max((x for states, x in paths.items() if all(s in e for s, e in zip(states, ends))), default=None)


class Lexicon:
    """A transducer from the letters of a word to (symbol, weight): a prefix tree whose states carry exact words and stems;
    after a stem any letters follow. The first stem on the way counts, a whole word before it."""

    def __init__(self, words: dict[str, tuple[str, float]], stems: dict[str, tuple[str, float]]):
        self.arcs: list[dict[str, int]] = [{}]
        self.word: dict[int, tuple[str, float]] = {}
        self.stem: dict[int, tuple[str, float]] = {}
        for ends, entries in ((self.word, words), (self.stem, stems)):
            for text, out in entries.items():
                at = 0
                for c in text:
                    if c not in self.arcs[at]:
                        self.arcs[at][c] = len(self.arcs)
                        self.arcs.append({})
                    at = self.arcs[at][c]
                ends[at] = out

    def read(self, word: str) -> tuple[str, float] | None:
        at, found = 0, None
        for c in word:
            at = self.arcs[at].get(c)
            if at is None:
                return found
            found = found or self.stem.get(at)
        return self.word.get(at) or found
