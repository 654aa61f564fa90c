"""Small deterministic weighted transducers over one-byte symbols, and their composition."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Transducer:
    """``step[state][symbol] = (next state, output symbol, weight)``; other symbols pass through.

    A symbol without an entry is copied, with weight 0, and goes to ``other[state]`` (the state
    itself where that is missing). The machine starts in state 0 at every clause.
    """

    step: tuple[dict[int, tuple[int, int, float]], ...]
    other: dict[int, int]

    def move(self, state: int, symbol: int) -> tuple[int, int, float]:
        found = self.step[state].get(symbol)
        return found if found is not None else (self.other.get(state, state), symbol, 0.0)

    def run(self, clause: bytes) -> tuple[bytes, float]:
        state, total, out = 0, 0.0, bytearray()
        for symbol in clause:
            state, written, weight = self.move(state, symbol)
            out.append(written)
            total += weight
        return bytes(out), total


def compose(first: Transducer, second: Transducer, alphabet: bytes) -> Transducer:
    """One machine that reads what ``first`` reads and writes what ``second`` makes of it."""
    names = {(0, 0): 0}
    todo, steps = [(0, 0)], []
    while todo:
        a, b = todo.pop(0)
        row = {}
        for symbol in alphabet:
            a2, middle, w1 = first.move(a, symbol)
            b2, written, w2 = second.move(b, middle)
            if (a2, b2) not in names:
                names[(a2, b2)] = len(names)
                todo.append((a2, b2))
            row[symbol] = (names[(a2, b2)], written, w1 + w2)
        steps.append(row)
    return Transducer(tuple(steps), {})


def after(trigger: bytes, span: int | None, rewrite: dict[int, int]) -> Transducer:
    """Rewrites symbols that follow a trigger within ``span`` symbols (to the clause's end: None)."""
    n = 1 if span is None else span
    steps: list[dict[int, tuple[int, int, float]]] = [{t: (1, t, 0.0) for t in trigger}]
    other = {}
    for left in range(n, 0, -1):  # state n - left + 1: `left` symbols may still be rewritten
        state = n - left + 1
        onward = state if span is None else (state + 1 if left > 1 else 0)
        row = {t: (1, t, 0.0) for t in trigger}
        row.update({s: (1 if s in trigger else onward, r, 0.0) for s, r in rewrite.items()})
        steps.append(row)
        other[state] = onward
    return Transducer(tuple(steps), other)


def weigh(weights: dict[int, float]) -> Transducer:
    """Adds a weight for every symbol that is read."""
    return Transducer(({s: (0, s, w) for s, w in weights.items()},), {})
