"""Small weighted finite-state transducers over symbols: rules, composition, and the tables they are run by.

A transducer is deterministic: at each state a symbol leads to one state, writes one symbol and adds a weight.
Symbols without an arc stay as they are, at the same state, with weight 0.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Transducer:
    """Arcs ``(state, read) -> (state, written, weight)``; the start is state 0."""

    arcs: dict[tuple[int, str], tuple[int, str, float]] = field(default_factory=dict)

    def arc(self, state: int, read: str, to: int, written: str | None = None, weight: float = 0.0) -> "Transducer":
        self.arcs[state, read] = (to, read if written is None else written, weight)
        return self

    def step(self, state: int, read: str) -> tuple[int, str, float]:
        return self.arcs.get((state, read), (state, read, 0.0))

    def run(self, word: Iterable[str]) -> tuple[list[str], float]:
        """What is written for ``word``, and the weight of its path."""
        state, out, total = 0, [], 0.0
        for read in word:
            state, written, weight = self.step(state, read)
            out.append(written)
            total += weight
        return out, total


def compose(first: Transducer, second: Transducer, alphabet: Iterable[str]) -> Transducer:
    """One transducer that does what ``second`` does to the output of ``first``, on the states that can be reached."""
    alphabet = list(alphabet)
    out, number, todo = Transducer(), {(0, 0): 0}, [(0, 0)]
    while todo:
        a, b = pair = todo.pop()
        for read in alphabet:
            to_a, middle, w_a = first.step(a, read)
            to_b, written, w_b = second.step(b, middle)
            if (to_a, to_b) not in number:
                number[to_a, to_b] = len(number)
                todo.append((to_a, to_b))
            out.arc(number[pair], read, number[to_a, to_b], written, w_a + w_b)
    return out


def window(opening: Iterable[str], closing: Iterable[str], marked: dict[str, str], reach: int, passing: Iterable[str], weight: float = 0.0) -> Transducer:
    """Marks the symbols of ``marked`` that stand within ``reach`` symbols after one of ``opening``, in the same clause."""
    t = Transducer()
    for state in range(reach + 1):
        for s in passing:
            t.arc(state, s, max(0, state - 1))
        for s, changed in marked.items():
            t.arc(state, s, max(0, state - 1), changed if state else s, weight if state else 0.0)
        for s in opening:
            t.arc(state, s, reach)
        for s in closing:
            t.arc(state, s, 0)
    return t


def tables(t: Transducer, alphabet: list[str], outputs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state, output and weight of every state and symbol, by their numbers."""
    states = 1 + max([s for s, _ in t.arcs] + [to for to, _, _ in t.arcs.values()], default=0)
    go, out, weight = np.zeros((states, len(alphabet)), np.int16), np.zeros((states, len(alphabet)), np.int16), np.zeros((states, len(alphabet)))
    for s in range(states):
        for i, read in enumerate(alphabet):
            to, written, w = t.step(s, read)
            go[s, i], out[s, i], weight[s, i] = to, outputs.index(written), w
    return go, out, weight
