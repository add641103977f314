"""Cheapest paths through steps between a few states, ties to the ASCII-least labels.

A path's labels are a linked list that shares its prefix with other paths: a node holds its
last label, the rolling hash of all labels up to it, and its ancestors 1, 2, 4, ... steps back.
Two paths of equal cost are compared by lifting both over ever shorter jumps to where they
first differ. Equal hashes are only believed once the labels have been compared too; that
happens only when hashes of different nodes are equal.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

#: A Mersenne prime, and the base of the rolling hash.
MODULUS, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687


class Step(NamedTuple):
    """One way from state ``old`` to state ``new``. Labels of one step compare as Python orders
    them, and different ones decide a comparison, whatever follows."""

    old: int
    new: int
    cost: int
    label: int


class Trails:
    """All paths found so far; node 0 is the empty one. Only nodes of equal depth are compared."""

    def __init__(self, modulus: int = MODULUS) -> None:
        self.modulus = modulus
        self.label, self.state, self.hash, self.lifts = [0], [0], [0], [()]

    def add(self, parent: int, label: int, state: int) -> int:
        node, lifts, above, k = len(self.label), [parent], parent, 0
        while len(self.lifts[above]) > k:
            above = self.lifts[above][k]
            lifts.append(above)
            k += 1
        self.label.append(label)
        self.state.append(state)
        self.hash.append((self.hash[parent] * BASE + label + 1) % self.modulus)
        self.lifts.append(lifts)
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of equal depth have equal labels."""
        if a == b:
            return True
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.label[a] != self.label[b]:
                return False
            a, b = self.lifts[a][0], self.lifts[b][0]
        return True

    def less(self, a: int, label_a, b: int, label_b) -> bool:
        """Whether ``a``'s labels and then ``label_a`` come before those of ``b`` and ``label_b``."""
        if self.same(a, b):
            return label_a < label_b
        for k in reversed(range(len(self.lifts[a]))):
            if k < len(self.lifts[a]):
                up_a, up_b = self.lifts[a][k], self.lifts[b][k]
                if not self.same(up_a, up_b):
                    a, b = up_a, up_b
        return self.label[a] < self.label[b]

    def back(self, node: int) -> tuple[list[int], list[int]]:
        """The labels on the way to a node, and the states after each."""
        labels, states = [], []
        while node:
            labels.append(self.label[node])
            states.append(self.state[node])
            node = self.lifts[node][0]
        return labels[::-1], states[::-1]


def cheapest(trails: Trails, steps: Iterable[Sequence[Step]], entry: int) -> dict[int, tuple[int, int]]:
    """For each state reached from ``entry``: the cost of the best path there, and its node.

    Of two paths to one state with equal cost, no continuation favours the greater one, so one
    per state is enough.
    """
    at = {entry: (0, 0)}
    for ways in steps:
        best: dict[int, tuple[int, int, int]] = {}
        for old, new, cost, label in ways:
            if old not in at:
                continue
            so_far, node = at[old]
            cost += so_far
            held = best.get(new)
            if held is None or cost < held[0] or (cost == held[0] and trails.less(node, label, held[1], held[2])):
                best[new] = (cost, node, label)
        at = {state: (cost, trails.add(node, label, state)) for state, (cost, node, label) in best.items()}
    return at
