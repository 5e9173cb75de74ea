"""A minimal acyclic transducer from words to id sequences, laid out for memory mapping.

Words are byte strings. States with equal futures are shared, so common suffixes are stored once.
Each edge carries an additive output; the sum along a word's path is the word's rank in sorted
order, and the rank points at the word's ids.
"""

from __future__ import annotations

import mmap
import struct
from array import array
from collections.abc import Iterable

MAGIC = b"LEX1"
HEADER = struct.Struct("<4s4I")  # magic, states, edges, words, ids


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The automaton of distinct words with their ids, as bytes. The empty word isn't allowed."""
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    counts: list[int] = []

    def freeze(final: bool, edges: list[tuple[int, int]]) -> int:
        """The one state that has this finality and these edges."""
        key = (final, tuple(edges))
        at = register.get(key)
        if at is None:
            at = register[key] = len(states)
            states.append(key)
            counts.append(final + sum(counts[to] for _, to in edges))
        return at

    # The last word, and for each of its prefixes whether a word ends there and the edges closed.
    path, finals, closed = bytearray(), [False], [[]]

    def shorten(depth: int) -> None:
        while len(path) > depth:
            label = path.pop()
            state = freeze(finals.pop(), closed.pop())
            closed[-1].append((label, state))

    for word, _ in entries:
        common, limit = 0, min(len(word), len(path))
        while common < limit and word[common] == path[common]:
            common += 1
        shorten(common)
        for label in word[common:]:
            path.append(label)
            finals.append(False)
            closed.append([])
        finals[-1] = True
    shorten(0)
    root = freeze(finals[0], closed[0])

    first, final, labels = array("I", [0]), bytearray(), bytearray()
    targets, adds = array("I"), array("I")
    for ends, edges in states:
        before = int(ends)
        for label, to in edges:
            labels.append(label)
            targets.append(to)
            adds.append(before)
            before += counts[to]
        first.append(len(labels))
        final.append(ends)
    assert root == len(states) - 1
    offsets, ids = array("I", [0]), array("I")
    for _, sequence in entries:
        ids.extend(sequence)
        offsets.append(len(ids))
    head = HEADER.pack(MAGIC, len(states), len(labels), len(entries), len(ids))
    numbers = b"".join(x.tobytes() for x in (first, targets, adds, offsets, ids))
    return head + numbers + bytes(final) + bytes(labels)


class Lexicon:
    """Look-up in a compiled lexicon, from memory or from a mapped file."""

    def __init__(self, data: bytes | mmap.mmap):
        magic, states, edges, words, ids = HEADER.unpack(data[: HEADER.size])
        if magic != MAGIC:
            raise ValueError("not a lexicon")
        self.data, self.words, self.root = data, words, states - 1
        at = HEADER.size
        view, numbers = memoryview(data), []
        for n in (states + 1, edges, edges, words + 1, ids):
            numbers.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.targets, self.adds, self.offsets, self.ids = numbers
        self.final, self.labels_at = view[at : at + states], at + states

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> list[int] | None:
        """The word's ids, or None if the lexicon doesn't hold it."""
        state, rank, find, base = self.root, 0, self.data.find, self.labels_at
        first, targets, adds = self.first, self.targets, self.adds
        for k in range(len(word)):
            edge = find(word[k : k + 1], base + first[state], base + first[state + 1])
            if edge < 0:
                return None
            edge -= base
            rank += adds[edge]
            state = targets[edge]
        if not self.final[state]:
            return None
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist()
