"""Sorted runs of sequences that carry common prefix lengths, and the trie that their merge walks.

A sequence is a list of integers. A run knows how much each of its sequences
shares with the one before; a tree of losers merges runs and compares two heads
only from where both part from the last output, so what is shared is looked at
once. The merged order visits a trie depth first: the nodes of the present
sequence are a stack, and a node is finished when a sequence leaves it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any, NamedTuple


class Entry(NamedTuple):
    """A distinct sequence and what comes with it."""

    sequence: list[int]
    #: Code points of each turn, the first item's being 0.
    chars: list[int]
    #: Conversations with it, and the least of them.
    n: int
    least: int
    #: What is known of nodes below its last: children, leaves, saved.
    below: tuple[int, int, int]
    #: The key of the conversations that end with it, if any does.
    ends: tuple[int, int] | None


def packed(x: int, y: int) -> int:
    """One integer in the order of (x, y), two signed 64-bit integers."""
    return (x << 64) + y + (1 << 63)


def unpacked(token: int) -> tuple[int, int]:
    return token >> 64, (token & ((1 << 64) - 1)) - (1 << 63)


class Run(NamedTuple):
    entries: list[Entry]
    #: Length of the common prefix with the entry before.
    shared: list[int]


def common(a: list[int], b: list[int], start: int = 0) -> int:
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


def sorted_run(entries: list[Entry]) -> Run:
    entries = sorted(entries, key=lambda e: e.sequence)
    pairs = zip(entries, entries[1:])
    return Run(entries, [0, *(common(a.sequence, b.sequence) for a, b in pairs)])


class LoserTree:
    """Merges runs; iterates over (entry, length of the prefix shared with the last output)."""

    def __init__(self, runs: list[Run]) -> None:
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.at = [0] * self.size
        self.heads: list[list[int] | None] = [r.entries[0].sequence if r.entries else None for r in runs]
        self.heads += [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.compared = 0
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The run with the lesser head; the other stays at ``node``, with what it shares with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            wins = y is None
        elif self.shared[a] != self.shared[b]:
            wins = self.shared[a] > self.shared[b]
        else:
            start = self.shared[a]
            to = common(x, y, start)
            self.compared += to - start + 1
            wins = to == len(x) or to < len(y) and x[to] < y[to]
            self.shared[b if wins else a] = to
        self.losers[node] = b if wins else a
        return a if wins else b

    def __iter__(self) -> Iterator[tuple[Entry, int]]:
        while self.heads[self.winner] is not None:
            w = self.winner
            run, at = self.runs[w], self.at[w]
            yield run.entries[at], self.shared[w]
            self.at[w] = at = at + 1
            more = at < len(run.entries)
            self.heads[w] = run.entries[at].sequence if more else None
            self.shared[w] = run.shared[at] if more else 0
            node = (w + self.size) // 2
            while node:
                w = self._play(node, w, self.losers[node])
                node //= 2
            self.winner = w


class _Node:
    __slots__ = ("chars", "children", "ends", "least", "leaves", "n", "open", "rows", "saved", "token")

    def __init__(self, token: int, chars: int, is_open: bool) -> None:
        self.token, self.chars, self.open = token, chars, is_open
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: tuple[int, int] | None = None
        self.rows: list[dict[str, Any]] = []


#: A finished node has no ``key``; its ``parent_conv`` is known, or it has the ``parent_key`` of an open node.
FIELDS = {"depth": "int", "n": "long", "least": "long", "children": "long", "leaves": "long", "saved": "long", "chars": "long", "end_x": "long", "end_y": "long"}
FIELDS |= {"root_x": "long", "root_y": "long", "key": "binary", "parent_key": "binary", "parent_conv": "long", "above": "array<binary>"}


def _keys(stack: list[_Node]) -> list[bytes]:
    """128 bits for each node's path."""
    keys, before = [], b""
    for node in stack:
        before = hashlib.blake2b(before + node.token.to_bytes(17, "big", signed=True), digest_size=16).digest()
        keys.append(before)
    return keys


def walk(merged: Iterator[tuple[Entry, int]]) -> Iterator[dict[str, Any]]:
    """Rows of ``FIELDS`` for the nodes of the trie of ``merged`` entries.

    The nodes of the first and of the last sequence may go on in other tasks.
    They are open: rows with a ``key``, the keys ``above`` them, and figures
    without those of open nodes below (``n`` and ``least`` include them). A row
    comes when its parent is left; open ones, and those below open ones, come
    with the key of the parent.
    """
    stack: list[_Node] = []

    def leave(depth: int, last: bool) -> Iterator[dict[str, Any]]:
        keys: list[bytes] | None = None
        while len(stack) > depth:
            node = stack.pop()
            node.open |= last
            parent = stack[-1] if stack else None
            if node.open:
                keys = keys or _keys([*stack, node])
                own = keys[len(stack)]
                for row in node.rows:
                    yield row | {"parent_key": own}
            else:
                for row in node.rows:
                    yield row | {"parent_conv": node.least}
                node.leaves = max(1, node.leaves)
                node.saved += (node.n - 1) * node.chars
            x, y = node.ends or (None, None)
            row = {"depth": len(stack), "n": node.n, "least": node.least, "children": node.children, "leaves": node.leaves, "saved": node.saved, "chars": node.chars}
            row |= {"end_x": x, "end_y": y}
            if not stack:
                row["root_x"], row["root_y"] = unpacked(node.token)
            if parent:
                parent.n += node.n
                parent.least = node.least if parent.least is None else min(parent.least, node.least)
            if node.open:
                yield row | {"key": own, "parent_key": keys[len(stack) - 1] if stack else None, "above": keys[: len(stack)]}
            elif parent is None:
                yield row
            else:
                parent.children += 1
                parent.leaves += node.leaves
                parent.saved += node.saved
                parent.rows.append(row)

    first = True
    for entry, shared in merged:
        yield from leave(shared, False)
        stack.extend(_Node(t, c, first) for t, c in zip(entry.sequence[shared:], entry.chars[shared:], strict=True))
        node, first = stack[-1], False
        node.n += entry.n
        node.least = entry.least if node.least is None else min(node.least, entry.least)
        node.ends = entry.ends
        for name, value in zip(("children", "leaves", "saved"), entry.below, strict=True):
            setattr(node, name, getattr(node, name) + value)
    yield from leave(0, True)
