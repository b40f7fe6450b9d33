"""Patterns of token tags with gaps, run as one finite automaton over whole batches of token arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


class TagAutomaton:
    """All patterns compiled to one table of transitions.

    A pattern is a sequence of tags; between two of its tags up to ``max_gap`` tokens of
    other tags than the next one may stand. A state is, for each pattern, the tags met
    and the gap so far; states are made as they are reached from the start. Tags that no
    pattern names share one column of the table.
    """

    def __init__(self, patterns: list[list[str]], max_gap: int = 0):
        if not patterns or not all(patterns):
            raise ValueError("patterns must not be empty")
        self.patterns, self.max_gap = patterns, max_gap
        self.tags = sorted({t for p in patterns for t in p})
        self.code = {t: k + 1 for k, t in enumerate(self.tags)}
        self.longest = max((len(p) - 1) * (max_gap + 1) + 1 for p in patterns)
        dead = (None,) * len(patterns)
        start = ((0, 0),) * len(patterns)
        self.states = {dead: 0, start: 1}
        rows, accept, todo = [[0] * (len(self.tags) + 1)], [[False] * len(patterns)], [start]
        while todo:
            state = todo.pop(0)
            row = []
            for tag in (None, *self.tags):
                new = tuple(self._step(k, s, tag, state is start) for k, s in enumerate(state))
                if new not in self.states:
                    self.states[new] = len(self.states)
                    todo.append(new)
                row.append(self.states[new])
            rows.append(row)
            accept.append([s is not None and s[0] == len(p) for s, p in zip(state, patterns)])
        self.table, self.accept = np.array(rows, dtype=np.int32), np.array(accept)

    def _step(self, k: int, at: tuple[int, int] | None, tag: str | None, first: bool) -> tuple[int, int] | None:
        if at is None or at[0] == len(self.patterns[k]):
            return None
        if tag == self.patterns[k][at[0]]:
            return at[0] + 1, 0
        return (at[0], at[1] + 1) if not first and at[1] < self.max_gap else None

    def ends(self, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """(patterns, tokens): how many tokens the match that starts at each token spans, 0 for none.

        codes are the tags of all texts in a row, left the tokens from each one to its text's end.
        Every token starts a run of the automaton and all runs advance together.
        """
        out = np.zeros((len(self.patterns), len(codes)), dtype=np.int32)
        live, state = np.arange(len(codes)), np.ones(len(codes), dtype=np.int32)
        for step in range(self.longest):
            state = self.table[state, codes[live + step]]
            done = self.accept[state]
            for k in range(len(self.patterns)):
                hit = live[done[:, k]]
                out[k, hit] = step + 1
            keep = (state > 0) & (left[live] > step + 1)
            live, state = live[keep], state[keep]
            if not len(live):
                break
        return out

    def runs(self, tags: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ends() of a list array of tags, and the offsets of its texts."""
        offsets = tags.offsets.to_numpy() - tags.offsets[0].as_py()
        flat = tags.flatten()
        coded = flat.dictionary_encode()
        names = np.array([self.code.get(t, 0) for t in coded.dictionary.to_pylist()] + [0], dtype=np.int32)
        codes = names[coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)]
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(codes))
        return self.ends(codes, left), offsets


def _first_free(size: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
    """Matches from left to right that don't overlap: (first token, tokens)."""
    out, free = [], a
    for i in np.flatnonzero(size[a:b]) + a:
        if i >= free:
            out.append((int(i), int(size[i])))
            free = i + size[i]
    return out


def tag_spans(patterns: list[list[str]], max_gap: int = 0) -> Callable:
    """An Arrow UDF of a column of tag arrays: the spans of each pattern, (pattern, first, last) by token numbers from 0.

    Spans of one pattern don't overlap, the leftmost first. A null array gives null.
    """
    auto = TagAutomaton(patterns, max_gap)
    kind = pa.list_(pa.struct([("pattern", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))

    @F.arrow_udf("array<struct<pattern:int,first:int,last:int>>")
    def run(tags: pa.Array) -> pa.Array:
        size, offsets = auto.runs(tags)
        null, out = tags.is_null().to_pylist(), []
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            spans = [(k, at - a, at - a + n - 1) for k in range(len(auto.patterns)) for at, n in _first_free(size[k], a, b)] if size[:, a:b].any() else []
            out.append(None if null[i] else [{"pattern": k, "first": x, "last": y} for k, x, y in spans])
        return pa.array(out, kind)

    return run


def tags_kept(patterns: list[list[str]]) -> Callable:
    """An Arrow UDF of a column of tag arrays: for each token, whether no occurrence of any pattern covers it.

    Occurrences may overlap; a pattern of one tag excludes its tokens. Null gives null.
    """
    auto = TagAutomaton(patterns)

    @F.arrow_udf("array<boolean>")
    def run(tags: pa.Array) -> pa.Array:
        size, offsets = auto.runs(tags)
        change = np.zeros(size.shape[1] + 1, dtype=np.int64)
        for k in range(len(auto.patterns)):
            at = np.flatnonzero(size[k])
            np.add.at(change, at, 1)
            np.add.at(change, at + size[k][at], -1)
        kept = pa.array(np.cumsum(change)[:-1] == 0)
        null = np.append(tags.is_null().to_numpy(zero_copy_only=False), False)
        return pa.ListArray.from_arrays(pa.array(offsets, mask=null, type=pa.int32()), kept)

    return run
