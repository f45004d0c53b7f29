"""Periodic runs of words, found with a suffix automaton whose tree is accessed as a link-cut tree.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` and 2 q words
long, that no neighbouring word extends. The suffix links of the automaton form a tree; the path
from the root to a prefix holds all its suffixes, and each node knows where its words occurred last.
Nodes of one path with the same last end are a segment. When a word is appended, its prefix's path is
accessed and takes the new end as its colour. A segment that ended at j and whose deepest node is L
words long says that the longest common suffix of the prefixes j and i is L words. If L = i - j, these
words and those before them are a square, its period is the smallest, and no word before it keeps
the period. So each run is met once, at the end of its first square, and is then extended to the
right by doubling comparisons. Accesses cost a logarithm of the length each, taken over a text.

Only stretches that may hold runs go through the automaton: in a run every word lies in six words that
occur again in it, so a word without that ends a stretch, and what is left is looked at again until
nothing more goes. This drops no run, as hashes that agree by chance only keep more words.

A text of any length is one row in one task and takes memory in proportion to its words. Null and
empty texts have no runs; null collapses to the empty text. Repeated rows are each looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from careerlake.llm.common import let, positions, words

LEAST = 12
GRAM = LEAST // 2
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, GRAM, np.uint64) * np.uint64(2) + np.uint64(1)

FOUND = T.StructType([
    T.StructField("runs", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType()),
    ]))),
    T.StructField("collapsed", T.StringType()),
])


def automaton(letters: list) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, lengths of the longest words, and the state of every prefix."""
    link, length, following, prefixes = [-1], [0], [{}], []
    last = 0
    for letter in letters:
        state = len(link)
        link.append(0)
        length.append(length[last] + 1)
        following.append({})
        at = last
        while at >= 0 and letter not in following[at]:
            following[at][letter] = state
            at = link[at]
        if at >= 0:
            target = following[at][letter]
            if length[target] > length[at] + 1:
                copy = len(link)
                link.append(link[target])
                length.append(length[at] + 1)
                following.append(following[target].copy())
                while at >= 0 and following[at].get(letter) == target:
                    following[at][letter] = copy
                    at = link[at]
                link[target] = target = copy
            link[state] = target
        prefixes.append(state)
        last = state
    return link, length, prefixes


class Paths:
    """A rooted tree whose root paths are kept as splay trees, one per segment of equal colour.

    A segment's colour stands at the top of its splay tree.
    """

    def __init__(self, parents: list[int]):
        self.up = list(parents)  # parent in the splay tree; at its top, the parent of the segment
        self.before = [-1] * len(parents)
        self.after = [-1] * len(parents)
        self.colour = [0] * len(parents)

    def _raise(self, node: int) -> int:
        """Brings a node to the top of its splay tree; the segment's colour."""
        up, before, after = self.up, self.before, self.after
        while True:
            parent = up[node]
            if parent < 0:
                return self.colour[node]
            if before[parent] == node:
                left = True
            elif after[parent] == node:
                left = False
            else:
                return self.colour[node]
            above = up[parent]
            inner = above >= 0 and (before[above] == parent or after[above] == parent)
            if inner and (before[above] == parent) == left:
                self._turn(parent, above, left)
            elif inner:
                self._turn(node, parent, left)
                parent, left = above, not left
            self._turn(node, parent, left)

    def _turn(self, node: int, parent: int, left: bool) -> None:
        up, before, after = self.up, self.before, self.after
        above = up[parent]
        if left:
            moved = after[node]
            before[parent], after[node] = moved, parent
        else:
            moved = before[node]
            after[parent], before[node] = moved, parent
        if moved >= 0:
            up[moved] = parent
        up[parent], up[node] = node, above
        if above >= 0 and before[above] == parent:
            before[above] = node
        elif above >= 0 and after[above] == parent:
            after[above] = node
        else:
            self.colour[node] = self.colour[parent]

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Colours the path to the root; the segments it had, as old colour and deepest node."""
        up, after, found, below = self.up, self.after, [], -1
        while node >= 0:
            old = self._raise(node)
            if old:
                found.append((old, node))
            if after[node] >= 0:
                self.colour[after[node]] = old
            after[node] = below
            below, node = node, up[node]
        self.colour[below] = colour
        return found


def _extended(letters: list, at: int, period: int) -> int:
    """The end of the longest stretch from ``at`` on that repeats what stands a period before."""
    step = 1
    while step:
        if at + step <= len(letters) and letters[at : at + step] == letters[at - period : at - period + step]:
            at += step
            step *= 2
        else:
            step //= 2
    return at


def runs_of(letters: list) -> list[tuple[int, int, int]]:
    """Start, length and period of every run of any length of at least two periods."""
    link, length, prefixes = automaton(letters)
    paths = Paths(link)
    found = []
    for end, state in enumerate(prefixes, 1):
        for before, node in paths.access(state, end):
            period = end - before
            if length[node] == period:
                start = end - 2 * period
                found.append((start, _extended(letters, end, period) - start, period))
    return found


def _stretches(parts: list[bytes]) -> list[tuple[int, int]]:
    """Stretches of words outside of which no run has a word."""
    n = len(parts)
    if n < LEAST:
        return []
    marks = np.fromiter(map(hash, parts), np.int64, n).view(np.uint64)
    grams = marks[: n - GRAM + 1] * _FACTORS[0]
    for k in range(1, GRAM):
        grams += marks[k : n - GRAM + 1 + k] * _FACTORS[k]
    kept, waiting = [], [(0, n)]
    while waiting:
        begin, end = waiting.pop()
        here = grams[begin : end - GRAM + 1]
        order = np.argsort(here)
        equal = here[order[1:]] == here[order[:-1]]
        if not equal.any():
            continue
        edges = np.zeros(end - begin + 1, np.int64)
        for twice in (order[1:][equal], order[:-1][equal]):
            np.add.at(edges, twice, 1)
            np.add.at(edges, twice + GRAM, -1)
        inside = np.concatenate(([False], np.cumsum(edges[:-1]) > 0, [False]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        for first, last in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if last - first == end - begin:
                kept.append((begin, end))
            elif last - first >= LEAST:
                waiting.append((begin + first, begin + last))
    return kept


def runs(parts: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs of a list of words, by start, then period."""
    found = []
    for begin, end in _stretches(parts):
        numbers: dict[bytes, int] = {}
        letters = [numbers.setdefault(word, len(numbers)) for word in parts[begin:end]]
        found += [(begin + start, n, period) for start, n, period in runs_of(letters) if n >= LEAST]
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(parts: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without what runs repeat after their first period."""
    if found:
        edges = np.zeros(len(parts) + 1, np.int64)
        for start, n, period in found:
            edges[start + period] += 1
            edges[start + n] -= 1
        parts = [parts[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    return b" ".join(parts)


@F.arrow_udf(FOUND)
def periodic(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts:
        parts = (text.as_py() or "").encode().split()  # bytes: only ASCII spaces separate
        found = runs(parts)
        rows.append({
            "runs": [{"start": s, "length": n, "period": q} for s, n, q in found],
            "collapsed": collapsed(parts, found).decode(),
        })
    return pa.array(rows, to_arrow_type(FOUND))


def with_runs(docs: DataFrame, text: str = "text", runs_as: str = "runs", collapsed_as: str = "collapsed") -> DataFrame:
    """``docs`` with every text's runs (word number, words, period; by start, then period) and the
    text without repeats; columns of these names are replaced."""
    found = periodic(docs[text])
    return docs.withColumns({runs_as: found["runs"], collapsed_as: found["collapsed"]})


def longest(found: Column) -> Column:
    """The run with the greatest length, of equal ones that with the least start, then period; null without runs."""
    best = F.array_max(F.transform(found, lambda r: F.struct(r.length.alias("n"), (-r.start).alias("s"), (-r.period).alias("q"))))
    return F.when(best.isNotNull(), F.struct((-best.s).alias("start"), best.n.alias("length"), (-best.q).alias("period")))


def repeated(text: Column, at: Column, period: Column) -> Column:
    """The text with the words from number ``at`` on replaced by repeats of the first ``period`` of them."""
    return let(words(text), lambda parts: F.array_join(F.transform(
        positions(F.size(parts)),
        lambda i: F.get(parts, F.when(i < at, i).otherwise(at + (i - at) % period).cast("int")),
    ), " "))
