"""Periodic run detection: suffix automaton with link-cut access.

A run is a stretch of consecutive words with least period q and length at least
max(24, 3 q) that no neighbouring word extends keeping the period.

Method. The words of a stretch are appended to a suffix automaton one by one. Its
suffix links form a tree, kept as a link-cut tree whose preferred paths carry
the place where their node's strings ended last (one colour a path). Appending word i accesses the
node of the whole prefix: the path to the root is recoloured to i, and on the
way every segment of another colour e shows its deepest node, whose strings of
up to ``length`` words end at e and at i, and not in between. So the last
length + (i - e) words have period d = i - e, no smaller one if length >= 2 d, and
can't be extended to the left; with d <= length they hold a square. If the next word
breaks the period they can't be extended to the right either: every run is
found once, at its last word, by the segment that holds its last 2 q words. A
stretch of n words recolours O(n log n) segments.

What is appended. In a run each of two words q apart starts or ends equal stretches of
16 words or more (24 - 8, or 2 q if q is over 8), at most a third of the
stretch apart. So a run lies within words that are covered by repeated 16-word
windows at such a distance, and whole within one block of them. Only such blocks go to the automaton (again
cut by their own windows until nothing falls away); windows are compared by
64-bit hashes, which can only add blocks, never lose one.

A text is handled in one task; memory grows with its longest block. Defined
results: null and empty texts have no words and no runs, and collapse to "";
repeated rows keep their rows; all input columns stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlens.llm.shared import small_batches
from merchlens.llm.words import mix

LEAST, TIMES = 24, 3  # a run has at least LEAST words and TIMES periods
WINDOW = 16  # words of a window: LEAST - LEAST // TIMES, and a power of two

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class RecolouredAutomaton:
    """A suffix automaton (nodes from 1, the root; 0: none) whose link tree is a link-cut tree of splay trees, one a preferred path."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0, 0], [0, 0], [{}, {}]
        self.left, self.right, self.up = [0, 0], [0, 0], [0, 0]
        self.colour = [-1, -1]  # valid at the root of a path's splay tree
        self.last, self.words = 1, 0

    def _node(self, length: int, link: int, arcs: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(arcs)
        for of in (self.left, self.right):
            of.append(0)
        self.up.append(link)
        self.colour.append(-1)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        """Make ``x`` the root of its path's splay tree; the path keeps its colour."""
        left, right, up = self.left, self.right, self.up
        y = up[x]
        if not y or (left[y] != x and right[y] != x):
            return
        while True:
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if inner and (left[y] == x) == (left[z] == y):  # same sides: the parent goes first
                self._rotate(y, z)
                self._rotate(x, y)
            else:
                self._rotate(x, y)
                if inner:
                    self._rotate(x, z)
            if not inner:
                self.colour[x] = self.colour[y]
                return
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                self.colour[x] = self.colour[z]
                return

    def _rotate(self, x: int, y: int) -> None:
        left, right, up = self.left, self.right, self.up
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b:
            up[b] = y
        up[y], up[x] = x, z
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def _extend(self, word: int) -> None:
        length, link, arcs = self.length, self.link, self.next
        p, self.words = self.last, self.words + 1
        new = self.last = self._node(self.words, 0, {})
        while p and word not in arcs[p]:
            arcs[p][word] = new
            p = link[p]
        if not p:
            to = 1
        else:
            to = q = arcs[p][word]
            if length[p] + 1 != length[q]:
                to = self._clone(q, length[p] + 1)
                while p and arcs[p].get(word) == q:
                    arcs[p][word] = to
                    p = link[p]
        link[new] = self.up[new] = to

    def _clone(self, q: int, length: int) -> int:
        """A node between ``q`` and its link, on the path of ``q``."""
        self._splay(q)
        clone = self._node(length, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        above = self.left[clone] = self.left[q]
        if above:
            self.up[above] = clone
        self.left[q], self.up[clone] = clone, q
        return clone

    def append(self, word: int) -> list[tuple[int, int]]:
        """(last end, length) of the longest strings that end here and ended there last, by segment."""
        self._extend(word)
        end, below, x, out = self.words - 1, self.last, self.up[self.last], []
        while x:  # access: the path to the root becomes one of the new colour
            self._splay(x)
            out.append((self.colour[x], self.length[x]))
            if self.right[x]:
                self.colour[self.right[x]] = self.colour[x]
            self.right[x], self.up[below] = below, x
            below, x = x, self.up[x]
        self.colour[below] = end
        return out


def block_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of word numbers, by their last word."""
    automaton, n, out = RecolouredAutomaton(), len(words), []
    append = automaton.append
    for end in range(n):
        for last, length in append(words[end]):
            period = end - last
            if length >= (TIMES - 1) * period and length + period >= LEAST and (end + 1 == n or words[end + 1] != words[end + 1 - period]):
                out.append((end + 1 - length - period, length + period, period))
    return out


def blocks(words: np.ndarray, at: int = 0) -> Iterator[tuple[int, int]]:
    """(start, end) of the blocks that can hold runs: words covered by windows that repeat at most a third of the block apart."""
    todo = [(at, at + len(words))]
    while todo:
        low, high = todo.pop()
        if high - low < LEAST:
            continue
        grams, size = mix(words[low - at:high - at].astype(np.uint64)), 1
        while size < WINDOW:
            with np.errstate(over="ignore"):
                grams = mix(grams[:-size] * np.uint64(0xD6E8FEB86659FD93) + grams[size:])
            size *= 2
        order = np.argsort(grams, kind="stable")
        near = (grams[order[1:]] == grams[order[:-1]]) & (order[1:] - order[:-1] <= (high - low) // TIMES)
        if not near.any():
            continue
        cover = np.zeros(high - low + 1, np.int64)
        for of in (order[1:][near], order[:-1][near]):
            np.add.at(cover, of, 1)
            np.add.at(cover, of + WINDOW, -1)
        inside = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        if len(edges) == 2 and edges[1] - edges[0] == high - low:
            yield low, high
        else:
            todo += [(low + int(x), low + int(y)) for x, y in zip(edges[::2], edges[1::2], strict=True)]


def find_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of words, by start, then period."""
    if len(words) < LEAST:
        return []
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(number) > len(words) - WINDOW:  # a run has at least so many words after its first period, which holds all its different ones
        return []
    return sorted((low + start, length, period) for low, high in blocks(np.array(ids)) for start, length, period in block_runs(ids[low:high]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        drop = np.zeros(len(words), bool)
        for start, length, period in runs:
            drop[start + period:start + length] = True
        words = [w for w, gone in zip(words, drop.tolist(), strict=True) if not gone]
    return b" ".join(words)


def _pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, runs, texts = [], [], []
        for text in batch.column(batch.num_columns - 1):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()  # at 0x20 and 0x09-0x0D
            found = find_runs(words)
            counts.append(len(words))
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            texts.append(collapsed(words, found))
        kept = batch.columns[:-1]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(runs, RUNS), pa.array(texts, pa.binary()).cast(pa.string())],
                                         names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", columns: tuple[str, str, str] = ("n_words", "runs", "collapsed")) -> DataFrame:
    """``docs`` with the number of words, the runs (array of start, length, period) and the collapsed text, under the names ``columns``,
    which replace columns of these names."""
    small_batches(docs.sparkSession)
    kept = docs.drop(*(c for c in columns if c != text))
    names = kept.columns
    plain = kept.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("t", F.col(f"c{names.index(text)}"))
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate(f.dataType.simpleString() for f in kept.schema.fields))
    made = plain.mapInArrow(_pass, f"{schema}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return made.toDF(*names, *columns)
