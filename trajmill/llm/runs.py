"""Periodic runs of words, found online by catchers over dyadic blocks.

For every power of two L, the words read so far are cut into blocks of L words. A completed
block is a catcher of the periods 2L-1 to 4L-2: any stretch of 2L-1 words holds a whole block, so
where a square of such a period ends, a block of its first half is met again one period later. With
every appended word the suffix of L words is compared with the two catchers of each L whose
periods it can complete. Matches of neighbouring blocks at one distance are merged into chains; a
chain, lengthened by the few words before its first and after its last block, is the whole
stretch in which words repeat at that distance, and squares that overlap become one run.

Blocks are compared by 64-bit hashes, doubled from level to level: two comparisons a word and
level, whatever the text holds, so a text of n words takes O(n log n) steps. Words are appended in
pieces, which numpy handles at once; how a text is cut into pieces changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are appended at once, and that short texts fill together.
PIECE = 1 << 16
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


class _Row:
    """A growing array."""

    def __init__(self) -> None:
        self.room, self.size = np.zeros(1024, dtype=np.uint64), 0

    def extend(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.room):
            larger = np.zeros(2 * (self.size + len(values)), dtype=np.uint64)
            larger[: self.size] = self.room[: self.size]
            self.room = larger
        self.room[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def now(self) -> np.ndarray:
        return self.room[: self.size]


class Catchers:
    """Runs of a stream of words, given as numbers.

    A run is a stretch with smallest period q, of at least ``times`` periods and ``least`` words,
    that no neighbouring word extends. ``longest`` bounds the texts in the stream: where several are
    appended, each followed by a number of its own, no longer period is looked for.
    """

    def __init__(self, times: int = 4, least: int = 6, longest: int | None = None) -> None:
        if times < 2:
            raise ValueError("a run has two periods at least")
        self.times, self.least, self.longest = times, least, longest
        self.size = 0
        self.levels = [_Row()]
        #: Chains of each level: period, first and last block, as columns.
        self.chains = [np.zeros((0, 3), dtype=np.int64)]

    def append(self, words: np.ndarray) -> None:
        """Advance all catchers over more words."""
        self.size += len(words)
        self.levels[0].extend(_mixed(words.astype(np.uint64) * _ODD + _ODD))
        reach = self.size if self.longest is None else min(self.size, self.longest)
        while self.times * ((2 << len(self.levels)) - 1) <= reach:
            self.levels.append(_Row())
            self.chains.append(np.zeros((0, 3), dtype=np.int64))
        fresh = self.size - len(words)
        for k, row in enumerate(self.levels):
            length = 1 << k
            if k:
                fresh, below = row.size, self.levels[k - 1].now
                half = length // 2
                left, right = below[fresh : len(below) - half], below[fresh + half :]
                row.extend(_mixed(left * _ODD + right))
            self._catch(k, length, fresh, row.now)

    def _catch(self, k: int, length: int, fresh: int, hashes: np.ndarray) -> None:
        """Compare the suffixes that end in the new words with their two catchers."""
        at = np.arange(max(fresh, 2 * length - 1), len(hashes), dtype=np.int64)
        nearest = (at - 2 * length + 1) // length * length
        found = []
        for block in (nearest, nearest - length):
            hit = np.flatnonzero((block >= 0) & (hashes[at] == hashes[block]))
            block = block[hit]
            found.append(np.stack([at[hit] - block, block, block], axis=1))
        chains = np.concatenate([self.chains[k], *found])
        chains = chains[np.lexsort((chains[:, 1], chains[:, 0]))]
        follows = (chains[1:, 0] == chains[:-1, 0]) & (chains[1:, 1] == chains[:-1, 2] + length)
        starts = np.flatnonzero(np.concatenate([[True], ~follows])) if len(chains) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([starts[1:], [len(chains)]])[: len(starts)] - 1
        chains = np.stack([chains[starts, 0], chains[starts, 1], chains[ends, 2]], axis=1)
        # A chain whose next block has been compared grows no more: if it is too short, it goes.
        open_ = chains[:, 2] + 2 * length + chains[:, 0] > self.size
        self.chains[k] = chains[open_ | self._enough(chains[:, 0], chains[:, 2] - chains[:, 1] + 3 * length - 2)]

    def _enough(self, period: np.ndarray, stretch: np.ndarray) -> np.ndarray:
        return stretch + period >= np.maximum(self.times * period, self.least)

    def runs(self) -> np.ndarray:
        """(start, length, period) rows of the runs in the words so far, by start, then period."""
        found = [np.zeros((0, 3), dtype=np.int64)]
        for k, chains in enumerate(self.chains):
            length = 1 << k
            period, first, last = chains.T
            some = self._enough(period, last - first + 3 * length - 2)
            period, first, end = period[some], first[some].copy(), last[some] + length
            for j in range(k - 1, -1, -1):
                step, row = 1 << j, self.levels[j].now
                before = first - step
                same = before >= 0
                same[same] = row[before[same]] == row[before[same] + period[same]]
                first = np.where(same, before, first)
                same = end + period + step <= self.size
                same[same] = row[end[same]] == row[end[same] + period[same]]
                end = np.where(same, end + step, end)
            whole = self._enough(period, end - first)
            found.append(np.stack([first, end - first + period, period], axis=1)[whole])
        every = np.concatenate(found)
        # Multiples of a run's period fill the same stretch: the smallest stays.
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        again = (every[1:, 0] == every[:-1, 0]) & (every[1:, 1] == every[:-1, 1])
        every = every[np.concatenate([[True], ~again])] if len(every) else every
        return every[np.lexsort((every[:, 2], every[:, 0]))]


def runs_of(
    texts: Iterable[list[bytes]], times: int = 4, least: int = 6
) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Each text of words with its runs. Short texts share a stream, each ended by a word of its own."""
    group: list[list[bytes]] = []
    size = 0
    for words in texts:
        if group and size + len(words) > PIECE:
            yield from _runs_of_group(group, times, least)
            group, size = [], 0
        group.append(words)
        size += len(words) + 1
    yield from _runs_of_group(group, times, least)


def _runs_of_group(
    group: list[list[bytes]], times: int, least: int
) -> Iterator[tuple[list[bytes], np.ndarray]]:
    ids: dict = {}
    codes = np.empty(sum(map(len, group)) + len(group), dtype=np.int64)
    starts, at = [], 0
    for words in group:
        starts.append(at)
        codes[at : at + len(words)] = [ids.setdefault(w, len(ids)) for w in words]
        at += len(words)
        codes[at] = -len(starts)
        at += 1
    catchers = Catchers(times, least, max(map(len, group), default=0))
    for piece in range(0, at, PIECE):
        catchers.append(codes[piece : piece + PIECE])
    found = catchers.runs()
    cuts = np.searchsorted(found[:, 0], starts)
    for i, start in enumerate(starts):
        own = found[cuts[i] : cuts[i + 1] if i + 1 < len(cuts) else len(found)]
        yield group[i], own - [start, 0, 0]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that repeat the first period of a run."""
    if not len(runs):
        return words
    # A count of the runs that drop a word, from its changes.
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def highest(runs: np.ndarray) -> int | None:
    """The place of the run with the greatest length / period; ties: smallest start, then period."""
    best = None
    for i, (_, length, period) in enumerate(runs.tolist()):
        if best is None or length * best[1] > best[0] * period:
            best = length, period, i
    return best and best[2]


_FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, top int, collapsed string"


def _finder(times: int, least: int):
    @F.pandas_udf(_FOUND)
    def finder(texts: pd.Series) -> pd.DataFrame:
        words = ((t or "").encode("utf-8", "surrogatepass").split() for t in texts)
        rows = []
        for own, runs in runs_of(words, times, least):
            kept = b" ".join(collapse(own, runs)).decode("utf-8", "surrogatepass")
            named = [{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()]
            rows.append((len(own), named, highest(runs), kept))
        found = pd.DataFrame(rows, columns=["n_words", "runs", "top", "collapsed"])
        return found.astype({"top": "Int32"})

    return finder


def find_runs(docs: DataFrame, times: int = 4, least: int = 6, text: str = "text") -> DataFrame:
    """(row, n_words, runs, top, collapsed) of every row of the documents.

    ``row`` holds all columns as they were, whatever their names. Words are split at ASCII white
    space and compared as they are. ``runs`` are the (start, length, period) of all runs of at
    least ``times`` periods and ``least`` words, by start, then period; ``top`` is the place, from 0, of
    the one with the greatest length / period (null without any; ties: smallest start, then period);
    ``collapsed`` holds the words that no run repeats, joined by one space. Null and empty texts
    have no words, no runs and an empty ``collapsed``. Rows are handled each on its own: repeated
    rows repeat their result, an empty table gives an empty one. A task holds, for one text at a
    time or for short texts of ``PIECE`` words together, 8 bytes a word for every power of two up
    to an eighth of its words.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].cast("string").alias("text"))
    return rows.select("row", _finder(times, least)("text").alias("found")).select("row", "found.*")
