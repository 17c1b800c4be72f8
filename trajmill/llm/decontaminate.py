"""Benchmark passages in documents, found by the q-gram lemma.

Both sides are reduced to lower-case letters and digits with single spaces. If an item of m
characters stands in a text with at most e edits, the two share at least ``m - q + 1 - e * q``
q-grams, all on diagonals (place in the text less place in the item) no more than e apart.
So shared q-grams are counted in overlapping bands of diagonals, each ``2 (e + 1)`` wide;
only regions that reach the bound are aligned, within their band. Nothing within the edit
budget is missed.

An item may leave out some of its most common q-grams: each one left out lowers its bound by
one, which keeps the lemma true.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters handled at once.
BUFFER = 1 << 20
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_MAP_BITS = 22


def _letter_table() -> np.ndarray:
    """For code points below 65536: the lower-case letter or digit, 32 for anything else."""
    table = np.full(1 << 16, 32, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


_TABLE: list[np.ndarray] = []


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, place of each in the text). Code points above 65535 count as letters."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = _TABLE[0][np.minimum(raw, 65535)]
    high = raw > 65535
    if high.any():
        codes = np.where(high, raw, codes)
    space = codes == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    if len(space) and space[0]:
        keep[0] = False
    at = np.flatnonzero(keep)
    if len(at) and codes[at[-1]] == 32:
        at = at[:-1]
    return codes[at], at


def _gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = codes[:n].astype(np.uint64)
    for k in range(1, q):
        h *= _BASE
        h += codes[k : k + n]
    h *= _MIX
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h


@dataclass
class Index:
    q: int
    ids: list
    items: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    firsts: np.ndarray
    entry_item: np.ndarray
    entry_place: np.ndarray
    known: np.ndarray
    short: list[int]


def build(ids: list, texts: list[str | None], q: int = 7, rate: float = 0.12) -> Index:
    """The index of one block of items. The edit budget of an item is ``rate`` of its length, or as
    much less as the lemma needs to ask for a q-gram per eight characters; items shorter than 4 q
    must occur exactly, as whole words; items without letters never occur."""
    items = [normalise(t or "")[0] for t in texts]
    lengths = np.array([len(i) for i in items], dtype=np.int64)
    spare = (lengths - q + 1 - np.maximum(1, lengths // 8)) // q
    edits = np.minimum((rate * lengths).astype(np.int64), np.maximum(0, spare))
    bound = lengths - q + 1 - edits * q
    short = [i for i, n in enumerate(lengths) if 0 < n < 4 * q]
    long = [i for i, n in enumerate(lengths) if n >= 4 * q]
    hashes = [_gram_hashes(items[i], q) for i in long]
    every, where, how_often = (
        np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        if long
        else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    )
    need, parts, at = bound.copy(), [], 0
    for i, own in zip(long, hashes):
        counts = how_often[where[at : at + len(own)]]
        at += len(own)
        common = np.argsort(-counts, kind="stable")[: bound[i] // 2]
        left_out = common[counts[common] > 4]
        need[i] -= len(left_out)
        kept = np.setdiff1d(np.arange(len(own)), left_out)
        parts.append((own[kept], np.full(len(kept), i, dtype=np.int64), kept))
    grams = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.uint64)
    order = np.argsort(grams, kind="stable")
    keys, firsts = np.unique(grams[order], return_index=True)
    known = np.zeros(1 << _MAP_BITS, dtype=bool)
    known[keys >> np.uint64(64 - _MAP_BITS)] = True
    return Index(
        q,
        list(ids),
        items,
        edits,
        need,
        keys,
        np.append(firsts, len(grams)),
        np.concatenate([p[1] for p in parts])[order] if parts else np.zeros(0, np.int64),
        np.concatenate([p[2] for p in parts])[order] if parts else np.zeros(0, np.int64),
        known,
        short,
    )


def align(item: np.ndarray, codes: np.ndarray, base: int, width: int, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best occurrence of the item on the diagonals from ``base`` on, ends in
    ``codes``; None if it needs more than ``most`` edits. A start costs nothing."""
    steps = np.arange(width)
    padded = np.zeros(len(item) + width, dtype=codes.dtype)
    lo, hi = max(base, 0), min(base + len(padded), len(codes))
    if lo < hi:
        padded[lo - base : hi - base] = codes[lo:hi]
    row = np.zeros(width, dtype=np.int64)
    for j, c in enumerate(item):
        new = row + (padded[j : j + width] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        if j % 16 == 0 and row.min() > most:
            return None
    best = int(row.argmin())
    if row[best] > most:
        return None
    return int(row[best]), base + len(item) + best


def occurrence(item: np.ndarray, codes: np.ndarray, base: int, width: int, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best occurrence within the band."""
    lo = max(0, base)
    exact = codes[lo : max(0, base + len(item) + width)].tobytes().find(item.tobytes())
    if exact >= 0 and exact % 4 == 0:
        return lo + exact // 4, lo + exact // 4 + len(item), 0
    found = align(item, codes, base, width, most)
    if found is None:
        return None
    edits, end = found
    # What an item has beyond the end of the text is as many edits whether replaced or left out.
    end = min(end, len(codes))
    # The start is the end of the reversed item in the reversed text before the end.
    reach = len(item) + edits
    before = codes[max(0, end - reach) : end][::-1]
    back = align(item[::-1], before, -edits, 2 * edits + 1, edits)
    start = end - (back[1] if back else len(item))
    return max(start, 0), end, edits


def _regions(index: Index, codes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, item, band) with enough shared q-grams."""
    hashes = _gram_hashes(codes, index.q)
    maybe = np.flatnonzero(index.known[hashes >> np.uint64(64 - _MAP_BITS)])
    place = np.searchsorted(index.keys, hashes[maybe])
    hit = index.keys[np.minimum(place, len(index.keys) - 1)] == hashes[maybe] if len(index.keys) else np.zeros(len(maybe), bool)
    at, place = maybe[hit], place[hit]
    first, count = index.firsts[place], index.firsts[place + 1] - index.firsts[place]
    if not count.sum():
        return []
    at = np.repeat(at, count)
    entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    item = index.entry_item[entry]
    band = (at - index.entry_place[entry]) // (index.edits[item] + 1)
    group = doc[at].astype(np.int64) * len(index.items) + item
    # Each hit counts for the band that starts at its own part of the diagonals and for the one that
    # starts a part earlier: of parts of edits + 1 diagonals any two neighbours make a band.
    key = (group << 24) + (band + 8)
    key, item = np.concatenate([key, key - 1]), np.concatenate([item, item])
    # A table of counts by hash first: few hits are left to be sorted.
    slot = ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - _MAP_BITS)).astype(np.int64)
    enough = np.bincount(slot, minlength=1 << _MAP_BITS)[slot] >= index.need[item]
    keys, counts = np.unique(key[enough], return_counts=True)
    owner = (keys >> 24) % len(index.items)
    keys = keys[counts >= index.need[owner]]
    return [(int((k >> 24) // len(index.items)), int((k >> 24) % len(index.items)), int(k & 0xFFFFFF) - 8) for k in keys]


def _best_apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping occurrences of one item the one with the fewest edits, then the first."""
    kept: dict[int, list[tuple[int, int, int]]] = {}
    for item, start, end, edits in sorted(set(found), key=lambda x: (x[3], x[1], x[2])):
        own = kept.setdefault(item, [])
        if not any(s < end and start < e for s, e, _ in own):
            own.append((start, end, edits))
    return sorted((item, *x) for item, own in kept.items() for x in own)


def search(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits) of all occurrences; start and end are
    characters of the text as it is."""
    out: list[tuple[int, int, int, int, int]] = []
    gap = np.zeros(int(index.edits.max(initial=0)) + 1, dtype=np.uint32)
    overlap = max((len(i) for i in index.items), default=0) + 2 * len(gap)
    group: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    found: dict[int, list] = {}

    def flush() -> None:
        if not group:
            return
        codes = np.concatenate([x for _, _, c, _ in group for x in (c, gap)])
        sizes = np.array([len(c) + len(gap) for _, _, c, _ in group])
        starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(group)), sizes)
        for g, item, band in _regions(index, codes, doc):
            width = int(index.edits[item]) + 1
            number, shift, own, places = group[g]
            hit = occurrence(index.items[item], own, band * width - int(starts[g]), 2 * width, int(index.edits[item]))
            if hit:
                start, end, edits = hit
                if end > start:
                    found.setdefault(number, []).append(
                        (item, shift + int(places[start]), shift + int(places[end - 1]) + 1, edits)
                    )
        group.clear()

    size = 0
    for number, text in enumerate(texts):
        codes, places = normalise(text or "")
        for item in index.short:
            word = index.items[item]
            for at in _exactly(word, codes):
                found.setdefault(number, []).append((item, int(places[at]), int(places[at + len(word) - 1]) + 1, 0))
        # Long texts are cut into parts that overlap by more than any occurrence.
        for lo in range(0, max(1, len(codes)), BUFFER):
            part = slice(lo, lo + BUFFER + overlap)
            group.append((number, 0, codes[part], places[part]))
            size += len(codes[part])
            if size >= BUFFER:
                flush()
                size = 0
    flush()
    for number, own in sorted(found.items()):
        out += [(number, *x) for x in _best_apart(own)]
    return out


def _exactly(word: np.ndarray, codes: np.ndarray) -> list[int]:
    if len(word) > len(codes):
        return []
    at = np.flatnonzero(codes[: len(codes) - len(word) + 1] == word[0])
    for k in range(1, len(word)):
        at = at[codes[at + k] == word[k]]
    ends = at + len(word)
    whole = ((at == 0) | (codes[at - 1] == 32)) & ((ends == len(codes)) | (codes[np.minimum(ends, len(codes) - 1)] == 32))
    return at[whole].tolist()


def _blocks(benchmark: DataFrame, q: int, rate: float, item_id: str, text: str, block_chars: int) -> Iterator[Index]:
    """Indexes of blocks of items with about ``block_chars`` characters each: what a task holds does
    not grow with the benchmark, only the number of passes does."""
    items = benchmark.select(F.col(item_id).alias("id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // block_chars))
    for block in range(count):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == block).orderBy("id", "text").collect()
        if own:
            yield build([r["id"] for r in own], [r["text"] for r in own], q, rate)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    q: int = 7,
    rate: float = 0.12,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_chars: int = 4_000_000,
) -> DataFrame:
    """(id column, item id, start, end, edits): every place where a benchmark item stands in a
    document with at most ``rate`` of its characters edited.

    Case, punctuation and white space do not count. Of overlapping occurrences of one item the
    best is returned. Null and empty texts and items give no rows; repeated rows give repeated
    rows; null ids stay; other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, start long, end long, edits long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    found = spark.createDataFrame([], schema)
    for index in _blocks(benchmark, q, rate, item_id, item_text, block_chars):
        shared = spark.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = Index(**shared.value)
            for batch in batches:
                ids = batch["id"].tolist()
                hits = search(own, batch["text"].tolist())
                yield pd.DataFrame(
                    {
                        "id": pd.Series([ids[h[0]] for h in hits], dtype=batch["id"].dtype),
                        "item": [own.ids[h[1]] for h in hits],
                        "start": [h[2] for h in hits],
                        "end": [h[3] for h in hits],
                        "edits": [h[4] for h in hits],
                    }
                )

        found = found.unionByName(rows.mapInPandas(run, schema))
    return found.withColumnsRenamed({"id": id_col, "item": item_id})


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    q: int = 7,
    rate: float = 0.12,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_chars: int = 4_000_000,
) -> DataFrame:
    """The documents, all columns, in which no benchmark item stands."""

    def leaks(index: Index) -> Column:
        shared = docs.sparkSession.sparkContext.broadcast(vars(index))

        @F.pandas_udf("boolean")
        def any_item(texts: pd.Series) -> pd.Series:
            hit = {h[0] for h in search(Index(**shared.value), texts.tolist())}
            return pd.Series([i in hit for i in range(len(texts))], dtype=bool)

        return any_item(F.col(text).cast("string"))

    for index in _blocks(benchmark, q, rate, item_id, item_text, block_chars):
        docs = docs.where(~leaks(index))
    return docs
