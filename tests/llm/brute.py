"""Brute-force versions of the operators, for small tables."""

from __future__ import annotations

import re

import numpy as np
import regex
import xxhash

MASK = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: str | None, size: int) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    shingles = shingles or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(count: int, links) -> list[int]:
    parent = list(range(count))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(count)]


def near(prints: list[int], bits: int):
    table = np.array(prints, dtype=np.uint64)
    for i in range(len(table)):
        for j in np.flatnonzero(np.bitwise_count(table[i + 1 :] ^ table[i]) <= bits):
            yield i, i + 1 + int(j)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def line_words(line: str) -> str:
    """A line as it is compared: lower-case words, or its visible characters if it has none."""
    words = [w for w in regex.split(r"[^\p{L}\p{M}\p{N}\p{S}#%&*+@/\\-]+", line.lower()) if w]
    return " ".join(words) or regex.sub(r"[\s\p{Z}\p{C}]+", "", line)


def like_lines(lines: list[str], similarity=0.9):
    """All pairs whose edits are at most (1 - similarity) of the longer. An edit changes at most three
    3-grams of either text, so texts with too many different ones need no comparison."""
    size = 256
    grams = np.zeros((len(lines), size), dtype=np.int32)
    for row, line in zip(grams, lines):
        for i in range(len(line) - 2):
            row[xxhash.xxh32_intdigest(line[i : i + 3].encode()) % size] += 1
    lengths = np.array([len(x) for x in lines])
    for i, line in enumerate(lines):
        most = (np.maximum(lengths[i + 1 :], lengths[i]) * (1 - similarity) + 1e-9).astype(int)
        apart = np.abs(grams[i + 1 :] - grams[i]).sum(axis=1)
        for j in np.flatnonzero((np.abs(lengths[i + 1 :] - lengths[i]) <= most) & (apart <= 6 * most)):
            if edits(line, lines[i + 1 + j]) <= most[j]:
                yield i, i + 1 + int(j)


def dropped_lines(docs: list[tuple], similarity=0.9) -> set[tuple]:
    """(id, text hash, line) of the occurrences that go, of (id, text) documents."""
    found: dict[str, list[tuple]] = {}
    for doc_id, text in docs:
        if text is None:
            continue
        k = signed(xxhash.xxh64_intdigest(text.encode(), 42))
        for at, line in enumerate(text.split("\n")):
            if norm := line_words(line):
                found.setdefault(norm, []).append((doc_id is None, doc_id, k, at))
    lines = list(found)
    members: dict[int, set[tuple]] = {}
    for line, group in zip(lines, groups(len(lines), like_lines(lines, similarity))):
        members.setdefault(group, set()).update(found[line])
    order = lambda o: (o[0], o[1] or 0, o[2], o[3])
    return {o[1:] for own in members.values() for o in own if o != min(own, key=order)}


def kept_text(doc_id, text: str | None, gone: set[tuple]) -> str | None:
    if text is None:
        return None
    k = signed(xxhash.xxh64_intdigest(text.encode(), 42))
    return "\n".join(line for at, line in enumerate(text.split("\n")) if (doc_id, k, at) not in gone)


def plain(text: str) -> str:
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def nearest(item: str, text: str) -> int:
    """The least edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for c in item:
        new = [row[0] + 1]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def runs(words: list, times: int = 4, least: int = 6) -> list[list[int]]:
    """[start, length, period] of the periodic runs: every distance, every stretch."""
    found = []
    for p in range(1, len(words) // times + 1):
        same = [a == b for a, b in zip(words, words[p:])] + [False]
        start = None
        for at, equal in enumerate(same):
            if equal and start is None:
                start = at
            elif not equal and start is not None:
                if at - start + p >= max(least, times * p):
                    own = words[start : at + p]
                    if not any(own[q:] == own[:-q] for q in range(1, p)):
                        found.append([start, len(own), p])
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))
