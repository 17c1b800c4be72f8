"""Toxicity scores from bags of subword embeddings.

A text is cut into windows of a few words. A window's character n-grams, within words and
with their edges, are hashed to buckets; the buckets' vectors are averaged and go into a linear
softmax. Vectors and softmax are trained together by Adagrad in numpy. A document scores as
its most toxic window, in training as in use: the loss of a document is that of its top window. A
misspelling that was never seen shares most n-grams with the word it comes from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajmill.llm.shared import held_out, store

#: Bytes handled at once; a longer text is read in parts that end between windows.
PART = 1 << 19


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 18
    width: int = 8
    grams: tuple[int, ...] = (3, 4, 5, 6)
    window: int = 12
    least_docs: int = 3


def _space_table() -> np.ndarray:
    """Letters, digits and bytes outside ASCII stay; all else becomes a space."""
    table = np.full(256, 32, dtype=np.uint8)
    for lo, hi in ((48, 58), (97, 123), (128, 256)):
        table[lo:hi] = np.arange(lo, hi)
    return table


def features(texts: list[str | None], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket ids, window of each id, document of each window).

    Every text has at least one window; one without words has an empty window.
    """
    table = _space_table()
    joined = b"\n".join(b" " + (t or "").lower().encode("utf-8", "replace").replace(b"\n", b" ") + b" " for t in texts)
    raw = np.frombuffer(joined, dtype=np.uint8)
    breaks = raw == 10
    data = table[raw]
    space = data == 32
    doc = np.cumsum(breaks, dtype=np.int32)
    word_start = np.empty(len(data), dtype=bool)
    word_start[0] = False
    word_start[1:] = ~space[1:] & space[:-1]
    words = np.cumsum(word_start, dtype=np.int64)
    ends = np.flatnonzero(np.append(breaks, True))
    before = np.concatenate([[0], words[ends[:-1]]]) if len(ends) > 1 else np.zeros(1, dtype=np.int64)
    in_doc = words - before[doc]
    doc_windows = np.maximum(1, -(-(np.append(words, words[-1:])[ends] - before) // shape.window))
    first_window = np.concatenate([[0], np.cumsum(doc_windows)[:-1]])
    window_doc = np.repeat(np.arange(len(texts)), doc_windows)
    gaps = np.concatenate([[0], np.cumsum(space, dtype=np.int32)])
    wide = data.astype(np.uint32)
    all_ids, all_windows = [], []
    for n in shape.grams:
        if len(data) < n:
            continue
        count = len(data) - n + 1
        # Inside a gram there is no space, at its edges there may be one.
        clean = gaps[n - 1 : n - 1 + count] - gaps[1 : 1 + count] == 0
        clean &= ~(space[:count] & space[n - 1 :])
        at = np.flatnonzero(clean)
        code = np.full(len(at), n, dtype=np.uint32)
        for k in range(n):
            code = (code ^ wide[at + k]) * np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
        # The place of the gram's second byte, which is in its word.
        word = in_doc[at + 1] - 1
        all_ids.append((code % np.uint32(shape.buckets)).astype(np.int32))
        all_windows.append(first_window[doc[at]] + word // shape.window)
    if not all_ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), window_doc
    return np.concatenate(all_ids), np.concatenate(all_windows), window_doc


@dataclass
class Model:
    """``pull`` of a bucket: its vector times the difference of the two softmax rows."""

    shape: Shape
    pull: np.ndarray
    bias: float

    def window_logits(self, ids: np.ndarray, windows: np.ndarray, count: int) -> np.ndarray:
        total = np.bincount(windows, weights=self.pull[ids], minlength=count)
        grams = np.bincount(windows, minlength=count)
        return total / np.maximum(grams, 1) + self.bias

    def logits(self, texts: list[str | None]) -> np.ndarray:
        ids, windows, window_doc = features(texts, self.shape)
        logits = self.window_logits(ids, windows, len(window_doc))
        starts = np.searchsorted(window_doc, np.arange(len(texts)))
        return np.maximum.reduceat(logits, starts) if len(texts) else np.zeros(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of class 1 of each whole text; long texts are read in parts, of
        which the highest counts."""
        out = np.full(len(texts), -np.inf)
        group, size = [], 0
        parts = ((i, part) for i, text in enumerate(texts) for part in _parts(text or "", self.shape))
        for i, part in parts:
            group.append((i, part))
            size += len(part)
            if size >= PART:
                np.maximum.at(out, [g[0] for g in group], self.logits([g[1] for g in group]))
                group, size = [], 0
        if group:
            np.maximum.at(out, [g[0] for g in group], self.logits([g[1] for g in group]))
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def _parts(text: str, shape: Shape):
    """The text in pieces of about PART characters that end with a window, so that the windows are those of
    the whole text. A window of more than PART characters, one endless word mostly, is cut into several."""
    if len(text) <= PART:
        yield text
        return
    word = r"A-Za-z0-9\x80-\U0010ffff"
    start = end = 0
    cuts = []
    # What is matched is never given back: else the last words would be cut to make up a window.
    for found in re.finditer(rf"(?:[^{word}]*+[{word}]++){{{shape.window}}}", text):
        if found.end() - start > PART and end > start:
            cuts.append((start, end))
            start = end
        end = found.end()
        if end - start > PART:
            cuts += [(at, min(at + PART, end)) for at in range(start, end, PART)]
            start = end
    if len(text) - start > PART and end > start:
        cuts.append((start, end))
        start = end
    cuts += [(at, min(at + PART, len(text))) for at in range(start, len(text), PART)]
    # A piece without a word is no window, unless the whole text has none.
    with_words = [c for c in cuts if re.compile(f"[{word}]").search(text, *c)]
    for lo, hi in with_words or [(0, 0)]:
        yield text[lo:hi]


def _training_bags(
    texts: list[str], labels: np.ndarray, shape: Shape
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket ids by window, where each window starts, document of each window, number of documents
    of each class that hold a bucket), made in groups of documents to bound the memory."""
    all_ids, all_sizes, all_docs = [], [], []
    holders = np.zeros((2, shape.buckets))
    for lo in range(0, len(texts), 128):
        ids, windows, window_doc = features(texts[lo : lo + 128], shape)
        all_ids.append(ids[np.argsort(windows, kind="stable")])
        all_sizes.append(np.bincount(windows, minlength=len(window_doc)))
        all_docs.append(window_doc + lo)
        pairs = np.unique(ids.astype(np.int64) * 128 + window_doc[windows])
        truth = labels[lo + pairs % 128]
        for value in (0, 1):
            holders[value] += np.bincount(pairs[truth == value] // 128, minlength=shape.buckets)
    starts = np.concatenate([[0], np.cumsum(np.concatenate(all_sizes))])
    return np.concatenate(all_ids), starts, np.concatenate(all_docs), holders


def _bag_means(pull: np.ndarray, ids: np.ndarray, starts: np.ndarray, at_once: int = 1 << 13) -> np.ndarray:
    out = np.zeros(len(starts) - 1)
    for lo in range(0, len(out), at_once):
        edge = starts[lo : lo + at_once + 1]
        sums = np.concatenate([[0.0], np.cumsum(pull[ids[edge[0] : edge[-1]]], dtype=np.float64)])
        sizes = edge[1:] - edge[:-1]
        out[lo : lo + at_once] = (sums[edge[1:] - edge[0]] - sums[edge[:-1] - edge[0]]) / np.maximum(sizes, 1)
    return out


def train(
    texts: list[str], labels: np.ndarray, shape: Shape, epochs: int = 60, rate: float = 0.3, head_start: float = 5.0, seed: int = 1
) -> Model:
    """Fit vectors and softmax together. In an epoch each document is stood for by the window that
    was its top one when the epoch began and, in the first half of them, by a random one too;
    both classes weigh the same."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (shape.buckets, shape.width)).astype(np.float32) / shape.width
    soft = np.zeros((shape.width, 2), dtype=np.float32)
    soft[:, 1] = rng.normal(0, 0.5, shape.width)
    soft[:, 0] = -soft[:, 1]
    bias = np.zeros(2, dtype=np.float32)
    seen_v, seen_s, seen_b = np.full(shape.buckets, 1e-6), np.full_like(soft, 1e-6), np.full(2, 1e-6)
    labels = labels.astype(np.int64)
    ids, starts, window_doc, (clean, toxic) = _training_bags(texts, labels, shape)
    # Buckets that few documents hold keep a zero vector, as buckets never seen do.
    known = clean + toxic >= shape.least_docs
    doc_starts = np.searchsorted(window_doc, np.arange(len(texts) + 1))
    share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    # Vectors start along the softmax by the log odds of the classes among a bucket's holders.
    odds = np.log((toxic + 0.5) / (labels.sum() + 1)) - np.log((clean + 0.5) / ((1 - labels).sum() + 1))
    along = soft[:, 1] - soft[:, 0]
    vectors += np.outer(head_start * odds, along / (along @ along)).astype(np.float32)
    vectors[~known] = 0

    def model() -> Model:
        return Model(shape, (vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))

    for epoch in range(epochs):
        logits = _bag_means(model().pull, ids, starts)
        picks = np.lexsort((logits, window_doc))[doc_starts[1:] - 1]
        owners = np.arange(len(texts))
        if epoch < epochs // 2:
            spans = doc_starts[1:] - doc_starts[:-1]
            random = doc_starts[:-1] + (rng.random(len(texts)) * spans).astype(np.int64)
            picks, owners = np.concatenate([picks, random]), np.concatenate([owners, owners])
        order = rng.permutation(len(picks))
        for lo in range(0, len(order), 256):
            chosen, docs = picks[order[lo : lo + 256]], owners[order[lo : lo + 256]]
            sizes = starts[chosen + 1] - starts[chosen]
            owner = np.repeat(np.arange(len(chosen)), sizes)
            inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            grams = ids[starts[chosen][owner] + inside]
            touched, local = np.unique(grams, return_inverse=True)
            # How often each window has each bucket: the bags are one matrix product.
            cells, times = np.unique(owner * len(touched) + local, return_counts=True)
            row, col = cells // max(1, len(touched)), cells % max(1, len(touched))
            part = (times / np.maximum(sizes, 1)[row]).astype(np.float32)
            table = vectors[touched]
            bags = np.stack(
                [np.bincount(row, part * table[col, d], len(chosen)) for d in range(shape.width)], axis=1
            )
            z = bags @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - np.eye(2)[labels[docs]]) * share[docs, None] / len(chosen)
            d_soft, d_bias, d_bags = bags.T @ error, error.sum(axis=0), error @ soft.T
            d_vectors = np.stack(
                [np.bincount(col, part * d_bags[row, d], len(touched)) for d in range(shape.width)], axis=1
            )
            seen_v[touched] += (d_vectors**2).mean(axis=1)
            step = rate * d_vectors / np.sqrt(seen_v[touched])[:, None]
            vectors[touched] -= (known[touched, None] * step).astype(np.float32)
            seen_s += d_soft**2
            soft -= (0.1 * rate * d_soft / np.sqrt(seen_s)).astype(np.float32)
            seen_b += d_bias**2
            bias -= (0.1 * rate * d_bias / np.sqrt(seen_b)).astype(np.float32)
    return model()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    most: tuple[int, int] = (3000, 1500),
    longest: int = 4000,
    shape: Shape = Shape(),
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Model | None:
    """Train on a bounded sample; None if a class has no document.

    ``most`` documents of class 0 and 1, those with the lowest hash of their id, and ``longest``
    characters a document are the most that come to the driver. Held-out documents, null
    ids, and ids whose labels are null or differ are not learnt.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("top"), F.count(F.lit(1)).alias("n"), F.count("label").alias("k"))
        .where("label = top AND n = k AND label IN (0, 1) AND id IS NOT NULL")
        .where(~held_out(F.col("id")))
        .select("id", "label", F.xxhash64("id").alias("order"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    fitting = texts.where(F.length("text") <= longest)
    joined = store(fitting.select("id").distinct().join(known, "id"), "labels")
    picks = [
        joined.where(F.col("label") == value).orderBy("order", "id").limit(most[value]) for value in (0, 1)
    ]
    ids = store(picks[0].unionByName(picks[1]), "sample")
    # The ids are bounded by ``most``; repeated rows of an id count once and stay within it.
    rows = fitting.join(F.broadcast(ids), "id").orderBy("order", "id", "text").limit(2 * sum(most))
    rows = sorted({(r["id"], r["text"], r["label"]) for r in rows.collect()})
    truth = np.array([r[2] for r in rows], dtype=np.int64)
    if len(set(truth.tolist())) < 2:
        return None
    return train([r[1] for r in rows], truth, shape)


def score_column(model: Model | None, text: Column) -> Column:
    """Probability of toxicity of a whole text; 0 if nothing could be learnt."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return score(text.cast("string"))


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id column, held_out, score) of every document. Null and empty texts score as a window
    without words; repeated rows and null ids stay (a null id is not held out); other columns
    are not read; an empty table gives an empty result."""
    return docs.select(
        F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score_column(model, F.col(text)).alias("score")
    )


def keep_clean(docs: DataFrame, model: Model | None, limit: float = 0.7, text: str = "text") -> DataFrame:
    """The documents, all columns, that score below the limit."""
    return docs.where(score_column(model, F.col(text)) < limit)
