"""Language of documents by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word forwards and backwards, starting afresh at every word,
and labels each position with a distribution over languages. A document pools the
positions of all its letters. As words are read on their own, equal words are read once.
Training is backpropagation through time in numpy, every position carrying its document's
language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.llm.shared import held_out, store

UNKNOWN = "und"
#: A longer word is read in pieces of so many bytes.
PIECE = 32
#: Characters handled at once, and words remembered between such groups.
GROUP = 1 << 20
MEMORY = 1 << 18

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Direction:
    """A gated recurrent layer; bytes enter by row of ``inputs``: update, reset, candidate."""

    inputs: np.ndarray
    inner: np.ndarray

    @classmethod
    def fresh(cls, hidden: int, rng: np.random.Generator) -> Direction:
        return cls(
            rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
            rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32),
        )

    def step(self, h: np.ndarray, letters: np.ndarray) -> tuple:
        n = h.shape[1]
        x, u = self.inputs[letters], h @ self.inner
        gates = _sigmoid(x[:, : 2 * n] + u[:, : 2 * n])
        update, reset = gates[:, :n], gates[:, n:]
        candidate = np.tanh(x[:, 2 * n :] + reset * u[:, 2 * n :])
        return candidate + update * (h - candidate), update, reset, candidate, u[:, 2 * n :]

    def read(self, words: np.ndarray) -> np.ndarray:
        """States after each byte of words of one length: (length, words, hidden)."""
        hidden = self.inner.shape[0]
        h = np.zeros((len(words), hidden), dtype=np.float32)
        out = np.empty((words.shape[1], len(words), hidden), dtype=np.float32)
        for t in range(words.shape[1]):
            h = self.step(h, words[:, t])[0]
            out[t] = h
        return out

    def learn(self, words: np.ndarray, d_states: callable):
        """Forward, then backpropagation through time with the gradients ``d_states`` gives for all
        states; yields (d_inputs, d_inner)."""
        hidden = self.inner.shape[0]
        length = words.shape[1]
        h = np.zeros((len(words), hidden), dtype=np.float32)
        states, kept = [], []
        for t in range(length):
            before = h
            h, update, reset, candidate, u = self.step(h, words[:, t])
            states.append(h)
            kept.append((before, update, reset, candidate, u))
        d_out = yield np.stack(states)
        d_inputs, d_inner = np.zeros_like(self.inputs), np.zeros_like(self.inner)
        carry = np.zeros_like(h)
        for t in range(length - 1, -1, -1):
            before, update, reset, candidate, u = kept[t]
            d_h = d_out[t] + carry
            d_candidate = d_h * (1 - update) * (1 - candidate**2)
            d_update = d_h * (before - candidate) * update * (1 - update)
            d_reset = d_candidate * u * reset * (1 - reset)
            d_x = np.concatenate([d_update, d_reset, d_candidate], axis=1)
            d_u = np.concatenate([d_update, d_reset, d_candidate * reset], axis=1)
            np.add.at(d_inputs, words[:, t], d_x)
            d_inner += before.T @ d_u
            carry = d_h * update + d_u @ self.inner.T
        yield d_inputs, d_inner


@dataclass
class Network:
    forward: Direction
    backward: Direction
    out: np.ndarray
    bias: np.ndarray
    languages: list[str]

    def positions(self, words: np.ndarray) -> np.ndarray:
        """(length, words, languages): the distribution at each position."""
        both = np.concatenate([self.forward.read(words), self.backward.read(words[:, ::-1])[::-1]], axis=2)
        z = both @ self.out + self.bias
        z = np.exp(z - z.max(axis=2, keepdims=True))
        return z / z.sum(axis=2, keepdims=True)

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """(words, languages + 1): each word's distributions summed over its letters, and their
        number."""
        out = np.zeros((len(words), len(self.languages) + 1), dtype=np.float32)
        pieces = [(i, w[at : at + PIECE]) for i, w in enumerate(words) for at in range(0, len(w), PIECE)]
        lengths = np.array([len(p) for _, p in pieces])
        owners = np.array([i for i, _ in pieces])
        for length in np.unique(lengths):
            chosen = np.flatnonzero(lengths == length)
            for lo in range(0, len(chosen), 1 << 14):
                part = chosen[lo : lo + (1 << 14)]
                table = np.frombuffer(b"".join(pieces[i][1] for i in part), dtype=np.uint8).reshape(-1, length)
                mask = _LETTER[table]
                sums = np.einsum("twl,wt->wl", self.positions(table), mask.astype(np.float32))
                found = np.concatenate([sums, mask.sum(axis=1, keepdims=True)], axis=1)
                if length < PIECE:
                    # The last or only piece of its word.
                    out[owners[part]] += found
                else:
                    np.add.at(out, owners[part], found)
        return out


def train(
    texts: list[str], languages: list[str], hidden: int = 12, steps: int = 700, batch: int = 512, rate: float = 0.01, seed: int = 1
) -> Network:
    """Fit by Adam on words drawn evenly from the languages; a batch holds words of one length."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    place = {name: i for i, name in enumerate(names)}
    words = [[] for _ in names]
    for text, name in zip(texts, languages):
        for w in text.lower().encode("utf-8", "replace").split():
            words[place[name]] += [w[at : at + PIECE] for at in range(0, len(w), PIECE)]
    drawn = [own[i] for own in words if own for i in rng.integers(len(own), size=batch * steps // max(1, len(names)) // 4)]
    truth = np.concatenate([np.full(batch * steps // max(1, len(names)) // 4, i) for i, own in enumerate(words) if own] or [np.zeros(0, int)])
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(drawn):
        by_length.setdefault(len(w), []).append(i)
    net = Network(
        Direction.fresh(hidden, rng),
        Direction.fresh(hidden, rng),
        np.zeros((2 * hidden, len(names)), dtype=np.float32),
        np.zeros(len(names), dtype=np.float32),
        names,
    )
    if len(names) < 2:
        return net
    weights = [net.forward.inputs, net.forward.inner, net.backward.inputs, net.backward.inner, net.out, net.bias]
    means, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    lengths = sorted(by_length)
    chances = np.array([len(by_length[n]) * n for n in lengths], dtype=float)
    for step in range(1, steps + 1):
        length = lengths[rng.choice(len(lengths), p=chances / chances.sum())]
        pool = by_length[length]
        picked = [pool[i] for i in rng.integers(len(pool), size=min(batch, len(pool)))]
        table = np.frombuffer(b"".join(drawn[i] for i in picked), dtype=np.uint8).reshape(-1, length)
        labels = truth[picked]
        mask = _LETTER[table].T[:, :, None].astype(np.float32)
        run_f, run_b = net.forward.learn(table, None), net.backward.learn(table[:, ::-1], None)
        both = np.concatenate([next(run_f), next(run_b)[::-1]], axis=2)
        z = both @ net.out + net.bias
        z = np.exp(z - z.max(axis=2, keepdims=True))
        error = z / z.sum(axis=2, keepdims=True)
        error[:, np.arange(len(labels)), labels] -= 1
        error *= mask / max(1.0, float(mask.sum()))
        d_both = error @ net.out.T
        d_forward = run_f.send(d_both[:, :, :hidden])
        d_backward = run_b.send(d_both[::-1, :, hidden:])
        gradients = [
            *d_forward,
            *d_backward,
            np.tensordot(both, error, axes=([0, 1], [0, 1])),
            error.sum(axis=(0, 1)),
        ]
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, s in zip(weights, gradients, means, squares):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


class Reader:
    """Predicts texts one group after the other and remembers the words it has read."""

    def __init__(self, net: Network):
        self.net = net
        self.known: dict[bytes, int] = {}
        self.pooled = np.zeros((0, len(net.languages) + 1), dtype=np.float32)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        """The row of each word; words not yet known are read."""
        if len(self.known) > MEMORY:
            self.known, self.pooled = {}, self.pooled[:0]
        fresh = list(set(words).difference(self.known))
        if fresh:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self.pooled = np.concatenate([self.pooled, self.net.pooled(fresh)])
        return np.array(list(map(self.known.__getitem__, words)))

    def sums(self, texts: list[str]) -> np.ndarray:
        """Per text the distributions summed over its letters, and their number."""
        out = np.zeros((len(texts), len(self.net.languages) + 1))
        group, size = [], 0
        for i, text in enumerate(texts):
            for at in range(0, max(1, len(text)), GROUP):
                group.append((i, text[at : at + GROUP]))
                size += len(group[-1][1])
                if size >= GROUP:
                    self._flush(group, out)
                    group, size = [], 0
        self._flush(group, out)
        return out

    def _flush(self, group: list[tuple[int, str]], out: np.ndarray) -> None:
        words, owners, starts = [], [], []
        for i, text in group:
            own = text.lower().encode("utf-8", "replace").split()
            if own:
                owners.append(i)
                starts.append(len(words))
                words += own
        if words:
            # A long text is in several groups, but once in each.
            rows = self._rows(words)
            out[owners] += np.add.reduceat(self.pooled[rows], starts, axis=0)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        plain = [t or "" for t in texts]
        if not self.net.languages:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(plain), "score": [0.0] * len(plain)})
        sums = self.sums(plain)
        letters = sums[:, -1]
        means = sums[:, :-1] / np.maximum(letters, 1)[:, None]
        best = means.argmax(axis=1)
        some = np.array([letters[i] > 0 and any(map(str.isalpha, t)) for i, t in enumerate(plain)], dtype=bool)
        names = np.array([*self.net.languages, UNKNOWN], dtype=object)
        return pd.DataFrame(
            {
                "lang_pred": names[np.where(some, best, -1)],
                "score": np.where(some, means[np.arange(len(plain)), best], 0.0),
            }
        )


def fit(
    docs: DataFrame,
    per_language: int = 300,
    longest: int = 4000,
    most_languages: int = 200,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    **options,
) -> Network:
    """Train on a bounded sample: of each of the ``most_languages`` languages with the most ids (others are
    not learnt; it bounds the sample) the ``per_language`` documents with the lowest hash of their id, of at most ``longest`` characters.
    Held-out documents, null ids and null languages are not learnt."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    fitting = rows.where(F.length("text") <= longest)
    # Both lists are bounded by the parameters.
    names = store(
        fitting.select("lang", "id").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages),
        "languages",
    )
    ids = fitting.select("lang", F.xxhash64("id").alias("order"), "id").join(F.broadcast(names), "lang")
    # Of the hashes of distinct ids, spread evenly, a few times as many as are needed are compared.
    low = F.col("order") / float(1 << 64) + 0.5 <= 8.0 * (per_language + 8) / F.col("count")
    first = Window.partitionBy("lang").orderBy("order", "id")
    ids = ids.where(low).withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language)
    chosen = store(ids.select("lang", "id", "order").distinct(), "sample")
    found = fitting.join(F.broadcast(chosen), ["lang", "id"]).orderBy("order", "id", "lang", "text")
    picked = sorted({(r["id"], r["lang"], r["text"]) for r in found.limit(per_language * most_languages).collect()})
    return train([r[2] for r in picked], [r[1] for r in picked], **options)


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id column, held_out, lang_pred, score) of every document; the score is the mean probability
    of the language over the text's letters.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if no language could be
    learnt. Repeated rows and null ids stay (a null id is not held out); other columns are not
    read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(net)
        for texts in batches:
            yield reader.predict(texts.tolist())

    label = F.pandas_udf(_typed(run), "lang_pred string, score double")
    return docs.select(
        F.col(id_col), held_out(F.col(id_col)).alias("held_out"), label(F.col(text).cast("string")).alias("found")
    ).select(id_col, "held_out", "found.lang_pred", "found.score")


def _typed(run):
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return run
