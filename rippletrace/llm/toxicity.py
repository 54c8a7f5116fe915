"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's words and their first four and five letters, hashed into a
fixed number of buckets. The machine learns a weight for each bucket and a short
vector for each, whose inner products are the weights of pairs. An insult next
to the mention of a group can so weigh more than both do alone.

No term is left out. What keeps the many rare ones from being learned by heart
is the size of their input: it grows with how well a term tells the labels apart
by itself, or, as a term may matter in pairs only, with how often it occurs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippletrace.llm.common import add_columns, fold, materialise

BUCKETS = 1 << 18
PREFIXES = (4, 5)
_WORD = re.compile(r"\w+")


def term_ids(word: str) -> list[int]:
    """Buckets of a lower-case word and of its prefixes, in separate name spaces."""
    terms = [f"w {word}", *(f"{n} {word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms]


class TermTable:
    """The buckets of words seen before, for many texts at once; it is emptied beyond ``most`` words."""

    def __init__(self, most: int = 300_000) -> None:
        self.most, self.place, self.buckets = most, {}, np.zeros((1024, 1 + len(PREFIXES)), "int32")

    def _add(self, word: str) -> int:
        at = self.place[word] = len(self.place)
        if at == len(self.buckets):
            self.buckets = np.concatenate([self.buckets, np.zeros_like(self.buckets)])
        ids = term_ids(word)
        self.buckets[at] = ids + ids[:1] * (1 + len(PREFIXES) - len(ids))
        return at

    def rows(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted different pairs (text, bucket), as two arrays."""
        words, n, place = [], np.zeros(len(texts), "int64"), self.place
        for i, t in enumerate(texts):
            found = set(_WORD.findall(t.lower())) if t else ()
            n[i] = len(found)
            for w in found:
                at = place.get(w)
                words.append(self._add(w) if at is None else at)
        of = np.repeat(np.arange(len(texts)), n * self.buckets.shape[1])
        pairs = np.unique(of * BUCKETS + self.buckets[np.array(words, "int64")].ravel())
        if len(place) > self.most:
            place.clear()
        return pairs // BUCKETS, (pairs % BUCKETS).astype("int32")


@dataclass
class FactorizationMachine:
    """``theta`` has a row for each bucket: its weight, then its vector, both times the size of the bucket's input."""

    bias: float
    theta: np.ndarray

    def scores(self, n: int, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Probability of label 1 for ``n`` rows, given the sorted pairs (row, bucket) of what they hold."""
        z = np.full(n, self.bias)
        if len(row):
            full, at = np.unique(row, return_index=True)
            v = self.theta[bucket].astype("float64")
            s, squares = np.add.reduceat(v, at, axis=0), np.add.reduceat(v[:, 1:] ** 2, at, axis=0)
            z[full] += s[:, 0] + (s[:, 1:] ** 2 - squares).sum(axis=1) / 2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def input_sizes(rows: list[np.ndarray], labels: np.ndarray, chi_half: float = 50.0, common: float = 500.0, most_common: float = 0.15) -> np.ndarray:
    """The size of each bucket's input, 0 to 1.

    It is (chi / (chi + ``chi_half``)) ** 1.5, chi being the chi square of the
    table bucket x label, and at least ``most_common`` for what is in
    ``common`` rows or more, in proportion for what is rarer.
    """
    n, bad = len(rows), float(labels.sum())
    count = lambda part: np.bincount(np.concatenate([np.zeros(0, "int32"), *part]), minlength=BUCKETS).astype("float64")
    seen, a = count(rows), count([r for r, y in zip(rows, labels) if y])
    chi = n * (a * (n - bad) - (seen - a) * bad) ** 2 / (seen * (n - seen) * bad * (n - bad) + 1.0)
    return np.maximum((chi / (chi + chi_half)) ** 1.5, most_common * np.minimum(1.0, seen / common))


class Batch:
    """Rows of a training step: entry i says that row ``row``[i] (sorted) holds the input used[inv[i]] with ``size``[i]."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, sizes: np.ndarray) -> None:
        flat, n = np.concatenate(rows), [len(r) for r in rows]
        self.used, inv = np.unique(flat, return_inverse=True)
        self.inv, self.size, self.labels = inv.astype("int32"), sizes[flat].astype("float32"), labels
        self.row, self.at = np.repeat(np.arange(len(rows), dtype="int32"), n), np.concatenate([[0], np.cumsum(n)[:-1]])
        self.order = np.argsort(inv, kind="stable").astype("int32")
        self.starts = np.searchsorted(inv[self.order], np.arange(len(self.used)))

    def logits(self, theta: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row its logit and the sums of its inputs' vectors; each entry's vector. ``theta`` is that of ``used``."""
        x = theta[self.inv] * self.size[:, None]
        s = np.add.reduceat(x, self.at, axis=0)
        pairs = (s[:, 1:] ** 2 - np.add.reduceat(x[:, 1:] ** 2, self.at, axis=0)).sum(axis=1) / 2
        return bias + s[:, 0] + pairs, s, x

    def gradient(self, theta: np.ndarray, bias: float, decay: float) -> tuple[np.ndarray, float]:
        """Of the mean log loss plus ``decay`` / 2 times the squares of ``theta``, for theta and bias."""
        z, s, x = self.logits(theta, bias)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.labels) / len(self.labels)
        each = s[self.row] - x
        each[:, 0] = 1
        each *= (g[self.row] * self.size)[:, None]
        return np.add.reduceat(each[self.order], self.starts, axis=0) + decay * theta, float(g.sum())


def train(
    rows: list[np.ndarray], labels: np.ndarray, rank: int = 6, visits: int = 60_000, batch: int = 256, rate: float = 0.3, decay: float = 1e-4, seed: int = 5
) -> FactorizationMachine:
    """Fit by Adagrad on the log loss; ``rows`` hold buckets, each once.

    There are 20 epochs, fewer for more than ``visits`` / 20 rows, but 6 at least.
    """
    draws, n = np.random.default_rng(seed), len(rows)
    share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    bias, theta = float(np.log(share / (1 - share))), np.zeros((BUCKETS, 1 + rank), "float32")
    if not 0 < labels.sum() < n:
        return FactorizationMachine(bias, theta.astype("float32"))
    sizes = input_sizes(rows, labels)
    theta[:, 1:] = draws.normal(0, 0.05, (BUCKETS, rank))
    squares, bias_squares = np.full(theta.shape, 1e-8, "float32"), 1e-8
    order, parts = draws.permutation(n), []
    for i in range(0, n, batch):
        part = [j for j in order[i : i + batch] if len(rows[j])]
        if part:
            parts.append(Batch([rows[j] for j in part], labels[part], sizes))
    for _ in range(int(np.clip(visits // n, 6, 20))):
        for i in draws.permutation(len(parts)):
            used = parts[i].used
            g, g_bias = parts[i].gradient(theta[used], bias, decay)
            squares[used] += g**2
            theta[used] -= rate * g / np.sqrt(squares[used])
            bias_squares += g_bias**2
            bias -= rate * g_bias / np.sqrt(bias_squares)
    return FactorizationMachine(bias, (theta * sizes[:, None]).astype("float32"))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = 12_000,
    max_entries: int = 6_000_000,
    folds: int = 3,
    held_out: int | None = 1,
) -> FactorizationMachine:
    """Fit a machine on ``labels`` (``key``, ``label``) of ``docs``.

    Rows with crc32(key) mod ``folds`` = ``held_out`` are never looked at. At
    most ``max_rows`` labelled rows are used, those with the smallest hash of
    their key, and of these as many as hold ``max_entries`` different terms of a
    text together: that is the bound of the sample, and of what the driver gets.
    Their texts are read whole, and no term is left out.

    Null labels and keys are ignored. If a key has several labels the largest
    counts; if it has several documents each different text is a row, and equal
    rows count as often as they are there. Without labels, or with labels of one
    kind, scores are that kind's share for every text.
    """
    known = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).dropna()
    if held_out is not None:
        known = known.where(fold("k", folds) != held_out)
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    # A sample of max_rows pairs of numbers: its size is known.
    sample = F.broadcast(known.orderBy(F.xxhash64("k"), "k").limit(max_rows))
    chosen = docs.select(F.col(key).cast("long").alias("k"), text).join(sample, "k")

    def terms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = TermTable()
        for pdf in batches:
            row, bucket = table.rows(pdf[text].tolist())
            terms = np.split(bucket, np.searchsorted(row, np.arange(1, len(pdf))))
            yield pd.DataFrame({"k": pdf["k"], "y": pdf["y"], "n": [len(t) for t in terms], "terms": [t.tobytes() for t in terms]})

    rows = chosen.select("k", "y", text).mapInPandas(terms_of, "k long, y int, n long, terms binary")
    rows = materialise(rows.withColumns({"h": F.xxhash64("k"), "tie": F.xxhash64("terms")}), "toxicity-terms")
    # Keys may repeat in the documents, so that rows are bounded once more.
    order = ["h", "k", "tie", "y"]
    sizes = rows.select(*order, "n").orderBy(*order).limit(max_rows).toPandas()
    taken = int((sizes["n"].cumsum() <= max_entries).sum())
    data = rows.orderBy(*order).limit(taken).select("y", "terms").toPandas() if taken else pd.DataFrame({"y": [], "terms": []})
    return train([np.frombuffer(t, "int32") for t in data["terms"]], data["y"].to_numpy("float64"))


def score_toxicity(
    docs: DataFrame, model: FactorizationMachine, text: str = "text", into: str = "toxicity", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add the score (0 to 1) of every whole text as column ``into``.

    A null or empty text has no terms and gets the score of the bias alone. The
    new column replaces one of that name; other columns pass unchanged, whatever
    they hold. Repeated rows and texts with the same terms score alike; an empty
    table gives an empty table. The model, of fixed size, is a broadcast
    variable; a task holds one batch and a bounded table of words. With
    ``keep``, only those columns of the input are returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model, table = shared.value, TermTable()
        return lambda texts: [model.scores(len(texts), *table.rows(texts)).tolist()]

    return add_columns(docs, text, start, [(into, T.DoubleType(), pa.float64())], keep)
