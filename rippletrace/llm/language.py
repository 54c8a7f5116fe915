"""Language by the nearest of several centroids per language.

Texts are vectors of hashed letter n-grams, weighted by TF-IDF and normalised.
The sample of each language is clustered into a few centroids; a text gets the
language of the centroid with the largest cosine, and is rejected if that one is
further away than nearly all texts it was made from.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippletrace.llm.common import add_columns, fold, materialise

DIMS = 8192
GRAMS = (1, 2, 3)
_CHUNK = 1 << 20
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter; made once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams of letters and gaps; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    # One gap for each run of other characters, one before and one after the text.
    keep = letter | np.concatenate([[False], letter[:-1]])
    x = np.concatenate([[32], np.where(letter, codes, 32)[keep], [32]]).astype("uint64")
    out = np.zeros(DIMS, "int64")
    for at in range(0, len(x), _CHUNK):
        part = x[at : at + _CHUNK + max(GRAMS) - 1]
        h = np.zeros(len(part), "uint64")
        for n in GRAMS:
            m = len(part) - n + 1
            if at + _CHUNK < len(x):
                m = min(m, _CHUNK)
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 : n - 1 + m] + np.uint64(n)
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out += np.bincount((mixed >> np.uint64(51)).astype("int64"), minlength=DIMS)
    return out


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with damped counts, of length 1."""
    v = np.log1p(counts) * idf
    return (v / max(np.linalg.norm(v), 1e-12)).astype("float32")


@dataclass
class Centroids:
    idf: np.ndarray
    langs: list[str]
    vectors: np.ndarray
    least: np.ndarray  # the cosine below which a text is rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = gram_counts(text) if text else None
        if counts is None or not self.langs:
            return "und", 0.0, True
        cos = self.vectors @ unit(counts, self.idf)
        best = int(cos.argmax())
        return self.langs[best], float(min(max(cos[best], 0.0), 1.0)), bool(cos[best] < self.least[best])


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from well-spread rows; centroids and the rows' cosines with theirs."""
    picks = [int((x @ x.mean(axis=0)).argmax())]
    for _ in range(min(k, len(x)) - 1):
        picks.append(int((x @ x[picks].T).max(axis=1).argmin()))
    c = x[picks]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, x @ c.T


def fit_languages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 1500,
    clusters: int = 4,
    reject_share: float = 0.001,
    folds: int = 4,
    held_out: int | None = 2,
    max_languages: int = 1000,
) -> Centroids:
    """Fit centroids on about ``per_language`` rows of each language, picked by a hash of key and text.

    That is the bound of the sample, with ``max_languages``: of more languages
    those with the most rows are learned. Rows that are equal in key and text
    count as one, so that null or repeated keys cannot enlarge it. Rows with
    crc32(key) mod ``folds`` = ``held_out`` and rows without a language are
    never looked at. Each language is clustered in a task of its own, and the
    driver gets ``clusters`` vectors for each. A text's centroid rejects what is less similar to it than all but
    ``reject_share`` of its own rows. Without such rows nothing is learned and
    every text is ``und``.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(lang).cast("string").alias("lang"), text).where(F.col("lang").isNotNull())
    if held_out is not None:
        rows = rows.where(fold("k", folds) != held_out)
    sizes = rows.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "of").limit(max_languages)
    rows = rows.withColumn("h", F.xxhash64(text))
    picked = F.pmod(F.xxhash64("k", "h", F.lit("sample")), F.lit(1 << 30)) < F.lit(float(per_language << 30)) / F.col("n")
    # One row per language, max_languages at most.
    sample = rows.join(F.broadcast(sizes), F.col("lang") == F.col("of")).where(picked).dropDuplicates(["lang", "k", "h"]).select("lang", text)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(a, c) for a, t in zip(pdf["lang"], pdf[text]) if t and (c := gram_counts(t)) is not None]
            at = [np.flatnonzero(c).astype("int32") for _, c in found]
            yield pd.DataFrame({"lang": [a for a, _ in found], "at": at, "n": [c[i].astype("int32") for (_, c), i in zip(found, at)]})

    counted = materialise(sample.mapInPandas(grams, "lang string, at array<int>, n array<int>"), "language-grams")
    total = counted.count()
    seen = counted.select(F.explode("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()
    idf = np.full(DIMS, np.log(1 + total))
    for x in seen:
        idf[x["at"]] = np.log((1 + total) / (1 + x["n"])) + 0.05

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(pdf), DIMS), "float32")
        for i, (at, n) in enumerate(zip(pdf["at"], pdf["n"])):
            dense = np.zeros(DIMS)
            dense[np.asarray(at, "int64")] = n
            x[i] = unit(dense, idf)
        x = x[np.lexsort(x[:, :8].T)]  # the order of rows must not matter
        c, cos = _cluster(x, clusters)
        own = cos.argmax(axis=1)
        least = [float(np.quantile(cos[own == i, i], reject_share)) if (own == i).any() else 2.0 for i in range(len(c))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "vector": [v.astype("float32").tobytes() for v in c], "least": least})

    made = counted.groupBy("lang").applyInPandas(cluster, "lang string, vector binary, least double").collect()
    made = sorted(made, key=lambda r: (r["lang"], bytes(r["vector"])))
    vectors = np.array([np.frombuffer(bytes(r["vector"]), "float32") for r in made]).reshape(-1, DIMS)
    return Centroids(idf, [r["lang"] for r in made], vectors, np.array([r["least"] for r in made]))


def predict_languages(docs: DataFrame, model: Centroids, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add lang_pred, score (the cosine, 0 to 1) and rejected to every row, from its whole text.

    A null text, or one without a letter, is ``und`` with score 0 and rejected.
    A rejected text keeps the language that it is nearest to in lang_pred. Equal
    cosines go to the language first in order. New columns replace columns of
    their names; other columns pass unchanged. Repeated rows are judged alike;
    an empty table gives an empty table. One pass, no shuffle. With ``keep``,
    only those columns of the input are returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()), ("rejected", T.BooleanType(), pa.bool_())]

    def start():
        return lambda texts: list(zip(*map(shared.value.predict, texts)))

    return add_columns(docs, text, start, new, keep)
