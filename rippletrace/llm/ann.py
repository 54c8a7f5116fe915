"""Nearest neighbours with an inverted file and product quantisation.

Vectors are normalised, so that the largest cosine is the largest inner product.
Coarse centroids cut the space into cells. A vector is kept in its cell as codes
of its residual, one per sub-space. A query scans the cells nearest to it with
tables of its inner products with all code words. With the length of what the
codes leave out these bound the true inner products: every row that may be among
the best is ranked again by the cosine of the original vectors in double
precision, so that nothing in the scanned cells is lost. Equal vectors are
indexed once, with the smallest of their keys.

How many cells a query scans is settled by an audit: for a few queries the true
neighbours are found by brute force, and so many cells are scanned that the
wanted share of these lies in them. As cells are searched exactly, this is the
recall of the whole search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.llm.common import materialise

BLOCK_ROWS = 4096
QUERY_BLOCK = 128


def usable(vector: str | Column) -> Column:
    """True for vectors that aren't null, empty or zero and hold only finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int, draws: np.random.Generator) -> np.ndarray:
    """Plain k-means; empty clusters get a random row."""
    c = x[draws.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[draws.integers(0, len(x), len(c))])
    return c.astype("float32")


@dataclass
class IvfPq:
    coarse: np.ndarray  # cells x d
    words: np.ndarray  # parts x 256 x (d / parts)

    @property
    def parts(self) -> int:
        return len(self.words)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((self.coarse**2).sum(axis=1) - 2 * (x @ self.coarse.T)).argmin(axis=1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        r = (x - self.coarse[cell]).reshape(len(x), self.parts, -1)
        out = np.empty((len(x), self.parts), "uint8")
        for j, w in enumerate(self.words):
            out[:, j] = ((w**2).sum(axis=1) - 2 * (r[:, j] @ w.T)).argmin(axis=1)
        return out

    def missed(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The length of what is left of each row after its centroid and code words."""
        r = (x - self.coarse[cell]).reshape(len(x), self.parts, -1)
        return np.sqrt(sum(((r[:, j] - w[codes[:, j]]) ** 2).sum(axis=1, dtype="float64") for j, w in enumerate(self.words)))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and part, the inner products with all code words."""
        return np.einsum("qjd,jwd->qjw", q.reshape(len(q), self.parts, -1), self.words)

    def by_nearness(self, q: np.ndarray) -> np.ndarray:
        """For each query, all cells by how near their centroids are."""
        return ((self.coarse**2).sum(axis=1) - 2 * (q @ self.coarse.T)).argsort(axis=1, kind="stable")


def unit_rows(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows in double precision, and normalised in single precision."""
    x = np.array([np.asarray(v, "float64") for v in vectors])
    return x, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")


def smallest_hashes(vectors: DataFrame, n: int) -> DataFrame:
    """(id, v, h, g): the ``n`` rows with the smallest hashes of their ids (h), and of their vectors (g) where an id has several.

    Hashes alone are ordered, and the last of them picks the rows. Ordering
    whole rows would send ``n`` vectors of each task to where they are merged.
    """
    rows = vectors.select("id", "v", F.xxhash64("id").alias("h"), F.xxhash64("v").alias("g"))
    last = rows.select("h", "g").orderBy("h", "g").limit(n).agg(F.max(F.struct("h", "g")).alias("last")).first()["last"]
    if last is None:
        return rows.limit(0)
    return rows.where((F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("g") <= last["g"])))


def fit_index(vectors: DataFrame, n: int, d: int, sample_rows: int = 16_000, seed: int = 11) -> IvfPq:
    """Fit centroids and code words on a sample of at most ``sample_rows`` vectors.

    ``vectors`` has id and v. The sample holds those with the smallest hash of
    their id. There is about one cell for each 2 * sqrt(n) rows.
    """
    sample = smallest_hashes(vectors, sample_rows).toPandas().sort_values(["h", "id", "g"], ignore_index=True)[:sample_rows]
    _, x = unit_rows(sample["v"])
    draws = np.random.default_rng(seed)
    coarse = kmeans(x, int(np.clip(np.sqrt(n) / 2, 1, 4096)), 12, draws)
    parts = next(p for p in (d // 2, d // 3, d // 4, d // 5, 1) if p and d % p == 0)
    model = IvfPq(coarse, np.zeros((parts, 1, d // parts), "float32"))
    r = (x - coarse[model.cells(x)]).reshape(len(x), parts, -1)
    words = [kmeans(r[:, j], 256, 8, draws) for j in range(parts)]
    model.words = np.stack(words)
    return model


def audit_probes(vectors: DataFrame, queries: DataFrame, model: IvfPq, k: int, goal: float, audits: int = 64) -> int:
    """How many cells to scan so that they hold the share ``goal`` of true neighbours.

    ``audits`` queries, those with the smallest hash of their id, are compared
    with every row by brute force, block by block.
    """
    chosen = queries.orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(audits).toPandas()
    if not len(chosen):
        return 1
    _, q = unit_rows(chosen["v"])
    ids = chosen["id"].to_numpy()
    shared = vectors.sparkSession.sparkContext.broadcast((model, q, ids))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, q, ids = shared.value
        order = model.by_nearness(q).argsort(axis=1)
        for pdf in batches:
            if not len(pdf):
                continue
            _, x = unit_rows(pdf["v"])
            cos = np.where(ids[:, None] == pdf["id"].to_numpy()[None], -9, q @ x.T)
            top = np.argpartition(-cos, min(k, cos.shape[1]) - 1, axis=1)[:, :k]
            cell = model.cells(x)[top]
            rows = np.repeat(np.arange(len(q)), top.shape[1])
            yield pd.DataFrame({"query": rows, "cos": np.take_along_axis(cos, top, 1).ravel(), "place": order[rows, cell.ravel()]})

    found = vectors.mapInPandas(nearest, "query int, cos float, place int").where("cos > -2")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cos"), "place"))).where(F.col("rank") <= k)
    places = [r["place"] for r in best.select("place").collect()]
    return int(np.quantile(places, goal)) + 1 if places else 1


def smallest_keys(rows: DataFrame, most: int) -> DataFrame:
    """(id, v): each different vector with the ``most`` smallest of its ids.

    More are never asked for: ids of one vector have equal cosines, and the
    smaller ones come first. The rows of a common vector are cut before they
    are shuffled for it.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.select("id", "v").distinct().withColumn("rank", rank).where(F.col("rank") <= most).select("id", "v")


def best_of_block(q: np.ndarray, q_id: int, near: np.ndarray, missed: np.ndarray, x: np.ndarray, norm: np.ndarray, ids: np.ndarray, owner: np.ndarray, k: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of the ``k`` nearest of a block to one query, exactly.

    ``near`` are inner products by codes, off by ``missed`` at most. Row
    owner[i] of ``x`` has the key ids[i]; rows of ``x`` are in the order of
    ``owner``. The ``depth`` best by codes set the bar, and all rows that may
    reach it are ranked.
    """
    length = np.linalg.norm(q)

    def ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cos = np.full(len(x), -9.0)
        cos[rows] = np.einsum("nd,d->n", x[rows], q) / (length * norm[rows])
        score = cos[owner]
        score[ids == q_id] = -9
        at = np.flatnonzero(score > -2)
        if len(at) > 4 * k:  # those that tie with the last of the best stay; a key may be there several times
            best = np.sort(score[at])[-4 * k]
            if len(np.unique(ids[at[score[at] >= best]])) >= k:
                at = at[score[at] >= best]
        at = at[np.lexsort((ids[at], -score[at]))]
        _, first = np.unique(ids[at], return_index=True)
        at = at[np.sort(first)[:k]]
        return ids[at], score[at]

    if len(x) <= depth:
        return ranked(np.arange(len(x)))
    rows = np.argpartition(-near, depth - 1)[:depth]
    who, score = ranked(rows)
    if len(who) < k:
        return ranked(np.arange(len(x)))
    may = near + missed >= score[-1]
    may[rows] = False
    return ranked(np.concatenate([rows, np.flatnonzero(may)])) if may.any() else (who, score)


def search_neighbours(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    depth: int = 320,
    goal: float = 0.97,
    sample_rows: int = 16_000,
) -> DataFrame:
    """The ``k`` nearest found of each row that fulfils ``queries``, by cosine.

    Output: query_id, rank (from 1), ``key`` and score, the cosine in double
    precision of the original vectors; nearest first, ties to the smaller key.
    Only where the table has fewer candidates than ``k`` a query gets fewer rows:
    one whose cells hold too few scans further ones.

    Vectors that are null, empty, zero or hold null or non-finite numbers and
    rows without a key take no part. Vectors of different lengths have no
    cosine: each length has an index of its own, and those without a query none.
    Rows with the key of the query aren't its candidates. A key on several rows
    is one candidate, with the largest cosine of these, and one query, with the
    first of its vectors in order (the shortest first). No usable query gives an
    empty result; other columns aren't read.

    The index is fitted on a bounded sample and holds every different vector, in
    blocks of about ``BLOCK_ROWS`` of one cell however large the cell is. Blocks
    of the queries that scan a cell are sent to each of its blocks, so that a
    large cell is spread over tasks; each pair yields the ``k`` best rows a
    query. The ``depth`` best by codes are ranked first, then whatever may be
    better than the last of these.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(usable("v") & F.col("id").isNotNull())
    asked = rows.where("asks").groupBy("id").agg(F.min(F.struct(F.size("v").alias("d"), "v")).alias("q")).select("id", "q.d", "q.v")
    out = vectors.sparkSession.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    # A row for each length that a query has, of which tables have one as a rule.
    for n, of in enumerate(asked.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()):
        found = _search(rows.where(F.size("v") == of["d"]), asked.where(F.col("d") == of["d"]).drop("d"), of["n"], of["d"], k, depth, goal, sample_rows)
        found = found.select("query_id", "rank", F.col("found").alias(key), "score")
        out = out.unionByName(found) if n else found
    return out


def _search(rows: DataFrame, asked: DataFrame, n_asked: int, d: int, k: int, depth: int, goal: float, sample_rows: int) -> DataFrame:
    """(query_id, rank, found, score) of ``n_asked`` queries among rows (id, v) of length ``d``."""
    rows = materialise(smallest_keys(rows, k + 1), "ann-keys")
    model = fit_index(rows, rows.count(), d, sample_rows)
    probes = audit_probes(rows, asked, model, k, goal)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            if len(pdf):
                x, u = unit_rows(pdf["v"])
                cell = model.cells(u)
                codes = model.encode(u, cell)
                missed = model.missed(u, cell, codes)
                yield pd.DataFrame({"id": pdf["id"], "cell": cell.astype("int32"), "codes": [c.tobytes() for c in codes], "missed": missed, "x": [v.tobytes() for v in x]})

    coded = materialise(rows.mapInPandas(code, "id long, cell int, codes binary, missed double, x binary"), "ann-coded")
    sizes = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    # A row per cell, of which there are 4,096 at most. A shuffle by cell would deal whole cells to tasks.
    salted = coded.join(F.broadcast(sizes), "cell").withColumn("salt", F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / BLOCK_ROWS)))
    blocks = np.zeros(len(model.coarse), "int32")
    for r in sizes.collect():  # a row per cell
        blocks[r["cell"]] = -(-r["n"] // BLOCK_ROWS)
    # How many keys each cell adds for certain: a key on several vectors counts in one cell.
    homes = np.zeros(len(model.coarse), "int64")
    for r in coded.groupBy("id").agg(F.min("cell").alias("cell")).groupBy("cell").count().collect():
        homes[r["cell"]] = r["count"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "id"])
        first = ~pdf["x"].duplicated().to_numpy()
        one = pdf[first]
        out = {"ids": pdf["id"].to_numpy("int64"), "owner": first.cumsum() - 1, "missed": one["missed"].to_numpy("float64")}
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "salt": pdf["salt"].iloc[:1], **{n: [v.tobytes()] for n, v in out.items()}, "codes": [b"".join(one["codes"])], "x": [b"".join(one["x"])]})

    packed = "cell int, salt long, ids binary, owner binary, missed binary, codes binary, x binary"
    index = salted.select("id", "cell", "codes", "missed", "x", "salt").groupBy("cell", "salt").applyInPandas(pack, packed)

    def pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, u = unit_rows(pdf["v"])
        near = shared.value.by_nearness(u)
        before = np.cumsum(homes[near], axis=1) - homes[near]
        # As many cells as audited, and on until they hold k keys besides the query's.
        scans = (np.arange(near.shape[1]) < probes) | (before <= k)
        out = [(int(c), blocks[c], pdf["id"].to_numpy("int64")[m].tobytes(), x[m].tobytes()) for c in np.unique(near[scans]) for m in [((near == c) & scans).any(axis=1)]]
        return pd.DataFrame(out, columns=["cell", "blocks", "q_ids", "q_x"])

    block = F.pmod(F.xxhash64("id"), F.lit(-(-n_asked // QUERY_BLOCK)))
    asks = asked.withColumn("block", block).groupBy("block").applyInPandas(pack_queries, "cell int, blocks int, q_ids binary, q_x binary")
    asks = asks.where("blocks > 0").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("salt"), "q_ids", "q_x")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            for ids, owner, missed, codes, x, q_ids, q_x, cell in zip(*(pdf[c] for c in ("ids", "owner", "missed", "codes", "x", "q_ids", "q_x", "cell"))):
                ids, owner, q_ids, missed = np.frombuffer(ids, "int64"), np.frombuffer(owner, "int64"), np.frombuffer(q_ids, "int64"), np.frombuffer(missed, "float64")
                codes = np.frombuffer(codes, "uint8").reshape(len(missed), -1)
                x, q = np.frombuffer(x, "float64").reshape(len(missed), d), np.frombuffer(q_x, "float64").reshape(len(q_ids), d)
                norm = np.linalg.norm(x, axis=1)
                u = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype("float32")
                tables = model.tables(u)
                near = np.repeat((u @ model.coarse[cell])[:, None], len(x), axis=1)
                for j in range(model.parts):
                    near += tables[:, j][:, codes[:, j]]
                off = missed * (1 + 1e-5) + 1e-6 * (d + 1)  # what single precision may add
                best = [best_of_block(q[i], q_ids[i], near[i], off, x, norm, ids, owner, k, depth) for i in range(len(q))]
                yield pd.DataFrame({"query_id": np.repeat(q_ids, [len(w) for w, _ in best]), "found": np.concatenate([w for w, _ in best]), "score": np.concatenate([c for _, c in best])})

    # Blocks of queries are repeated for each cell: by what they come from they look small enough to be sent to all tasks by way of the driver.
    met = index.join(asks.hint("merge"), ["cell", "salt"])
    met = met.mapInPandas(scan, "query_id long, found long, score double").groupBy("query_id", "found").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "found"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "found", "score")
