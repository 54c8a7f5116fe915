"""Hard negatives of anchors, found by bounds along a spanning tree of anchors.

Scores are inner products of whole numbers. The anchors of a block are joined by
a minimum spanning tree. A candidate's score at an anchor lies no further from
its score at the parent than the length of the edge times the length of the
candidate, so that a score, or a bound of it, at the parent bounds that at the
child. Only candidates whose bounds overlap what is looked for are scored again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.llm.common import materialise
from rippletrace.llm.lloyd import narrow, products, whole_vector, wide

#: Rows of a block of candidates, and of a block of anchors.
BLOCK_ROWS = 16_384
ANCHOR_BLOCK = 128
_FAR = np.int64(2**62)


def root_up(squares: np.ndarray) -> np.ndarray:
    """Square roots in whole numbers, rounded up."""
    r = np.maximum(np.floor(np.sqrt(squares.astype("float64"))).astype("int64") - 1, 0)
    for _ in range(3):
        r += r * r < squares
    return r


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree of the rows: their order, parents first, and for each place the parent's place (-1 for the root) and the edge's length, rounded up."""
    squares = (x**2).sum(axis=1)
    apart = squares[:, None] + squares[None] - 2 * products(x, x.T)
    order, parent, edge = [0], [-1], [0]
    near, via, out = apart[0].copy(), np.zeros(len(x), "int64"), np.ones(len(x), bool)
    out[0] = False
    for _ in range(1, len(x)):
        at = np.where(out, near, np.iinfo("int64").max).argmin()
        order.append(int(at))
        parent.append(int(via[at]))
        edge.append(int(near[at]))
        out[at] = False
        closer = apart[at] < near
        via[closer], near[closer] = len(order) - 1, apart[at][closer]
    return np.array(order), np.array(parent), root_up(np.array(edge, "int64"))


def scores_along_tree(
    anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, x: np.ndarray, norm: np.ndarray, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor, parents first, the rows of ``x`` that may be wanted and their exact scores.

    ``wanted`` gets the anchor's place and for each row the lowest and highest
    score that it may have there, and tells which rows are to be scored. The root
    has no bounds and is scored with all rows.
    """
    low, high = np.empty((len(anchors), len(x)), "int64"), np.empty((len(anchors), len(x)), "int64")
    for i in range(len(anchors)):
        if parent[i] < 0:
            rows = np.arange(len(x))
        else:
            off = edge[i] * norm
            # No score passes 2^58, so the limits only keep sums of many edges within 64 bits.
            low[i] = np.maximum(low[parent[i]] - off, -_FAR)
            high[i] = np.minimum(high[parent[i]] + off, _FAR)
            rows = np.flatnonzero(wanted(i, low[i], high[i]))
        exact = products(x if len(rows) == len(x) else x[rows], anchors[i][:, None])[:, 0]
        low[i, rows] = high[i, rows] = exact
        yield i, rows, exact


def nth_largest(values: np.ndarray, n: int) -> int:
    """The ``n``-th largest value, or less than any score if there aren't so many."""
    return int(np.partition(values, len(values) - n)[len(values) - n]) if len(values) >= n else -int(_FAR)


def first_of(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties by smaller id."""
    if len(score) > most:
        keep = np.flatnonzero(score >= nth_largest(score, most))
        return keep[np.lexsort((ids[keep], -score[keep]))][:most]
    return np.lexsort((ids, -score))


def windows_of(scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """For each positive's score p the least and greatest s with low * p <= 100 * s <= high * p."""
    return [(-(-low * p // 100), high * p // 100) for p in scores]


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
) -> DataFrame:
    """For each row that fulfils ``anchors`` and each of its positives, rows of other labels that score nearly as high.

    Output: anchor_id, positive_id, rank (int, from 1), negative_id,
    positive_score, negative_score. An anchor's positives are the ``positives``
    other rows of its label that score highest; the negatives of each are the
    first ``negatives`` rows of other labels with a score between ``low`` and
    ``high`` percent of the positive's. Ties go to the smaller key. Labels are
    whole numbers.

    Rows without a key or a label, with a null or non-finite component or beyond
    64-bit arithmetic (``lloyd.MOST_SQUARES``) take no part. Vectors of different
    lengths don't meet; empty ones score 0. Of several rows with one key the
    first by label and vector counts. No anchor, no positive or no negative is no
    row. Other columns aren't read.

    The anchors are compared with all rows, block by block: blocks of anchors are
    dealt to every block of candidates, whatever their labels, so that a common
    label is spread over all tasks. Each pair of blocks yields at most
    ``negatives`` rows for each positive.
    """
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole_vector(vector, scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks")
    ).where("id is not null and label is not null and v is not null")
    rows = materialise(rows.groupBy("id").agg(F.min(F.struct("label", "v", "asks")).alias("r")).select("id", "r.*", F.size("r.v").alias("d")), "mine-rows")
    asked = rows.where("asks")
    n_blocks = -(-rows.count() // BLOCK_ROWS)
    n_asking = -(-asked.count() // ANCHOR_BLOCK)
    place = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(max(1, n)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        d = int(pdf["d"].iloc[0])
        x = np.concatenate([np.asarray(v, "int64") for v in pdf["v"]]).reshape(len(pdf), d)
        norm = root_up((x**2).sum(axis=1))
        return pd.DataFrame({"d": [d], "block": pdf["block"].iloc[:1], "ids": [pdf["id"].to_numpy("int64").tobytes()], "labels": [pdf["label"].to_numpy("int64").tobytes()],
                             "x": [narrow(x)], "norm": [norm.tobytes()]})

    spread = rows.drop("asks").withColumn("block", place(n_blocks, "block"))
    blocks = materialise(spread.groupBy("d", "block").applyInPandas(pack, "d int, block long, ids binary, labels binary, x binary, norm binary"), "mine-candidates")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        d = int(pdf["d"].iloc[0])
        x = np.concatenate([np.asarray(v, "int64") for v in pdf["v"]]).reshape(len(pdf), d)
        order, parent, edge = spanning_tree(x)
        pdf = pdf.iloc[order]
        out = {"a_ids": pdf["id"].to_numpy("int64"), "a_labels": pdf["label"].to_numpy("int64"), "parent": parent, "edge": edge}
        found = pdf["found"].tolist()
        # Of each anchor its positives, as many as it has.
        out["n_found"] = np.array([len(f) for f in found], "int64")
        out["p_ids"] = np.array([p["id"] for f in found for p in f], "int64")
        out["p_scores"] = np.array([p["score"] for f in found for p in f], "int64")
        return pd.DataFrame({"d": [d], **{n: [v.tobytes()] for n, v in out.items()}, "a": [narrow(x[order])]})

    names = ["a_ids", "a_labels", "parent", "edge", "n_found", "p_ids", "p_scores"]

    def met(asking: DataFrame) -> DataFrame:
        """Blocks of anchors (id, label, v, d, found) next to each block of candidates of the same length."""
        trees = asking.withColumn("block", place(n_asking, "tree")).groupBy("d", "block").applyInPandas(grow, f"d int, {', '.join(f'{n} binary' for n in names)}, a binary")
        trees = trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n_blocks) - 1).cast("long"))))
        return blocks.join(trees, ["d", "block"]).drop("block")

    def unpack(r) -> tuple:
        of = {n: np.frombuffer(getattr(r, n), "int64") for n in [*names, "ids", "labels", "norm"]}
        shape = lambda data, n: wide(data, r.d) if r.d else np.zeros((n, 0), "int64")
        return of, shape(r.a, len(of["a_ids"])), shape(r.x, len(of["ids"]))

    def best_positives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                of, a, x = unpack(r)
                mine = lambda i: (of["labels"] == of["a_labels"][i]) & (of["ids"] != of["a_ids"][i])  # noqa: E731, B023
                # Whoever can't reach the last of the best lowest scores isn't among the best.
                wanted = lambda i, lo, hi: (m := mine(i)) & (hi >= nth_largest(lo[m], positives))  # noqa: E731, B023
                out = []
                for i, at, score in scores_along_tree(a, of["parent"], of["edge"], x, of["norm"], wanted):
                    keep = mine(i)[at]
                    at, score = at[keep], score[keep]
                    top = first_of(score, of["ids"][at], positives)
                    out.append(pd.DataFrame({"id": of["a_ids"][i], "positive": of["ids"][at[top]], "score": score[top]}))
                yield pd.concat(out)

    none = F.array().cast("array<struct<id:long,score:long>>")
    first = met(asked.withColumn("found", none)).mapInPandas(best_positives, "id long, positive long, score long")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "positive"))
    chosen = first.withColumn("rank", rank).where(F.col("rank") <= positives)
    # At most ``positives`` of an anchor.
    chosen = chosen.groupBy("id").agg(F.collect_list(F.struct(F.col("positive").alias("id"), "score")).alias("found"))
    chosen = materialise(asked.drop("asks").join(chosen, "id"), "mine-positives")

    def best_negatives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                of, a, x = unpack(r)
                ends = np.cumsum(of["n_found"])
                held = [list(zip(of["p_ids"][e - n : e].tolist(), of["p_scores"][e - n : e].tolist())) for n, e in zip(of["n_found"], ends)]
                windows = [[w for w in windows_of([s for _, s in h], low, high) if w[0] <= w[1]] for h in held]

                def wanted(i: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
                    if not windows[i]:  # noqa: B023
                        return np.zeros(len(lo), bool)
                    other = of["labels"] != of["a_labels"][i]  # noqa: B023
                    return other & np.logical_or.reduce([(hi >= s) & (lo <= e) for s, e in windows[i]])  # noqa: B023

                out = []
                for i, at, score in scores_along_tree(a, of["parent"], of["edge"], x, of["norm"], wanted):
                    keep = of["labels"][at] != of["a_labels"][i]
                    at, score = at[keep], score[keep]
                    for (positive, p), (s, e) in zip(held[i], windows_of([p for _, p in held[i]], low, high)):
                        inside = np.flatnonzero((score >= s) & (score <= e))
                        top = inside[first_of(score[inside], of["ids"][at[inside]], negatives)]
                        out.append(pd.DataFrame({"anchor_id": of["a_ids"][i], "positive_id": positive, "negative_id": of["ids"][at[top]], "positive_score": p, "negative_score": score[top]}))
                if out:
                    yield pd.concat(out)

    form = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    near = met(chosen).mapInPandas(best_negatives, form)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return near.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
