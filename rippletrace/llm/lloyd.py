"""Centroid clustering in whole numbers, sharded by dimension.

Vectors are cut into blocks of rows and, within these, into blocks of columns. A
shard is a block of columns of all rows, together with the same columns of all
centroids. In each round the tasks of a shard compute the exact partial
distances of their rows to the slices of the centroids; the partial distances of
a block of rows are added up over the shards and give its nearest centroids; sums
of the columns by cluster go back to the shards, each of which computes its own
slice of the new centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippletrace.llm.common import drop_steps, materialise

#: Vectors whose squares add up to more than this take no part: sums of products then fit in 64 bits.
MOST_SQUARES = 2.0**58


def whole_vector(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component in double precision; null where the vector is null, has a null or non-finite component, or is too long for 64 bits."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    squares = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(squares < MOST_SQUARES, F.transform(scaled, lambda x: F.floor(x)))


def seed_vectors(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors (id, v) with the smallest SHA-256 of ``<seed>:<id>``, then by the vector; rows without an id come last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(name.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], "int64")


def shard_blocks(vectors: DataFrame, d: int, columns: int, chunk_rows: int) -> DataFrame:
    """(chunk, shard, ids, x): blocks of at most ``chunk_rows`` rows of (id, v), cut into blocks of ``columns`` columns.

    Shard -1 has the ids, the others the numbers. No row is shuffled for it, and
    each row of the input counts on its own, equal ones included.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(at, chunk_rows)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)
                cut = [narrow(x[:, c : c + columns]) for c in range(0, d, columns)]
                ids = [part.column("id").to_pylist(), *[None] * len(cut)]
                arrays = [pa.array([chunk] * len(ids), pa.int64()), pa.array(range(-1, len(cut)), pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array([None, *cut], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "shard", "ids", "x"])
                chunk += 1

    return vectors.select("id", "v").mapInArrow(pack, "chunk long, shard int, ids array<long>, x binary")


def narrow(x: np.ndarray) -> bytes:
    """The numbers with a leading byte for their width, 32 bits where they fit."""
    kind = "int32" if np.abs(x).max(initial=0) < 2**31 else "int64"
    return (b"4" if kind == "int32" else b"8") + np.ascontiguousarray(x, kind).tobytes()


def wide(data: bytes, columns: int) -> np.ndarray:
    """What ``narrow`` wrote, as rows of 64-bit numbers."""
    return np.frombuffer(data, "int32" if data[:1] == b"4" else "int64", offset=1).astype("int64").reshape(-1, columns)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y exactly: in double precision where no sum can pass 2^53, else in whole numbers."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * x.shape[1]
    return (x.astype("float64") @ y.astype("float64")).astype("int64") if most < 2**53 else x @ y


def partial_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances over these columns between all rows and all centroids."""
    return (x**2).sum(axis=1)[:, None] - 2 * products(x, centroids.T) + (centroids**2).sum(axis=1)[None]


def cluster_vectors(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    d: int = 64,
    scale: int = 256,
    seed: int = 2,
    columns: int = 16,
    chunk_rows: int = 1024,
) -> DataFrame:
    """Clusters of vectors by ``rounds`` rounds of Lloyd's algorithm, in exact whole numbers.

    Output: ``key`` (long), cluster (int), distance (long, squared), and of the
    cluster cluster_inertia, centroid_sha256 (of the components joined by commas)
    and over all inertia. Seeds as in ``seed_vectors``. Ties go to the smaller
    cluster, means are rounded down, empty clusters keep their centroid. Rounds
    end early when no centroid moves, as further ones change nothing.

    Only vectors with exactly ``d`` components, none null or non-finite, take
    part; neither do those beyond 64-bit arithmetic (see ``MOST_SQUARES``).
    Repeated rows count each for itself, a row without a key is clustered like
    others and may be a seed only after all that have one. Fewer vectors than
    ``k`` are fewer clusters, no vector is no row. Inertia beyond 64 bits is
    null. Other columns aren't read.

    Each round moves ``k`` partial distances per row and shard, and each row
    once. What is gathered and broadcast are the centroids, k x d numbers: ``k``
    and ``d`` are parameters and don't grow with the data.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole_vector(vector, scale).alias("v")).where(F.size("v") == d)
    rows = materialise(rows, "lloyd-vectors")
    context = rows.sparkSession.sparkContext
    seeds = seed_vectors(rows, k, seed)
    width = {s: min(columns, d - c) for s, c in enumerate(range(0, d, columns))}
    slices = {s: seeds.reshape(-1, d)[:, s * columns : s * columns + w] for s, w in width.items()}
    blocks = materialise(shard_blocks(rows, d, columns, chunk_rows), "lloyd-blocks", "shard")

    def measured(slices: dict[int, np.ndarray]) -> DataFrame:
        """(chunk, shard, x, part): partial distances, by the tasks of each shard."""
        shared = context.broadcast(slices)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for chunk, shard, data in zip(pdf["chunk"], pdf["shard"], pdf["x"]):
                    x = wide(data, width[shard])
                    yield pd.DataFrame({"chunk": [chunk], "shard": [shard], "x": [data], "part": [narrow(partial_distances(x, shared.value[shard]))]})

        return blocks.where("shard >= 0").select("chunk", "shard", "x").mapInPandas(work, "chunk long, shard int, x binary, part binary")

    def nearest(parts: pd.Series, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row and its distance; ties go to the smaller number."""
        total = sum(wide(p, n) for p in parts)
        own = total.argmin(axis=1)
        return own, total[np.arange(len(own)), own]

    def sums_of(n: int):
        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            own, _ = nearest(pdf["part"], n)
            member = np.zeros((n, len(own)), "int64")
            member[own, np.arange(len(own))] = 1
            sums = [narrow(products(member, wide(x, width[s]))) for s, x in zip(pdf["shard"], pdf["x"])]
            return pd.DataFrame({"shard": pdf["shard"], "sums": sums, "counts": [narrow(member.sum(axis=1)[:, None])] * len(pdf)})

        return work

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per shard from all rows of a task, so that a shard gets as many rows as there were tasks."""
        sums, counts = {}, {}
        for pdf in batches:
            for s, a, n in zip(pdf["shard"], pdf["sums"], pdf["counts"]):
                sums[s] = sums.get(s, 0) + wide(a, width[s])
                counts[s] = counts.get(s, 0) + wide(n, 1)
        yield pd.DataFrame([(s, narrow(sums[s]), narrow(counts[s])) for s in sums], columns=["shard", "sums", "counts"])

    def moved(slices: dict[int, np.ndarray], n: int) -> dict[int, np.ndarray]:
        """The slices after one round, each computed by its shard."""
        shared, form = context.broadcast(slices), "shard int, sums binary, counts binary"

        def update(pdf: pd.DataFrame) -> pd.DataFrame:
            s = pdf["shard"].iloc[0]
            sums, counts = sum(wide(a, width[s]) for a in pdf["sums"]), sum(wide(c, 1) for c in pdf["counts"])
            return pd.DataFrame({"shard": [s], "slice": [narrow(np.where(counts > 0, sums // np.maximum(counts, 1), shared.value[s]))]})

        parts = measured(slices).groupBy("chunk").applyInPandas(sums_of(n), form).mapInPandas(added, form)
        return {r["shard"]: wide(r["slice"], width[r["shard"]]) for r in parts.groupBy("shard").applyInPandas(update, "shard int, slice binary").collect()}

    n = len(seeds)
    for _ in range(rounds if n else 0):
        before, slices = slices, moved(slices, n)
        if all((before[s] == slices[s]).all() for s in slices):
            break

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        own, distance = nearest(pdf["part"], n)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "cluster": [own], "distance": [distance]})

    found = measured(slices).groupBy("chunk").applyInPandas(assign, "chunk long, cluster array<int>, distance array<long>")
    found = found.join(blocks.where("shard = -1").select("chunk", "ids"), "chunk")
    found = materialise(found.select(F.inline(F.arrays_zip("ids", "cluster", "distance"))), "lloyd-clusters")
    drop_steps(blocks, rows)
    centroids = np.concatenate([slices[s] for s in sorted(slices)], axis=1)
    # A row per cluster.
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 2**63 else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, fits(s), fits(sum(inertia.values())), names[c]) for c, s in sorted(inertia.items())]
    facts = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("ids").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
