"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words. Every document of the source then
has the same expected number of copies, target / source size, whose fractional
part has to be rounded. Documents are paired: two fractions move mass measured
in words between each other, in a random direction, until one of them is 0 or
1, and the other goes on to the next pair. The words of a source are thereby
kept exactly, up to the one document left at the end.

Pairs are formed in small groups first. What each group leaves over, one
document, is combined by a reduction tree over Spark groups, level by level.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippletrace.llm.common import materialise

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
LEAF_ROWS = 500
FAN_IN = 64


def word_count(text: str):
    """Number of words in the column ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """A row (source, source_size, rows, target) for each source.

    ``sizes`` has source and size. Sources weigh ``weights`` in turn, by code
    point, null last. They share ``share`` times all words by weight. A target
    stops at ``most`` times its source's size and the excess goes to the other
    sources by weight until none is above. That is min(most * size, level *
    weight) for one level: with sources sorted by the level at which they are
    full, the level follows from running sums.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    # One row per source: the order of all sources is what the weights hang on.
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    ranked = stats.withColumn("w", w).withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("w"))
    by_full = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(all_rows) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("w").over(by_full.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # The level holds for the first source that isn't full at it, and for all after it.
    ranked = ranked.withColumn("level", level).withColumn("at", F.row_number().over(by_full))
    found = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("at", "level"))).over(all_rows)["level"]
    target = F.least(F.col("cap"), F.coalesce(found * F.col("w"), F.col("cap")))
    return ranked.select("source", "source_size", "rows", target.alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Round the fractions ``p`` but for one at most, keeping sum(p * size).

    In each round neighbours duel. The pair (i, j) either moves words from j to
    i or from i to j, as many as fit before a fraction reaches 0 or 1; the odds
    keep the expectation of both.
    """
    p = p.astype("float64").copy()
    alive = np.flatnonzero((p > 0) & (p < 1))
    size = np.maximum(size.astype("float64"), 1e-9)
    while len(alive) > 1:
        n = len(alive) // 2 * 2
        i, j = alive[:n:2], alive[1:n:2]
        mi, mj = p[i] * size[i], p[j] * size[j]
        ri, rj = size[i] - mi, size[j] - mj
        up, down = np.minimum(ri, mj), np.minimum(mi, rj)  # words to i, words to j
        to_i = draws.random(len(i)) * (up + down) < down
        i_ends, j_ends = np.where(to_i, ri <= mj, mi <= rj), np.where(to_i, mj <= ri, rj <= mi)
        moved = np.where(to_i, up, -down)
        p[i] = np.where(i_ends, to_i, (mi + moved) / size[i])
        p[j] = np.where(j_ends, ~to_i, (mj - moved) / size[j])
        p[alive] = np.where(p[alive] < 1e-12, 0.0, np.where(p[alive] > 1 - 1e-12, 1.0, p[alive]))
        alive = alive[(p[alive] > 0) & (p[alive] < 1)]
    return p


def _numbered(sizes: DataFrame, run: int = 4096) -> DataFrame:
    """``sizes`` with a number ``row`` that tells equal rows apart, in whatever order.

    They are counted and written out again, in runs that are spread over tasks.
    """
    runs = sizes.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    # Runs of a common key leave its task before they become rows.
    runs = runs.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {run}")))).repartition("key", "source", "size", "run")
    upto = F.least(F.col("n"), (F.col("run") + 1) * run) - 1
    return runs.select("key", "source", "size", F.explode(F.sequence(F.col("run") * run, upto)).alias("row"))


def _level(rows: DataFrame, columns: list[str], seed: int, last: bool) -> DataFrame:
    """Round each group (source, bucket) of ``rows``; the last level also rounds what is left."""

    def work(rows: pa.Table) -> pa.Table:
        # Arrow, as pandas would turn long keys next to a null into floating point.
        rows = rows.sort_by([(c, "ascending") for c in ("size", "tie", "key", "row")])
        draws = np.random.Generator(np.random.Philox(key=[seed, rows["tie"][0].as_py() & 0x7FFFFFFFFFFFFFFF]))
        p = pivot(rows["p"].to_numpy(), rows["size"].to_numpy(), draws)
        if last:
            left = (p > 0) & (p < 1)
            p[left] = (draws.random(int(left.sum())) < p[left]).astype("float64")
        return rows.set_column(rows.column_names.index("p"), "p", pa.array(p))

    return rows.groupBy("source", "bucket").applyInArrow(work, rows.select(*columns).schema)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    leaf_rows: int = LEAF_ROWS,
    fan_in: int = FAN_IN,
    row: str | None = None,
) -> DataFrame:
    """Copies of each document such that sources reach their target words.

    Output: one row per input row with ``key``, source, size (words),
    source_size, target (words, of its source), copies (whole) and taken =
    copies * size. With ``row``, a column of numbers that are different for all
    rows, that one too. Copies never exceed the whole number at or above ``most``.

    Nulls: a null text has size 0; a null source is a source of its own, last;
    a null key is allowed. Rows of size 0 get the whole part of their expected
    copies. Ties and repeated rows: equal rows are interchangeable, each is
    rounded for itself. An empty table gives an empty table; other columns of
    the input aren't read. The result depends on the rows and ``seed`` only,
    not on how they are partitioned.

    Text is read once; what is shuffled is (key, source, size, row). Without
    ``row``, equal rows are counted and numbered, so that rows which share a key
    are dealt to many groups as others are. Groups hold about ``leaf_rows`` rows whatever the size of a source, and each level of
    the tree has ``fan_in`` times fewer rows than the one below.
    """
    extra = [] if row is None else [F.col(row).cast("long").alias("row")]
    base = docs.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), *extra)
    sizes = materialise(base, "mix-sizes")
    targets = materialise(source_targets(sizes, weights, share, most), "mix-targets")
    depth_rows = targets.agg(F.max("rows")).first()[0] or 0
    # Null-safe, and one row per source; Spark weighs its size before broadcasting it.
    t = targets.withColumnRenamed("source", "of")
    each = sizes if row is not None else _numbered(sizes)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        each.join(t, each["source"].eqNullSafe(t["of"]))
        .drop("of")
        .withColumn("whole", F.floor(rate))
        .withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(F.lit(0.0)))
        .withColumn("tie", F.xxhash64("key", "size", "row", F.lit(seed)))
        .withColumn("leaves", F.ceil(F.col("rows") / leaf_rows))
        .withColumn("bucket", F.pmod(F.shiftright("tie", 16), F.col("leaves")))
        .select("key", "source", "size", "source_size", "target", "whole", "p", "tie", "bucket", "row")
    )
    columns = rows.columns
    leaves = -(-depth_rows // leaf_rows)
    done, level = [], 0
    while True:
        last = leaves <= 1
        rows = materialise(_level(rows, columns, seed * 1000 + level, last), f"mix-level{level}")
        whole = (F.col("p") <= 0) | (F.col("p") >= 1)
        done.append(rows if last else rows.where(whole))
        if last:
            break
        rows = rows.where(~whole).withColumn("bucket", F.floor(F.col("bucket") / fan_in)).select(*columns)
        leaves = -(-leaves // fan_in)
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.round("p")).cast("long")
    return out.select(
        *([] if row is None else [F.col("row").alias(row)]),
        F.col("key").alias(key), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
