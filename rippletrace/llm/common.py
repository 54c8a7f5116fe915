"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippletrace.sources.tables import drop_steps, shared_dir
from rippletrace.sources.tables import save_step as materialise

__all__ = ["add_columns", "drop_steps", "fold", "free_name", "materialise", "new_path", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the input tables; with ``columns``, only those are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet, in the application's folder of step tables."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, with as many underscores at its end as it takes to differ from all of ``taken`` in any case of letters."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def fold(key_column: str, modulus: int):
    """crc32 of a key's decimal text, modulo ``modulus``; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key_column).cast("string"), F.lit("")).cast("binary")) % modulus


def add_columns(
    docs: DataFrame,
    of: str,
    start: Callable[[], Callable[[list], Sequence[list]]],
    new: Sequence[tuple[str, T.DataType, pa.DataType]],
    keep: Sequence[str] | None = None,
    rows: int = 500,
) -> DataFrame:
    """``docs`` with columns ``new`` (name, type, Arrow type) computed from the column ``of``.

    ``start`` is called once a task and returns the function that gets the values
    of up to ``rows`` rows and gives a list for each new column. Columns named
    as a new one are replaced. The others, or those in ``keep``, pass as Arrow
    arrays: pandas would turn long integers next to a null into floating point.
    """
    names = [n for n, _, _ in new]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t, _ in new])
    types = [t for _, _, t in new]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = make(part.column(of).to_pylist())
                arrays = [part.column(c) for c in kept] + [pa.array(v, t) for v, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *names])

    return docs.mapInArrow(work, schema)
