"""Impact analysis of changes as they arrive.

The analysis looks at one change at a time and keeps no state between them, so
a stream is a sequence of micro-batches of the batch job. What is written for a
batch replaces what an earlier attempt at it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rippletrace.jobs.impact import analyse
from rippletrace.sources.tables import change_of, step_scope


def arriving_diffs(spark: SparkSession, path: str, repo: str = "") -> DataFrame:
    """A stream of (repo, change_id, diff_source, diff_text), one row for each file that appears under ``path``."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    source = F.col("_metadata.file_path")
    return files.select(F.lit(repo).alias("repo"), change_of(source, path).alias("change_id"), source.alias("diff_source"), F.col("value").alias("diff_text"))


def analyse_stream(diffs: DataFrame, endpoints: DataFrame, references: DataFrame, out: str, checkpoint: str, threshold: float = 0.5) -> StreamingQuery:
    """Write affected and summary below ``out`` for each micro-batch of ``diffs``, until there are no more files."""

    def batch(rows: DataFrame, number: int) -> None:
        # Without the scope step tables would pile up for as long as the stream runs.
        with step_scope(rows.sparkSession):
            found = analyse(rows, endpoints, references, threshold)
            found.affected.write.mode("overwrite").parquet(f"{out}/affected/batch={number}")
            found.summary.write.mode("overwrite").parquet(f"{out}/summary/batch={number}")

    return diffs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
