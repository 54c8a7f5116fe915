"""Change-impact analysis and training-data preparation as Spark jobs."""
