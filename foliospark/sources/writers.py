"""Writers for splits and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_split(rows: DataFrame, path: str) -> None:
    """JSON lines in one folder per value of `split`; one pass writes both."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def write_run_summary(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Metrics per file as CSV and the one-row summary as JSON."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/metrics")
    summary.write.mode("overwrite").json(f"{path}/summary")
