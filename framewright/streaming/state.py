"""What micro-batch jobs share: the trigger they use by default, and outputs that a replay replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Work off what is there, then end.
AVAILABLE_NOW = {"availableNow": True}


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Output of one micro-batch; a replay replaces it."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
