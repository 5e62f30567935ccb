"""Live task table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chunkloom import constants as K
from chunkloom.operators.tasks import latest_task_state


def task_state(updates: DataFrame) -> DataFrame:
    """Current state per task; a finished task stands at 100."""
    latest = latest_task_state(updates)
    done = F.col("state").isin(*K.TERMINAL_STATES)
    return latest.withColumn("progress", F.when(done, F.lit(100)).otherwise(F.col("progress")))
