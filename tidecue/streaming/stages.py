"""Stage reports over a stream of job events. The inputs of all other operators are complete files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stages(events: DataFrame) -> DataFrame:
    """The latest status of every job of a stream of (job_id, event_id, ts, status), for update or complete mode.

    The state is one row per job; event order comes from (ts, event_id), so late events change nothing that
    is newer.
    """
    latest = F.max_by("status", F.struct("ts", "event_id"))
    return events.groupBy("job_id").agg(latest.alias("status"), F.count("*").alias("n_events"))
