"""Streaming jobs over the events files."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.catalog import register
from hazegrid.catalog import tables as D
from hazegrid.catalog.tables import with_tables
from hazegrid.session import new_path
from hazegrid.streaming import refresh as R


def _stream(spark, d):
    schema = D.table(spark, d, "events").schema
    return D.readings_of(R.read_folder_stream(spark, d, schema, "events.parquet"))


@register(
    "stream_cell_stats",
    with_tables(
        "flagged",
        """SELECT thirtymins, sensor_id, median(pm) AS median, avg(pm) AS mean, max(pm) AS max, min(pm) AS min,
                  coalesce(sum(pm), 0)::DOUBLE AS sum, count(*) AS count FROM flagged
           WHERE thirtymins + INTERVAL '30 minutes' <= (SELECT max(time) - INTERVAL '1 hour' FROM flagged)
           GROUP BY ALL""",
    ),
    "median, mean, sum",
)
def stream_cell_stats(spark, d):
    """Closed half hours; the last ones wait for later readings."""
    counts = R.stream_cell_counts(_stream(spark, d), "sensor_id", "pm")
    written = R.run_to_folder(
        counts, new_path(spark, "cell-counts"), new_path(spark, "cell-counts-state")
    )
    return R.cell_stats_of_counts(written, "sensor_id")


@register(
    "stream_cell_stats_late",
    with_tables(
        "flagged",
        """SELECT thirtymins, sensor_id, median(pm) AS median, avg(pm) AS mean, max(pm) AS max, min(pm) AS min,
                  coalesce(sum(pm), 0)::DOUBLE AS sum, count(*) AS count FROM flagged GROUP BY ALL""",
    ),
    "median, mean, sum",
)
def stream_cell_stats_late(spark, d):
    """Readings come in four files, the newest first; every half hour is as a batch job has it.

    The batches are added up in between, and the job runs once more without new files.
    """
    rows = D.readings(spark, d).select("event_id", "time", "sensor_id", "pm")
    inbox, path, state = (new_path(spark, n) for n in ("late-inbox", "late-cells", "late-state"))
    parts = ("day(time) > 20", "day(time) BETWEEN 11 AND 20 AND event_id % 2 = 0", "day(time) <= 20 AND event_id % 2 = 1", "day(time) <= 10 AND event_id % 2 = 0")
    for k, part in enumerate((*parts, "false")):
        rows.where(part).coalesce(1).write.mode("append").parquet(inbox)
        stream = R.read_folder_stream(spark, inbox, rows.schema)
        counts = R.write_cell_deltas(stream, "sensor_id", "pm", path, state)
        if k == 1:
            R.compact_cell_deltas(spark, path, rows.schema["sensor_id"])
    return R.cell_stats_of_counts(counts, "sensor_id")


@register(
    "stream_idempotent_append",
    with_tables(
        "readings",
        """SELECT event_id, time, sensor_id, pm, time < (SELECT max(time) - INTERVAL '1 hour' FROM readings WHERE event_id % 3 <> 0)
                  AND event_id % 3 = 0 AS late FROM readings""",
    ),
)
def stream_idempotent_append(spark, d):
    """Every reading arrives twice and the job runs three times; each is stored once.

    A third of the readings arrive only after the others, so most of them are late.
    """
    inbox = new_path(spark, "inbox")
    rows = D.readings(spark, d).select("event_id", "time", "sensor_id", "pm")
    path, state = new_path(spark, "appended"), new_path(spark, "appended-state")
    for part in ("event_id % 3 <> 0", "event_id % 3 = 0", "false"):
        for _ in range(2):
            rows.where(part).write.mode("append").parquet(inbox)
        stream = R.read_folder_stream(spark, inbox, rows.schema)
        out = R.append_once(stream, ["event_id"], path, state)
    late = R.late_rows(spark, path, rows.schema)
    return out.withColumn("late", F.lit(False)).union(late.withColumn("late", F.lit(True)))
