"""Streaming forms of the half-hour cells and of the replay-safe append.

Both read a folder of files and run with an ``availableNow`` trigger, so a
scheduled run handles what arrived since the last one and stops.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.operators.quantiles import MEDIAN, stats_of_counts


def stream_cell_counts(
    readings: DataFrame,
    cell: str,
    value: str,
    time: str = "time",
    delay: str = "1 hour",
    window: str = "30 minutes",
) -> DataFrame:
    """Streaming half of the cell statistics: ``(thirtymins, cell, __v)`` with count.

    A streamed median would keep all values of a cell in one state row. State is
    kept per distinct value instead, which spreads a hot cell and stays small; the
    statistics are finished when the table is read (``cell_stats_of_counts``).
    """
    timed = readings.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", delay)
    return (
        timed.where(F.col(cell).isNotNull())
        .groupBy(
            F.window("__ts", window).alias("w"), F.col(cell), F.col(value).cast("double").alias("__v")
        )
        .agg(F.count(F.lit(1)).alias("__c"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("thirtymins"), cell, "__v", "__c")
    )


def cell_stats_of_counts(counts: DataFrame, cell: str) -> DataFrame:
    """median, mean, max, min, sum, count per half hour and cell."""
    return stats_of_counts(
        counts, ["thirtymins", cell], ("mean", "max", "min", "sum", "count"), MEDIAN
    )


def run_to_folder(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there in append mode, then return the table written.

    Readings that come after their half hour was closed are not in it; their number
    is warned of. ``write_cell_deltas`` takes them in.
    """
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    # Of a run with many batches the stream remembers only the last ones' numbers.
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    late = sum(s["numRowsDroppedByWatermark"] for s in states)
    if late:
        warnings.warn(f"at least {late} rows came after their window was closed", stacklevel=2)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


# ---- cells that late readings correct -------------------------------------------


def write_cell_deltas(
    readings: DataFrame, cell: str, value: str, path: str, checkpoint: str, time: str = "time", window: str = "30 minutes"
) -> DataFrame:
    """Fold each batch to ``(thirtymins, cell, __v, __c)`` and append it; returns the table's counts.

    A batch's counts are what it adds to the cells, however old its readings are: a
    reading that comes late corrects its half hour. Nothing is kept in state and no batch
    reads the table. Each batch has a folder of its own, overwritten when the batch is
    replayed, so every reading counts once; ``read_cell_counts`` adds the folders up.
    A new checkpoint over a table that has batches is refused.
    """
    spark = readings.sparkSession
    if _has_rows(spark, f"{path}/delta") and not _exists(spark, f"{checkpoint}/metadata"):
        raise ValueError(f"{path} has rows that were not written with the checkpoint {checkpoint}")

    def write(batch: DataFrame, number: int) -> None:
        start = F.window(F.col(time).cast("timestamp"), window)["start"].cast("timestamp_ntz")
        keyed = batch.where(F.col(cell).isNotNull() & F.col(time).isNotNull())
        counts = keyed.groupBy(start.alias("thirtymins"), F.col(cell), F.col(value).cast("double").alias("__v")).agg(
            F.count(F.lit(1)).alias("__c")
        )
        counts.write.mode("overwrite").parquet(f"{path}/delta/batch={number}")

    query = (
        readings.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return read_cell_counts(spark, path, readings.schema[cell])


def read_cell_counts(spark: SparkSession, path: str, cell: T.StructField) -> DataFrame:
    """The counts of all batches: the last compacted version, and the batches after it."""
    schema = T.StructType(
        [T.StructField("thirtymins", T.TimestampNTZType()), cell, T.StructField("__v", T.DoubleType()), T.StructField("__c", T.LongType())]
    )
    names = schema.fieldNames()
    last = _last_version(spark, path)
    table = spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{path}/folded/upto={last}")
    if _has_rows(spark, f"{path}/delta"):
        batches = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        deltas = spark.read.schema(batches).parquet(f"{path}/delta")
        after = deltas if last is None else deltas.where(F.col("batch") > last)
        table = table.union(after.select(*names))
    return table


def compact_cell_deltas(spark: SparkSession, path: str, cell: T.StructField) -> None:
    """Add all batches up in one folder, which readers take once it is complete.

    The batches themselves stay until a caller deletes them, so readers that began before
    go on, and running it again after a failure is safe.
    """
    numbers = _folder_numbers(spark, f"{path}/delta", "batch=")
    last = _last_version(spark, path)
    if not numbers or (last is not None and last >= max(numbers)):
        return
    counts = read_cell_counts(spark, path, cell)
    folded = counts.groupBy("thirtymins", cell.name, "__v").agg(F.sum("__c").alias("__c"))
    folded.write.mode("overwrite").parquet(f"{path}/folded/upto={max(numbers)}")


def _last_version(spark: SparkSession, path: str) -> int | None:
    """The newest folder that a finished job has marked as complete."""
    done = [n for n in _folder_numbers(spark, f"{path}/folded", "upto=") if _exists(spark, f"{path}/folded/upto={n}/_SUCCESS")]
    return max(done, default=None)


def _folder_numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return [int(name.removeprefix(prefix)) for name in found if name.startswith(prefix)]


# ---- append, each reading once ---------------------------------------------------


def append_once(
    stream: DataFrame,
    keys: Sequence[str],
    path: str,
    checkpoint: str,
    time: str = "time",
    delay: str = "1 hour",
) -> DataFrame:
    """Append readings, each once; returns the table.

    A reading is new unless one of its keys is stored already. Readings no older than
    ``delay`` before the latest one stored are compared with the stored ones of that
    time only. Older ones are late: they are compared with everything and go to a side
    table (``late_rows``), so nothing is lost.

    The latest time is the stream's own state: each batch writes it for the next one, and
    no batch looks for it in the table. Rows lie in folders by day, so an ordinary batch
    lists and reads the days that ``delay`` reaches back to, however large the table is.

    Within a day each batch has its own folder, overwritten when the batch is replayed, so
    a restart after a lost driver does not write a batch twice. A new checkpoint over a
    table that has rows is refused, since its batches would be numbered from 0 again.
    """
    spark, schema = stream.sparkSession, stream.schema
    if _has_rows(spark, f"{path}/kept") and not _exists(spark, f"{checkpoint}/metadata"):
        raise ValueError(f"{path} has rows that were not written with the checkpoint {checkpoint}")
    keys, ts = list(keys), F.col(time).cast("timestamp")

    def stored(part: str, number: int, days: Sequence[str] | None = None) -> DataFrame:
        """Rows of earlier batches, those of ``days`` or all."""
        folders = [f"{path}/{part}"] if days is None else [f"{path}/{part}/day={d}" for d in days]
        folders = [f for f in folders if _exists(spark, f)]
        if not folders:
            return spark.createDataFrame([], schema)
        table = spark.read.option("basePath", f"{path}/{part}").schema(f"{schema.toDDL()}, day string, batch bigint").parquet(*folders)
        return table.where(F.col("batch") < number).select(*stream.columns)

    def write_part(rows: DataFrame, part: str, number: int) -> None:
        filed = rows.withColumns({"day": F.to_date(F.col(time)).cast("string"), "batch": F.lit(number)})
        replacing = filed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        replacing.partitionBy("day", "batch").parquet(f"{path}/{part}")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            newest = _newest(spark, path, number)
            bound = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
            old = F.coalesce(ts < bound, F.lit(False)) if newest is not None else F.lit(False)
            fresh = batch.where(~old).dropDuplicates(keys)
            recent = stored("kept", number, _days_between(spark, newest, bound)).where(~old)
            write_part(_unseen(fresh, recent.select(*keys), keys), "kept", number)
            if newest is not None:
                behind = batch.where(old).dropDuplicates(keys)
                if not behind.isEmpty():
                    every = stored("kept", number).select(*keys).union(stored("late", number).select(*keys))
                    write_part(_unseen(behind, every, keys), "late", number)
            latest = batch.agg(F.greatest(F.max(ts), F.lit(newest).cast("timestamp")).alias("newest"))
            latest.write.mode("overwrite").parquet(f"{path}/newest/batch={number}")
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stored("kept", 2**62)


def _newest(spark: SparkSession, path: str, number: int):
    """The latest time before this batch, as the last batch has written it."""
    before = [n for n in _folder_numbers(spark, f"{path}/newest", "batch=") if n < number]
    if not before:
        return None
    return spark.read.schema("newest timestamp").parquet(f"{path}/newest/batch={max(before)}").first()["newest"]


def _days_between(spark: SparkSession, newest, bound: Column) -> list[str]:
    """Folders of the days from ``bound`` to the newest one, and the one of rows without a time."""
    days = ["__HIVE_DEFAULT_PARTITION__"]
    if newest is not None:
        span = F.sequence(F.to_date(bound.cast("timestamp_ntz")), F.to_date(F.lit(newest).cast("timestamp").cast("timestamp_ntz")))
        days += [r[0] for r in spark.range(1).select(F.explode(F.transform(span, lambda d: d.cast("string")))).collect()]
    return days


def late_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """Readings of an ``append_once`` table that came too late for it."""
    if not _has_rows(spark, f"{path}/late"):
        return spark.createDataFrame([], schema)
    filed = f"{schema.toDDL()}, day string, batch bigint"
    return spark.read.schema(filed).parquet(f"{path}/late").select(*schema.fieldNames())


def _unseen(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not among ``known``; null keys are keys like others."""
    other = known.distinct().withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(other, same, "left_anti")


def _has_rows(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).inputFiles())
    except AnalysisException:  # no such folder yet
        return False


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_folder_stream(spark: SparkSession, path: str, schema, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)
