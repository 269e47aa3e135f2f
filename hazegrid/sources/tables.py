"""Table writers, and the reader of one partition."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header. Texts keep their quotes, commas, line breaks and outer blanks."""
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**options).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_partitioned(df: DataFrame, path: str, key: str, mode: str = "append") -> None:
    """One folder per key value, appended to or created, in a single job.

    The rebalance hint brings a key's rows together and lets adaptive execution
    split a key that holds much of the data over as many tasks as its size needs.
    """
    df.hint("rebalance", F.col(key)).write.mode(mode).partitionBy(key).parquet(path)


def read_partition(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """Rows of one key; the other folders are not read."""
    return spark.read.parquet(path).where(F.col(key) == F.lit(value))


def replace_partitions(df: DataFrame, path: str, key: str, gone: Sequence = ()) -> None:
    """Replace the partitions that ``df`` has rows for, and drop others of the keys ``gone``.

    All rows are written beside the table first, where readers do not look. Only when
    that is done is anything published, a partition at a time by renaming its folder: a
    load that fails has changed nothing, and no partition is ever a mix of both states.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    table = hadoop.Path(path)
    system = table.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = f"{path}/_replacing-{uuid.uuid4().hex}"
    df.hint("rebalance", F.col(key)).write.partitionBy(key).parquet(f"{beside}/new")
    new = {f.getPath().getName() for f in system.listStatus(hadoop.Path(f"{beside}/new")) if f.isDirectory()}
    system.mkdirs(hadoop.Path(f"{beside}/old"))
    for name in sorted(new | {f"{key}={value}" for value in gone}):
        own, old = hadoop.Path(f"{path}/{name}"), hadoop.Path(f"{beside}/old/{name}")
        if system.exists(own) and not system.rename(own, old):
            raise OSError(f"{own} could not be moved")
        if name in new and not system.rename(hadoop.Path(f"{beside}/new/{name}"), own):
            system.rename(old, own)
            raise OSError(f"{own} could not be published")
    system.delete(hadoop.Path(beside), True)
