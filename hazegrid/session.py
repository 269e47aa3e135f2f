"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set to a list, it gets the plan of everything that is staged (tests read it).
STAGED_PLANS: list[str] | None = None


def build_session(app: str = "hazegrid", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job here assumes (UTC, adaptive execution).

    Shuffle parallelism is left to the cluster unless passed in ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the one named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary
    folder; a cluster without it is an error, since machine-local files would
    not be visible to the other executors. For the same reason a ``file:`` folder on a
    cluster needs ``spark.hazegrid.sharedFiles=true``, which says that it is mounted
    everywhere.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if folder:
        if folder.startswith("file:") and not local and spark.conf.get("spark.hazegrid.sharedFiles", "") != "true":
            raise RuntimeError(f"{folder} is a folder of one machine; name one that all executors share")
        return folder.rstrip("/")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="hazegrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def qualified(spark: SparkSession, folder: str, shared: bool = False) -> str:
    """A folder's full URI; one without a scheme lies in Hadoop's default file system.

    Code that writes files itself, not by Spark, needs it. A folder of one machine is
    refused off local mode, unless it is ``shared``: one below ``shared_folder``, which
    has judged it.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    local = spark.sparkContext.master.startswith("local")
    if full.startswith("file:") and not (local or shared or spark.conf.get("spark.hazegrid.sharedFiles", "") == "true"):
        raise RuntimeError(f"{full} is a folder of one machine; name one that all executors share")
    return full


def run_folder(spark: SparkSession) -> str:
    """Folder of what this application stages."""
    return f"{shared_folder(spark)}/hazegrid/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """Path below the shared folder that nothing else uses."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "staged") -> DataFrame:
    """Write a result that is used more than once and read it back.

    Lineage is cut, a lost executor costs nothing, and each use reads only the columns
    it needs.
    """
    path = new_path(df.sparkSession, name)
    if STAGED_PLANS is not None:
        STAGED_PLANS.append(df._jdf.queryExecution().toString())
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application has staged; frames that read from it are of no use then."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
