"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Settings that the plans rely on; everything else is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # What a Python worker makes of a batch can be many times as large, so that the batch is bounded by its bytes, not by its rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a running session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "6g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("corpusloom")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.retainedStages", "100000")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@cache
def _local_folder() -> str:
    """A folder of this process on a machine that is driver and executor in one; gone when the process ends."""
    path = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the folder given to setCheckpointDir().

    Where neither is set, a local session gets a folder of its own, and a session
    on a cluster an error: its executors would each write to their own disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    # local-cluster and all other masters have executors with folders of their own.
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(_local_folder())
    return context.getCheckpointDir().rstrip("/")


def app_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder, to be deleted when it has ended."""
    return f"{work_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{app_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Most tasks that a spread table gets, so that what is dealt out is a few GB at most.
SPREAD_TASKS = 32


def spread(df: DataFrame) -> DataFrame:
    """A table whose scan gives fewer tasks than there are cores, dealt out to more; others as they are.

    Such a table is small, a split or a row group for each task, and dealing it
    out costs less than work in the row on few cores.
    """
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, SPREAD_TASKS)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no more than the tasks it
    ran, and gives the planner the real size of the table, by which it decides
    on broadcasting it.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *dfs: DataFrame) -> None:
    """Delete tables made by stored() once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = f"{app_dir(spark)}/"
    for df in dfs:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
