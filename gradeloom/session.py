"""Session settings and the shared folder that every operator writes its intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def local_session(app: str = "gradeloom", cpus: str = "8", **conf: str) -> SparkSession:
    """A single-JVM session for tests and bench runs; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only where it is unset and the master is local (tests) is a temporary folder made, once per
    application; a cluster without the setting is an error, as its machines would not see the folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
        spark.sparkContext.setCheckpointDir(_own_folder[app])
    return _own_folder[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder as Parquet and read it back.

    The copy survives the loss of executors, is read with column pruning, and gives the planner a
    size that comes from files instead of a guess.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task of a counted table gets, about; rows of a side that is broadcast.
TASK_ROWS = 262_144
BROADCAST_ROWS = 50_000


def tasks_for(table: DataFrame) -> int:
    """Tasks to deal a stored table over, so that what one holds doesn't grow with the table."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // TASK_ROWS))


def small_or_merge(table: DataFrame) -> DataFrame:
    """A stored table hinted for a join: few rows are broadcast, as a few keys would leave all but a few tasks idle; more are merged."""
    return table.hint("broadcast" if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else "merge")
