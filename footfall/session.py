"""Session settings shared by jobs and tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Run-time settings the operators count on, for a session made elsewhere."""
    # All stored timestamps are UTC without zone; casts must not move them.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build_session(
    app: str = "footfall", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with adaptive execution. Partition counts are left to AQE, which
    coalesces small shuffles and splits skewed join partitions at run time. On a
    cluster leave `shuffle_partitions` unset and size
    spark.sql.adaptive.coalescePartitions.initialPartitionNum for the job."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        # Generated methods above this size are not compiled by the JVM; wide projections
        # (classification) run faster as several smaller ones.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Plans here are large; recording a call site per column doubles the time to build one.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        # One JVM does everything in local mode.
        b = b.master(master).config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return prepare(b.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: what the session names in
    spark.checkpoint.dir. Only a session on one machine may go without; it gets a temporary
    folder. On a cluster a missing setting is an error, since executors do not share disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="footfall-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the session."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes `df` once to a table of its own in the shared folder and reads it back: a cut of
    the lineage that is columnar, keeps its measured size for the planner, and survives lost
    executors. The caller's cluster empties the shared folder as it does checkpoints."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
