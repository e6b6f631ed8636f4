"""Session settings the transformations rely on."""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that change plans; all can be set on a running session. Results depend on none:
#: instants are UTC wall clocks without a zone.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", app: str = "noonwatt", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        # Call sites are looked up for every column otherwise, which slows down
        # building a plan. Can only be set when a session starts.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    # One machine, so a folder of its own will do. Removed when the process ends.
    folder = tempfile.mkdtemp(prefix="noonwatt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark = builder.config("spark.checkpoint.dir", folder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for written tables, below the cluster's ``spark.checkpoint.dir``.

    Executors on other machines must see what is written here, so a cluster has to name the
    folder; a local session falls back on its warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "noonwatt-tables")
    _WRITTEN.append(os.path.join(base, f"noonwatt-{uuid.uuid4().hex}"))
    return _WRITTEN[-1]


_WRITTEN: list[str] = []


def release(spark: SparkSession) -> None:
    """Remove the tables that were written for plans so far. Frames that read them are of no
    use afterwards; their results must have been written or collected."""
    while _WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
