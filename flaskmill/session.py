"""Session settings the jobs rely on, and the shared folder for staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Streaming state on disk: first-seen deduplication keeps every key.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def local_session(app: str = "flaskmill", cores: str = "8") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Folder per local application.
_LOCAL: dict[str, str] = {}


def staging_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only where none is set and Spark runs
    locally, since other machines could not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = context.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="flaskmill-stage-")
    return _LOCAL[app]


#: A scan of this many splits at most holds some hundred megabytes, whatever the cluster.
FEW_SPLITS = 4


def balance(df: DataFrame) -> DataFrame:
    """Spread a scan of a few splits, whose rows would all be worked on in as many tasks.

    The bound is on the splits and so on the size, not on the number of cores: a scan of many
    splits is never shuffled. ``df`` must be a plain scan.
    """
    splits, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if splits <= min(FEW_SPLITS, cores - 1) else df


# Folders staged so far, by application.
_STAGED: dict[str, list[str]] = {}


def stage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Cuts the lineage in a way that survives lost executors, keeps column pruning for the
    passes that follow, and gives the planner real sizes. The folder stays until the enclosing
    ``staging`` block ends; without one the caller's results may still need it.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark).rstrip('/')}/flaskmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession):
    """Folders staged inside the block are deleted at its end: for jobs that write their results."""
    folders = _STAGED.setdefault(spark.sparkContext.applicationId, [])
    before = len(folders)
    try:
        yield
    finally:
        for path in folders[before:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del folders[before:]
