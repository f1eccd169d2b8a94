"""Sinks that keep a ledger: what each batch wrote is committed with it and seen by the next.

A batch writes its rows to a folder of its own and then, read back from there, the keys to the
ledger; both are overwritten when the batch is run again. So a crash anywhere between the rows
and Spark's own commit repeats nothing and loses nothing, and rows without a ledger entry do not
count. Folders are named after the checkpoint and the batch: a stream that starts over needs a
new checkpoint folder, and still repeats no row whose key is in the ledger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flaskmill.functions.text import is_present, text_digest


def _batch_name(checkpoint: str, number: int) -> str:
    return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}-{number:012d}"


def _ledger(spark: SparkSession, path: str, name: str = "ledger", but: str | None = None) -> DataFrame | None:
    """batch and what it committed; without the batch that is being run (again)."""
    try:
        rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return rows if but is None else rows.where(F.col("batch") != but)


def _text(key: str):
    return F.col(key).cast("string")


def append_once(
    batch: DataFrame, number: int, path: str, checkpoint: str, key: str, between: Callable[[], None] = lambda: None
) -> None:
    """One batch: the first row of each key that no other batch has committed; null keys stay out.

    ``between`` is called after the rows and before the ledger, for tests of a crash there.
    """
    name, spark = _batch_name(checkpoint, number), batch.sparkSession
    known = _ledger(spark, path, but=name)
    rows = batch.where(F.col(key).isNotNull()).withColumn("_key", text_digest(_text(key))).dropDuplicates(["_key"])
    if known is not None:
        rows = rows.join(known.select("_key"), "_key", "left_anti")
    rows.write.mode("overwrite").parquet(f"{path}/rows/batch={name}")
    between()
    written = spark.read.parquet(f"{path}/rows/batch={name}").select("_key")
    written.write.mode("overwrite").parquet(f"{path}/ledger/batch={name}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the batches that are in the ledger."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    batches = _ledger(spark, path).select("batch").distinct()  # a row for each batch
    return rows.join(F.broadcast(batches), "batch", "left_semi").drop("batch", "_key")


def stream_append_once(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append what is there, each key once over all batches, restarts and runs."""
    return _start(stream, checkpoint, lambda batch, n: append_once(batch, n, path, checkpoint, key))


def exclude_growing(batch: DataFrame, number: int, path: str, checkpoint: str, key: str) -> None:
    """One batch of rows (``held`` false) and held-out keys (``held`` true).

    Keys of this batch and of all before it stop its rows; rows that passed earlier stay. The
    held keys are deduplicated before they are joined, so neither a key with many rows nor one
    that is held out often meets in one task. Null keys pass.
    """
    name, spark = _batch_name(checkpoint, number), batch.sparkSession
    marked = batch.withColumn("_key", text_digest(_text(key)))
    new = marked.where(F.col("held") & is_present(_text(key))).select("_key").distinct()
    new.write.mode("overwrite").parquet(f"{path}/held/batch={name}")
    held = _ledger(spark, path, "held")
    held = new if held is None else held.select("_key").distinct()
    rows = marked.where(~F.col("held")).join(held, "_key", "left_anti").drop("held")
    rows.write.mode("overwrite").parquet(f"{path}/rows/batch={name}")
    done = spark.range(1).select(F.lit(number).alias("number"))
    done.write.mode("overwrite").parquet(f"{path}/ledger/batch={name}")


def stream_exclude_growing(
    rows: DataFrame, holdout: DataFrame, path: str, checkpoint: str, key: str
) -> StreamingQuery:
    """Rows of one stream whose key no row of the other has held out so far."""
    none = holdout.select(F.col(key), F.lit(True).alias("held"))
    both = rows.withColumn("held", F.lit(False)).unionByName(none, allowMissingColumns=True)
    return _start(both, checkpoint, lambda batch, n: exclude_growing(batch, n, path, checkpoint, key))


def _start(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # read more than once, by one batch
        try:
            write(kept, number)
        finally:
            kept.unpersist()

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
