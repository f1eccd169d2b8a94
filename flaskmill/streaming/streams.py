"""Streaming forms of the stateless steps, of first-seen deduplication, and of the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flaskmill.functions.text import is_present, text_digest
from flaskmill.operators.extract import normalize_reaction
from flaskmill.operators.leakage import holdout_keys, without_keys
from flaskmill.sources.schemas import REACTION_DOCUMENT


def stream_normalize(
    spark: SparkSession, path: str, schema: str = REACTION_DOCUMENT, files_per_trigger: int = 100
) -> DataFrame:
    """New document files are normalised as they arrive; no state."""
    documents = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", True)
        .json(path)
    )
    return normalize_reaction(documents.withColumn("source_dataset", F.col("_metadata.file_name")))


def stream_exclude(stream: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    """Stream-static anti join: held-out keys never pass, null keys do."""
    return without_keys(stream, holdout_keys([holdout], key), key)


def stream_dedupe(
    stream: DataFrame, key: str, event_time: str | None = None, delay: str | None = None
) -> DataFrame:
    """First row seen per key; empty keys are dropped.

    The state holds the digest of every key ever seen. With an event time and a delay the state forgets
    keys older than the watermark, and a copy arriving later than that passes again. Kept on
    disk by the RocksDB state store when the session sets it.
    """
    keyed = stream.where(is_present(key)).withColumn("_key", text_digest(key))
    if event_time is None:
        return keyed.dropDuplicates(["_key"]).drop("_key")
    late = keyed.withWatermark(event_time, delay)
    return late.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def stream_append(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """File sink with a checkpoint: a restart repeats at most the running batch and writes no
    row twice. Processes what is there and stops."""
    return (
        stream.writeStream.format(form)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
