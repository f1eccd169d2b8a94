"""Writers for pools, targets and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flaskmill.constants import CONDITION_POOL_FIELDS, TARGET_FIELDS


def write_jsonl(df: DataFrame, path: str, fields: Sequence[str] = CONDITION_POOL_FIELDS) -> None:
    """The listed fields as JSON lines; null fields are left out of their line."""
    have = [f for f in fields if f in df.columns]
    df.select(*have).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_eval_targets(df: DataFrame, path: str, fields: Sequence[str] = TARGET_FIELDS) -> None:
    """Projection only: fields the rows do not have are skipped, nulls are kept."""
    have = [f for f in fields if f in df.columns]
    df.select(*have).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_run(summary: DataFrame, records: DataFrame, path: str) -> None:
    """Per-record detail as parquet beside a one-row JSON summary."""
    records.write.mode("overwrite").parquet(f"{path}/records")
    summary.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/summary")


def pending_rows(df: DataFrame, done: DataFrame, row_id: str) -> DataFrame:
    """Rows whose id is not in the output yet."""
    return df.join(done.select(row_id).distinct(), row_id, "left_anti")


def resume_append(df: DataFrame, path: str, row_id: str) -> None:
    """Append the rows the output lacks; a second run adds nothing."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(F.col(row_id))
        df = pending_rows(df, done, row_id)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    df.write.mode("append").parquet(path)
