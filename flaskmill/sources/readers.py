"""Readers for record tables, documents, lookups and runs."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flaskmill.functions.text import is_present
from flaskmill.session import stage
from flaskmill.sources.json_split import json_records
from flaskmill.sources.schemas import REACTION_DOCUMENT

LOGGER = logging.getLogger("flaskmill.sources")


def read_records(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    form: str | None = None,
    mode: str = "FAILFAST",
) -> DataFrame:
    """A JSON array or JSON lines; blank lines are skipped.

    ``form`` is ``array`` or ``lines``; left out, the first non-blank character decides. A line
    that cannot be read is an error; in the mode PERMISSIVE it is a row of nulls, with its text in
    ``_corrupt_record`` where the schema has that column. Large files are read by several tasks
    in both forms.
    """
    if form is None:
        lines = spark.read.text(path).where(F.trim("value") != "")
        first = lines.select(F.substring(F.ltrim("value"), 1, 1).alias("c")).head()
        form = "array" if first is not None and first["c"] == "[" else "lines"
    if form == "array":
        return _parsed(json_records(spark, path), schema, mode).select("r.*")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("mode", mode).json(path)


def _parsed(texts: DataFrame, schema: str | None, mode: str = "FAILFAST") -> DataFrame:
    """Adds ``r``: the record in ``value``, by the schema given or found in all of them."""
    if schema is None:
        spark = texts.sparkSession
        strings = getattr(texts.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        schema = DataFrame(spark._jsparkSession.read().json(strings), spark).schema
    options = {"mode": mode, "columnNameOfCorruptRecord": "_corrupt_record"}
    return texts.withColumn("r", F.from_json("value", schema, options))


def read_exclusion_keys(spark: SparkSession, paths: Sequence[str], key: str) -> DataFrame:
    """Distinct non-empty keys of several files; a missing file is only a warning, a line that
    cannot be read is an error: its key would not be held out."""
    found = []
    for path in paths:
        try:
            found.append(read_records(spark, path, f"{key} STRING").select(key))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            LOGGER.warning("exclusion file %s not found, nothing is excluded for it", path)
    if not found:
        return spark.createDataFrame([], f"{key} STRING")
    return reduce(DataFrame.unionByName, found).where(is_present(key)).distinct()


def numbered_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """value, file_path, file_name, position: the non-blank lines of a file or tree, counted from
    0 in every file, however Spark splits it.

    The lines are written once with their place within their split; a split's start is the
    number of lines in the splits before it, one row per split.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text(path).where(F.trim("value") != "")
    place = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_name", "file_block_start")]
    lines = stage(lines.select("value", *place, F.monotonically_increasing_id().alias("_at")))
    split = ["file_path", "file_block_start"]
    before = W.partitionBy("file_path").orderBy("file_block_start").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        lines.groupBy(*split)
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    position = F.col("_before") + F.col("_at") - F.col("_first")
    return lines.join(starts, split).select("value", "file_path", "file_name", position.alias("position"))


def read_reaction_documents(
    spark: SparkSession,
    path: str,
    schema: str = REACTION_DOCUMENT,
    pattern: str | None = None,
    mode: str = "FAILFAST",
) -> DataFrame:
    """JSON-lines documents of one file or a whole tree, tagged with their file name.

    ``index_in_file`` is the document's own where it states one, else its line's place in the
    file; ``row_id`` is the file's path and that place, never null and never twice. A line that
    cannot be read is an error; in the mode PERMISSIVE it stands in ``_corrupt_record``.
    """
    bad = "_corrupt_record"
    parsed = F.from_json("value", f"{schema}, {bad} STRING", {"mode": mode, "columnNameOfCorruptRecord": bad})
    docs = numbered_lines(spark, path, pattern).select(
        parsed.alias("d"), "file_path", F.col("file_name").alias("source_dataset"), "position"
    )
    row_id = F.format_string("%s#%012d", F.col("file_path"), F.col("position"))
    docs = docs.select("d.*", "source_dataset", row_id.alias("row_id"), "position")
    if "index_in_file" in docs.columns:
        docs = docs.withColumn("index_in_file", F.coalesce("index_in_file", "position"))
    else:
        docs = docs.withColumn("index_in_file", F.col("position"))
    return docs.drop("position", *([bad] if mode == "FAILFAST" else []))


def read_split(table: DataFrame, splits: Sequence[str] | None = None, split: str = "split") -> DataFrame:
    """All splits, or the named ones; prunes folders when the table is partitioned by split."""
    return table if splits is None else table.where(F.col(split).isin(*splits))


def read_role_lookup(spark: SparkSession, path: str) -> DataFrame:
    """``smiles, role`` of a tab-separated table; any role but ``reagent`` is a substrate."""
    try:
        lines = spark.read.csv(path, sep="\t", header=True, quote="")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "smiles STRING, role STRING")
    smiles, role = lines.columns[:2]
    return lines.where(is_present(smiles)).select(
        F.col(smiles).alias("smiles"),
        F.when(F.col(role) == "reagent", "reagent").otherwise("substrate").alias("role"),
    )


def read_run(spark: SparkSession, path: str, schema: str | None = None, several: bool = False) -> DataFrame:
    """Records of a run file with their position.

    The format keeps a whole run in one JSON value; it is read by as many tasks as the file has
    splits. A folder of several is an error unless ``several`` says that it is meant: positions are
    then those of each file, which ``run`` names. ``schema`` is the whole file's.
    """
    texts = json_records(spark, path, "records")
    if not several and texts.select("file_path").distinct().limit(2).count() > 1:
        raise ValueError(f"{path} holds several runs, whose positions would repeat")
    if schema is not None:
        record = T.StructType.fromDDL(schema)["records"].dataType.elementType
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in record.fields)
    names = ["file_name"] if several else []
    return _parsed(texts, schema).select(
        *[F.col(n).alias("run") for n in names], F.col("position").alias("record_pos"), "r.*"
    )
