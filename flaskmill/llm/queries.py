"""The registered queries of the operators, one for each, over whole tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from flaskmill.llm import (
    chat_windows,
    chosen_path,
    compression,
    conversation_repair,
    decontaminate,
    licenses,
    link_graph,
    mixing,
    pii,
    quality_rules,
    source_divergence,
    suffix_arrays,
    tokens,
)
from flaskmill.llm.texts import staging_dir


_SHIPPED: set[str] = set()


#: Rows and bytes that go to a Python worker at a time; whole texts are long rows.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, which may not have it installed (once a session), and
    keep the batches small that hold their texts."""
    context = spark.sparkContext
    for name, value in BATCHES.items():
        spark.conf.set(name, value)
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="flaskmill-")) / "flaskmill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))  # the driver serves it; executors never read this path
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return compression.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file as text; it is sent to the executors, which need no copy."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{staging_dir(spark).rstrip('/')}/token-blocks-{uuid.uuid4().hex}"
    tokens.write_blocks(table(spark, folder, "documents"), path, tokenizer())
    return tokens.document_digests(tokens.read_blocks(spark, path))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.detect(table(spark, folder, "documents"))


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.join(table(spark, folder, "documents"))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_arrays.remove_repeats(table(spark, folder, "documents"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return link_graph.judge(table(spark, folder, "pages"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair(table(spark, folder, "conversations"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.audit(table(spark, folder, "documents"))


def op13_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    conversations = chat_windows.with_control_strings(table(spark, folder, "conversations"))
    return chat_windows.digests(chat_windows.windows(conversations))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_token_blocks": op3_token_blocks,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_mixing": op6_mixing,
    "op7_pii": op7_pii,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_source_divergence": op12_source_divergence,
    "op13_chat_windows": op13_chat_windows,
}
SQL: dict[str, str] = {
    "op1_license_scan": licenses.scan_sql(),
    "op11_conversation_repair": conversation_repair.repair_sql(),
    "op12_source_divergence": source_divergence.audit_sql(),
    "op13_chat_windows": chat_windows.digests_sql(),
}
