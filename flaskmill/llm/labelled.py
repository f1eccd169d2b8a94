"""Labelled rows for fitting, and a one-dimensional probability calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of what is fitted on: rows of each label, and bytes of a text.
PER_LABEL = 1500
LONGEST = 20_000


def held_out(doc_id="doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drawn(df: DataFrame, at: Column, key: str, rows: int, wanted: int) -> DataFrame:
    """The rows with the lowest ``at`` (a long that is spread evenly), ``wanted`` of about ``rows``
    different ``key``s; equal places go by the key, and a key counts once.

    A cut that about twice as many pass comes before the exact one, so what the last step sees
    does not grow with the input, and neither does it shrink: places have 64 bits.
    """
    share = min(1.0, (2 * wanted + 100) / max(1, rows))
    low, high = -(1 << 63), (1 << 63) - 1
    some = df.withColumn("at", at).where(F.col("at") <= min(high, low + int(share * (1 << 64))))
    return some.dropDuplicates([key]).orderBy("at", key).limit(wanted)


def sample(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL
) -> tuple[pa.Array, np.ndarray, float]:
    """At most ``per_label`` texts of each label (0 and 1), their labels, and the share of label 1
    among all labels that may be learned from.

    Rows are drawn by the digest of their id among all that are not held out, so the draw does
    not depend on partitions. Texts over ``LONGEST`` bytes are not fitted on. An id with several
    labels counts by the largest; null labels and ids do not count.
    """
    one = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    count = one.agg(F.count("*").alias("n"), F.sum("label").alias("good")).first()
    share = ((count["good"] or 0) + 1) / (count["n"] + 2)
    good = count["good"] or 0
    parts = [
        drawn(one.where(F.col("label") == k), F.xxhash64("doc_id"), "doc_id", rows, per_label)
        for k, rows in ((0, count["n"] - good), (1, good))
    ]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")  # at most 2 * per_label rows
        .where(F.octet_length("text") <= LONGEST)
        .groupBy("doc_id", "label", "at")
        .agg(F.min("text").alias("text"))
        .select("at", "label", "text")
        .toArrow()
        .sort_by([("at", "ascending"), ("text", "ascending")])
    )
    return (
        rows["text"].combine_chunks().cast(pa.string()),
        np.asarray(rows["label"].to_numpy(), np.int64),
        share,
    )


def halves(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that a model is fitted on, and those its probabilities are calibrated on."""
    at = np.arange(n)
    return at[at % 3 != 0], at[at % 3 == 0]


def _columns(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return x[:, None] if x.ndim == 1 else x


def calibrate(x: np.ndarray, y: np.ndarray, share: float, steps: int = 60) -> np.ndarray:
    """Logistic curve (offset, slopes) from raw scores to the probability of label 1.

    Newton's method on smoothed targets, which keeps separable labels finite; labels weigh as
    they are shared among all labelled rows (``share`` of label 1), not as in the sample. Without
    both labels the curve is flat at that share.
    """
    x = _columns(x)
    good, bad = int((y == 1).sum()), int((y == 0).sum())
    if not good or not bad:
        return np.concatenate(([np.log(share / (1 - share))], np.zeros(x.shape[1])))
    mean, scale = x.mean(0), x.std(0) + 1e-12
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    weight = np.where(y == 1, share / good, (1 - share) / bad) * len(y)
    ridge = 1e-2 * np.eye(z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = probability(z @ w)
        step = np.linalg.solve(
            (z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (p - target)) + ridge @ w
        )
        w = w - step / max(1.0, np.abs(step).max())
    slopes = w[1:] / scale
    return np.concatenate(([w[0] - (slopes * mean).sum()], slopes))


def probability(x: np.ndarray, curve: np.ndarray | None = None) -> np.ndarray:
    """Logistic function of a raw score, or of the scores' value on a curve."""
    if curve is not None:
        x = curve[0] + _columns(x) @ curve[1:]
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
