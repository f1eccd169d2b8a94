"""Quality classifier: which of two zstandard dictionaries makes a text smaller.

One dictionary is built from good and one from bad labelled texts. A text is compressed in
pieces with either. The difference of the two sizes over their sum and how far the text shrinks
are turned into a probability by a logistic curve fitted on labelled rows that built neither
dictionary (the second tells apart texts that repeat themselves, which either dictionary makes
equally small).

Null and empty texts have a difference of 0 and do not shrink. Repeated rows give repeated results, an empty table
none; without labels of both kinds every score is the smoothed share of label 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flaskmill.llm import labelled
from flaskmill.llm.texts import strings

#: Long texts are compressed piece by piece; within one piece the dictionary still matters.
PIECE = 4096
DICTIONARY = 112_640
LEVEL = 3


def build_dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """Dictionary of the texts; where they are too few to train one, the texts themselves."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-size:]


def _compressor(dictionary: bytes):
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=LEVEL)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data)


#: Bytes added to both sizes, so that the noise in a few words does not decide.
SMOOTH = 48


def differences(texts: pa.Array, good: bytes, bad: bytes) -> np.ndarray:
    """Per text the normalised size difference, positive if the good dictionary fits better, and
    the log of the compressed share of the text and its square."""
    by_good, by_bad = _compressor(good), _compressor(bad)
    frame = len(by_good.compress(b""))
    sizes = np.zeros((len(texts), 3))
    for i, text in enumerate(texts.cast(pa.binary())):
        raw = text.as_py()
        g = b = 0
        for at in range(0, len(raw), PIECE):
            piece = raw[at : at + PIECE]
            g += len(by_good.compress(piece)) - frame
            b += len(by_bad.compress(piece)) - frame
        sizes[i] = g, b, len(raw)
    g, b, n = sizes.T
    shrink = np.log((np.minimum(g, b) + SMOOTH) / (n + SMOOTH))
    return np.column_stack([(b - g) / (b + g + SMOOTH), shrink, shrink * shrink])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = labelled.PER_LABEL) -> dict:
    """Dictionaries and calibration, from a bounded sample of the labels not held out."""
    texts, y, share = labelled.sample(docs, labels, per_label=per_label)
    build, check = labelled.halves(len(y))
    raw = texts.cast(pa.binary()).to_pylist()
    good = build_dictionary([raw[i] for i in build if y[i] == 1])
    bad = build_dictionary([raw[i] for i in build if y[i] == 0])
    x = differences(texts.take(pa.array(check)), good, bad)
    return {"good": good, "bad": bad, "curve": labelled.calibrate(x, y[check], share)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of ``docs`` and ``score`` (probability of label 1) of each whole text.

    A column named score is replaced.
    """
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType(), False)])

    def run(batches):
        for batch in batches:
            texts = strings(batch.column(batch.schema.get_field_index("text")))
            p = labelled.probability(
                differences(texts, model["good"], model["bad"]), model["curve"]
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p)], names=[*batch.schema.names, "score"]
            )

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score reaches the threshold)."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        labelled.held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def reject_bad(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with the same columns."""
    return score(docs, fit(docs, labels)).where(F.col("score") >= threshold).select(*docs.columns)
