"""Quality rules: counts of a text against fixed limits, then a hashed n-gram classifier.

The classifier is a logistic regression on hashed character 3-grams, words and word pairs, each
as its share of the text's n-grams of that kind, so that length does not decide. It is fitted on
a bounded sample of labelled rows, its probability is calibrated on others, and texts are scored
in Arrow batches against fixed thresholds.

Null texts count as empty; texts that fail a base rule are not kept whatever their score.
Repeated rows give repeated results. Without labels of both kinds nothing but the base rules
decides (the threshold is then passed by all).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flaskmill.llm import labelled
from flaskmill.llm.texts import (
    IS_SPACE,
    buffer,
    mix,
    slices,
    span_hashes,
    spans,
    window_hashes,
    words,
)

BITS = 16
KINDS = 3  # character 3-grams, words, word pairs
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
KEEP = 0.5

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flag: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))[starts])


def _first_of(text: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(text, np.arange(n + 1))


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the key occurs before; it occurs twice or more."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    before, more = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order] = same[:-1]
    more[order] = same[:-1] | same[1:]
    return before, more


class Slice:
    """Words of the texts of one slice and what both the rules and the classifier need."""

    def __init__(self, texts: pa.Array):
        self.data, self.starts = buffer(texts)
        self.n = len(texts)
        self.begin, self.end, self.text = words(self.data, self.starts)
        self.hash = span_hashes(self.data, self.begin, self.end)
        self.first = _first_of(self.text, self.n)
        self.count = np.diff(self.first)

    def keyed(self, value: np.ndarray, text: np.ndarray) -> np.ndarray:
        return mix(value + (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

    def rules(self) -> dict[str, np.ndarray]:
        solid = ~IS_SPACE[self.data]
        chars = _per_text(solid & ((self.data & 0xC0) != 0x80), self.starts)
        symbols = _per_text(IS_SYMBOL[self.data], self.starts)
        begin, end, text = spans(self.data != 10, self.starts)
        total = np.concatenate(([0], np.cumsum(solid)))
        with_word = total[end] > total[begin]
        line = span_hashes(self.data, begin, end)[with_word]
        before, _ = _again(self.keyed(line, text[with_word]))
        dup = np.bincount(text[with_word][before], minlength=self.n)
        size = 3
        inside = (np.arange(len(self.hash)) + size <= self.first[1:][self.text])[
            : max(0, len(self.hash) - size + 1)
        ]
        three, owner = window_hashes(self.hash, size)[inside], self.text[: len(inside)][inside]
        _, more = _again(self.keyed(three, owner))
        mark = np.zeros(len(self.hash) + 1, bool)
        at = np.flatnonzero(inside)[more]
        for k in range(size):
            mark[at + k] = True
        repeated = _per_text(mark[:-1], self.first)
        failed = (self.count < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * self.count)
        return {
            "n_words": self.count,
            "word_chars": chars,
            "n_symbols": symbols,
            "n_dup_lines": dup,
            "n_repeat_words": repeated,
            "base_failed": failed,
        }

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per kind the hashed index of each n-gram and the text it belongs to."""
        data, length = self.data, np.diff(self.starts)
        grams = max(0, len(data) - 2)
        wide = data.astype(np.uint32)
        code = wide[:grams] | (wide[1 : grams + 1] << 8) | (wide[2 : grams + 2] << 16)
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        owner = np.repeat(np.arange(self.n, dtype=np.int32), length)[:grams]
        ok = np.ones(grams, bool)
        for back in (1, 2):
            at = self.starts[1:] - back
            at = at[(at >= 0) & (at < grams)]
            ok[at] = False
        shift = np.uint64(64 - BITS)
        pair = window_hashes(self.hash, 2)
        inside = self.text[:-1] == self.text[1:]
        return [
            (code[ok], owner[ok]),
            ((self.hash >> shift), self.text),
            ((pair >> shift)[inside], self.text[: len(pair)][inside]),
        ]


def raw_scores(part: Slice, weights: np.ndarray) -> np.ndarray:
    """Sum over kinds of the mean weight of the text's n-grams."""
    total = np.zeros(part.n)
    for kind, (at, text) in enumerate(part.features()):
        got = np.bincount(text, weights=weights[kind][at], minlength=part.n)
        total += got / np.maximum(1, np.bincount(text, minlength=part.n))
    return total


def train(texts: pa.Array, y: np.ndarray, steps: int = 150, decay: float = 1e-5) -> np.ndarray:
    """Weights by kind: full-batch Adam on the logistic loss, either label counting alike."""
    size = 1 << BITS
    rows, cols, vals, n = [], [], [], 0
    for _, _, texts_part in slices(texts):
        part = Slice(texts_part)
        for kind, (at, text) in enumerate(part.features()):
            key = text.astype(np.int64) * size + at.astype(np.int64)
            key, count = np.unique(key, return_counts=True)
            row = key // size
            share = count / np.maximum(1, np.bincount(text, minlength=part.n))[row]
            rows.append(row + n)
            cols.append(key % size + kind * size)
            vals.append(share)
        n += part.n
    row, col, val = map(np.concatenate, (rows, cols, vals))
    w, m, v, bias = np.zeros(KINDS * size), np.zeros(KINDS * size), np.zeros(KINDS * size), 0.0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[col] * val, minlength=n) + bias
        g = weight * (labelled.probability(z) - y)
        grad = np.bincount(col, weights=g[row] * val, minlength=len(w)) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= 0.5 * g.sum()
    return w.reshape(KINDS, size).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = labelled.PER_LABEL) -> dict:
    """Weights and calibration, from a bounded sample of the labels not held out."""
    texts, y, share = labelled.sample(docs, labels, per_label=per_label)
    if len(set(y.tolist())) < 2:
        return {"weights": np.zeros((KINDS, 1 << BITS), np.float32), "curve": np.array([30.0, 0.0])}
    build, check = labelled.halves(len(y))
    weights = train(texts.take(pa.array(build)), y[build])
    x = np.concatenate(
        [raw_scores(Slice(p), weights) for _, _, p in slices(texts.take(pa.array(check)))] or [[]]
    )
    return {"weights": weights, "curve": labelled.calibrate(x, y[check], share)}


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, score double, kept boolean"
)


def apply_rules(docs: DataFrame, model: dict, keep: float = KEEP) -> DataFrame:
    """Counts, score and verdict of each whole text."""

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for row, end, texts in slices(column):
                part = Slice(texts)
                base = part.rules()
                p = labelled.probability(raw_scores(part, model["weights"]), model["curve"])
                kept = ~base["base_failed"] & (p >= keep)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, end - row)]
                    + [pa.array(x if x.dtype == bool else x.astype(np.int64)) for x in base.values()]
                    + [pa.array(p), pa.array(kept)],
                    names=["doc_id", *base, "score", "kept"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def judge(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    return apply_rules(docs, fit(docs, labels), keep)
