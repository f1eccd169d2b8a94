"""Benchmark decontamination: item-sized windows by SimHash, then weighted shingles.

Texts are compared as words in lower case without ASCII signs, in shingles of five words. Each
item has a 64-bit SimHash of its shingles, weighted by how often they stand in it. For every
item length, windows of that many words slide over a document; a window that shares no shingle
with any item has similarity 0 and needs no fingerprint, all others get one. ``RADIUS + 1`` bit
blocks index the item fingerprints: two fingerprints within ``RADIUS`` bits agree on one block
at least, so the index finds every item within the radius of a window. Each such pair is then
verified by weighted Jaccard similarity of the shingle counts, sum of minima over sum of maxima.

Windows reach from the first to the last place where a window can lie; a document shorter than
an item is one window for it. Items or documents without words match nothing. An item of fewer
than five words is one shingle of its own size: its windows match where all words are equal. Null
texts count as empty. Items with a null id are items too and give a null id. Items with equal text
give equal rows; repeated documents give repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flaskmill.llm.texts import SHINGLE, bare_words, shingles, slices, window_hashes

SIMILARITY = 0.8
#: At similarity 0.8 two fingerprints differ in about 10 of 64 bits; 18 leaves a wide margin.
RADIUS = 18
#: Items compared in one pass over the documents. A larger benchmark takes several passes.
ITEMS = 20_000
#: Places of a document whose windows are fingerprinted at a time.
STRETCH = 1 << 14


def fingerprint(value: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """SimHash of each of ``n`` sets of weighted hashes; empty sets have 0."""
    out = np.zeros(n, np.uint64)
    for bit in range(64):
        sign = ((value >> np.uint64(bit)) & np.uint64(1)).astype(np.float64) * 2 - 1
        out |= (np.bincount(owner, weights=sign * weight, minlength=n) > 0).astype(np.uint64) << np.uint64(bit)
    return out


def block_edges(radius: int) -> list[int]:
    return [64 * k // (radius + 1) for k in range(radius + 2)]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Index:
    """Items of one pass: shingle counts, fingerprints and the blocks of their bits."""

    def __init__(self, ids: list[int | None], texts: pa.Array, radius: int = RADIUS):
        self.ids = np.asarray([0 if i is None else i for i in ids], np.int64)
        self.no_id = np.asarray([i is None for i in ids], bool)
        word, first = bare_words(texts)
        self.length = np.diff(first)
        # for each length under a shingle, the items' hashes in order and the items
        self.short = {}
        for size in range(1, SHINGLE):
            items = np.flatnonzero(self.length == size)
            if len(items):
                key = window_hashes(word, size)[first[items]]
                order = np.argsort(key, kind="stable")
                self.short[size] = (key[order], items[order])
        value, owner = shingles(word, first)
        key = np.lexsort((value, owner))
        value, owner = value[key], owner[key]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        self.value, self.owner = value[at], owner[at]
        self.count = np.diff(np.concatenate((at, [len(value)])))
        self.start = np.searchsorted(self.owner, np.arange(len(self.ids) + 1))
        self.total = np.bincount(self.owner, weights=self.count, minlength=len(self.ids))
        self.print = fingerprint(self.value, self.count, self.owner, len(self.ids))
        self.known = np.unique(self.value)
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.known >> np.uint64(48)).astype(np.int64)] = True
        self.radius = radius
        edges = block_edges(radius)
        self.blocks = list(zip(edges[:-1], edges[1:], strict=True))
        self.lengths = np.unique(self.length[self.length > 0])
        # for each block, the items in order of their length and the block's bits
        self.tables = []
        for low, high in self.blocks:
            key = self._keys(self.print, self.length, low, high)
            order = np.argsort(key, kind="stable")
            self.tables.append((key[order], order))

    @staticmethod
    def _keys(value: np.ndarray, length: np.ndarray, low: int, high: int) -> np.ndarray:
        bits = (value >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        return (length.astype(np.uint64) << np.uint64(high - low)) | bits

    def is_known(self, value: np.ndarray) -> np.ndarray:
        out = self.gate[(value >> np.uint64(48)).astype(np.int64)]
        at = np.flatnonzero(out)
        near = np.searchsorted(self.known, value[at])
        out[at] = self.known[np.minimum(near, len(self.known) - 1)] == value[at] if len(self.known) else False
        return out

    def near(self, prints: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of the same length within the radius, each once."""
        pairs = []
        for (low, high), (keys, items) in zip(self.blocks, self.tables, strict=True):
            mine = self._keys(prints, length, low, high)
            left, right = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            n = right - left
            window = np.repeat(np.arange(len(prints)), n)
            item = items[np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            close = distance(prints[window], self.print[item]) <= self.radius
            pairs.append(window[close] * len(self.ids) + item[close])
        both = np.unique(np.concatenate(pairs))
        return both // max(1, len(self.ids)), both % max(1, len(self.ids))

    def similarity(self, value: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's."""
        mine, count = np.unique(value, return_counts=True)
        s = slice(self.start[item], self.start[item + 1])
        at = np.searchsorted(mine, self.value[s])
        ok = at < len(mine)
        ok[ok] = mine[at[ok]] == self.value[s][ok]
        both = np.minimum(count[at[ok]], self.count[s][ok]).sum()
        return float(both / (len(value) + self.total[item] - both))


def _windows(whole: np.ndarray, n_words: int, seeds: np.ndarray, lengths: np.ndarray):
    """(begin, length, fingerprint) of the windows of a document that hold a seed.

    Fingerprints come from running sums of the shingles' bits as signs, over one stretch of the
    document at a time.
    """
    reach = max(1, int(min(lengths[-1], n_words)) - SHINGLE + 1)
    for group in np.split(seeds, np.flatnonzero(np.diff(seeds) > reach) + 1):
        low, high = max(0, int(group[0]) - reach + 1), int(group[-1]) + 1
        for at in range(low, high, STRETCH):
            end = min(high, at + STRETCH)
            stretch = np.ascontiguousarray(whole[at : end + reach])
            bits = np.unpackbits(stretch.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            run = np.zeros((len(stretch) + 1, 64), np.int32)
            np.cumsum(bits.astype(np.int8) * 2 - 1, axis=0, out=run[1:], dtype=np.int32)
            for length in lengths.tolist():
                size = min(length, n_words)
                per = min(max(1, size - SHINGLE + 1), len(whole))
                begin = np.arange(at, min(end, n_words - size + 1, len(whole) - per + 1))
                # the next seed from the window's begin on lies in the window
                next_seed = np.searchsorted(group, begin)
                holds = next_seed < len(group)
                holds[holds] = group[next_seed[holds]] < begin[holds] + per
                begin = begin[holds]
                over = run[begin - at + per] > run[begin - at]
                prints = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
                yield begin, np.full(len(begin), length), prints


def _document(word: np.ndarray, index: Index, seeds: np.ndarray, least: float):
    """Best window of each matching item in one document: (item, first word, words, similarity).

    ``seeds``: places of shingles that some item holds. Of equally similar windows the first.
    """
    best: dict[int, tuple[float, int, int]] = {}
    whole = window_hashes(word, min(SHINGLE, len(word)))
    found = list(_windows(whole, len(word), seeds, index.lengths))
    begin, length, prints = (np.concatenate(x) for x in zip(*found, strict=True))
    window, item = index.near(prints, length)
    for w, i in zip(window.tolist(), item.tolist(), strict=True):
        at, size = int(begin[w]), min(int(length[w]), len(word))
        s = index.similarity(whole[at : at + min(max(1, size - SHINGLE + 1), len(whole))], i)
        if s >= least and (-s, at) < (-best.get(i, (0.0, 0, 0))[0], best.get(i, (0.0, 0, 0))[1]):
            best[i] = (s, at, size)
    return [(item, w, n, s) for item, (s, w, n) in sorted(best.items())]


def _short_items(word: np.ndarray, first: np.ndarray, index: Index) -> dict[int, dict[int, tuple[int, int]]]:
    """text: {item: (first word, words)} of items under a shingle, at their first place in the text."""
    out: dict[int, dict[int, tuple[int, int]]] = {}
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for size, (keys, items) in index.short.items():
        whole = window_hashes(word, size)
        left, right = np.searchsorted(keys, whole, "left"), np.searchsorted(keys, whole, "right")
        at = np.flatnonzero(right > left)
        at = at[at + size <= first[text[at] + 1]]
        _, once = np.unique(text[at] * (len(keys) + 1) + left[at], return_index=True)
        for a in at[once].tolist():
            mine = out.setdefault(int(text[a]), {})
            for item in items[left[a] : right[a]].tolist():
                mine[item] = (a - int(first[text[a]]), size)
    return out


def _matches(texts: pa.Array, index: Index, least: float):
    """(row, matches) of the texts that match some item."""
    word, first = bare_words(texts)
    short = _short_items(word, first, index) if least <= 1 else {}
    value, text = shingles(word, first)
    hit = index.is_known(value)
    start = np.searchsorted(text, np.arange(len(texts) + 1))
    for i in np.union1d(text[hit], np.asarray(list(short), np.int64)).astype(np.int64).tolist():
        seeds = np.flatnonzero(hit[start[i] : start[i + 1]])
        found = _document(word[first[i] : first[i + 1]], index, seeds, least) if len(seeds) else []
        if i in short:
            rest = [f for f in found if f[0] not in short[i]]
            found = sorted(rest + [(item, at, size, 1.0) for item, (at, size) in short[i].items()])
        if found:
            yield i, found


FOUND = [
    T.StructField("item_id", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("similarity", T.DoubleType()),
]


def _pass(docs: DataFrame, index: Index, least: float) -> DataFrame:
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            owner = batch.select(names)
            for row, _, texts in slices(batch.column(batch.schema.get_field_index("text"))):
                at, rows = [], []
                for i, found in _matches(texts, index, least):
                    at += [row + i] * len(found)
                    rows += found
                item, w, n, s = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
                part = owner.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array(index.ids[item := np.asarray(item, np.int64)], pa.int64(), mask=index.no_id[item]),
                        pa.array(w, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.float64()),
                    ],
                    names=[*names, *(f.name for f in FOUND)],
                )

    schema = T.StructType([docs.schema[c] for c in names] + FOUND)
    return docs.select(*names, "text").mapInArrow(run, schema)


def passes(benchmark: DataFrame, items: int = ITEMS):
    """Indexes of at most ``items`` items each, read one after another in order of their ids."""
    texts = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, -(-texts.count() // items))
    for k in range(parts):
        part = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else texts
        rows = part.orderBy("item_id", "text").toArrow()
        yield Index(rows["item_id"].to_pylist(), rows["text"].combine_chunks().cast(pa.string()))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, items: int = ITEMS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: the best window of each document for each
    item that it holds with at least ``least`` similarity."""
    out = None
    for index in passes(benchmark, items):
        found = _pass(docs.select("doc_id", "text"), index, least)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no item, with the same columns."""
    text_at, schema = docs.columns.index("text"), T.StructType(docs.schema.fields)
    for index in passes(benchmark):

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, _, texts in slices(batch.column(text_at)):
                    keep[[row + i for i, _ in _matches(texts, index, least)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
