"""Token ids of whole texts, packed at a fixed width and read back.

File format: a folder of Parquet part files whose rows are *blocks*. A block holds the ids of
whole documents one after another, each id in the fewest bits that hold the vocabulary, lowest
bit first, without gaps:

    shard    int           part of the id range; shards and blocks ascend with doc_id
    first    long          ids of the shard before this block
    n        int           ids in the block
    width    int           bits of one id
    payload  binary        the packed ids
    doc_id   array<long>   documents of the block, in order
    at       array<int>    index in the block of each document's first id
    n_tokens array<int>    ids of each document, the end id included

Id i of a block starts at bit i * width, so one id, one document or a whole block is unpacked
by the same vectorised read. Blocks hold whole documents and can be read on their own, so a read
may split the files anywhere between blocks. Part files come from Spark's own commit, so retried
tasks leave no half-written blocks and no machine-local file is involved.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from flaskmill.llm.texts import buffer, slices, span_hashes, words

END_ID = 2
BLOCK_IDS = 1 << 16
#: Encoded words (arrays) and runs (Python objects) that a worker remembers; it starts anew beyond.
REMEMBERED = 1_000_000
REMEMBERED_RUNS = 50_000
#: Bytes of text encoded at a time; a larger slice repeats more of its words.
SLICE = 2 << 20

BLOCKS = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("doc_id", T.ArrayType(T.LongType())),
        T.StructField("at", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.ArrayType(T.IntegerType())),
    ]
)


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids at ``width`` bits each, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()  # the same bytes as below
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from index ``first`` on, as unsigned 32-bit integers; ids take 32 bits at most."""
    bit = (np.arange(first, first + count, dtype=np.int64)) * width
    if not count:
        return np.zeros(0, np.uint32)
    low, high = int(bit[0] >> 3), int((bit[-1] + width + 7) >> 3)
    raw = np.concatenate([np.frombuffer(payload, np.uint8)[low:high], np.zeros(8, np.uint8)])
    at, shift = (bit >> 3) - low, (bit & 7).astype(np.uint64)
    value = np.zeros(count, np.uint64)
    for k in range((width + 14) // 8):
        value |= raw[at + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


#: Words of these bytes alone fall into runs of letters, single digits and runs of signs, and
#: each run is one unit of the vocabulary file's own splitting rule. The apostrophe is not among
#: them, and neither is ``<``, with which the special tokens begin.
PLAIN = re.compile(rb"[!-&(-;=-~]+")
RUNS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")


class WordEncoder:
    """Ids of texts, through a tokenizer that never joins across ASCII white space.

    Each different word (by 64-bit hash) is encoded once and remembered. Where the vocabulary
    file lower-cases and splits plain words into runs (found out by ``_plain_runs``), such words
    go straight to the library's BPE model run by run; all others go through its whole chain.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.by_runs = self._plain_runs()
        self._forget()

    def _plain_runs(self) -> bool:
        probe = "The Quick,brown2-FOX(10%)jumps...over|a_lazy#dog! ~x}{y=z;;:q"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        self.runs: dict[str, list[int]] = {}
        return whole == [i for w in probe.split() for i in self._by_runs(w.encode())]

    def _by_runs(self, word: bytes) -> list[int]:
        out = []
        for run in RUNS.findall(word.decode().lower()):
            ids = self.runs.get(run)
            if ids is None:
                ids = self.runs[run] = [t.id for t in self.tokenizer.model.tokenize(run)]
            out += ids
        return out

    def _forget(self):
        self.runs = {}
        self.known = np.zeros(0, np.uint64)  # hashes in order
        self.index = np.zeros(0, np.int64)  # position of each in `offset`
        self.pool = np.zeros(1 << 16, np.uint32)
        self.offset = np.zeros(1, np.int64)

    def _learn(self, hashes: np.ndarray, missing: list[bytes]):
        found: list[list[int]] = [[]] * len(missing)
        rest = []
        for i, word in enumerate(missing):
            if self.by_runs and PLAIN.fullmatch(word):
                found[i] = self._by_runs(word)
            else:
                rest.append(i)
        if rest:
            texts = [missing[i].decode("utf-8", "replace") for i in rest]
            got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for i, e in zip(rest, got, strict=True):
                found[i] = e.ids
        if len(self.runs) > REMEMBERED_RUNS:
            self.runs = {}
        length = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum()))
        used = int(self.offset[-1])
        if used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[:used], np.zeros(used + 2 * len(flat), np.uint32)])
        self.pool[used : used + len(flat)] = flat
        where = np.searchsorted(self.known, hashes)
        new = len(self.offset) - 1 + np.arange(len(hashes))
        self.known = np.insert(self.known, where, hashes)
        self.index = np.insert(self.index, where, new)
        self.offset = np.concatenate([self.offset, used + np.cumsum(length)])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by ``end_id``; number of ids of each text)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        data, starts = buffer(texts)
        begin, end, text = words(data, starts)
        each, one, which = np.unique(
            span_hashes(data, begin, end), return_index=True, return_inverse=True
        )
        at = np.searchsorted(self.known, each)
        old = np.zeros(len(each), bool)
        if len(self.known):
            old = self.known[np.minimum(at, len(self.known) - 1)] == each
        if not old.all():
            raw, new = data.tobytes(), one[~old]
            pairs = zip(begin[new].tolist(), end[new].tolist(), strict=True)
            self._learn(each[~old], [raw[a:b] for a, b in pairs])
        which = self.index[np.searchsorted(self.known, each)][which] if len(each) else which
        first, length = self.offset[which], self.offset[which + 1] - self.offset[which]
        before = np.concatenate(([0], np.cumsum(length)))
        take = np.arange(before[-1]) + np.repeat(first - before[:-1], length)
        ends = before[np.searchsorted(text, np.arange(1, len(starts)))]
        counts = np.diff(np.concatenate(([0], ends))) + 1
        return np.insert(self.pool[take], ends, np.uint32(end_id)), counts


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(model: str) -> WordEncoder:
    key = zlib.crc32(model.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(model)
    return _ENCODERS[key]


def vocabulary_bits(model: str) -> int:
    from tokenizers import Tokenizer

    return max(1, (Tokenizer.from_str(model).get_vocab_size(with_added_tokens=True) - 1).bit_length())


def write_blocks(
    docs: DataFrame, path: str, model: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS
) -> None:
    """Encode every whole text and write the blocks, in ascending doc_id order.

    Null texts count as empty (one id, the end id); null ids come first; repeated ids are kept,
    in the order of their texts' digest. An empty table writes no blocks.
    """
    width = max(vocabulary_bits(model), int(end_id).bit_length())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one vocabulary file

    def run(batches):
        encoder = _encoder(shared.value)
        shard, first = TaskContext.get().partitionId(), 0
        ids, doc_ids, counts, size = [], [], [], 0

        def block():
            nonlocal first, size
            flat, n = np.concatenate(ids), np.asarray(counts, np.int64)
            row = {
                "shard": shard, "first": first, "n": len(flat), "width": width,
                "payload": pack(flat, width), "doc_id": list(doc_ids),
                "at": (np.cumsum(n) - n).tolist(), "n_tokens": n.tolist(),
            }
            first += len(flat)
            ids.clear(), doc_ids.clear(), counts.clear()
            size = 0
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            owner = batch.column(0).to_pylist()
            for row, end, texts in slices(batch.column(1), SLICE):
                flat, n = encoder.encode(texts, end_id)
                at = 0
                for doc, count in zip(owner[row:end], n.tolist(), strict=True):
                    ids.append(flat[at : at + count])
                    doc_ids.append(doc)
                    counts.append(count)
                    at += count
                    size += count
                    if size >= block_ids:
                        yield block()
        if counts:
            yield block()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(BLOCKS)
    tie = F.xxhash64("text")
    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id", tie)
        .sortWithinPartitions("doc_id", tie)
    )
    ordered.mapInArrow(run, BLOCKS).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """shard, shard_start: ids of all shards before; a row for each part file."""
    totals = blocks.groupBy("shard").agg(F.sum("n").alias("ids"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))


def document_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, unpacked from the blocks."""

    def run(batches):
        for batch in batches:
            for block in batch.to_pylist():
                ids = unpack(block["payload"], block["width"], 0, block["n"]).astype("<u4")
                at, n = np.asarray(block["at"], np.int64), np.asarray(block["n_tokens"], np.int64)
                crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["doc_id"], pa.int64()),
                        pa.array(at + (block["first"] + block["shard_start"])),
                        pa.array(n),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = blocks.join(F.broadcast(shard_starts(blocks)), "shard")  # a row for each part file
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(blocks: DataFrame, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of one document (of each, where its id repeats)."""
    found = blocks.where(F.array_contains("doc_id", doc_id)).collect()
    return [
        unpack(b["payload"], b["width"], a, n)
        for b in found
        for d, a, n in zip(b["doc_id"], b["at"], b["n_tokens"], strict=True)
        if d == doc_id
    ]
