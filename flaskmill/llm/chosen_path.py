"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles (words in lower case without ASCII signs). Documents of
equal sets form a *text*, which is joined once, with the number of its documents.

* A text is embedded as ``COORDINATES`` minimum hashes; two texts agree on a coordinate with the
  probability of their Jaccard similarity.
* From the root of each run, a node of the recursion picks each coordinate with probability
  ``1 / (SIMILARITY * COORDINATES)``, by a hash of its own path, and sends a text on to the child
  named by the coordinate and the text's value there. Texts that share a child share that value.
  A pair at the threshold survives a level in one child on average, dissimilar pairs die out.
* A node of at most ``BUCKET`` texts is brute-forced; larger ones recurse. What is still larger at
  the last level is brute-forced in blocks, each pair of blocks in a task of its own.
* ``RUNS`` independent runs bring the recall of a pair at the threshold above 0.999; ``recall``
  computes it.

Candidates (pairs whose minimum hashes agree on ``NEAR`` coordinates at least, a margin of more
than four deviations below the threshold) are handed on as spanning links of each bucket, never as
all pairs. Inside each connected group of candidates every pair of texts is then verified by exact
Jaccard similarity of whole shingle sets, again in blocks, and counted where it is verified.

Null texts count as empty. Documents without words have equal (empty) sets; texts of fewer than
five words are one shingle. Repeated rows are documents of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flaskmill.llm.components import connected
from flaskmill.llm.texts import bare_words, mix, shared_rows, shingles, slices

SIMILARITY = 0.8
COORDINATES = 64
RUNS = 16
DEPTH = 3
BUCKET = 128
NEAR = 37
#: Texts of a block in large nodes (signatures of 128 bytes each) and in large groups of candidates
#: (whole texts).
NODE_BLOCK = 1024
BLOCK = 256
SEED = 29

_ODD = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) + np.uint64(SEED << 8)) | np.uint64(1)
_ADD = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) + np.uint64(SEED << 20))


def recall(similarity: float = SIMILARITY, depth: int = DEPTH, runs: int = RUNS) -> float:
    """Chance that a pair of this similarity meets in a bucket ``depth`` levels down, at least."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive * similarity / SIMILARITY)
    return 1 - (1 - alive) ** runs


def unique_sets(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each owner in ascending order, once each."""
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], owner[new]


def signatures(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(sets, COORDINATES) minimum hashes of 16 bits; empty sets have 0."""
    out = np.zeros((len(start) - 1, COORDINATES), np.uint16)
    some = np.flatnonzero(np.diff(start) > 0)
    if len(some):
        for k in range(COORDINATES):
            hashed = (value * _ODD[k] + _ADD[k]) >> np.uint64(24)
            # the least of 40 bits, of which the lower 16 are kept
            out[some, k] = np.minimum.reduceat(hashed, start[:-1][some]).astype(np.uint16)
    return out


def set_keys(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Two rows, the halves of the 128-bit key of each set."""
    raw = value.tobytes()
    ends = zip(start[:-1].tolist(), start[1:].tolist(), strict=True)
    keys = b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in ends)
    return np.frombuffer(keys, np.int64).reshape(-1, 2).T


def read_sets(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (128-bit key of the set), size, sig."""

    def run(batches):
        for batch in batches:
            for row, end, texts in slices(batch.column(1)):
                n = end - row
                value, owner = unique_sets(*shingles(*bare_words(texts)))
                start = np.searchsorted(owner, np.arange(n + 1))
                sig = signatures(value, start)
                k1, k2 = set_keys(value, start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n), pa.array(k1), pa.array(k2),
                        pa.array(np.diff(start), pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary()),
                    ],
                    names=["doc_id", "k1", "k2", "size", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, size long, sig binary")


def _sig(column: pa.Array) -> np.ndarray:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset]
    size = len(column) * COORDINATES
    return np.frombuffer(data, np.uint16, size, int(at)).reshape(-1, COORDINATES) if size else np.zeros((0, COORDINATES), np.uint16)


# --- the recursion ------------------------------------------------------------------------

_LIMIT = np.uint64(int(2**64 / (SIMILARITY * COORDINATES)) - 1)


def children(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) for every coordinate that a row's node picks."""
    pick = mix(node[:, None] ^ _ODD[None, :]) <= _LIMIT
    row, k = np.nonzero(pick)
    return row, mix(mix(node[row] + _ADD[k]) ^ (sig[row, k].astype(np.uint64) + np.uint64(1)) * _ODD[k])


def _first_level(texts: DataFrame) -> DataFrame:
    roots = mix(np.arange(1, RUNS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches):
        for batch in batches:
            ids, sig = batch.column(0), _sig(batch.column(1))
            for root in roots:
                row, node = children(np.full(len(sig), root, np.uint64), sig)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(node.view(np.int64))], names=["id", "node"])

    return texts.select("id", "sig").mapInArrow(run, "id long, node long")


def _next_level(members: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            node = np.asarray(batch.column(1).to_numpy()).view(np.uint64)
            row, child = children(node, _sig(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(child.view(np.int64))], names=["id", "node"])

    return members.select("id", "node", "sig").mapInArrow(run, "id long, node long")


def spanning(near: np.ndarray) -> np.ndarray:
    """(first row, other row) pairs that connect what the symmetric matrix ``near`` connects."""
    seen, out = np.zeros(len(near), bool), []
    for i in range(len(near)):
        if seen[i]:
            continue
        seen[i] = True
        members, front = [], np.asarray([i])
        while len(front):
            front = np.flatnonzero(near[front].any(0) & ~seen)
            seen[front] = True
            members.append(front)
        members = np.concatenate(members)
        out.append(np.column_stack([np.full(len(members), i), members]))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def near_rows(sig: np.ndarray) -> np.ndarray:
    """Matrix of the rows that agree on ``NEAR`` coordinates at least."""
    out = np.zeros((len(sig), len(sig)), bool)
    for low in range(0, len(sig), 64):
        out[low : low + 64] = (sig[low : low + 64, None, :] == sig[None, :, :]).sum(2, dtype=np.uint8) >= NEAR
    return out


def _groups(batches, keys: int):
    """Tables of the rows of one key (the first ``keys`` columns), from sorted batches."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        n = table.num_rows
        if not n:
            continue
        cut = np.zeros(n, bool)
        for k in range(keys):
            column = table.column(k).to_numpy()
            cut[1:] |= column[1:] != column[:-1]
        at = np.flatnonzero(cut).tolist()
        for a, b in zip([0, *at][:-1], at, strict=True):
            yield table.slice(a, b - a)
        rest = table.slice(at[-1] if at else 0)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


LINKS = "a long, b long"


def _bucket_links(members: DataFrame) -> DataFrame:
    """Spanning links of the near pairs of each bucket."""

    def run(batches):
        first, second, held = [], [], 0
        for group in _groups(batches, 1):
            if group.num_rows < 2:
                continue
            ids = group.column(1).to_numpy()
            pairs = spanning(near_rows(_sig(group.column(2).combine_chunks())))
            first.append(ids[pairs[:, 0]])
            second.append(ids[pairs[:, 1]])
            held += len(pairs)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], names=["a", "b"])
                first, second, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], names=["a", "b"])

    # in order of id, so that the runs name mostly the same links
    dealt = members.select("node", "id", "sig").repartition("node").sortWithinPartitions("node", "id")
    return dealt.mapInArrow(run, LINKS)


def _in_blocks(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Copies of the rows for each pair of blocks of their group that needs them.

    Adds low, high (the two blocks) and own (the row's block). Groups of one block are not copied.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(group, "id"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    out = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other)
    return out.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "blocks")


def _block_links(members: DataFrame) -> DataFrame:
    """As ``_bucket_links`` for large nodes of the last level, a pair of blocks at a time."""

    def run(batches):
        for group in _groups(batches, 3):
            ids, own = group.column("id").to_numpy(), group.column("own").to_numpy()
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            near = near_rows(_sig(group.column("sig").combine_chunks()))
            if low != high:
                near &= own[:, None] != own[None, :]
            pairs = spanning(near)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], names=["a", "b"])

    dealt = _in_blocks(members, "node", "n", NODE_BLOCK).select("node", "low", "high", "own", "id", "sig")
    keys = ["node", "low", "high"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, LINKS)


def candidates(texts: DataFrame) -> DataFrame:
    """a, b: links that connect all near pairs which share a bucket. ``texts``: id, sig."""
    links = None
    nodes = _first_level(texts)
    for level in range(1, DEPTH + 1):
        nodes = shared_rows(nodes)
        # Written first, so that Spark can split the partitions of very common nodes in the join.
        sizes = shared_rows(nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
        members = shared_rows(nodes.join(sizes, "node").join(texts.select("id", "sig"), "id"))
        found = [_bucket_links(members.where(F.col("n") <= BUCKET))]
        large = members.where(F.col("n") > BUCKET)
        more = not large.isEmpty()
        if more and level == DEPTH:
            found.append(_block_links(large))
        for part in found:
            links = part if links is None else links.unionByName(part)
        if not more:
            break
        nodes = _next_level(large)
    return shared_rows(links.distinct())


# --- verification -------------------------------------------------------------------------


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets (ascending arrays)."""
    n = len(sets)
    if n <= 6:
        out = np.zeros((n, n), np.int64)
        for i in range(n):
            out[i, i] = len(sets[i])
            for j in range(i + 1, n):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    keep = count[column] > 1  # a shingle of one set only is in no intersection
    _, column = np.unique(column[keep], return_inverse=True)
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    width = max(1, min(4096, columns))
    for low in range(0, columns, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((n, width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _verified(rows: DataFrame, least: float) -> DataFrame:
    """id, text_links, doc_links of the row's pairs that are verified here, and one link, which
    together with the others' connects what these pairs connect."""

    def run(batches):
        for group in _groups(batches, 3):
            ids, own = group.column("id").to_numpy(), group.column("own").to_numpy()
            copies = group.column("copies").to_numpy()
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            sets, n = [], group.num_rows
            for _, _, part in slices(group.column("text").combine_chunks()):
                value, owner = unique_sets(*shingles(*bare_words(part)))
                sets += np.split(value, np.searchsorted(owner, np.arange(1, len(part))))
            both = common(sets)
            size = np.asarray([len(s) for s in sets])
            union = size[:, None] + size[None, :] - both
            linked = both >= least * union
            np.fill_diagonal(linked, False)
            if low != high:
                linked &= own[:, None] != own[None, :]
            pairs = spanning(linked)
            link = np.full(n, -1, np.int64)
            link[pairs[:, 1]] = pairs[:, 0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids), pa.array(linked.sum(1).astype(np.int64)),
                    pa.array((linked * copies[None, :]).sum(1).astype(np.int64)),
                    pa.array(ids[np.maximum(link, 0)], mask=link < 0),
                ],
                names=["id", "text_links", "doc_links", "link"],
            )

    keys = ["root", "low", "high"]
    dealt = rows.select(*keys, "own", "id", "copies", "text").repartition(*keys).sortWithinPartitions(*keys, "id")
    return dealt.mapInArrow(run, "id long, text_links long, doc_links long, link long")


def with_set_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with k1, k2 of each row's set; columns of these names are replaced."""
    names = [c for c in docs.columns if c not in ("k1", "k2")]
    text_at = names.index("text")

    def run(batches):
        for batch in batches:
            found = []
            for _, _, texts in slices(batch.column(text_at)):
                value, owner = unique_sets(*shingles(*bare_words(texts)))
                found.append(set_keys(value, np.searchsorted(owner, np.arange(len(texts) + 1))))
            k1, k2 = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k1), pa.array(k2)], names=[*names, "k1", "k2"])

    keys = [T.StructField(k, T.LongType()) for k in ("k1", "k2")]
    return docs.select(*names).mapInArrow(run, T.StructType([docs.schema[c] for c in names] + keys))


def _texts(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2 of every document; what is found about every text)."""
    keys = shared_rows(read_sets(docs.select("doc_id", "text")))
    texts = keys.groupBy("k1", "k2").agg(
        F.count("*").alias("copies"),
        F.min("doc_id").alias("doc"),
        F.first("sig").alias("sig"),
        F.first("size").alias("size"),
    )
    texts = shared_rows(texts.withColumn("id", F.monotonically_increasing_id()))
    links = candidates(texts.where("size > 0"))
    groups = shared_rows(connected(links))
    sizes = groups.groupBy("root").agg(F.count("*").alias("members"))
    wanted = groups.join(sizes, "root").join(texts.select("id", "k1", "k2", "copies"), "id")
    whole = with_set_keys(docs.select("text")).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    rows = _in_blocks(wanted.join(whole, ["k1", "k2"]), "root", "members", BLOCK)
    checked = shared_rows(_verified(rows, least))
    near = checked.where("link IS NOT NULL").select(F.col("id").alias("a"), F.col("link").alias("b"))
    counts = checked.groupBy("id").agg(
        F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links")
    )
    rooted = (
        texts.select("id", "k1", "k2", "copies", "doc")
        .join(connected(near), "id", "left")
        .join(counts, "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    return keys.select("doc_id", "k1", "k2"), shared_rows(rooted)


def join(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """A row for each document: doc_id, class_id, n_links, n_text_links, k1, k2.

    class_id: least doc_id of the documents that are connected by similarities of ``least`` and
    more (null where none has an id). n_links: other documents with such a similarity, copies
    included; n_text_links: other texts (different sets) with it.
    """
    keys, rooted = _texts(docs, least)
    named = rooted.groupBy("root").agg(F.min("doc").alias("class_id"))
    found = rooted.join(named, "root").select(
        "k1",
        "k2",
        "class_id",
        (F.coalesce("doc_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("text_links", F.lit(0)).alias("n_text_links"),
    )
    return keys.join(found, ["k1", "k2"]).select(
        "doc_id", "class_id", "n_links", "n_text_links", "k1", "k2"
    )


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class, with the same columns.

    The row with the least doc_id stays (a null id only where no other has one; of rows with
    that id the one with the least key of its set, and any one of rows equal in both).
    """
    _, rooted = _texts(docs, least)
    first = F.struct(F.col("doc").isNull().alias("none"), "doc", "k1", "k2")
    kept = rooted.groupBy("root").agg(F.min(first).alias("one")).select("one.doc", "one.k1", "one.k2")
    names = docs.columns
    hidden = [f"_kept_{i}" for i in range(len(names))]
    rows = with_set_keys(docs.select("text", *[F.col(f"`{n}`").alias(h) for n, h in zip(names, hidden, strict=True)]))
    id_at = hidden[names.index("doc_id")]
    rows = rows.join(kept.withColumnRenamed("doc", "_doc"), ["k1", "k2"]).where(F.col(id_at).eqNullSafe(F.col("_doc")))
    one = rows.dropDuplicates(["k1", "k2"])
    return one.select(*[F.col(h).alias(n) for n, h in zip(names, hidden, strict=True)])
