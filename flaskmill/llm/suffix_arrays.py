"""Repeated passages by suffix arrays: every byte under a string of ``LENGTH`` bytes that also
starts anywhere else is removed.

1. *Anchors.* A window of ``LENGTH`` bytes picks its smallest hashed ``GRAM`` (the leftmost of
   equals), so equal windows pick equal grams at equal places. The windows that pick one gram lie
   side by side; with their bytes they are the gram's *context*. Windows can only be equal
   if their grams are, so grams that occur once are done with, and equal contexts are kept once
   with their number.
2. *Shards.* The contexts are dealt into shards by their gram; the contexts of a very common gram
   are dealt over several. Per shard a suffix array is refined by prefix doubling in the manner
   of Larsson and Sadakane (only groups that are still unsorted are sorted again), and common
   prefixes are taken as Kasai does: along the text a prefix shrinks by one at most, so bytes are
   only compared where the neighbour changes. A window repeats if its prefix with a neighbour
   reaches ``LENGTH`` or its context stands for several.
3. *Merging.* Shards of a gram that was dealt over several give out their different windows as
   sorted 128-bit digests; equal ranges of all those lists meet in one task, where each window is
   looked up in the merged list by binary search.
4. The repeated windows go back to all texts with that context, and each text is cut.

Texts are UTF-8 bytes; null counts as empty. Matches never cross texts; repeated rows repeat each
other. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flaskmill.llm.texts import buffer, mix, shared_rows, slices

LENGTH = 400
GRAM = 32
#: Bytes of contexts in a shard, about; contexts of one gram that lie in one shard at most.
SHARD_BYTES = 2 << 20
TOGETHER = 1024
#: Positions worked on at a time; the low bits of a key hold the position.
STEP = 1 << 20
_BITS = np.uint64(21)


# --- anchors ------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` bytes (a power of two) from each position."""
    h, width, factor = mix(data.astype(np.uint64) + np.uint64(1)), 1, 0x9E3779B97F4A7C15
    while width < size:
        h = h[:-width] * np.uint64(factor) + h[width:] if len(h) > width else h[:0]
        factor = (factor * factor | 1) & (2**64 - 1)
        width *= 2
    return mix(h)


def sliding_min(key: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        key = np.minimum(key[:-width], key[width:]) if len(key) > width else key[:0]
        width *= 2
    rest = size - width
    return np.minimum(key[: len(key) - rest], key[rest:]) if len(key) > rest else key[:0]


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, place, first, last, hash) of the anchors of texts of ``STEP`` bytes in all, about.

    ``first`` and ``last`` are the first and last window that pick the gram at ``place``.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64)
    h = gram_hashes(data, gram)
    key = ((h >> _BITS) << _BITS) | np.arange(len(h), dtype=np.uint64)
    low = sliding_min(key, length - gram + 1)
    pick = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
    end = np.repeat(starts[1:], np.diff(starts))[: len(pick)]
    at = np.flatnonzero(np.arange(len(pick)) + length <= end)  # windows inside one text
    if not len(at):
        return none, none, none, none, none.astype(np.uint64)
    pick = pick[at]
    new = np.ones(len(at), bool)
    new[1:] = pick[1:] != pick[:-1]
    head = np.flatnonzero(new)
    first, last = at[head], at[np.concatenate((head[1:], [len(at)])) - 1]
    place = pick[head]
    text = np.searchsorted(starts, place, "right") - 1
    return text, place - starts[text], first - starts[text], last - starts[text], h[place]


ANCHORS = "k1 long, k2 long, h long, c long, first int, last int"


def find_anchors(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row for each anchor of each text (``k1``, ``k2``, ``text``): gram, context, its windows."""

    def run(batches):
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            for row, _, part in slices(batch.column(2), STEP):
                data, starts = buffer(part)
                for low in range(0, max(1, len(data)), STEP):
                    # a text longer than a step comes alone and is gone through in steps
                    some, own = data, starts
                    if len(data) > STEP:
                        some = data[low : low + STEP + length - 1]
                        own = np.asarray([0, len(some)])
                    elif low:
                        break
                    text, _, first, last, h = anchors(some, own, length, gram)
                    raw = some.tobytes()
                    begin, end = own[text] + first, own[text] + last + length
                    c = np.fromiter(
                        (xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)),
                        np.uint64, len(text),
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(k1[row + text]), pa.array(k2[row + text]),
                            pa.array(h.view(np.int64)), pa.array(c.view(np.int64)),
                            pa.array((low + first).astype(np.int32)), pa.array((low + last).astype(np.int32)),
                        ],
                        names=["k1", "k2", "h", "c", "first", "last"],
                    )

    return texts.select("k1", "k2", "text").mapInArrow(run, ANCHORS)


# --- suffix arrays ------------------------------------------------------------------------


def suffix_array(data: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(positions ordered by their first ``depth`` bytes, rank of each position's group).

    Larsson-Sadakane refinement: the first order is by eight bytes; a round doubles the depth by
    the ranks of the positions that far ahead, for groups of more than one position only. Equal
    ranks mean equal bytes up to ``depth`` for positions that have so many bytes left.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : n + k]
    order = np.argsort(key, kind="stable").astype(np.int32)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0)).astype(np.int32)
    rank = np.zeros(n + depth, np.int32) - 1
    rank[order] = group
    done = 8
    while done < depth:
        step = min(done, depth - done)
        size_one = np.ones(n, bool)  # sorted groups are skipped
        size_one[:-1] &= group[1:] != group[:-1]
        size_one[1:] &= group[1:] != group[:-1]
        at = np.flatnonzero(~size_one)
        if not len(at):
            break
        position = order[at]
        pair = (group[at].astype(np.int64) << 32) | (rank[position + step].astype(np.int64) + 1)
        again = np.argsort(pair, kind="stable")
        position, pair = position[again], pair[again]
        order[at] = position
        new = np.ones(len(at), bool)
        new[1:] = pair[1:] != pair[:-1]
        group[at] = np.maximum.accumulate(np.where(new, at, 0))
        rank[position] = group[at]
        done += step
    return order, rank[:n]


def common_prefixes(data: np.ndarray, limit: np.ndarray, at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Common prefix of each position ``at`` (ascending) with ``before``, its neighbour in order.

    ``limit``: end of the text that each position of ``data`` lies in. Kasai: where position and
    neighbour both move on by one, the prefix is one shorter; bytes are compared only elsewhere.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (before[1:] != before[:-1] + 1)
    a, b = at[fresh].astype(np.int64), before[fresh].astype(np.int64)
    room = np.minimum(limit[a] - a, limit[b] - b)
    got, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    block = 64
    padded = np.concatenate([data, np.zeros(block, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, block)
    while len(open_):
        on = []
        for some in np.array_split(open_, -(-len(open_) // 65536)):
            same = rows[a[some] + got[some]] == rows[b[some] + got[some]]
            whole = same.all(1)
            got[some] += np.where(whole, block, same.argmin(1))
            on.append(some[whole & (got[some] < room[some])])
        open_ = np.concatenate(on)
    got = np.minimum(got, room)
    head = np.flatnonzero(fresh)
    which = np.cumsum(fresh) - 1
    return got[which] - (np.arange(len(at)) - head[which])


def window_digests(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of the ``length`` bytes from each position (positions near the end lack
    bytes; theirs are of no use)."""
    out = []
    for seed in (1, 2):
        h = mix(data.astype(np.uint64) + np.uint64(seed << 32))
        width = 1
        odd = mix(np.arange(64 * seed, 64 * seed + 64, dtype=np.uint64)) | np.uint64(1)
        turn = 0
        while width < length:
            step = min(width, length - width)
            ahead = np.concatenate([h[step:], np.zeros(step, np.uint64)])
            h = mix(h * odd[turn] + ahead)
            width += step
            turn += 1
        out.append(h)
    return out[0], out[1]


def repeated_windows(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int = LENGTH):
    """(repeats, group): for all positions, whether a window that starts there equals another
    window, and the rank of its group. ``windows`` flags the positions where windows start."""
    order, rank = suffix_array(data, length)
    keep = windows[order]
    order = order[keep]
    group = rank[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = group[1:] == group[:-1]
    limit = np.repeat(starts[1:], np.diff(starts))
    at, before = order[1:][same[1:-1]], order[:-1][same[1:-1]]
    by_place = np.argsort(at, kind="stable")
    at, before = at[by_place], before[by_place]
    long = common_prefixes(data, limit, at, before) >= length
    repeats = np.zeros(len(data), bool)
    repeats[at[long]] = True
    repeats[before[long]] = True
    return repeats, rank


def runs(flag: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flag.view(np.int8), [0]))))
    return edge.reshape(-1, 2)


FOUND = (
    "h long, c long, lows array<int>, highs array<int>, "
    "range long, d1 array<long>, d2 array<long>, hs array<long>, cs array<long>, places array<int>"
)
_FOUND_TYPES = {
    "h": pa.int64(), "c": pa.int64(), "lows": pa.list_(pa.int32()), "highs": pa.list_(pa.int32()),
    "range": pa.int64(), "d1": pa.list_(pa.int64()), "d2": pa.list_(pa.int64()),
    "hs": pa.list_(pa.int64()), "cs": pa.list_(pa.int64()), "places": pa.list_(pa.int32()),
}


def _shard(length: int, ranges: int):
    """Repeated windows of the contexts of one shard: a row for each context that has some. For
    contexts of a gram that lies in several shards too, the digests of their different windows,
    as sorted lists: a row for each of the ``ranges`` that digests are merged in."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        h, c = table["h"].to_numpy(), table["c"].to_numpy()
        n, dealt = table["n"].to_numpy(), table["salts"].to_numpy() > 1
        data, starts = buffer(table["bytes"].combine_chunks())
        windows = np.zeros(len(data) + 1, np.int32)
        np.add.at(windows, starts[:-1], 1)
        np.add.at(windows, starts[1:] - length + 1, -1)
        windows = np.cumsum(windows[:-1]) > 0
        repeats, rank = repeated_windows(data, starts, windows, length)
        out = {k: [] for k in _FOUND_TYPES}

        def add(**row):
            for k in out:
                out[k].append(row.get(k))

        for i in range(len(h)):
            size = int(starts[i + 1] - starts[i]) - length + 1
            flag = repeats[starts[i] : starts[i] + size] if n[i] == 1 else np.ones(size, bool)
            if flag.any():
                found = runs(flag)
                add(h=int(h[i]), c=int(c[i]), lows=found[:, 0], highs=found[:, 1])
        if dealt.any():
            d1, d2 = window_digests(data, length)
            # one window of each group stands for it
            place = np.flatnonzero(np.repeat(dealt, np.diff(starts)) & windows)
            _, one = np.unique(rank[place], return_index=True)
            place = place[one]
            part = ((d1[place] >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
            order = np.lexsort((d2[place], d1[place], part))
            place, part = place[order], part[order]
            own = np.searchsorted(starts, place, "right") - 1
            cut = np.flatnonzero(np.diff(part)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
                p, i = place[a:b], own[a:b]
                add(range=int(part[a]), d1=d1[p].view(np.int64), d2=d2[p].view(np.int64), hs=h[i], cs=c[i], places=(p - starts[i]).astype(np.int32))
        return pa.table({k: pa.array(v, _FOUND_TYPES[k]) for k, v in out.items()})

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Windows that several shards hold, in one range of digests.

    Every shard's list is sorted and holds a window once, so a window is in several lists if the
    merged list, looked up by binary search, has its digest more than once. A row for each
    context that has such windows.
    """
    flat = lambda name: table[name].combine_chunks().values.to_numpy(zero_copy_only=False)
    d1, d2 = flat("d1").view(np.uint64), flat("d2").view(np.uint64)
    key = mix(d1) ^ (d2 * np.uint64(0x9E3779B97F4A7C15))
    merged = np.sort(key)
    n = np.searchsorted(merged, key, "right") - np.searchsorted(merged, key, "left")
    at = np.flatnonzero(n > 1)
    # equal keys are looked at in full
    at = at[np.lexsort((d2[at], d1[at]))]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = (d1[at][1:] == d1[at][:-1]) & (d2[at][1:] == d2[at][:-1])
    at = at[same[1:] | same[:-1]]
    h, c, place = flat("hs")[at], flat("cs")[at], flat("places")[at].astype(np.int64)
    order = np.lexsort((place, c, h))
    h, c, place = h[order], c[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)  # runs of windows side by side
    end = place[np.concatenate((head[1:], [len(h)])) - 1] + 1 if len(head) else place
    h, c, low = h[head], c[head], place[head]
    first = np.ones(len(head), bool)
    first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    group = np.flatnonzero(first)
    offsets = pa.array(np.concatenate((group, [len(head)])).astype(np.int32))
    ints = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32)))
    return pa.table({"h": pa.array(h[group]), "c": pa.array(c[group]), "lows": ints(low), "highs": ints(end)})


# --- the whole job ------------------------------------------------------------------------


def _contexts(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted context, cut from one text that holds it."""
    lists = wanted.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("h", "c", "n", "salts", "first", "last")).alias("cuts")
    )
    one = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column(0)[row].as_buffer().to_pybytes()
                cuts = batch.column(1)[row].values.flatten()
                h, c, n, salts, first, last = (x.to_numpy(zero_copy_only=False) for x in cuts)
                parts = [raw[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, (h, c, n, salts)), pa.array(parts, pa.binary())],
                    names=["h", "c", "n", "salts", "bytes"],
                )

    both = one.join(lists, ["k1", "k2"]).select(F.col("text").cast("binary").alias("text"), "cuts")
    return both.mapInArrow(run, "h long, c long, n long, salts long, bytes binary")


def repeated(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """k1, k2, lows, highs: byte ranges of each text that are covered by repeated strings.

    ``texts``: k1, k2 (key of the text) and text, a row for each document.
    """
    every = shared_rows(find_anchors(texts, length, gram))
    # Written first, so that both sides of the join are plain scans and Spark can split the
    # partitions of very common grams.
    twice = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    twice = shared_rows(twice)
    some = shared_rows(every.join(twice, "h", "left_semi"))
    contexts = some.groupBy("h", "c").agg(
        F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "last")).alias("one")
    )
    contexts = shared_rows(contexts.select("h", "c", "n", "one.*"))
    salts = contexts.groupBy("h").agg(F.ceil(F.count("*") / TOGETHER).cast("long").alias("salts"))
    salts = shared_rows(salts.where("salts > 1"))
    wanted = contexts.join(salts, "h", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    size = contexts.agg(F.sum(F.col("last") - F.col("first") + length)).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("h", F.when(F.col("salts") > 1, F.pmod("c", "salts")).otherwise(0)), F.lit(shards))
    found = shared_rows(
        _contexts(wanted, texts, length)
        .withColumn("shard", shard)
        .groupBy("shard")
        .applyInArrow(_shard(length, shards), FOUND)
    )
    merged = (
        found.where("range IS NOT NULL")
        .groupBy("range")
        .applyInArrow(_merge, "h long, c long, lows array<int>, highs array<int>")
    )
    own = found.where("range IS NULL").select("h", "c", "lows", "highs")
    covers = own.unionByName(merged).groupBy("h", "c").agg(
        F.flatten(F.collect_list(F.arrays_zip("lows", "highs"))).alias("windows")
    )
    covers = shared_rows(covers)  # a plain scan again, for contexts that many texts share
    placed = some.select("k1", "k2", "h", "c", "first").distinct().join(covers, ["h", "c"])
    moved = F.transform(
        "windows",
        lambda w: F.struct((w["lows"] + F.col("first")).alias("low"), (w["highs"] + F.col("first") + (length - 1)).alias("high")),
    )
    return placed.groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list(moved))).alias("cuts"))


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(raw: bytes, low: np.ndarray, high: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, what is left) for ranges in order of their low ends."""
    if not len(low):
        return 0, 0, raw
    reach = np.maximum.accumulate(high)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > reach[:-1]
    begin = low[new].tolist()
    end = reach[np.concatenate((np.flatnonzero(new)[1:], [len(low)])) - 1].tolist()
    kept, at = [], 0
    for a, b in zip(begin, end, strict=True):
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return sum(end) - sum(begin), len(begin), b"".join(kept)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text")
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    texts = keyed(docs.select("doc_id", "text"))
    cuts = shared_rows(repeated(texts, length, gram))

    def run(batches):
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                raw = batch.column(1)[row].as_buffer().to_pybytes()
                cut = batch.column(2)[row]
                low, high = (
                    (x.to_numpy().astype(np.int64) for x in cut.values.flatten()) if cut.is_valid else (np.zeros(0, int),) * 2
                )
                removed, spans, kept = _cut(raw, low, high)
                out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    both = texts.join(cuts, ["k1", "k2"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "cuts")
    return both.mapInArrow(run, SCHEMA)
