"""What the operators share: UTF-8 buffers of Arrow batches as numpy arrays, words and shingles.

A *slice* holds the texts of some rows as one byte array ``data`` and ``starts`` (one entry more
than rows). Slices are cut at ``SLICE_BYTES``, so memory per task does not follow the batch; one
longer text makes a slice of its own. Null texts are read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flaskmill.session import stage, staging_dir  # noqa: F401  (used by the operators)

SLICE_BYTES = 1 << 20
SHINGLE = 5

#: Space, tab and the line ends between 9 and 13 part words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII signs that `bare` words leave out.
IS_SIGN = np.zeros(256, bool)
IS_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def text_key(text="text"):
    """128-bit key of a text; null counts as empty. Equal texts are worked on once."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (one to one)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


def strings(column) -> pa.Array:
    """Plain string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, starts) of a string array without nulls."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end row, texts) in slices of about ``size`` bytes."""
    column = strings(column)
    _, starts = buffer(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + size, "right")) - 1)
        end = min(end, n)
        yield row, end, column.slice(row, end - row)
        row = end


def spans(solid: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``solid`` bytes that do not cross texts: begin, end, index of the text."""
    flag = solid.astype(np.int8)
    edge = np.empty(len(flag) + 1, np.int8)
    edge[0], edge[-1] = (flag[0], -flag[-1]) if len(flag) else (0, 0)
    edge[1:-1] = flag[1:] - flag[:-1]
    begin, end = edge == 1, edge == -1
    inner = starts[1:-1]
    inner = inner[(inner > 0) & (inner < len(flag))]
    cut = inner[solid[inner - 1] & solid[inner]]
    begin[cut] = True
    end[cut] = True
    begin, end = np.flatnonzero(begin[:-1]), np.flatnonzero(end)
    return begin, end, np.searchsorted(starts, begin, "right") - 1


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: begin, end, index of the text."""
    return spans(~IS_SPACE[data], starts)


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """Odd multipliers by position within a word."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = mix(np.arange(1, max(n, 256) * 2, dtype=np.uint64)) | np.uint64(1)
    return _POWERS


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, for spans in order that leave only skipped bytes between them."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    total = np.concatenate(([0], np.cumsum(length)))
    if total[-1] == len(data):
        own = data
    else:
        inside = np.zeros(len(data) + 1, np.int8)
        inside[begin] += 1
        inside[end] -= 1
        own = data[np.cumsum(inside[:-1]).astype(bool)]
    place = np.arange(total[-1]) - np.repeat(total[:-1], length)
    powers = _powers(int(length.max()))
    values = (own.astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix(np.add.reduceat(values, total[:-1]) + length.astype(np.uint64))


def bare(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, starts) in lower case without ASCII signs."""
    data, starts = buffer(pc.utf8_lower(column))
    keep = ~IS_SIGN[data]
    before = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], before[starts]


def bare_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and per text the index of its first word (one entry more)."""
    data, starts = bare(column)
    begin, end, text = words(data, starts)
    return span_hashes(data, begin, end), np.searchsorted(text, np.arange(len(starts)))


def window_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` words, across texts; the caller drops those that cross."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += word[k : k + n] * odd[k]
    return mix(total)


def shingles(word: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles and the index of each one's text.

    A text of fewer words has one shingle of all its words, a text without words none.
    """
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(word)) - first[:-1][text]
    whole = window_hashes(word, size)
    ok = (place + size <= count[text])[: len(whole)]
    value, owner = whole[ok], text[: len(whole)][ok]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = [window_hashes(word[first[i] : first[i + 1]], int(count[i])) for i in short]
        value, owner = np.concatenate([value, *extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner


def shared_rows(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    return stage(df)
