"""Hashed text features and set similarity.

A feature set is the sparse form of a 0/1 vector: the ids of its on-bits. Features are
character shingles, not chemical environments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flaskmill.constants import FINGERPRINT_BITS
from flaskmill.functions.text import as_column, bind


def shingles(text, width: int = 3) -> Column:
    """Distinct runs of ``width`` characters; a shorter text is one shingle."""
    text = as_column(text)
    # One pass of a pattern over the text; a step of an array function per character is dearer.
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))."), F.lit(1))
    return F.when(F.length(text) >= width, F.array_distinct(runs)).when(F.length(text) > 0, F.array(text))


def bits_of(runs, bits: int = FINGERPRINT_BITS) -> Column:
    """Sorted ids of the on-bits of distinct shingles."""
    bit = lambda s: (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") % bits).cast("int")
    return F.sort_array(F.array_distinct(F.transform(runs, bit)))


def feature_set(text, width: int = 3, bits: int = FINGERPRINT_BITS) -> Column:
    """Sorted ids of the on-bits; null for a null or empty text."""
    return bits_of(shingles(text, width), bits)


def combine_or(sets, ordered: bool = True) -> Column:
    """Union over an array of sets, sorted or as it comes; unreadable (null) members are skipped."""
    known = F.filter(sets, lambda x: x.isNotNull())
    union = F.array_distinct(F.flatten(known))
    return F.sort_array(union) if ordered else union


def transform_xor(a, b) -> Column:
    """Bits set on exactly one side."""
    a, b = as_column(a), as_column(b)
    return F.sort_array(F.concat(F.array_except(a, b), F.array_except(b, a)))


def tanimoto(a, b) -> Column:
    """Shared over combined size of two feature sets; 0 when both are empty."""
    a, b = as_column(a), as_column(b)
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 0.0).otherwise(shared / union)


#: Bits of a packed vector's words.
WORD = 64


def packed(on, bits: int = FINGERPRINT_BITS) -> Column:
    """The dense form of sorted on-bits: 64-bit words, so that overlaps are counted by the word."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    start = F.struct(
        F.array().cast("array<struct<key:int,value:bigint>>").alias("full"), F.lit(0).alias("key"), zero.alias("value")
    )

    def put(acc: Column, b: Column) -> Column:
        """Words follow each other, so one word is open at a time."""
        key = F.shiftright(b, WORD.bit_length() - 1)
        bit = F.call_function("shiftleft", one, b - key * WORD)
        same = key == acc["key"]
        closed = F.array(F.struct(acc["key"].alias("key"), acc["value"].alias("value")))
        return F.struct(
            F.when(same, acc["full"]).otherwise(F.concat(acc["full"], closed)).alias("full"),
            key.alias("key"),
            F.when(same, acc["value"].bitwiseOR(bit)).otherwise(bit).alias("value"),
        )

    def words(acc: Column) -> Column:
        last = F.array(F.struct(acc["key"].alias("key"), acc["value"].alias("value")))
        found = F.map_from_entries(F.concat(acc["full"], last))
        dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(bits // WORD - 1)), lambda w: F.coalesce(m[w], zero))
        return bind(found, dense)

    return F.aggregate(as_column(on), start, put, words)


def filled(words, bits: int = FINGERPRINT_BITS) -> Column:
    """A packed vector as one without nulls: what is read back may have some, and each pair would ask."""
    words = as_column(words)
    return F.array(*[F.coalesce(F.get(words, F.lit(i)), F.lit(0).cast("bigint")) for i in range(bits // WORD)])


def overlap(a, b, bits: int = FINGERPRINT_BITS, first: int = 0) -> Column:
    """On-bits that two packed vectors share, from the bit ``first`` up to ``bits``."""
    a, b = as_column(a), as_column(b)
    words = range(first // WORD, bits // WORD)
    counts = [F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.get(b, F.lit(i)))) for i in words]
    while len(counts) > 1:
        counts = [x + y for x, y in zip(counts[::2], counts[1::2], strict=True)]
    return counts[0]


def tanimoto_of_counts(shared, a_size, b_size) -> Column:
    """Shared over combined size, from the sizes; 0 when both are empty."""
    shared, union = as_column(shared), as_column(a_size) + as_column(b_size) - as_column(shared)
    return F.when(union == 0, 0.0).otherwise(shared / union)
