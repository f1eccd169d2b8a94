"""Holdout exclusion, leak reports, run pairing and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flaskmill.operators.dedupe import dedupe_first, first_per
from flaskmill.operators.ordering import seeded_hash
from flaskmill.operators.skew import join_spread
from flaskmill.functions.text import is_present, text_digest


def holdout_keys(holdouts: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct non-empty keys of several tables."""
    narrow = [h.select(key).where(is_present(key)) for h in holdouts]
    return reduce(DataFrame.unionByName, narrow).distinct()


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys``; rows meet by the key's digest, a null key stays.

    No hint: Spark broadcasts the digests when their measured size allows, and splits skewed
    partitions of the rows otherwise. Deduplicate first where one key holds many rows.
    """
    held = keys.select(text_digest(key).alias("_key")).distinct()
    return df.withColumn("_key", text_digest(key)).join(held, "_key", "left_anti").drop("_key")


def exclude_holdout(df: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not held out; a null key stays."""
    return without_keys(df, holdout.select(key).where(is_present(key)), key)


def exclude_many(df: DataFrame, holdouts: Sequence[DataFrame], key: str) -> DataFrame:
    return without_keys(df, holdout_keys(holdouts, key), key)


def leak_report(test: DataFrame, train: DataFrame, key: str, pair: Sequence[str]) -> DataFrame:
    """Rows in, leaked, kept and kept share, and distinct overlap by key and by pair.

    The test rows are first counted per distinct pair of digests, so copies do not travel and
    neither does a text.
    """
    cols = list(dict.fromkeys([key, *pair]))
    short = [text_digest(c).alias(c) for c in cols]
    have = test.select(*short).groupBy(*cols).agg(F.count("*").alias("_rows"))
    known = train.where(is_present(key)).select(*short).distinct()
    keys = known.select(key).distinct().withColumn("_key_hit", F.lit(True))
    pairs = known.select(*pair).distinct().withColumn("_pair_hit", F.lit(True))
    marked = have.join(keys, key, "left").join(pairs, list(pair), "left")
    per_key = marked.groupBy(key).agg(
        F.sum("_rows").alias("_rows"),
        F.max(F.col("_key_hit").cast("int")).alias("_key_hit"),
        F.sum(F.when(F.col("_pair_hit"), 1).otherwise(0)).alias("_pairs"),
    )
    rows = F.coalesce(F.sum("_rows"), F.lit(0))
    leaked = F.coalesce(F.sum(F.when(F.col("_key_hit") == 1, F.col("_rows"))), F.lit(0))
    return per_key.agg(
        rows.alias("rows_in"),
        leaked.alias("leaked"),
        F.count_if(F.col("_key_hit") == 1).alias("leaked_keys"),
        F.coalesce(F.sum("_pairs"), F.lit(0)).alias("leaked_pairs"),
    ).select(
        "rows_in",
        "leaked",
        (F.col("rows_in") - F.col("leaked")).alias("kept"),
        F.when(F.col("rows_in") == 0, 0.0)
        .otherwise(100.0 * (F.col("rows_in") - F.col("leaked")) / F.col("rows_in"))
        .alias("kept_percent"),
        "leaked_keys",
        "leaked_pairs",
    )


def attach_predictions(
    targets: DataFrame, predictions: DataFrame, key: str, order: str, target_id: str
) -> DataFrame:
    """Inner join by key; of several predictions for one key the last by ``order`` counts."""
    known = predictions.where(is_present(key))
    last = first_per(known, [key], [F.col(order).desc()]).drop(order)
    return join_spread(targets, last, key, [target_id], "inner")


def pair_runs(a: DataFrame, b: DataFrame, pos: str = "record_pos", product: str = "product") -> DataFrame:
    """Two runs side by side by position; an error unless lengths and products agree.

    Columns other than ``pos`` and ``product`` get the suffixes ``_a`` and ``_b``.
    """
    left = a.select(pos, *[F.col(c).alias(f"{c}_a") for c in a.columns if c != pos])
    right = b.select(pos, *[F.col(c).alias(f"{c}_b") for c in b.columns if c != pos])
    both = left.join(right, pos, "full_outer")
    same = F.coalesce(F.col(f"{product}_a") == F.col(f"{product}_b"), F.lit(False))
    # In a filter, so that no projection after it can prune the check away.
    checked = both.where(F.assert_true(same, "runs differ in length or record order").isNull())
    return checked.withColumnRenamed(f"{product}_a", product).drop(f"{product}_b")


def subset_like(
    full: DataFrame, like: DataFrame, index: str, pos: str = "record_pos", product: str = "product"
) -> DataFrame:
    """Rows of ``full`` named by ``like``'s index, carrying ``like``'s position as ``like_pos``;
    an error if a product differs or an index is missing."""
    wanted = like.select(
        F.col(index).alias("_index"), F.col(pos).alias("like_pos"), F.col(product).alias("_product")
    )
    both = wanted.join(full, F.col("_index") == F.col(pos), "left")
    same = F.coalesce(F.col(product) == F.col("_product"), F.lit(False))
    checked = both.where(F.assert_true(same, "the two runs are not the same test file").isNull())
    return checked.drop("_index", "_product")


def lookup_join(df: DataFrame, key: str, lookup: DataFrame) -> DataFrame:
    """Left join with a lookup that has one row per key.

    A plain join: Spark sends a lookup of small measured size to all tasks, and splits the
    partitions of frequent keys otherwise.
    """
    return df.join(lookup, key, "left")


def merge_chunks(
    chunks: Sequence[DataFrame],
    settings: Sequence[str],
    product: str = "product",
    pos: str = "record_pos",
) -> DataFrame:
    """Chunks one after the other, refusing differing settings; a repeated product keeps the
    row of the first chunk that has it, and records without a product all stay."""
    stacked = reduce(
        DataFrame.unionByName, [c.withColumn("chunk", F.lit(i)) for i, c in enumerate(chunks)]
    )
    marks = stacked.select(F.to_json(F.struct(*settings)).alias("s"))
    agree = marks.agg((F.coalesce(F.min("s") == F.max("s"), F.lit(True))).alias("ok")).scalar()
    checked = stacked.where(
        F.assert_true(agree, "chunks were scored with different settings").isNull()
    )
    # A record without a product repeats no other: all of them stay.
    empty = checked.where(~is_present(product))
    return dedupe_first(checked, product, ["chunk", pos]).unionByName(empty)


def answer_coverage(test: DataFrame, train: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """For every named key: test rows that state it, and the share also found in train.

    A key is one text per row, a canonical set joined to text for instance.
    """
    parts = []
    for name, expr in keys.items():
        have = test.select(expr.alias("_k")).where(F.col("_k").isNotNull())
        counted = have.groupBy("_k").agg(F.count("*").alias("_rows"))
        known = train.select(expr.alias("_k")).where(F.col("_k").isNotNull()).distinct()
        marked = counted.join(known.withColumn("_hit", F.lit(True)), "_k", "left")
        stated = F.coalesce(F.sum("_rows"), F.lit(0))
        covered = F.coalesce(F.sum(F.when(F.col("_hit"), F.col("_rows"))), F.lit(0))
        parts.append(
            marked.agg(stated.alias("stated"), covered.alias("covered")).select(
                F.lit(name).alias("answer"),
                "stated",
                "covered",
                F.when(F.col("stated") == 0, 0.0)
                .otherwise(F.col("covered") / F.col("stated"))
                .alias("share"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def mix(a: DataFrame, b: DataFrame, seed, key: str, into: str = "shuffle_key") -> DataFrame:
    """Both tables together with the seeded order as a column; ``write_mixed`` writes in it."""
    return a.unionByName(b, allowMissingColumns=True).withColumn(into, seeded_hash(seed, key))


#: Bits of the filter in front of a large holdout: 16 MB however many keys there are.
FILTER_BITS = 1 << 27


def _place(key: str, bits: int) -> Column:
    """A key's bit; functions of bitmaps count from 1."""
    return F.pmod(F.xxhash64(F.lit(5), key), F.lit(bits)) + 1


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """One bit for every key, as bitmaps of 4 KB: a table of ``bits / 8`` bytes at most."""
    placed = keys.where(is_present(key)).select(_place(key, bits).alias("place"))
    return placed.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")
    )


def exclude_large(df: DataFrame, holdout: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose key is not held out, for a holdout that is too large to broadcast.

    Only the bitmaps are broadcast, which have a size of their own. Rows whose bit is not set are
    kept where they stand; only the others, the rows held out and one in ``bits / keys`` of the
    rest, are moved to be compared with the keys. ``df`` is read twice. A null key stays.
    """
    place = _place(key, bits)
    bit = F.bitmap_bit_position(place)
    maps = F.broadcast(key_filter(holdout.select(key), key, bits).withColumnRenamed("bucket", "_bucket"))
    marked = df.withColumn("_bucket", F.when(is_present(key), F.bitmap_bucket_number(place)))
    marked = marked.join(maps.withColumnRenamed("bitmap", "_bitmap"), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0, F.lit(False))
    sure = marked.where(~hit).select(*df.columns)
    rest = marked.where(hit).select(*df.columns)
    return sure.unionByName(exclude_holdout(rest, holdout, key))


def write_mixed(df: DataFrame, path: str, by: str = "shuffle_key", files: int | None = None) -> None:
    """Rows in the order of ``by`` over all files, which are read in the order of their names.

    Files are ranges of ``by``, sorted inside; a seeded hash makes them of about equal size. Equal
    places go by the rest of the row, so reruns agree.
    """
    columns = [by, F.xxhash64(*[c for c in df.columns if c != by])]
    ranges = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    ranges.sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def read_mixed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``write_mixed`` with their ``place``, counted over files and rows alone."""
    rows = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))  # a row for each file
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(files), "_file")
    return placed.withColumn("place", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")
