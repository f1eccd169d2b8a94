"""Seeded samples, exact splits and mixes.

Every random choice is the order of ``md5(seed:key)``, so a result depends on the rows and
the seed only, never on partitions or task order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flaskmill.functions.text import has_any, is_present, text_digest
from flaskmill.operators.dedupe import dedupe_first, first_per
from flaskmill.operators.leakage import exclude_holdout
from flaskmill.operators.ordering import (
    SMALL_N,
    first_by_hash,
    first_by_hash_per_group,
    first_in_order,
    first_per_group_by_index,
    label_by_cuts,
    seeded_hash,
)
from flaskmill.session import stage


def take_unique(df: DataFrame, key: str, n: int, order: str) -> DataFrame:
    """First row per non-empty key in source order, up to ``n`` rows."""
    return first_in_order(dedupe_first(df, key, order), n, order)


def _kept_by_id(df: DataFrame, chosen: DataFrame, row_id: str) -> DataFrame:
    return df.join(chosen.select(row_id), row_id, "left_semi")


def _once(df: DataFrame, *sizes: int) -> DataFrame:
    """Large cuts read their input several times, so it is written once; ids only."""
    return stage(df) if max(sizes) > SMALL_N else df


def seeded_sample_nested(df: DataFrame, n: int, seed, key: str, row_id: str) -> DataFrame:
    """Seeded shuffle, then the first row per key, up to ``n``: a smaller n is a prefix.

    Rows are chosen on (id, digest of the key) alone; the wide rows are only filtered by the chosen ids.
    """
    short = df.where(is_present(key)).select(row_id, text_digest(key).alias("_text"))
    shuffled = short.withColumn("_h", seeded_hash(seed, row_id))
    unique = first_per(shuffled, ["_text"], ["_h", row_id]).select(row_id)
    return _kept_by_id(df, first_by_hash(_once(unique, n), n, row_id, seed), row_id)


def stratified_capped_sample(
    df: DataFrame,
    n: int,
    group: str,
    key: str,
    row_id: str,
    seed,
    cap: int | None = None,
    holdout: DataFrame | None = None,
) -> DataFrame:
    """Up to ``n`` rows with distinct keys, at most ``cap`` of them from one group, none with a
    key of ``holdout``.

    Rows are chosen on (id, digest of the key, group) alone; the wide rows are only filtered by
    the chosen ids. Copies collapse before held-out keys are taken away, so a key with many rows
    reaches that join once. A null group counts as one group. The choice is uniform within a
    group over the whole input.
    """
    cap = max(1, n // 10) if cap is None else cap
    named = F.when(is_present(group), F.col(group).cast("string")).otherwise("unknown")
    narrow = df.where(is_present(key)).select(row_id, text_digest(key).alias("_text"), named.alias("_group"))
    unique = first_per(narrow, ["_text"], [row_id])
    if holdout is not None:
        held = holdout.where(is_present(key)).select(text_digest(key).alias("_text")).distinct()
        unique = unique.join(held, "_text", "left_anti")
    unique = _once(unique.select(row_id, "_group"), n, cap)
    capped = _once(first_by_hash_per_group(unique, cap, row_id, "_group", seed), n)
    return _kept_by_id(df, first_by_hash(capped, n, row_id, seed), row_id)


def split_count(df: DataFrame, val_n: int, row_id: str, seed, into: str = "split") -> DataFrame:
    """``min(val_n, max(1, N // 10))`` rows for validation, the rest for training."""
    tenth = F.greatest(F.lit(1), F.floor(F.col("_total") / 10))
    size = F.least(F.lit(val_n), tenth)
    return label_by_cuts(df, row_id, seed, [("val", size)], "train", into)


def split_fractions(
    df: DataFrame, test: float, val: float, row_id: str, seed, into: str = "split"
) -> DataFrame:
    """Exactly ``int(N*test)`` test rows, then ``int(N*val)`` validation rows, rest training."""
    sizes = [
        ("test", F.floor(F.col("_total") * F.lit(test))),
        ("val", F.floor(F.col("_total") * F.lit(val))),
    ]
    return label_by_cuts(df, row_id, seed, sizes, "train", into)


def require_any(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.where(has_any(*cols))


def require_any_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """How many rows have a populated field, of how many."""
    return df.agg(F.count_if(has_any(*cols)).alias("populated"), F.count("*").alias("total"))


def mix_by_presence(
    df: DataFrame,
    field: str,
    n_without: int,
    holdout: DataFrame,
    key: str,
    row_id: str,
    seed,
    fraction: float = 1.0,
) -> DataFrame:
    """Every row that has the field and ``int(n_without * fraction)`` seeded ones that do not,
    after the held-out keys are removed. ``mix_key`` is the seeded order to write in."""
    kept = exclude_holdout(df, holdout, key)
    with_field = kept.where(is_present(field))
    without = kept.where(~is_present(field))
    drawn = first_by_hash(without, int(n_without * fraction), row_id, seed)
    return with_field.unionByName(drawn).withColumn("mix_key", seeded_hash(seed, row_id))


def mix_report(mixed: DataFrame, field: str, other: str) -> DataFrame:
    share = lambda c: F.round(100.0 * F.avg(is_present(c).cast("int")), 6)
    return mixed.agg(
        F.count("*").alias("rows"),
        F.count_if(is_present(field)).alias("with_field"),
        share(field).alias("with_field_percent"),
        F.count_if(~is_present(field)).alias("without_field"),
        share(other).alias("other_percent"),
    )


def indexed_subset(df: DataFrame, n: int, seed, row_id: str) -> DataFrame:
    """Seeded subset that keeps its original index; a run cut short is a uniform sample."""
    return first_by_hash(df, n, row_id, seed).withColumn("subset_key", seeded_hash(seed, row_id))


def first_n_passing(df: DataFrame, keep: Column, n: int, order: str) -> DataFrame:
    """The first ``n`` rows that pass; an error if there are fewer. They are looked for once."""
    passing = stage(first_in_order(df.where(keep), n, order))
    found = passing.count()
    if found < n:
        raise ValueError(f"only {found} usable rows found, wanted {n}")
    return passing


def cap_first_per_source(df: DataFrame, n: int, source: str, index: str) -> DataFrame:
    """The first ``n`` rows of every file by index in the file, after any dropped rows.

    Rows without an index come first; rows without a file count as one file.
    """
    return first_per_group_by_index(df, n, index, source)


def expand_copies(df: DataFrame, n: int, size: str, row_id: str, seed) -> DataFrame:
    """One canonical copy (root null) and up to ``n - 1`` more, each with its own seeded root
    out of ``0 .. size-1``."""
    pool = F.when(
        F.col(size) > 0, F.sequence(F.lit(0), F.col(size).cast("int") - 1)
    ).otherwise(F.array().cast("array<int>"))
    ordered = F.array_sort(
        F.transform(
            pool,
            lambda r: F.struct(
                F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"), r.cast("string"))).alias("h"),
                r.alias("root"),
            ),
        )
    )
    extra = F.transform(F.slice(ordered, 1, n - 1), lambda e: e["root"]) if n > 1 else F.array().cast("array<int>")
    roots = F.concat(F.array(F.lit(None).cast("int")), extra)
    return df.select("*", F.posexplode(roots).alias("copy", "root"))


def bernoulli_flag(p: float, seed, epoch, row_id: str) -> Column:
    """Per-row, per-epoch coin that is true with probability ``p``."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(row_id).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32)) < p
