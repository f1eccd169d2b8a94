"""First-occurrence deduplication of tables and of ranked candidate lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flaskmill.functions.molecules import canonical_set
from flaskmill.functions.text import as_column, bind, is_present, split_fragments, text_digest

# A canonical part may itself contain a dot, so sets are joined with a control character.
SEPARATOR = "\x1f"


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key combination."""
    # The rank limit of 1 runs before the shuffle too, so copies of one key collapse in
    # every task and a hot key sends one row per task.
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def dedupe_first(df: DataFrame, key: str, order: str | Sequence[str]) -> DataFrame:
    """First row per key in source order; rows with an empty key are dropped."""
    order = [order] if isinstance(order, str) else list(order)
    # Rows meet by the digest, so a long key is not a shuffle and sort key as well.
    keyed = df.where(is_present(key)).withColumn("_key", text_digest(key))
    return first_per(keyed, ["_key"], order).drop("_key")


def dedupe_pair(
    df: DataFrame, key: str, set_col: str, order: str | Sequence[str], canonical=None
) -> DataFrame:
    """First row per (key, unordered set of fragments); a set that cannot be read counts
    as its own text."""
    order = [order] if isinstance(order, str) else list(order)
    parts = split_fragments(set_col)
    found = canonical_set(parts, canonical) if canonical else canonical_set(parts)
    named = df.where(is_present(key)).withColumn("_set", set_key(found, F.col(set_col)))
    return first_per(named, [key, "_set"], order).drop("_set")


def set_key(found: Column, text: Column) -> Column:
    """One text that tells sets apart, and unreadable texts from sets."""
    return F.coalesce(
        F.concat(F.lit("s:"), F.array_join(found, SEPARATOR)), F.concat(F.lit("t:"), text)
    )


def keep_first(values: Column, keys: Column) -> Column:
    """Elements of ``values`` whose key did not occur earlier in the list."""
    first = lambda ks: F.filter(values, lambda _, i: F.array_position(ks, F.get(ks, i)) == i + 1)
    return bind(keys, first)


def dedupe_candidates_set(candidates, sets: Column | None = None) -> Column:
    """First candidate per fragment set; an unreadable candidate is keyed by its text."""
    candidates = as_column(candidates)
    if sets is None:
        keys = lambda cs: F.transform(cs, lambda c: set_key(canonical_set(split_fragments(c)), c))
        return bind(candidates, lambda cs: keep_first(cs, keys(cs)))
    return keep_first(candidates, F.zip_with(candidates, sets, lambda c, s: set_key(s, c)))


def dedupe_candidates_raw(candidates) -> Column:
    """First candidate per exact text."""
    return F.array_distinct(as_column(candidates))


def valid_candidates(candidates) -> Column:
    """Candidates whose every fragment has a canonical form."""
    ok = lambda c: canonical_set(split_fragments(c)).isNotNull()
    return F.filter(as_column(candidates), ok)


def dedupe_candidates_valid(candidates) -> Column:
    """Unreadable candidates dropped, then the first per fragment set."""
    return dedupe_candidates_set(valid_candidates(candidates))


def dedupe_parsed(parsed, n: int) -> Column:
    """Distinct readable answers in rank order, at most ``n``."""
    known = F.filter(as_column(parsed), lambda p: p.isNotNull())
    return F.slice(F.array_distinct(known), 1, n)
