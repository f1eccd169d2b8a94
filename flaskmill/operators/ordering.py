"""Seeded order by hash, and exact cuts in it without sorting everything in one place.

The order is ``md5(seed:key)`` and then the key. The n-th row is found in two narrow passes:
a histogram over the leading hash bits names the bucket that holds it, and only the rows of
that bucket are ranked. The wide rows are then kept by comparing with the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flaskmill.operators.skew import join_spread
from flaskmill.session import stage

# Largest n for which the plain window or limit is used: up to here the rank limit is
# applied before the shuffle, so a hot group sends n rows per task. Results do not depend on it.
SMALL_N = 1000
HASH_DIGITS = 4


def seeded_hash(seed, *keys) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _bucket(h: Column) -> Column:
    return F.conv(F.substring(h, 1, HASH_DIGITS), 16, 10).cast("int")


def _position(key: str) -> Column:
    return F.struct(F.col("_h").alias("h"), F.col(key).alias("k"))


def cut_table(
    df: DataFrame, key: str, seed, wanted: dict[str, Column], group: Sequence[str] = ()
) -> DataFrame:
    """One row per group and, for every name in ``wanted``, the last position kept.

    A wanted number of rows is an expression over ``_total``. Where everything is kept the
    position lies after every hash, where nothing is kept before. ``key`` must be unique. All
    cuts share the two passes.
    """
    group = list(group)
    narrow = df.select(*group, key, seeded_hash(seed, key).alias("_h")).withColumn(
        "_b", _bucket(F.col("_h"))
    )
    # At most 16**HASH_DIGITS rows per group from here on.
    hist = narrow.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    per_group = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    running = hist.withColumn("_cum", F.sum("_n").over(per_group.orderBy("_b"))).withColumn(
        "_total", F.sum("_n").over(per_group)
    )
    wants = [
        F.struct(F.lit(name).alias("_name"), n.cast("bigint").alias("_want"))
        for name, n in wanted.items()
    ]
    asked = running.select("*", F.inline(F.array(*wants)))
    edge = asked.where(
        (F.col("_want") < F.col("_total"))
        & (F.col("_cum") >= F.col("_want"))
        & (F.col("_cum") - F.col("_n") < F.col("_want"))
    ).select(*group, "_b", "_name", (F.col("_want") - F.col("_cum") + F.col("_n")).alias("_need"))
    inside = narrow.join(edge, [*group, "_b"])
    rank = F.row_number().over(W.partitionBy(*group, "_b", "_name").orderBy("_h", key))
    cut = inside.withColumn("_rank", rank).where(F.col("_rank") == F.col("_need"))
    kind = df.schema[key].dataType
    beyond = lambda h: F.struct(F.lit(h).alias("h"), F.lit(None).cast(kind).alias("k"))
    trivial = asked.where((F.col("_want") >= F.col("_total")) | (F.col("_want") <= 0)).select(
        *group,
        "_name",
        F.when(F.col("_want") <= 0, beyond(BEFORE_ALL)).otherwise(beyond(AFTER_ALL)).alias("_cut"),
    )
    every = trivial.unionByName(cut.select(*group, "_name", _position(key).alias("_cut")))
    columns = [F.max(F.when(F.col("_name") == name, F.col("_cut"))).alias(name) for name in wanted]
    return every.groupBy(*group).agg(*columns)


# No hexadecimal digest sorts before the empty text or after a letter past f.
BEFORE_ALL, AFTER_ALL = "", "g"


def tie_break(df: DataFrame) -> Column:
    """Tells rows of equal position apart; rows that are alike in all columns are exchangeable."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def group_text(group: str) -> Column:
    """The group as a text that is never null and tells a null from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))


def edges(buckets: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Per group the bucket ``_edge`` that holds the n-th row and how many of it are ``_need``ed.

    ``buckets`` has the group's columns, ``_b`` and ``_n`` rows. A group of at most n rows keeps
    everything: its edge lies after all its buckets.
    """
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    running = buckets.withColumn("_cum", F.sum("_n").over(whole.orderBy("_b")))
    before = F.col("_cum") - F.col("_n")
    inside = (F.col("_cum") > n) & (before <= n)
    found = running.groupBy(*by).agg(
        F.min(F.when(inside, F.struct(F.col("_b").alias("b"), (F.lit(n) - before).alias("need")))).alias("_e"),
        F.max("_b").alias("_last"),
    )
    return found.select(
        *by,
        F.coalesce("_e.b", F.col("_last") + 1).alias("_edge"),
        F.coalesce("_e.need", F.lit(0)).cast("bigint").alias("_need"),
    )


def up_to_edge(rows: DataFrame, order: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the buckets before the edge, and the first of the edge's own.

    ``rows`` carry ``_b``, ``_edge`` and ``_need``; only the edge's rows are ranked.
    """
    rank = F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy(*order))
    at_edge = rows.where(F.col("_b") == F.col("_edge")).withColumn("_rank", rank)
    some = at_edge.where(F.col("_rank") <= F.col("_need")).drop("_rank")
    return rows.where(F.col("_b") < F.col("_edge")).unionByName(some)


def first_by_hash(df: DataFrame, n: int, key: str, seed) -> DataFrame:
    """The first ``n`` rows in seeded order: a smaller n gives a subset of a larger one.

    Exactly n rows, or all of fewer. Rows of equal key are told apart by their other columns.
    """
    hashed = df.withColumn("_h", seeded_hash(seed, key)).withColumn("_tie", tie_break(df))
    order = ["_h", key, "_tie"]
    if n <= SMALL_N:
        return hashed.orderBy(*order).limit(n).select(*df.columns)
    dealt = hashed.withColumn("_b", _bucket(F.col("_h")))
    edge = edges(dealt.groupBy("_b").agg(F.count("*").alias("_n")), n)
    known = dealt.join(F.broadcast(edge))  # one row
    return up_to_edge(known, order).select(*df.columns)


def _join_edges(dealt: DataFrame, edge: DataFrame, spread: list[str]) -> DataFrame:
    return join_spread(dealt, edge, "_g", spread, "inner")


def first_by_hash_per_group(df: DataFrame, n: int, key: str, group: str, seed) -> DataFrame:
    """The first ``n`` rows of every group in seeded order; a null group is a group."""
    hashed = df.withColumn("_h", seeded_hash(seed, key)).withColumn("_tie", tie_break(df))
    order = ["_h", key, "_tie"]
    if n <= SMALL_N:
        rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
        return hashed.withColumn("_rank", rank).where(F.col("_rank") <= n).select(*df.columns)
    dealt = hashed.withColumn("_b", _bucket(F.col("_h"))).withColumn("_g", group_text(group))
    edge = edges(dealt.groupBy("_g", "_b").agg(F.count("*").alias("_n")), n, ["_g"])
    return up_to_edge(_join_edges(dealt, edge, ["_tie"]), order, ["_g"]).select(*df.columns)


def label_by_cuts(
    df: DataFrame, key: str, seed, sizes: Sequence[tuple[str, Column]], rest: str, into: str
) -> DataFrame:
    """Label consecutive stretches of the seeded order with exact sizes.

    ``sizes`` gives (label, number of rows as an expression over ``_total``) in order; what
    is left gets ``rest``. The cuts come as one scalar subquery; the rows do not move.
    """
    wanted, upto = {}, F.lit(0).cast("bigint")
    for name, size in sizes:
        upto = upto + size.cast("bigint")
        wanted[name] = upto
    # The same one-row subquery for every label, which Spark runs once.
    cuts = cut_table(df, key, seed, wanted).select(F.struct(*wanted).alias("_row")).scalar()
    label = F.lit(rest)
    for name in reversed(wanted):
        label = F.when(_position(key) <= cuts[name], name).otherwise(label)
    return df.withColumn("_h", seeded_hash(seed, key)).withColumn(into, label).drop("_h")


#: Quantiles of a group's index values between which its rows are counted.
QUANTILES = 256


def first_per_group_by_index(df: DataFrame, n: int, index: str, group: str) -> DataFrame:
    """The first ``n`` rows of every group by a number, nulls first; a null group is a group.

    A large group is counted between its own quantiles, so one far-off index does not push all
    others into one stretch, and only the stretch with the n-th row is ranked.
    """
    order = [F.col(index).asc_nulls_first(), "_tie"]
    tied = df.withColumn("_tie", tie_break(df))
    if n <= SMALL_N:
        rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
        return tied.withColumn("_rank", rank).where(F.col("_rank") <= n).select(*df.columns)
    grouped = tied.withColumn("_g", group_text(group))
    shares = [k / QUANTILES for k in range(1, QUANTILES)]
    cuts = grouped.groupBy("_g").agg(F.percentile_approx(index, shares, 4 * QUANTILES).alias("_cuts"))
    below = F.size(F.filter(F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)), lambda c: c < F.col(index)))
    bucket = F.when(F.col(index).isNull(), -1).otherwise(below)
    dealt = _join_edges(grouped, cuts, ["_tie"]).withColumn("_b", bucket).drop("_cuts")
    edge = edges(dealt.groupBy("_g", "_b").agg(F.count("*").alias("_n")), n, ["_g"])
    return up_to_edge(_join_edges(dealt, edge, ["_tie"]), order, ["_g"]).select(*df.columns)


def first_in_order(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows by ``order``, nulls first; exactly n rows, or all of fewer.

    For a large n the order values alone are sorted over ranges; the range that holds the n-th
    is the only one looked into, and the rows are kept in place by comparing with that value.
    """
    tied = df.withColumn("_tie", tie_break(df))
    first = F.col(order).asc_nulls_first()
    if n <= SMALL_N:
        return tied.orderBy(first, "_tie").limit(n).select(*df.columns)
    values = stage(df.select(order).repartitionByRange(first).withColumn("_b", F.spark_partition_id()))
    edge = edges(values.groupBy("_b").agg(F.count("*").alias("_n")), n).first()
    if edge is None or not edge["_need"] and values.where(F.col("_b") >= edge["_edge"]).isEmpty():
        return df
    ahead = F.col("_b") < edge["_edge"]
    if edge["_need"]:
        inside = values.where(F.col("_b") == edge["_edge"]).orderBy(first).limit(edge["_need"])
        last = inside.agg(F.max(F.struct(F.col(order).isNotNull().alias("some"), order)).alias("v"))
    else:
        last = values.where(ahead).agg(F.max(F.struct(F.col(order).isNotNull().alias("some"), order)).alias("v"))
    last = last.first()["v"]
    if not last["some"]:
        return tied.where(F.col(order).isNull()).orderBy("_tie").limit(n).select(*df.columns)
    sooner = F.col(order).isNull() | (F.col(order) < F.lit(last[order]))
    missing = n - values.where(sooner).count()
    equal = tied.where(F.col(order) == F.lit(last[order])).orderBy("_tie").limit(missing)
    return df.where(sooner).unionByName(equal.select(*df.columns))
