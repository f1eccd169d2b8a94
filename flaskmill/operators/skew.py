"""Joins whose left side may hold one very frequent key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 200
SALTS = 64


def hot_keys(left: DataFrame, key: str) -> DataFrame:
    """Keys holding more than 1/HOT_SHARE of the rows: fewer than HOT_SHARE of them.

    Counted with map-side partial aggregation, so a hot key costs one row per partition.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = left.agg(F.count(key).alias("_total"))
    return counts.where(F.col("_n") * HOT_SHARE > total.scalar()).select(key)


def join_spread(
    left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "left"
) -> DataFrame:
    """Equi-join on ``key`` (unique in ``right``) with the hot keys of ``left`` salted.

    ``left`` must give the same rows each time it is read, which any plan without random
    functions does. Hot left rows are spread over SALTS reducers by ``spread`` columns, the matching right
    rows are repeated that often, every other row moves once. The only table broadcast is
    the hot-key list, which has fewer than HOT_SHARE rows whatever the input.
    """
    hot = hot_keys(left, key).withColumn("_hot", F.lit(True))
    # Rows without a key cannot match; they are spread as well instead of sharing a reducer.
    left_salt = F.when(
        F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    ).otherwise(0)
    right_salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    salted_left = left.join(F.broadcast(hot), key, "left").withColumn("_salt", left_salt)
    salted_right = right.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(right_salts)
    )
    return salted_left.drop("_hot").join(salted_right.drop("_hot"), [key, "_salt"], how).drop("_salt")
