"""Paired exact test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x >= 1: Stirling's series after moving the argument up by 8."""
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def two_sided_p(b: Column, c: Column) -> Column:
    """Exact two-sided binomial p of ``b`` against ``c`` at one half; 1 when both are 0.

    The largest tail term is taken in logs and the others follow as ratios to it. With m at
    most n/2, a term d steps down is below exp(-d(d-1)/n) of the largest, so the terms
    beyond 10·sqrt(n)+10 steps are under 1e-43 of it and change no digit of a double.
    """
    n, m = (b + c).cast("double"), F.least(b, c).cast("double")
    steps = F.least(m, F.ceil(10 * F.sqrt(n)) + 10).cast("bigint")
    top = log_gamma(n + 1) - log_gamma(m + 1) - log_gamma(n - m + 1) - n * math.log(2.0)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, d):
        term = acc["term"] * (m - d + 1) / (n - m + d)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    counts = F.when(steps > 0, F.sequence(F.lit(1).cast("bigint"), steps)).otherwise(
        F.array().cast("array<bigint>")
    )
    tail = F.aggregate(counts, start, step, lambda acc: acc["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(top) * tail))


def mcnemar_exact(df: DataFrame, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per metric: rates, discordant counts and p; pairs with a null are left out.

    ``metrics`` maps a name to the two runs' hit flags. All metrics are counted in one pass.
    """
    flags = [
        F.struct(F.lit(name).alias("metric"), a.alias("a"), b.alias("b"))
        for name, (a, b) in metrics.items()
    ]
    counted = (
        df.select(F.inline(F.array(*flags)))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("metric")
        .agg(
            F.count("*").alias("n"),
            F.avg(F.col("a").cast("int")).alias("rate_a"),
            F.avg(F.col("b").cast("int")).alias("rate_b"),
            F.count_if(F.col("a") & ~F.col("b")).alias("only_a"),
            F.count_if(F.col("b") & ~F.col("a")).alias("only_b"),
        )
    )
    return counted.withColumn("p", two_sided_p(F.col("only_a"), F.col("only_b")))
