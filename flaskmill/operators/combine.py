"""Combining, filtering and re-ranking candidate lists; all inside one record's row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flaskmill.functions import molecules as M
from flaskmill.functions.text import as_column, split_fragments
from flaskmill.operators.dedupe import dedupe_candidates_set, dedupe_candidates_valid
from flaskmill.operators.topk import TOP_KS, share


def interleave(*runs) -> Column:
    """First of each list, then second of each, and so on; longer lists keep their tail."""

    def placed(run, source):
        return F.transform(
            F.coalesce(as_column(run), F.array().cast("array<string>")),
            lambda c, i: F.struct(i.alias("rank"), F.lit(source).alias("source"), c.alias("c")),
        )

    every = F.concat(*[placed(run, source) for source, run in enumerate(runs)])
    return F.transform(F.array_sort(every), lambda x: x["c"])


def ensemble(*runs) -> Column:
    """Interleaved lists with repeated fragment sets removed."""
    return dedupe_candidates_set(interleave(*runs))


def oracle_ceiling(df: DataFrame, rank_a: str, rank_b: str, rank_merged: str, ks: Sequence[int] = TOP_KS) -> DataFrame:
    """Per k: rate of each run, of the merged run, of either run hitting, and the headroom."""
    ranks = {"a": F.col(rank_a), "b": F.col(rank_b), "merged": F.col(rank_merged)}
    cols = []
    for k in ks:
        hits = {n: F.coalesce(r <= k, F.lit(False)) for n, r in ranks.items()}
        cols += [share(h).alias(f"{n}_top{k}") for n, h in hits.items()]
        either = share(hits["a"] | hits["b"])
        cols.append(either.alias(f"oracle_top{k}"))
        cols.append((either - share(hits["merged"])).alias(f"headroom_top{k}"))
    return df.agg(*cols)


def rerank_verified(candidates, flags, n: int) -> Column:
    """Verified ones of the first ``n`` first, both parts in their order, then the rest."""
    candidates = as_column(candidates)
    marked = F.zip_with(
        F.slice(candidates, 1, n),
        F.slice(as_column(flags), 1, n),
        lambda c, f: F.struct(c.alias("c"), F.coalesce(f, F.lit(False)).alias("f")),
    )
    real = F.filter(marked, lambda x: x["c"].isNotNull())
    pick = lambda flag: F.transform(F.filter(real, lambda x: x["f"] == flag), lambda x: x["c"])
    tail = F.filter(candidates, lambda _, i: i >= n)
    return F.concat(pick(True), pick(False), tail)


def any_verified(flags, n: int) -> Column:
    return F.exists(F.slice(as_column(flags), 1, n), lambda f: F.coalesce(f, F.lit(False)))


def readable_fragments(candidate) -> Column:
    """At least one fragment, and each of them readable as it is written."""
    parts = split_fragments(candidate)
    return (F.size(parts) > 0) & F.forall(parts, M.is_readable)


def validity_filter(df: DataFrame, candidates: str, keep: int | None = None) -> DataFrame:
    """Readable candidates, how many were generated and are valid, and the one served."""
    valid = F.filter(candidates, readable_fragments)
    out = df.withColumn("valid", valid).withColumns(
        {
            "candidates_generated": F.size(candidates),
            "candidates_valid": F.size("valid"),
            "served": F.coalesce(F.get("valid", F.lit(0)), F.lit("")),
        }
    )
    return out if keep is None else out.withColumn("valid", F.slice("valid", 1, keep))


def substitute_side(
    test: DataFrame, run: DataFrame, field: str, index: str, candidates: str = "candidates"
) -> DataFrame:
    """The test rows with ``field`` replaced by the first distinct valid candidate.

    No row is dropped: with no valid candidate the field becomes empty text. The reference
    side, the original index and the exact and core flags are kept.
    """
    joined = test.join(run.select(index, candidates), index, "left")
    none = F.array().cast("array<string>")
    joined = joined.withColumn("_c", F.coalesce(candidates, none)).drop(candidates)
    valid = joined.withColumn("_v", dedupe_candidates_valid("_c"))
    served = F.coalesce(F.get("_v", F.lit(0)), F.lit(""))
    return (
        valid.withColumn("cascade_reference_reactants", F.col(field))
        .withColumn(field, served)
        .withColumns(
            {
                "cascade_index": F.col(index),
                "cascade_candidates_generated": F.size("_c"),
                "cascade_candidates_valid": F.size("_v"),
                "cascade_stage1_exact": _served_hit(field, M.canonical_set),
                "cascade_stage1_core_exact": _served_hit(
                    field, lambda p: M.canonical_set(M.strip_auxiliary(p))
                ),
            }
        )
        .drop("_c", "_v")
    )


def _served_hit(field: str, to_set) -> Column:
    served, reference = (
        to_set(split_fragments(c)) for c in (field, "cascade_reference_reactants")
    )
    return (F.col(field) != "") & M.same_set(served, reference)


def stage2_input(kept, mode: str) -> Column:
    """What the second stage reads: all kept candidates dot-joined, or the best one."""
    kept = as_column(kept)
    if mode == "merged":
        return F.array_join(kept, ".")
    if mode == "best":
        return F.get(kept, F.lit(0))
    raise ValueError(f"unknown mode {mode!r}")
