"""The fragment dimension: attributes once per distinct fragment, joined back where a
canonical table is supplied.

Purely lexical attributes are column expressions (functions.molecules) and need no join; the
dimension is for reporting and for canonical forms that come from outside.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flaskmill.functions import molecules as M
from flaskmill.functions.text import as_set, bind, split_fragments
from flaskmill.operators.skew import join_spread


def explode_fragments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per fragment occurrence, as column ``raw``."""
    arrays = [split_fragments(c) for c in cols]
    return df.select(F.explode(F.concat(*arrays)).alias("raw"))


def describe_fragments(fragments: DataFrame) -> DataFrame:
    """Lexical attributes of the fragments in ``raw``; other columns stay."""
    text = M.normalize_token("raw")
    return fragments.withColumns(
        {
            "canonical": M.canonical_text("raw"),
            "has_carbon": M.has_carbon(text),
            "net_charge": M.net_charge(text),
            "heavy_atoms": M.heavy_atoms(text),
            "elements": as_set(M.elements_of(text)),
            "is_auxiliary": M.is_auxiliary("raw"),
        }
    ).withColumn("is_valid", F.col("canonical").isNotNull())


def build_fragment_dim(
    sources: Sequence[tuple[DataFrame, Sequence[str]]], canonical_map: DataFrame | None = None
) -> DataFrame:
    """Distinct fragments with their lexical attributes and number of occurrences.

    ``canonical_map(raw, canonical)`` overrides the lexical form for the fragments it lists;
    a null canonical there marks the fragment invalid.
    """
    every = reduce(DataFrame.unionByName, [explode_fragments(df, cols) for df, cols in sources])
    counted = every.groupBy("raw").agg(F.count("*").alias("occurrences"))
    dim = describe_fragments(counted).drop("is_valid")
    if canonical_map is not None:
        # One row per distinct fragment on both sides: nothing to skew.
        named = canonical_map.select("raw", F.col("canonical").alias("_given"), F.lit(True).alias("_listed"))
        given = F.when(F.col("_listed"), F.col("_given")).otherwise(F.col("canonical"))
        dim = dim.join(named, "raw", "left").withColumn("canonical", given).drop("_given", "_listed")
    return dim.withColumn("is_valid", F.col("canonical").isNotNull())


def canonicalise_sets(
    df: DataFrame, id_col: str, text_cols: Sequence[str], dim: DataFrame
) -> DataFrame:
    """For every text column ``c``: ``c_set`` and ``c_core`` (auxiliary fragments dropped).

    Sets are sorted distinct arrays, null when any part is invalid; no fragment at all gives
    the empty set. The fragments of one row come back together once, for all columns.
    """
    tagged = F.concat(*[tag_fragments(c, i) for i, c in enumerate(text_cols)])
    back = with_canonical_parts(df, id_col, tagged, dim)
    new = {}
    for i, c in enumerate(text_cols):
        new[f"{c}_set"], new[f"{c}_core"] = part_sets(F.lit(i))
    return back.withColumns(new).drop("_parts")


def tag_fragments(text, part) -> Column:
    """Fragments of a text, each with the number of the text it belongs to."""
    part = F.lit(part) if isinstance(part, int) else part
    return F.transform(
        split_fragments(text), lambda f: F.struct(part.alias("part"), f.alias("raw"))
    )


def with_canonical_parts(df: DataFrame, id_col: str, tagged: Column, dim: DataFrame) -> DataFrame:
    """``df`` with the looked-up fragments of each row as ``_parts``."""
    parts = df.select(id_col, F.posexplode(tagged).alias("_pos", "_f")).select(
        id_col, "_pos", "_f.part", "_f.raw"
    )
    table = dim.select("raw", "canonical", "is_auxiliary")
    joined = join_spread(parts, table, "raw", [id_col, "_pos"])
    grouped = joined.groupBy(id_col).agg(
        F.collect_list(F.struct("part", "canonical", "is_auxiliary")).alias("_parts")
    )
    none = F.array().cast(grouped.schema["_parts"].dataType)
    return df.join(grouped, id_col, "left").withColumn("_parts", F.coalesce("_parts", none))


def part_sets(part: Column) -> tuple[Column, Column]:
    """Full and core set of one numbered text out of ``_parts``."""
    return named_sets(F.filter("_parts", lambda p: p["part"] == part))


def _set_of(parts: Column) -> Column:
    return bind(F.transform(parts, lambda p: p["canonical"]), M.whole_set)


def lexical_sets(df: DataFrame, text_cols: Sequence[str]) -> DataFrame:
    """The same columns as ``canonicalise_sets`` from the text alone, without any shuffle."""
    new = {}
    for c in text_cols:
        new[f"{c}_set"], new[f"{c}_core"] = named_sets(named_fragments(c))
    return df.withColumns(new)


def fragment_names(parts) -> Column:
    """Canonical form of each fragment."""
    return F.transform(parts, M.canonical_text)


def core_set(parts, names) -> Column:
    """Set of the names of those fragments that are not auxiliary."""
    named = F.zip_with(
        parts, names, lambda f, k: F.struct(k.alias("canonical"), M.is_auxiliary_named(f, k).alias("is_auxiliary"))
    )
    return _set_of(_core(named))


def named_fragments(text) -> Column:
    """Fragments of a text as (canonical, is_auxiliary), each looked at once."""
    named = lambda f, k: F.struct(k.alias("canonical"), M.is_auxiliary_named(f, k).alias("is_auxiliary"))
    return F.transform(split_fragments(text), lambda f: bind(M.canonical_text(f), lambda k: named(f, k)))


def _core(parts: Column) -> Column:
    return F.filter(parts, lambda p: ~F.coalesce(p["is_auxiliary"], F.lit(False)))


def named_sets(parts: Column) -> tuple[Column, Column]:
    """Full and core set of named fragments."""
    return _set_of(parts), _set_of(_core(parts))


def strip_aux(df: DataFrame, col: str, into: str) -> DataFrame:
    """Dot-joined text without auxiliary fragments; unreadable ones stay."""
    return df.withColumn(into, F.array_join(M.strip_auxiliary(split_fragments(col)), "."))


def strip_maps_canonical(df: DataFrame, col: str, into: str) -> DataFrame:
    """Text without atom-map numbers, in order; null if any part is unreadable."""
    return df.withColumn(into, M.unmapped_canonical(col))
