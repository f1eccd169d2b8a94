"""Substrate and reagent roles, and corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flaskmill.constants import (
    CATALYST_METALS,
    COMPONENT_SEPARATOR,
    HELDOUT_REAGENTS,
    INORGANIC_NUCLEOPHILES,
    KNOWN_REAGENTS,
    MIN_SHARED_ATOMS,
    MIN_SHARED_FRACTION,
    NUCLEOPHILE_METALS,
)
from flaskmill.functions import molecules as M
from flaskmill.functions.fingerprints import shingles
from flaskmill.functions.text import (
    atom_map_ids,
    bind,
    is_present,
    literal_array,
    normalize_components,
    split_fragments,
    strip_atom_maps,
)
from flaskmill.operators.skew import join_spread


def shared_atoms(fragment: Column, product_features: Column) -> Column:
    """Estimate of the atoms a fragment shares with the product: its heavy atoms times the
    share of its text features (distinct shingles) that the product has too.

    Stands in for the size of the largest common substructure, which needs a graph matcher;
    pass a real count to ``classify_role`` where one is available.
    """

    def estimate(features):
        common = F.size(F.array_intersect(features, product_features))
        return M.heavy_atoms(fragment) * common / F.size(features)

    return bind(shingles(fragment), estimate)


def product_context(product: Column) -> Column:
    """The product's text and features, computed once for all fragments of a row."""
    return F.struct(product.alias("text"), shingles(product).alias("bits"))


def classify_role(
    fragment: Column,
    product: Column,
    shared: Column,
    curated: Column | None = None,
) -> Column:
    """True for a substrate, false for a reagent; rules in order, the first that applies wins.

    ``fragment`` and ``product`` are canonical texts, null where unreadable, which makes no
    substrate. ``curated`` is the fragment's hand label (``reagent`` or anything else) or null,
    ``shared`` the number of atoms in common with the product.
    """
    curated = F.lit(None).cast("string") if curated is None else curated
    rules = lambda elements: _rules(fragment, product, shared, curated, elements)
    return bind(M.elements_of(fragment), rules)


def _rules(fragment, product, shared, curated, elements) -> Column:
    heavy = F.size(F.filter(elements, lambda e: e != "H"))
    carbon = M.has_carbon(fragment)
    has_any_of = lambda metals: F.arrays_overlap(elements, literal_array(metals))
    enough = lambda s: (s >= MIN_SHARED_ATOMS) & (s >= MIN_SHARED_FRACTION * heavy)
    return (
        F.when(fragment.isNull() | product.isNull(), False)
        .when(fragment.isin(*KNOWN_REAGENTS) | F.coalesce(curated == "reagent", F.lit(False)), False)
        .when(curated.isNotNull() | fragment.isin(*INORGANIC_NUCLEOPHILES), True)
        .when(has_any_of(CATALYST_METALS), False)
        .when(has_any_of(NUCLEOPHILE_METALS) & carbon, True)
        .when(~carbon, False)
        .when(heavy == 1, False)
        .otherwise(F.coalesce(bind(shared, enough), F.lit(False)))
    )


def split_roles(
    df: DataFrame,
    product: str = "product_smiles",
    reactants: str = "reactants_smiles",
    row_id: str | None = None,
    curated: DataFrame | None = None,
    drop_empty_substrates: bool = False,
) -> DataFrame:
    """Reactant side split into substrates (dot-joined) and reagents (comma-joined or null).

    Fragments are canonical, distinct and in order; unreadable ones are dropped, and so are
    rows whose product is unreadable. The full side is kept. Without a curated table the
    work stays inside each row. With one (``smiles, role``), the labels are joined per
    fragment, needing ``row_id``.
    """
    named = (
        df.withColumn("_product", M.canonical_text(product))
        .where(F.col("_product").isNotNull())
        .withColumn("_parts", _canonical_parts(reactants))
    )
    if curated is None:
        none = F.lit(None).cast("string")
        labelled = named.withColumn(
            "_parts",
            F.transform("_parts", lambda f: F.struct(f.alias("f"), none.alias("role"))),
        )
    else:
        labelled = _with_labels(named, row_id, curated)
    judge = lambda p, context: F.struct(
        p["f"].alias("f"),
        classify_role(
            p["f"], context["text"], shared_atoms(p["f"], context["bits"]), p["role"]
        ).alias("keep"),
    )
    judged = bind(
        product_context(F.col("_product")),
        lambda context: F.transform("_parts", lambda p: judge(p, context)),
    )
    pick = lambda flag: F.transform(
        F.filter("_judged", lambda p: p["keep"] == flag), lambda p: p["f"]
    )
    reagents = pick(False)
    out = (
        labelled.withColumn("_judged", judged)
        .withColumn("full_reactants_smiles", F.col(reactants))
        .withColumn(product, F.col("_product"))
        .withColumn(reactants, F.array_join(pick(True), "."))
        .withColumn("reagents", F.when(F.size(reagents) > 0, F.array_join(reagents, COMPONENT_SEPARATOR)))
        .drop("_product", "_parts", "_judged")
    )
    return out.where(F.col(reactants) != "") if drop_empty_substrates else out


def _canonical_parts(reactants: str) -> Column:
    named = F.transform(split_fragments(reactants), M.canonical_text)
    return F.array_distinct(F.filter(named, lambda x: x.isNotNull()))


def _with_labels(named: DataFrame, row_id: str, curated: DataFrame) -> DataFrame:
    parts = named.select(row_id, F.posexplode("_parts").alias("pos", "f"))
    table = curated.select(F.col("smiles").alias("f"), "role")
    joined = join_spread(parts, table, "f", [row_id, "pos"])
    grouped = joined.groupBy(row_id).agg(
        F.array_sort(F.collect_list(F.struct("pos", "f", "role"))).alias("_p")
    )
    kind = "array<struct<f:string,role:string>>"
    back = named.drop("_parts").join(grouped, row_id, "left")
    inner = F.transform("_p", lambda p: F.struct(p["f"].alias("f"), p["role"].alias("role")))
    return back.withColumn("_parts", F.coalesce(inner, F.array().cast(kind))).drop("_p")


def role_summary(split: DataFrame, rows_in: int | Column, drop_empty: bool = False) -> DataFrame:
    """Means over kept rows; shares without substrate or reagent over the input rows.

    With ``drop_empty`` rows without a substrate are counted but not kept.
    """
    substrates = F.size(split_fragments("reactants_smiles"))
    reagents = F.when(
        is_present("reagents"), F.size(F.split("reagents", COMPONENT_SEPARATOR))
    ).otherwise(0)
    marked = split.select(substrates.alias("s"), reagents.alias("r"))
    kept = F.col("s") > 0 if drop_empty else F.lit(True)
    rows_in = F.lit(rows_in) if isinstance(rows_in, int) else rows_in
    return marked.agg(
        F.count_if(kept).alias("rows_written"),
        F.avg(F.when(kept, F.col("s"))).alias("substrates_per_row"),
        F.avg(F.when(kept, F.col("r"))).alias("reagents_per_row"),
        (100.0 * F.count_if(F.col("s") == 0) / rows_in).alias("no_substrate_percent"),
        (100.0 * F.count_if(kept & (F.col("r") == 0)) / rows_in).alias("no_reagent_percent"),
    )


def species_frequency(df: DataFrame, cols: Sequence[str], top_n: int) -> DataFrame:
    """The most frequent fragments; counted map-side first, ties by text."""
    arrays = [split_fragments(c) for c in cols]
    every = df.select(F.explode(F.concat(*arrays)).alias("species"))
    counted = every.groupBy("species").agg(F.count("*").alias("occurrences"))
    return counted.orderBy(F.desc("occurrences"), "species").limit(top_n)


def donation_audit(df: DataFrame, product: str, reactants: str) -> DataFrame:
    """Fragments, and how many share no atom-map id with their product."""
    parts = F.split(reactants, "[.]")
    alone = bind(
        atom_map_ids(product),
        lambda ids: F.filter(parts, lambda f: ~F.arrays_overlap(atom_map_ids(f), ids)),
    )
    return (
        df.select(F.size(parts).alias("n"), F.size(alone).alias("u"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("fragments"),
            F.coalesce(F.sum("u"), F.lit(0)).alias("undonated"),
        )
    )


def role_validation(
    df: DataFrame, product: str, reactants: str, row_id: str, seed, negatives_per_row: int = 2
) -> DataFrame:
    """Confusion of the role rule: every mapped reactant should be a substrate, and seeded
    held-out reagents added to each row should be reagents.

    The held-out list is a fixed literal, so each row carries its own draws: no join.
    """
    draw = F.slice(
        F.array_sort(
            F.transform(
                literal_array(HELDOUT_REAGENTS),
                lambda r: F.struct(
                    F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"), r)).alias("h"),
                    r.alias("f"),
                ),
            )
        ),
        1,
        negatives_per_row,
    )
    unmapped = lambda c: M.canonical_text(strip_atom_maps(c))
    positives = F.filter(F.transform(F.split(reactants, "[.]"), unmapped), lambda x: x.isNotNull())
    judged = lambda fs: bind(
        product_context(F.col("_p")),
        lambda x: F.transform(
            fs, lambda f: classify_role(f, x["text"], shared_atoms(f, x["bits"]))
        ),
    )
    hits = lambda a, flag: F.size(F.filter(a, lambda x: x == flag))
    rows = (
        df.withColumn("_p", unmapped(product))
        .where(F.col("_p").isNotNull())
        .withColumn("_pos", judged(positives))
        .withColumn("_neg", judged(F.transform(draw, lambda d: d["f"])))
    )
    total = rows.agg(
        F.sum(hits(F.col("_pos"), True)).alias("tp"),
        F.sum(hits(F.col("_pos"), False)).alias("fn"),
        F.sum(hits(F.col("_neg"), True)).alias("fp"),
        F.sum(hits(F.col("_neg"), False)).alias("tn"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return total.select(
        "tp", "fn", "fp", "tn",
        ratio(tp, tp + fn).alias("substrate_recall"),
        ratio(tn, tn + fp).alias("reagent_recall"),
        ratio(tn, tn + fn).alias("reagent_precision"),
    )


def field_coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Filled share per field, all in one pass."""
    return df.agg(*[F.avg(is_present(f).cast("int")).alias(f"{f}_filled") for f in fields])


def label_profile(df: DataFrame, field: str, canonical=None) -> DataFrame:
    """Fill rate, number of distinct sets, and share of the most frequent one."""
    named = df.select(normalize_components(field, canonical).alias("s"))
    counted = named.groupBy("s").agg(F.count("*").alias("n"))
    filled = F.col("s").isNotNull()
    total = F.sum("n")
    return counted.agg(
        total.alias("rows"),
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("filled"),
        F.count_if(filled).alias("distinct_sets"),
        F.coalesce(F.max(F.when(filled, F.col("n"))), F.lit(0)).alias("most_frequent"),
    ).select(
        "rows",
        F.when(F.col("rows") > 0, F.col("filled") / F.col("rows")).otherwise(0.0).alias("fill_rate"),
        "distinct_sets",
        F.when(F.col("filled") > 0, F.col("most_frequent") / F.col("filled")).otherwise(0.0).alias("top_share"),
    )


def split_by_presence(df: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """Rows that state the field, and the others."""
    return df.where(is_present(field)), df.where(~is_present(field))
