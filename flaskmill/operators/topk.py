"""Top-k scoring of ranked candidate lists.

A run has one row per record with its candidates as an array, best first, no longer than the
beam. Everything about one record is decided inside its row; the scores are one aggregate
over all rows, so scoring does not shuffle records.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flaskmill.constants import (
    CATALYST_GROUP_METALS,
    CATALYST_GROUPS,
    JSON_MISSING,
    SOLVENT_GROUPS,
    TOP_KS,
)
from flaskmill.functions import molecules as M
from flaskmill.functions.text import (
    as_column,
    as_set,
    bind,
    bucket_index,
    is_present,
    literal_array,
    literal_map,
    normalize_components,
    split_fragments,
    strip,
    to_number,
    within_tolerance,
)
from flaskmill.operators.fragments import (
    core_set,
    fragment_names,
    part_sets,
    tag_fragments,
    with_canonical_parts,
)
from flaskmill.operators.roles import (
    classify_role,
    product_context,
    shared_atoms,
)


# --- candidate sets ---------------------------------------------------------------------


def prepare_run(df: DataFrame, candidates: str = "candidates", reference: str = "reference") -> DataFrame:
    """Adds the full and core sets of the reference and of every candidate, and whether the
    first candidate is valid as a whole."""
    # Names apart from what is auxiliary: scores that need no core sets do not ask for the latter.
    parts = df.withColumns({"_ref": split_fragments(reference), "_cands": F.transform(candidates, split_fragments)})
    named = parts.withColumns(
        {"_ref_names": fragment_names("_ref"), "_cand_names": F.transform("_cands", fragment_names)}
    )
    return named.withColumns(
        {
            "ref_set": M.whole_set(F.col("_ref_names")),
            "ref_core": core_set("_ref", "_ref_names"),
            "cand_sets": F.transform("_cand_names", M.whole_set),
            "cand_cores": F.zip_with("_cands", "_cand_names", core_set),
            "top1_valid": F.coalesce(M.is_valid(F.get(candidates, F.lit(0))), F.lit(False)),
        }
    ).drop("_ref", "_cands", "_ref_names", "_cand_names")


def prepare_run_with_dim(
    df: DataFrame,
    record_id: str,
    dim: DataFrame,
    candidates: str = "candidates",
    reference: str = "reference",
) -> DataFrame:
    """The same columns from a fragment dimension with supplied canonical forms."""
    tagged = F.concat(
        tag_fragments(reference, -1),
        F.flatten(F.transform(candidates, lambda c, i: tag_fragments(c, i))),
    )
    back = with_canonical_parts(df, record_id, tagged, dim)
    ref_set, ref_core = part_sets(F.lit(-1))
    each = lambda n: F.transform(candidates, lambda _, i: part_sets(i)[n])
    return back.withColumns(
        {"ref_set": ref_set, "ref_core": ref_core, "cand_sets": each(0), "cand_cores": each(1)}
    ).withColumn("top1_valid", F.coalesce(F.size(F.get("cand_sets", F.lit(0))) > 0, F.lit(False))).drop("_parts")


def first_hit(sets, reference) -> Column:
    """Rank of the first candidate set equal to the reference set; null when none is."""
    return rank_where(as_column(sets), as_column(reference), lambda s, ref: s == ref)


def rank_where(items: Column, reference: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Position of the first item that passes against the reference; null when none does."""
    sure = lambda x, ref: F.coalesce(test(x, ref), F.lit(False))
    hits = bind(reference, lambda ref: F.transform(items, lambda x: sure(x, ref)))
    return F.nullif(F.array_position(hits, True), F.lit(0))


def usable_ks(num_beams: int | None, ks: Sequence[int] = TOP_KS) -> list[int]:
    """Cut-offs the beam can fill."""
    return [k for k in ks if num_beams is None or k <= num_beams]


def share(flag: Column, empty: float | None = 0.0) -> Column:
    """Share of rows with the flag, ``empty`` if there are no rows."""
    rate = F.avg(F.coalesce(flag, F.lit(False)).cast("int"))
    return rate if empty is None else F.coalesce(rate, F.lit(empty))


def hit_rates(rank: Column, name: str, ks: Sequence[int]) -> list[Column]:
    return [share(rank <= k).alias(f"{name}_top{k}") for k in ks]


def topk_scores(prepared: DataFrame, num_beams: int | None = None) -> DataFrame:
    """Exact, core and rank-1 validity rates over all records, in one pass."""
    ks = usable_ks(num_beams)
    ranked = prepared.select(
        first_hit("cand_sets", "ref_set").alias("e"),
        first_hit("cand_cores", "ref_core").alias("c"),
        F.col("top1_valid").alias("v"),
    )
    return ranked.agg(
        F.count("*").alias("total"),
        share(F.col("v")).alias("top1_valid_rate"),
        *hit_rates(F.col("e"), "exact_match", ks),
        *hit_rates(F.col("c"), "core_exact_match", ks),
    )


def topk_exact(prepared: DataFrame, num_beams: int | None = None) -> DataFrame:
    ranked = prepared.select(first_hit("cand_sets", "ref_set").alias("r"))
    return ranked.agg(
        F.count("*").alias("total"), *hit_rates(F.col("r"), "exact_match", usable_ks(num_beams))
    )


def topk_core_exact(prepared: DataFrame, num_beams: int | None = None) -> DataFrame:
    ranked = prepared.select(first_hit("cand_cores", "ref_core").alias("r"))
    return ranked.agg(
        F.count("*").alias("total"), *hit_rates(F.col("r"), "core_exact_match", usable_ks(num_beams))
    )


def top1_valid_rate(prepared: DataFrame) -> DataFrame:
    return prepared.agg(share(F.col("top1_valid")).alias("top1_valid_rate"))


def structure_success_rate(texts) -> Column:
    """Readable share of a list; empty entries fail and an empty list scores 0."""
    texts = as_column(texts)
    good = F.filter(texts, lambda t: F.coalesce((t != "") & M.is_valid(t), F.lit(False)))
    return F.when(F.size(texts) > 0, F.size(good) / F.size(texts)).otherwise(0.0)


def topk_by_view(
    df: DataFrame,
    view: str,
    product: str = "product",
    candidates: str = "candidates",
    reference: str = "reference",
    num_beams: int | None = None,
) -> DataFrame:
    """Hits on sets ``as_written`` or reduced to ``substrates``.

    Unreadable fragments are left out here rather than spoiling their set. Records whose
    reference comes out empty can not hit but stay in the denominator.
    """
    if view not in ("as_written", "substrates"):
        raise ValueError(f"unknown view {view!r}")
    ks = usable_ks(num_beams)

    def molecules(text, context):
        named = F.transform(split_fragments(text), M.canonical_text)
        named = F.filter(named, lambda x: x.isNotNull())
        if view == "substrates":
            keep = lambda f: classify_role(
                f, context["text"], shared_atoms(f, context["bits"])
            )
            named = F.filter(named, lambda f: F.coalesce(keep(f), F.lit(False)))
        return as_set(named)

    def sets(context):
        head = F.slice(candidates, 1, max(ks))
        return F.struct(
            molecules(F.col(reference), context).alias("ref"),
            F.transform(head, lambda c: molecules(c, context)).alias("cands"),
        )

    known = df.select(bind(product_context(M.canonical_text(product)), sets).alias("s"))
    ranked = known.select(
        F.when(F.size("s.ref") > 0, first_hit("s.cands", "s.ref")).alias("r")
    )
    return ranked.agg(F.count("*").alias("total"), *hit_rates(F.col("r"), "exact_match", ks))


# --- condition fields -------------------------------------------------------------------


def _members(groups: dict) -> Column:
    return literal_map({m: g for g, members in groups.items() for m in members})


def solvent_group(component: Column) -> Column:
    return F.try_element_at(_members(SOLVENT_GROUPS), M.canonical_text(component))


METAL = r"\[[^\]]*(?:" + "|".join(CATALYST_GROUP_METALS) + ")"


def catalyst_group(component: Column) -> Column:
    """Curated family, else the alphabetically first group metal in the structure."""
    metals = F.array_intersect(M.elements_of(component), literal_array(CATALYST_GROUP_METALS))
    # Metals stand in brackets only, by their symbols. array_min of none is null, and so is the
    # text built from it.
    by_metal = F.when(
        F.rlike(component, F.lit(METAL)) & M.is_readable(component), F.concat(F.lit("metal_"), F.array_min(metals))
    )
    return F.coalesce(
        F.try_element_at(_members(CATALYST_GROUPS), M.canonical_text(component)), by_metal
    )


CLASSIFIERS: dict[str, Callable[[Column], Column]] = {
    "solvent": solvent_group,
    "catalyst": catalyst_group,
}


def component_groups(value, classifier: Callable[[Column], Column]) -> Column:
    """Families of the components that have one; null when none has."""
    value = as_column(value)
    pieces = F.split(F.replace(value, F.lit(","), F.lit(".")), "[.]")
    parts = F.filter(F.transform(pieces, strip), lambda p: ~p.isin("", JSON_MISSING))
    groups = F.filter(F.transform(parts, classifier), lambda g: g.isNotNull())
    found = bind(as_set(groups), lambda s: F.when(F.size(s) > 0, s))
    return F.when(is_present(value, JSON_MISSING), found)


def string_field_ranks(
    df: DataFrame,
    field: str,
    parsed: str = "parsed",
    classifier: Callable[[Column], Column] | None = None,
    canonical=M.canonical_text,
    num_beams: int | None = None,
    first_answer: bool = False,
) -> DataFrame:
    """Per record: reference set and families, first exact and first same-family rank, and
    whether the rank-1 answer was read and left the field out.

    ``first_answer`` keeps the set of the rank-1 answer, ``{field}_first``, and its families.
    """
    head = F.slice(parsed, 1, max(usable_ks(num_beams)))
    out = df.withColumn(f"{field}_ref", normalize_components(field, canonical))
    # Where nothing is stated no answer can hit, and only the first is asked whether it is silent.
    asked = F.when(F.col(f"{field}_ref").isNull(), F.slice(parsed, 1, 1)).otherwise(head)
    sets = F.transform(asked, lambda p: normalize_components(p[field], canonical))
    out = out.withColumn(f"{field}_sets", sets)
    first = F.lit(0)
    new = {
        f"{field}_rank": first_hit(f"{field}_sets", f"{field}_ref"),
        f"{field}_silent": F.get(parsed, first).isNotNull() & F.get(f"{field}_sets", first).isNull(),
    }
    if first_answer:
        new[f"{field}_first"] = F.get(f"{field}_sets", first)
        if classifier is not None:
            new[f"{field}_first_groups"] = component_groups(F.get(parsed, first)[field], classifier)
    if classifier is not None:
        out = out.withColumn(f"{field}_ref_groups", component_groups(field, classifier))
        groups = F.col(f"{field}_ref_groups")
        new[f"{field}_group_rank"] = rank_where(
            head,
            groups,
            lambda p, g: F.size(F.array_except(g, component_groups(p[field], classifier))) == 0,
        )
    return out.withColumns(new).drop(f"{field}_sets")


def string_field_scores(field: str, ks: Sequence[int], grouped: bool) -> list[Column]:
    """Aggregates over ``string_field_ranks``.

    Exact rates count records that state the field, family rates those that can be
    classified, both whether or not the generation was read; record-level rates count all.
    """
    stated = F.col(f"{field}_ref").isNotNull()
    rank, silent = F.col(f"{field}_rank"), F.col(f"{field}_silent")
    cols = [
        F.count_if(stated).alias(f"{field}_expected_count"),
        share(~stated, None).alias(f"{field}_absent_share"),
        F.avg(F.when(~stated, silent.cast("int"))).alias(f"{field}_silence_correct"),
    ]
    for k in ks:
        hit = F.coalesce(rank <= k, F.lit(False))
        cols.append(F.avg(F.when(stated, hit.cast("int"))).alias(f"{field}_exact_match_top{k}"))
        right = F.when(stated, hit).otherwise(silent)
        cols.append(share(right, None).alias(f"{field}_record_level_top{k}"))
    if grouped:
        known = F.col(f"{field}_ref_groups").isNotNull()
        cols.append(F.count_if(known).alias(f"{field}_same_group_classifiable_count"))
        for k in ks:
            hit = F.coalesce(F.col(f"{field}_group_rank") <= k, F.lit(False))
            cols.append(F.avg(F.when(known, hit.cast("int"))).alias(f"{field}_same_group_top{k}"))
    return cols


def numeric_field_ranks(
    df: DataFrame,
    field: str,
    tolerance: float,
    edges: Sequence[float],
    parsed: str = "parsed",
    force_numeric: bool = False,
    num_beams: int | None = None,
) -> DataFrame:
    """Per record: reference number, first rank within tolerance and first in its bucket.

    ``force_numeric`` drops answers without a number from the first max(k) candidates and
    ranks what is left.
    """
    kind = df.schema[field].dataType.simpleString()
    ref_value = to_number(field) if kind == "string" else F.col(field).cast("double")
    numbers = F.transform(
        F.slice(parsed, 1, max(usable_ks(num_beams))), lambda p: to_number(p[field])
    )
    if force_numeric:
        numbers = F.filter(numbers, lambda x: x.isNotNull())
    ref = F.col(f"{field}_ref")
    return df.withColumns({f"{field}_ref": ref_value, f"{field}_nums": numbers}).withColumns(
        {
            f"{field}_tol_rank": rank_where(
                F.col(f"{field}_nums"), ref, lambda x, r: within_tolerance(x, r, tolerance)
            ),
            f"{field}_bucket_rank": rank_where(
                F.col(f"{field}_nums"),
                ref,
                lambda x, r: bucket_index(x, edges) == bucket_index(r, edges),
            ),
        }
    ).drop(f"{field}_nums")


def numeric_field_scores(field: str, ks: Sequence[int]) -> list[Column]:
    stated = F.col(f"{field}_ref").isNotNull()
    cols = [F.count_if(stated).alias(f"{field}_expected_count")]
    for k in ks:
        for name, rank in (("within_tol", "tol_rank"), ("same_bucket", "bucket_rank")):
            hit = F.coalesce(F.col(f"{field}_{rank}") <= k, F.lit(False))
            cols.append(F.avg(F.when(stated, hit.cast("int"))).alias(f"{field}_{name}_top{k}"))
    return cols


def parsed_rate_top1(parsed="parsed") -> Column:
    return share(F.get(as_column(parsed), F.lit(0)).isNotNull())


def with_first_answer(df: DataFrame, field: str, predicted: Column, classifier=None, canonical=M.canonical_text) -> DataFrame:
    """Adds the sets and families that ``top1_field_scores`` compares, under the names of
    ``string_field_ranks``: worked out once a record, however many rates use them."""
    new = {
        f"{field}_ref": normalize_components(field, canonical),
        f"{field}_first": normalize_components(predicted, canonical),
    }
    if classifier is not None:
        new[f"{field}_ref_groups"] = component_groups(field, classifier)
        new[f"{field}_first_groups"] = component_groups(predicted, classifier)
    return df.withColumns(new)


def top1_field_scores(
    field: str, predicted: Column, classifier=None, canonical=M.canonical_text, ready: bool = False
) -> list[Column]:
    """Single-answer rates: predicted at all, equal set, any shared component, families.

    ``ready``: the rows come from ``with_first_answer`` or ``string_field_ranks``.
    """
    ref_ok, pred_ok = is_present(field, JSON_MISSING), is_present(predicted, JSON_MISSING)
    if ready:
        ref, pred = F.col(f"{field}_ref"), F.col(f"{field}_first")
    else:
        ref, pred = normalize_components(field, canonical), normalize_components(predicted, canonical)
    stated = ref.isNotNull()
    among = lambda base, flag: F.avg(F.when(base, F.coalesce(flag, F.lit(False)).cast("int")))
    cols = [
        F.count_if(ref_ok).alias(f"{field}_expected_count"),
        among(ref_ok, pred_ok).alias(f"{field}_present_rate"),
        among(stated, pred == ref).alias(f"{field}_exact_match_rate"),
        among(stated, F.arrays_overlap(pred, ref)).alias(f"{field}_any_overlap_rate"),
    ]
    if classifier is not None:
        if ready:
            ref_g, pred_g = F.col(f"{field}_ref_groups"), F.col(f"{field}_first_groups")
        else:
            ref_g, pred_g = component_groups(field, classifier), component_groups(predicted, classifier)
        cols.append(F.count_if(ref_g.isNotNull()).alias(f"{field}_same_group_classifiable_count"))
        cols.append(
            among(ref_g.isNotNull(), F.size(F.array_except(ref_g, pred_g)) == 0).alias(f"{field}_same_group_rate")
        )
    return cols


def slice_rate(df: DataFrame, by: str, rank: str, stated: Column, k: int) -> DataFrame:
    """Hit rate at k per value of a record attribute, with the number of records counted."""
    hit = F.coalesce(F.col(rank) <= k, F.lit(False)).cast("int")
    return df.where(stated).groupBy(by).agg(F.count("*").alias("n"), F.avg(hit).alias("rate"))


def always_silent_baseline(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Score of never answering: the share of records without the field."""
    absent = lambda f: normalize_components(f).isNull()
    return df.agg(*[share(absent(f), None).alias(f"{f}_always_silent") for f in fields])


TOP1_SCORES = (
    "expected_count", "present_rate", "exact_match_rate", "any_overlap_rate",
    "same_group_classifiable_count", "same_group_rate",
)


def score_summary(
    df: DataFrame,
    string_fields: Sequence[str],
    numeric_fields: dict[str, tuple[float, Sequence[float]]],
    parsed: str = "parsed",
    num_beams: int | None = None,
    force_numeric: bool = False,
    classifiers: dict | None = None,
    first_answer: bool = False,
    slice_by: str | None = None,
) -> DataFrame:
    """Every score of a conditions run as one row, in one pass over the records.

    ``first_answer`` adds the rates of the first answer alone and the score of never answering;
    ``slice_by`` the exact rates of records with and without that field.
    """
    classifiers = CLASSIFIERS if classifiers is None else classifiers
    ks = usable_ks(num_beams)
    cols = [F.count("*").alias("total"), parsed_rate_top1(parsed).alias("parsed_rate_top1")]
    for field in string_fields:
        classifier = classifiers.get(field)
        df = string_field_ranks(df, field, parsed, classifier, num_beams=num_beams, first_answer=first_answer)
        cols += string_field_scores(field, ks, classifier is not None)
    for field, (tolerance, edges) in numeric_fields.items():
        df = numeric_field_ranks(df, field, tolerance, edges, parsed, force_numeric, num_beams)
        cols += numeric_field_scores(field, ks)
    if first_answer:
        answer = F.get(parsed, F.lit(0))
        for field in string_fields:
            for score, name in zip(
                top1_field_scores(field, answer[field], classifiers.get(field), ready=True), TOP1_SCORES, strict=False
            ):
                cols.append(score.alias(f"{field}_top1_{name}"))
            cols.append(share(F.col(f"{field}_ref").isNull(), None).alias(f"{field}_always_silent"))
    if slice_by is not None:
        for field in string_fields:
            stated = F.col(f"{field}_ref").isNotNull()
            for name, part in (("with", is_present(slice_by)), ("without", ~is_present(slice_by))):
                counted = stated & part
                cols.append(F.count_if(counted).alias(f"{field}_{name}_{slice_by}_count"))
                for k in ks:
                    hit = F.coalesce(F.col(f"{field}_rank") <= k, F.lit(False)).cast("int")
                    cols.append(F.avg(F.when(counted, hit)).alias(f"{field}_{name}_{slice_by}_top{k}"))
    return df.agg(*cols)
