"""End-to-end jobs: from input folders to pools, targets and scores.

Each job reads, composes operators and writes. What several later steps read is staged once
in the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flaskmill.constants import (
    CONDITION_POOL_FIELDS,
    REACTANT_FIELDS,
    RUN_SETTING_KEYS,
    TARGET_FIELDS,
    TEMPERATURE_EDGES,
    TEMPERATURE_TOLERANCE,
    TOP_KS,
    YIELD_EDGES,
    YIELD_TOLERANCE,
)
from flaskmill.functions.rendering import check_fields, parse_generation
from flaskmill.operators import combine, dedupe, leakage, roles, sampling, stats, topk
from flaskmill.operators.extract import normalize_flat_row, normalize_reaction
from flaskmill.session import stage, staging
from flaskmill.sources import readers, writers

PRODUCT = "product_smiles"


def writes(job):
    """What the job stages is deleted when it has written its results."""

    @wraps(job)
    def run(first, *args, **named):
        with staging(first if isinstance(first, SparkSession) else first.sparkSession):
            return job(first, *args, **named)

    return run


CONDITIONS = ("solvent", "temperature_celsius", "catalyst", "yield_percent")
NUMERIC = {
    "temperature_celsius": (TEMPERATURE_TOLERANCE, TEMPERATURE_EDGES),
    "yield_percent": (YIELD_TOLERANCE, YIELD_EDGES),
}


def open_reactions(spark: SparkSession, documents: str) -> DataFrame:
    """Normalised reactions of a document tree, with the place they came from as ``row_id``."""
    docs = readers.read_reaction_documents(spark, documents)
    return normalize_reaction(docs, keep=("row_id",))


@writes
def build_eval_targets(
    spark: SparkSession,
    documents: str,
    out: str,
    count: int = 100,
    cap: int | None = None,
    seed: int = 0,
    exclude: Sequence[str] = (),
) -> None:
    """Distinct products, spread over sources, outside the excluded files."""
    rows = stage(open_reactions(spark, documents))
    held = readers.read_exclusion_keys(spark, exclude, PRODUCT) if exclude else None
    drawn = sampling.stratified_capped_sample(
        rows, count, "source_dataset", PRODUCT, "row_id", seed, cap, held
    )
    writers.write_eval_targets(drawn, out, TARGET_FIELDS)


@writes
def build_flat_targets(
    table: DataFrame, dataset: str, out: str, count: int = 100, seed: int = 0, splits=None
) -> None:
    """Seeded distinct products of a flat table, or of its named splits only."""
    rows = stage(flat_reactions(table, dataset, splits))
    drawn = sampling.seeded_sample_nested(rows, count, seed, PRODUCT, "reaction_id")
    writers.write_eval_targets(drawn, out, REACTANT_FIELDS)


def flat_reactions(table: DataFrame, dataset: str, splits=None) -> DataFrame:
    return normalize_flat_row(readers.read_split(table, splits), dataset)


@writes
def build_flat_pool(
    spark: SparkSession, table: DataFrame, dataset: str, split: str, exclude: str, out: str
) -> None:
    """First row per product of one split, without the held-out products."""
    rows = normalize_flat_row(readers.read_split(table, [split]), dataset, keep=("idx",))
    held = readers.read_exclusion_keys(spark, [exclude], PRODUCT)
    kept = leakage.exclude_holdout(dedupe.dedupe_first(rows, PRODUCT, "idx"), held, PRODUCT)
    writers.write_jsonl(kept, out, REACTANT_FIELDS)


@writes
def build_train_pools(
    spark: SparkSession,
    documents: str,
    exclude: str,
    out: str,
    pool_count: int = 60_000,
    cap: int | None = None,
    seed: int = 42,
    val_count: int = 3_000,
    val_frac: float = 0.05,
    test_frac: float = 0.05,
) -> None:
    """Capped pool, split by count for the reactant task and by share for the conditions."""
    rows = stage(open_reactions(spark, documents))
    held = readers.read_exclusion_keys(spark, [exclude], PRODUCT)
    pool = stage(
        sampling.stratified_capped_sample(
            rows, pool_count, "source_dataset", PRODUCT, "row_id", seed, cap, held
        )
    )
    halves = stage(sampling.split_count(pool, val_count, "row_id", seed))
    for part in ("train", "val"):
        writers.write_jsonl(halves.where(F.col("split") == part), f"{out}/reactants_{part}", REACTANT_FIELDS)
    stated = sampling.require_any(pool, CONDITIONS)
    thirds = stage(sampling.split_fractions(stated, test_frac, val_frac, "row_id", seed))
    for part in ("train", "val", "test"):
        writers.write_jsonl(thirds.where(F.col("split") == part), f"{out}/conditions_{part}", CONDITION_POOL_FIELDS)


POOL_SCHEMA = (
    "product_smiles STRING, reactants_smiles STRING, reagents STRING, full_reactants_smiles STRING, "
    "solvent STRING, catalyst STRING, temperature_celsius DOUBLE, yield_percent DOUBLE"
)


@writes
def build_clean_test(spark: SparkSession, test: str, train: Sequence[str], out: str) -> None:
    """The test rows whose product occurs in none of the training files."""
    rows = readers.read_records(spark, test, POOL_SCHEMA)
    held = readers.read_exclusion_keys(spark, train, PRODUCT)
    writers.write_jsonl(leakage.exclude_holdout(rows, held, PRODUCT), out, rows.columns)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a unique ``row_id``, written once so that it stays the same for every reader."""
    return stage(rows.withColumn("row_id", F.monotonically_increasing_id()))


@writes
def build_roles_pool(
    spark: SparkSession, pool: str, out: str, lookup: str | None = None, drop_empty: bool = False
) -> None:
    """A pool with its reactant side split into substrates and reagents."""
    rows = readers.read_records(spark, pool, POOL_SCHEMA).drop("reagents", "full_reactants_smiles")
    curated = row_id = None
    if lookup is not None:
        row_id, curated = "row_id", readers.read_role_lookup(spark, lookup)
        rows = numbered(rows)
    split = roles.split_roles(rows, row_id=row_id, curated=curated, drop_empty_substrates=drop_empty)
    writers.write_jsonl(split, out, [f.split()[0] for f in POOL_SCHEMA.split(", ")])


@writes
def build_mixed_pool(
    spark: SparkSession, pool: str, test: str, out: str, n_without: int = 80_000, seed: int = 42, fraction: float = 1.0
) -> None:
    """Every row with a temperature and a seeded number without, in seeded order."""
    rows = readers.read_records(spark, pool, POOL_SCHEMA)
    # Rows that are alike share an id and are exchangeable, so the draw depends on content only.
    rows = rows.withColumn("row_id", F.md5(F.to_json(F.struct(*rows.columns))))
    held = readers.read_records(spark, test, POOL_SCHEMA)
    mixed = sampling.mix_by_presence(
        rows, "temperature_celsius", n_without, held, PRODUCT, "row_id", seed, fraction
    )
    writers.write_jsonl(mixed.orderBy("mix_key"), out, [f.split()[0] for f in POOL_SCHEMA.split(", ")])


# --- evaluation ---------------------------------------------------------------------------


def score_candidates(run: DataFrame, num_beams: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, records) of a run whose candidates are deduplicated first."""
    records = run.withColumn("candidates", dedupe.dedupe_candidates_set("candidates"))
    return topk.topk_scores(topk.prepare_run(records), num_beams), records


def score_conditions(
    run: DataFrame, kind: str, fields: Sequence[str], num_beams: int | None = None, force_numeric: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(summary, records) of a conditions run with ``candidates_raw``."""
    fields = check_fields(fields)
    raw = run.withColumn("candidates_raw", dedupe.dedupe_candidates_raw("candidates_raw"))
    records = raw.withColumn(
        "parsed", F.transform("candidates_raw", lambda c: parse_generation(c, kind, fields))
    )
    strings = [f for f in fields if f not in NUMERIC]
    numeric = {f: NUMERIC[f] for f in fields if f in NUMERIC}
    sliced = "temperature_celsius" if "temperature_celsius" in raw.columns else None
    summary = topk.score_summary(
        records, strings, numeric, "parsed", num_beams, force_numeric, first_answer=True, slice_by=sliced
    )
    return summary, records


def merge_condition_chunks(chunks: Sequence[DataFrame], settings: Sequence[str] = RUN_SETTING_KEYS) -> DataFrame:
    """Chunks of one run as one run, to be scored again as a whole."""
    return leakage.merge_chunks(chunks, settings)


def ensemble(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, records) of two runs interleaved record by record."""
    both = leakage.pair_runs(a, b)
    merged = combine.ensemble("candidates_a", "candidates_b")
    records = both.select(
        "record_pos", "product", F.col("reference_a").alias("reference"), merged.alias("candidates")
    )
    return topk.topk_scores(topk.prepare_run(records)), records


def compare_runs(a: DataFrame, b: DataFrame, ks: Sequence[int] = TOP_KS) -> DataFrame:
    """Paired exact test of two runs, exact and core, at every cut-off."""

    def ranks(run):
        ready = topk.prepare_run(run)
        return ready.select(
            "record_pos",
            "product",
            topk.first_hit("cand_sets", "ref_set").alias("exact"),
            topk.first_hit("cand_cores", "ref_core").alias("core"),
        )

    hit = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    metrics = {
        f"{kind}_top{k}": (hit(f"{kind}_a", k), hit(f"{kind}_b", k)) for kind in ("exact", "core") for k in ks
    }
    return stats.mcnemar_exact(leakage.pair_runs(ranks(a), ranks(b)), metrics)


def structure_summary(run: DataFrame, num_beams: int | None = None) -> DataFrame:
    """All scores of a run of structures as rows (score, value): exact, core, first answer valid,
    readable share of the lists, and exact hits in both views."""
    prepared = topk.prepare_run(run)
    parts = {
        "": topk.topk_scores(prepared, num_beams),
        "list_": run.agg(F.avg(topk.structure_success_rate("candidates")).alias("success_rate")),
        "as_written_": topk.topk_by_view(run, "as_written", num_beams=num_beams),
        "substrates_": topk.topk_by_view(run, "substrates", num_beams=num_beams),
    }
    rows = None
    for prefix, part in parts.items():
        names = [c for c in part.columns if c != "total" or not prefix]
        pairs = [F.struct(F.lit(prefix + c).alias("score"), F.col(c).cast("double").alias("value")) for c in names]
        found = part.select(F.inline(F.array(*pairs)))
        rows = found if rows is None else rows.unionByName(found)
    return rows


PAIRED_AT = 5


def compare_condition_runs(a: DataFrame, b: DataFrame, k: int = PAIRED_AT) -> tuple[DataFrame, DataFrame]:
    """(paired exact test, rates) of two conditions runs with ``parsed`` answers.

    The test counts records that state the field. The rates of the text fields are given apart
    for records with and without a temperature.
    """
    strings = ("reagents", "solvent", "catalyst")
    heat = "temperature_celsius"

    def hits(run):
        ranked = run
        for field in strings:
            ranked = topk.string_field_ranks(ranked, field)
        ranked = topk.numeric_field_ranks(ranked, heat, *NUMERIC[heat])
        hit = lambda field, rank: F.when(
            F.col(f"{field}_ref").isNotNull(), F.coalesce(F.col(rank) <= k, F.lit(False))
        ).alias(field)
        return ranked.select(
            "record_pos",
            F.col(PRODUCT).alias("product"),
            *[hit(f, f"{f}_rank") for f in strings],
            hit(heat, f"{heat}_tol_rank"),
            F.col(f"{heat}_ref").isNotNull().alias("stated"),
        )

    both = leakage.pair_runs(hits(a), hits(b))
    metrics = {f"{f}_top{k}": (F.col(f"{f}_a"), F.col(f"{f}_b")) for f in (*strings, heat)}
    sides = [
        F.struct(
            F.lit(f).alias("field"), F.lit(run).alias("run"), F.col(f"stated_{run}").alias("with_temperature"),
            F.col(f"{f}_{run}").alias("hit"),
        )
        for f in strings
        for run in "ab"
    ]
    rates = (
        both.select(F.inline(F.array(*sides)))
        .where(F.col("hit").isNotNull())
        .groupBy("field", "run", "with_temperature")
        .agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("int")).alias("rate"))
    )
    return stats.mcnemar_exact(both, metrics), rates


def oracle_ceiling(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exact, core) rates of two runs, of their merged run, and of a choice that always takes
    the run that hits."""
    both = leakage.pair_runs(a, b)
    lists = {"a": F.col("candidates_a"), "b": F.col("candidates_b"), "merged": combine.ensemble("candidates_a", "candidates_b")}
    # One row per record and list, scored alike.
    long = both.select(
        "record_pos",
        F.col("reference_a").alias("reference"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("list"), c.alias("candidates")) for n, c in lists.items()])),
    )
    ready = topk.prepare_run(long)
    ranks = ready.select(
        "record_pos",
        "list",
        topk.first_hit("cand_sets", "ref_set").alias("exact"),
        topk.first_hit("cand_cores", "ref_core").alias("core"),
    )
    of = lambda kind: ranks.groupBy("record_pos").agg(
        *[F.max(F.when(F.col("list") == n, F.col(kind))).alias(n) for n in lists]
    )
    return tuple(combine.oracle_ceiling(of(kind), "a", "b", "merged") for kind in ("exact", "core"))


def rerank(run: DataFrame, flags: str = "flags", most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(summary, records) with the verified of the first ``most`` candidates in front.

    ``flags`` says of each candidate whether the round trip gave the product back.
    """
    records = run.withColumns(
        {
            "candidates": combine.rerank_verified("candidates", flags, most),
            "verified": combine.any_verified(flags, most),
        }
    )
    summary = topk.topk_scores(topk.prepare_run(records))
    rate = records.agg(topk.share(F.col("verified")).alias("v")).scalar()
    return summary.withColumn("verified_at_least_one_rate", rate), records


@writes
def cascade_inputs(
    spark: SparkSession, test: str, run: DataFrame, out: str, limit: int | None = None, seed: int = 0,
    field: str = "full_reactants_smiles",
) -> None:
    """Test rows whose reactant side is the first stage's best valid answer, appended to ``out``.

    ``run`` has the test row's place in its file as ``cascade_index`` and its candidates. A seeded
    subset keeps its places; rows that ``out`` has already are not written again.
    """
    lines = readers.numbered_lines(spark, test)
    rows = lines.select(
        F.col("position").alias("cascade_index"),
        F.inline(F.array(F.from_json("value", POOL_SCHEMA, {"mode": "FAILFAST"}))),
    )
    if limit is not None:
        rows = sampling.indexed_subset(rows, limit, seed, "cascade_index").drop("subset_key")
    made = combine.substitute_side(rows, run, field, "cascade_index")
    writers.resume_append(made, out, "cascade_index")


def demo_inputs(targets: DataFrame, predictions: DataFrame, count: int, order: str, keep) -> DataFrame:
    """The first ``count`` targets that state a condition, pass ``keep`` and have a valid
    prediction for their product, with that prediction as the reactant side."""
    wanted = targets.where(keep & sampling.has_any(*CONDITIONS))
    both = leakage.attach_predictions(
        wanted, predictions.select(PRODUCT, "candidates", "position"), PRODUCT, "position", order
    )
    valid = F.filter("candidates", lambda c: combine.readable_fragments(c))
    ready = both.withColumn("valid", valid).withColumn("served", F.get("valid", F.lit(0)))
    chosen = sampling.first_n_passing(ready, F.col("served").isNotNull(), count, order)
    scored = topk.prepare_run(
        chosen.select(order, F.array("served").alias("candidates"), F.col("reactants_smiles").alias("reference"))
    ).select(
        order,
        F.coalesce(topk.first_hit("cand_sets", "ref_set") == 1, F.lit(False)).alias("exact_match_top1"),
        F.coalesce(topk.first_hit("cand_cores", "ref_core") == 1, F.lit(False)).alias("core_exact_match_top1"),
    )
    return chosen.select(
        order,
        PRODUCT,
        F.col("served").alias("reactants_smiles"),
        F.col("reactants_smiles").alias("reference_reactants_smiles"),
        F.size("candidates").alias("candidates_generated"),
        F.size("valid").alias("candidates_valid"),
        F.struct(*CONDITIONS).alias("reference_conditions"),
    ).join(scored, order)
