"""Queries for top-k scoring, combining and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from flaskmill.constants import (
    TEMPERATURE_EDGES,
    TEMPERATURE_TOLERANCE,
    TOP_KS,
    YIELD_EDGES,
    YIELD_TOLERANCE,
)
from flaskmill.functions.text import normalize_components
from flaskmill.functions.molecules import canonical_text
from flaskmill.operators import combine, dedupe, leakage, stats, topk
from flaskmill.operators.fragments import build_fragment_dim
from flaskmill.plans import fixtures as X
from flaskmill.plans.registry import query

KS = TOP_KS


def rates(rank: str, name: str) -> str:
    return ", ".join(
        f"avg(CASE WHEN {rank} <= {k} THEN 1 ELSE 0 END) AS {name}_top{k}" for k in KS
    )


@query("topk_exact", f"{X.RUN_A_SQL} SELECT count(*) AS total, {rates('e_rank', 'exact_match')} FROM scored")
def topk_exact(spark, folder):
    return topk.topk_exact(topk.prepare_run(X.run(spark, folder)))


@query("topk_core_exact", f"{X.RUN_A_SQL} SELECT count(*) AS total, {rates('c_rank', 'core_exact_match')} FROM scored")
def topk_core_exact(spark, folder):
    return topk.topk_core_exact(topk.prepare_run(X.run(spark, folder)))


@query("top1_valid_rate", f"{X.RUN_A_SQL} SELECT avg(v1::INT) AS top1_valid_rate FROM scored")
def top1_valid_rate(spark, folder):
    return topk.top1_valid_rate(topk.prepare_run(X.run(spark, folder)))


@query(
    "topk_scores",
    f"""{X.RUN_A_SQL} SELECT count(*) AS total, avg(v1::INT) AS top1_valid_rate,
    {rates('e_rank', 'exact_match')}, {rates('c_rank', 'core_exact_match')} FROM scored""",
)
def topk_scores(spark, folder):
    return topk.topk_scores(topk.prepare_run(X.run(spark, folder)))


@query(
    "topk_scores_with_canonical_map",
    f"""WITH {X.RECORDS_SQL},
    {X.dim_sql(X.fragments_of_runs("l_partkey")).replace("dim AS (", "lexical AS (")},
    dim AS (SELECT * REPLACE (CASE WHEN raw = 'OCC' THEN 'CCO' ELSE canonical END AS canonical)
            FROM lexical),
    {X.sets_sql("rsets", "recs", "rid", "reference")},
    {X.scored_sql().replace("t.cand IN (FROM cvalid)", "c.set_text IS NOT NULL")}
    SELECT count(*) AS total, avg(v1::INT) AS top1_valid_rate,
    {rates('e_rank', 'exact_match')}, {rates('c_rank', 'core_exact_match')} FROM scored""",
)
def topk_scores_with_canonical_map(spark, folder):
    run = X.run(spark, folder)
    given = spark.createDataFrame([("OCC", "CCO")], "raw string, canonical string")
    texts = run.select("reference", F.array_join("candidates", ".").alias("c"))
    dim = build_fragment_dim([(texts, ["reference", "c"])], given)
    return topk.topk_scores(topk.prepare_run_with_dim(run, "record_pos", dim))


@query(
    "structure_success_rate",
    f"""{X.RUN_A_SQL} SELECT rid AS record_pos,
    coalesce(avg(CASE WHEN c.cand IN (FROM cvalid) THEN 1 ELSE 0 END) FILTER (WHERE c.rank IS NOT NULL), 0.0) AS rate
    FROM recs LEFT JOIN cands c USING (rid) GROUP BY rid""",
)
def structure_success_rate(spark, folder):
    rate = topk.structure_success_rate("candidates")
    return X.run(spark, folder).select("record_pos", rate.alias("rate"))


@query(
    "topk_by_view_as_written",
    f"""WITH {X.RECORDS_SQL},
    {X.dim_sql(X.fragments_of_runs("l_partkey"))},
    {X.run_sql("cands")},
    known AS (SELECT r.rid, string_agg(DISTINCT d.canonical, ' ' ORDER BY d.canonical) AS s
      FROM (SELECT rid, unnest(string_split(reference, '.')) AS f FROM recs) r
      JOIN dim d ON d.raw = r.f GROUP BY r.rid),
    cknown AS (SELECT c.rid, c.rank, string_agg(DISTINCT d.canonical, ' ' ORDER BY d.canonical) AS s
      FROM (SELECT rid, rank, unnest(string_split(cand, '.')) AS f FROM cands) c
      JOIN dim d ON d.raw = c.f GROUP BY c.rid, c.rank),
    hit AS (SELECT k.rid, min(CASE WHEN c.s = k.s THEN c.rank END) AS r
      FROM known k LEFT JOIN cknown c USING (rid) GROUP BY k.rid)
    SELECT count(*) AS total, {rates('r', 'exact_match')} FROM hit""",
)
def topk_by_view_as_written(spark, folder):
    return topk.topk_by_view(X.run(spark, folder), "as_written")


def _substrates_sql() -> str:
    from flaskmill.plans.chemistry import roles_sql

    texts = "SELECT f FROM (" + X.fragments_of_runs("l_partkey") + ") UNION ALL SELECT product FROM recs"
    return f"""WITH {X.RECORDS_SQL}, {X.dim_sql(texts)}, {X.run_sql("cands")},
    prods AS (SELECT rid, reference, coalesce(d.canonical, '') AS product FROM recs JOIN dim d ON d.raw = recs.product),
    parts AS (
      SELECT rid, 0 AS rank, product, unnest(string_split(reference, '.')) AS f0 FROM prods
      UNION ALL SELECT rid, rank, product, unnest(string_split(cand, '.')) FROM cands JOIN prods USING (rid) WHERE rank <= 5),
    known AS (SELECT rid, rank, product, d.canonical AS f FROM parts JOIN dim d ON d.raw = f0 WHERE d.canonical IS NOT NULL),
    {roles_sql("SELECT DISTINCT f, product FROM known")},
    sets AS (SELECT rid, rank, string_agg(DISTINCT k.f, ' ' ORDER BY k.f) AS s
      FROM known k JOIN judged j ON j.f = k.f AND j.product = k.product WHERE j.substrate GROUP BY rid, rank),
    hit AS (SELECT r.rid, min(CASE WHEN c.s = k.s THEN c.rank END) AS r FROM recs r
      LEFT JOIN sets k ON k.rid = r.rid AND k.rank = 0 LEFT JOIN sets c ON c.rid = r.rid AND c.rank > 0 GROUP BY r.rid)
    SELECT count(*) AS total, {rates('r', 'exact_match')} FROM hit"""


@query("topk_by_view_substrates", _substrates_sql())
def topk_by_view_substrates(spark, folder):
    return topk.topk_by_view(X.run(spark, folder), "substrates")


# --- candidate lists ----------------------------------------------------------------------

READABLE_SQL = """readable AS (SELECT rid, rank, bool_and(d.raw_ok) AS ok
      FROM (SELECT rid, rank, unnest(string_split(cand, '.')) AS f FROM cands) p
      JOIN dim d ON d.raw = p.f GROUP BY rid, rank),"""
LISTS = "coalesce(string_agg(cand, ' ' ORDER BY rank), '')"


@query(
    "dedupe_candidates_set",
    f"""{X.RUN_A_SQL},
    keyed AS (SELECT c.rid, c.rank, c.cand, coalesce('s:' || s.set_text, 't:' || c.cand) AS key
              FROM cands c JOIN csets s USING (rid, rank)),
    kept AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY rid, key ORDER BY rank) = 1)
    SELECT rid AS record_pos, {LISTS} AS kept FROM recs LEFT JOIN kept USING (rid) GROUP BY rid""",
)
def dedupe_candidates_set(spark, folder):
    kept = F.array_join(dedupe.dedupe_candidates_set("candidates"), " ")
    return X.run(spark, folder).select("record_pos", kept.alias("kept"))


@query(
    "dedupe_candidates_valid",
    f"""{X.RUN_A_SQL},
    kept AS (SELECT c.rid, c.rank, c.cand FROM cands c JOIN csets s USING (rid, rank)
      WHERE s.set_text IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY rid, s.set_text ORDER BY rank) = 1)
    SELECT rid AS record_pos, {LISTS} AS kept FROM recs LEFT JOIN kept USING (rid) GROUP BY rid""",
)
def dedupe_candidates_valid(spark, folder):
    kept = F.array_join(dedupe.dedupe_candidates_valid("candidates"), " ")
    return X.run(spark, folder).select("record_pos", kept.alias("kept"))


@query(
    "dedupe_candidates_raw",
    f"""WITH {X.GENERATIONS_SQL},
    kept AS (SELECT rid, txt, min(raw_rank) AS rank FROM gens GROUP BY rid, txt)
    SELECT rid AS record_pos, string_agg(txt, ' ' ORDER BY rank) AS kept FROM kept GROUP BY rid""",
)
def dedupe_candidates_raw(spark, folder):
    kept = F.array_join(dedupe.dedupe_candidates_raw("candidates_raw"), " ")
    return X.generations(spark, folder).select("record_pos", kept.alias("kept"))


@query(
    "dedupe_parsed",
    f"""WITH {X.CONDITION_RECORDS_SQL}, {X.PARSED_SQL},
    answers AS (SELECT rid, rank,
        concat_ws('|', {", ".join(f"coalesce({f}, '?')" for f in X.FIELDS)}) AS a FROM parsed WHERE ok),
    firsts AS (SELECT rid, a, min(rank) AS rank FROM answers GROUP BY rid, a),
    kept AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY rid ORDER BY rank) <= 3)
    SELECT rid AS record_pos, coalesce(string_agg(a, ' ' ORDER BY rank), '') AS kept
    FROM recs LEFT JOIN kept USING (rid) GROUP BY rid""",
)
def dedupe_parsed(spark, folder):
    answer = lambda p: F.concat_ws("|", *[F.coalesce(p[f], F.lit("?")) for f in X.FIELDS])
    run = X.condition_run(spark, folder).withColumn("kept", dedupe.dedupe_parsed("parsed", 3))
    return run.select("record_pos", F.array_join(F.transform("kept", answer), " ").alias("kept"))


INTERLEAVED_SQL = f"""{X.RUN_AB_SQL},
    both_lists AS (SELECT rid, rank, 0 AS src, cand FROM cands_a
                   UNION ALL SELECT rid, rank, 1, cand FROM cands_b),
    placed AS (SELECT b.*, coalesce(sa.set_text, sb.set_text) AS set_text,
                      coalesce(sa.core_text, sb.core_text) AS core_text
      FROM both_lists b
      LEFT JOIN csets_a sa ON b.src = 0 AND sa.rid = b.rid AND sa.rank = b.rank
      LEFT JOIN csets_b sb ON b.src = 1 AND sb.rid = b.rid AND sb.rank = b.rank),
    firsts AS (SELECT * FROM placed QUALIFY row_number() OVER (
      PARTITION BY rid, coalesce('s:' || set_text, 't:' || cand) ORDER BY rank, src) = 1),
    both_valid AS (FROM cvalid_a UNION FROM cvalid_b),
    merged AS (SELECT rid, cand, set_text, core_text,
      row_number() OVER (PARTITION BY rid ORDER BY rank, src) AS rank FROM firsts),
    scored_m AS (SELECT r.rid,
         min(CASE WHEN c.set_text = s.set_text THEN c.rank END) AS e_rank,
         min(CASE WHEN c.core_text = s.core_text THEN c.rank END) AS c_rank,
         coalesce(bool_or(c.rank = 1 AND c.cand IN (FROM both_valid)), false) AS v1
       FROM recs r JOIN rsets s USING (rid) LEFT JOIN merged c USING (rid) GROUP BY r.rid)"""


def paired(spark, folder):
    a = X.run(spark, folder, "l_partkey")
    b = X.run(spark, folder, "l_suppkey").select("record_pos", "product", "candidates")
    both = leakage.pair_runs(a, b)
    return both.withColumn("merged", combine.ensemble("candidates_a", "candidates_b"))


@query(
    "pair_runs",
    f"""WITH {X.RECORDS_SQL}, {X.run_sql("cands_a", "l_partkey")}, {X.run_sql("cands_b", "l_suppkey")},
    na AS (SELECT rid, count(*) AS n FROM cands_a GROUP BY rid),
    nb AS (SELECT rid, count(*) AS n FROM cands_b GROUP BY rid)
    SELECT rid AS record_pos, product, coalesce(na.n, 0)::INT AS n_a, coalesce(nb.n, 0)::INT AS n_b
    FROM recs LEFT JOIN na USING (rid) LEFT JOIN nb USING (rid)""",
)
def pair_runs(spark, folder):
    a = X.run(spark, folder, "l_partkey").select("record_pos", "product", "candidates")
    b = X.run(spark, folder, "l_suppkey").select("record_pos", "product", "candidates")
    return leakage.pair_runs(a, b).select(
        "record_pos", "product", F.size("candidates_a").alias("n_a"), F.size("candidates_b").alias("n_b")
    )


@query(
    "interleave_ensemble",
    f"""{INTERLEAVED_SQL} SELECT count(*) AS total, avg(v1::INT) AS top1_valid_rate,
    {rates('e_rank', 'exact_match')}, {rates('c_rank', 'core_exact_match')} FROM scored_m""",
)
def interleave_ensemble(spark, folder):
    merged = paired(spark, folder).select(
        F.col("reference_a").alias("reference"), F.col("merged").alias("candidates")
    )
    return topk.topk_scores(topk.prepare_run(merged))


def ranked_pair(spark, folder, lists=("candidates_a", "candidates_b", "merged")):
    """Exact and core ranks of the named lists."""
    both = paired(spark, folder).withColumnRenamed("reference_a", "reference")
    out = both.select("record_pos", "reference", "candidates_a", "candidates_b", "merged")
    for name in lists:
        ranked = topk.prepare_run(out, name)
        out = ranked.withColumns(
            {
                f"{name}_e": topk.first_hit("cand_sets", "ref_set"),
                f"{name}_c": topk.first_hit("cand_cores", "ref_core"),
            }
        ).drop("cand_sets", "cand_cores", "ref_set", "ref_core", "top1_valid")
    return out.drop("candidates_a", "candidates_b", "merged", "reference")


def _ceiling_sql(kind: str) -> str:
    cols = []
    for k in KS:
        flag = lambda t: f"(coalesce({t}.{kind}_rank <= {k}, false))"
        a, b, m = flag("a"), flag("b"), flag("m")
        cols += [
            f"avg({a}::INT) AS a_top{k}", f"avg({b}::INT) AS b_top{k}", f"avg({m}::INT) AS merged_top{k}",
            f"avg(({a} OR {b})::INT) AS oracle_top{k}",
            f"avg(({a} OR {b})::INT) - avg({m}::INT) AS headroom_top{k}",
        ]
    return f"""{INTERLEAVED_SQL} SELECT {", ".join(cols)}
    FROM scored_a a JOIN scored_b b USING (rid) JOIN scored_m m USING (rid)"""


@query("oracle_ceiling", _ceiling_sql("e"))
def oracle_ceiling(spark, folder):
    return combine.oracle_ceiling(ranked_pair(spark, folder), "candidates_a_e", "candidates_b_e", "merged_e")


@query("oracle_ceiling_core", _ceiling_sql("c"))
def oracle_ceiling_core(spark, folder):
    return combine.oracle_ceiling(ranked_pair(spark, folder), "candidates_a_c", "candidates_b_c", "merged_c")


def _mcnemar_sql() -> str:
    rows = []
    for kind, name in (("e", "exact"), ("c", "core")):
        for k in KS:
            a, b = (f"coalesce({t}.{kind}_rank <= {k}, false)" for t in "ab")
            rows.append(
                f"SELECT '{name}_top{k}' AS metric, count(*) AS n, avg(({a})::INT) AS rate_a, "
                f"avg(({b})::INT) AS rate_b, count(*) FILTER ({a} AND NOT {b}) AS only_a, "
                f"count(*) FILTER ({b} AND NOT {a}) AS only_b "
                f"FROM scored_a a JOIN scored_b b USING (rid)"
            )
    terms = """SELECT metric, sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1)
        - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2.0))) AS tail
      FROM (SELECT *, unnest(range(0, least(only_a, only_b) + 1)) AS i FROM counts) GROUP BY metric"""
    return f"""{X.RUN_AB_SQL}, counts AS ({" UNION ALL ".join(rows)}), tails AS ({terms})
    SELECT metric, n, rate_a, rate_b, only_a, only_b, round(least(1.0, 2 * tail), 6) AS p,
      CASE WHEN tail > 0 THEN round(log10(least(1.0, 2 * tail)), 6) ELSE -999.0 END AS log10_p
    FROM counts JOIN tails USING (metric)"""


@query("mcnemar_exact", _mcnemar_sql())
def mcnemar_exact(spark, folder):
    hit = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    metrics = {
        f"{name}_top{k}": (hit(f"candidates_a_{kind}", k), hit(f"candidates_b_{kind}", k))
        for kind, name in (("e", "exact"), ("c", "core"))
        for k in KS
    }
    tested = stats.mcnemar_exact(
        ranked_pair(spark, folder, ("candidates_a", "candidates_b")), metrics
    )
    # The logarithm tells small p-values apart, which six decimals do not.
    small = F.when(F.col("p") > 0, F.round(F.log10("p"), 6)).otherwise(-999.0)
    return tested.withColumn("log10_p", small).withColumn("p", F.round("p", 6))


@query(
    "rerank_verified",
    f"""WITH {X.RECORDS_SQL}, {X.run_sql("cands")},
    flagged AS (SELECT *, length(cand) % 3 = 0 AND rank <= 4 AS ok FROM cands)
    SELECT rid AS record_pos,
      coalesce(string_agg(cand, ' ' ORDER BY rank > 4, NOT ok, rank), '') AS reranked,
      coalesce(bool_or(ok), false) AS any_verified
    FROM recs LEFT JOIN flagged USING (rid) GROUP BY rid""",
)
def rerank_verified(spark, folder):
    run = X.run(spark, folder).withColumn(
        "flags", F.transform("candidates", lambda c: F.length(c) % 3 == 0)
    )
    return run.select(
        "record_pos",
        F.array_join(combine.rerank_verified("candidates", "flags", 4), " ").alias("reranked"),
        combine.any_verified("flags", 4).alias("any_verified"),
    )


@query(
    "validity_filter",
    f"""{X.RUN_A_SQL},
    {READABLE_SQL}
    valid AS (SELECT c.* FROM cands c JOIN readable s USING (rid, rank) WHERE s.ok),
    n AS (SELECT rid, count(*) AS n FROM cands GROUP BY rid)
    SELECT recs.rid AS record_pos, coalesce(any_value(n.n), 0)::INT AS candidates_generated,
      count(valid.cand)::INT AS candidates_valid, coalesce(arg_min(valid.cand, valid.rank), '') AS served,
      coalesce(string_agg(valid.cand, '.' ORDER BY valid.rank) FILTER (WHERE true), '') AS merged
    FROM recs LEFT JOIN valid USING (rid) LEFT JOIN n USING (rid) GROUP BY recs.rid""",
)
def validity_filter(spark, folder):
    kept = combine.validity_filter(X.run(spark, folder), "candidates")
    return kept.select(
        "record_pos", "candidates_generated", "candidates_valid", "served",
        combine.stage2_input("valid", "merged").alias("merged"),
    )


@query(
    "substitute_side",
    f"""{X.RUN_A_SQL},
    kept AS (SELECT c.rid, c.rank, c.cand, s.set_text, s.core_text
      FROM cands c JOIN csets s USING (rid, rank) WHERE s.set_text IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY rid, s.set_text ORDER BY rank) = 1),
    best AS (SELECT rid, count(*) AS n, arg_min(cand, rank) AS cand, arg_min(set_text, rank) AS st,
             arg_min(core_text, rank) AS ct FROM kept GROUP BY rid),
    n AS (SELECT rid, count(*) AS n FROM cands GROUP BY rid)
    SELECT recs.rid AS cascade_index, coalesce(best.cand, '') AS reference,
      reference AS cascade_reference_reactants,
      coalesce(n.n, 0)::INT AS cascade_candidates_generated, coalesce(best.n, 0)::INT AS cascade_candidates_valid,
      coalesce(best.st = rsets.set_text, false) AS cascade_stage1_exact,
      coalesce(best.ct = rsets.core_text, false) AS cascade_stage1_core_exact
    FROM recs JOIN rsets USING (rid) LEFT JOIN best USING (rid) LEFT JOIN n USING (rid)""",
)
def substitute_side(spark, folder):
    run = X.run(spark, folder)
    out = combine.substitute_side(
        X.records(spark, folder), run.select("record_pos", "candidates"), "reference", "record_pos"
    )
    return out.select(
        "cascade_index", "reference", "cascade_reference_reactants", "cascade_candidates_generated",
        "cascade_candidates_valid", "cascade_stage1_exact", "cascade_stage1_core_exact",
    )


@query(
    "stage2_input",
    f"""{X.RUN_A_SQL},
    {READABLE_SQL}
    valid AS (SELECT c.* FROM cands c JOIN readable s USING (rid, rank) WHERE s.ok
      QUALIFY row_number() OVER (PARTITION BY rid ORDER BY rank) <= 2)
    SELECT rid AS record_pos, string_agg(cand, '.' ORDER BY rank) AS merged, arg_min(cand, rank) AS best
    FROM valid GROUP BY rid""",
)
def stage2_input(spark, folder):
    kept = combine.validity_filter(X.run(spark, folder), "candidates", keep=2)
    return kept.where(F.size("valid") > 0).select(
        "record_pos",
        combine.stage2_input("valid", "merged").alias("merged"),
        combine.stage2_input("valid", "best").alias("best"),
    )


# --- condition fields ---------------------------------------------------------------------

NUMBERS = {
    "temperature_celsius": (TEMPERATURE_TOLERANCE, TEMPERATURE_EDGES),
    "yield_percent": (YIELD_TOLERANCE, YIELD_EDGES),
}


def _string_ctes(field: str) -> str:
    grouped = field != "reagents"
    parts = [
        X.components_sql(f"{field}_ref", "recs", "rid", field),
        X.components_sql(f"{field}_pred", "(SELECT * FROM parsed WHERE ok)", "rid, rank", field),
    ]
    if grouped:
        parts += [
            X.groups_sql(f"{field}_rgrp", "recs", "rid", field),
            X.groups_sql(f"{field}_pgrp", "(SELECT * FROM parsed WHERE ok)", "rid, rank", field),
        ]
    group_rank = (
        f"min(CASE WHEN len(list_filter(rg.grps, lambda g: NOT list_contains(pg.grps, g))) = 0 AND pg.grps IS NOT NULL AND p.rank <= 5 THEN p.rank END) AS grank, bool_or(rg.grps IS NOT NULL) AS classifiable"
        if grouped
        else "NULL AS grank, false AS classifiable"
    )
    group_join = (
        f"LEFT JOIN {field}_rgrp rg USING (rid) LEFT JOIN {field}_pgrp pg ON pg.rid = recs.rid AND pg.rank = p.rank"
        if grouped
        else ""
    )
    parts.append(f"""{field}_s AS (
      SELECT recs.rid, bool_or(rr.parts IS NOT NULL) AS stated,
        min(CASE WHEN pp.parts = rr.parts AND p.rank <= 5 THEN p.rank END) AS rank,
        coalesce(bool_or(p.rank = 1 AND p.ok AND pp.parts IS NULL), false) AS silent,
        {group_rank}
      FROM recs LEFT JOIN {field}_ref rr USING (rid) LEFT JOIN parsed p ON p.rid = recs.rid
      LEFT JOIN {field}_pred pp ON pp.rid = recs.rid AND pp.rank = p.rank {group_join}
      GROUP BY recs.rid)""")
    return ",\n".join(parts)


def _string_scores(field: str) -> str:
    cols = [
        f"count(*) FILTER (stated) AS {field}_expected_count",
        f"avg((NOT stated)::INT) AS {field}_absent_share",
        f"avg(silent::INT) FILTER (NOT stated) AS {field}_silence_correct",
    ]
    for k in KS:
        hit = f"coalesce(rank <= {k}, false)"
        cols.append(f"avg({hit}::INT) FILTER (stated) AS {field}_exact_match_top{k}")
        cols.append(f"avg((CASE WHEN stated THEN {hit} ELSE silent END)::INT) AS {field}_record_level_top{k}")
    if field != "reagents":
        cols.append(f"count(*) FILTER (classifiable) AS {field}_same_group_classifiable_count")
        for k in KS:
            cols.append(f"avg(coalesce(grank <= {k}, false)::INT) FILTER (classifiable) AS {field}_same_group_top{k}")
    return ", ".join(cols)


def _number(value: str) -> str:
    return f"try_cast(regexp_replace({value}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"


def _bucket(value: str, edges) -> str:
    return "(" + " + ".join(f"({value} >= {e})::INT" for e in edges) + ")"


def _numeric_cte(field: str, force: bool) -> str:
    tolerance, edges = NUMBERS[field]
    keep = "WHERE x IS NOT NULL" if force else ""
    rank = "row_number() OVER (PARTITION BY rid ORDER BY rank)" if force else "rank"
    return f"""{field}_n AS (SELECT rid, {rank} AS rank, x FROM (
      SELECT rid, rank, {_number(field)} AS x FROM parsed WHERE rank <= 5) {keep}),
    {field}_s AS (
      SELECT recs.rid, any_value(recs.{field}) AS ref,
        min(CASE WHEN abs(n.x - recs.{field}) <= {tolerance} THEN n.rank END) AS tol_rank,
        min(CASE WHEN {_bucket("n.x", edges)} = {_bucket(f"recs.{field}", edges)} THEN n.rank END) AS bucket_rank
      FROM recs LEFT JOIN {field}_n n USING (rid) GROUP BY recs.rid)"""


def _numeric_scores(field: str) -> str:
    cols = [f"count(ref) AS {field}_expected_count"]
    for k in KS:
        for name, rank in (("within_tol", "tol_rank"), ("same_bucket", "bucket_rank")):
            cols.append(f"avg(coalesce({rank} <= {k}, false)::INT) FILTER (ref IS NOT NULL) AS {field}_{name}_top{k}")
    return ", ".join(cols)


def _field_sql(field: str) -> str:
    return f"{X.CONDITIONS_SQL}, {_string_ctes(field)} SELECT {_string_scores(field)} FROM {field}_s"


def _field_query(field: str):
    @query(f"field_scores_{field}", _field_sql(field))
    def scores(spark, folder):
        classifier = topk.CLASSIFIERS.get(field)
        ranked = topk.string_field_ranks(X.condition_run(spark, folder), field, classifier=classifier)
        return ranked.agg(*topk.string_field_scores(field, KS, classifier is not None))

    return scores


for _field in ("reagents", "solvent", "catalyst"):
    _field_query(_field)


def _numeric_query(field: str, force: bool):
    name = f"numeric_scores_{field}" + ("_forced" if force else "")
    sql = f"{X.CONDITIONS_SQL}, {_numeric_cte(field, force)} SELECT {_numeric_scores(field)} FROM {field}_s"

    @query(name, sql)
    def scores(spark, folder):
        tolerance, edges = NUMBERS[field]
        ranked = topk.numeric_field_ranks(
            X.condition_run(spark, folder), field, tolerance, edges, force_numeric=force
        )
        return ranked.agg(*topk.numeric_field_scores(field, KS))

    return scores


for _field in NUMBERS:
    for _force in (False, True):
        _numeric_query(_field, _force)


def _summary_sql() -> str:
    strings = ("reagents", "solvent", "catalyst")
    ctes = [_string_ctes(f) for f in strings] + [_numeric_cte(f, False) for f in NUMBERS]
    heads = [f"(SELECT {_string_scores(f)} FROM {f}_s)" for f in strings]
    heads += [f"(SELECT {_numeric_scores(f)} FROM {f}_s)" for f in NUMBERS]
    first = """(SELECT count(*) AS total, avg(coalesce(p.ok, false)::INT) AS parsed_rate_top1
      FROM recs LEFT JOIN parsed p ON p.rid = recs.rid AND p.rank = 1)"""
    return f"{X.CONDITIONS_SQL}, {', '.join(ctes)} SELECT * FROM " + ", ".join([first, *heads])


@query("score_summary", _summary_sql())
def score_summary(spark, folder):
    return topk.score_summary(
        X.condition_run(spark, folder), ("reagents", "solvent", "catalyst"), NUMBERS
    )


@query(
    "parsed_rate_top1",
    f"""WITH {X.CONDITION_RECORDS_SQL}, {X.PARSED_SQL}
    SELECT avg(coalesce(p.ok, false)::INT) AS parsed_rate_top1
    FROM recs LEFT JOIN parsed p ON p.rid = recs.rid AND p.rank = 1""",
)
def parsed_rate_top1(spark, folder):
    return X.condition_run(spark, folder).agg(topk.parsed_rate_top1().alias("parsed_rate_top1"))


def _top1_sql(field: str) -> str:
    grouped = field != "reagents"
    ctes = [
        X.components_sql("rr", "recs", "rid", field),
        X.components_sql("pp", "(SELECT * FROM parsed WHERE ok AND rank = 1)", "rid", field),
    ]
    overlap = "len(list_intersect(string_split(rr.parts, ' ~ '), string_split(pp.parts, ' ~ '))) > 0"
    cols = [
        f"count(*) FILTER (recs.{field} NOT IN ('', 'not specified')) AS {field}_expected_count",
        f"avg(coalesce(p.{field} NOT IN ('', 'not specified'), false)::INT) FILTER (recs.{field} NOT IN ('', 'not specified')) AS {field}_present_rate",
        f"avg(coalesce(pp.parts = rr.parts, false)::INT) FILTER (rr.parts IS NOT NULL) AS {field}_exact_match_rate",
        f"avg(coalesce({overlap}, false)::INT) FILTER (rr.parts IS NOT NULL) AS {field}_any_overlap_rate",
    ]
    joins = "LEFT JOIN rr USING (rid) LEFT JOIN pp USING (rid) LEFT JOIN parsed p ON p.rid = recs.rid AND p.rank = 1 AND p.ok"
    if grouped:
        ctes += [
            X.groups_sql("rg", "recs", "rid", field),
            X.groups_sql("pg", "(SELECT * FROM parsed WHERE ok AND rank = 1)", "rid", field),
        ]
        joins += " LEFT JOIN rg USING (rid) LEFT JOIN pg USING (rid)"
        cols += [
            f"count(rg.grps) AS {field}_same_group_classifiable_count",
            f"avg(coalesce(pg.grps IS NOT NULL AND len(list_filter(rg.grps, lambda g: NOT list_contains(pg.grps, g))) = 0, false)::INT) FILTER (rg.grps IS NOT NULL) AS {field}_same_group_rate",
        ]
    return f"{X.CONDITIONS_SQL}, {', '.join(ctes)} SELECT {', '.join(cols)} FROM recs {joins}"


def _top1_query(field: str):
    @query(f"top1_field_scores_{field}", _top1_sql(field))
    def scores(spark, folder):
        run = X.condition_run(spark, folder)
        predicted = F.get("parsed", F.lit(0))[field]
        classifier = topk.CLASSIFIERS.get(field)
        run = topk.with_first_answer(run.withColumn("predicted", predicted), field, F.col("predicted"), classifier)
        return run.agg(*topk.top1_field_scores(field, F.col("predicted"), classifier, ready=True))

    return scores


for _field in ("reagents", "solvent", "catalyst"):
    _top1_query(_field)


def _compared_sql(k: int = 5) -> str:
    """The run against itself without its first answers, field by field."""
    shifted = "parsed_b AS (SELECT * REPLACE (rank - 1 AS rank) FROM parsed WHERE rank > 1)"
    heat = "temperature_celsius"
    rows = []
    for field in ("reagents", "solvent", "catalyst", heat):
        if field == heat:
            ctes, hit = _numeric_cte(heat, False), f"CASE WHEN ref IS NOT NULL THEN coalesce(tol_rank <= {k}, false) END"
        else:
            ctes, hit = _string_ctes(field), f"CASE WHEN stated THEN coalesce(rank <= {k}, false) END"
        a = f"({X.CONDITIONS_SQL}, {ctes} SELECT rid, {hit} AS hit FROM {field}_s)"
        b = f"({X.CONDITIONS_SQL}, {shifted}, {ctes.replace('parsed', 'parsed_b')} SELECT rid, {hit} AS hit FROM {field}_s)"
        rows.append(
            f"SELECT '{field}_top{k}' AS metric, count(*) AS n, avg(a.hit::INT) AS rate_a, avg(b.hit::INT) AS rate_b, "
            f"count(*) FILTER (a.hit AND NOT b.hit) AS only_a, count(*) FILTER (b.hit AND NOT a.hit) AS only_b "
            f"FROM {a} a JOIN {b} b USING (rid) WHERE a.hit IS NOT NULL AND b.hit IS NOT NULL"
        )
    terms = """SELECT metric, sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1)
        - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2.0))) AS tail
      FROM (SELECT *, unnest(range(0, least(only_a, only_b) + 1)) AS i FROM counts) GROUP BY metric"""
    return f"""WITH counts AS ({" UNION ALL ".join(rows)}), tails AS ({terms})
    SELECT metric, n, rate_a, rate_b, only_a, only_b, round(least(1.0, 2 * tail), 6) AS p
    FROM counts JOIN tails USING (metric)"""


@query("compare_condition_runs", _compared_sql())
def compare_condition_runs(spark, folder):
    from flaskmill.plans import jobs

    run = X.condition_run(spark, folder)
    later = run.withColumn("parsed", F.slice("parsed", 2, F.greatest(F.size("parsed"), F.lit(1))))
    tested, _ = jobs.compare_condition_runs(run, later, 5)
    return tested.withColumn("p", F.round("p", 6))


SLICE = "temperature_celsius"


def _whole_summary_sql() -> str:
    """The summary, the first answers and the slices side by side."""
    strings = ("reagents", "solvent", "catalyst")
    parts = [f"({_summary_sql()})"]
    for field in strings:
        names = topk.TOP1_SCORES if field != "reagents" else topk.TOP1_SCORES[:4]
        cols = ", ".join(f"{field}_{n} AS {field}_top1_{n}" for n in names)
        parts.append(f"(SELECT {cols} FROM ({_top1_sql(field)}))")
        slices = []
        for name, part in (("with", f"{SLICE} IS NOT NULL"), ("without", f"{SLICE} IS NULL")):
            slices.append(f"count(*) FILTER (stated AND {part}) AS {field}_{name}_{SLICE}_count")
            for k in KS:
                hit = f"avg(coalesce(rank <= {k}, false)::INT) FILTER (stated AND {part})"
                slices.append(f"{hit} AS {field}_{name}_{SLICE}_top{k}")
        parts.append(
            f"({X.CONDITIONS_SQL}, {_string_ctes(field)} SELECT {', '.join(slices)} FROM {field}_s JOIN recs USING (rid))"
        )
    silent = ", ".join(f"avg((coalesce({f}, '') IN ('', 'not specified'))::INT) AS {f}_always_silent" for f in strings)
    parts.append(f"(WITH {X.CONDITION_RECORDS_SQL} SELECT {silent} FROM recs)")
    return "SELECT * FROM " + ", ".join(parts)


@query("score_summary_sliced", _whole_summary_sql())
def score_summary_sliced(spark, folder):
    return topk.score_summary(
        X.condition_run(spark, folder), ("reagents", "solvent", "catalyst"), NUMBERS, first_answer=True, slice_by=SLICE
    )


@query(
    "slice_rate",
    f"""{X.CONDITIONS_SQL}, {_string_ctes("solvent")}
    SELECT temperature_celsius IS NOT NULL AS has_temp, count(*) AS n, avg(coalesce(rank <= 5, false)::INT) AS rate
    FROM solvent_s JOIN recs USING (rid) WHERE stated GROUP BY 1""",
)
def slice_rate(spark, folder):
    ranked = topk.string_field_ranks(X.condition_run(spark, folder), "solvent")
    ranked = ranked.withColumn("has_temp", F.col("temperature_celsius").isNotNull())
    return topk.slice_rate(ranked, "has_temp", "solvent_rank", F.col("solvent_ref").isNotNull(), 5)


@query(
    "always_silent_baseline",
    f"""WITH {X.CONDITION_RECORDS_SQL} SELECT
    {", ".join(f"avg((coalesce({f}, '') IN ('', 'not specified'))::INT) AS {f}_always_silent" for f in ("reagents", "solvent", "catalyst"))}
    FROM recs""",
)
def always_silent_baseline(spark, folder):
    return topk.always_silent_baseline(
        X.condition_records(spark, folder), ("reagents", "solvent", "catalyst")
    )


@query(
    "component_groups",
    f"""{X.CONDITIONS_SQL}, {X.groups_sql("s", "recs", "rid", "solvent")}, {X.groups_sql("c", "recs", "rid", "catalyst")}
    SELECT rid AS record_pos, coalesce(array_to_string(s.grps, ','), '') AS solvent_groups,
      coalesce(array_to_string(c.grps, ','), '') AS catalyst_groups
    FROM recs LEFT JOIN s USING (rid) LEFT JOIN c USING (rid)""",
)
def component_groups(spark, folder):
    groups = lambda f: F.coalesce(
        F.array_join(topk.component_groups(f, topk.CLASSIFIERS[f]), ","), F.lit("")
    )
    return X.condition_records(spark, folder).select(
        "record_pos", groups("solvent").alias("solvent_groups"), groups("catalyst").alias("catalyst_groups")
    )


@query(
    "normalize_components",
    f"""{X.CONDITIONS_SQL}, {X.components_sql("s", "recs", "rid", "solvent")}
    SELECT rid AS record_pos, coalesce(s.parts, '') AS parts FROM recs LEFT JOIN s USING (rid)""",
)
def normalize_components_query(spark, folder):
    parts = F.array_join(normalize_components("solvent", canonical_text), " ~ ")
    return X.condition_records(spark, folder).select(
        "record_pos", F.coalesce(parts, F.lit("")).alias("parts")
    )
