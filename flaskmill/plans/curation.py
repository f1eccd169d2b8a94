"""Queries for exclusion, sampling, splitting, deduplication and corpus statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flaskmill.functions.molecules import canonical_text
from flaskmill.functions.text import (
    first_present,
    has_any,
    has_temperature,
    is_present,
    normalize_components,
)
from flaskmill.operators import dedupe, leakage, ordering, roles, sampling
from flaskmill.plans import fixtures as X
from flaskmill.plans.registry import query, table
from flaskmill.session import stage, staging_dir

SEED = 42
HOLDOUT_SEED = 7
HOLDOUT = 100


def holdout(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ordering.first_by_hash(docs, HOLDOUT, "doc_id", HOLDOUT_SEED).select("text")


HOLDOUT_SQL = f"""holdout AS (SELECT DISTINCT text FROM (
  SELECT text FROM documents ORDER BY md5(concat_ws(':', '{HOLDOUT_SEED}', doc_id)), doc_id LIMIT {HOLDOUT}))"""
OUTSIDE = "(text IS NULL OR text NOT IN (SELECT text FROM holdout))"


def h(key: str, seed=SEED) -> str:
    return f"md5(concat_ws(':', '{seed}', {key}))"


# --- joins and leakage --------------------------------------------------------------------


@query("exclude_holdout", f"WITH {HOLDOUT_SQL} SELECT doc_id, source FROM documents WHERE {OUTSIDE}")
def exclude_holdout(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return leakage.exclude_holdout(docs, holdout(spark, folder), "text").select("doc_id", "source")


@query(
    "exclude_many",
    f"""WITH {HOLDOUT_SQL} SELECT doc_id FROM documents WHERE {OUTSIDE}
    AND text NOT IN (SELECT text FROM benchmark) AND text NOT IN (SELECT text FROM conversations)""",
)
def exclude_many(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    others = [holdout(spark, folder)] + [
        table(spark, folder, n).select("text") for n in ("benchmark", "conversations")
    ]
    return leakage.exclude_many(docs, others, "text").select("doc_id")


def split_documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return sampling.split_fractions(docs, 0.2, 0.1, "doc_id", SEED)


SPLIT_SQL = f"""ranked AS (SELECT *, row_number() OVER (ORDER BY {h('doc_id')}, doc_id) AS rn,
  count(*) OVER () AS n FROM documents),
parts AS (SELECT doc_id, text, source, CASE WHEN rn <= floor(n * 0.2) THEN 'test'
  WHEN rn <= floor(n * 0.2) + floor(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM ranked)"""


@query(
    "leak_report",
    f"""WITH {SPLIT_SQL}, test AS (FROM parts WHERE split = 'test'), train AS (FROM parts WHERE split = 'train')
    SELECT count(*) AS rows_in, count(*) FILTER (k) AS leaked, count(*) FILTER (NOT k) AS kept,
      100.0::DOUBLE * count(*) FILTER (NOT k) / count(*) AS kept_percent,
      count(DISTINCT text) FILTER (k) AS leaked_keys,
      count(DISTINCT (text, source)) FILTER (p) AS leaked_pairs
    FROM (SELECT *, text IN (SELECT text FROM train) AS k,
                 (text, source) IN (SELECT (text, source) FROM train) AS p FROM test)""",
)
def leak_report(spark, folder):
    parts = stage(split_documents(spark, folder))
    test, train = parts.where("split = 'test'"), parts.where("split = 'train'")
    return leakage.leak_report(test, train, "text", ["text", "source"])


@query(
    "attach_predictions",
    """SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN (
      SELECT o_custkey, o_orderkey, o_totalprice FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) ON o_custkey = c_custkey""",
)
def attach_predictions(spark, folder):
    targets = table(spark, folder, "customer").select("c_custkey")
    predictions = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice",
        F.col("o_orderkey").alias("position"),
    )
    return leakage.attach_predictions(targets, predictions, "c_custkey", "position", "c_custkey")


@query(
    "subset_like",
    f"""WITH {X.RECORDS_SQL},
    picked AS (SELECT o_orderkey AS idx, row_number() OVER (ORDER BY {h('o_orderkey', 5)}, o_orderkey) - 1 AS like_pos
      FROM orders ORDER BY {h('o_orderkey', 5)}, o_orderkey LIMIT 500)
    SELECT like_pos, rid AS record_pos, product, reference FROM picked JOIN recs ON rid = idx""",
)
def subset_like(spark, folder):
    from pyspark.sql import Window as W

    full = X.records(spark, folder)
    drawn = sampling.indexed_subset(full, 500, 5, "record_pos")
    # 500 rows, the size of the subset itself.
    order = W.partitionBy(F.lit(0)).orderBy("subset_key", "record_pos")
    like = drawn.select(
        F.col("record_pos").alias("cascade_index"), "product",
        (F.row_number().over(order) - 1).cast("bigint").alias("record_pos"),
    )
    out = leakage.subset_like(full, like, "cascade_index")
    return out.select("like_pos", "record_pos", "product", "reference")


@query(
    "lookup_join",
    f"""WITH {X.dim_sql("SELECT " + X.sql_species("l_partkey") + " AS f FROM lineitem")}
    SELECT coalesce(g.grp, 'none') AS grp, count(*) AS n FROM lineitem
    JOIN dim ON raw = {X.sql_species("l_partkey")}
    LEFT JOIN (VALUES {", ".join(f"('{m}', '{k}')" for k, v in X.SOLVENT_GROUPS.items() for m in v)}) g(member, grp)
      ON member = raw GROUP BY 1""",
)
def lookup_join(spark, folder):
    members = [(m, g) for g, ms in X.SOLVENT_GROUPS.items() for m in ms]
    lookup = spark.createDataFrame(members, "species string, grp string")
    lines = table(spark, folder, "lineitem").select(
        X.species(F.col("l_partkey")).alias("species")
    )
    joined = leakage.lookup_join(lines, "species", lookup)
    return joined.groupBy(F.coalesce("grp", F.lit("none")).alias("grp")).agg(F.count("*").alias("n"))


@query(
    "merge_chunks",
    """SELECT conv_id, turn, role, chunk FROM (
      SELECT *, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS chunk FROM conversations
      WHERE role IN ('system', 'user', 'assistant'))
    QUALIFY text IS NULL OR text = '' OR row_number() OVER (PARTITION BY text ORDER BY chunk, conv_id * 1000 + turn) = 1""",
)
def merge_chunks(spark, folder):
    turns = table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("record_pos"),
        F.lit(5).alias("num_beams"), F.lit("compact").alias("target_format"),
    )
    chunks = [turns.where(F.col("role") == r) for r in ("system", "user", "assistant")]
    merged = leakage.merge_chunks(chunks, ["num_beams", "target_format"], product="text")
    return merged.select("conv_id", "turn", "role", "chunk")


@query(
    "answer_coverage",
    f"""WITH {X.CONDITION_RECORDS_SQL}, {X.dim_sql(" UNION ALL ".join(
        f"SELECT trim(unnest(string_split(replace({f}, ',', '.'), '.'))) AS f FROM recs WHERE {f} IS NOT NULL"
        for f in ("solvent", "catalyst")))},
    {X.components_sql("s", "recs", "rid", "solvent")}, {X.components_sql("c", "recs", "rid", "catalyst")},
    split AS (SELECT o_orderkey AS rid, row_number() OVER (ORDER BY {h('o_orderkey')}, o_orderkey)
      <= floor(count(*) OVER () * 0.2) AS test FROM orders),
    ans AS (SELECT 'solvent' AS answer, rid, parts FROM s UNION ALL SELECT 'catalyst', rid, parts FROM c)
    SELECT answer, count(*) AS stated, count(*) FILTER (hit) AS covered,
      count(*) FILTER (hit)::DOUBLE / count(*) AS share
    FROM (SELECT a.answer, (a.answer, a.parts) IN (SELECT (answer, parts) FROM ans JOIN split USING (rid) WHERE NOT test) AS hit
          FROM ans a JOIN split USING (rid) WHERE test) GROUP BY answer""",
)
def answer_coverage(spark, folder):
    records = X.condition_records(spark, folder)
    parts = stage(sampling.split_fractions(records, 0.2, 0.0, "record_pos", SEED))
    key = lambda f: F.array_join(normalize_components(f, canonical_text), " ~ ")
    return leakage.answer_coverage(
        parts.where("split = 'test'"),
        parts.where("split = 'train'"),
        {"solvent": key("solvent"), "catalyst": key("catalyst")},
    )


@query(
    "mix",
    f"""SELECT doc_key, {h('doc_key')} AS shuffle_key FROM (
      SELECT 'd' || doc_id AS doc_key FROM documents UNION ALL SELECT 'b' || item_id FROM benchmark)""",
)
def mix(spark, folder):
    a = table(spark, folder, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc_key"))
    b = table(spark, folder, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("doc_key"))
    return leakage.mix(a, b, SEED, "doc_key")


@query(
    "mix_written",
    f"""SELECT doc_key, row_number() OVER (ORDER BY {h('doc_key')}, doc_key) - 1 AS place FROM (
      SELECT 'd' || doc_id AS doc_key FROM documents UNION ALL SELECT 'b' || item_id FROM benchmark)""",
)
def mix_written(spark, folder):
    """The mix as files whose names and rows are in the seeded order."""
    path = f"{staging_dir(spark).rstrip('/')}/flaskmill-{uuid.uuid4().hex}"
    leakage.write_mixed(mix(spark, folder), path)
    return leakage.read_mixed(spark, path).select("doc_key", "place")


@query(
    "exclude_large",
    """WITH held AS (SELECT text FROM documents WHERE lang = 'fr' AND text <> '' UNION SELECT text FROM benchmark)
    SELECT doc_id, lang FROM documents WHERE text IS NULL OR text NOT IN (SELECT text FROM held WHERE text IS NOT NULL)""",
)
def exclude_large(spark, folder):
    """Documents whose whole text is neither a French document's nor a benchmark item's."""
    docs = table(spark, folder, "documents")
    held = docs.where("lang = 'fr'").select("text").unionByName(table(spark, folder, "benchmark").select("text"))
    return leakage.exclude_large(docs.select("doc_id", "lang", "text"), held, "text").select("doc_id", "lang")


# --- sampling -----------------------------------------------------------------------------


@query(
    "stratified_capped_sample",
    f"""WITH {HOLDOUT_SQL},
    uniq AS (SELECT doc_id, source FROM documents WHERE {OUTSIDE} AND text <> ''
      QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
    capped AS (SELECT * FROM uniq QUALIFY row_number() OVER (
      PARTITION BY coalesce(nullif(source, ''), 'unknown') ORDER BY {h('doc_id')}, doc_id) <= 30)
    SELECT doc_id, source FROM capped ORDER BY {h('doc_id')}, doc_id LIMIT 300""",
)
def stratified_capped_sample(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    drawn = sampling.stratified_capped_sample(
        docs, 300, "source", "text", "doc_id", SEED, holdout=holdout(spark, folder)
    )
    return drawn.select("doc_id", "source")


@query(
    "stratified_capped_sample_large",
    f"""WITH capped AS (SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (
      PARTITION BY o_orderpriority ORDER BY {h('o_orderkey')}, o_orderkey) <= 1500)
    SELECT o_orderkey, o_orderpriority FROM capped ORDER BY {h('o_orderkey')}, o_orderkey LIMIT 6000""",
)
def stratified_capped_sample_large(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.stratified_capped_sample(
        orders.withColumn("k", F.col("o_orderkey")), 6000, "o_orderpriority", "k", "o_orderkey", SEED, cap=1500
    ).drop("k")


@query(
    "take_unique",
    """SELECT doc_id, lang FROM documents WHERE text <> ''
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 ORDER BY doc_id LIMIT 200""",
)
def take_unique(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return sampling.take_unique(docs, "text", 200, "doc_id").select("doc_id", "lang")


@query(
    "take_unique_large",
    """SELECT o_orderkey, o_custkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 ORDER BY o_orderkey LIMIT 1200""",
)
def take_unique_large(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return sampling.take_unique(orders, "o_custkey", 1200, "o_orderkey")


@query(
    "seeded_sample_nested",
    f"""SELECT doc_id FROM (SELECT doc_id FROM documents WHERE text <> ''
      QUALIFY row_number() OVER (PARTITION BY text ORDER BY {h('doc_id')}, doc_id) = 1)
    ORDER BY {h('doc_id')}, doc_id LIMIT 150""",
)
def seeded_sample_nested(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sampling.seeded_sample_nested(docs, 150, SEED, "text", "doc_id").select("doc_id")


@query(
    "split_count",
    f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {h('o_orderkey')}, o_orderkey)
      <= least(2000, greatest(1, floor(count(*) OVER () / 10))) THEN 'val' ELSE 'train' END AS split FROM orders""",
)
def split_count(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return sampling.split_count(orders, 2000, "o_orderkey", SEED)


@query("split_fractions", f"WITH {SPLIT_SQL} SELECT doc_id, split FROM parts")
def split_fractions(spark, folder):
    return split_documents(spark, folder).select("doc_id", "split")


LABELLED_SQL = "labelled AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def labelled(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.join(table(spark, folder, "labels"), "doc_id", "left")


@query(
    "require_any",
    f"WITH {LABELLED_SQL} SELECT doc_id, lang FROM labelled WHERE quality IS NOT NULL OR toxic IS NOT NULL",
)
def require_any(spark, folder):
    kept = sampling.require_any(labelled(spark, folder).drop("text"), ["quality", "toxic"])
    return kept.select("doc_id", "lang")


@query(
    "require_any_report",
    f"""WITH {LABELLED_SQL} SELECT count(*) FILTER (quality IS NOT NULL OR toxic IS NOT NULL) AS populated,
    count(*) AS total FROM labelled""",
)
def require_any_report(spark, folder):
    return sampling.require_any_report(labelled(spark, folder), ["quality", "toxic"])


MIX_SQL = f"""WITH {HOLDOUT_SQL}, {LABELLED_SQL}, kept AS (FROM labelled WHERE {OUTSIDE}),
    mixed AS (SELECT * FROM kept WHERE quality IS NOT NULL UNION ALL
      (SELECT * FROM kept WHERE quality IS NULL ORDER BY {h('doc_id')}, doc_id LIMIT 200))"""


def mixed(spark, folder):
    return sampling.mix_by_presence(
        labelled(spark, folder), "quality", 400, holdout(spark, folder), "text", "doc_id", SEED, 0.5
    )


@query(
    "mix_by_presence",
    f"{MIX_SQL} SELECT doc_id, quality IS NOT NULL AS labelled, {h('doc_id')} AS mix_key FROM mixed",
)
def mix_by_presence(spark, folder):
    return mixed(spark, folder).select("doc_id", is_present("quality").alias("labelled"), "mix_key")


@query(
    "mix_report",
    f"""{MIX_SQL} SELECT count(*) AS rows, count(quality) AS with_field,
    round(100.0::DOUBLE * avg((quality IS NOT NULL)::INT), 6) AS with_field_percent,
    count(*) - count(quality) AS without_field,
    round(100.0::DOUBLE * avg((lang <> '')::INT), 6) AS other_percent FROM mixed""",
)
def mix_report(spark, folder):
    return sampling.mix_report(mixed(spark, folder), "quality", "lang")


@query(
    "indexed_subset",
    f"""SELECT o_orderkey, {h('o_orderkey', 0)} AS subset_key FROM orders
    ORDER BY {h('o_orderkey', 0)}, o_orderkey LIMIT 3000""",
)
def indexed_subset(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return sampling.indexed_subset(orders, 3000, 0, "o_orderkey")


@query(
    "first_n_passing",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50",
)
def first_n_passing(spark, folder):
    orders = table(spark, folder, "orders")
    passing = (F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F")
    return sampling.first_n_passing(orders, passing, 50, "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    "cap_first_per_source",
    "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7",
)
def cap_first_per_source(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return sampling.cap_first_per_source(docs, 7, "source", "doc_id")


@query(
    "cap_first_per_source_large",
    """SELECT o_orderkey, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 2500""",
)
def cap_first_per_source_large(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.cap_first_per_source(orders, 2500, "o_orderstatus", "o_orderkey")


@query(
    "expand_copies",
    f"""WITH roots AS (SELECT p_partkey, unnest(range(0, p_size)) AS root FROM part),
    drawn AS (SELECT p_partkey, root, row_number() OVER (PARTITION BY p_partkey
      ORDER BY md5(concat_ws(':', '{SEED}', p_partkey, root)), root) AS copy FROM roots)
    SELECT p_partkey, copy::INT AS copy, root::INT AS root FROM drawn WHERE copy <= 4
    UNION ALL SELECT p_partkey, 0, -1 FROM part""",
)
def expand_copies(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_size")
    out = sampling.expand_copies(parts, 5, "p_size", "p_partkey", SEED)
    return out.select("p_partkey", "copy", F.coalesce("root", F.lit(-1)).alias("root"))


@query(
    "bernoulli_flag",
    f"""SELECT o_orderkey, ('0x' || md5(concat_ws(':', '{SEED}', '3', o_orderkey))[1:8])::BIGINT / 4294967296.0::DOUBLE < 0.3 AS flag
    FROM orders""",
)
def bernoulli_flag(spark, folder):
    flag = sampling.bernoulli_flag(0.3, SEED, 3, "o_orderkey")
    return table(spark, folder, "orders").select("o_orderkey", flag.alias("flag"))


# --- deduplication ------------------------------------------------------------------------


@query(
    "dedupe_first",
    "SELECT doc_id, source FROM documents WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)
def dedupe_first(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return dedupe.dedupe_first(docs, "text", "doc_id").select("doc_id", "source")


@query(
    "dedupe_pair",
    f"""WITH {X.CONDITION_RECORDS_SQL},
    {X.dim_sql("SELECT unnest(string_split(reactants_smiles, '.')) AS f FROM recs")},
    {X.sets_sql("s", "recs", "rid", "reactants_smiles")}
    SELECT rid AS record_pos, product_smiles, reactants_smiles FROM recs JOIN s USING (rid)
    QUALIFY row_number() OVER (PARTITION BY product_smiles, coalesce('s:' || set_text, 't:' || reactants_smiles) ORDER BY rid) = 1""",
)
def dedupe_pair(spark, folder):
    rows = X.condition_records(spark, folder).select("record_pos", "product_smiles", "reactants_smiles")
    return dedupe.dedupe_pair(rows, "product_smiles", "reactants_smiles", "record_pos")


# --- presence and statistics --------------------------------------------------------------


@query(
    "read_split",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')",
)
def read_split(spark, folder):
    from flaskmill.sources.readers import read_split as pick

    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return pick(orders, ["F", "P"], "o_orderstatus")


@query(
    "presence",
    f"""WITH {X.CONDITION_RECORDS_SQL} SELECT rid AS record_pos,
    coalesce(reagents, solvent, catalyst, 'none') AS first_one,
    (solvent IS NOT NULL OR temperature_celsius IS NOT NULL OR catalyst IS NOT NULL OR yield_percent IS NOT NULL) AS any_field,
    temperature_celsius IS NOT NULL AS has_temp FROM recs""",
)
def presence(spark, folder):
    return X.condition_records(spark, folder).select(
        "record_pos",
        first_present("reagents", "solvent", "catalyst", F.lit("none")).alias("first_one"),
        has_any("solvent", "temperature_celsius", "catalyst", "yield_percent").alias("any_field"),
        has_temperature().alias("has_temp"),
    )


@query(
    "field_coverage",
    f"""WITH {X.CONDITION_RECORDS_SQL} SELECT
    {", ".join(f"avg(({f} IS NOT NULL)::INT) AS {f}_filled" for f in X.FIELDS)} FROM recs""",
)
def field_coverage(spark, folder):
    return roles.field_coverage(X.condition_records(spark, folder), X.FIELDS)


@query(
    "label_profile",
    f"""WITH {X.CONDITION_RECORDS_SQL},
    {X.dim_sql("SELECT trim(unnest(string_split(replace(solvent, ',', '.'), '.'))) AS f FROM recs WHERE solvent IS NOT NULL")},
    {X.components_sql("s", "recs", "rid", "solvent")},
    counted AS (SELECT parts, count(*) AS n FROM recs LEFT JOIN s USING (rid) GROUP BY parts)
    SELECT sum(n)::BIGINT AS rows, sum(n) FILTER (parts IS NOT NULL)::DOUBLE / sum(n) AS fill_rate,
      count(parts) AS distinct_sets,
      max(n) FILTER (parts IS NOT NULL)::DOUBLE / sum(n) FILTER (parts IS NOT NULL) AS top_share FROM counted""",
)
def label_profile(spark, folder):
    return roles.label_profile(X.condition_records(spark, folder), "solvent", canonical_text)


@query(
    "split_by_presence",
    f"""WITH {X.CONDITION_RECORDS_SQL} SELECT rid AS record_pos, temperature_celsius IS NOT NULL AS with_temperature FROM recs""",
)
def split_by_presence(spark, folder):
    yes, no = roles.split_by_presence(X.condition_records(spark, folder), "temperature_celsius")
    mark = lambda df, flag: df.select("record_pos", F.lit(flag).alias("with_temperature"))
    return mark(yes, True).unionByName(mark(no, False))


@query(
    "species_frequency",
    f"""WITH {X.CONDITION_RECORDS_SQL}
    SELECT f AS species, count(*) AS occurrences FROM (
      SELECT unnest(string_split(reactants_smiles, '.')) AS f FROM recs) WHERE f <> ''
    GROUP BY f ORDER BY occurrences DESC, f LIMIT 10""",
)
def species_frequency(spark, folder):
    return roles.species_frequency(X.condition_records(spark, folder), ["reactants_smiles"], 10)
