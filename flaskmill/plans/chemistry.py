"""Queries for structure text, classes, roles and the fragment dimension."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flaskmill.constants import (
    CATALYST_METALS,
    CLASS_ALIASES,
    CLASS_GROUPS,
    CLASS_KEYWORDS,
    HELDOUT_REAGENTS,
    INORGANIC_NUCLEOPHILES,
    KNOWN_REAGENTS,
    NUCLEOPHILE_METALS,
    TEMPERATURE_EDGES,
)
from flaskmill.functions import classes
from flaskmill.functions import molecules as M
from flaskmill.functions import text as T
from flaskmill.operators import extract, fragments, roles
from flaskmill.operators.fragment_store import FragmentStore
from flaskmill.plans import fixtures as X
from flaskmill.plans.registry import heavy_table, query, table
from flaskmill.session import staging_dir


# --- fragments ----------------------------------------------------------------------------

LINE_SPECIES = f"SELECT {X.sql_species('l_partkey')} AS f FROM lineitem"


@query(
    "fragment_dim",
    f"""WITH {X.dim_sql(LINE_SPECIES)}
    SELECT raw, occurrences, coalesce(CASE WHEN raw = 'OCC' THEN 'CCO' ELSE canonical END, '') AS canonical,
      canonical IS NOT NULL AS is_valid, list_contains(elements, 'C') AS has_carbon, charge::INT AS net_charge,
      len(list_filter(elements, lambda e: e <> 'H'))::INT AS heavy_atoms,
      array_to_string(list_sort(list_distinct(elements)), ',') AS elements, aux AS is_auxiliary
    FROM dim""",
)
def fragment_dim(spark, folder):
    lines = table(spark, folder, "lineitem").select(X.species(F.col("l_partkey")).alias("s"))
    given = spark.createDataFrame([("OCC", "CCO")], "raw string, canonical string")
    dim = fragments.build_fragment_dim([(lines, ["s"])], given)
    return dim.withColumn("canonical", F.coalesce("canonical", F.lit(""))).withColumn(
        "elements", F.array_join("elements", ",")
    )


@query(
    "fragment_store",
    f"""WITH {X.dim_sql(LINE_SPECIES)}
    SELECT raw, occurrences, coalesce(canonical, '') AS canonical, canonical IS NOT NULL AS is_valid,
      list_contains(elements, 'C') AS has_carbon, charge::BIGINT AS net_charge,
      len(list_filter(elements, lambda e: e <> 'H')) AS heavy_atoms,
      array_to_string(list_sort(list_distinct(elements)), ',') AS elements, aux AS is_auxiliary
    FROM dim""",
)
def fragment_store(spark, folder):
    """The dimension added up from the parts of a table."""
    lines = table(spark, folder, "lineitem").select("l_returnflag", X.species(F.col("l_partkey")).alias("s"))
    name = uuid.uuid4().hex
    store = FragmentStore(spark, f"fragments_{name}", f"{staging_dir(spark).rstrip('/')}/store-{name}", 16)
    for flag in ("A", "N", "R"):
        store.add(flag, [(lines.where(F.col("l_returnflag") == flag), ["s"])])
    return store.table().withColumns(
        {"canonical": F.coalesce("canonical", F.lit("")), "elements": F.array_join("elements", ",")}
    )



def _two_sets(sets: str) -> str:
    return f"""SELECT rid AS record_pos, coalesce(set_text, 'none') AS full_set,
      coalesce(core_text, 'none') AS core_set FROM {sets}"""


def _set_texts(df, col):
    text = lambda c: F.coalesce(F.array_join(c, " "), F.lit("none"))
    return df.select("record_pos", text(f"{col}_set").alias("full_set"), text(f"{col}_core").alias("core_set"))


REACTANT_DIM = X.dim_sql("SELECT unnest(string_split(reactants_smiles, '.')) AS f FROM recs")


@query(
    "lexical_sets",
    f"""WITH {X.CONDITION_RECORDS_SQL}, {REACTANT_DIM},
    {X.sets_sql("s", "recs", "rid", "reactants_smiles")} {_two_sets("s")}""",
)
def lexical_sets(spark, folder):
    rows = X.condition_records(spark, folder).select("record_pos", "reactants_smiles")
    return _set_texts(fragments.lexical_sets(rows, ["reactants_smiles"]), "reactants_smiles")


@query(
    "canonicalise_sets",
    f"""WITH {X.CONDITION_RECORDS_SQL}, {REACTANT_DIM.replace("dim AS (", "lexical AS (")},
    dim AS (SELECT * REPLACE (CASE WHEN raw = 'OCC' THEN 'CCO' ELSE canonical END AS canonical) FROM lexical),
    {X.sets_sql("s", "recs", "rid", "reactants_smiles")} {_two_sets("s")}""",
)
def canonicalise_sets(spark, folder):
    rows = X.condition_records(spark, folder).select("record_pos", "reactants_smiles")
    given = spark.createDataFrame([("OCC", "CCO")], "raw string, canonical string")
    dim = fragments.build_fragment_dim([(rows, ["reactants_smiles"])], given)
    return _set_texts(
        fragments.canonicalise_sets(rows, "record_pos", ["reactants_smiles"], dim), "reactants_smiles"
    )


@query(
    "strip_aux",
    f"""WITH {X.CONDITION_RECORDS_SQL}, {REACTANT_DIM},
    parts AS (SELECT rid, unnest(string_split(reactants_smiles, '.')) AS f,
      generate_subscripts(string_split(reactants_smiles, '.'), 1) AS pos FROM recs)
    SELECT rid AS record_pos, coalesce(string_agg(f, '.' ORDER BY pos) FILTER (WHERE NOT aux), '') AS core
    FROM parts JOIN dim ON raw = f GROUP BY rid""",
)
def strip_aux(spark, folder):
    rows = X.condition_records(spark, folder).select("record_pos", "reactants_smiles")
    return fragments.strip_aux(rows, "reactants_smiles", "core").select("record_pos", "core")


def mapped(spark, folder):
    """Orders as atom-mapped reactions."""
    key = F.col("o_custkey")
    left = F.concat(
        F.lit("[CH3:"), (key % 7).cast("string"), F.lit("][OH:"), (key % 5).cast("string"),
        F.lit("].Cl[CH2:"), (key % 3).cast("string"), F.lit("]C."), X.species(key),
    )
    right = F.concat(F.lit("[CH3:"), (key % 4).cast("string"), F.lit("][O:"), (key % 5).cast("string"), F.lit("]C"))
    return heavy_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("record_pos"), left.alias("reactants"), right.alias("product")
    )


MAPPED_SQL = f"""mapped AS (SELECT o_orderkey AS rid,
  '[CH3:' || (o_custkey % 7) || '][OH:' || (o_custkey % 5) || '].Cl[CH2:' || (o_custkey % 3) || ']C.'
    || {X.sql_species("o_custkey")} AS reactants,
  '[CH3:' || (o_custkey % 4) || '][O:' || (o_custkey % 5) || ']C' AS product FROM orders)"""


@query(
    "strip_maps_canonical",
    f"""WITH {MAPPED_SQL},
    parts AS (SELECT rid, unnest(string_split(reactants, '.')) AS raw_f,
      generate_subscripts(string_split(reactants, '.'), 1) AS pos FROM mapped),
    {X.dim_sql("SELECT raw_f AS f FROM parts")}
    SELECT rid AS record_pos, coalesce(CASE WHEN bool_and(ok) THEN string_agg(t, '.' ORDER BY pos) END, 'none') AS clean
    FROM (SELECT rid, pos, CASE raw_f WHEN 'NaOH' THEN '[Na+].[OH-]' ELSE regexp_replace(raw_f, ':[0-9]+\\]', ']', 'g') END AS t,
          raw_f <> 'PhBr' AND d.ok AS ok FROM parts JOIN dim d ON d.raw = raw_f) GROUP BY rid""",
)
def strip_maps_canonical(spark, folder):
    out = fragments.strip_maps_canonical(mapped(spark, folder), "reactants", "clean")
    return out.select("record_pos", F.coalesce("clean", F.lit("none")).alias("clean"))


@query(
    "atom_map_ids",
    f"""WITH {MAPPED_SQL} SELECT rid AS record_pos,
    array_to_string(regexp_extract_all(reactants, ':([0-9]+)\\]', 1), ',') AS ids FROM mapped""",
)
def atom_map_ids(spark, folder):
    return mapped(spark, folder).select(
        "record_pos", F.array_join(T.atom_map_ids("reactants"), ",").alias("ids")
    )


@query(
    "donation_audit",
    f"""WITH {MAPPED_SQL}, parts AS (SELECT unnest(string_split(reactants, '.')) AS f, product FROM mapped)
    SELECT count(*) AS fragments, count(*) FILTER (NOT list_has_any(
      regexp_extract_all(f, ':([0-9]+)\\]', 1), regexp_extract_all(product, ':([0-9]+)\\]', 1))) AS undonated FROM parts""",
)
def donation_audit(spark, folder):
    return roles.donation_audit(mapped(spark, folder), "product", "reactants")


@query(
    "parse_reaction",
    f"""WITH {MAPPED_SQL}, rx AS (SELECT rid, CASE rid % 4 WHEN 0 THEN reactants || '>>' WHEN 1 THEN product
      ELSE reactants || '>>' || product || '.' END AS rx FROM mapped),
    sides AS (SELECT rid, list_filter(string_split(string_split(rx, '>>')[1], '.'), lambda x: x <> '') AS l,
      list_filter(string_split(string_split(rx, '>>')[2], '.'), lambda x: x <> '') AS r, contains(rx, '>>') AS two FROM rx)
    SELECT rid AS record_pos, CASE WHEN two AND len(l) > 0 AND len(r) > 0
      THEN len(l) || ' ' || array_to_string(r, ' ') ELSE 'none' END AS parsed FROM sides""",
)
def parse_reaction(spark, folder):
    rid = F.col("record_pos")
    rx = (
        F.when(rid % 4 == 0, F.concat("reactants", F.lit(">>")))
        .when(rid % 4 == 1, F.col("product"))
        .otherwise(F.concat("reactants", F.lit(">>"), "product", F.lit(".")))
    )
    parsed = mapped(spark, folder).select("record_pos", T.parse_reaction(rx).alias("p"))
    text = F.concat_ws(" ", F.size("p.reactants").cast("string"), F.array_join("p.products", " "))
    return parsed.select("record_pos", F.when(F.col("p").isNotNull(), text).otherwise("none").alias("parsed"))


@query(
    "match_flags",
    f"""WITH {X.RECORDS_SQL}, {X.run_sql("cands")}, firsts AS (SELECT rid, cand FROM cands WHERE rank = 1),
    {X.dim_sql(X.fragments_of_runs("l_partkey"))},
    {X.sets_sql("rsets", "recs", "rid", "reference")}, {X.sets_sql("csets", "firsts", "rid", "cand")}
    SELECT rid AS record_pos, coalesce(r.set_text = c.set_text, false) AS exact,
      coalesce(r.core_text = c.core_text, false) AS core FROM rsets r LEFT JOIN csets c USING (rid)""",
)
def match_flags(spark, folder):
    first = F.get("candidates", F.lit(0))
    return X.run(spark, folder).select(
        "record_pos",
        M.is_exact_match(first, "reference").alias("exact"),
        M.is_core_exact_match(first, "reference").alias("core"),
    )


@query(
    "size_filter",
    f"""WITH {X.CONDITION_RECORDS_SQL},
    texts AS (SELECT DISTINCT product_smiles AS f FROM recs UNION SELECT DISTINCT reactants_smiles FROM recs),
    {X.dim_sql("SELECT f FROM texts")},
    size AS (SELECT raw, CASE WHEN raw_ok THEN len({X._sql_elements("raw")}) ELSE 1000000 END AS n FROM dim)
    SELECT rid AS record_pos FROM recs JOIN size p ON p.raw = product_smiles JOIN size r ON r.raw = reactants_smiles
    WHERE p.n <= 10 AND r.n <= 12 AND len(list_filter(string_split(reactants_smiles, '.'), lambda x: x <> '')) <= 2
      AND (catalyst IS NULL OR catalyst = '' OR length(catalyst) <= 8)""",
)
def size_filter(spark, folder):
    keep = extract.size_filter(max_product=10, max_reactants=12, max_fragments=2, max_catalyst_chars=8)
    return X.condition_records(spark, folder).where(keep).select("record_pos")


# --- numbers and classes ------------------------------------------------------------------


@query(
    "to_number",
    r"""SELECT event_id, coalesce(try_cast(regexp_replace(props, '[^0-9.\-]', '', 'g') AS DOUBLE), -1) AS a,
      coalesce(try_cast(regexp_replace(ts::DATE::VARCHAR, '[^0-9.\-]', '', 'g') AS DOUBLE), -1) AS b,
      try_cast(regexp_replace(value::VARCHAR || ' C', '[^0-9.\-]', '', 'g') AS DOUBLE) AS c FROM events""",
)
def to_number(spark, folder):
    missing = lambda c: F.coalesce(c, F.lit(-1.0))
    return table(spark, folder, "events").select(
        "event_id",
        missing(T.to_number("props")).alias("a"),
        missing(T.to_number(F.to_date("ts"))).alias("b"),
        T.to_number(F.concat(F.col("value").cast("string"), F.lit(" C"))).alias("c"),
    )


@query(
    "buckets",
    f"""SELECT event_id, ({" + ".join(f"(value >= {e})::INT" for e in TEMPERATURE_EDGES)}) AS bucket,
      abs(value - user_id) <= 10 AS near FROM events""",
)
def buckets(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        T.bucket_index("value", TEMPERATURE_EDGES).alias("bucket"),
        T.within_tolerance("value", F.col("user_id").cast("double"), 10.0).alias("near"),
    )


LABELS = (
    "1", " 10 ", "Friedel-Crafts acylation", "De-protection", "Boc deprotection", "N-Boc Protection",
    "C-C bond", "carbon carbon coupling", "Ester hydrolysis", "Heteroatom alkylation and arylation",
    "functional_group_interconversion", "Some Other", "", "Suzuki",
)


def _class_sql(label: str) -> str:
    l = f"lower(trim({label}))"
    words = f"replace(replace({l}, '-', ' '), '_', ' ')"
    chain = [f"WHEN {l} = '{k}' THEN '{v}'" for k, v in CLASS_ALIASES.items()]
    chain += [f"WHEN contains({words}, '{k}') THEN '{v}'" for k, v in CLASS_KEYWORDS.items()]
    return f"CASE WHEN {l} = '' THEN NULL {' '.join(chain)} ELSE replace({words}, ' ', '_') END"


CLASS_SQL = f"""labelled AS (SELECT event_id, event_type, {X.sql_list(LABELS)}[1 + user_id % {len(LABELS)}] AS label FROM events),
    named AS (SELECT *, {_class_sql("label")} AS name, {_class_sql("event_type")} AS other FROM labelled)"""


def class_labels(spark, folder):
    label = F.get(T.literal_array(LABELS), (F.col("user_id") % len(LABELS)).cast("int"))
    return table(spark, folder, "events").select("event_id", "event_type", label.alias("label"))


@query(
    "normalize_class",
    f"WITH {CLASS_SQL} SELECT event_id, coalesce(name, 'none') AS name, coalesce(other, 'none') AS other FROM named",
)
def normalize_class(spark, folder):
    name = lambda c: F.coalesce(classes.normalize_class(c), F.lit("none"))
    return class_labels(spark, folder).select(
        "event_id", name("label").alias("name"), name("event_type").alias("other")
    )


TARGETS = ("amidation", "reduction", "suzuki", "deprotection")


@query(
    "class_similarity",
    f"""WITH {CLASS_SQL} SELECT event_id, CASE WHEN name IS NULL THEN 0.0
      WHEN name IN {TARGETS} THEN 1.0
      {" ".join(f"WHEN name IN {g} AND list_has_any({X.sql_list(TARGETS)}, {X.sql_list(g)}) THEN 0.5" for g in CLASS_GROUPS)}
      ELSE 0.0 END::DOUBLE AS similarity FROM named""",
)
def class_similarity(spark, folder):
    return class_labels(spark, folder).select(
        "event_id", classes.class_similarity("label", T.literal_array(TARGETS)).alias("similarity")
    )


# --- roles --------------------------------------------------------------------------------


def _features(c: str) -> str:
    """Distinct runs of three characters; a shorter text is one run."""
    return (
        f"list_distinct([substr({c}, i, 3) FOR i IN range(1, greatest(length({c}) - 2, 1) + 1)])"
    )


def _shared(f: str, product: str) -> str:
    common = f"len(list_intersect({_features(f)}, {_features(product)}))"
    return f"(len({X._sql_elements(f)}) * {common} / len({_features(f)})::DOUBLE)"


def roles_sql(pairs: str, curated: str | None = None) -> str:
    """CTE ``judged``: the pairs (f, product) of canonical texts with the flag ``substrate``."""
    quoted = lambda vs: "(" + ", ".join(f"'{v}'" for v in vs) + ")"
    reagent, labelled, join = "false", "false", ""
    if curated:
        reagent, labelled = "coalesce(k.role = 'reagent', false)", "k.role IS NOT NULL"
        join = f"LEFT JOIN ({curated}) k ON k.smiles = p.f"
    readable = X._sql_readable
    return f"""judged AS (SELECT DISTINCT p.f, p.product, CASE
      WHEN NOT {readable("p.f")} OR NOT {readable("p.product")} THEN false
      WHEN p.f IN {quoted(KNOWN_REAGENTS)} OR {reagent} THEN false
      WHEN {labelled} OR p.f IN {quoted(INORGANIC_NUCLEOPHILES)} THEN true
      WHEN list_has_any({X._sql_elements("p.f")}, {X.sql_list(CATALYST_METALS)}) THEN false
      WHEN list_has_any({X._sql_elements("p.f")}, {X.sql_list(NUCLEOPHILE_METALS)})
        AND list_contains({X._sql_elements("p.f")}, 'C') THEN true
      WHEN NOT list_contains({X._sql_elements("p.f")}, 'C') THEN false
      WHEN len({X._sql_elements("p.f")}) = 1 THEN false
      ELSE {_shared("p.f", "p.product")} >= 3
        AND {_shared("p.f", "p.product")} >= 0.5 * len({X._sql_elements("p.f")})
      END AS substrate FROM ({pairs}) p {join})"""


def _split_roles_sql(curated: str | None = None) -> str:
    return f"""WITH {X.CONDITION_RECORDS_SQL},
    {X.dim_sql("SELECT unnest(string_split(reactants_smiles, '.')) AS f FROM recs UNION ALL SELECT product_smiles FROM recs")},
    rows_in AS (SELECT recs.rid, d.canonical AS product, reactants_smiles AS whole FROM recs
      JOIN dim d ON d.raw = product_smiles WHERE d.canonical IS NOT NULL),
    parts AS (SELECT rid, product, d.canonical AS f, min(pos) AS pos FROM (
        SELECT rid, product, unnest(string_split(whole, '.')) AS f0,
               generate_subscripts(string_split(whole, '.'), 1) AS pos FROM rows_in)
      JOIN dim d ON d.raw = f0 WHERE d.canonical IS NOT NULL GROUP BY rid, product, d.canonical),
    {roles_sql("SELECT DISTINCT f, product FROM parts", curated)},
    split AS (SELECT r.rid, r.product, r.whole,
        coalesce(string_agg(p.f, '.' ORDER BY p.pos) FILTER (WHERE j.substrate), '') AS substrates,
        string_agg(p.f, ', ' ORDER BY p.pos) FILTER (WHERE NOT j.substrate) AS reagents,
        count(p.f) FILTER (WHERE NOT j.substrate) AS n_reagents
      FROM rows_in r LEFT JOIN parts p USING (rid) LEFT JOIN judged j ON j.f = p.f AND j.product = p.product
      GROUP BY r.rid, r.product, r.whole)"""


SPLIT_COLUMNS = """SELECT rid AS record_pos, product AS product_smiles, substrates AS reactants_smiles,
    coalesce(reagents, 'none') AS reagents, whole AS full_reactants_smiles FROM split"""


def _split_output(df):
    return df.select(
        "record_pos", "product_smiles", "reactants_smiles",
        F.coalesce("reagents", F.lit("none")).alias("reagents"), "full_reactants_smiles",
    )


def role_rows(spark, folder):
    return X.condition_records(spark, folder).select("record_pos", "product_smiles", "reactants_smiles")


@query("split_roles", f"{_split_roles_sql()} {SPLIT_COLUMNS}")
def split_roles(spark, folder):
    return _split_output(roles.split_roles(role_rows(spark, folder)))


CURATED = (("CC(=O)O", "reagent"), ("ClCCl", "substrate"), ("CCN(CC)CC", "substrate"), ("CC(=O)[O-]", "substrate"))


@query(
    "split_roles_curated",
    _split_roles_sql(
        "SELECT * FROM (VALUES " + ", ".join(str(c) for c in CURATED) + ") t(smiles, role)"
    )
    + SPLIT_COLUMNS
    + " WHERE substrates <> ''",
)
def split_roles_curated(spark, folder):
    curated = spark.createDataFrame(list(CURATED), "smiles string, role string")
    out = roles.split_roles(
        role_rows(spark, folder), row_id="record_pos", curated=curated, drop_empty_substrates=True
    )
    return _split_output(out)


@query(
    "role_summary",
    f"""{_split_roles_sql()},
    n AS (SELECT CASE WHEN substrates = '' THEN 0 ELSE len(string_split(substrates, '.')) END AS s, n_reagents AS r FROM split)
    SELECT count(*) AS rows_written, avg(s) AS substrates_per_row, avg(r) AS reagents_per_row,
      100.0::DOUBLE * count(*) FILTER (s = 0) / (SELECT count(*) FROM recs) AS no_substrate_percent,
      100.0::DOUBLE * count(*) FILTER (r = 0) / (SELECT count(*) FROM recs) AS no_reagent_percent FROM n""",
)
def role_summary(spark, folder):
    rows = role_rows(spark, folder)
    total = rows.agg(F.count("*")).scalar()
    return roles.role_summary(roles.split_roles(rows), total)


@query(
    "role_validation",
    f"""WITH {MAPPED_SQL},
    clean AS (SELECT rid, regexp_replace(product, ':[0-9]+\\]', ']', 'g') AS product,
      [regexp_replace(f, ':[0-9]+\\]', ']', 'g') FOR f IN string_split(reactants, '.')] AS parts FROM mapped),
    {X.dim_sql("SELECT unnest(parts) AS f FROM clean UNION ALL SELECT product FROM clean")},
    rows_in AS (SELECT c.rid, d.canonical AS product, parts FROM clean c JOIN dim d ON d.raw = c.product WHERE d.canonical IS NOT NULL),
    pos AS (SELECT product, d.canonical AS f FROM (SELECT product, unnest(parts) AS f0 FROM rows_in)
      JOIN dim d ON d.raw = f0 WHERE d.canonical IS NOT NULL),
    neg AS (SELECT product, f FROM (SELECT rid, product, unnest({X.sql_list(HELDOUT_REAGENTS)}) AS f FROM rows_in)
      QUALIFY row_number() OVER (PARTITION BY rid ORDER BY md5(concat_ws(':', '11', rid, f)), f) <= 2),
    {roles_sql("SELECT DISTINCT f, product FROM pos UNION SELECT DISTINCT f, product FROM neg")},
    counts AS (SELECT (SELECT count(*) FROM pos JOIN judged USING (f, product) WHERE substrate) AS tp,
      (SELECT count(*) FROM pos JOIN judged USING (f, product) WHERE NOT substrate) AS fn,
      (SELECT count(*) FROM neg JOIN judged USING (f, product) WHERE substrate) AS fp,
      (SELECT count(*) FROM neg JOIN judged USING (f, product) WHERE NOT substrate) AS tn)
    SELECT tp, fn, fp, tn, tp::DOUBLE / (tp + fn) AS substrate_recall, tn::DOUBLE / (tn + fp) AS reagent_recall,
      tn::DOUBLE / (tn + fn) AS reagent_precision FROM counts""",
)
def role_validation(spark, folder):
    return roles.role_validation(mapped(spark, folder), "product", "reactants", "record_pos", 11)
