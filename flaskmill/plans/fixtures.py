"""Reaction-like inputs derived from the given tables, in Spark and as SQL.

Order and line numbers pick structure texts from a palette or spell a chain of their own, so that
records, ranked candidates, condition fields and the different texts among them grow with the
tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flaskmill.constants import (
    ABBREVIATIONS,
    CATALYST_GROUP_METALS,
    CATALYST_GROUPS,
    FORMULA_ALIASES,
    SOLVENT_GROUPS,
)
from flaskmill.functions.text import literal_array
from flaskmill.plans.registry import heavy_table, table

SPECIES = (
    "CCO", "OCC", "CC(=O)O", "ClCCl", "[Na+]", "[OH-]", "O", "c1ccccc1", "CC(=O)[O-]",
    "Br[Mg]c1ccccc1", "not-a-smiles", "[Pd]", "CN(C)C=O", "NaOH", "CCN(CC)CC", "PhBr",
)


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: One number in so many has a text of its own, so that there are more of them in larger tables.
OWN_TEXT = 5
ATOMS = "CNOS"


def species(number: Column) -> Column:
    """A structure text: mostly of the palette, else a chain that spells the number."""
    named = F.get(literal_array(SPECIES), (number % len(SPECIES)).cast("int"))
    turn = F.floor(number / OWN_TEXT).cast("string")
    chain = F.translate(F.conv(turn, 10, len(ATOMS)), "0123", ATOMS)
    return F.when(number % OWN_TEXT == 0, chain).otherwise(named)


def sql_species(number: str) -> str:
    chain = f"translate(to_base(({number}) // {OWN_TEXT}, {len(ATOMS)}), '0123', '{ATOMS}')"
    named = f"{sql_list(SPECIES)}[1 + ({number}) % {len(SPECIES)}]"
    return f"(CASE WHEN ({number}) % {OWN_TEXT} = 0 THEN {chain} ELSE {named} END)"


# --- ranked runs --------------------------------------------------------------------------


def records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per order: position, product and reference."""
    key = F.col("o_custkey")
    salt = F.when(F.col("o_orderpriority") == "1-URGENT", ".[Na+]").otherwise("")
    return heavy_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("record_pos"),
        F.concat(species(key), species(key + 5)).alias("product"),
        F.concat(species(key), salt).alias("reference"),
    )


RECORDS_SQL = f"""recs AS (
  SELECT o_orderkey AS rid,
         {sql_species("o_custkey")} || {sql_species("o_custkey + 5")} AS product,
         {sql_species("o_custkey")}
           || CASE WHEN o_orderpriority = '1-URGENT' THEN '.[Na+]' ELSE '' END AS reference
  FROM orders)"""


def run(spark: SparkSession, folder: str, by: str = "l_partkey") -> DataFrame:
    """Records with their candidates: one per line number, the set of its lines' species. The tables
    repeat line numbers within an order; such lines are one candidate of several species.
    """
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("record_pos"),
        F.struct(F.col("l_linenumber").alias("line"), species(F.col(by)).alias("s")).alias("pick"),
    )
    picks = lines.groupBy("record_pos").agg(F.array_sort(F.collect_set("pick")).alias("picks"))
    numbers = F.array_distinct(F.transform("picks", lambda p: p["line"]))
    text = lambda n: F.array_join(
        F.transform(F.filter("picks", lambda p: p["line"] == n), lambda p: p["s"]), "."
    )
    made = F.coalesce(F.transform(numbers, text), F.array().cast("array<string>"))
    joined = records(spark, folder).join(picks, "record_pos", "left")
    return joined.withColumn("candidates", made).drop("picks")


def run_sql(name: str, by: str = "l_partkey") -> str:
    """CTE ``name(rid, rank, cand)``."""
    return f"""{name} AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY ln) AS rank, cand
  FROM (SELECT rid, ln, string_agg(s, '.' ORDER BY s) AS cand
        FROM (SELECT DISTINCT l_orderkey AS rid, l_linenumber AS ln,
                     {sql_species(by)} AS s FROM lineitem)
        GROUP BY rid, ln)
  WHERE rid IN (SELECT o_orderkey FROM orders))"""


# --- lexical attributes in SQL ------------------------------------------------------------


# Written apart from the library's own patterns, so that the check can tell when those are wrong.
_SQL_BRACKET = r"\[[0-9]*([A-Z][a-z]?|b|c|n|o|p|s|se|as|[*])[^\]\[]*\]"
ATOM = _SQL_BRACKET + "|Cl|Br|B|C|N|O|P|S|F|I|b|c|n|o|p|s|[*]"
ELEMENT = r"^\[?[0-9]*([A-Z][a-z]?|se|as|b|c|n|o|p|s)"
CHARGE = r"([+]+[0-9]*|[-]+[0-9]*)(?::[0-9]+)?\]"
#: A bare text: letters for atoms, at most one bond before an atom, ring number or branch.
_SQL_ATOMS = "(Cl|Br|[BCNOPSFIbcnops*])"
_SQL_SHAPE = (
    r"^A([-=#$:~/\\]?(A|[0-9]|%[0-9][0-9])|[(][-=#$:~/\\]?A|[)]|[.]A)*$".replace("A", _SQL_ATOMS)
)


def _sql_readable(c: str) -> str:
    bare = f"regexp_replace({c}, '{_SQL_BRACKET}', 'C', 'g')"
    signs = f"regexp_replace({bare}, '[^()]', '', 'g')"
    for _ in range(12):  # no fixture nests deeper
        signs = f"replace({signs}, '()', '')"
    digits = f"regexp_replace({bare}, '%[0-9][0-9]', '', 'g')"
    rings = " AND ".join(f"(length({digits}) - length(replace({digits}, '{d}', ''))) % 2 = 0" for d in range(10))
    return f"(regexp_full_match({bare}, '{_SQL_SHAPE}') AND {signs} = '' AND {rings})"


def _sql_elements(c: str) -> str:
    symbol = f"regexp_extract(a, '{ELEMENT}', 1)"
    return (
        f"[upper(e[1]) || e[2:] FOR e IN [{symbol} FOR a IN "
        f"regexp_extract_all({c}, '({ATOM})', 1)] IF e <> '']"
    )


def _sql_charge(c: str) -> str:
    size = "coalesce(try_cast(regexp_replace(m, '[+-]', '', 'g') AS INT), length(m))"
    return (
        f"coalesce(list_sum([CASE WHEN m[1] = '-' THEN -{size} ELSE {size} END "
        f"FOR m IN regexp_extract_all({c}, '{CHARGE}', 1)]), 0)"
    )


def dim_sql(source: str) -> str:
    """CTE ``dim`` with the attributes of the fragments ``f`` selected by ``source``."""
    aliases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FORMULA_ALIASES.items())
    norm = "formula"
    for short, full in ABBREVIATIONS.items():
        norm = f"replace({norm}, '{short}', '{full}')"
    return f"""frag AS (
  SELECT f AS raw, count(*) AS occurrences FROM ({source}) WHERE f <> '' GROUP BY f),
named AS (
  SELECT raw, occurrences, CASE trim(raw) {aliases} ELSE trim(raw) END AS formula FROM frag),
normed AS (SELECT *, {norm} AS norm FROM named),
attrs AS (
  SELECT *, {_sql_readable("norm")} AS ok, {_sql_readable("formula")} AS formula_ok,
         {_sql_elements("norm")} AS elements, {_sql_elements("formula")} AS formula_elements,
         {_sql_charge("norm")} AS charge, {_sql_charge("formula")} AS formula_charge
  FROM normed),
dim AS (
  SELECT raw, occurrences, CASE WHEN ok THEN norm END AS canonical, ok, norm, elements, charge,
         {_sql_readable("raw")} AS raw_ok,
         formula_ok AND (formula_charge <> 0 OR NOT list_contains(formula_elements, 'C')) AS aux
  FROM attrs)"""


def sets_sql(name: str, source: str, keys: str, text: str) -> str:
    """CTE ``name(keys, set_text, core_text)``: canonical sets of the fragments of ``text``.

    A null means a part that can not be read; no part at all is the empty text.
    """
    return f"""{name} AS (
  SELECT {keys},
         CASE WHEN bool_and(d.canonical IS NOT NULL)
              THEN string_agg(DISTINCT d.canonical, ' ' ORDER BY d.canonical) END AS set_text,
         CASE WHEN coalesce(bool_and(d.canonical IS NOT NULL) FILTER (WHERE NOT d.aux), true)
              THEN coalesce(string_agg(DISTINCT d.canonical, ' ' ORDER BY d.canonical)
                            FILTER (WHERE NOT d.aux), '') END AS core_text
  FROM (SELECT {keys}, unnest(string_split({text}, '.')) AS f FROM {source}) p
  JOIN dim d ON d.raw = p.f
  GROUP BY {keys})"""


def valid_sql(name: str, source: str) -> str:
    """CTE ``name(cand)``: the distinct candidate texts that are valid as a whole."""
    aliases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FORMULA_ALIASES.items())
    norm = f"CASE cand {aliases} ELSE cand END"
    for short, full in ABBREVIATIONS.items():
        norm = f"replace({norm}, '{short}', '{full}')"
    return f"""{name} AS (
  SELECT cand FROM (SELECT cand, {norm} AS norm FROM (SELECT DISTINCT cand FROM {source}))
  WHERE {_sql_readable("norm")})"""


def scored_sql(by: str = "l_partkey", suffix: str = "") -> str:
    """CTEs ending in ``scored``: per record the exact and core rank and rank-1 validity.

    Needs ``recs`` and ``dim`` before it.
    """
    x = suffix
    return f"""{run_sql(f"cands{x}", by)},
{sets_sql(f"csets{x}", f"cands{x}", "rid, rank", "cand")},
{valid_sql(f"cvalid{x}", f"cands{x}")},
scored{x} AS (
  SELECT r.rid,
         min(CASE WHEN c.set_text = s.set_text THEN c.rank END) AS e_rank,
         min(CASE WHEN c.core_text = s.core_text THEN c.rank END) AS c_rank,
         coalesce(bool_or(c.rank = 1 AND t.cand IN (FROM cvalid{x})), false) AS v1
  FROM recs r JOIN rsets s USING (rid) LEFT JOIN csets{x} c USING (rid)
  LEFT JOIN cands{x} t ON t.rid = c.rid AND t.rank = c.rank
  GROUP BY r.rid)"""


def fragments_of_runs(*by: str) -> str:
    parts = [f"SELECT {sql_species(b)} AS f FROM lineitem" for b in by]
    parts.append("SELECT unnest(string_split(reference, '.')) FROM recs")
    return " UNION ALL ".join(parts)


RUN_A_SQL = f"""WITH {RECORDS_SQL},
{dim_sql(fragments_of_runs("l_partkey"))},
{sets_sql("rsets", "recs", "rid", "reference")},
{scored_sql()}"""

RUN_AB_SQL = f"""WITH {RECORDS_SQL},
{dim_sql(fragments_of_runs("l_partkey", "l_suppkey"))},
{sets_sql("rsets", "recs", "rid", "reference")},
{scored_sql("l_partkey", "_a")},
{scored_sql("l_suppkey", "_b")}"""


# --- condition runs -----------------------------------------------------------------------

FIELDS = ("reagents", "solvent", "catalyst", "temperature_celsius", "yield_percent")


def condition_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per order with sparsely filled condition fields."""
    key, price = F.col("o_custkey"), F.col("o_totalprice")
    second = F.when(key % 3 == 0, F.concat(F.lit(", "), species(key + 1))).otherwise("")
    solvent = F.when(key % 5 == 1, "not specified").when(key % 5 != 0, F.concat(species(key), second))
    return heavy_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("record_pos"),
        F.concat(species(key), species(key + 5)).alias("product_smiles"),
        F.concat(species(key), F.lit("."), species(key + 3)).alias("reactants_smiles"),
        F.when(key % 4 != 0, species(key % 11)).alias("reagents"),
        solvent.alias("solvent"),
        F.when(F.col("o_orderstatus") != "O", species(F.floor(key / 7))).alias("catalyst"),
        F.when(F.col("o_orderstatus") == "F", price / 4000).alias("temperature_celsius"),
        F.when(key % 2 == 0, price / 5000).alias("yield_percent"),
    )


CONDITION_RECORDS_SQL = f"""recs AS (
  SELECT o_orderkey AS rid,
         {sql_species("o_custkey")} || {sql_species("o_custkey + 5")} AS product_smiles,
         {sql_species("o_custkey")} || '.' || {sql_species("o_custkey + 3")} AS reactants_smiles,
         CASE WHEN o_custkey % 4 <> 0 THEN {sql_species("o_custkey % 11")} END AS reagents,
         CASE WHEN o_custkey % 5 = 1 THEN 'not specified'
              WHEN o_custkey % 5 <> 0 THEN {sql_species("o_custkey")}
                || CASE WHEN o_custkey % 3 = 0 THEN ', ' || {sql_species("o_custkey + 1")} ELSE '' END
              END AS solvent,
         CASE WHEN o_orderstatus <> 'O' THEN {sql_species("o_custkey // 7")} END AS catalyst,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 4000 END AS temperature_celsius,
         CASE WHEN o_custkey % 2 = 0 THEN o_totalprice / 5000 END AS yield_percent
  FROM orders)"""


def in_line_order(lines: DataFrame, order: str, number: str, text: Column, into: str) -> DataFrame:
    """One row per order with the texts of all its lines, by line number and then text."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(number).alias("n"), text.alias("t"))))
    return lines.groupBy(order).agg(listed.alias(into))


def generations(spark: SparkSession, folder: str) -> DataFrame:
    """Per order a generated text for every line, in compact form, some with a field missing."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    heat = F.when(F.col("l_quantity") > 40, "?").otherwise(F.col("l_quantity").cast("string"))
    text = F.concat_ws(
        "|",
        F.when(supp % 6 == 0, "?").otherwise(species(supp % 11)),
        F.when(part % 9 == 0, "").otherwise(species(part)),
        F.when(supp % 4 == 0, "?").otherwise(species(part + supp)),
        heat,
        F.when(F.col("l_returnflag") != "R", (F.col("l_linenumber") * 10).cast("string")),
    )
    lines = table(spark, folder, "lineitem")
    listed = in_line_order(lines, "l_orderkey", "l_linenumber", text, "lines")
    texts = F.transform("lines", lambda x: x["t"])
    return listed.select(F.col("l_orderkey").alias("record_pos"), texts.alias("candidates_raw"))


GENERATIONS_SQL = f"""gens AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY ln, txt) AS raw_rank, txt
  FROM (SELECT l_orderkey AS rid, l_linenumber AS ln,
          concat_ws('|',
            CASE WHEN l_suppkey % 6 = 0 THEN '?' ELSE {sql_species("l_suppkey % 11")} END,
            CASE WHEN l_partkey % 9 = 0 THEN '' ELSE {sql_species("l_partkey")} END,
            CASE WHEN l_suppkey % 4 = 0 THEN '?' ELSE {sql_species("l_partkey + l_suppkey")} END,
            CASE WHEN l_quantity > 40 THEN '?' ELSE l_quantity::VARCHAR END,
            CASE WHEN l_returnflag <> 'R' THEN (l_linenumber * 10)::VARCHAR END) AS txt
        FROM lineitem))"""

PARSED_SQL = f"""{GENERATIONS_SQL},
ranked AS (
  SELECT rid, txt, row_number() OVER (PARTITION BY rid ORDER BY first_rank) AS rank
  FROM (SELECT rid, txt, min(raw_rank) AS first_rank FROM gens GROUP BY rid, txt)),
parts AS (SELECT rid, rank, txt, string_split(replace(txt, ' ', ''), '|') AS p FROM ranked),
parsed AS (
  SELECT rid, rank, txt, len(p) = 5 AS ok,
         {", ".join(f"CASE WHEN len(p) = 5 AND p[{i}] NOT IN ('', '?') THEN p[{i}] END AS {f}"
                    for i, f in enumerate(FIELDS, 1))}
  FROM parts)"""


def condition_run(spark: SparkSession, folder: str) -> DataFrame:
    """Condition records with deduplicated, parsed generations."""
    from flaskmill.functions.rendering import parse_generation
    from flaskmill.operators.dedupe import dedupe_candidates_raw

    none = F.array().cast("array<string>")
    joined = condition_records(spark, folder).join(generations(spark, folder), "record_pos", "left")
    texts = dedupe_candidates_raw(F.coalesce("candidates_raw", none))
    return joined.withColumn("candidates_raw", texts).withColumn(
        "parsed", F.transform("candidates_raw", lambda c: parse_generation(c, "compact", FIELDS))
    )


def _component_rows(source: str, keys: str, field: str) -> str:
    return (
        f"SELECT {keys}, trim(unnest(string_split(replace({field}, ',', '.'), '.'))) AS part "
        f"FROM {source} WHERE {field} IS NOT NULL AND {field} NOT IN ('', 'not specified')"
    )


def components_sql(name: str, source: str, keys: str, field: str) -> str:
    """CTE ``name(keys, parts)``: normalised component set as one text."""
    return f"""{name} AS (
  SELECT {keys}, string_agg(DISTINCT coalesce(d.canonical, lower(p.part)), ' ~ '
           ORDER BY coalesce(d.canonical, lower(p.part))) AS parts
  FROM ({_component_rows(source, keys, field)}) p JOIN dim d ON d.raw = p.part
  WHERE p.part <> '' GROUP BY {keys})"""


def groups_sql(name: str, source: str, keys: str, field: str) -> str:
    """CTE ``name(keys, grps)``: list of families, only where there is one."""
    groups, metal = (SOLVENT_GROUPS, "NULL") if field == "solvent" else (
        CATALYST_GROUPS,
        f"CASE WHEN d.ok AND len(list_intersect(d.elements, {sql_list(CATALYST_GROUP_METALS)})) > 0 "
        f"THEN 'metal_' || list_min(list_intersect(d.elements, {sql_list(CATALYST_GROUP_METALS)})) END",
    )
    rows = ", ".join(f"('{m}', '{g}')" for g, members in groups.items() for m in members)
    return f"""{name} AS (
  SELECT {keys}, list_sort(list(DISTINCT grp)) AS grps
  FROM (SELECT {", ".join("p." + k.strip() for k in keys.split(","))}, coalesce(g.grp, {metal}) AS grp
        FROM ({_component_rows(source, keys, field)}) p JOIN dim d ON d.raw = p.part
        LEFT JOIN (VALUES {rows}) g(member, grp) ON g.member = d.canonical
        WHERE p.part <> '')
  WHERE grp IS NOT NULL GROUP BY {keys})"""


CONDITION_PARTS_SQL = " UNION ALL ".join(
    f"SELECT trim(unnest(string_split(replace({f}, ',', '.'), '.'))) AS f FROM {t} WHERE {f} IS NOT NULL"
    for t in ("recs", "parsed")
    for f in ("reagents", "solvent", "catalyst")
)
CONDITIONS_SQL = f"""WITH {CONDITION_RECORDS_SQL},
{PARSED_SQL},
{dim_sql(CONDITION_PARTS_SQL)}"""
