"""Queries for nested and flat ingest, sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flaskmill.functions.nested import find_first_json, find_first_path, json_number, measurement_unit, numeric_value
from flaskmill.operators import extract
from flaskmill.plans import chemistry, curation
from flaskmill.plans import fixtures as X
from flaskmill.plans.registry import heavy_table, query, table
from flaskmill.session import staging_dir
from flaskmill.sources import readers, writers
from flaskmill.sources.schemas import COMPONENT, REACTION_DOCUMENT
from flaskmill.streaming import streams


def scratch(spark) -> str:
    """A new folder in the shared staging area."""
    return f"{staging_dir(spark).rstrip('/')}/flaskmill-{uuid.uuid4().hex}"


def documents(spark, folder):
    """Nested reaction documents: an order with an input component for each of its lines."""
    role = (
        F.when(F.col("l_returnflag") == "A", "REACTANT")
        .when(F.col("l_returnflag") == "R", "solvent")
        .when(F.col("l_linestatus") == "O", "CATALYST")
        .otherwise("REAGENT")
    )
    pick = F.concat_ws("|", X.species(F.col("l_partkey")), role)
    lines = X.in_line_order(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber", pick, "lines")
    lines = lines.withColumnRenamed("l_orderkey", "o_orderkey")
    empty = "ARRAY<STRUCT<type: STRING, value: STRING>>"

    def identifier(*pairs):
        return F.array(*[F.struct(F.lit(t).alias("type"), v.alias("value")) for t, v in pairs])

    def entry(line, position):
        parts = F.split(line["t"], "[|]")
        s, none, kind = F.get(parts, F.lit(0)), F.lit(None).cast("string"), line["n"] % 3
        named = F.concat(F.lit("name-"), s)
        ids = F.when(kind == 0, identifier(("NAME", named), ("CXSMILES", s))).when(
            kind == 2, identifier(("NAME", named))
        )
        smiles = F.when(kind == 1, s).when((kind == 2) & (F.col("o_custkey") % 2 == 0), "")
        comp = F.struct(
            ids.alias("identifiers"), smiles.alias("smiles"), none.alias("canonical_smiles"),
            named.alias("name"), F.get(parts, F.lit(1)).alias("reaction_role"),
        ).cast(COMPONENT)
        value = F.struct(F.array(comp).alias("components"))
        return F.struct(F.concat(F.lit("in"), position.cast("string")).alias("key"), value.alias("value"))

    key, price = F.col("o_custkey"), F.col("o_totalprice")

    def product(s, *amounts):
        measured = [
            F.struct(F.lit(t).alias("type"), F.struct(v.cast("double").alias("value")).alias("percentage"))
            for t, v in amounts
        ]
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(None).cast(empty).alias("identifiers"), s.alias("smiles"), none.alias("canonical_smiles"),
            none.alias("name"), F.array(*measured).alias("measurements"),
        )

    first_yield = F.when(key % 6 == 0, 0.0).when(key % 6 > 1, price / 5000)
    products = F.array(
        product(X.species(key), ("CONVERSION", price), ("yield", first_yield)),
        product(X.species(key + 1), ("YIELD", F.when(key % 7 > 0, price / 7000))),
    )
    unit = F.when(key % 3 == 0, "KELVIN").when(key % 3 == 1, "FAHRENHEIT").otherwise("CELSIUS")
    setpoint = F.struct(price.alias("value"), unit.alias("units"))
    heat = F.struct(F.struct(setpoint.alias("setpoint")).alias("temperature"))
    known = F.coalesce("lines", F.array().cast("array<struct<n: bigint, t: string>>"))
    inputs = F.map_from_entries(F.transform(known, entry))
    return heavy_table(spark, folder, "orders").join(lines, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("index_in_file"),
        F.when(key % 2 == 1, F.concat(F.lit("r-"), F.col("o_orderkey"))).alias("reaction_id"),
        F.when(key % 8 == 0, identifier(("NAME", F.lit("")), ("ID", F.concat(F.lit("i-"), F.col("o_orderkey"))))).alias("identifiers"),
        inputs.alias("inputs"),
        F.when(key % 5 != 0, heat).alias("conditions"),
        F.array(F.struct(products.alias("products"))).alias("outcomes"),
        F.concat(F.lit("file_"), (key % 20).cast("string"), F.lit(".json.gz")).alias("source_dataset"),
    )


COMPONENTS_SQL = f"""picks AS (SELECT l_orderkey AS rid, l_linenumber AS ln,
    concat_ws('|', {X.sql_species("l_partkey")}, CASE WHEN l_returnflag = 'A' THEN 'REACTANT'
      WHEN l_returnflag = 'R' THEN 'solvent' WHEN l_linestatus = 'O' THEN 'CATALYST' ELSE 'REAGENT' END) AS t
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
comps AS (SELECT rid, ln, t, string_split(t, '|')[1] AS s, string_split(t, '|')[2] AS role,
  CASE WHEN ln % 3 = 2 THEN NULL ELSE string_split(t, '|')[1] END AS smiles,
  CASE WHEN ln % 3 = 2 THEN 'name-' || string_split(t, '|')[1] ELSE string_split(t, '|')[1] END AS label FROM picks)"""

NORMAL_SQL = f"""{COMPONENTS_SQL},
{X.dim_sql(f"SELECT smiles AS f FROM comps WHERE smiles IS NOT NULL UNION ALL SELECT {X.sql_species('o_custkey')} FROM orders UNION ALL SELECT {X.sql_species('o_custkey + 1')} FROM orders")},
sides AS (SELECT rid,
  string_agg(DISTINCT d.canonical, '.' ORDER BY d.canonical) FILTER (WHERE role = 'REACTANT') AS reactants,
  string_agg(DISTINCT label, ', ' ORDER BY label) FILTER (WHERE role = 'solvent') AS solvent,
  string_agg(DISTINCT label, ', ' ORDER BY label) FILTER (WHERE role = 'CATALYST') AS catalyst
  FROM comps LEFT JOIN dim d ON d.raw = smiles GROUP BY rid),
made AS (SELECT o_orderkey AS rid, o_custkey AS key, o_totalprice AS price,
  a.canonical AS p1, b.canonical AS p2,
  CASE WHEN o_custkey % 6 = 0 THEN 0.0::DOUBLE WHEN o_custkey % 6 > 1 THEN o_totalprice / 5000 END AS y1,
  CASE WHEN o_custkey % 7 > 0 THEN o_totalprice / 7000 END AS y2
  FROM orders JOIN dim a ON a.raw = {X.sql_species('o_custkey')} JOIN dim b ON b.raw = {X.sql_species('o_custkey + 1')}),
normal AS (SELECT rid, key, reactants, coalesce(p1, p2) AS product, solvent, catalyst,
  CASE WHEN p1 IS NOT NULL AND y1 <> 0 THEN y1 WHEN p2 IS NOT NULL AND y2 <> 0 THEN y2
       WHEN p2 IS NOT NULL THEN y2 ELSE y1 END AS amount,
  CASE WHEN key % 5 = 0 THEN NULL WHEN key % 3 = 0 THEN round_even(price - 273.15, 2)
       WHEN key % 3 = 1 THEN round_even((price - 32.0) * 5.0 / 9.0, 2) ELSE price END AS heat
  FROM made JOIN sides USING (rid) WHERE reactants IS NOT NULL AND coalesce(p1, p2) IS NOT NULL)"""


def _shown(df):
    return df.select(
        "reaction_id", "reactants_smiles", "product_smiles", "reaction_smiles",
        F.coalesce("solvent", F.lit("none")).alias("solvent"),
        F.coalesce("catalyst", F.lit("none")).alias("catalyst"),
        F.coalesce(F.round("temperature_celsius", 4), F.lit(-999.0)).alias("temperature_celsius"),
        F.coalesce(F.round("yield_percent", 6), F.lit(-1.0)).alias("yield_percent"),
    )


def _normal_sql(identifier: str) -> str:
    return f"""SELECT {identifier} AS reaction_id, reactants AS reactants_smiles, product AS product_smiles,
    reactants || '>>' || product AS reaction_smiles, coalesce(solvent, 'none') AS solvent,
    coalesce(catalyst, 'none') AS catalyst, coalesce(round(heat, 4), -999.0) AS temperature_celsius,
    coalesce(round(amount, 6), -1.0) AS yield_percent FROM normal"""


_GIVEN_ID = "CASE WHEN key % 2 = 1 THEN 'r-' || rid WHEN key % 8 = 0 THEN 'i-' || rid"


@query(
    "normalize_reaction",
    f"""WITH {NORMAL_SQL} {_normal_sql(_GIVEN_ID + " ELSE 'ord_file_' || (key % 20) || '.json_' || rid END")}""",
)
def normalize_reaction(spark, folder):
    return _shown(extract.normalize_reaction(documents(spark, folder)))


@query(
    "explode_inputs",
    f"""WITH {COMPONENTS_SQL} SELECT rid AS index_in_file,
    (row_number() OVER (PARTITION BY rid ORDER BY ln, t) - 1)::INT AS pos, role,
    coalesce(smiles, 'none') AS identifier,
    CASE WHEN ln % 3 = 1 THEN 'name-' || s ELSE 'name-' || s END AS name FROM comps""",
)
def explode_inputs(spark, folder):
    docs = documents(spark, folder)
    _, dtype = extract.input_components(docs)
    exploded = extract.explode_inputs(docs, "index_in_file")
    c = F.col("component")
    return exploded.select(
        "index_in_file", "pos", F.col("component.reaction_role").alias("role"),
        F.coalesce(extract.compound_identifier(c, dtype), F.lit("none")).alias("identifier"),
        extract.compound_name(c, dtype).alias("name"),
    )


@query(
    "explode_products",
    f"""SELECT o_orderkey AS index_in_file, 0 AS pos, {X.sql_species("o_custkey")} AS product,
      coalesce(round(CASE WHEN o_custkey % 6 = 0 THEN 0.0 WHEN o_custkey % 6 > 1 THEN o_totalprice / 5000 END, 6), -1) AS amount FROM orders
    UNION ALL SELECT o_orderkey, 1, {X.sql_species("o_custkey + 1")},
      coalesce(round(CASE WHEN o_custkey % 7 > 0 THEN o_totalprice / 7000 END, 6), -1) FROM orders""",
)
def explode_products(spark, folder):
    docs = documents(spark, folder)
    _, dtype = extract.outcome_products(docs)
    exploded = extract.explode_products(docs, "index_in_file")
    p = F.col("product")
    return exploded.select(
        "index_in_file", "pos", extract.compound_identifier(p, dtype).alias("product"),
        F.coalesce(F.round(extract.extract_yield(p, dtype), 6), F.lit(-1.0)).alias("amount"),
    )


@query(
    "nested_search",
    """SELECT o_orderkey AS index_in_file, CASE WHEN o_custkey % 5 = 0 THEN -1.0 ELSE o_totalprice END AS value,
      CASE WHEN o_custkey % 5 = 0 THEN 'none' WHEN o_custkey % 3 = 0 THEN 'kelvin'
           WHEN o_custkey % 3 = 1 THEN 'fahrenheit' ELSE 'celsius' END AS unit FROM orders""",
)
def nested_search(spark, folder):
    docs = documents(spark, folder)
    dtype = docs.schema["conditions"].dataType
    find = lambda leaf: find_first_path(F.col("conditions"), dtype, {"setpoint"}, leaf)
    return docs.select(
        "index_in_file",
        F.coalesce(find(numeric_value), F.lit(-1.0)).alias("value"),
        F.coalesce(find(measurement_unit), F.lit("none")).alias("unit"),
    )


@query(
    "nested_search_json",
    """SELECT o_orderkey, (CASE WHEN o_custkey % 4 IN (0, 2) THEN o_orderkey ELSE o_custkey END)::DOUBLE AS value,
    CASE o_custkey % 4 WHEN 2 THEN 'STRING' WHEN 3 THEN 'BIGINT' ELSE 'OBJECT' END AS kind FROM orders""",
)
def nested_search_json(spark, folder):
    """Documents that name the same fields in different orders."""
    first, second = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    a = F.concat(F.lit('"a":{"setpoint":{"unit":"c","value":'), second, F.lit("}}"))
    b = F.concat(F.lit('"b":{"setpoint":{"units":"K","mean":"'), first, F.lit('"}}'))
    way = F.col("o_custkey") % 4
    doc = (
        F.when(way == 0, F.concat(F.lit("{"), b, F.lit(","), a, F.lit("}")))
        .when(way == 1, F.concat(F.lit("{"), a, F.lit(","), b, F.lit("}")))
        .when(way == 2, F.concat(F.lit('{"a":{"setpoint":[]},"b":[{"x":1},{"setpoint":"'), first, F.lit('"}]}')))
        .otherwise(F.concat(F.lit('{"a":[[{"deep":{"setpoint":'), second, F.lit('}}]],"setpoint":""}')))
    )
    docs = heavy_table(spark, folder, "orders").select("o_orderkey", doc.alias("doc"))
    hits = docs.select("o_orderkey", find_first_json("doc", {"setpoint"}).alias("hit"))
    return hits.select("o_orderkey", json_number(F.col("hit")).alias("value"), F.col("hit.kind").alias("kind"))


@query(
    "role_matches",
    f"""WITH {COMPONENTS_SQL} SELECT role, count(*) AS n, bool_or(upper(role) LIKE '%SOLVENT%' OR upper(role) LIKE '%CATALYST%') AS hit
    FROM comps GROUP BY role""",
)
def role_matches(spark, folder):
    exploded = extract.explode_inputs(documents(spark, folder), "index_in_file")
    role = F.col("component.reaction_role")
    hit = extract.role_matches(role, ["SOLVENT", "CATALYST"])
    return exploded.groupBy(role.alias("role")).agg(F.count("*").alias("n"), F.bool_or(hit).alias("hit"))


def flat_rows(spark, folder):
    """Flat reaction rows under the several accepted column names."""
    key = F.col("record_pos")
    rows = chemistry.mapped(spark, folder)
    return rows.select(
        F.when(key % 3 != 0, F.concat("reactants", F.lit(">>"), "product")).alias("rxn_smiles"),
        F.when(key % 3 != 1, F.col("reactants")).alias("reactants"),
        F.when(key % 3 != 1, F.when(key % 13 == 0, "?!").otherwise(F.col("product"))).alias("product"),
        F.when(key % 4 == 0, F.concat(F.lit("id"), key)).alias("id"),
        F.get(F.array(*[F.lit(x) for x in chemistry.LABELS]), (key % len(chemistry.LABELS)).cast("int")).alias("class"),
        F.when(key % 10 == 0, "test").otherwise("train").alias("split"),
        key.alias("idx"),
    )


_STRIP = "regexp_replace({}, ':[0-9]+\\]', ']', 'g')"


@query(
    "normalize_flat_row",
    f"""WITH {chemistry.MAPPED_SQL},
    parts AS (SELECT rid, pos, CASE f WHEN 'NaOH' THEN '[Na+].[OH-]' ELSE {_STRIP.format("f")} END AS t FROM (
      SELECT rid, unnest(string_split(reactants, '.')) AS f,
             generate_subscripts(string_split(reactants, '.'), 1) AS pos FROM mapped)),
    {X.dim_sql("SELECT DISTINCT t AS f FROM parts")},
    sided AS (SELECT rid, string_agg(t, '.' ORDER BY pos) AS sided FROM parts JOIN dim ON raw = t
      WHERE raw_ok GROUP BY rid),
    flat AS (SELECT m.rid, m.product, m.reactants, s.sided,
      {X.sql_list(chemistry.LABELS)}[1 + m.rid % {len(chemistry.LABELS)}] AS label FROM mapped m LEFT JOIN sided s USING (rid)
      WHERE m.rid % 3 = 1 OR m.rid % 13 <> 0)
    SELECT CASE WHEN rid % 4 = 0 THEN 'id' || rid ELSE 'uspto50k_' || CASE WHEN rid % 10 = 0 THEN 'test' ELSE 'train' END || '_' || rid END AS reaction_id,
      {_STRIP.format("product")} AS product_smiles, coalesce(sided, reactants) AS reactants_smiles,
      CASE WHEN rid % 3 <> 0 THEN reactants || '>>' || CASE WHEN rid % 3 <> 1 AND rid % 13 = 0 THEN '?!' ELSE product END
           ELSE coalesce(sided, reactants) || '>>' || {_STRIP.format("product")} END AS reaction_smiles,
      coalesce(nullif({chemistry._class_sql("label")}, ''), 'none') AS reaction_class_normalized FROM flat""",
)
def normalize_flat_row(spark, folder):
    rows = flat_rows(spark, folder)
    # The mapped text is what the row's own reaction column holds.
    out = extract.normalize_flat_row(rows, "flat-rows")
    return out.select(
        "reaction_id", "product_smiles", "reactants_smiles", "reaction_smiles",
        F.coalesce("reaction_class_normalized", F.lit("none")).alias("reaction_class_normalized"),
    )


# --- sources and sinks --------------------------------------------------------------------

POOL = "record_pos BIGINT, product_smiles STRING, reactants_smiles STRING, solvent STRING, temperature_celsius DOUBLE, catalyst STRING, yield_percent DOUBLE"


@query(
    "jsonl_round_trip",
    f"""WITH {X.CONDITION_RECORDS_SQL} SELECT rid AS record_pos, product_smiles, reactants_smiles,
    coalesce(solvent, 'none') AS solvent, coalesce(temperature_celsius, -1.0) AS temperature_celsius,
    coalesce(catalyst, 'none') AS catalyst, coalesce(yield_percent, -1.0) AS yield_percent FROM recs""",
)
def jsonl_round_trip(spark, folder):
    path = scratch(spark)
    fields = [f.split()[0] for f in POOL.split(", ")]
    writers.write_jsonl(X.condition_records(spark, folder), path, fields)
    back = readers.read_records(spark, path, POOL)
    return back.fillna("none").fillna(-1.0)


@query(
    "exclusion_keys",
    f"WITH {curation.HOLDOUT_SQL} SELECT text FROM holdout UNION SELECT text FROM benchmark WHERE text <> ''",
)
def exclusion_keys(spark, folder):
    first, second = scratch(spark), scratch(spark)
    writers.write_eval_targets(curation.holdout(spark, folder), first, ["text", "missing_field"])
    writers.write_jsonl(table(spark, folder, "benchmark"), second, ["item_id", "text"])
    return readers.read_exclusion_keys(spark, [first, second, f"{first}-absent"], "text")


@query(
    "documents_round_trip",
    f"""WITH {NORMAL_SQL} {_normal_sql(_GIVEN_ID + " ELSE 'fallback' END")}""",
)
def documents_round_trip(spark, folder):
    path = scratch(spark)
    documents(spark, folder).drop("source_dataset").write.json(f"{path}/data/part")
    back = readers.read_reaction_documents(spark, path, REACTION_DOCUMENT, "*.json")
    shown = _shown(extract.normalize_reaction(back))
    # Without an id of its own a row is named after its file, and files are named by Spark.
    return shown.withColumn("reaction_id", F.regexp_replace("reaction_id", "^ord_.*", "fallback"))


@query(
    "role_lookup",
    f"""SELECT smiles, CASE WHEN any_value(p) = 'PROMO' THEN 'reagent' ELSE 'substrate' END AS role FROM (
      SELECT {X.sql_species("p_partkey")} || p_partkey AS smiles, p_type AS p FROM part) GROUP BY smiles""",
)
def role_lookup(spark, folder):
    path = scratch(spark)
    role = F.when(F.col("p_type") == "PROMO", "reagent").otherwise(F.lower("p_type"))
    rows = table(spark, folder, "part").select(
        F.concat(X.species(F.col("p_partkey")), F.col("p_partkey")).alias("smiles"),
        role.alias("role"), F.col("p_name").alias("name"), F.lit("").alias("ambiguous"),
    )
    rows.write.csv(path, sep="\t", header=True, quote="", emptyValue="")
    return readers.read_role_lookup(spark, path)


@query(
    "run_round_trip",
    f"""WITH {X.RECORDS_SQL}, {X.run_sql("cands")}
    SELECT rid AS record_pos, any_value(product) AS product, coalesce(string_agg(cand, ' ' ORDER BY rank), '') AS candidates,
      any_value(n) AS total FROM recs LEFT JOIN cands USING (rid), (SELECT count(*) AS n FROM orders) GROUP BY rid""",
)
def run_round_trip(spark, folder):
    path = scratch(spark)
    run = X.run(spark, folder)
    writers.write_run(run.agg(F.count("*").alias("total")), run, path)
    total = spark.read.schema("total BIGINT").json(f"{path}/summary").scalar()
    return spark.read.parquet(f"{path}/records").select(
        "record_pos", "product", F.array_join("candidates", " ").alias("candidates"), total.alias("total")
    )


@query("resume_append", "SELECT o_orderkey, o_custkey FROM orders")
def resume_append(spark, folder):
    path = scratch(spark)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    writers.resume_append(orders.where("o_orderstatus = 'F'"), path, "o_orderkey")
    writers.resume_append(orders, path, "o_orderkey")
    writers.resume_append(orders, path, "o_orderkey")
    return spark.read.parquet(path)


# --- streams ------------------------------------------------------------------------------


def _finish(stream, spark, schema):
    out = scratch(spark)
    running = streams.stream_append(stream, f"{out}/rows", f"{out}/checkpoint")
    running.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


@query(
    "stream_normalize",
    f"""WITH {NORMAL_SQL} {_normal_sql(_GIVEN_ID + " ELSE 'fallback' END")}""",
)
def stream_normalize(spark, folder):
    path = scratch(spark)
    documents(spark, folder).drop("source_dataset").write.json(path)
    normal = streams.stream_normalize(spark, path)
    back = _finish(normal, spark, normal.schema)
    return _shown(back).withColumn(
        "reaction_id", F.regexp_replace("reaction_id", "^ord_.*", "fallback")
    )


def _text_stream(spark, folder):
    path = scratch(spark)
    table(spark, folder, "documents").select("doc_id", "text").write.parquet(path)
    return spark.readStream.schema("doc_id BIGINT, text STRING").parquet(path)


@query(
    "stream_exclude",
    f"WITH {curation.HOLDOUT_SQL} SELECT doc_id FROM documents WHERE {curation.OUTSIDE}",
)
def stream_exclude(spark, folder):
    open_docs = streams.stream_exclude(_text_stream(spark, folder), curation.holdout(spark, folder), "text")
    return _finish(open_docs.select("doc_id"), spark, "doc_id BIGINT")


@query("stream_dedupe", "SELECT DISTINCT md5(text) AS digest FROM documents WHERE text <> ''")
def stream_dedupe(spark, folder):
    unique = streams.stream_dedupe(_text_stream(spark, folder), "text")
    return _finish(unique.select(F.md5("text").alias("digest")), spark, "digest STRING")


@query("stream_append", "SELECT event_id, event_type FROM events")
def stream_append(spark, folder):
    path, out = scratch(spark), scratch(spark)
    events = table(spark, folder, "events").select("event_id", "event_type")
    schema = "event_id BIGINT, event_type STRING"
    for part in ("event_type = 'click'", "event_type <> 'click'"):
        # The second run starts from the checkpoint of the first and takes the new files only.
        events.where(part).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        streams.stream_append(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


def _list_files(docs, path: str, head, tail: str = "") -> None:
    """A file for each source: ``head``, the source's documents as a JSON list, ``tail``."""
    # Keys may repeat: a row's place in its table tells it from the others.
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    rows = docs.select(F.coalesce("source", F.lit("none")).alias("bucket"), "doc_id", "source", "text", *place)
    order = ["doc_id", "file", "row"]
    # First, last and number of each list from the keys alone, so that texts move once.
    ends = rows.groupBy("bucket").agg(
        F.min(F.struct(*order)).alias("low"), F.max(F.struct(*order)).alias("high"), F.count("*").alias("n")
    )
    rows = rows.join(F.broadcast(ends), "bucket")
    is_row = lambda end: (F.col("file") == F.col(f"{end}.file")) & (F.col("row") == F.col(f"{end}.row"))
    value = F.concat(
        F.when(is_row("low"), head).otherwise(F.lit(",")),
        F.to_json(F.struct("doc_id", "source", "text")),
        F.when(is_row("high"), F.lit("]" + tail)).otherwise(F.lit("")),
    )
    lines = rows.repartition("bucket").sortWithinPartitions("bucket", *order).select("bucket", value.alias("value"))
    lines.write.partitionBy("bucket").text(path)


LISTED = "doc_id BIGINT, source STRING, text STRING"


@query("json_arrays", "SELECT doc_id, source, md5(text) AS digest, length(text) AS n_chars FROM documents")
def json_arrays(spark, folder):
    """Whole documents through files that are one JSON array each."""
    path = scratch(spark)
    _list_files(table(spark, folder, "documents"), path, F.lit("["))
    back = readers.read_records(spark, path, LISTED, form="array")
    return back.select("doc_id", "source", F.md5("text").alias("digest"), F.char_length("text").cast("long").alias("n_chars"))


@query(
    "read_runs",
    """SELECT doc_id, source, md5(text) AS digest,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS record_pos FROM documents""",
)
def read_runs(spark, folder):
    """Run files of one JSON value each: a summary, then the records in their order."""
    path = scratch(spark)
    summary = F.concat(F.lit('{"summary":'), F.to_json(F.struct("bucket", "n")), F.lit(',"records":['))
    docs = table(spark, folder, "documents")
    _list_files(docs, path, summary, "}")
    back = readers.read_run(spark, path, f"records ARRAY<STRUCT<{LISTED}>>", several=True)
    return back.select("doc_id", "source", F.md5("text").alias("digest"), "record_pos")
