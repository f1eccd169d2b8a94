"""Queries for training text and its audits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flaskmill.functions import rendering as R
from flaskmill.operators import audits
from flaskmill.plans import curation
from flaskmill.plans import fixtures as X
from flaskmill.plans.registry import heavy_table, query, table

ALWAYS = ("solvent", "temperature_celsius")
CODE_SQL = """CASE WHEN solvent IS NULL AND temperature_celsius IS NULL THEN '0' ELSE
    CASE WHEN solvent IS NOT NULL THEN 'S' ELSE '' END || CASE WHEN temperature_celsius IS NOT NULL THEN 'T' ELSE '' END END"""


@query(
    "format_input",
    f"""WITH {X.CONDITION_RECORDS_SQL} SELECT rid AS record_pos,
    'predict conditions: [' || {CODE_SQL} || '] PRODUCT: ' || product_smiles || ' REACTANTS: ' || reactants_smiles AS prompt,
    'predict conditions: PRODUCT: ' || product_smiles || ' REACTANTS: ' || reactants_smiles AS plain FROM recs""",
)
def format_input(spark, folder):
    return X.condition_records(spark, folder).select(
        "record_pos",
        R.format_input("product_smiles", "reactants_smiles", R.schema_code(ALWAYS)).alias("prompt"),
        R.format_input("product_smiles", "reactants_smiles").alias("plain"),
    )


@query(
    "format_target_compact",
    f"""WITH {X.CONDITION_RECORDS_SQL} SELECT rid AS record_pos,
    concat_ws('|', {", ".join(f"coalesce({f}::VARCHAR, '?')" for f in X.FIELDS)}) AS whole,
    concat_ws('|', {", ".join(f"{f}::VARCHAR" if f in ALWAYS else f"coalesce({f}::VARCHAR, '?')" for f in X.FIELDS)}) AS partial
    FROM recs""",
)
def format_target_compact(spark, folder):
    return X.condition_records(spark, folder).select(
        "record_pos",
        R.format_target("compact").alias("whole"),
        R.format_target("compact", always=ALWAYS).alias("partial"),
    )


DOC_FIELDS = {
    "reagents": "lang", "solvent": "text", "catalyst": "source",
    "temperature_celsius": "n_chars", "yield_percent": "quality",
}


def _json_sql(drop: bool) -> str:
    parts = []
    for field, column in DOC_FIELDS.items():
        value = f"{column}::VARCHAR" if column in ("n_chars", "quality") else f"to_json({column})::VARCHAR"
        missing = "NULL" if drop and field in ALWAYS else f"'\"{field}\":\"not specified\"'"
        parts.append(
            f"CASE WHEN {column} IS NOT NULL AND {column}::VARCHAR <> '' THEN '\"{field}\":' || {value} ELSE {missing} END"
        )
    return f"'{{' || concat_ws(',', {', '.join(parts)}) || '}}'"


@query(
    "format_target_json",
    f"""WITH {curation.LABELLED_SQL} SELECT doc_id, md5({_json_sql(False)}) AS whole,
    md5({_json_sql(True)}) AS partial FROM labelled""",
)
def format_target_json(spark, folder):
    rows = heavy_table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return rows.select(
        "doc_id",
        F.md5(R.format_target("json", columns=DOC_FIELDS)).alias("whole"),
        F.md5(R.format_target("json", always=ALWAYS, columns=DOC_FIELDS)).alias("partial"),
    )


@query(
    "schema_code_counts",
    f"WITH {X.CONDITION_RECORDS_SQL} SELECT {CODE_SQL} AS code, count(*) AS rows FROM recs GROUP BY 1",
)
def schema_code_counts(spark, folder):
    return audits.schema_code_counts(X.condition_records(spark, folder), ALWAYS)


@query(
    "char_inventory",
    """SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM (
      SELECT text FROM documents UNION ALL SELECT text FROM conversations) WHERE text <> ''""",
)
def char_inventory(spark, folder):
    texts = heavy_table(spark, folder, "documents").select("text").unionByName(
        heavy_table(spark, folder, "conversations").select("text")
    )
    return audits.char_inventory(texts, ["text"])


VOCAB_SQL = "vocab AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark)"


def vocab(spark, folder):
    return audits.char_inventory(table(spark, folder, "benchmark"), ["text"])


@query(
    "missing_chars",
    f"""WITH {VOCAB_SQL} SELECT DISTINCT ch FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents)
    WHERE ch <> '' AND ch NOT IN (SELECT ch FROM vocab)""",
)
def missing_chars(spark, folder):
    have = audits.char_inventory(heavy_table(spark, folder, "documents"), ["text"])
    return audits.missing_chars(have, vocab(spark, folder))


@query(
    "strings_with_unknown",
    f"""WITH {VOCAB_SQL}, known AS (SELECT list(ch) AS v FROM vocab)
    SELECT count(*) AS texts, count(*) FILTER (len(list_filter(list_distinct(string_split(text, '')),
      lambda c: c <> '' AND NOT list_contains(known.v, c))) > 0) AS with_unknown FROM (
      SELECT text FROM documents UNION ALL SELECT lang FROM documents), known""",
)
def strings_with_unknown(spark, folder):
    docs = heavy_table(spark, folder, "documents").select("text", "lang")
    return audits.strings_with_unknown(docs, ["text", "lang"], vocab(spark, folder))


PREFIX_SQL = """CASE WHEN least(length(a), length(b)) = 0 THEN 0 ELSE coalesce(
    list_min([i FOR i IN range(1, least(length(a), length(b)) + 1) IF substr(a, i, 1) <> substr(b, i, 1)]) - 1,
    least(length(a), length(b))) END"""


@query(
    "common_prefix_length",
    f"""WITH {X.CONDITION_RECORDS_SQL}, pairs AS (SELECT rid, product_smiles AS a, reactants_smiles AS b FROM recs)
    SELECT rid AS record_pos, ({PREFIX_SQL})::INT AS shared FROM pairs""",
)
def common_prefix_length(spark, folder):
    shared = audits.common_prefix_length(F.col("product_smiles"), F.col("reactants_smiles"))
    return X.condition_records(spark, folder).select("record_pos", shared.alias("shared"))


@query(
    "length_profile",
    """SELECT avg(length(text)) AS mean, quantile_disc(length(text), 0.95)::INT AS p95,
    quantile_disc(length(text), 0.99)::INT AS p99, max(length(text))::INT AS longest,
    avg((length(text) > 200)::INT) AS over_200, avg((length(text) > 2000)::INT) AS over_2000 FROM documents""",
)
def length_profile(spark, folder):
    docs = heavy_table(spark, folder, "documents").select("text")
    return audits.length_profile(docs, "text", [200, 2000])


@query(
    "length_sketches",
    """SELECT count(*) AS rows, avg(length(text)) AS mean, max(length(text))::BIGINT AS longest,
    true AS p95_close, true AS p99_close, true AS over_200_close FROM documents WHERE text IS NOT NULL""",
)
def length_sketches(spark, folder):
    """Parts by source, sketched by themselves and combined; their ranks held against the texts."""
    docs = heavy_table(spark, folder, "documents").select("source", "text").where("text IS NOT NULL")
    profile = audits.profile_of_sketches(audits.length_sketch(docs, "text", ["source"]), [200])
    n = F.length("text")
    close = lambda share, wanted: F.abs(share - wanted) <= audits.SKETCH_RANK_ERROR
    below = lambda q: (F.avg((n < F.col(q)).cast("int")), F.avg((n <= F.col(q)).cast("int")))
    held = docs.join(F.broadcast(profile), F.lit(True)).groupBy("rows", "mean", "longest", "over_200")  # one row

    def inside(q, wanted):
        low, high = below(q)
        return (low - audits.SKETCH_RANK_ERROR <= wanted) & (high + audits.SKETCH_RANK_ERROR >= wanted)

    return held.agg(
        inside("p95", 0.95).alias("p95_close"), inside("p99", 0.99).alias("p99_close"),
        close(F.avg((n > 200).cast("int")), F.col("over_200")).alias("over_200_close"),
    ).drop("over_200")


@query("length_buckets", "SELECT doc_id, length(text)::INT AS chars FROM documents")
def length_buckets(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    laid_out = audits.length_buckets(docs, "text", "doc_id", 16)
    return laid_out.select("doc_id", F.length("text").alias("chars"))


@query("length_layout", "SELECT true AS in_order, true AS even, count(*) AS n, sum(length(text)) AS chars FROM documents")
def length_layout(spark, folder):
    """Partitions of the layout hold lengths that follow each other, and about as many rows each."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    laid_out = audits.length_buckets(docs, "text", "doc_id", 16)
    parts = laid_out.groupBy(F.spark_partition_id().alias("part")).agg(
        F.min(F.length("text")).alias("low"), F.max(F.length("text")).alias("high"),
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"),
    )
    follows = F.col("low") >= F.coalesce(F.lag("high").over(W.orderBy("part")), F.col("low"))
    return parts.withColumn("follows", follows).agg(  # a row for each partition
        F.bool_and("follows").alias("in_order"), (F.max("n") * 16 <= 3 * F.sum("n")).alias("even"),
        F.sum("n").alias("n"), F.sum("chars").alias("chars"),
    )


@query(
    "parse_generation_compact",
    f"""WITH {X.PARSED_SQL} SELECT rid AS record_pos, rank::INT AS rank, ok,
    {", ".join(f"coalesce({f}, 'none') AS {f}" for f in X.FIELDS)} FROM parsed""",
)
def parse_generation_compact(spark, folder):
    from flaskmill.operators.dedupe import dedupe_candidates_raw

    texts = X.generations(spark, folder).select(
        "record_pos", F.posexplode(dedupe_candidates_raw("candidates_raw")).alias("pos", "raw")
    )
    parsed = texts.withColumn("p", R.parse_generation("raw", "compact", X.FIELDS))
    return parsed.select(
        "record_pos", (F.col("pos") + 1).alias("rank"), F.col("p").isNotNull().alias("ok"),
        *[F.coalesce(F.col("p")[f], F.lit("none")).alias(f) for f in X.FIELDS],
    )


@query(
    "parse_generation_json",
    """WITH made AS (SELECT event_id, user_id % 6 AS kind,
      '"solvent":"' || event_type || '","temperature_celsius":' || value AS body FROM events),
    raws AS (SELECT event_id, CASE kind WHEN 0 THEN '{' || body || '}' WHEN 1 THEN body WHEN 2 THEN '[1,2]'
      WHEN 3 THEN '{' || body WHEN 4 THEN '{' || body || '} end' ELSE '{"solvent":null}' END AS raw FROM made),
    tried AS (SELECT event_id, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw
      WHEN json_valid('{' || raw || '}') THEN '{' || raw || '}' END AS good FROM raws)
    SELECT event_id, good IS NOT NULL AS ok, coalesce(good ->> '$.solvent', 'none') AS solvent,
      coalesce(good ->> '$.temperature_celsius', 'none') AS temperature_celsius FROM tried""",
)
def parse_generation_json(spark, folder):
    kind = F.col("user_id") % 6
    body = F.concat(
        F.lit('"solvent":"'), "event_type", F.lit('","temperature_celsius":'), F.col("value").cast("string")
    )
    raw = (
        F.when(kind == 0, F.concat(F.lit("{"), body, F.lit("}")))
        .when(kind == 1, body)
        .when(kind == 2, "[1,2]")
        .when(kind == 3, F.concat(F.lit("{"), body))
        .when(kind == 4, F.concat(F.lit("{"), body, F.lit("} end")))
        .otherwise('{"solvent":null}')
    )
    fields = ("solvent", "temperature_celsius")
    parsed = table(spark, folder, "events").select(
        "event_id", R.parse_generation(raw, "json", fields).alias("p")
    )
    return parsed.select(
        "event_id", F.col("p").isNotNull().alias("ok"),
        *[F.coalesce(F.col("p")[f], F.lit("none")).alias(f) for f in fields],
    )
