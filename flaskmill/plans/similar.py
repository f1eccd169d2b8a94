"""Queries for feature sets and similarity search."""

from __future__ import annotations

from pyspark.sql import functions as F

from flaskmill.constants import FINGERPRINT_BITS, SIMILARITY_WEIGHTS
from flaskmill.functions import fingerprints as P
from flaskmill.operators import ordering, similarity
from flaskmill.plans.chemistry import _class_sql
from flaskmill.plans.registry import heavy_table, query


def _bits(text: str) -> str:
    return (
        f"list_distinct([('0x' || md5(substr({text}, i, 3))[1:8])::BIGINT % {FINGERPRINT_BITS} "
        f"FOR i IN range(1, greatest(length({text}) - 2, 1) + 1)])"
    )


ITEMS_SQL = f"""items AS (SELECT page_id AS row_id, html AS product,
      regexp_replace(html, '<[^>]*>', ' ', 'g') AS reactants,
      CASE regexp_extract(url, '/([a-z][a-z])/', 1) WHEN 'fr' THEN 'oxidation' WHEN 'de' THEN 'reduction'
        WHEN 'en' THEN 'suzuki' ELSE '' END AS rclass FROM pages),
    fp AS (SELECT row_id, product, rclass, {_bits("product")} AS fp,
      list_distinct(flatten([{_bits("f")} FOR f IN string_split(reactants, '.') IF f <> ''])) AS rfp
      FROM items WHERE product <> ''),
    vec AS (SELECT row_id, product, rclass, fp, list_concat(
      list_filter(fp, lambda b: NOT list_contains(rfp, b)), list_filter(rfp, lambda b: NOT list_contains(fp, b))) AS tx FROM fp)"""


def items(spark, folder):
    lang = F.regexp_extract("url", "/([a-z][a-z])/", 1)
    rclass = (
        F.when(lang == "fr", "oxidation").when(lang == "de", "reduction").when(lang == "en", "suzuki").otherwise("")
    )
    return heavy_table(spark, folder, "pages").select(
        F.col("page_id").alias("row_id"), F.col("html").alias("product"),
        F.regexp_replace("html", "<[^>]*>", " ").alias("reactants"), rclass.alias("rclass"),
    )


def _listed(bits: str) -> str:
    return f"array_to_string(list_sort({bits}), ',')"


@query(
    "feature_set",
    f"WITH {ITEMS_SQL} SELECT row_id, md5({_listed('fp')}) AS bits, len(fp)::INT AS n FROM vec",
)
def feature_set(spark, folder):
    bits = items(spark, folder).select("row_id", P.feature_set("product").alias("fp"))
    return bits.select("row_id", F.md5(F.array_join("fp", ",")).alias("bits"), F.size("fp").alias("n"))


HELD_SQL = "held AS (SELECT DISTINCT product FROM (SELECT product FROM items ORDER BY md5(concat_ws(':', '3', row_id)), row_id LIMIT 40))"


def held(spark, folder):
    return ordering.first_by_hash(items(spark, folder), 40, "row_id", 3).select("product")


@query(
    "similarity_table",
    f"""WITH {ITEMS_SQL}, {HELD_SQL} SELECT row_id, product, md5({_listed('fp')}) AS fp, md5({_listed('tx')}) AS tx
    FROM vec WHERE product NOT IN (SELECT product FROM held)""",
)
def similarity_table(spark, folder):
    out = similarity.build_similarity_table(
        items(spark, folder), held(spark, folder), payload=["row_id", "product"]
    )
    text = lambda c: F.md5(F.array_join(c, ","))
    return out.select("row_id", "product", text("fp").alias("fp"), text("tx").alias("tx"))


@query(
    "similarity_table_report",
    f"""WITH {ITEMS_SQL}, {HELD_SQL} SELECT count(*) FILTER (NOT out AND product <> '') AS indexed,
    count(*) FILTER (NOT out AND product = '') AS skipped, count(*) FILTER (out) AS excluded
    FROM (SELECT product, product IN (SELECT product FROM held) AS out FROM items)""",
)
def similarity_table_report(spark, folder):
    return similarity.similarity_table_report(items(spark, folder), held(spark, folder))


K = 5
#: The stated set of queries: every row whose id is divisible by this.
EVERY = 50
W1, W2, W3 = SIMILARITY_WEIGHTS


def _jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    union = f"(len({a}) + len({b}) - {shared})"
    return f"CASE WHEN {union} = 0 THEN 0.0 ELSE {shared}::DOUBLE / {union} END"


@query(
    "similar_topk",
    f"""WITH {ITEMS_SQL},
    named AS (SELECT *, {_class_sql("rclass")} AS cls FROM vec),
    pairs AS (SELECT q.row_id AS query, t.row_id AS neighbour, ({_jaccard("t.fp", "q.fp")}) AS ps,
        ({_jaccard("t.tx", "q.tx")}) AS ts,
        CASE WHEN t.cls IS NULL OR q.cls IS NULL THEN 0.0 WHEN t.cls = q.cls THEN 1.0
             WHEN t.cls IN ('oxidation', 'reduction') AND q.cls IN ('oxidation', 'reduction') THEN 0.5 ELSE 0.0 END AS cs
      FROM named q JOIN named t ON q.row_id <> t.row_id WHERE q.row_id % {EVERY} = 0),
    scored AS (SELECT query, neighbour, {W1}::DOUBLE * ps + {W2}::DOUBLE * ts + {W3}::DOUBLE * cs AS score FROM pairs)
    SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, neighbour)::INT AS rank,
      neighbour, round(score, 9) AS score
    FROM scored QUALIFY rank <= {K}""",
)
def similar_topk(spark, folder):
    rows = items(spark, folder)
    return similarity.similar_topk(rows.where(F.col("row_id") % EVERY == 0), rows, K)


@query("similar_topk_indexed")
def similar_topk_indexed(spark, folder):
    """Neighbours of every row, through the index."""
    rows = items(spark, folder)
    return similarity.similar_topk(rows, rows, K, exact=False)
