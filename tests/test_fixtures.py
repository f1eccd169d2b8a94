"""The derived inputs use every row of the tables they come from."""

from pyspark.sql import functions as F

from flaskmill.operators import extract
from flaskmill.plans import fixtures, ingest

FOLDER = "/root/testdata/sf0.001"


def test_every_line_is_a_component_and_a_candidate(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    known = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left_semi").count()
    exploded = extract.explode_inputs(ingest.documents(spark, FOLDER), "index_in_file")
    assert exploded.count() == known
    made = fixtures.generations(spark, FOLDER).agg(F.sum(F.size("candidates_raw"))).head()[0]
    assert made == lines.count()
