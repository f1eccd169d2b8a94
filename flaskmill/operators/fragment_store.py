"""A fragment dimension that is kept and grows: parts of a corpus add what they bring.

Two bucketed tables by fragment: attributes, one row a fragment and written once, and counts, one
row a fragment and part. A new part is counted by itself and meets the stored fragments in their
buckets, so only its own fragments are shuffled and only those never seen get attributes. Both
tables lie in a folder of the caller's and are registered from there in every session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flaskmill.operators.fragments import describe_fragments, explode_fragments

ATTRIBUTES = (
    "raw STRING, canonical STRING, has_carbon BOOLEAN, net_charge BIGINT, heavy_atoms BIGINT, "
    "elements ARRAY<STRING>, is_auxiliary BOOLEAN, is_valid BOOLEAN"
)
COUNTS = "raw STRING, part STRING, occurrences BIGINT"


class FragmentStore:
    """``name`` is a table name, ``path`` its folder; ``buckets`` stays what it was at the start.

    Buckets below the session's shuffle partitions make Spark shuffle the stored side as well.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 256):
        self.spark, self.name, self.counts = spark, name, f"{name}_counts"
        for table, columns in ((self.name, ATTRIBUTES), (self.counts, COUNTS)):
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (raw) "
                f"SORTED BY (raw) INTO {buckets} BUCKETS LOCATION '{path.rstrip('/')}/{table}'"
            )

    def unseen(self, counted: DataFrame) -> DataFrame:
        """Fragments of ``counted`` without attributes; the stored ones stay in their buckets."""
        return counted.join(self.spark.table(self.name).select("raw").hint("merge"), "raw", "left_anti")

    def add(self, part: str, sources: Sequence[tuple[DataFrame, Sequence[str]]]) -> bool:
        """Add a part's fragments; false if the part is there already.

        Attributes come first: a run that ends in between is repeated by adding the part again.
        """
        from functools import reduce

        if not self.spark.table(self.counts).where(F.col("part") == part).limit(1).isEmpty():
            return False
        every = reduce(DataFrame.unionByName, [explode_fragments(df, cols) for df, cols in sources])
        counted = every.where(F.col("raw").isNotNull()).groupBy("raw").agg(F.count("*").alias("occurrences"))
        self._insert(describe_fragments(self.unseen(counted.select("raw"))), self.name)
        self._insert(counted.withColumn("part", F.lit(part)), self.counts)
        return True

    def _insert(self, rows: DataFrame, table: str) -> None:
        columns = self.spark.table(table).schema
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns]).write.insertInto(table)

    def table(self) -> DataFrame:
        """The dimension over all parts; buckets meet where they are."""
        counted = self.spark.table(self.counts).groupBy("raw").agg(F.sum("occurrences").alias("occurrences"))
        return self.spark.table(self.name).hint("merge").join(counted, "raw")
