"""Records of large JSON values, read by as many tasks as the file has splits.

A file is cut at every ``}``, which Spark's text source does split by split. Whether a piece
begins inside a text, and how deep, follows from all pieces before it: each counts its quotes
and brackets for both cases (it begins outside of a text, or inside), a split sums up its own,
and the sums of the splits before, a row each, decide which case holds. A piece that comes back
to the depth of the list closes a record. The task that reads a split adds the sums within it, and
the pieces are written once; what a split or a file adds is a row each and is sent to them. So only
the pieces of records of several pieces move, to be put together. An escape never spans a cut: ``}``
is not escaped in JSON.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flaskmill.session import stage

SPLIT = ["file_path", "file_block_start"]
BEFORE = W.unboundedPreceding, -1
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


def _brackets(text: Column) -> Column:
    """Opened less closed."""
    count = lambda signs: F.char_length(text) - F.char_length(F.translate(text, signs, ""))
    return count("{[") - count("}]")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """piece, closed (a ``}`` follows), at (order within the split), odd (quotes), and the change
    of depth if the piece begins outside of a text (d0) or inside (d1)."""
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "}").text(path)
    place = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_name", "file_block_start", "file_size")]
    # Without escaped signs only quotes that open or close a text are left.
    bare = F.regexp_replace("value", r"\\.", "")
    parts = F.split(bare, '"')
    inside = lambda first: F.array_join(F.filter(parts, lambda _, i: i % 2 == first), " ")
    return lines.select(
        F.col("value").alias("piece"),
        *place,
        F.monotonically_increasing_id().alias("at"),
        (F.octet_length("value") + 1).alias("bytes"),
        ((F.size(parts) - 1) % 2).alias("odd"),
        _brackets(inside(0)).alias("d0"),
        _brackets(inside(1)).alias("d1"),
    )


def _upto(column: Column, order: list, by: list) -> Column:
    return F.coalesce(F.sum(column).over(W.partitionBy(*by).orderBy(*order).rowsBetween(*BEFORE)), F.lit(0))


SUMMED = (
    "piece string, file_path string, file_name string, file_block_start long, file_size long, at long, bytes long, "
    "odd long, was long, c0 long, c1 long, s0 long, s1 long, nth long, rank long"
)


def _summed(pieces: DataFrame) -> DataFrame:
    """Sums within a split, in the task that reads it: ``was`` (the piece begins inside of a text if the split
    begins outside), the change of depth (c0, c1) and that of all pieces before (s0, s1) for both cases, its
    place (``nth``), and that among the pieces that end outside of a text in the same case and as deep (``rank``)."""

    def run(batches):
        ends, ranks = {}, {}
        for batch in batches:
            sums = {k: np.zeros(batch.num_rows, np.int64) for k in ("was", "c0", "c1", "s0", "s1", "nth", "rank")}
            narrow = batch.select(["file_path", "file_block_start", "odd", "d0", "d1"]).to_pandas()
            odds, d0, d1 = (narrow[k].to_numpy(np.int64) for k in ("odd", "d0", "d1"))
            for split, at in narrow.groupby(["file_path", "file_block_start"], sort=False).indices.items():
                odd, s0, s1, nth = ends.get(split, (0, 0, 0, 0))
                total = odd + np.cumsum(odds[at])
                was, case = (total - odds[at]) % 2, total % 2  # it ends outside of a text in this case
                # The cut-off brace counts if the piece ends outside of a text.
                c0 = np.where(was == 0, d0[at], d1[at]) - (case == 0)
                c1 = np.where(was == 1, d0[at], d1[at]) - (case == 1)
                after0, after1 = s0 + np.cumsum(c0), s1 + np.cumsum(c1)
                kind = 2 * np.where(case == 0, after0, after1) + case
                order = np.argsort(kind, kind="stable")
                kinds, first, n = np.unique(kind[order], return_index=True, return_counts=True)
                known = ranks.setdefault(split, {})
                begin = np.asarray([known.get(k, 0) for k in kinds.tolist()], np.int64)
                rank = np.empty(len(at), np.int64)
                rank[order] = np.arange(len(at)) + np.repeat(begin - first, n)
                known.update(zip(kinds.tolist(), (begin + n).tolist(), strict=True))
                ends[split] = int(total[-1]), int(after0[-1]), int(after1[-1]), nth + len(at)
                found = {"was": was, "c0": c0, "c1": c1, "s0": after0 - c0, "s1": after1 - c1, "rank": rank}
                for k, v in (found | {"nth": nth + np.arange(len(at))}).items():
                    sums[k][at] = v
            kept = ["piece", "file_path", "file_name", "file_block_start", "file_size", "at", "bytes", "odd"]
            columns = [batch.column(k) for k in kept] + [pa.array(sums[k]) for k in ("was", "c0", "c1", "s0", "s1", "nth", "rank")]
            yield pa.RecordBatch.from_arrays(columns, names=kept + ["was", "c0", "c1", "s0", "s1", "nth", "rank"])

    return pieces.withColumns({k: F.col(k).cast("long") for k in ("bytes", "odd")}).mapInArrow(run, SUMMED)


def _placed(pieces: DataFrame) -> DataFrame:
    """Adds ``text`` (the piece begins inside of one), ``depth`` before and ``after`` it."""
    rows = stage(_summed(pieces))
    totals = rows.groupBy(*SPLIT).agg(
        F.sum("odd").alias("odd"), F.sum("c0").alias("t0"), F.sum("c1").alias("t1"), F.max("at").alias("end"),
        F.sum("bytes").alias("bytes"), F.max("file_size").alias("size"),
    )
    order = ["file_block_start"]
    totals = totals.withColumn("case", _upto(F.col("odd"), order, ["file_path"]) % 2)
    own = F.when(F.col("case") == 0, F.col("t0")).otherwise(F.col("t1"))
    last = F.col("file_block_start") == F.max("file_block_start").over(W.partitionBy("file_path"))
    # Without a brace behind the last piece the pieces come to one byte more than the file; a
    # byte order mark is not among them. Of compressed files only their texts are known.
    over = F.sum("bytes").over(W.partitionBy("file_path")) - F.col("size")
    totals = totals.withColumns(
        {
            "start": _upto(own, order, ["file_path"]),
            "end": F.when(last, F.col("end")),
            "braced": F.when(F.col("file_path").rlike(PACKED), F.lit(None)).otherwise(over.isin(0, -3)),
        }
    )
    totals = stage(totals.select(*SPLIT, "case", "start", "end", "braced"))
    pick = lambda a: F.when(F.col("case") == 0, F.col(f"{a}0")).otherwise(F.col(f"{a}1"))
    return (
        rows.join(F.broadcast(totals), SPLIT)
        .withColumns(
            {
                "text": F.col("was") != F.col("case"),
                "depth": F.col("start") + pick("s"),
                "after": F.col("start") + pick("s") + pick("c"),
                "tail": F.coalesce(F.col("at") == F.col("end"), F.lit(False)),
            }
        )
        .select("piece", "file_path", "file_name", "file_block_start", "at", "nth", "rank", "odd", "text", "depth", "after", "tail", "braced")
    )


def _opening(field: str | None) -> Column:
    """What follows the list's ``[`` in the piece that opens it, else null."""
    if field is None:
        found = F.regexp_extract("piece", r"^[\s\x{FEFF}]*\[((?s).*)$", 1)
        starts = (F.col("file_block_start") == 0) & (F.col("depth") == 0) & F.col("piece").rlike(r"^[\s\x{FEFF}]*\[")
        return F.when(starts & ~F.col("text") & (F.col("nth") == 0), found)
    key = rf'"{re.escape(field)}"\s*:\s*\['
    parts = F.split("piece", key)
    base = F.when(F.col("text"), 1).otherwise(0)

    def rest(i: Column) -> Column:
        """The piece behind the i-th place where the key stands, if it is one of the outermost."""
        ahead = F.array_join(F.slice(parts, 1, i), " ")
        bare = F.split(F.regexp_replace(ahead, r"\\.", ""), '"')
        outside = F.array_join(F.filter(bare, lambda _, j: (j + base) % 2 == 0), " ")
        even = (F.size(bare) - 1 + base) % 2 == 0
        behind = F.array_join(F.slice(parts, i + 1, F.size(parts)), f'"{field}":[')
        return F.when(even & (F.col("depth") + _brackets(outside) == 1), behind)

    places = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), rest)
    return F.when(F.size(parts) > 1, F.get(F.filter(places, lambda x: x.isNotNull()), F.lit(0)))


def json_records(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """value (the text of a record), file_path, file_name, position: the objects of the list that
    each file is, or that it has under the outermost key ``field``.

    Large files are read by several tasks. A file that ends inside a text or with open brackets
    is an error, as is one without the list. Elements that are no objects stay in the text of the
    next record, where parsing finds them.
    """
    level = 1 if field is None else 2
    rows = _placed(_pieces(spark, path))
    ends = rows.where("tail").select(
        "file_path",
        (F.col("text") != (F.col("odd") == 1)).alias("open"),
        F.when(F.col("braced"), F.col("after") == 0)
        .when(~F.col("braced"), F.col("after") == -1)
        .otherwise(F.col("after").isin(0, -1))
        .alias("closed"),
    )
    whole = F.when(F.col("closed") & ~F.col("open"), 0).otherwise(1)
    here, rest = F.struct("file_block_start", "at"), _opening(field)
    starts = stage(rows.where(rest.isNotNull()).groupBy("file_path").agg(F.min(here).alias("from")))
    bad = ends.join(starts, "file_path", "left").agg(
        F.sum(whole).alias("open"), F.count_if(F.col("from").isNull()).alias("none")
    ).first()
    if bad["open"] or bad["none"]:
        raise ValueError(f"{path}: {bad['open'] or 0} files end too early, {bad['none']} have no list of records")
    rows = rows.join(F.broadcast(starts), "file_path")
    first, late = here == F.col("from"), here >= F.col("from")
    empty = F.when(first, rest.rlike(r"^\s*\]"))
    shut = (F.col("depth") == level) & ~F.col("text") & F.col("piece").rlike(r"^\s*\]")
    over = rows.where(late & (empty | (shut & ~first))).groupBy("file_path").agg(F.min(here).alias("to"))
    rows = rows.join(F.broadcast(stage(over)), "file_path", "left")
    rows = rows.withColumns(
        {
            "closes": (F.col("after") == level) & ~(F.col("text") != (F.col("odd") == 1)),
            "listed": late & (F.col("to").isNull() | (here < F.col("to"))),
        }
    )
    sums = rows.groupBy(*SPLIT).agg(
        F.count_if(F.col("closes") & F.col("listed")).alias("n"), F.count_if(F.col("closes") & ~late).alias("skipped")
    )
    sums = sums.withColumn("before", _upto(F.col("n"), ["file_block_start"], ["file_path"]))
    numbered = rows.where("listed").join(F.broadcast(sums), SPLIT).select(
        *SPLIT, "file_name", "at", "closes", "before", "n", (F.col("rank") - F.col("skipped")).alias("rank"),
        F.when(first, rest).otherwise(F.col("piece")).alias("piece"),
        # Between records where it begins and where it ends: a record of its own.
        (F.col("closes") & ~first & (F.col("depth") == level) & ~F.col("text")).alias("alone"),
    )
    onward = W.partitionBy(*SPLIT).orderBy("at").rowsBetween(W.currentRow, W.unboundedFollowing)
    ends_at = F.first(F.when(F.col("closes"), F.col("rank")), ignorenulls=True).over(onward)
    parts = numbered.where("NOT alone").withColumn("position", F.col("before") + F.coalesce(ends_at, F.col("n")))
    joined = parts.groupBy("file_path", "file_name", "position").agg(
        F.sort_array(F.collect_list(F.struct("file_block_start", "at", "piece"))).alias("pieces"),
        F.max("closes").alias("closes"),
    )
    joined = joined.where("closes").withColumn("piece", F.array_join(F.col("pieces.piece"), "}"))
    alone = numbered.where("alone").withColumn("position", F.col("before") + F.col("rank"))
    kept = ["piece", "file_path", "file_name", "position"]
    return alone.select(*kept).unionByName(joined.select(*kept)).select(
        F.regexp_replace(F.concat("piece", F.lit("}")), r"^[\s,]+", "").alias("value"),
        "file_path", "file_name", F.col("position").cast("long").alias("position"),
    )
