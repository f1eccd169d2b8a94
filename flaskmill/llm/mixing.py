"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Highest quotients ``target / (2 q + 1)`` share the blocks among sources, then a source's blocks
among its shards, so every shard gets an integer quota. The block that quotas are counted in is
one word: with larger ones sources of a few words miss their targets. No quota is above three
times what there is; its blocks go to the next quotient. A shard is one seeded order of
documents. It takes all its words ``quota // words`` times, and of the rest whole runs of
``RUN`` words in a seeded order, the last run in part, so that its words come to the quota.

Both apportionments are sums over tables: the divisor at which rounding ``votes / divisor`` gives
about the right number of seats is narrowed in a few passes for all groups at once, and only the
seats at that edge are ranked. The level of the targets is found by sums as well. Small sources
share tasks, large ones have as many shards as they need.

Null texts have no words, and documents without words are taken 0 times. A null source is a
source of its own, last in order. Repeated rows are documents of their own. Nothing depends on
partitions: reruns agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from flaskmill.llm.texts import shared_rows

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words of a run that a seeded choice takes together.
RUN = 16
#: Words (and documents) that a shard holds about, and that small sources in one task come to.
SHARD = 1 << 19
TOGETHER = 1 << 17
SEED = 17
#: Divisors tried in a pass, and passes: the divisor is known to twelve digits then.
TRIED, PASSES = 255, 5

WORD = r"[^\x20\x09-\x0D]+"


def apportion(entries: DataFrame) -> DataFrame:
    """Adds ``quota``: the seats of each group ``of`` by highest quotients ``votes / (2 q + 1)``.

    ``entries``: of (no nulls), name (unique in its group, decides ties), votes, cap, seats (one
    number in a group). A table that is read several times.
    """

    def rounded(divisor: Column) -> Column:
        return F.floor(F.least(F.col("cap").cast("double"), F.col("votes") / divisor + 0.5))

    n, total, least = F.count("*"), F.sum("votes"), F.min("votes")
    some = F.col("seats") - F.col("n") / 2 - 1
    bounds = (
        entries.where(F.col("votes") > 0)
        .groupBy("of", "seats")
        .agg(n.alias("n"), total.alias("total"), least.alias("least"), F.max("votes").alias("most"))
        .select(
            "of",
            # Rounding gives more seats than there are at the lower divisor, no more at the higher.
            (F.least(F.col("least") / (F.col("least") + 0.5), F.col("total") / (F.col("seats") + F.col("n") / 2)) / 1000).alias("lo"),
            F.least(2 * F.col("most") + 1, F.when(some > 0, F.col("total") / some * 1.001)).alias("hi"),
        )
    )
    between = F.transform(
        F.sequence(F.lit(1), F.lit(TRIED)),
        lambda c: F.col("lo") * F.pow(F.col("hi") / F.col("lo"), c / F.lit(TRIED + 1)),
    )
    for _ in range(PASSES):
        tried = entries.join(bounds, "of").withColumn("d", F.explode(between))
        sums = tried.groupBy("of", "seats", "lo", "hi", "d").agg(F.sum(rounded(F.col("d"))).alias("sum"))
        enough = F.col("sum") <= F.col("seats")
        bounds = sums.groupBy("of").agg(
            F.coalesce(F.max(F.when(~enough, F.col("d"))), F.min("lo")).alias("lo"),
            F.coalesce(F.min(F.when(enough, F.col("d"))), F.max("hi")).alias("hi"),
        )
    fixed = shared_rows(
        entries.join(bounds, "of", "left").withColumns(
            {
                # Groups without votes have no bounds and get nothing.
                "sure": F.when(F.col("hi").isNull(), 0).otherwise(rounded(F.col("hi"))).cast("long"),
                "most": F.when(F.col("lo").isNull(), 0).otherwise(rounded(F.col("lo"))).cast("long"),
            }
        )
    )
    given = fixed.groupBy("of").agg(F.sum("sure").alias("given"))
    best = W.partitionBy("of").orderBy(F.desc("quotient"), "name")
    edge = (
        fixed.where(F.col("most") > F.col("sure"))
        .join(given, "of")
        .select("of", "name", "votes", (F.col("seats") - F.col("given")).alias("left"), F.explode(F.sequence(F.col("sure") + 1, F.col("most"))).alias("seat"))
        .withColumn("quotient", F.col("votes") / (2 * F.col("seat") - 1))
        .withColumn("nth", F.row_number().over(best))
        .where(F.col("nth") <= F.col("left"))
        .groupBy("of", "name")
        .agg(F.count("*").alias("more"))
    )
    return (
        fixed.join(edge, ["of", "name"], "left")
        .withColumn("quota", F.col("sure") + F.coalesce("more", F.lit(0)))
        .drop("lo", "hi", "sure", "most", "more")
    )


def _key(source) -> Column:
    """A source's name, never null."""
    return F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def _weighed(totals: DataFrame, weights) -> DataFrame:
    """Adds weight: sources by code point, null last, take the weights in turn."""
    order = [F.col("source").isNull(), F.col("source")]
    placed = shared_rows(totals.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    nth = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1 + F.col("ahead")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    # A row for each task of the step before.
    placed = placed.join(F.broadcast(parts), "part")
    return placed.withColumn("weight", F.get(turn, (nth % len(weights)).cast("int"))).drop("part", "ahead")


SOURCES = "of string, source_size long, target double, quota long, shards long"


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST, shard: int = SHARD) -> DataFrame:
    """of (the source's key), source_size, target, quota (words), shards; one row a source.

    ``sized`` has source and size. What exceeds a cap is shared again until none is above: the
    level ``rest / free weights`` only rises, so a few sums find it.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rows = shared_rows(_weighed(totals, weights))
    cap = F.col("source_size") * most
    rest, free, capped = 0.0, 1.0, None
    while True:
        over = F.lit(False) if capped is None else F.lit(rest) * F.col("weight") / F.lit(free) > cap
        sums = rows.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)).alias("caps"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free"),
            F.count_if(over).alias("capped"),
        ).first()
        if sums["capped"] == capped:
            break
        rest, free, capped = float(sums["total"] - sums["caps"]), sums["free"] or 1.0, sums["capped"]
    share = F.lit(rest) * F.col("weight") / F.lit(free)
    entries = shared_rows(
        rows.select(
            F.lit("").alias("of"),
            _key("source").alias("name"),
            F.when(share > cap, cap.cast("double")).otherwise(share).alias("votes"),
            cap.alias("cap"),
            F.lit(sums["total"]).alias("seats"),
            "source_size",
            F.ceil((F.col("source_size") + F.col("n_docs")) / shard).alias("shards"),
        )
    )
    return apportion(entries).select(
        F.col("name").alias("of"), "source_size", F.col("votes").alias("target"), "quota",
        F.greatest("shards", F.lit(1)).cast("long").alias("shards"),
    )


def _placed(table: pa.Table, seed: int):
    """Documents of one shard in order: first and end word, times all are taken, and how many of
    the words before each place the seeded runs take."""
    at, tie = table["at"].to_numpy(), table["tie"].to_numpy()
    table = table.take(pa.array(np.lexsort((tie, at))))
    first = lambda name: table[name][0].as_py()
    size = table["size"].to_numpy().astype(np.int64)
    end = size.cumsum()
    words, quota = int(end[-1]), first("shard_quota")
    times, rest = divmod(quota, words) if words else (0, 0)
    runs = -(-words // RUN)
    length = np.full(runs, RUN, np.int64)
    if runs:
        length[-1] = words - (runs - 1) * RUN
    order = np.random.default_rng([seed, zlib.crc32(first("of").encode()), first("shard")]).permutation(runs)
    upto = np.cumsum(length[order])
    taken = np.zeros(runs, np.int64)
    taken[order] = np.clip(rest - (upto - length[order]), 0, length[order])
    return table, end - size, end, times, taken


def _taken(begin, end, times: int, taken: np.ndarray):
    before = np.concatenate(([0], np.cumsum(taken)))
    padded = np.concatenate((taken, [0]))
    until = lambda x: before[x // RUN] + np.minimum(x % RUN, padded[x // RUN])
    return times * (end - begin) + until(end) - until(begin)


def sized(docs: DataFrame) -> DataFrame:
    """Adds size (words of the whole text) and the seeded place of each row in its source."""
    return docs.withColumns(
        {
            "of": _key("source"),
            "size": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"),
            "tie": F.xxhash64(F.coalesce("text", F.lit(""))),
            "at": F.xxhash64(F.lit(SEED), F.col("doc_id")),
        }
    )


def _dealt(rows: DataFrame, narrow: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their shard, its quota, and the task (``bucket``) that works on it: shards of one
    source are tasks of their own, whole sources share tasks of about the same size."""
    place = F.pmod(F.xxhash64(F.lit(SEED + 1), "at", "tie"), F.col("shards"))
    join = lambda df: df.join(sources, "of").withColumn("shard", place)
    entries = shared_rows(
        join(narrow)
        .groupBy("of", "shard", "quota")
        .agg(F.sum("size").alias("words"))
        .select(
            "of",
            F.col("shard").alias("name"),
            F.col("words").cast("double").alias("votes"),
            (F.col("words") * MOST).alias("cap"),
            F.col("quota").alias("seats"),
        )
    )
    shards = apportion(entries).select("of", F.col("name").alias("shard"), F.col("quota").alias("shard_quota"))
    small = sources.where(F.col("shards") == 1)
    total = small.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    together = F.pmod(F.xxhash64(F.lit(SEED), "of"), F.lit(1 + total // TOGETHER))
    bucket = F.when(F.col("shards") > 1, F.xxhash64("of", "shard")).otherwise(together)
    return join(rows).join(shards, ["of", "shard"]).withColumn("bucket", bucket)


def _by_shard(table: pa.Table):
    """The shards of one task, one after another."""
    table = table.combine_chunks()
    if not len(table):
        return
    of, shard = table["of"].combine_chunks().dictionary_encode(), table["shard"].to_numpy()
    unit = of.indices.to_numpy()
    order = np.lexsort((shard, unit))
    edge = np.flatnonzero((np.diff(unit[order]) != 0) | (np.diff(shard[order]) != 0)) + 1
    for rows in np.split(order, edge):
        yield table.take(pa.array(rows))


NARROW = ["doc_id", "of", "size", "tie", "at"]


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target (of the source), taken (words, repeats counted)."""
    narrow = shared_rows(sized(docs.select("doc_id", "text", "source")).select(*NARROW, "source"))
    sources = shared_rows(targets(narrow))
    schema = T._parse_datatype_string("doc_id long, size long, source_size long, target double, taken long")
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        out = []
        for one in _by_shard(table):
            one, begin, end, times, taken = _placed(one, SEED)
            words = pa.array(_taken(begin, end, times, taken))
            out.append(one.select(["doc_id", "size", "source_size", "target"]).append_column("taken", words))
        return pa.concat_tables(out).cast(arrow)

    narrow = narrow.drop("source")
    return _dealt(narrow, narrow, sources).groupBy("bucket").applyInArrow(run, schema)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """Words ``a`` to ``b`` of the text for each span, as they stand, a line each."""
    import re

    at = [m.span() for m in re.finditer(WORD, text)]
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in spans)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken whole
    and one for the words that seeded runs take of it; n_chars counts the row's own text.

    Documents of which nothing is taken are left out. Columns may have any names except those
    with a leading ``_mix_``, which this step adds for a while.
    """
    names = docs.columns
    kept = {n: f"_mix_{i}" for i, n in enumerate(names)}
    narrow = shared_rows(sized(docs.select("doc_id", "text", "source")).select(*NARROW, "source"))
    sources = shared_rows(targets(narrow))
    others = [n for n in names if n not in ("doc_id", "source")]
    renamed = [F.col(f"`{n}`").alias(kept[n]) for n in others]
    wide = sized(docs.select("doc_id", "text", "source", *renamed)).drop("text")
    fields = list(docs.schema.fields)
    arrow = to_arrow_schema(T.StructType(fields))

    def taken_rows(table: pa.Table) -> pa.Table:
        table, begin, end, times, taken = _placed(table, SEED)
        take, texts = [], []
        run = np.flatnonzero(taken)
        low, high = run * RUN, run * RUN + taken[run]
        # Neighbouring runs that are taken whole are one span.
        joined = np.flatnonzero(low[1:] == high[:-1])
        low, high = np.delete(low, joined + 1), np.delete(high, joined)
        for i in np.flatnonzero(end > begin).tolist():
            text = table[kept["text"]][i].as_py()
            take += [i] * times
            texts += [text] * times
            spans = []
            for a, b in zip(low[(k := np.searchsorted(high, begin[i], "right")) :], high[k:], strict=True):
                if a >= end[i]:
                    break
                spans.append((max(a, begin[i]) - begin[i], min(b, end[i]) - begin[i]))
            if spans:
                take.append(i)
                texts.append(_cut(text, spans))
        table = table.take(pa.array(take, pa.int64()))
        columns = {n: table[kept[n] if n in others else n] for n in names}
        columns["text"] = pa.array(texts, pa.string())
        if "n_chars" in names:
            columns["n_chars"] = pa.array([len(t) for t in texts], pa.int64())
        return pa.table(columns).cast(arrow)

    def run(table: pa.Table) -> pa.Table:
        return pa.concat_tables([taken_rows(one) for one in _by_shard(table)])

    dealt = _dealt(wide, narrow.drop("source"), sources)
    return dealt.groupBy("bucket").applyInArrow(run, T.StructType(fields))
