"""Similarity table, and top-k search over it: exact, or through an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flaskmill.constants import FINGERPRINT_BITS, SIMILARITY_WEIGHTS
from flaskmill.functions.classes import class_groups, class_similarity, normalize_class
from flaskmill.functions.fingerprints import (
    bits_of,
    combine_or,
    feature_set,
    filled,
    overlap,
    packed,
    shingles,
    tanimoto_of_counts,
    transform_xor,
)
from flaskmill.functions.text import split_fragments
from flaskmill.operators.leakage import holdout_keys
from flaskmill.operators.skew import join_spread
from flaskmill.session import balance, stage

SIGNATURE = ("product", "reactants", "rclass")


def with_features(df: DataFrame, product: str = "product", reactants: str = "reactants") -> DataFrame:
    """Adds ``fp`` (product features) and ``tx`` (their XOR with the united reactants)."""
    # United before they are hashed: a shingle that stands in many reactants is hashed once.
    runs = combine_or(F.transform(split_fragments(reactants), lambda f: shingles(f)), ordered=False)
    # A column of its own, as it is mentioned twice below.
    known = df.withColumn("fp", feature_set(product)).withColumn("_united", bits_of(runs))
    return known.withColumn("tx", transform_xor("fp", "_united")).drop("_united")


def build_similarity_table(
    df: DataFrame, holdout: DataFrame, key: str = "product", payload: Sequence[str] | None = None
) -> DataFrame:
    """Rows outside the holdout that have features, with the payload columns and vectors."""
    kept = df.join(holdout_keys([holdout], key), key, "left_anti")
    cols = list(df.columns if payload is None else payload)
    # No features means no text; asked of the text, they are not computed twice.
    return with_features(kept.where(F.length("product") > 0)).select(*cols, "fp", "tx")


def similarity_table_report(df: DataFrame, holdout: DataFrame, key: str = "product") -> DataFrame:
    """How many rows get indexed, are skipped for want of features, or are held out."""
    keys = holdout_keys([holdout], key).withColumn("_out", F.lit(True))
    out = F.coalesce(F.col("_out"), F.lit(False))
    usable = F.length(key) > 0
    return df.join(keys, key, "left").agg(
        F.count_if(~out & F.coalesce(usable, F.lit(False))).alias("indexed"),
        F.count_if(~out & ~F.coalesce(usable, F.lit(False))).alias("skipped"),
        F.count_if(out).alias("excluded"),
    )


def _digest():
    return F.sha2(F.to_json(F.struct(*[_text(c).alias(c) for c in SIGNATURE])), 256)


def _text(name: str):
    return F.coalesce(F.col(name), F.lit(""))


#: Rows of a block on either side of a scan: a task holds one block of each.
BLOCK = 2048
#: Bits of the vectors that one step counts.
SHARED_BITS = 1024
#: Index: sampled pivots, cells every row is filed under, cells a query looks into.
MOST_PIVOTS = 4096
OWN_CELLS = 2
PROBED_CELLS = 12
#: Parts for each wanted partner, between which a floor is sought: more of them, nearer to the n-th score.
PARTS = 4


def _signatures(df: DataFrame, row_id: str) -> DataFrame:
    """Distinct (product, reactants, class) with features, packed for counting.

    ``sig`` is the smallest row id among the copies, a short exact name for the joins below;
    ``digest`` finds the signature of a row.
    """
    distinct = df.groupBy(*[_text(c).alias(c) for c in SIGNATURE]).agg(F.min(row_id).alias("sig"))
    return (
        # Much work a row: a small table must not end up in one task.
        with_features(balance(stage(distinct.where(F.length("product") > 0))))
        .select(
            "sig", _digest().alias("digest"), normalize_class("rclass").alias("cls"),
            F.size("fp").alias("fp_size"), F.size("tx").alias("tx_size"),
            packed("fp").alias("fp"), packed("tx").alias("tx"),
        )
    )


def _side(df: DataFrame, name: str) -> DataFrame:
    plain = [F.col(c).alias(f"{name}_{c}") for c in ("sig", "cls", "fp_size", "tx_size")]
    return df.select(
        *plain, class_groups("cls").alias(f"{name}_groups"), *[filled(v).alias(f"{name}_{v}") for v in ("fp", "tx")]
    )


def _blocks(rows: int) -> int:
    return max(1, -(-rows // BLOCK))


def _once(df: DataFrame, name: str, value) -> DataFrame:
    """Adds a column in a step that no other expression is merged with.

    A filter on a plain column would have it computed twice.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _shared(df: DataFrame, name: str, v: str) -> DataFrame:
    """Adds the number of on-bits that both sides' vectors ``v`` share.

    The words make a long expression: all of them in one step are a generated method of more
    than the 8,000 bytes that the JVM compiles, and then each pair takes a hundred times as long.
    """
    cuts = range(0, FINGERPRINT_BITS, SHARED_BITS)
    for i in cuts:
        df = _once(df, f"{name}_{i}", overlap(f"q_{v}", f"t_{v}", i + SHARED_BITS, i))
    return df.withColumn(name, sum((F.col(f"{name}_{i}") for i in cuts[1:]), F.col(f"{name}_0")))


def _scored(pairs: DataFrame, weights: Sequence[float], floor: str | None = None) -> DataFrame:
    """q, t and score of pairs that carry both sides' vectors; with ``floor`` of those that reach it.

    Sets of sizes a <= b are at most a / b alike: pairs that cannot reach the floor are dropped
    before their vectors are looked at, or after the first of the two.
    """
    w_product, w_transform, w_class = weights
    alike = lambda v: tanimoto_of_counts(f"_{v}_same", f"t_{v}_size", f"q_{v}_size")

    def most(v):
        a, b = F.col(f"q_{v}_size"), F.col(f"t_{v}_size")
        return F.when(F.greatest(a, b) == 0, 0.0).otherwise(F.least(a, b) / F.greatest(a, b))

    def reaching(pairs, product, transform):
        if floor is None:
            return pairs
        return pairs.where(w_product * product + w_transform * transform + w_class * F.col("_kin") >= F.col(floor) - 1e-9)

    kin = class_similarity("t_cls", "q_cls", normal=True, groups=("t_groups", "q_groups"))
    pairs = reaching(_once(pairs, "_kin", kin), most("fp"), most("tx"))
    pairs = reaching(_shared(pairs, "_fp_same", "fp"), alike("fp"), most("tx"))
    pairs = reaching(_shared(pairs, "_tx_same", "tx"), alike("fp"), alike("tx"))
    # Rounded, so that mixes that are equal tie whatever the order of addition.
    score = F.round(w_product * alike("fp") + w_transform * alike("tx") + w_class * F.col("_kin"), 9)
    if floor is not None:
        pairs = pairs.where(score >= F.col(floor))
    return pairs.select(F.col("q_sig").alias("q"), F.col("t_sig").alias("t"), score.alias("score"))


def _scan(q: DataFrame, t: DataFrame, n_q: int, n_t: int, weights: Sequence[float], floor: str | None = None) -> DataFrame:
    """Scores of a set of queries against all rows, block by block.

    Each side is sent once for every block of the other, so a task joins two blocks. Pairs that
    stay below the ``floor`` of their query, or of their row, are dropped before anything is sorted.
    """
    q_blocks, t_blocks = _blocks(n_q), _blocks(n_t)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("q_block", block("q_sig", q_blocks)).withColumn("t_block", every(t_blocks))
    t = t.withColumn("t_block", block("t_sig", t_blocks)).withColumn("q_block", every(q_blocks))
    return _scored(q.join(t, ["q_block", "t_block"]), weights, floor)


def _best(scored: DataFrame, n: int, by: str = "q", of: str = "t") -> DataFrame:
    """The ``n`` best of each; every task keeps ``n`` of its own before anything is moved."""
    order = W.partitionBy(by).orderBy(F.desc("score"), of)
    return scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def _floors(scored: DataFrame, n: int, by: str, of: str) -> DataFrame:
    """A ``floor`` that ``n`` different partners of each reach, found without a sort of the pairs.

    The partners are dealt to a few parts by a hash, and the n-th best of the parts' best scores
    is reached by n of them. Those with no such score are left out.
    """
    part = F.pmod(F.xxhash64(of), F.lit(PARTS * n)).cast("int")
    best = scored.groupBy(by, part.alias("_part")).agg(F.max("score").alias("score"))
    nth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(n - 1))
    return best.groupBy(by).agg(nth.alias("floor")).where(F.col("floor").isNotNull())


def _above(side: DataFrame, floors: DataFrame, sig: str, by: str) -> DataFrame:
    """One side of a scan with each one's ``floor``; 0, which all scores reach, where it has none."""
    known = side.join(floors.select(F.col(by).alias(sig), "floor"), sig, "left")
    return known.withColumn("floor", F.coalesce("floor", F.lit(0.0)))


def _cells(rows: DataFrame, pivots: DataFrame, n_rows: int, n_pivots: int, n: int, weights) -> DataFrame:
    """sig, cell, nth: the ``n`` pivots that each row is most alike, the pivots being the queries."""
    q, t = _side(pivots, "q"), _side(rows, "t")
    floors = _floors(_scan(q, t, n_pivots, n_rows, weights), n, "t", "q")
    near = _scan(q, _above(t, floors, "t_sig", "t"), n_pivots, n_rows, weights, "floor")
    nth = F.row_number().over(W.partitionBy("t").orderBy(F.desc("score"), "q"))
    return near.select(F.col("t").alias("sig"), F.col("q").alias("cell"), nth.alias("nth")).where(F.col("nth") <= n)


def _probed(
    q_sig: DataFrame, t_sig: DataFrame, n_q: int, n_t: int, weights, probes: int, n: int | None = None
) -> DataFrame:
    """q, t, score of the pairs that meet in a cell of the index, or of each query's ``n`` best.

    Pivots are ``4 sqrt(n)`` signatures, the first by a hash of their id, ``MOST_PIVOTS`` at most.
    Every row is filed under its ``OWN_CELLS`` best pivots and every query looks into its
    ``probes`` best ones, so pairs grow with the power 1.5 of the rows and not with their square.
    """
    n_pivots = min(n_t, MOST_PIVOTS, int(4 * n_t**0.5) + 1)
    pivots = stage(t_sig.orderBy(F.xxhash64(F.lit(29), "sig"), "sig").limit(n_pivots))
    within = lambda cells, most: cells.where(F.col("nth") <= most)
    if q_sig is t_sig:
        # The same rows file and ask: they are held against the pivots once.
        both = stage(_cells(t_sig, pivots, n_t, n_pivots, max(OWN_CELLS, probes), weights))
        filed, asked = within(both, OWN_CELLS), within(both, probes)
    else:
        filed = within(_cells(t_sig, pivots, n_t, n_pivots, OWN_CELLS, weights), OWN_CELLS)
        asked = within(stage(_cells(q_sig, pivots, n_q, n_pivots, probes, weights)), probes)
    filed = filed.drop("nth").withColumnRenamed("sig", "t_sig").join(_side(t_sig, "t"), "t_sig")
    asked = balance(asked.withColumnRenamed("sig", "q_sig"))
    sides = _side(q_sig, "q")
    met = lambda cells, sides: cells.drop("nth").join(sides, "q_sig").join(filed, "cell")
    if n is None:
        return _scored(met(asked, sides), weights).distinct()
    # The best cells alone give a floor; few of the pairs of all cells reach it. A pair meets in
    # OWN_CELLS cells at most, and its repeats fall in the same part.
    floors = stage(_floors(_scored(met(within(asked, OWN_CELLS), sides), weights), n, "q", "t"))
    reached = _scored(met(asked, _above(sides, floors, "q_sig", "q")), weights, "floor")
    return _best(_best(reached, OWN_CELLS * n).distinct(), n)


def _listed(
    best: DataFrame, queries: DataFrame, table: DataFrame, q_sig: DataFrame, t_sig: DataFrame, k: int, row_id: str
) -> DataFrame:
    """query, rank, neighbour, score of rows, from the ``k + 1`` best signatures of each signature."""
    # Copies tie on the score and are told apart by id: only k + 1 of them can matter, one
    # more than k because the query itself may be among them.
    first = W.partitionBy("digest").orderBy("neighbour")
    members = (
        table.select(_digest().alias("digest"), F.col(row_id).alias("neighbour"))
        .withColumn("_m", F.row_number().over(first))
        .where(F.col("_m") <= k + 1)
        .join(t_sig.select("digest", F.col("sig").alias("t")), "digest")
        .select("t", "neighbour")
    )
    best = _best(best.join(members, "t"), k + 1, "q", "neighbour")
    # At most k + 1 per signature, so the list fits in a row and each query reads its own.
    near = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "neighbour")))
    listed = (
        best.groupBy(F.col("q").alias("sig"))
        .agg(near.alias("near"))
        .join(q_sig.select("sig", "digest"), "sig")
        .select("digest", "near")
    )
    asked = queries.select(_digest().alias("digest"), F.col(row_id).alias("query"))
    others = F.filter("near", lambda x: x["neighbour"] != F.col("query"))
    return (
        join_spread(asked, listed, "digest", ["query"], "inner")
        .select("query", F.posexplode(F.slice(others, 1, k)).alias("pos", "x"))
        .select(
            "query",
            (F.col("pos") + 1).alias("rank"),
            F.col("x.neighbour").alias("neighbour"),
            (-F.col("x.minus")).alias("score"),
        )
    )


def similar_topk(
    queries: DataFrame,
    table: DataFrame,
    k: int,
    weights: Sequence[float] = SIMILARITY_WEIGHTS,
    row_id: str = "row_id",
    exact: bool = True,
    probes: int = PROBED_CELLS,
) -> DataFrame:
    """The k best table rows per query by the weighted product, transform and class similarity;
    k rows whenever the table has k others with features.

    Both sides need ``row_id`` (unique), ``product``, ``reactants`` and ``rclass``. Copies are
    scored once per distinct signature, and a row is no neighbour of itself.

    An index of sampled pivots gives each query a first list. With ``exact`` its last score is a
    floor: all rows are then scanned in blocks, and a pair is counted out only if its sizes and
    classes keep it below that floor. The scan is linear in the table for a given set of queries.
    Without ``exact`` the first list is the result: rows that meet the query in no cell are
    missed, and the work grows with the power 1.5 of the rows. That is the form for asking
    about every row of a large table.
    """
    # The vectors are read by several joins below and are dear to compute: written once.
    t_sig = balance(stage(_signatures(table, row_id)))
    q_sig = t_sig if queries is table else balance(stage(_signatures(queries, row_id)))
    n_t, n_q = t_sig.count(), q_sig.count()
    if not n_t or not n_q:
        return _listed(
            t_sig.select(F.col("sig").alias("q"), F.col("sig").alias("t"), F.lit(0.0).alias("score")),
            queries.limit(0), table, q_sig, t_sig, k, row_id,
        )
    best = stage(_probed(q_sig, t_sig, n_q, n_t, weights, probes, k + 1))
    if exact:
        # The list may hold the query itself: one more than k signatures are at least k rows.
        enough = F.when(F.count("*") > k, F.min("score")).otherwise(F.lit(0.0)).alias("floor")
        asked = _above(_side(q_sig, "q"), best.groupBy("q").agg(enough), "q_sig", "q")
        best = _best(_scan(asked, _side(t_sig, "t"), n_q, n_t, weights, "floor"), k + 1)
    return _listed(best, queries, table, q_sig, t_sig, k, row_id)
