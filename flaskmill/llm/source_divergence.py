"""How far the sources of a language differ in their words, and by which words.

Identical texts of a language are collapsed to one with its number of copies per source. Each is
cut into words once; its counts and document frequencies are added with those numbers. Terms in
at least ``LEAST_DOCS`` documents of the language are kept, and every (lang, source) group gives
each kept term the weight ``p = 1 + floor(10^9 (count + 1) / (N + V))``.

A pair's value is the sum of ``f(p, q) = floor((p - q)^2 / q)`` over all ``V`` kept terms, most of
which occur in neither source. Only what occurs is looked at: with ``p0`` and ``q0`` the weights of
terms that do not occur,

    sum f(p, q) = V f(p0, q0)
                + sum over terms of the one   (f(p, q0) - f(p0, q0))
                + sum over terms of the other (f(p0, q) - f(p0, q0))
                + sum over terms of both      (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))

The first three need each group's counts of equal weights; the last is added up in numpy over
blocks of ``BLOCK`` by ``BLOCK`` sources of a term, so a term that all sources use is many rows
and never pairs of rows. All of it is whole numbers of 64 bits.

Defined results: null text, lang and source count as ''. A group without terms keeps its rows in
``pair``; a language without kept terms has values 0 and no ``term`` rows. Repeated rows are
documents of their own. Columns other than the three are not read. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flaskmill.llm.texts import buffer, shared_rows, slices, span_hashes, spans, text_key

LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Sources of a term that are paired in one row, and pairs held at a time.
BLOCK = 512
PAIRS_AT_ONCE = 1 << 20
#: Bytes of text whose counts are added up before they leave the task.
SLICE = 8 << 20

#: ASCII letters and all bytes of other characters make up terms.
IS_TERM = np.zeros(256, bool)
IS_TERM[[c for c in range(128) if chr(c).isalpha()]] = True
IS_TERM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def collapse(docs: DataFrame) -> DataFrame:
    """lang, text, sources (source and number of copies): one row for each text of a language."""
    rows = docs.select(
        *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    ).withColumn("key", text_key())
    copies = (
        rows.groupBy("lang", "key", "source")
        .agg(F.count("*").alias("n"))
        .groupBy("lang", "key")
        .agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    )
    texts = rows.groupBy("lang", "key").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "key"]).select("lang", "text", "sources")


def _sums(key: np.ndarray, *values: np.ndarray):
    """Distinct keys in order, and the sums of the values of each (whole numbers)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], *(np.add.reduceat(v[order], first) for v in values)


COUNTS = "lang string, source string, term string, n long, docs long"
#: Counted rows that a task adds up before it hands them on.
MERGED = 1 << 20


def _merged(tables):
    """Equal (lang, source, term) of a task as one row, as far as memory is set aside for it."""
    names = ["lang", "source", "term"]
    waiting, rows = [], 0
    for table in tables:
        waiting.append(table)
        rows += len(table)
        if rows > MERGED:
            one = pa.concat_tables(waiting).group_by(names, use_threads=False)
            one = one.aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*names, "n", "docs"])
            waiting, rows = [one], len(one)
            if rows > MERGED // 2:
                yield from one.to_batches(max_chunksize=1 << 16)
                waiting, rows = [], 0
    if waiting:
        one = pa.concat_tables(waiting).group_by(names, use_threads=False)
        one = one.aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*names, "n", "docs"])
        yield from one.to_batches(max_chunksize=1 << 16)


def _count(batches):
    yield from _merged(_counted(batches))


def _counted(batches):
    names = ["lang", "source", "term", "n", "docs"]
    for batch in batches:
        table = pa.Table.from_batches([batch]).combine_chunks()
        langs = table["lang"].combine_chunks().dictionary_encode()
        for row, end, texts in slices(table["text"], SLICE):
            data, starts = buffer(texts)
            data = LOWER[data]
            begin, stop, text = spans(IS_TERM[data], starts)
            if not len(begin):
                continue
            # Term numbers of the slice, then one entry for each text and term.
            _, one, term = np.unique(span_hashes(data, begin, stop), return_index=True, return_inverse=True)
            pair, n = np.unique(text * len(one) + term, return_counts=True)
            text, term = np.divmod(pair, len(one))
            # Copies: an entry for each source that has the text, times its copies there.
            lists = table["sources"].combine_chunks().slice(row, end - row)
            each = np.asarray(lists.value_lengths(), np.int64)
            flat = lists.flatten()
            copies = flat.field("n").to_numpy().astype(np.int64)
            source = flat.field("source").dictionary_encode()
            lang = langs.indices.to_numpy()[row:end].astype(np.int64)
            group = np.repeat(lang, each) * len(source.dictionary) + source.indices.to_numpy()
            first = np.cumsum(each) - each
            reps = each[text]
            at = np.repeat(first[text] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
            key, n, docs = _sums(
                group[at] * len(one) + np.repeat(term, reps), np.repeat(n, reps) * copies[at], copies[at]
            )
            group, term = np.divmod(key, len(one))
            lang, source_at = np.divmod(group, len(source.dictionary))
            size = stop[one] - begin[one]
            offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            place = np.repeat(begin[one] - offsets[:-1], size) + np.arange(offsets[-1])
            words = pa.StringArray.from_buffers(
                len(one), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[place].tobytes())
            )
            columns = [
                langs.dictionary.take(pa.array(lang)),
                source.dictionary.take(pa.array(source_at)),
                words.take(pa.array(term)),
                pa.array(n),
                pa.array(docs),
            ]
            yield pa.table(columns, names=names)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, term, n (in the whole language), sources (source and count): kept terms only."""
    counts = (
        collapse(docs)
        .mapInArrow(_count, COUNTS)
        # Tasks have added up their own counts; a term's rows meet once, for both sums below.
        .repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    return (
        counts.groupBy("lang", "term")
        .agg(
            F.sum("docs").alias("docs"),
            F.sum("n").alias("n"),
            F.collect_list(F.struct("source", "n")).alias("sources"),
        )
        .where(F.col("docs") >= LEAST_DOCS)
        .drop("docs")
    )


def weight(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), in decimals: the product may pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, wide(total + terms)).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


SHARED = "lang string, one int, other int, value long"


def _shared(batches):
    """Sums over terms of both sources of a pair, for each batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).combine_chunks()
        langs = table["lang"].combine_chunks().dictionary_encode()
        lang = langs.indices.to_numpy().astype(np.int64)
        sides = []
        for name in ("left", "right"):
            lists = table[name].combine_chunks()
            flat = lists.flatten()
            length = np.asarray(lists.value_lengths(), np.int64)
            sides.append((length, *(flat.field(f).to_numpy().astype(np.int64) for f in ("gid", "p", "p0"))))
        (n_left, gid, p, p0), (n_right, gid2, q, q0) = sides
        ahead = np.concatenate(([0], np.cumsum(n_left * n_right)))
        left, right = np.cumsum(n_left) - n_left, np.cumsum(n_right) - n_right
        row = 0
        while row < len(lang):
            end = max(row + 1, int(np.searchsorted(ahead, ahead[row] + PAIRS_AT_ONCE, "right")) - 1)
            which = np.repeat(np.arange(row, end), np.diff(ahead[row : end + 1]))
            i, j = np.divmod(np.arange(len(which)) + ahead[row] - ahead[which], n_right[which])
            i, j = i + left[which], j + right[which]
            unlike = gid[i] != gid2[j]
            i, j, which = i[unlike], j[unlike], which[unlike]
            row = end
            if not len(i):
                continue
            value = _gap(p[i], q[j]) - _gap(p[i], q0[j]) - _gap(p0[i], q[j]) + _gap(p0[i], q0[j])
            span = int(max(gid.max(), gid2.max())) + 1
            key, value = _sums((lang[which] * span + gid[i]) * span + gid2[j], value)
            key, other = np.divmod(key, span)
            at, one = np.divmod(key, span)
            columns = [
                langs.dictionary.take(pa.array(at)),
                pa.array(one.astype(np.int32)),
                pa.array(other.astype(np.int32)),
                pa.array(value),
            ]
            yield from pa.table(columns, names=["lang", "one", "other", "value"]).to_batches()


def _blocks(list_name: str, block: str) -> Column:
    return F.slice(list_name, F.col(block) * BLOCK + 1, F.lit(BLOCK))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: see the module."""
    kept = shared_rows(term_counts(docs))
    flat = kept.select("lang", "term", "n", F.explode("sources").alias("s")).select(
        "lang", "term", "n", F.col("s.source").alias("source"), F.col("s.n").alias("count")
    )
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    totals = flat.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    long = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    groups = shared_rows(
        named.join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select("lang", "source", long("total").alias("total"), long("terms").alias("terms"), long("lang_total").alias("lang_total"))
        .withColumns(
            {
                "gid": F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1,
                "p0": F.when(F.col("terms") > 0, weight(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1)))),
            }
        )
    )
    weighed = shared_rows(
        flat.join(groups, ["lang", "source"]).select(
            "lang",
            "term",
            "source",
            "gid",
            "p0",
            weight(F.col("count"), F.col("total"), F.col("terms")).alias("p"),
            weight(F.col("n"), F.col("lang_total"), F.col("terms")).alias("q"),
        )
    )
    return _pair_part(weighed, groups).unionByName(_term_part(weighed))


def _term_part(weighed: DataFrame) -> DataFrame:
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return (
        weighed.where(F.col("p") > F.col("q"))
        .select("lang", "source", "term", gap(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= TOP_TERMS)
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )


def _pair_part(weighed: DataFrame, groups: DataFrame) -> DataFrame:
    lists = weighed.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "p0")).alias("all"))
    numbers = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / BLOCK).cast("int"))
    blocks = (
        lists.where(F.size("all") > 1)
        .withColumn("i", F.explode(numbers))
        .withColumn("j", F.explode(numbers))
        .select("lang", _blocks("all", "i").alias("left"), _blocks("all", "j").alias("right"))
    )
    both = blocks.mapInArrow(_shared, SHARED).groupBy("lang", "one", "other").agg(F.sum("value").alias("both"))
    # How often a group has each weight: as many entries as it has different counts.
    alike = weighed.groupBy("lang", "gid", "p").agg(F.count("*").alias("k"))
    alike = alike.groupBy("lang", "gid").agg(F.collect_list(F.struct("p", "k")).alias("alike"))
    side = groups.join(alike, ["lang", "gid"], "left").select(
        "lang", "source", "gid", "p0", "terms", F.coalesce("alike", F.array().cast("array<struct<p:long,k:long>>")).alias("alike")
    )
    one = side.select("lang", "source", F.col("gid").alias("one"), "p0", "terms", F.col("alike").alias("own"))
    other = side.select(
        "lang", F.col("source").alias("item"), F.col("gid").alias("other"), F.col("p0").alias("q0"), F.col("alike").alias("its")
    )
    zero = F.lit(0).cast("long")
    none = gap(F.col("p0"), F.col("q0"))
    add = lambda value: lambda sum_, x: sum_ + x["k"] * value(x["p"])
    alone = F.aggregate("own", zero, add(lambda p: gap(p, F.col("q0")) - none)) + F.aggregate(
        "its", zero, add(lambda q: gap(F.col("p0"), q) - none)
    )
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # Every ordered pair of a language's sources is a row of the result.
    return (
        one.join(other, "lang")
        .where(F.col("one") != F.col("other"))
        .join(both, ["lang", "one", "other"], "left")
        .withColumn(
            "value",
            F.when(F.col("terms") > 0, F.col("terms") * none + alone + F.coalesce("both", zero)).otherwise(zero),
        )
        .withColumn("rank", F.row_number().over(best))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    )


def audit_sql() -> str:
    """The same in DuckDB: every kept term with every group."""
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(text, '') AS text FROM documents
), words AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text,
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY lang, term
  HAVING count(DISTINCT id) >= {LEAST_DOCS}
), counts AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM words SEMI JOIN kept USING (lang, term)
  GROUP BY lang, source, term
), langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups AS (
  SELECT lang, source, coalesce(t.total, 0) AS total, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals t USING (lang, source) LEFT JOIN langs USING (lang)
), weights AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE} * (coalesce(c.n, 0) + 1)) // CAST(g.total + g.v AS HUGEINT) AS p,
    1 + ({SCALE} * (k.n + 1)) // CAST(l.total + l.v AS HUGEINT) AS lang_p
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM weights a JOIN weights b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), every AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM every
  UNION ALL
  SELECT lang, source, 'term', term, (p - lang_p) * (p - lang_p) // lang_p FROM weights WHERE n > 0 AND p > lang_p
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
