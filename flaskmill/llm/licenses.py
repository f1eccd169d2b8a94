"""Licence scans: canonical texts are looked up by digest among known licences.

A unit is a whole document, one of its lines, or a run of lines that holds a known text of several
lines, however it is wrapped. Units are brought to a canonical form (lower
case, copyright lines left out, equivalent spellings unified, punctuation and white space
folded) and hash-joined, as entire texts, to the digests of known licences in the same form.

Null and empty texts match nothing. A document of one line can match as a text and as a line.
Runs of lines inside a longer known run or text are left out (a text under its title).
Repeated rows give repeated matches; equal ids are not merged.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flaskmill.llm import license_texts
from flaskmill.llm.texts import slices

#: Fixed values: (pattern, replacement) in order.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
SPELLINGS = (
    (r"licenc(e|es|ed|ing)\b", r"licens\1"),
    (r"\bsub ?licens", "sublicens"),
    (r"\bnon ?infringement\b", "noninfringement"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bv(ersion)? ?([0-9])", r"version \2"),
    (r"\b(gpl|lgpl|agpl|mpl)version ", r"\1 version "),
)


def folded(texts: pa.Array) -> pa.Array:
    """Canonical form with line ends kept."""
    out = pc.replace_substring_regex(pc.utf8_lower(texts), COPYRIGHT_LINE, "")
    out = pc.replace_substring_regex(out, PUNCTUATION, " ")
    for pattern, new in SPELLINGS:
        out = pc.replace_substring_regex(out, pattern, new)
    return out


class Runs:
    """Known texts of several lines: finds the runs of whole lines that hold one."""

    def __init__(self, forms: list[str]):
        long = [" ".join(f.split()) for f in forms if sum(bool(x.strip()) for x in f.split("\n")) > 1]
        self.head = min([24, *map(len, long)])
        self.known: dict[str, dict[int, set[bytes]]] = {}
        for form in long:
            sizes = self.known.setdefault(form[: self.head], {})
            sizes.setdefault(len(form), set()).add(hashlib.md5(form.encode()).digest())

    def find(self, lines: list[tuple[int, str]]) -> list[tuple[int, bytes]]:
        """(number of the first line, digest) of each longest run over (number, form) of lines."""
        whole = " ".join(x for _, x in lines)
        begins = list(accumulate((len(x) + 1 for _, x in lines), initial=0))
        hits = [(n, a) for (n, _), a in zip(lines, begins, strict=False) if whole[a : a + self.head] in self.known]
        if not hits:
            return []
        ends, out, covered = {b - 1: k for k, b in enumerate(begins)}, [], 0
        first = dict(zip(begins, range(len(lines)), strict=False))
        for n, a in hits:
            for size, digests in sorted(self.known[whole[a : a + self.head]].items(), reverse=True):
                if a + size <= covered:
                    break
                if a + size not in ends:
                    continue
                digest = hashlib.md5(whole[a : a + size].encode()).digest()
                if digest in digests:
                    covered = a + size
                    # a whole text or a single line is a unit of its own
                    if size < len(whole) and ends[covered] - first[a] > 1:
                        out.append((n, digest))
                    break
        return out


def units(
    docs: DataFrame, sizes: list[int] | None = None, lines: bool = True, runs: Runs | None = None
) -> DataFrame:
    """All columns of ``docs`` but text, line_no (0: the whole text), scope, digest of each unit.

    Equal digests need equal sizes, so units of other sizes than those given are left out.
    """
    names = [c for c in docs.columns if c not in ("text", "line_no", "scope", "digest")]
    schema = T.StructType(
        [docs.schema[c] for c in names]
        + [T.StructField("line_no", T.IntegerType()), T.StructField("scope", T.StringType())]
        + [T.StructField("digest", T.BinaryType())]
    )
    wanted = None if sizes is None else frozenset(sizes)

    def run(batches):
        for batch in batches:
            keep = batch.select(names)
            for row, _, texts in slices(batch.column(batch.schema.get_field_index("text"))):
                at, number, scope, digest = [], [], [], []
                for i, text in enumerate(folded(texts).to_pylist(), row):
                    whole = " ".join(w for w in text.replace("\n", " ").split(" ") if w)
                    found = [(0, whole)]
                    if lines:
                        found += [(n, x.strip(" ")) for n, x in enumerate(text.split("\n"), 1)]
                    for n, form in found:
                        if form and (wanted is None or len(form) in wanted):
                            at.append(i)
                            number.append(n)
                            scope.append("line" if n else "text")
                            digest.append(hashlib.md5(form.encode()).digest())
                    if runs is not None:
                        for n, key in runs.find([x for x in found[1:] if x[1]]):
                            at.append(i)
                            number.append(n)
                            scope.append("lines")
                            digest.append(key)
                part = keep.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(number, pa.int32()), pa.array(scope, pa.string())]
                    + [pa.array(digest, pa.binary())],
                    names=[*names, "line_no", "scope", "digest"],
                )

    return docs.select(*names, "text").mapInArrow(run, schema)


def known_texts(spark) -> DataFrame:
    return spark.createDataFrame(license_texts.known() + license_texts.more(), "license string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, scope ('text', 'line' or 'lines'), line_no (the first, from 1; 0 for a text), license,
    digest.

    ``known`` has license and text: a list some person keeps, which does not grow with the
    documents. Of known texts with the same form the first id counts.
    """
    known = (known if known is not None else known_texts(docs.sparkSession)).select("license", "text")
    rows = known.dropna().toArrow()  # the list itself
    forms = folded(rows["text"].combine_chunks().cast(pa.string()))
    sizes = [len(" ".join(f.split())) for f in forms.to_pylist()]
    runs = Runs(forms.to_pylist())
    digests = units(known, lines=False).groupBy("digest").agg(F.min("license").alias("license"))
    found = units(docs.select("doc_id", "text"), sizes, runs=runs).join(F.broadcast(digests), "digest")
    return found.select(
        "doc_id", "scope", "line_no", "license", F.lower(F.hex("digest")).alias("digest")
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_folded(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_sql_text(COPYRIGHT_LINE)}, '', 'g')"
    out = f"regexp_replace({out}, {_sql_text(PUNCTUATION)}, ' ', 'g')"
    for pattern, new in SPELLINGS:
        out = f"regexp_replace({out}, {_sql_text(pattern)}, {_sql_text(new)}, 'g')"
    return out


def _sql_line(text: str) -> str:
    return f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'))"


def scan_sql() -> str:
    rows = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in license_texts.known())
    return f"""WITH known AS (
  SELECT md5(form) AS digest, min(license) AS license
  FROM (SELECT license, {_sql_line(_sql_folded("text"))} AS form FROM (VALUES {rows}) k(license, text))
  WHERE form <> '' GROUP BY 1),
docs AS (SELECT doc_id, {_sql_folded("coalesce(text, '')")} AS body FROM documents),
parts AS (SELECT doc_id, string_split(body, chr(10)) AS lines FROM docs),
units AS (
  SELECT doc_id, 'text' AS scope, 0 AS line_no, {_sql_line("body")} AS form FROM docs
  UNION ALL
  SELECT doc_id, 'line', i::INT, trim(lines[i]) FROM (
    SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM parts))
SELECT doc_id, scope, line_no, license, digest FROM units JOIN known ON md5(units.form) = known.digest"""
