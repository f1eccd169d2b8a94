"""Scalar text, number and presence functions (Column in, Column out)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flaskmill.constants import JSON_MISSING

# Everything str.strip() removes, so that trimming is the same for every script.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(values: dict[str, str]) -> Column:
    """Constant map, handed to Spark in one piece."""
    return F.expr("map(" + ", ".join(_quoted(x) for pair in values.items() for x in pair) + ")")


def literal_array(values) -> Column:
    """Constant array of texts, handed to Spark in one piece."""
    return F.expr("array(" + ", ".join(_quoted(v) for v in values) + ")")


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it.

    Inside array functions Spark does not share repeated expressions, and an expression from
    outside is evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Begins and ends with a visible ASCII sign: nothing to trim.
TRIMMED = r"(?s)\A[!-~](?:.*[!-~])?\z"


def strip(c) -> Column:
    c = as_column(c)
    # The search through the list of signs is the dear part, and seldom needed.
    return F.when(F.rlike(c, F.lit(TRIMMED)), c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def is_present(c, *absent: str) -> Column:
    """Neither null nor the empty text, nor one of the extra ``absent`` markers.

    Zero is present: only the text form is looked at.
    """
    c = as_column(c)
    return c.isNotNull() & ~c.cast("string").isin("", *absent)


def is_present_array(c) -> Column:
    return F.coalesce(F.size(as_column(c)) > 0, F.lit(False))


def first_present(*cols, zero_is_missing: bool = False) -> Column:
    """First column that is present; with ``zero_is_missing`` a 0 counts as absent too."""

    def keep(c):
        ok = is_present(c)
        return F.when(ok & (c != 0) if zero_is_missing else ok, c)

    # Bound, as what is looked for may be found by a search of its own.
    return F.coalesce(*[bind(as_column(c), keep) for c in cols])


def has_any(*cols) -> Column:
    return reduce(lambda a, b: a | b, [is_present(c) for c in cols])


def has_temperature(c="temperature_celsius") -> Column:
    return is_present(c)


def to_number(text) -> Column:
    """Digits, dots and minus signs of a text read as a double, else null.

    Only ASCII digits are kept, so a range such as ``20-30`` is null and ``25 C`` is 25.
    """
    kept = F.regexp_replace(as_column(text).cast("string"), r"[^0-9.\-]", "")
    return kept.try_cast("double")


def split_fragments(c) -> Column:
    """Non-empty dot-separated parts; null gives an empty array."""
    parts = F.filter(F.split(as_column(c), "[.]"), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def as_set(array) -> Column:
    """Sorted distinct array: two of them are equal exactly when the sets are."""
    return F.sort_array(F.array_distinct(array))


def normalize_components(c, canonical=None) -> Column:
    """Set of the comma- or dot-separated components, null when nothing is stated.

    ``canonical`` maps one component to its canonical text or null; what it cannot read is
    kept as lower-cased text.
    """
    c = as_column(c)
    pieces = F.split(F.replace(c.cast("string"), F.lit(","), F.lit(".")), "[.]")
    parts = F.filter(F.transform(pieces, strip), lambda x: x != "")
    name = F.lower if canonical is None else lambda x: F.coalesce(canonical(x), F.lower(x))
    found = bind(as_set(F.transform(parts, name)), lambda s: F.when(F.size(s) > 0, s))
    return F.when(is_present(c, JSON_MISSING), found)


def bucket_index(v, edges) -> Column:
    """Index of the half-open bucket; a value on an edge belongs to the upper one."""
    v = as_column(v)
    steps = [F.when(v >= F.lit(float(e)), 1).otherwise(0) for e in edges]
    return F.when(v.isNotNull(), reduce(lambda a, b: a + b, steps))


def same_bucket(a, b, edges) -> Column:
    return F.coalesce(bucket_index(a, edges) == bucket_index(b, edges), F.lit(False))


def within_tolerance(a, b, tolerance: float) -> Column:
    return F.coalesce(F.abs(as_column(a) - as_column(b)) <= tolerance, F.lit(False))


def parse_reaction(c) -> Column:
    """``left>>right`` as a struct of two fragment arrays; null if a side is missing."""
    sides = F.split(as_column(c), ">>", 2)
    left, right = split_fragments(F.get(sides, F.lit(0))), split_fragments(F.get(sides, F.lit(1)))
    return F.when(
        (F.size(sides) == 2) & (F.size(left) > 0) & (F.size(right) > 0),
        F.struct(left.alias("reactants"), right.alias("products")),
    )


def atom_map_ids(c) -> Column:
    return F.regexp_extract_all(as_column(c), F.lit(r":(\d+)\]"), F.lit(1))


def strip_atom_maps(c) -> Column:
    return F.regexp_replace(as_column(c), r":\d+\]", "]")


def text_digest(c) -> Column:
    """256-bit digest of a text, to join and group by in its place; null stays null."""
    return F.unhex(F.sha2(as_column(c).cast("string"), 256))
