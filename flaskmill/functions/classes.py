"""Reaction class labels and their similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flaskmill.constants import CLASS_ALIASES, CLASS_GROUPS, CLASS_KEYWORDS
from flaskmill.functions.text import as_column, strip


def normalize_class(c) -> Column:
    """Number alias, else first keyword hit, else the label with underscores; blank is null."""
    label = F.lower(strip(as_column(c).cast("string")))
    words = F.translate(label, "-_", "  ")
    chain = F.when(label == "", F.lit(None).cast("string"))
    for number, name in CLASS_ALIASES.items():
        chain = chain.when(label == number, name)
    for keyword, name in CLASS_KEYWORDS.items():
        chain = chain.when(F.contains(words, F.lit(keyword)), name)
    return chain.otherwise(F.replace(words, F.lit(" "), F.lit("_")))


def class_groups(name) -> Column:
    """The groups that a normalised label belongs to, a bit each; 0 for none and for null."""
    name = as_column(name)
    bits = [F.when(name.isin(*group), 1 << i).otherwise(0) for i, group in enumerate(CLASS_GROUPS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def class_similarity(c, targets, normal: bool = False, groups: tuple | None = None) -> Column:
    """1 for a member of ``targets``, 0.5 for a class of a target's group, else 0.

    ``normal`` says that the label is a normalised one already. With ``groups``, the
    ``class_groups`` of both, ``targets`` is one label: the form for many pairs.
    """
    name, targets = as_column(c) if normal else normalize_class(c), as_column(targets)
    chain = F.when(name.isNull() | targets.isNull(), 0.0)
    if groups is not None:
        shared = as_column(groups[0]).bitwiseAND(as_column(groups[1]))
        return chain.when(name == targets, 1.0).when(shared != 0, 0.5).otherwise(0.0)
    chain = chain.when(F.array_contains(targets, name), 1.0)
    for group in CLASS_GROUPS:
        members = F.array(*[F.lit(g) for g in group])
        chain = chain.when(name.isin(*group) & F.arrays_overlap(targets, members), 0.5)
    return chain.otherwise(0.0)
