"""Lexical attributes of structure text.

These read the text only: no valence, aromaticity or ring perception. The canonical form is
the normalised text unless a ``raw -> canonical`` table is supplied (operators.fragments).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flaskmill.constants import ABBREVIATIONS, FORMULA_ALIASES
from flaskmill.functions.text import (
    as_column,
    as_set,
    bind,
    literal_map,
    split_fragments,
    strip,
    strip_atom_maps,
)

BRACKET_ATOM = r"\[[0-9]*(?:[A-Z][a-z]?|[bcnops]|se|as|\*)[^\[\]]*\]"
ATOM = BRACKET_ATOM + r"|Br|Cl|[BCNOPSFIbcnops*]"
TOKEN = ATOM + r"|[-=#$:/\\.()~]|%[0-9][0-9]|[0-9]"
#: Tokens, or atoms outside brackets, and nothing else. Possessive: no length of text can make them
#: recurse.
TOKENS = rf"\A(?:{TOKEN})++\z"
PLAIN = r"\A(?:Br|Cl|[BCNOPSFIbcnops*])++\z"
BARE_SYMBOL = r"Br|Cl|[BCNOPSFIbcnops]"
ELEMENT = r"^\[?[0-9]*([A-Z][a-z]?|[bcnops]|se|as)"
CHARGE = r"([+-]+[0-9]*)(?::[0-9]+)?\]"




def normalize_formula(c) -> Column:
    """Trimmed text, known formula names replaced; null when blank."""
    aliases = literal_map(FORMULA_ALIASES)
    return bind(
        strip(c), lambda t: F.when(t != "", F.coalesce(F.try_element_at(aliases, t), t))
    )


def normalize_token(c) -> Column:
    """``normalize_formula`` and then the abbreviations, replaced wherever they occur."""
    return _spelled_out(normalize_formula(c))


def _spelled_out(formula: Column) -> Column:
    return reduce(
        lambda text, item: F.replace(text, F.lit(item[0]), F.lit(item[1])), ABBREVIATIONS.items(), formula
    )


#: What no structure text holds, bracket atoms read as one letter: a part that begins with a ring
#: digit, branch or bond, an empty or atomless branch start, two bonds in a row, a bond that ends a
#: branch or a part.
MISPLACED = (
    r"(?:^|\.)[0-9%()=#$:~-]|\([0-9%().]|\(\)|[-=#$:~]{2}|[-=#$:~](?:\)|\.|$)|\.(?:\.|$)"
)


def is_readable(text) -> Column:
    """Only structure tokens, at least one atom, nested branches, ring digits in pairs, no bond,
    digit or branch out of place."""
    return bind(as_column(text), _readable)


def _readable(text: Column) -> Column:
    # In a text of tokens every letter and star belongs to an atom.
    ok = F.rlike(text, F.lit(TOKENS)) & F.rlike(text, F.lit("[A-Za-z*]"))
    bare = F.when(F.contains(text, F.lit("[")), F.regexp_replace(text, BRACKET_ATOM, "C")).otherwise(text)
    sound = lambda t: ~F.rlike(t, F.lit(MISPLACED)) & _nested(t) & _rings_close(t)
    # A row of plain atoms passes all of it.
    return F.coalesce(F.rlike(text, F.lit(PLAIN)) | (ok & bind(bare, sound)), F.lit(False))


def _nested(text: Column) -> Column:
    """Every branch that is closed was opened before, and all are closed."""
    signs = F.regexp_extract_all(text, F.lit("[()]"), F.lit(0))
    depth = F.aggregate(
        signs,
        F.lit(0),
        lambda d, c: F.when(d < 0, d).when(c == "(", d + 1).otherwise(d - 1),
    )
    return ~(F.contains(text, F.lit("(")) | F.contains(text, F.lit(")"))) | (depth == 0)


def _rings_close(text: Column) -> Column:
    """Every ring number stands an even number of times."""
    rings = F.regexp_extract_all(text, F.lit("%[0-9][0-9]|[0-9]"), F.lit(0))
    even = lambda r, x: F.size(F.filter(r, lambda y: y == x)) % 2 == 0
    # At most 110 different numbers, each counted once.
    return ~F.rlike(text, F.lit("[0-9]")) | bind(rings, lambda r: F.forall(F.array_distinct(r), lambda x: even(r, x)))


def canonical_text(c) -> Column:
    """Normalised text, or null when it cannot be read."""
    read = lambda t: bind(normalize_token(t), lambda n: F.when(_readable(n), n))
    # A row of plain atoms holds no formula name, abbreviation or blank: it is canonical as it stands.
    return bind(as_column(c), lambda t: F.when(F.rlike(t, F.lit(PLAIN)), t).otherwise(read(t)))


def is_valid(c) -> Column:
    return canonical_text(c).isNotNull()


def elements_of(text) -> Column:
    """Element symbol of every atom token, in text order."""
    return bind(as_column(text), _elements)


def _elements(text: Column) -> Column:
    atoms = F.regexp_extract_all(text, F.lit("(" + ATOM + ")"), F.lit(1))
    in_brackets = F.filter(F.transform(atoms, lambda a: F.regexp_extract(a, ELEMENT, 1)), lambda s: s != "")
    # Outside of brackets an atom is its symbol; a star is none.
    bare = F.regexp_extract_all(text, F.lit("(" + BARE_SYMBOL + ")"), F.lit(1))
    return F.transform(F.when(F.contains(text, F.lit("[")), in_brackets).otherwise(bare), _symbol)


def _symbol(s) -> Column:
    small = s.isin(*"bcnops", "se", "as")
    return F.when(small, F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1))).otherwise(s)


def net_charge(text) -> Column:
    """Sum of the bracket charges, written ``+``, ``--`` or ``+2``."""
    text = as_column(text)
    marks = F.regexp_extract_all(text, F.lit(CHARGE), F.lit(1))

    def amount(mark):
        digits = F.regexp_replace(mark, "[+-]", "")
        size = F.coalesce(digits.try_cast("int"), F.length(mark))
        return F.when(F.startswith(mark, F.lit("-")), -size).otherwise(size)

    total = F.aggregate(F.transform(marks, amount), F.lit(0), lambda a, x: a + x)
    return F.when(F.rlike(text, F.lit(CHARGE)), total).when(text.isNotNull(), 0)


def has_carbon(text) -> Column:
    """A carbon atom inside or outside brackets."""
    text = as_column(text)
    # The shorter search also answers for texts without brackets.
    bare = F.when(F.contains(text, F.lit("[")), F.regexp_replace(text, r"\[[^\]]*\]", "")).otherwise(text)
    return F.rlike(bare, F.lit("C(?!l)|c")) | F.rlike(text, F.lit(r"\[[0-9]*[Cc](?![a-z])"))


def heavy_atoms(text) -> Column:
    return F.size(F.filter(elements_of(text), lambda e: e != "H"))


def is_auxiliary(c) -> Column:
    """Readable and either charged or without carbon; unreadable text is never auxiliary."""
    return bind(normalize_formula(c), lambda text: _auxiliary(text, _readable(text)))


def is_auxiliary_named(c, canonical) -> Column:
    """``is_auxiliary`` of a text with its ``canonical_text``: one that is canonical as it stands is
    not read again."""
    known = lambda text: F.coalesce(as_column(canonical) == text, F.lit(False))
    return bind(normalize_formula(c), lambda text: _auxiliary(text, known(text) | _readable(text)))


def _auxiliary(text: Column, readable: Column) -> Column:
    # Without a bracket there is no charge.
    charge = F.when(F.contains(text, F.lit("[")), net_charge(text)).otherwise(0)
    return F.coalesce(readable & ~(has_carbon(text) & (charge == 0)), F.lit(False))


def strip_auxiliary(fragments) -> Column:
    return F.filter(fragments, lambda x: ~is_auxiliary(x))


def canonical_set(fragments, canonical=canonical_text) -> Column:
    """Order-independent set of canonical parts; null as soon as one part is unreadable."""
    return bind(F.transform(fragments, canonical), whole_set)


def whole_set(named: Column) -> Column:
    """Set of the names, null as soon as one of them is."""
    return F.when(~F.exists(named, lambda x: x.isNull()), as_set(named))


def same_set(a, b) -> Column:
    return F.coalesce(a == b, F.lit(False))


def is_exact_match(predicted, reference) -> Column:
    """Both dot-joined texts present and naming the same set."""
    predicted, reference = as_column(predicted), as_column(reference)
    both = (predicted != "") & (reference != "")
    sets = [canonical_set(split_fragments(c)) for c in (predicted, reference)]
    return F.coalesce(both, F.lit(False)) & same_set(*sets)


def is_core_exact_match(predicted, reference) -> Column:
    """``is_exact_match`` after dropping auxiliary fragments on both sides."""
    predicted, reference = as_column(predicted), as_column(reference)
    both = (predicted != "") & (reference != "")
    sets = [canonical_set(strip_auxiliary(split_fragments(c))) for c in (predicted, reference)]
    return F.coalesce(both, F.lit(False)) & same_set(*sets)


def unmapped_fragment(c) -> Column:
    """One fragment without atom-map numbers; null when unreadable."""
    text = strip_atom_maps(normalize_formula(c))
    return bind(text, lambda t: F.when(_readable(t), t))


def unmapped_canonical(c) -> Column:
    """Every dot-separated part unmapped and rejoined; null if any part is unreadable."""
    c = as_column(c)
    parts = F.transform(F.split(c, "[.]"), unmapped_fragment)
    whole = lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.array_join(p, "."))
    return F.when(c != "", bind(parts, whole))
