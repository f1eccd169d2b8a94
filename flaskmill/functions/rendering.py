"""Training text: prompts, targets, schema codes, and reading generations back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flaskmill.constants import (
    COMPACT_MISSING,
    COMPACT_SEPARATOR,
    CONDITION_FIELDS,
    EMPTY_SCHEMA,
    JSON_MISSING,
    SCHEMA_CODES,
)
from flaskmill.functions.text import as_column, bind, is_present, strip


def check_fields(fields: Sequence[str]) -> tuple[str, ...]:
    """Known condition fields in their fixed order."""
    unknown = [f for f in fields if f not in CONDITION_FIELDS]
    if unknown or not fields:
        raise ValueError(f"condition fields must be among {CONDITION_FIELDS}, got {fields}")
    return tuple(f for f in CONDITION_FIELDS if f in fields)


def schema_code(always: Sequence[str], columns: dict | None = None) -> Column:
    """Letters of the mandatory fields the row has; ``0`` for none, empty if not in use."""
    if not always:
        return F.lit("")
    letters = F.concat_ws(
        "",
        *[F.when(is_present(_at(columns, f)), SCHEMA_CODES[f]) for f in always],
    )
    return F.when(letters == "", EMPTY_SCHEMA).otherwise(letters)


def full_schema_code(always: Sequence[str]) -> str:
    return "".join(SCHEMA_CODES[f] for f in always) or EMPTY_SCHEMA


def format_input(product, reactants, schema=None) -> Column:
    marker = F.lit("")
    if schema is not None:
        schema = as_column(schema)
        marker = F.when(schema != "", F.concat(F.lit("["), schema, F.lit("] "))).otherwise("")
    return F.concat(
        F.lit("predict conditions: "), marker,
        F.lit("PRODUCT: "), as_column(product), F.lit(" REACTANTS: "), as_column(reactants),
    )


def format_target(
    kind: str,
    fields: Sequence[str] = CONDITION_FIELDS,
    always: Sequence[str] = (),
    columns: dict | None = None,
    numeric: Sequence[str] = ("temperature_celsius", "yield_percent"),
) -> Column:
    """Target text of one row.

    A field of ``always`` that the row lacks is left out instead of being written as missing.
    Numbers are bare in json and quoted text only where missing, so the text is put together
    part by part.
    """
    parts = []
    for field in fields:
        value = _at(columns, field)
        present = is_present(value)
        text = value.cast("string")
        if kind == "compact":
            filled, missing = text, F.lit(COMPACT_MISSING)
        elif kind == "json":
            body = text if field in numeric else _quoted(text)
            label = F.lit(f'"{field}":')
            filled, missing = F.concat(label, body), F.concat(label, F.lit(f'"{JSON_MISSING}"'))
        else:
            raise ValueError(f"unknown target format {kind!r}")
        part = F.when(present, filled)
        parts.append(part if field in always else part.otherwise(missing))
    if kind == "compact":
        return F.array_join(F.array_compact(F.array(*parts)), COMPACT_SEPARATOR)
    body = F.array_join(F.array_compact(F.array(*parts)), ",")
    return F.concat(F.lit("{"), body, F.lit("}"))


def _quoted(text: Column) -> Column:
    """JSON string literal: the value part of a one-field object."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _at(columns, field) -> Column:
    return as_column((columns or {}).get(field, field))


def parse_generation(raw, kind: str, fields: Sequence[str] = CONDITION_FIELDS) -> Column:
    """A generated text as a struct of text fields; null when it cannot be read.

    json is tried as it is and then wrapped in braces, and only an object counts. compact
    needs exactly one value per field; blanks and the missing mark become null.
    """
    raw = as_column(raw)
    if kind == "compact":
        given = lambda value: F.when(~value.isin("", COMPACT_MISSING), value)
        value = lambda parts, i: bind(F.get(parts, F.lit(i)), lambda v: bind(strip(v), given))
        read = lambda parts: F.when(
            F.size(parts) == len(fields), F.struct(*[value(parts, i).alias(f) for i, f in enumerate(fields)])
        )
        return bind(F.split(F.replace(raw, F.lit(" "), F.lit("")), "[|]"), read)
    if kind != "json":
        raise ValueError(f"unknown target format {kind!r}")

    def read(text):
        # As the only element of an array, so that anything after the object is an error.
        listed = F.from_json(
            F.concat(F.lit("["), text, F.lit("]")),
            "array<map<string,string>>",
            {"allowSingleQuotes": "false"},
        )
        alone = F.startswith(F.ltrim(text), F.lit("{")) & (F.size(listed) == 1)
        return F.when(alone, F.get(listed, F.lit(0)))

    found = F.coalesce(read(raw), read(F.concat(F.lit("{"), raw, F.lit("}"))))
    entries = F.map_entries(found)
    # Of a repeated key the last value counts.
    last = lambda f: F.try_element_at(F.filter(entries, lambda e: e["key"] == f), F.lit(-1))
    values = [last(f)["value"].alias(f) for f in fields]
    return F.when(found.isNotNull(), F.struct(*values))
