"""Searches through nested columns, resolved against the declared schema at plan time.

Each search becomes one coalesce over the paths the schema offers, in schema order. The searches
through JSON text need no schema and keep the order of each document.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flaskmill.constants import NUMERIC_KEYS, TEMPERATURE_KEYS
from flaskmill.functions.text import as_column, bind

NUMBER_TEXT = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf|infinity)\s*$"


def _filled(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.coalesce(col != "", F.lit(False))
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.size(col) > 0, F.lit(False))
    return col.isNotNull()


def _first(cols: list[Column]) -> Column | None:
    return F.coalesce(*cols) if cols else None


def _first_in_array(array: Column, visit: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(F.transform(array, visit), lambda x: x.isNotNull()), F.lit(0))


def _children(col: Column, dtype: T.DataType) -> list[tuple[str, Column, T.DataType]]:
    if isinstance(dtype, T.StructType):
        return [(f.name, col[f.name], f.dataType) for f in dtype.fields]
    return []


def _search(col, dtype, keys, leaf) -> Column | None:
    """struct(value) of the first filled key, null when there is none."""
    hits: list[Column] = []
    if isinstance(dtype, T.StructType):
        for name, child, kind in _children(col, dtype):
            if name in keys:
                hits.append(F.when(_filled(child, kind), F.struct(leaf(child, kind).alias("value"))))
        for _, child, kind in _children(col, dtype):
            deeper = _search(child, kind, keys, leaf)
            if deeper is not None:
                hits.append(deeper)
    elif isinstance(dtype, T.MapType):
        kind = dtype.valueType
        if isinstance(dtype.keyType, T.StringType):
            own = F.filter(
                F.map_entries(col),
                lambda e: e["key"].isin(*keys) & _filled(e["value"], kind),
            )
            found = F.get(own, F.lit(0))
            hits.append(
                F.when(found.isNotNull(), F.struct(leaf(found["value"], kind).alias("value")))
            )
        if _search(F.lit(None), kind, keys, leaf) is not None:
            hits.append(
                _first_in_array(F.map_values(col), lambda x: _search(x, kind, keys, leaf))
            )
    elif isinstance(dtype, T.ArrayType):
        kind = dtype.elementType
        if _search(F.lit(None), kind, keys, leaf) is not None:
            hits.append(_first_in_array(col, lambda x: _search(x, kind, keys, leaf)))
    return _first(hits)


def find_first_path(
    col: Column,
    dtype: T.DataType,
    keys: Collection[str],
    leaf: Callable[[Column, T.DataType], Column],
    default: Column | None = None,
) -> Column:
    """``leaf`` of the first filled value stored under one of ``keys``.

    A level's own keys come before anything deeper; empty text and empty arrays are passed
    over. The search stops at the first filled value even if ``leaf`` makes it null.
    """
    found = _search(col, dtype, frozenset(keys), leaf)
    if found is None:
        return default if default is not None else F.lit(None).cast("double")
    return found["value"]


def numeric_value(col: Column, dtype: T.DataType) -> Column:
    """A number, a numeric text, or the first readable number key of a struct or map."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return col.cast("double")
    if isinstance(dtype, T.StringType):
        return F.when(F.rlike(col, F.lit(NUMBER_TEXT)), col.try_cast("double"))
    if isinstance(dtype, T.StructType):
        kinds = {f.name: f.dataType for f in dtype.fields}
        cols = [numeric_value(col[k], kinds[k]) for k in NUMERIC_KEYS if k in kinds]
        if cols:
            return F.coalesce(*cols)
    if isinstance(dtype, T.MapType):
        return F.coalesce(
            *[
                numeric_value(F.try_element_at(col, F.lit(k)), dtype.valueType)
                for k in NUMERIC_KEYS
            ]
        )
    return F.lit(None).cast("double")


def measurement_unit(col: Column, dtype: T.DataType) -> Column:
    """Lower-cased ``units`` or ``unit``, else the first unit of a nested struct."""
    cols: list[Column] = []
    if isinstance(dtype, T.StructType):
        kinds = {f.name: f.dataType for f in dtype.fields}
        for name in ("units", "unit"):
            if isinstance(kinds.get(name), T.StringType):
                cols.append(F.when(col[name] != "", F.lower(col[name])))
        for name, kind in kinds.items():
            if isinstance(kind, (T.StructType, T.MapType)):
                cols.append(measurement_unit(col[name], kind))
    elif isinstance(dtype, T.MapType):
        kind = dtype.valueType
        if isinstance(kind, T.StringType):
            for name in ("units", "unit"):
                value = F.try_element_at(col, F.lit(name))
                cols.append(F.when(value != "", F.lower(value)))
        elif isinstance(kind, (T.StructType, T.MapType)):
            cols.append(_first_in_array(F.map_values(col), lambda x: measurement_unit(x, kind)))
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def to_celsius(value: Column, unit: Column) -> Column:
    """Kelvin and Fahrenheit to Celsius at two decimals, half to even; else unchanged."""
    return (
        F.when(F.contains(unit, F.lit("kelvin")), F.bround(value - 273.15, 2))
        .when(F.contains(unit, F.lit("fahrenheit")), F.bround((value - 32.0) * 5.0 / 9.0, 2))
        .otherwise(value)
    )


def temperature_to_celsius(col: Column, dtype: T.DataType) -> Column:
    return to_celsius(numeric_value(col, dtype), measurement_unit(col, dtype))


def find_temperature(col: Column, dtype: T.DataType) -> Column:
    return find_first_path(col, dtype, TEMPERATURE_KEYS, temperature_to_celsius)


#: Levels that a search through JSON text goes down.
JSON_DEPTH = 8


def _json_items(text: Column) -> Column:
    """key (null in arrays), value (a text's own characters, else JSON) and kind of the members
    of an object or array, as they stand in the document; null for anything else."""

    def members(rows: Column, types: Column, key: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
        kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
        return F.zip_with(
            rows, types, lambda r, v: F.struct(key(r).alias("key"), value(r).alias("value"), kind(v).alias("kind"))
        )

    read = lambda kind: F.from_json(text, kind)
    return F.coalesce(
        members(
            F.map_entries(read("MAP<STRING, STRING>")), F.map_values(read("MAP<STRING, VARIANT>")),
            lambda r: r["key"], lambda r: r["value"],
        ),
        members(read("ARRAY<STRING>"), read("ARRAY<VARIANT>"), lambda r: F.lit(None).cast("string"), lambda r: r),
    )


def find_first_json(text, keys: Collection[str], depth: int = JSON_DEPTH) -> Column:
    """struct(value, kind) of the first filled value under one of ``keys`` in a JSON text, in the
    order of the document; null when there is none.

    A level's own keys come before anything deeper; null, empty text and empty arrays are passed
    over, an empty object is not. ``kind`` is the JSON value's type. Needs no schema; members more
    than ``depth`` levels down are not looked at, and text that is no JSON has none.
    """

    def filled(x: Column) -> Column:
        nothing = (x["kind"] == "STRING") & (x["value"] == "") | (x["kind"] == "ARRAY") & (x["value"] == "[]")
        return (x["kind"] != "VOID") & ~nothing

    def walk(level: Column, left: int) -> Column:
        def look(items: Column) -> Column:
            own = F.get(F.filter(items, lambda x: x["key"].isin(*keys) & filled(x)), F.lit(0))
            own = F.when(own.isNotNull(), F.struct(own["value"].alias("value"), own["kind"].alias("kind")))
            if not left:
                return own
            nested = F.filter(items, lambda x: x["kind"].isin("OBJECT", "ARRAY"))
            return F.coalesce(own, _first_in_array(nested, lambda x: walk(x["value"], left - 1)))

        return bind(_json_items(level), look)

    return walk(as_column(text), depth - 1)


def json_number(hit: Column, depth: int = 4) -> Column:
    """A found JSON value as a number: a number, a numeric text, or the first readable number key
    of an object."""
    value, kind = hit["value"], hit["kind"]
    plain = (
        F.when(kind == "STRING", F.when(F.rlike(value, F.lit(NUMBER_TEXT)), value.try_cast("double")))
        .when(kind == "BOOLEAN", (value == "true").cast("double"))
        .when(~kind.isin("OBJECT", "ARRAY", "VOID"), value.try_cast("double"))
    )
    if not depth:
        return plain
    names = F.array(*[F.lit(k) for k in NUMERIC_KEYS])

    def member(items: Column) -> Column:
        child = lambda k: F.get(F.filter(items, lambda x: x["key"] == k), F.lit(0))
        return _first_in_array(names, lambda k: json_number(child(k), depth - 1))

    return F.coalesce(plain, F.when(kind == "OBJECT", bind(_json_items(value), member)))
