"""Nested and flat reaction records to normalised rows; projections only, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flaskmill.constants import COMPONENT_SEPARATOR, NON_REACTANT_ROLES
from flaskmill.functions.classes import normalize_class
from flaskmill.functions.molecules import (
    canonical_text,
    heavy_atoms,
    is_readable,
    unmapped_canonical,
    unmapped_fragment,
)
from flaskmill.functions.nested import find_first_path, find_temperature, numeric_value
from flaskmill.functions.text import as_set, first_present, is_present, split_fragments, strip


def _values(col: Column, dtype: T.DataType) -> Column:
    return F.map_values(col) if isinstance(dtype, T.MapType) else col


def _element(dtype: T.DataType) -> T.DataType:
    return dtype.valueType if isinstance(dtype, T.MapType) else dtype.elementType


def _kind(dtype: T.StructType, name: str) -> T.DataType | None:
    return dtype[name].dataType if name in dtype.names else None


def role_matches(role, needles) -> Column:
    """The upper-cased role contains one of the needles; a null role matches nothing."""
    upper = F.upper(role)
    hit = reduce(lambda a, b: a | b, [F.contains(upper, F.lit(n)) for n in needles])
    return F.coalesce(hit, F.lit(False))


def input_components(df: DataFrame, col: str = "inputs") -> tuple[Column, T.StructType]:
    """All components of all inputs, which are stored as a map or as a list."""
    dtype = df.schema[col].dataType
    item = _element(dtype)
    parts = F.transform(
        _values(F.col(col), dtype),
        lambda i: F.coalesce(i["components"], F.array().cast(item["components"].dataType)),
    )
    return F.filter(F.flatten(parts), lambda c: c.isNotNull()), item["components"].dataType.elementType


def outcome_products(df: DataFrame, col: str = "outcomes") -> tuple[Column, T.StructType]:
    item = df.schema[col].dataType.elementType
    parts = F.transform(
        F.col(col),
        lambda o: F.coalesce(o["products"], F.array().cast(item["products"].dataType)),
    )
    return F.filter(F.flatten(parts), lambda p: p.isNotNull()), item["products"].dataType.elementType


def explode_inputs(df: DataFrame, id_col: str, col: str = "inputs") -> DataFrame:
    array, _ = input_components(df, col)
    return df.select(id_col, F.posexplode(array).alias("pos", "component"))


def explode_products(df: DataFrame, id_col: str, col: str = "outcomes") -> DataFrame:
    array, _ = outcome_products(df, col)
    return df.select(id_col, F.posexplode(array).alias("pos", "product"))


def compound_identifier(c: Column, dtype: T.StructType) -> Column:
    """First identifier of a SMILES type that has a value, else the plain columns."""
    found = []
    ids = _kind(dtype, "identifiers")
    if ids is not None:
        match = F.filter(
            _values(c["identifiers"], ids),
            lambda i: F.contains(F.upper(i["type"]), F.lit("SMILES")) & is_present(i["value"]),
        )
        found.append(F.get(match, F.lit(0))["value"])
    found += [c[n] for n in ("smiles", "canonical_smiles") if n in dtype.names]
    return first_present(*found) if found else F.lit(None).cast("string")


def compound_name(c: Column, dtype: T.StructType) -> Column:
    """First identifier that has any value, else the name."""
    found = []
    ids = _kind(dtype, "identifiers")
    if ids is not None:
        match = F.filter(_values(c["identifiers"], ids), lambda i: is_present(i["value"]))
        found.append(F.get(match, F.lit(0))["value"])
    if "name" in dtype.names:
        found.append(c["name"])
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def extract_yield(product: Column, dtype: T.StructType) -> Column:
    """Percentage of the first yield measurement, also when that is null."""
    items = dtype["measurements"].dataType.elementType
    first = F.get(
        F.filter(
            product["measurements"],
            lambda m: F.contains(F.upper(m["type"]), F.lit("YIELD")),
        ),
        F.lit(0),
    )
    nested = find_first_path(first, items, {"percentage"}, numeric_value)
    if "percentage" not in items.names:
        return nested
    direct = numeric_value(first["percentage"], items["percentage"].dataType)
    return F.when(first["percentage"].isNotNull(), direct).otherwise(nested)


CONDITION_PARTS = ("solvents", "temperature_celsius", "catalysts")


def extract_conditions(df: DataFrame) -> Column:
    """struct(solvents, temperature_celsius, catalysts); a solvent role wins over catalyst."""
    return F.struct(*[part.alias(name) for name, part in _condition_parts(df).items()])


def _condition_parts(df: DataFrame) -> dict[str, Column]:
    comps, dtype = input_components(df)
    solvent = lambda c: role_matches(c["reaction_role"], ["SOLVENT"])
    catalyst = lambda c: ~solvent(c) & role_matches(c["reaction_role"], ["CATALYST"])

    def labels(test):
        label = lambda c: first_present(compound_identifier(c, dtype), compound_name(c, dtype))
        named = F.transform(F.filter(comps, test), label)
        kept = as_set(F.filter(named, lambda x: x.isNotNull()))
        return F.coalesce(kept, F.array().cast("array<string>"))

    if "conditions" in df.columns:
        temperature = find_temperature(F.col("conditions"), df.schema["conditions"].dataType)
    else:
        temperature = F.lit(None).cast("double")
    return {"solvents": labels(solvent), "temperature_celsius": temperature, "catalysts": labels(catalyst)}


def record_identifier(df: DataFrame, fallback: Column) -> Column:
    found = [F.col(n).cast("string") for n in ("reaction_id", "id") if n in df.columns]
    if "identifiers" in df.columns:
        ids = _values(F.col("identifiers"), df.schema["identifiers"].dataType)
        found.append(F.get(F.filter(ids, lambda i: is_present(i["value"])), F.lit(0))["value"])
    return first_present(*found, fallback)


def normalize_reaction(
    df: DataFrame,
    dataset: str = "source_dataset",
    index: str = "index_in_file",
    source: str = "ORD",
    id_prefix: str = "ord_",
    canonical=canonical_text,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Nested documents to flat rows; rows without a reactant or a product are dropped.

    The product is the first readable one; reactants are its sorted distinct canonical
    inputs. A yield of 0 counts as missing as long as a later product offers another.
    Columns named in ``keep`` are passed on.
    """
    comps, comp_type = input_components(df)
    products, product_type = outcome_products(df)
    reactants = F.transform(
        F.filter(comps, lambda c: ~role_matches(c["reaction_role"], NON_REACTANT_ROLES)),
        lambda c: canonical(compound_identifier(c, comp_type)),
    )
    made = F.filter(
        F.transform(
            products,
            lambda p: F.struct(
                canonical(compound_identifier(p, product_type)).alias("text"),
                extract_yield(p, product_type).alias("amount"),
            ),
        ),
        lambda p: p["text"].isNotNull(),
    )
    stem = F.regexp_replace(F.col(dataset), r"(?<=.)\.[^.]*$", "")
    fallback = F.concat(F.lit(id_prefix), stem, F.lit("_"), F.col(index).cast("string"))
    amounts = F.transform(F.col("_made"), lambda p: p["amount"])
    reactants_text = F.array_join(as_set(F.filter(F.col("_reactants"), lambda x: x.isNotNull())), ".")
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, COMPONENT_SEPARATOR))
    none = lambda kind: F.lit(None).cast(kind)
    return (
        df.withColumns({"_reactants": reactants, "_made": made})
        .withColumns({"_left": reactants_text, "_right": F.get("_made", F.lit(0))["text"]})
        .where((F.col("_left") != "") & F.col("_right").isNotNull())
        # Columns of their own: Spark would work out a struct again for every use.
        .withColumns({f"_{name}": part for name, part in _condition_parts(df).items()})
        .select(
            record_identifier(df, fallback).alias("reaction_id"),
            F.col(dataset).alias("split"),
            none("string").alias("reaction_class"),
            none("string").alias("reaction_class_normalized"),
            F.col("_left").alias("reactants_smiles"),
            F.col("_left").alias("reactant_smiles"),
            F.col("_right").alias("product_smiles"),
            F.concat("_left", F.lit(">>"), "_right").alias("reaction_smiles"),
            F.struct(*[F.col(f"_{name}").alias(name) for name in CONDITION_PARTS]).alias("conditions"),
            F.lit(source).alias("source"),
            F.col(dataset).alias("source_dataset"),
            joined(F.col("_solvents")).alias("solvent"),
            F.col("_temperature_celsius").alias("temperature_celsius"),
            none("double").alias("pressure_atm"),
            none("double").alias("reaction_time_hours"),
            F.coalesce(
                F.get(F.filter(amounts, lambda y: y != 0), F.lit(0)),
                F.try_element_at(amounts, F.lit(-1)),
            ).alias("yield_percent"),
            joined(F.col("_catalysts")).alias("catalyst"),
            *keep,
        )
    )


def normalize_flat_row(
    df: DataFrame,
    dataset: str,
    split: str = "split",
    index: str = "idx",
    source: str = "USPTO",
    id_prefix: str = "uspto50k_",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Flat rows under any of the accepted column names to the same normalised schema.

    ``dataset`` names the table the rows come from. Reactants keep their order and copies;
    unreadable parts are dropped, and if all are unreadable the raw side is kept. Rows without a
    readable product are dropped.
    """

    def pick(*names):
        found = [F.col(n).cast("string") for n in names if n in df.columns]
        return first_present(*found) if found else F.lit(None).cast("string")

    # One step per project: what the next step reads several times is computed once.
    sides = F.split("_rx", ">>", 2)
    halves = F.contains(F.col("_rx"), F.lit(">>"))
    given = df.withColumns(
        {
            "_rx": pick("reaction_smiles", "reaction", "rxn_smiles"),
            "_given_left": pick("reactants_smiles", "reactants", "source"),
            "_given_right": pick("product_smiles", "product", "target"),
            "_label": pick("class", "reaction_class", "label"),
            "_id": pick("reaction_id", "id"),
        }
    )
    sided = given.withColumns(
        {
            "_left": F.coalesce("_given_left", F.when(halves, F.get(sides, F.lit(0)))),
            "_right": F.coalesce("_given_right", F.when(halves, F.get(sides, F.lit(1)))),
        }
    ).where((F.col("_left") != "") & (F.col("_right") != ""))
    parts = F.filter(
        F.transform(F.split("_left", "[.]"), lambda p: unmapped_fragment(strip(p))),
        lambda p: p.isNotNull(),
    )
    read = sided.withColumns({"_parts": parts, "_product": unmapped_canonical("_right")})
    reactants = F.when(F.size("_parts") > 0, F.array_join("_parts", ".")).otherwise(F.col("_left"))
    fallback = F.concat(F.lit(id_prefix), F.col(split), F.lit("_"), F.col(index).cast("string"))
    none = lambda kind: F.lit(None).cast(kind)
    return (
        read.where(F.col("_product").isNotNull())
        .withColumn("_sided", reactants)
        .select(
            F.coalesce("_id", fallback).alias("reaction_id"),
            F.col(split).alias("split"),
            F.col("_label").alias("reaction_class"),
            normalize_class("_label").alias("reaction_class_normalized"),
            F.col("_sided").alias("reactants_smiles"),
            F.col("_sided").alias("reactant_smiles"),
            F.col("_product").alias("product_smiles"),
            F.coalesce("_rx", F.concat("_sided", F.lit(">>"), "_product")).alias("reaction_smiles"),
            F.struct(
                F.array().cast("array<string>").alias("solvents"),
                none("double").alias("temperature_celsius"),
                F.array().cast("array<string>").alias("catalysts"),
            ).alias("conditions"),
            F.lit(source).alias("source"),
            F.lit(dataset).alias("source_dataset"),
            none("string").alias("solvent"),
            none("double").alias("temperature_celsius"),
            none("double").alias("pressure_atm"),
            none("double").alias("reaction_time_hours"),
            none("double").alias("yield_percent"),
            *keep,
        )
    )


def size_filter(
    product="product_smiles",
    reactants="reactants_smiles",
    catalyst="catalyst",
    max_product: int = 16,
    max_reactants: int = 22,
    max_fragments: int = 3,
    max_catalyst_chars: int = 25,
) -> Column:
    """Size limits on the reference side; unreadable text counts as far too large."""

    def size(c):
        return F.when(is_readable(c), heavy_atoms(c)).otherwise(10**6)

    short = ~is_present(catalyst) | (F.length(catalyst) <= max_catalyst_chars)
    return (
        (size(product) <= max_product)
        & (size(reactants) <= max_reactants)
        & (F.size(split_fragments(reactants)) <= max_fragments)
        & short
    )
