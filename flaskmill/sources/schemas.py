"""Declared schemas of the inputs and outputs."""

IDENTIFIERS = "ARRAY<STRUCT<type: STRING, value: STRING>>"

COMPONENT = (
    f"STRUCT<identifiers: {IDENTIFIERS}, smiles: STRING, canonical_smiles: STRING, "
    "name: STRING, reaction_role: STRING>"
)

PRODUCT = (
    f"STRUCT<identifiers: {IDENTIFIERS}, smiles: STRING, canonical_smiles: STRING, "
    "name: STRING, measurements: ARRAY<STRUCT<type: STRING, "
    "percentage: STRUCT<value: DOUBLE>>>>"
)

REACTION_DOCUMENT = (
    "index_in_file BIGINT, reaction_id STRING, "
    f"identifiers {IDENTIFIERS}, "
    f"inputs MAP<STRING, STRUCT<components: ARRAY<{COMPONENT}>>>, "
    "conditions STRUCT<temperature: STRUCT<setpoint: STRUCT<value: DOUBLE, units: STRING>>>, "
    f"outcomes ARRAY<STRUCT<products: ARRAY<{PRODUCT}>>>"
)

FLAT_REACTION = (
    "idx BIGINT, split STRING, rxn_smiles STRING, reactants STRING, product STRING, "
    "id STRING, class STRING"
)

TOPK_RUN = (
    "summary STRUCT<total: BIGINT, num_beams: INT>, "
    "records ARRAY<STRUCT<product_smiles: STRING, reactants_smiles: STRING, "
    "candidates: ARRAY<STRING>>>"
)
