"""Golden cases of set matching, stripping and validity, and the text functions."""

import pytest
from pyspark.sql import functions as F

from flaskmill.functions import molecules as M
from flaskmill.functions import text as T
from flaskmill.operators import fragments, topk


def arr(*values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def given_map(spark):
    return spark.createDataFrame(
        [("OCC", "CCO"), ("not-a-smiles", None)], "raw string, canonical string"
    )


def sets(spark, *texts):
    """(full set, core set) per text, through a dimension with a supplied canonical map."""
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    dim = fragments.build_fragment_dim([(df, ["t"])], given_map(spark))
    rows = fragments.canonicalise_sets(df, "id", ["t"], dim).orderBy("id").collect()
    return [(r["t_set"], r["t_core"]) for r in rows]


def test_set_uses_the_map_and_drops_copies(spark):
    assert sets(spark, "CCO.OCC")[0][0] == ["CCO"]


def test_one_invalid_part_spoils_the_set(spark):
    assert sets(spark, "CCO.not-a-smiles")[0][0] is None


def test_order_does_not_matter(spark):
    a, b = sets(spark, "CCO.CC(=O)O", "CC(=O)O.OCC")
    assert a[0] == b[0] is not None


def test_empty_text_gives_the_empty_set(spark):
    full, core = sets(spark, "")[0]
    assert full == [] and core == []


def test_core_match_when_only_salts_differ(spark):
    a, b = sets(spark, "CCO.[Na+]", "CCO.[Na+].[OH-]")
    assert a[0] != b[0] and a[1] == b[1]


def test_lexical_and_mapped_sets_agree_without_a_map(spark):
    df = spark.createDataFrame(
        [(1, "CCO.[Na+].O"), (2, "NaOH.PhBr"), (3, ""), (4, None), (5, "CCO.?")], "id int, t string"
    )
    dim = fragments.build_fragment_dim([(df, ["t"])])
    mapped = fragments.canonicalise_sets(df, "id", ["t"], dim).select("id", "t_set", "t_core")
    plain = fragments.lexical_sets(df, ["t"]).select("id", "t_set", "t_core")
    assert sorted(mapped.collect()) == sorted(plain.collect())


@pytest.mark.parametrize(
    "parts, kept",
    [
        (["CCO", "[Na+]", "[OH-]", "O", "Cl"], ["CCO"]),
        (["Br[Mg]c1ccccc1", "OB(O)c1cccs1"], ["Br[Mg]c1ccccc1", "OB(O)c1cccs1"]),
        (["CCO", "O=C([O-])[O-]", "[Na+]", "[Na+]"], ["CCO"]),
        (["not-a-smiles"], ["not-a-smiles"]),
    ],
)
def test_strip_auxiliary(one, parts, kept):
    assert one(M.strip_auxiliary(arr(*parts))) == kept


def test_exact_and_core_match(one):
    exact, core = M.is_exact_match("p", "r"), M.is_core_exact_match("p", "r")
    assert one(exact, p="CCO.CC(=O)O", r="CC(=O)O.CCO") is True
    assert one(exact, p="CCO", r="CC(=O)O") is False
    assert one(exact, p="", r="CCO") is False
    assert one(exact, p="CCO", r=F.lit(None).cast("string")) is False
    assert one(exact, p="CCO.[Na+]", r="CCO.[Na+].[OH-]") is False
    assert one(core, p="CCO.[Na+]", r="CCO.[Na+].[OH-]") is True
    assert one(core, p="", r="CCO") is False
    big = "CCN(CC)c1ccc(C(=O)c2ccccc2C(=O)O)c(C)c1.CN(C)c1cccc(N(C)C)c1"
    assert one(core, p=big, r=f"CC(=O)OC(C)=O.{big}.[Na+].[OH-]") is False


def test_success_rate(one):
    assert one(topk.structure_success_rate(arr("CCO", "not-a-smiles", "CC(=O)O.CCO"))) == 2 / 3
    assert one(topk.structure_success_rate(arr("CCO", ""))) == 0.5
    assert one(topk.structure_success_rate(arr())) == 0.0


def test_validity(one):
    assert one(M.is_valid("t"), t="CCO.CC(=O)O") is True
    assert one(M.is_valid("t"), t="not-a-smiles(((") is False
    assert one(M.is_valid("t"), t="") is False
    assert one(M.is_valid("t"), t=F.lit(None).cast("string")) is False


@pytest.mark.parametrize(
    "text", ["C1CC", "C)(C", "()C", "C==C", "c1ccccc", "1C", "C()C", "C(", "C=", "=C", "C(=)C", "C%10C", "C..C", "(C)C", "C(1)C"]
)
def test_misplaced_signs_are_invalid(one, text):
    assert one(M.is_valid("t"), t=text) is False


@pytest.mark.parametrize(
    "text", ["C1CC1", "C%12CC%12", "F/C=C/F", "C(=O)(O)C", "[13CH4]", "C=1CCCCC=1", "CC(C)(C(C)C)C", "[Na+].[Cl-]", "N#N", "*C"]
)
def test_sound_texts_are_valid(one, text):
    assert one(M.is_valid("t"), t=text) is True


def test_split_fragments(one):
    assert one(T.split_fragments("t"), t="CCO.CC(=O)O") == ["CCO", "CC(=O)O"]
    assert one(T.split_fragments("t"), t="") == []
    assert one(T.split_fragments("t"), t=F.lit(None).cast("string")) == []


def test_long_text_is_judged_whole(one):
    assert one(M.is_valid("t"), t="C" * 60_000) is True
    assert one(M.is_valid("t"), t="C" * 60_000 + "t") is False


@pytest.mark.parametrize(
    "text, charge, heavy, carbon",
    [
        ("[Na+]", 1, 1, False),
        ("[Fe+3]", 3, 1, False),
        ("[Fe++]", 2, 1, False),
        ("CC(=O)[O-]", -1, 4, True),
        ("[13CH4]", 0, 1, True),
        ("[CH3:12]", 0, 1, True),
        ("[NH4+:2]", 1, 1, False),
        ("ClBr", 0, 2, False),
        ("[Sc]", 0, 1, False),
        ("[Co]", 0, 1, False),
        ("[H][H]", 0, 0, False),
        ("c1cc[nH]c1", 0, 5, True),
    ],
)
def test_lexical_attributes(one, text, charge, heavy, carbon):
    assert one(M.net_charge("t"), t=text) == charge
    assert one(M.heavy_atoms("t"), t=text) == heavy
    assert one(M.has_carbon("t"), t=text) is carbon


def test_formula_names_and_abbreviations(one):
    assert one(M.normalize_token("t"), t=" Pd(PPh3)4 ").count("c1ccccc1") == 12
    assert one(M.normalize_token("t"), t="PhOMe") == "c1ccccc1OC"
    assert one(M.normalize_token("t"), t="  ") is None


def test_to_number(one):
    read = lambda t: one(T.to_number("t"), t=t)
    assert read("25 C") == 25.0
    assert read("-78") == -78.0
    for text in ("20-30", "", "-", ".", "n/a", "1.2.3"):
        assert read(text) is None


def test_normalize_components(one):
    read = lambda t: one(T.normalize_components("t", M.canonical_text), t=t)
    assert read("CCO, Water.water") == ["CCO", "water"]
    assert read("not specified") is None
    assert read("") is None
    assert read(" , .") is None


def test_bucket_edges_go_up(one):
    read = lambda v: one(T.bucket_index("v", (0.0, 30.0, 80.0, 150.0)), v=v)
    assert [read(v) for v in (-1.0, 0.0, 29.9, 30.0, 150.0, 151.0)] == [0, 1, 1, 2, 4, 4]
    assert one(T.same_bucket("a", "b", (1.0,)), a=0.5, b=F.lit(None).cast("double")) is False


def test_zero_is_present_unless_told(one):
    assert one(T.is_present("v"), v=0.0) is True
    assert one(T.first_present("a", "b"), a=0.0, b=5.0) == 0.0
    assert one(T.first_present("a", "b", zero_is_missing=True), a=0.0, b=5.0) == 5.0


def test_parse_reaction(one):
    got = one(T.parse_reaction("t"), t="A.B>>C.")
    assert got["reactants"] == ["A", "B"] and got["products"] == ["C"]
    for text in ("A.B", ">>C", "A>>", "A>>."):
        assert one(T.parse_reaction("t"), t=text) is None


def test_atom_maps(one):
    assert one(T.atom_map_ids("t"), t="[CH3:1][OH:2]") == ["1", "2"]
    assert one(M.unmapped_canonical("t"), t="[CH3:1]C.[OH-:2]") == "[CH3]C.[OH-]"
    assert one(M.unmapped_canonical("t"), t="[CH3:1]C..C") is None


def test_symbols_with_and_without_brackets(one):
    read = lambda t: one(M.elements_of("t"), t=t)
    assert read("ClCc1cnsc1*Br") == ["Cl", "C", "C", "C", "N", "S", "C", "Br"]
    assert read("[Na+].[nH]1cc[13cH]c1.[*]") == ["Na", "N", "C", "C", "C", "C"]
    assert read("[Pd") == ["P"] and read("") == [] and read(None) is None
    assert [one(topk.catalyst_group(F.col("t")), t=t) for t in ("[Pd]", "Pd", "CPdC", "[Na+]", "Br[Mg]c1ccccc1")] == [
        "metal_Pd", None, None, None, "metal_Mg",
    ]


def test_no_name_or_abbreviation_is_a_row_of_plain_atoms(spark):
    names = spark.createDataFrame([(n,) for n in (*M.FORMULA_ALIASES, *M.ABBREVIATIONS)], "t string")
    assert not names.where(F.rlike("t", F.lit(M.PLAIN))).count()


def test_an_atom_is_read_once(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("t")).select(M.elements_of("t").alias("e"))
    # Only atoms in brackets are looked into, and once.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1
