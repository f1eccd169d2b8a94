"""Nested search and record normalisation."""

import json

import pytest
from pyspark.sql import functions as F

from flaskmill.functions import nested as N
from flaskmill.operators import extract
from flaskmill.sources import readers, writers
from flaskmill.sources.schemas import REACTION_DOCUMENT, TOPK_RUN


def read_json(spark, rows, schema=None):
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def compound(smiles=None, role=None, name=None, kind="SMILES"):
    out = {"reaction_role": role, "name": name}
    if smiles is not None:
        out["identifiers"] = [{"type": "NAME", "value": ""}, {"type": kind, "value": smiles}]
    return out


def document(index, components, products, **more):
    return {
        "index_in_file": index,
        "inputs": {"a": {"components": components[:1]}, "b": {"components": components[1:]}},
        "outcomes": [{"products": products}],
        **more,
    }


def product(smiles, *yields):
    return {
        "smiles": smiles,
        "measurements": [{"type": t, "percentage": {"value": v}} for t, v in yields],
    }


def test_normalize_reaction(spark):
    rows = [
        document(
            0,
            [compound("CCO", "REACTANT"), compound("[Na+]", None), compound("O", "SOLVENT"),
             compound("ClCCl", "solvent_mix_CATALYST"), compound("[Pd]", "CATALYST"), compound("CCO", "REACTANT")],
            [product("??", ("YIELD", 5.0)), product("CC", ("PURITY", 1.0), ("YIELD", 0.0)), product("CCC", ("YIELD", 60.0))],
            reaction_id="given",
            conditions={"temperature": {"setpoint": {"value": 298.15, "units": "KELVIN"}}},
        ),
        document(7, [compound("CO"), compound("name only", None, kind="OTHER")], [product("CC")]),
        document(8, [compound("O", "SOLVENT")], [product("CC")]),
        document(9, [compound("CO")], [product("zz")]),
    ]
    df = read_json(spark, rows, REACTION_DOCUMENT).withColumn("source_dataset", F.lit("set-1.pb.gz"))
    out = {r["reaction_id"]: r for r in extract.normalize_reaction(df).collect()}
    assert set(out) == {"given", "ord_set-1.pb_7"}
    first = out["given"]
    assert first["reactants_smiles"] == "CCO.[Na+]"
    assert first["product_smiles"] == "CC"
    assert first["reaction_smiles"] == "CCO.[Na+]>>CC"
    assert first["solvent"] == "ClCCl, O"
    assert first["catalyst"] == "[Pd]"
    assert first["temperature_celsius"] == 25.0
    assert first["yield_percent"] == 60.0
    second = out["ord_set-1.pb_7"]
    assert second["solvent"] is None and second["yield_percent"] is None
    assert second["conditions"]["solvents"] == []


def test_first_yield_counts_even_when_null(spark):
    rows = [document(0, [compound("CO")], [product("CC", ("YIELD", None), ("YIELD", 9.0))])]
    df = read_json(spark, rows, REACTION_DOCUMENT).withColumn("source_dataset", F.lit("x"))
    assert extract.normalize_reaction(df).head()["yield_percent"] is None


def test_search_prefers_the_level_over_its_depths(spark):
    rows = [
        {"c": {"deep": {"setpoint": {"value": 1.0}}, "temperature": {"amount": "40", "unit": "Fahrenheit"}}},
        {"c": {"deep": {"setpoint": {"value": 2.0}}}},
        {"c": {"list": [{"x": 1}, {"setpoint": {"value": 3.0}}, {"setpoint": {"value": 4.0}}]}},
        {"c": {}},
    ]
    df = read_json(spark, rows)
    dtype = df.schema["c"].dataType
    got = [r["t"] for r in df.select(N.find_temperature(F.col("c"), dtype).alias("t")).collect()]
    assert got == [4.44, 2.0, 3.0, None]


def test_search_stops_at_the_first_filled_value(spark):
    schema = "c struct<temperature: string, deep: struct<setpoint: double>>"
    df = read_json(spark, [{"c": {"temperature": "warm", "deep": {"setpoint": 5.0}}},
                           {"c": {"temperature": "", "deep": {"setpoint": 5.0}}}], schema)
    leaf = N.numeric_value
    keys = {"temperature", "setpoint"}
    got = df.select(N.find_first_path(F.col("c"), df.schema["c"].dataType, keys, leaf).alias("v"))
    assert [r["v"] for r in got.collect()] == [None, 5.0]


def test_search_through_maps(spark):
    schema = "c map<string, struct<setpoint: struct<value: double, units: string>>>"
    df = read_json(spark, [{"c": {"x": {"setpoint": {"value": 300.0, "units": "Kelvin"}}}}], schema)
    got = df.select(N.find_temperature(F.col("c"), df.schema["c"].dataType).alias("t")).head()
    assert got["t"] == 26.85


def test_numeric_text(spark):
    texts = ["1e3", " 2 ", "3d", "x", "", "-.5", "nan"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["v"] for r in df.select(N.numeric_value(F.col("t"), df.schema["t"].dataType).alias("v")).collect()]
    assert got[:6] == [1000.0, 2.0, None, None, None, -0.5]
    assert got[6] != got[6]


def test_flat_rows(spark):
    rows = [
        (0, "train", "[CH3:1]C.bad!>>[OH:2]C", None, None, None, "acyl"),
        (1, "train", None, "CC.CC", "CO", "mine", "3"),
        (2, "test", "CC>>", None, None, None, None),
        (3, "test", "CC>>??", None, None, None, None),
        (4, "test", None, "x?.y?", "CO", None, ""),
    ]
    df = spark.createDataFrame(
        rows, "idx int, split string, rxn_smiles string, reactants string, product string, id string, class string"
    )
    out = {r["reaction_id"]: r for r in extract.normalize_flat_row(df, "flat").collect()}
    assert set(out) == {"uspto50k_train_0", "mine", "uspto50k_test_4"}
    assert out["uspto50k_train_0"]["reactants_smiles"] == "[CH3]C"
    assert out["uspto50k_train_0"]["product_smiles"] == "[OH]C"
    assert out["uspto50k_train_0"]["reaction_class_normalized"] == "acylation"
    assert out["mine"]["reactants_smiles"] == "CC.CC"
    assert out["mine"]["reaction_smiles"] == "CC.CC>>CO"
    assert out["mine"]["reaction_class_normalized"] == "carbon_carbon_coupling"
    assert out["uspto50k_test_4"]["reactants_smiles"] == "x?.y?"


def test_readers_take_arrays_and_lines(spark, tmp_path):
    rows = [{"product_smiles": "A"}, {"product_smiles": ""}, {"product_smiles": "A"}, {"other": 1}]
    (tmp_path / "array.json").write_text("\n" + json.dumps(rows, indent=1))
    (tmp_path / "lines.json").write_text("\n\n".join(json.dumps(r) for r in rows))
    for name in ("array.json", "lines.json"):
        got = readers.read_records(spark, str(tmp_path / name), "product_smiles string, other int")
        assert got.count() == 4
    paths = [str(tmp_path / n) for n in ("array.json", "missing.json", "lines.json")]
    keys = readers.read_exclusion_keys(spark, paths, "product_smiles")
    assert [r[0] for r in keys.collect()] == ["A"]
    none = readers.read_exclusion_keys(spark, [str(tmp_path / "missing.json")], "product_smiles")
    assert none.count() == 0


def test_read_run(spark, tmp_path):
    run = {"summary": {"total": 2, "num_beams": 5},
           "records": [{"product_smiles": "P", "reactants_smiles": "R", "candidates": ["a", "b"]},
                       {"product_smiles": "Q", "reactants_smiles": "S", "candidates": []}]}
    (tmp_path / "run.json").write_text(json.dumps(run, indent=2))
    got = readers.read_run(spark, str(tmp_path / "run.json"), TOPK_RUN).orderBy("record_pos").collect()
    assert [(r["record_pos"], r["product_smiles"], r["candidates"]) for r in got] == [
        (0, "P", ["a", "b"]), (1, "Q", [])]


def plain_search(data, keys):
    """The first filled value in document order: own keys, then the values one after another."""
    inside = list(data.values()) if isinstance(data, dict) else data if isinstance(data, list) else []
    own = [v for k, v in data.items() if k in keys] if isinstance(data, dict) else []
    hits = [v for v in own if v not in (None, "", [])]
    for v in inside if not hits else []:
        hits += [h for h in [plain_search(v, keys)] if h not in (None, "", [])]
    return hits[0] if hits else None


def test_json_search_keeps_document_order(spark):
    docs = [
        {"z": {"t": 5}, "a": {"t": 6}}, {"a": {"t": 6}, "z": {"t": 5}}, {"z": {"q": {"t": 1}}, "t": 0}, {"t": "", "b": [{"t": []}, {"t": "x"}]},
        {"b": {"u": None}, "u": "[]", "t": {}}, {"u": [], "t": None}, [[{"t": False}], {"t": 2}], {"t": [1, {"u": 2}]}, 7, {}, [], {"t": 1.5, "u": 2},
        {"b": 1, "c": [{"k": {"t": {"value": None, "mean": "3e2"}}}]}, {"u": {"value": {"lower": 4}}}, {"t": "é \"}"},
    ]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, "no json {"), (100, None)]
    df = spark.createDataFrame(rows, "i int, doc string")
    hit = N.find_first_json("doc", {"t", "u"})
    got = {r["i"]: r for r in df.select("i", hit.alias("hit"), N.json_number(hit).alias("n")).collect()}
    for i, d in enumerate(docs):
        want, found = plain_search(d, {"t", "u"}), got[i]["hit"]
        if want is None:
            assert found is None, d
        elif isinstance(want, str):
            assert (found["value"], found["kind"]) == (want, "STRING")
        else:
            assert json.loads(found["value"]) == want, d
    assert [got[i]["n"] for i in (0, 1, 2, 3, 6, 11, 12, 13)] == [5.0, 6.0, 0.0, None, 0.0, 1.5, 300.0, 4.0]
    assert got[99]["hit"] is None and got[100]["hit"] is None


AWKWARD = [
    {"product_smiles": 'a "quoted" }{][ \\" }', "other": 1}, {}, {"product_smiles": "\\\\", "other": 2},
    {"product_smiles": "}", "deep": {"list": [{"records": [{"product_smiles": "no"}]}, "]"]}},
    {"product_smiles": "né\n\t\\", "other": None}, {"product_smiles": ",{", "other": 5}, {"product_smiles": "\"records\": [{"},
]


@pytest.mark.parametrize("indent", [None, 1])
def test_large_arrays_and_runs_are_read_by_several_tasks(spark, tmp_path, indent):
    """Texts full of brackets, nested lists, lists of the same name; splits of 700 bytes."""
    from flaskmill.sources import json_split

    rows = [r | {"n": i} for i, r in enumerate(AWKWARD * 40)]
    run = {"summary": {"records": [{"n": -1}], "x": "\"records\": ["}, "first": "{", "records": rows, "after": [{"n": -2}], "z": 1}
    (tmp_path / "rows.json").write_text(json.dumps(rows, indent=indent))
    (tmp_path / "run.json").write_text(json.dumps(run, indent=indent, ensure_ascii=False) + "\n" * (indent or 0))
    schema = "product_smiles string, other int, n long"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pieces = json_split._pieces(spark, str(tmp_path / "rows.json"))
        assert pieces.select("file_block_start").distinct().count() > 5
        want = [(r.get("product_smiles"), r.get("other"), r["n"]) for r in rows]
        got = readers.read_records(spark, str(tmp_path / "rows.json"), schema, form="array")
        assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == want
        found = readers.read_run(spark, str(tmp_path / "run.json"), f"records array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
        assert sorted(map(tuple, found.collect())) == [(i, *w) for i, w in enumerate(want)]
        inferred = readers.read_run(spark, str(tmp_path / "run.json")).orderBy("record_pos").collect()
        assert [(r["record_pos"], r["n"]) for r in inferred] == [(i, i) for i in range(len(rows))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pieces_are_written_once_and_whole_ones_stay(spark, tmp_path, monkeypatch):
    """Batches of three pieces in splits of 700 bytes: only records of several pieces move."""
    from flaskmill.sources import json_split

    rows = [r | {"n": i} for i, r in enumerate(AWKWARD * 12)]
    (tmp_path / "rows.json").write_text(json.dumps(rows))
    (tmp_path / "run.json").write_text(json.dumps({"first": [{"n": -1}], "records": rows, "after": [{"n": -2}]}, indent=1))
    (tmp_path / "flat.json").write_text(json.dumps([{"n": i} for i in range(300)]))
    staged, keep = [], json_split.stage
    monkeypatch.setattr(json_split, "stage", lambda df: staged.append(df.columns) or keep(df))
    conf = {
        "spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "3",
    }
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for name, field, many in (("rows", None, True), ("run", "records", True), ("flat", None, False)):
            staged.clear()
            found = json_split.json_records(spark, str(tmp_path / f"{name}.json"), field)
            assert sum("piece" in columns for columns in staged) == 1
            got = sorted((r["position"], json.loads(r["value"])) for r in found.collect())
            assert got == list(enumerate(rows if many else [{"n": i} for i in range(300)]))
            pieces = json_split._summed(json_split._pieces(spark, str(tmp_path / f"{name}.json"))).collect()
            for split in {r["file_block_start"] for r in pieces}:
                own = sorted((r for r in pieces if r["file_block_start"] == split), key=lambda r: r["at"])
                assert [r["nth"] for r in own] == list(range(len(own)))
                assert [r["s0"] for r in own] == [sum(x["c0"] for x in own[:i]) for i in range(len(own))]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_lists_of_repeated_and_missing_keys(spark, tmp_path):
    from pyspark.sql import functions as F

    from flaskmill.plans import ingest

    rows = [(1, "a", "x}"), (1, "a", "x}"), (None, "a", "y"), (None, "a", None), (3, "a", '"['), (3, "a", "]"), (2, None, "z"), (9, "b", "")]
    folder = tmp_path / "in"
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.repartition(3).write.parquet(str(folder / "documents.parquet"))
    ingest._list_files(ingest.table(spark, str(folder), "documents"), str(tmp_path / "out"), F.lit("["))
    lists = {}
    for file in (tmp_path / "out").glob("bucket=*/*.txt"):
        assert file.parent.name not in lists
        lists[file.parent.name] = [tuple(r.get(k) for k in ("doc_id", "source", "text")) for r in json.loads(file.read_text())]
    assert sorted(lists) == ["bucket=a", "bucket=b", "bucket=none"]
    assert sorted(sum(lists.values(), []), key=str) == sorted(rows, key=str)
    for found in lists.values():
        assert [r[0] for r in found] == sorted((r[0] for r in found), key=lambda k: (k is not None, k))
    back = ingest.json_arrays(spark, str(folder))
    assert sorted((r["doc_id"], r["source"], r["n_chars"]) for r in back.collect() if r["doc_id"]) == sorted(
        ((i, s, len(t)) for i, s, t in rows if i), key=lambda r: (r[0], str(r[1]), r[2])
    )
    numbered = [(r["source"], r["record_pos"]) for r in ingest.read_runs(spark, str(folder)).collect()]
    assert sorted(numbered, key=str) == sorted([*(("a", i) for i in range(6)), ("b", 0), (None, 0)], key=str)


def test_broken_and_empty_arrays(spark, tmp_path):
    read = lambda text, form="array": (
        (tmp_path / "x.json").write_text(text), readers.read_records(spark, str(tmp_path / "x.json"), "a int", form).sort("a").collect()
    )[1]
    assert read(" [ \n ]\n") == []
    assert [r["a"] for r in read('[{"a": 1}, {"a": 2}]')] == [1, 2]
    for broken in ('[{"a": 1},', '[{"a": "x}]', '{"a": 1}', '[{"a": 1}, 7, {"a": 2}]'):
        with pytest.raises(Exception):  # noqa: B017
            read(broken)
    for cut in ('{"records": [{"a": 1}]', '{"other": [{"a": 1}]}'):
        (tmp_path / "y.json").write_text(cut)
        with pytest.raises(ValueError):
            readers.read_run(spark, str(tmp_path / "y.json"), "records array<struct<a:int>>")
    (tmp_path / "y.json").write_text('{"records": [ ], "b": [{"a": 1}]}')
    assert readers.read_run(spark, str(tmp_path / "y.json"), "records array<struct<a:int>>").count() == 0


def test_role_lookup(spark, tmp_path):
    (tmp_path / "roles.tsv").write_text('smiles\trole\tname\nCC"O\treagent\tx\n\nCI\tsubstrate\ty\nB\tother\tz\n')
    got = readers.read_role_lookup(spark, str(tmp_path / "roles.tsv"))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("B", "substrate"), ('CC"O', "reagent"), ("CI", "substrate")]
    assert readers.read_role_lookup(spark, str(tmp_path / "none.tsv")).count() == 0


def test_writers_drop_nulls_only_in_pools(spark, tmp_path):
    df = spark.createDataFrame([("P", None)], "product_smiles string, solvent string")
    writers.write_jsonl(df, str(tmp_path / "pool"))
    writers.write_eval_targets(df, str(tmp_path / "targets"))
    text = lambda d: "".join(p.read_text() for p in (tmp_path / d).glob("part-*")).strip()
    assert json.loads(text("pool")) == {"product_smiles": "P"}
    assert json.loads(text("targets")) == {"product_smiles": "P", "solvent": None}


def test_documents_keep_their_file_name(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.json").write_text(json.dumps({"index_in_file": 3}) + "\n")
    got = readers.read_reaction_documents(spark, str(tmp_path)).head()
    assert (got["source_dataset"], got["index_in_file"]) == ("b.json", 3)


def test_labels_are_searched_once_for_each_list(spark, tmp_path):
    from flaskmill.sources.schemas import REACTION_DOCUMENT

    docs = spark.read.schema(REACTION_DOCUMENT).json(str(tmp_path)).withColumn("source_dataset", F.lit("a.json"))
    spark.conf.set("spark.sql.maxPlanStringLength", 10**7)
    plan = extract.normalize_reaction(docs)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.maxPlanStringLength")
    # Reactants, products, solvents and catalysts; what is found is not searched again to be tested.
    assert 4 <= plan.count("SMILES)") <= 8
