"""The jobs from input files to written pools and scores."""

import json

import pytest

from flaskmill.plans import jobs


def lines(path):
    return [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


@pytest.fixture
def documents(tmp_path):
    for f in range(4):
        folder = tmp_path / "docs" / f"d{f % 2}"
        folder.mkdir(parents=True, exist_ok=True)
        rows = []
        for i in range(60 if f else 200):
            product = "C" * (1 + i % 70) + "O" * f
            rows.append({
                "index_in_file": i,
                "inputs": {"x": {"components": [
                    {"smiles": "CO", "reaction_role": "REACTANT"},
                    {"smiles": "O", "reaction_role": "SOLVENT" if i % 2 else "REACTANT"}]}},
                "outcomes": [{"products": [{"smiles": product, "measurements": []}]}],
            })
        (folder / f"f{f}.json").write_text("\n".join(map(json.dumps, rows)))
    return str(tmp_path / "docs")


def test_targets_and_pools(spark, documents, tmp_path):
    targets, out = tmp_path / "targets", tmp_path / "pools"
    jobs.build_eval_targets(spark, documents, str(targets), count=20, cap=9, seed=1)
    held = lines(targets)
    assert len(held) == 20 and len({r["product_smiles"] for r in held}) == 20
    jobs.build_train_pools(spark, documents, str(targets), str(out), pool_count=80, cap=40, val_count=5,
                           val_frac=0.1, test_frac=0.2)
    parts = {n: lines(out / n) for n in ("reactants_train", "reactants_val", "conditions_train", "conditions_val", "conditions_test")}
    pool = parts["reactants_train"] + parts["reactants_val"]
    products = {r["product_smiles"] for r in pool}
    assert len(pool) == len(products) == 80
    assert not products & {r["product_smiles"] for r in held}
    assert len(parts["reactants_val"]) == 5
    stated = [r for n in parts if n.startswith("conditions") for r in parts[n]]
    assert len(parts["conditions_test"]) == int(len(stated) * 0.2)
    assert all(r["solvent"] == "O" and "catalyst" not in r for r in stated)
    clean = tmp_path / "clean"
    jobs.build_clean_test(spark, str(out / "reactants_train"), [str(out / "reactants_val")], str(clean))
    assert len(lines(clean)) == 75
    jobs.build_roles_pool(spark, str(out / "conditions_train"), str(tmp_path / "roles"))
    split = lines(tmp_path / "roles")
    assert len(split) == len(parts["conditions_train"])
    assert all(r["full_reactants_smiles"] == "CO" and r["reagents"] == "CO" for r in split)
    lookup = tmp_path / "lookup.tsv"
    lookup.write_text("smiles\trole\nCN\treagent\n")
    jobs.build_roles_pool(spark, str(out / "conditions_train"), str(tmp_path / "roles2"), str(lookup))
    assert sorted(map(str, lines(tmp_path / "roles2"))) == sorted(map(str, split))
    jobs.build_mixed_pool(spark, str(out / "conditions_train"), str(out / "conditions_test"), str(tmp_path / "mix"), n_without=7)
    assert len(lines(tmp_path / "mix")) == 7


def test_flat_jobs(spark, tmp_path):
    rows = [(i, "test" if i % 5 == 0 else "train", f"CO.{'C' * (1 + i % 9)}>>{'C' * (1 + i % 30)}") for i in range(100)]
    table = spark.createDataFrame(rows, "idx long, split string, rxn_smiles string")
    jobs.build_flat_targets(table, "flat", str(tmp_path / "t"), count=4, seed=0, splits=["test"])
    held = {r["product_smiles"] for r in lines(tmp_path / "t")}
    assert len(held) == 4
    jobs.build_flat_pool(spark, table, "flat", "train", str(tmp_path / "t"), str(tmp_path / "p"))
    kept = [r["product_smiles"] for r in lines(tmp_path / "p")]
    assert len(kept) == len(set(kept)) and not held & set(kept)


def test_evaluation(spark):
    schema = "record_pos long, product string, reference string, candidates array<string>"
    a = spark.createDataFrame([(0, "p", "CO", ["CO", "CO", "CC"]), (1, "q", "CC", ["C"])], schema)
    b = spark.createDataFrame([(0, "p", "CO", ["x?"]), (1, "q", "CC", ["CC"])], schema)
    summary, records = jobs.score_candidates(a)
    assert summary.head()["exact_match_top1"] == 0.5
    assert records.orderBy("record_pos").head()["candidates"] == ["CO", "CC"]
    summary, records = jobs.ensemble(a, b)
    assert summary.head()["exact_match_top3"] == 1.0
    got = {r["metric"]: r for r in jobs.compare_runs(a, b).collect()}
    assert (got["exact_top1"]["only_a"], got["exact_top1"]["only_b"], got["exact_top1"]["p"]) == (1, 1, 1.0)
    run = spark.createDataFrame([("CO", 20.0, ["CO|25", "CO|25", "?|?"])], "solvent string, temperature_celsius double, candidates_raw array<string>")
    summary, records = jobs.score_conditions(run, "compact", ["temperature_celsius", "solvent"])
    row = summary.head()
    assert row["solvent_exact_match_top1"] == 1.0 and row["temperature_celsius_within_tol_top1"] == 1.0
    assert len(records.head()["parsed"]) == 2


def test_jobs_leave_nothing_staged(spark, documents, tmp_path):
    from pathlib import Path

    from flaskmill import session

    folder = Path(session.staging_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    jobs.build_eval_targets(spark, documents, str(tmp_path / "t"), count=7, cap=9)
    assert len(lines(tmp_path / "t")) == 7 and set(folder.iterdir()) == before


def written(folder, name, products, index):
    folder.mkdir(parents=True, exist_ok=True)
    rows = []
    for i, product in enumerate(products):
        row = {
            "inputs": {"x": {"components": [{"smiles": "CO", "reaction_role": "REACTANT"}]}},
            "outcomes": [{"products": [{"smiles": product, "measurements": []}]}],
        }
        rows.append(row | ({"index_in_file": i} if index else {}))
    (folder / name).write_text("\n".join(map(json.dumps, rows)) + "\n\n")


def test_rows_are_told_apart_by_place(spark, tmp_path):
    """Neither a missing index nor equal file names give more rows than asked for."""
    chains = ["C" * n for n in range(1, 31)]
    written(tmp_path / "a", "f.json", chains, False)
    written(tmp_path / "b" / "x", "f.json", chains, True)
    written(tmp_path / "b" / "y", "f.json", [c + "O" for c in chains], True)
    for name in ("a", "b"):
        jobs.build_eval_targets(spark, str(tmp_path / name), str(tmp_path / f"t{name}"), count=5, cap=5)
        assert len(lines(tmp_path / f"t{name}")) == 5
    rows = jobs.open_reactions(spark, str(tmp_path / "a")).select("row_id", "reaction_id").collect()
    assert len({r["row_id"] for r in rows}) == len({r["reaction_id"] for r in rows}) == 30
    assert {r["reaction_id"] for r in rows} == {f"ord_f_{i}" for i in range(30)}


def test_places_do_not_depend_on_splits(spark, tmp_path):
    written(tmp_path / "d", "f.json", ["C" * (1 + i % 40) for i in range(200)], False)
    pool = tmp_path / "pool"
    pool.mkdir()
    texts = [json.dumps({"product_smiles": "C" * (1 + i % 60), "solvent": "O", "temperature_celsius": 20.0 if i % 9 == 0 else None}) for i in range(300)]
    (pool / "p.json").write_text("\n".join(texts))
    (tmp_path / "held.json").write_text('{"product_smiles": "CC"}')
    places, pools = [], []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            places.append(sorted(r[0] for r in jobs.open_reactions(spark, str(tmp_path / "d")).select("row_id").collect()))
            jobs.build_mixed_pool(spark, str(pool), str(tmp_path / "held.json"), str(tmp_path / f"mix{size}"), n_without=20)
            pools.append(sorted(map(str, lines(tmp_path / f"mix{size}"))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert places[0] == places[1] and len(set(places[0])) == 200
    assert pools[0] == pools[1] and len(pools[0]) == 20 + 34


def test_broken_lines_are_errors(spark, tmp_path):
    from flaskmill.sources import readers

    (tmp_path / "held.json").write_text('{"product_smiles": "A"}\n{"product_smiles": "B"\n{"product_smiles": "C"}')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        readers.read_exclusion_keys(spark, [str(tmp_path / "held.json")], "product_smiles").collect()
    (tmp_path / "d.json").write_text('{"index_in_file": 4}\n{"index_in\n{}')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        readers.read_reaction_documents(spark, str(tmp_path / "d.json")).collect()
    rows = readers.read_reaction_documents(spark, str(tmp_path / "d.json"), mode="PERMISSIVE")
    assert [(r["index_in_file"], r["_corrupt_record"]) for r in rows.orderBy("row_id").collect()] == [
        (4, None), (1, '{"index_in'), (2, None),
    ]


def test_several_run_files_are_refused(spark, tmp_path):
    from flaskmill.sources import readers
    from flaskmill.sources.schemas import TOPK_RUN

    for n in "ab":
        (tmp_path / f"{n}.json").write_text('{"summary": {}, "records": [{"product_smiles": "C"}]}')
    assert readers.read_run(spark, str(tmp_path / "a.json"), TOPK_RUN).count() == 1
    with pytest.raises(ValueError):
        readers.read_run(spark, str(tmp_path), TOPK_RUN)


def test_chunks_keep_records_without_a_product(spark):
    chunk = spark.createDataFrame([(0, "p", 5), (1, None, 5), (2, "", 5), (3, "p", 5)], "record_pos long, product string, num_beams int")
    from flaskmill.operators import leakage

    merged = leakage.merge_chunks([chunk], ["num_beams"])
    assert sorted(r["record_pos"] for r in merged.collect()) == [0, 1, 2]


def test_sampling_shuffles_no_text(spark):
    from flaskmill.operators import sampling

    rows = spark.createDataFrame([(i, f"text {i % 50}", f"s{i % 3}") for i in range(300)], "id long, body string, grp string")
    held = spark.createDataFrame([("text 3",)], "body string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        drawn = sampling.stratified_capped_sample(rows.select("id", "body", "grp"), 20, "grp", "body", "id", 1, holdout=held)
        plan = drawn.select("id")._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x or "Exchange SinglePartition" in x]
        assert exchanges and not any("body" in x for x in exchanges)
        assert "LeftAnti" in plan and "Partial" in plan[plan.index("LeftAnti") :]
        assert plan[plan.index("LeftAnti") :].count("WindowGroupLimit") == 2  # before that join
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


RUN = "record_pos long, product string, reference string, candidates array<string>"


def test_structure_summary_oracle_and_rerank(spark):
    a = spark.createDataFrame([(0, "p", "CO", ["CC", "CO"]), (1, "q", "CC", ["C"]), (2, "r", "CN", ["CN"])], RUN)
    b = spark.createDataFrame([(0, "p", "CO", ["x?"]), (1, "q", "CC", ["CC"]), (2, "r", "CN", ["O"])], RUN)
    scores = {r["score"]: r["value"] for r in jobs.structure_summary(a).collect()}
    assert scores["total"] == 3 and scores["exact_match_top1"] == pytest.approx(1 / 3)
    assert scores["exact_match_top3"] == scores["as_written_exact_match_top3"] == pytest.approx(2 / 3)
    assert scores["list_success_rate"] == 1.0 and "substrates_exact_match_top1" in scores
    exact, core = (t.head() for t in jobs.oracle_ceiling(a, b))
    assert exact["a_top1"] == exact["b_top1"] == pytest.approx(1 / 3) and exact["oracle_top1"] == pytest.approx(2 / 3)
    assert exact["merged_top3"] == core["merged_top3"] == 1.0 and exact["headroom_top3"] == pytest.approx(0)
    flagged = spark.createDataFrame(
        [(0, "p", "CO", ["CC", "CO", "C"], [False, True, True]), (1, "q", "CC", ["C", "CC"], [False, False])],
        RUN + ", flags array<boolean>",
    )
    summary, records = jobs.rerank(flagged, most=2)
    assert records.orderBy("record_pos").head()["candidates"] == ["CO", "CC", "C"]
    assert summary.head()["verified_at_least_one_rate"] == 0.5 and summary.head()["exact_match_top1"] == 0.5


def test_comparing_condition_runs(spark):
    answer = "struct<reagents: string, solvent: string, catalyst: string, temperature_celsius: string>"
    schema = (
        "record_pos long, product_smiles string, reagents string, solvent string, catalyst string, "
        f"temperature_celsius double, parsed array<{answer}>"
    )
    said = lambda solvent, heat: [(None, solvent, None, heat)]
    refs = [(0, "p", None, "CO", None, 20.0), (1, "q", None, "O", None, None), (2, "r", None, "CCO", None, 50.0)]
    a = spark.createDataFrame([(*r, said(s, h)) for r, s, h in zip(refs, ["CO", "O", "C"], ["25", None, "90"])], schema)
    b = spark.createDataFrame([(*r, said(s, h)) for r, s, h in zip(refs, ["C", "O", "C"], ["80", None, "55"])], schema)
    test, rates = jobs.compare_condition_runs(a, b)
    got = {r["metric"]: (r["n"], r["only_a"], r["only_b"]) for r in test.collect()}
    assert got == {"solvent_top5": (3, 1, 0), "temperature_celsius_top5": (2, 1, 1)}
    shown = {(r["field"], r["run"], r["with_temperature"]): (r["n"], r["rate"]) for r in rates.collect()}
    assert shown == {
        ("solvent", "a", True): (2, 0.5), ("solvent", "a", False): (1, 1.0),
        ("solvent", "b", True): (2, 0.0), ("solvent", "b", False): (1, 1.0),
    }


def test_cascade_and_demo_inputs(spark, tmp_path):
    rows = [{"product_smiles": "C" * (i + 1), "full_reactants_smiles": "CO", "reactants_smiles": "CO", "solvent": "O"} for i in range(12)]
    (tmp_path / "test.json").write_text("\n".join(map(json.dumps, rows)))
    run = spark.createDataFrame(
        [(i, ["?", "CO", "CC"] if i % 2 else []) for i in range(12)], "cascade_index long, candidates array<string>"
    )
    out = str(tmp_path / "out")
    jobs.cascade_inputs(spark, str(tmp_path / "test.json"), run, out, limit=5, seed=3)
    first = {r["cascade_index"] for r in spark.read.parquet(out).collect()}
    assert len(first) == 5
    jobs.cascade_inputs(spark, str(tmp_path / "test.json"), run, out, limit=9, seed=3)
    done = spark.read.parquet(out).collect()
    assert len(done) == len({r["cascade_index"] for r in done}) == 9 and first <= {r["cascade_index"] for r in done}
    for r in done:
        good = r["cascade_index"] % 2 == 1
        assert r["full_reactants_smiles"] == ("CO" if good else "") and r["cascade_reference_reactants"] == "CO"
        assert r["cascade_stage1_exact"] is good and r["cascade_candidates_valid"] == (2 if good else 0)
    targets = spark.createDataFrame(
        [(i, "C" * (i + 1), "CO", "O" if i % 3 else None, None, None, None) for i in range(9)],
        "place long, product_smiles string, reactants_smiles string, solvent string, temperature_celsius double, catalyst string, yield_percent double",
    )
    from pyspark.sql import functions as F

    found = spark.createDataFrame([("C" * (i + 1), ["?", "CO"] if i != 4 else ["?"], i) for i in range(9)], "product_smiles string, candidates array<string>, position long")
    demo = jobs.demo_inputs(targets, found, 3, "place", F.length("product_smiles") > 1).orderBy("place").collect()
    assert [r["place"] for r in demo] == [1, 2, 5]
    assert all(r["exact_match_top1"] and r["candidates_valid"] == 1 and r["reactants_smiles"] == "CO" for r in demo)
    with pytest.raises(ValueError):
        jobs.demo_inputs(targets, found, 6, "place", F.lit(True))


def test_summary_of_first_answers_and_slices(spark):
    run = spark.createDataFrame(
        [("CO", 20.0, ["CO|25"]), ("O", None, ["C|?"]), (None, None, ["?|?"])],
        "solvent string, temperature_celsius double, candidates_raw array<string>",
    )
    summary, _ = jobs.score_conditions(run, "compact", ["temperature_celsius", "solvent"])
    row = summary.head().asDict()
    assert row["solvent_top1_exact_match_rate"] == 0.5 and row["solvent_top1_expected_count"] == 2
    assert row["solvent_always_silent"] == pytest.approx(1 / 3)
    assert row["solvent_with_temperature_celsius_top1"] == 1.0 and row["solvent_without_temperature_celsius_top1"] == 0.0
    assert row["solvent_without_temperature_celsius_count"] == 1
