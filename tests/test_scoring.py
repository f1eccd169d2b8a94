"""Ranked lists, condition fields, significance, rendering and similarity."""

from math import comb

import pytest
from pyspark.sql import functions as F

from flaskmill.constants import TEMPERATURE_EDGES
from flaskmill.functions import classes, fingerprints
from flaskmill.functions import molecules as M
from flaskmill.functions import rendering as R
from flaskmill.operators import audits, combine, dedupe, roles, similarity, stats, topk


def strings(*values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def run_of(spark, *records):
    return spark.createDataFrame(list(records), "reference string, candidates array<string>")


def test_topk_rates(spark):
    run = run_of(
        spark,
        ("CCO", ["CO", "CCO"]),
        ("CCO.[Na+]", ["CCO", "[Na+].CCO"]),
        ("[Na+]", ["", "CO"]),
        ("zz", ["zz"]),
        ("CO", []),
    )
    got = topk.topk_scores(topk.prepare_run(run)).head().asDict()
    assert got["total"] == 5
    assert (got["exact_match_top1"], got["exact_match_top3"]) == (0.0, 0.4)
    # An all-salt reference matches an empty candidate once both are stripped.
    assert (got["core_exact_match_top1"], got["core_exact_match_top3"]) == (0.4, 0.6)
    assert got["top1_valid_rate"] == 0.4


def test_no_records_score_zero(spark):
    got = topk.topk_scores(topk.prepare_run(run_of(spark).limit(0))).head()
    assert got["total"] == 0 and got["exact_match_top5"] == 0.0


def test_cut_offs_beyond_the_beam_are_left_out(spark):
    got = topk.topk_scores(topk.prepare_run(run_of(spark, ("CO", ["CO"]))), num_beams=3)
    assert "exact_match_top3" in got.columns and "exact_match_top5" not in got.columns


def test_interleaving(one):
    a, b, c = strings("a1", "a2", "a3"), strings("b1"), strings("c1", "c2")
    assert one(combine.interleave(a, b)) == ["a1", "b1", "a2", "a3"]
    assert one(combine.interleave(b, a)) == ["b1", "a1", "a2", "a3"]
    assert one(combine.interleave(a, b, c)) == ["a1", "b1", "c1", "a2", "c2", "a3"]
    assert one(combine.ensemble(strings("CO.CC", "x?"), strings("CC.CO", "x?", "CCC"))) == ["CO.CC", "x?", "CCC"]


def test_candidate_deduplication(one):
    c = strings("CO.CC", "bad", "CC.CO", "bad", "CC")
    assert one(dedupe.dedupe_candidates_set(c)) == ["CO.CC", "bad", "CC"]
    assert one(dedupe.dedupe_candidates_valid(c)) == ["CO.CC", "CC"]
    assert one(dedupe.dedupe_candidates_raw(c)) == ["CO.CC", "bad", "CC.CO", "CC"]
    # A two-part set is not the set of one part that holds a dot.
    assert one(dedupe.dedupe_candidates_set(strings("[Na+].[OH-]", "NaOH"))) == ["[Na+].[OH-]", "NaOH"]


def test_rerank(one):
    c = strings("a", "b", "c", "d")
    flags = F.array(F.lit(False), F.lit(True), F.lit(True))
    assert one(combine.rerank_verified(c, flags, 3)) == ["b", "c", "a", "d"]
    assert one(combine.rerank_verified(c, flags, 2)) == ["b", "a", "c", "d"]
    assert one(combine.any_verified(flags, 1)) is False
    assert one(combine.rerank_verified(strings(), flags, 2)) == []


def test_substitution_drops_no_row(spark):
    test = spark.createDataFrame([(0, "CCO"), (1, "CC"), (2, "CO")], "i long, r string")
    run = spark.createDataFrame([(0, ["??", "CCO", "CCO"]), (1, ["x?"])], "i long, candidates array<string>")
    got = {r["cascade_index"]: r for r in combine.substitute_side(test, run, "r", "i").collect()}
    assert [got[i]["r"] for i in range(3)] == ["CCO", "", ""]
    assert [got[i]["cascade_candidates_valid"] for i in range(3)] == [1, 0, 0]
    assert [got[i]["cascade_stage1_exact"] for i in range(3)] == [True, False, False]
    assert got[1]["cascade_reference_reactants"] == "CC"


def test_oracle_never_below_merged(spark):
    df = spark.createDataFrame([(1, None, 1), (None, 3, 4), (None, None, None)], "a int, b int, m int")
    r = combine.oracle_ceiling(df, "a", "b", "m").head()
    assert (r["oracle_top1"], r["oracle_top3"], r["headroom_top3"]) == (1 / 3, 2 / 3, pytest.approx(1 / 3))


@pytest.mark.parametrize("b, c", [(0, 0), (1, 0), (3, 3), (2, 11), (11, 2), (40, 61), (500, 420)])
def test_exact_p(one, b, c):
    n = b + c
    want = min(1.0, 2 * sum(comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    assert one(stats.two_sided_p(F.lit(b), F.lit(c))) == pytest.approx(want, rel=1e-9)


def test_exact_p_of_many_pairs(one):
    tiny = one(stats.two_sided_p(F.lit(624), F.lit(10)))
    assert tiny == pytest.approx(2 * sum(comb(634, i) for i in range(11)) / 2**634, rel=1e-9)
    assert 0.2 < one(stats.two_sided_p(F.lit(5_000_000), F.lit(5_004_000))) < 0.21


def test_mcnemar_leaves_nulls_out(spark):
    df = spark.createDataFrame([(True, False), (True, True), (None, True), (False, True), (True, False)], "a boolean, b boolean")
    r = stats.mcnemar_exact(df, {"m": (F.col("a"), F.col("b"))}).head()
    assert (r["n"], r["only_a"], r["only_b"], r["p"]) == (4, 2, 1, 1.0)


def condition_run(spark, *rows):
    schema = "solvent string, catalyst string, temperature_celsius double, raw array<string>"
    df = spark.createDataFrame(list(rows), schema)
    fields = ("solvent", "catalyst", "temperature_celsius")
    return df.withColumn("parsed", F.transform("raw", lambda c: R.parse_generation(c, "compact", fields)))


def test_condition_scores(spark):
    run = condition_run(
        spark,
        ("CCO, O", None, 25.0, ["CCO|?|90", "O.CCO|?|30"]),
        ("CCO", "[Pd]", None, ["broken", "CO|C[Pd]C|?"]),
        (None, "CCN(CC)CC", 100.0, ["?|?|?", "?|?|109.9"]),
        ("not specified", "", 0.0, ["broken"]),
    )
    numeric = {"temperature_celsius": (10.0, TEMPERATURE_EDGES)}
    got = topk.score_summary(run, ("solvent", "catalyst"), numeric).head().asDict()
    assert got["total"] == 4 and got["parsed_rate_top1"] == 0.5
    assert got["solvent_expected_count"] == 2
    assert (got["solvent_exact_match_top1"], got["solvent_exact_match_top3"]) == (0.0, 0.5)
    # Ethanol and methanol are one family; the second record answers it at rank 2.
    assert (got["solvent_same_group_top1"], got["solvent_same_group_top3"]) == (0.0, 1.0)
    assert got["solvent_absent_share"] == 0.5 and got["solvent_silence_correct"] == 0.5
    assert (got["solvent_record_level_top1"], got["solvent_record_level_top3"]) == (0.25, 0.5)
    assert (got["catalyst_expected_count"], got["catalyst_same_group_classifiable_count"]) == (2, 2)
    assert (got["catalyst_exact_match_top5"], got["catalyst_same_group_top3"]) == (0.0, 0.5)
    assert got["temperature_celsius_expected_count"] == 3
    assert got["temperature_celsius_within_tol_top1"] == 0.0
    assert got["temperature_celsius_within_tol_top3"] == pytest.approx(2 / 3)
    forced = topk.score_summary(run, (), numeric, force_numeric=True).head().asDict()
    assert forced["temperature_celsius_within_tol_top1"] == pytest.approx(1 / 3)


def test_force_numeric_only_looks_at_the_first_candidates(spark):
    run = condition_run(spark, ("", "", 20.0, ["?|?|?"] * 5 + ["?|?|20"]))
    numeric = {"temperature_celsius": (10.0, TEMPERATURE_EDGES)}
    got = topk.score_summary(run, (), numeric, force_numeric=True).head()
    assert got["temperature_celsius_within_tol_top5"] == 0.0


def test_view_keeps_empty_references_in_the_denominator(spark):
    df = spark.createDataFrame([("CCOC", "zz", ["zz"]), ("CCCO", "CCCO.x?", ["CCCO"])], "product string, reference string, candidates array<string>")
    got = topk.topk_by_view(df, "as_written").head()
    assert (got["total"], got["exact_match_top1"]) == (2, 0.5)


def test_class_names(one):
    read = lambda t: one(classes.normalize_class("t"), t=t)
    assert read(" 6 ") == "deprotection"
    assert read("N-Boc Deprotection") == "deprotection"
    assert read("C-C bond formation") == "c_c_bond_formation"
    assert read("") is None
    near = lambda t, *targets: one(classes.class_similarity("t", strings(*targets)), t=t)
    assert near("oxidation", "oxidation") == 1.0
    assert near("oxidation", "reduction", "heck") == 0.5
    assert near("oxidation", "heck") == 0.0
    assert near("oxidation") == 0.0


def test_role_rules(one):
    def role(fragment, product="CCCCO", shared=99, curated=None):
        label = F.lit(curated).cast("string")
        return one(roles.classify_role(M.canonical_text("f"), M.canonical_text("p"), F.lit(shared), label), f=fragment, p=product)

    assert role("??") is False
    assert role("CCO") is False
    assert role("CCO", curated="substrate") is False
    assert role("CCCO", curated="reagent") is False
    assert role("CI", shared=0, curated="substrate") is True
    assert role("N", shared=0) is True
    assert role("CC(=O)O[Pd]OC(C)=O") is False
    assert role("OB(O)c1ccccc1", shared=0) is True
    assert role("[Li]Cl") is False
    assert role("OO") is False
    assert role("C") is False
    assert role("CCCCCC", shared=2) is False
    assert role("CCCCCCCC", shared=3) is False
    assert role("CCCCCO", shared=3) is True
    assert role("CCCCCO", product="??", shared=3) is False


def test_curated_roles_match_plain_ones(spark):
    df = spark.createDataFrame([(1, "CCCCO", "CCO.CCCCO.CCO.??"), (2, "zz", "CCO"), (3, "CCCO", "")], "id long, product_smiles string, reactants_smiles string")
    plain = roles.split_roles(df)
    table = spark.createDataFrame([("nothing", "reagent")], "smiles string, role string")
    labelled = roles.split_roles(df, row_id="id", curated=table).select(*plain.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, labelled.collect()))
    by_id = {r["id"]: r for r in plain.collect()}
    assert set(by_id) == {1, 3}
    assert (by_id[1]["reactants_smiles"], by_id[1]["reagents"]) == ("CCCCO", "CCO")
    assert by_id[1]["full_reactants_smiles"] == "CCO.CCCCO.CCO.??"
    assert (by_id[3]["reactants_smiles"], by_id[3]["reagents"]) == ("", None)
    assert roles.split_roles(df, drop_empty_substrates=True).count() == 1


def test_targets(spark):
    row = spark.createDataFrame([("a", None, "", 25.0, None)], "reagents string, solvent string, catalyst string, temperature_celsius double, yield_percent double")
    got = row.select(
        R.format_target("json").alias("j"),
        R.format_target("compact").alias("c"),
        R.format_target("compact", always=("solvent", "temperature_celsius")).alias("p"),
        R.schema_code(("solvent", "temperature_celsius")).alias("s"),
        R.schema_code(("solvent",)).alias("n"),
        R.schema_code(()).alias("off"),
    ).head()
    assert got["j"] == '{"reagents":"a","solvent":"not specified","catalyst":"not specified","temperature_celsius":25.0,"yield_percent":"not specified"}'
    assert got["c"] == "a|?|?|25.0|?"
    assert got["p"] == "a|?|25.0|?"
    assert (got["s"], got["n"], got["off"]) == ("T", "0", "")
    assert R.full_schema_code(("solvent", "temperature_celsius")) == "ST"
    assert R.full_schema_code(()) == "0"
    assert R.check_fields(["solvent", "reagents"]) == ("reagents", "solvent")
    for bad in ([], ["colour"]):
        with pytest.raises(ValueError):
            R.check_fields(bad)


def test_reading_generations(one):
    fields = ("solvent", "catalyst")
    compact = lambda t: one(R.parse_generation("t", "compact", fields), t=t)
    assert compact("C O | ?").asDict() == {"solvent": "CO", "catalyst": None}
    assert compact("CO") is None and compact("a|b|c") is None
    read = lambda t: one(R.parse_generation("t", "json", fields), t=t)
    assert read('{"solvent":"CO"}')["solvent"] == "CO"
    assert read('"solvent":"CO"')["solvent"] == "CO"
    assert read("")["solvent"] is None
    for text in ("[1]", '{"a":1} x', '{"a":1},{"b":2}', "{bad", "{'solvent':'a'}"):
        assert read(text) is None


def test_missing_characters(spark):
    def missing(known, *texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        vocab = spark.createDataFrame([(c,) for c in known], "ch string")
        found = audits.missing_chars(audits.char_inventory(df, ["t"]), vocab)
        counted = audits.strings_with_unknown(df, ["t"], vocab).head()
        return sorted(r[0] for r in found.collect()), tuple(counted)

    assert missing("CO()=c1", "CCO.CK") == ([".", "K"], (1, 1))
    assert missing("CO", "C.C", "O.O", "CO.OC") == (["."], (3, 3))
    assert missing("CO.", "CCO.OCC", "", "C") == ([], (3, 0))


def test_common_prefix(one):
    shared = lambda a, b: one(audits.common_prefix_length(F.col("a"), F.col("b")), a=a, b=b)
    assert [shared("abc", "abd"), shared("abc", "ab"), shared("", "x"), shared("x", "x"), shared("y", "x")] == [2, 2, 0, 1, 0]


def test_length_profile(spark):
    df = spark.createDataFrame([("x" * n,) for n in range(1, 101)] + [(None,)], "t string")
    r = audits.length_profile(df, "t", [64]).head()
    assert (r["mean"], r["p95"], r["p99"], r["longest"], r["over_64"]) == (50.5, 95, 99, 100, 0.36)


def test_length_buckets_keep_close_lengths_together(spark):
    df = spark.createDataFrame([(i, "x" * (i % 40)) for i in range(400)], "id long, t string")
    laid = audits.length_buckets(df, "t", "id", 4).withColumn("p", F.spark_partition_id())
    spans = laid.groupBy("p").agg(F.min(F.length("t")).alias("lo"), F.max(F.length("t")).alias("hi")).orderBy("lo").collect()
    assert sum(1 for _ in spans) == 4
    assert all(a["hi"] <= b["lo"] for a, b in zip(spans, spans[1:]))


def test_length_buckets_are_cut_by_bytes_too(spark):
    df = spark.createDataFrame([(i, "x" * (1 if i % 20 else 4000 + i % 7)) for i in range(800)] + [(None, None)], "id long, t string")
    laid = audits.length_buckets(df, "t", "id", 4, 20_000).withColumn("p", F.spark_partition_id())
    parts = laid.groupBy("p").agg(
        F.min(F.length("t")).alias("lo"), F.max(F.length("t")).alias("hi"), F.sum(F.length("t")).alias("chars"), F.count("*").alias("n")
    ).orderBy("p").collect()
    assert sum(p["n"] for p in parts) == 801 and sum(p["chars"] for p in parts) == df.agg(F.sum(F.length("t"))).head()[0]
    # Forty texts of 4,000 characters would lie in one partition of four.
    assert len(parts) > 6 and max(p["chars"] for p in parts) <= 60_000
    assert all(a["hi"] <= b["lo"] for a, b in zip(parts, parts[1:]))


def _repeats(df, of: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(of)


def test_first_answers_are_normalised_once_a_record(spark):
    # A pattern of the components stands in the plan once for each time that they are split.
    kind = "record_pos long, solvent string, parsed array<struct<solvent:string>>"
    rows = [(1, "CCO, O", [("O.CCO",)]), (2, "ClCCl", [("CCO",)]), (3, None, [(None,)]), (4, "O", None), (5, "O", [("O",), ("CCO",)])]
    df = spark.createDataFrame(rows, kind)
    answer = F.get("parsed", F.lit(0))["solvent"]
    whole = df.agg(*topk.top1_field_scores("solvent", answer, topk.solvent_group))
    ready = topk.with_first_answer(df, "solvent", answer, topk.solvent_group)
    ready = ready.agg(*topk.top1_field_scores("solvent", answer, topk.solvent_group, ready=True))
    assert whole.collect() == ready.collect()
    summary = topk.score_summary(df, ("solvent",), {}, first_answer=True, slice_by="solvent")
    # reference and answers, each as set and as families, and the families of the first answer
    assert _repeats(ready, "split(") == 4 and _repeats(summary, "split(") == 5
    assert summary.head()["solvent_top1_exact_match_rate"] == whole.head()["solvent_exact_match_rate"]


def test_set_similarity(one):
    ints = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<int>")
    assert one(fingerprints.tanimoto(ints(1, 2, 3), ints(2, 3, 4))) == 0.5
    assert one(fingerprints.tanimoto(ints(), ints())) == 0.0
    assert one(fingerprints.transform_xor(ints(1, 2, 3), ints(2, 9))) == [1, 3, 9]
    assert one(fingerprints.shingles("t"), t="abcde") == ["abc", "bcd", "cde"]
    assert one(fingerprints.shingles("t"), t="ab") == ["ab"]
    assert one(fingerprints.feature_set("t"), t="") is None


def plain_neighbours(vec, queries, k):
    """{query: best (rank, neighbour, score)} over all pairs."""
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0

    def kin(a, b):
        if not a or not b:
            return 0.0
        return 1.0 if a == b else 0.5 if {a, b} == {"heck", "suzuki"} else 0.0

    out = {}
    for q in queries:
        scored = []
        for t in vec:
            if t["row_id"] != q["row_id"]:
                s = 0.5 * alike(q["fp"], t["fp"]) + 0.3 * alike(q["tx"], t["tx"]) + 0.2 * kin(q["rclass"], t["rclass"])
                scored.append((-round(s, 9), t["row_id"]))
        out[q["row_id"]] = [(i + 1, n, -s) for i, (s, n) in enumerate(sorted(scored)[:k])]
    return out


def neighbours(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"], round(r["score"], 9)))
    return {q: sorted(rows) for q, rows in got.items()}


def items(spark):
    texts = ["abcdef", "abcdeg", "abcxyz", "hijklm", "abcdef", "hijkln", "bcdefg", "abcdefabcdef"]
    rows = [(i, texts[i % len(texts)], f"{texts[(i * 3) % 8]}.q", ("heck", "suzuki", "oxidation", "")[i % 4]) for i in range(60)]
    rows += [(100, "zz", None, None), (101, "", "a", "heck"), (102, None, None, None), (103, "mno" * 900, "pqr", "heck")]
    return spark.createDataFrame(rows, "row_id long, product string, reactants string, rclass string")


@pytest.mark.parametrize("block", [2048, 4])
def test_similar_topk_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    df = items(spark)
    vec = similarity.with_features(df).where("fp IS NOT NULL").collect()
    assert neighbours(similarity.similar_topk(df, df, 3)) == plain_neighbours(vec, vec, 3)
    some = df.where("row_id % 7 = 0 OR row_id = 100")
    asked = [v for v in vec if v["row_id"] % 7 == 0 or v["row_id"] == 100]
    got = neighbours(similarity.similar_topk(some, df, 70))
    # More than there are others: all of them come back, unlike ones with score 0 as well.
    assert got == plain_neighbours(vec, asked, 70)
    assert all(len(rows) == len(vec) - 1 for rows in got.values())


def test_similar_topk_of_empty_tables(spark):
    df = items(spark)
    assert similarity.similar_topk(df, df.limit(0), 3).count() == 0
    assert similarity.similar_topk(df.limit(0), df, 3).count() == 0


def test_index_finds_nine_in_ten_with_fewer_pairs(spark):
    """Against the exact search, on pages; the pairs looked at grow slower than their square."""
    from flaskmill.plans import similar

    pairs = {}
    for sf in ("sf0.001", "sf0.01"):
        rows = similar.items(spark, f"/root/testdata/{sf}")
        sig = similarity.stage(similarity._signatures(rows, "row_id"))
        n = sig.count()
        pairs[n] = similarity._probed(sig, sig, n, n, similarity.SIMILARITY_WEIGHTS, similarity.PROBED_CELLS).count()
    (small, large), (few, many) = pairs, pairs.values()
    assert many < (large / small) ** 1.8 * few
    exact = neighbours(similarity.similar_topk(rows, rows, 5))
    found = neighbours(similarity.similar_topk(rows, rows, 5, exact=False))
    assert len(exact) == large and all(len(v) == 5 for v in exact.values())
    hits = sum(s >= exact[q][-1][2] for q, best in found.items() for _, _, s in best)
    assert hits >= 0.9 * 5 * large


def test_packed_vectors(one):
    ints = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<int>")
    assert one(fingerprints.packed(ints(0, 63, 64, 2047)))[:2] == [-(2**63) + 1, 1]
    assert one(fingerprints.packed(ints(2047)))[31] == -(2**63)
    shared = lambda a, b: one(fingerprints.overlap(fingerprints.packed(a), fingerprints.packed(b)))
    assert shared(ints(1, 63, 64, 2047), ints(63, 64, 65, 2047)) == 3
    assert shared(ints(), ints(1)) == 0


def test_length_sketches_of_parts_add_up(spark):
    """Parts kept and combined later, against the exact profile of all rows."""
    rows = [(i % 7, "x" * ((i * 37) % 5000 if i % 3 else 12)) for i in range(30_000)] + [(1, None), (8, None)]
    df = spark.createDataFrame(rows, "part int, text string")
    parts = [audits.length_sketch(df.where(F.col("part") == p), "text") for p in range(9)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    got = audits.profile_of_sketches(whole, [1000, 4000]).head()
    exact = audits.length_profile(df, "text", [1000, 4000]).head()
    assert (got["rows"], got["longest"]) == (30_000, exact["longest"])
    assert got["mean"] == pytest.approx(exact["mean"])
    lengths = sorted(len(t) for _, t in rows if t is not None)
    for name, q in (("p95", 0.95), ("p99", 0.99)):
        low = sum(n < got[name] for n in lengths) / len(lengths)
        high = sum(n <= got[name] for n in lengths) / len(lengths)
        assert low - audits.SKETCH_RANK_ERROR <= q <= high + audits.SKETCH_RANK_ERROR
    for c in (1000, 4000):
        assert abs(got[f"over_{c}"] - exact[f"over_{c}"]) <= audits.SKETCH_RANK_ERROR


def test_similarity_table_counts(spark):
    df = spark.createDataFrame([("a",), ("",), ("b",), (None,), ("b",)], "product string").withColumn("reactants", F.lit("x"))
    held = spark.createDataFrame([("b",)], "product string")
    assert tuple(similarity.similarity_table_report(df, held).head()) == (1, 2, 2)
    assert similarity.build_similarity_table(df, held).count() == 1


def test_exact_scores_do_not_ask_what_is_auxiliary(spark):
    df = spark.createDataFrame([("CCO.[Na+]", ["O", "[Na+].CCO"])], "reference string, candidates array<string>")
    scored = topk.topk_exact(topk.prepare_run(df))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert M.CHARGE not in plan
    assert scored.head()["exact_match_top3"] == 1.0


def test_readable_texts_and_auxiliary_ones_with_their_names(spark):
    rows = [None, "", " ", "CCO", "Cl", "Clr", "CC\n", "[Na+]", "[Na+].CC", "c1ccccc1", "C1CC", "C(C", "C()C", "()", "[C", "NaOH", "PhBr", "C" * 20000]
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    got = df.select(
        M.is_readable("c").alias("ok"), M.is_auxiliary("c").alias("aux"),
        M.is_auxiliary_named("c", M.canonical_text("c")).alias("named"),
    ).collect()
    assert [r["ok"] for r in got] == [False] * 3 + [True, True] + [False] * 2 + [True] * 3 + [False] * 7 + [True]
    assert [r["aux"] for r in got] == [r["named"] for r in got]
    assert [rows[i] for i, r in enumerate(got) if r["aux"]] == ["Cl", "[Na+]", "[Na+].CC", "NaOH"]


def test_a_scan_with_a_floor_gives_no_pair_below_it(spark):
    texts = ["abcdef", "abcdeg", "abcxyz", "qrstuv"]
    df = spark.createDataFrame([(i, t, t, "") for i, t in enumerate(texts)], "row_id long, product string, reactants string, rclass string")
    sig = similarity._signatures(df, "row_id").cache()
    q, t = similarity._side(sig, "q").withColumn("floor", F.lit(0.3)), similarity._side(sig, "t")
    pairs = lambda rows: {(r["q"], r["t"]): r["score"] for r in rows.collect()}
    every = pairs(similarity._scan(q, t, 4, 4, similarity.SIMILARITY_WEIGHTS))
    kept = pairs(similarity._scan(q, t, 4, 4, similarity.SIMILARITY_WEIGHTS, "floor"))
    assert kept == {k: v for k, v in every.items() if v >= 0.3} and 4 < len(kept) < 16


def _steps(df):
    """The expressions of every step of the optimised plan, as text."""
    out, left = [], [df._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        out.append(node.expressions().mkString(" "))
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return out


def test_pairs_are_counted_once_and_in_short_steps(spark):
    """The JVM compiles no method of 64 words' counts, and a filter must not count them again."""
    df = items(spark)
    sig = similarity.stage(similarity._signatures(df, "row_id"))
    q, t = similarity._side(sig, "q").withColumn("floor", F.lit(0.3)), similarity._side(sig, "t")
    for floor in (None, "floor"):
        counts = [s.count("bit_count(") for s in _steps(similarity._scan(q, t, 9, 9, similarity.SIMILARITY_WEIGHTS, floor))]
        assert max(counts) == 16 and sum(counts) == 64


def test_floors_are_reached_by_as_many_partners(spark):
    rows = [("a", i, i / 100) for i in range(100)] + [("b", i, 0.5) for i in range(100)] + [("c", 1, 0.9), ("c", 1, 0.9)]
    scored = spark.createDataFrame(rows, "q string, t long, score double")
    floors = {r["q"]: r["floor"] for r in similarity._floors(scored, 3, "q", "t").collect()}
    # Two rows of one partner are not two partners.
    assert set(floors) == {"a", "b"} and floors["b"] == 0.5 and 0.8 < floors["a"] <= 0.97


@pytest.mark.parametrize("n", [2, 12, 100])
def test_cells_are_the_best_of_all_pivots(spark, n):
    sig = similarity.stage(similarity._signatures(items(spark), "row_id"))
    w, count = similarity.SIMILARITY_WEIGHTS, sig.count()
    every = {}
    for r in similarity._scan(similarity._side(sig, "q"), similarity._side(sig, "t"), count, count, w).collect():
        every.setdefault(r["t"], []).append((-r["score"], r["q"]))
    got = {}
    for r in similarity._cells(sig, sig, count, count, n, w).collect():
        got.setdefault(r["sig"], []).append((r["nth"], r["cell"]))
    want = {t: [(i + 1, q) for i, (_, q) in enumerate(sorted(pairs)[:n])] for t, pairs in every.items()}
    assert {t: sorted(cells) for t, cells in got.items()} == want


def test_shingles_are_runs_of_whole_characters(spark):
    texts = ["a\nb\r\n c", "a\U0001f600b\U0001f601\U0001f602", "aaaa", "éab", "ab", "\U0001f600", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["s"] for r in df.select(fingerprints.shingles("t").alias("s")).collect()]
    runs = lambda t: [t[i : i + 3] for i in range(max(1, len(t) - 2))]
    assert got == [list(dict.fromkeys(runs(t))) if t else None for t in texts]


def test_class_similarity_of_single_labels(spark):
    labels = [None, "heck", "suzuki", "oxidation", "reduction", "other"]
    df = spark.createDataFrame([(a, b) for a in labels for b in labels], "a string, b string")
    groups = (classes.class_groups("a"), classes.class_groups("b"))
    got = df.select(
        classes.class_similarity("a", F.array_compact(F.array("b")), normal=True).alias("listed"),
        classes.class_similarity("a", "b", normal=True, groups=groups).alias("single"),
    ).collect()
    assert [r["listed"] for r in got] == [r["single"] for r in got] and {r["single"] for r in got} == {0.0, 0.5, 1.0}
