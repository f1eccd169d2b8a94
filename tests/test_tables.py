"""Sampling, splitting, deduplication and joins against plain Python, with hot keys."""

import hashlib

import pytest
from pyspark.sql import functions as F

from flaskmill.operators import dedupe, leakage, ordering, sampling, skew


def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    """A third of the rows share one text, and a third one source."""
    out = []
    for i in range(6000):
        text = "hot" if i % 3 == 0 else f"t{i % 1700}"
        source = "big" if i % 3 == 1 else (None if i % 50 == 0 else f"s{i % 7}")
        out.append((i, text if i % 97 else "", source))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, source string").repartition(7).cache()


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def first_ids(rows):
    seen, out = set(), []
    for i, text, source in sorted(rows):
        if text and text not in seen:
            seen.add(text)
            out.append((i, text, source))
    return out


def test_dedupe_first(table, rows):
    assert ids(dedupe.dedupe_first(table, "text", "id")) == [r[0] for r in first_ids(rows)]


def test_hot_keys_collapse_before_the_shuffle(table):
    plan = dedupe.dedupe_first(table, "text", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("n", [50, 1500, 2500, 10_000])
def test_first_by_hash(table, rows, n):
    want = sorted(r[0] for r in sorted(rows, key=lambda r: digest(5, r[0]))[:n])
    assert ids(ordering.first_by_hash(table, n, "id", 5)) == want


@pytest.mark.parametrize("cap, n", [(40, 200), (1100, 1500), (1100, 100_000)])
def test_stratified_sample(table, rows, cap, n):
    groups = {}
    for r in sorted(first_ids(rows), key=lambda r: digest(9, r[0])):
        groups.setdefault(r[2] or "unknown", []).append(r)
    pool = [r for g in groups.values() for r in g[:cap]]
    want = sorted(r[0] for r in sorted(pool, key=lambda r: digest(9, r[0]))[:n])
    got = sampling.stratified_capped_sample(table, n, "source", "text", "id", 9, cap)
    assert ids(got) == want


def test_nested_samples(table):
    small = set(ids(sampling.seeded_sample_nested(table, 100, 3, "text", "id")))
    middle = set(ids(sampling.seeded_sample_nested(table, 900, 3, "text", "id")))
    large = set(ids(sampling.seeded_sample_nested(table, 1001, 3, "text", "id")))
    assert small < middle < large and len(large) == 1001


def test_samples_do_not_depend_on_partitions(table):
    a = sampling.stratified_capped_sample(table.repartition(2), 1200, "source", "text", "id", 1, 1001)
    b = sampling.stratified_capped_sample(table.repartition(11, "text"), 1200, "source", "text", "id", 1, 1001)
    assert ids(a) == ids(b)


@pytest.mark.parametrize("total", [0, 1, 9, 10, 39, 5003])
def test_split_sizes(spark, total):
    df = spark.range(total)
    got = dict(sampling.split_fractions(df, 0.05, 0.05, "id", 1).groupBy("split").count().collect())
    fifth = int(total * 0.05)
    assert got.get("test", 0) == fifth and got.get("val", 0) == fifth
    assert got.get("train", 0) == total - 2 * fifth
    got = dict(sampling.split_count(df, 400, "id", 1).groupBy("split").count().collect())
    assert got.get("val", 0) == min(400, max(1, total // 10), total)


def test_split_order_is_test_val_train(spark):
    rows = sampling.split_fractions(spark.range(100), 0.1, 0.2, "id", 4).collect()
    ranked = sorted(rows, key=lambda r: digest(4, r["id"]))
    assert [r["split"] for r in ranked] == ["test"] * 10 + ["val"] * 20 + ["train"] * 70


@pytest.mark.parametrize("n", [5, 1200, 3000])
def test_cap_per_source(table, rows, n):
    df = table.where("source is not null")
    want = []
    for s in {r[2] for r in rows if r[2]}:
        want += sorted(r[0] for r in rows if r[2] == s)[:n]
    assert ids(sampling.cap_first_per_source(df, n, "source", "id")) == sorted(want)


def test_take_unique(table, rows):
    first = [r[0] for r in first_ids(rows)]
    assert ids(sampling.take_unique(table, "text", 20, "id")) == first[:20]
    assert ids(sampling.take_unique(table, "text", 1100, "id")) == first[:1100]
    assert ids(sampling.take_unique(table, "text", 99_999, "id")) == first


def test_first_n_passing_refuses_too_few(spark):
    df = spark.range(10)
    assert ids(sampling.first_n_passing(df, F.col("id") > 3, 2, "id")) == [4, 5]
    with pytest.raises(ValueError):
        sampling.first_n_passing(df, F.col("id") > 8, 2, "id")
    with pytest.raises(ValueError):
        sampling.first_n_passing(df, F.col("id") > 80, 2, "id")


def test_expand_copies(spark):
    df = spark.createDataFrame([(1, 10), (2, 2), (3, 0)], "id long, size int")
    got = {}
    for r in sampling.expand_copies(df, 5, "size", "id", 1).collect():
        got.setdefault(r["id"], []).append(r["root"])
    assert len(got[1]) == 5 and len(set(got[1])) == 5 and set(got[1]) <= {None, *range(10)}
    assert sorted(got[2], key=str) == [0, 1, None] and got[3] == [None]
    single = sampling.expand_copies(df, 1, "size", "id", 1)
    assert [r["root"] for r in single.collect()] == [None] * 3


def test_bernoulli_share(spark):
    share = spark.range(20_000).agg(F.avg(sampling.bernoulli_flag(0.25, 1, 0, "id").cast("int"))).head()[0]
    assert abs(share - 0.25) < 0.02


def test_a_fragment_store_grows_by_new_fragments_only(spark, tmp_path):
    from flaskmill.operators import fragments
    from flaskmill.operators.fragment_store import FragmentStore

    make = lambda *texts: spark.createDataFrame([(t,) for t in texts], "s string")
    first, second = make("CCO.[Na+]", "CCO", "x?", None), make("CCO.CN", "", "CN.[Pd]", "CN")
    store = FragmentStore(spark, "grown", str(tmp_path), 8)
    assert store.add("one", [(first, ["s"])])
    assert not store.add("one", [(first, ["s"])])
    # The stored side is read bucket by bucket: the only exchanges are those that count the new part.
    counted = fragments.explode_fragments(second, ["s"]).groupBy("raw").count()
    plan = store.unseen(counted.select("raw"))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "grown" in line)
    assert "Bucketed: true" in lines[at]
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    above, inner = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < inner:
            above, inner = [*above, line], depth(line)
        if "SortMergeJoin" in line:
            break
    assert "SortMergeJoin" in above[-1] and not any("Exchange" in line for line in above), plan
    assert sorted(r["raw"] for r in store.unseen(counted.select("raw")).collect()) == ["CN", "[Pd]"]
    assert store.add("two", [(second, ["s"])])
    whole = fragments.build_fragment_dim([(first.unionByName(second), ["s"])])
    row = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert row(store.table()) == row(whole.select(*store.table().columns))
    assert spark.table("grown").count() == spark.table("grown").select("raw").distinct().count()


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_large_holdouts_are_filtered_before_the_join(spark, bits):
    """Exact whatever the filter lets through; only the filter is broadcast."""
    rows = [(i, None if i % 50 == 0 else "" if i % 50 == 1 else f"t{i % 3000}" if i % 3 else "hot") for i in range(9000)]
    df = spark.createDataFrame(rows, "id long, text string")
    for held in ({f"t{i}" for i in range(0, 4000, 7)}, {"hot", ""}, set()):
        keys = spark.createDataFrame([(t,) for t in held] + [(None,)], "text string")
        got = [r["id"] for r in leakage.exclude_large(df, keys, "text", bits).collect()]
        assert sorted(got) == [i for i, t in rows if not t or t not in held]
    plan = leakage.exclude_large(df, keys, "text", bits)._jdf.queryExecution().toString()
    assert "bitmap_construct_agg" in plan
    assert leakage.key_filter(keys.limit(0), "text").count() == 0


def test_a_mix_is_written_in_seeded_order(spark, tmp_path):
    a = spark.createDataFrame([(f"a{i}", i) for i in range(500)], "key string, n int")
    b = spark.createDataFrame([(f"b{i}",) for i in range(300)] * 2, "key string")
    path = str(tmp_path / "mixed")
    leakage.write_mixed(leakage.mix(a, b, 9, "key"), path, files=6)
    files = sorted(p for p in (tmp_path / "mixed").glob("part-*.parquet"))
    assert len(files) == 6
    keys = [r["key"] for f in files for r in spark.read.parquet(str(f)).collect()]
    want = sorted([f"a{i}" for i in range(500)] + [f"b{i}" for i in range(300)] * 2, key=lambda k: digest(9, k))
    assert keys == want
    rows = leakage.read_mixed(spark, path).collect()
    assert [r["key"] for r in sorted(rows, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in rows) == list(range(1100))


def test_exclusion_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, k string")
    held = spark.createDataFrame([("a",), (None,), ("",)], "k string")
    assert ids(leakage.exclude_holdout(df, held, "k")) == [2, 3]


def test_leak_report(spark):
    test = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "k string, s string")
    train = spark.createDataFrame([("a", "x"), ("c", "x"), (None, "x")], "k string, s string")
    r = leakage.leak_report(test, train, "k", ["k", "s"]).head()
    assert (r["rows_in"], r["leaked"], r["kept"], r["kept_percent"]) == (5, 3, 2, 40.0)
    assert (r["leaked_keys"], r["leaked_pairs"]) == (1, 1)
    empty = leakage.leak_report(test.limit(0), train, "k", ["k", "s"]).head()
    assert (empty["rows_in"], empty["kept_percent"]) == (0, 0.0)


def test_join_spread_equals_a_plain_join(spark, table):
    right = table.select("text").distinct().withColumn("n", F.length("text")).where("n % 2 = 1")
    for how in ("left", "inner"):
        ours = skew.join_spread(table, right, "text", ["id"], how).select("id", "text", "n")
        plain = table.join(right, "text", how).select("id", "text", "n")
        assert sorted(ours.collect()) == sorted(plain.collect())


def test_hot_keys_are_found_and_bounded(table):
    hot = [r[0] for r in skew.hot_keys(table, "text").collect()]
    assert "hot" in hot and len(hot) < skew.HOT_SHARE


def test_pairing_refuses_other_products(spark):
    a = spark.createDataFrame([(0, "p"), (1, "q")], "record_pos long, product string")
    b = spark.createDataFrame([(0, "p"), (1, "z")], "record_pos long, product string")
    assert leakage.pair_runs(a, a).count() == 2
    for other in (b, a.limit(1)):
        with pytest.raises(Exception, match="runs differ"):
            leakage.pair_runs(a, other).count()


def test_subset_like(spark):
    full = spark.createDataFrame([(0, "p"), (1, "q"), (2, "r")], "record_pos long, product string")
    like = spark.createDataFrame([(0, "r", 2), (1, "p", 0)], "record_pos long, product string, i int")
    got = leakage.subset_like(full, like, "i").orderBy("like_pos").collect()
    assert [r["product"] for r in got] == ["r", "p"]
    wrong = spark.createDataFrame([(0, "p", 2)], "record_pos long, product string, i int")
    missing = spark.createDataFrame([(0, "p", 9)], "record_pos long, product string, i int")
    for bad in (wrong, missing):
        with pytest.raises(Exception, match="same test file"):
            leakage.subset_like(full, bad, "i").count()


def test_merge_chunks(spark):
    schema = "record_pos long, product string, num_beams int"
    a = spark.createDataFrame([(0, "p", 5), (1, "q", 5)], schema)
    b = spark.createDataFrame([(0, "q", 5), (1, "r", 5)], schema)
    got = leakage.merge_chunks([a, b], ["num_beams"]).orderBy("chunk", "record_pos").collect()
    assert [(r["chunk"], r["product"]) for r in got] == [(0, "p"), (0, "q"), (1, "r")]
    c = spark.createDataFrame([(0, "z", 3)], schema)
    with pytest.raises(Exception, match="different settings"):
        leakage.merge_chunks([a, c], ["num_beams"]).collect()


def test_last_prediction_wins(spark):
    targets = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, k string")
    preds = spark.createDataFrame([("a", "old", 0), ("a", "new", 1), ("c", "x", 2)], "k string, v string, pos int")
    got = leakage.attach_predictions(targets, preds, "k", "pos", "id").collect()
    assert [(r["id"], r["v"]) for r in got] == [(1, "new")]


def test_staging_folder_comes_from_the_session(spark):
    from types import SimpleNamespace

    from flaskmill.session import stage, staging_dir

    def session(folder, master):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-x"))

    assert staging_dir(session("/shared/dir", "yarn")) == "/shared/dir"
    local = staging_dir(session(None, "local[2]"))
    assert local == staging_dir(session(None, "local[2]"))
    with pytest.raises(ValueError):
        staging_dir(session(None, "yarn"))
    df = spark.range(5).withColumn("a", F.array(F.lit(None).cast("string")))
    back = stage(df)
    assert back.schema["a"].dataType == df.schema["a"].dataType
    assert sorted(back.collect()) == sorted(df.collect())


def test_plans_hold_no_cross_join_and_no_python(spark):
    from flaskmill.plans.catalog import QUERIES

    names = ("split_fractions", "stratified_capped_sample", "split_roles", "topk_scores", "similar_topk",
             "canonicalise_sets", "role_validation", "strings_with_unknown")
    for name in names:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        for bad in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert bad not in plan, (name, bad)


@pytest.fixture(scope="module")
def odd(spark):
    """Null groups, null and equal order values, far-off ones, and rows that are alike."""
    rows = []
    for i in range(4000):
        group = None if i % 3 == 0 else ("" if i % 11 == 0 else f"g{i % 2}")
        index = None if i % 50 == 0 else (10**15 + i if i % 97 == 0 else i // 4)
        rows.append((i % 1500, index, group))
    return spark.createDataFrame(rows, "id long, at long, grp string").repartition(5).cache()


def sizes(df):
    return {r["grp"]: r["n"] for r in df.groupBy("grp").agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("n", [300, 999, 1001, 1200, 5000])
def test_one_meaning_for_every_n(odd, n):
    """The path for many rows gives what the path for few would."""
    rows = [tuple(r) for r in odd.collect()]
    place = lambda v: (v is not None, v or 0)
    per_group = {}
    for r in rows:
        per_group.setdefault(r[2], []).append(r)
    by_index = sampling.cap_first_per_source(odd, n, "grp", "at")
    assert sizes(by_index) == {g: min(n, len(m)) for g, m in per_group.items()}
    for g, members in per_group.items():
        got = by_index.where(F.col("grp").eqNullSafe(F.lit(g))).select("at").collect()
        want = sorted((r[1] for r in members), key=place)[:n]
        assert sorted((r[0] for r in got), key=place) == want
    by_hash = ordering.first_by_hash_per_group(odd, n, "id", "grp", 7)
    assert sizes(by_hash) == {g: min(n, len(m)) for g, m in per_group.items()}
    first = ordering.first_by_hash(odd, n, "id", 7)
    assert sorted(r["id"] for r in first.collect()) == sorted(sorted((r[0] for r in rows), key=lambda i: (digest(7, i), i))[:n])
    for order in ("at", "grp"):
        got = [r[order] for r in ordering.first_in_order(odd, n, order).collect()]
        want = sorted((r[1] if order == "at" else r[2] for r in rows), key=lambda v: (v is not None, v if v is not None else 0))[:n]
        assert sorted(got, key=lambda v: (v is not None, v if v is not None else 0)) == want


def test_the_draw_does_not_depend_on_partitions(odd):
    a = ordering.first_by_hash(odd, 1100, "id", 3)
    b = ordering.first_by_hash(odd.repartition(11), 1100, "id", 3)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
