"""Streaming forms: stateless, deduplicated, resumable."""

from flaskmill.streaming import streams


def run(stream, tmp_path, name):
    out = str(tmp_path / name)
    streams.stream_append(stream, out, str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    return out


def test_a_second_run_takes_only_new_keys(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "k string, v int"
    for rows in ([("a", 1), ("b", 2)], [("a", 3), ("c", 4), ("", 5), (None, 6)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = streams.stream_dedupe(spark.readStream.schema(schema).parquet(source), "k")
        out = run(stream, tmp_path, "out")
    got = spark.read.schema(schema).parquet(out).collect()
    assert sorted(r["k"] for r in got) == ["a", "b", "c"]
    assert {r["v"] for r in got if r["k"] == "a"} == {1}


def test_watermark_bounds_the_state(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "k string, at timestamp"
    rows = "values ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:01:00') t(k, at)"
    spark.sql(f"select * from {rows}").write.parquet(source)
    stream = streams.stream_dedupe(spark.readStream.schema(schema).parquet(source), "k", "at", "1 hour")
    out = run(stream, tmp_path, "out")
    assert spark.read.schema(schema).parquet(out).count() == 1


def test_exclusion_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "k string"
    spark.createDataFrame([("a",), ("b",), (None,)], schema).write.parquet(source)
    held = spark.createDataFrame([("a",)], schema)
    out = run(streams.stream_exclude(spark.readStream.schema(schema).parquet(source), held, "k"), tmp_path, "out")
    assert sorted(str(r["k"]) for r in spark.read.schema(schema).parquet(out).collect()) == ["None", "b"]


def appended(spark, tmp_path, checkpoint="once-checkpoint"):
    from flaskmill.streaming import ledger

    stream = spark.readStream.schema("k string, v int").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "once")
    ledger.stream_append_once(stream, out, str(tmp_path / checkpoint), "k").awaitTermination()
    return sorted(r["k"] for r in ledger.committed(spark, out).collect())


def put(spark, tmp_path, *rows):
    spark.createDataFrame(list(rows), "k string, v int").write.mode("append").parquet(str(tmp_path / "in"))


def test_keys_are_appended_once_over_restarts_and_runs(spark, tmp_path):
    put(spark, tmp_path, ("a", 1), ("b", 2), ("a", 3), (None, 4), ("", 5))
    assert appended(spark, tmp_path) == ["", "a", "b"]
    put(spark, tmp_path, ("b", 6), ("c", 7))
    assert appended(spark, tmp_path) == ["", "a", "b", "c"]
    assert appended(spark, tmp_path) == ["", "a", "b", "c"]
    # Another run, from the first file on.
    put(spark, tmp_path, ("d", 8))
    assert appended(spark, tmp_path, "other-checkpoint") == ["", "a", "b", "c", "d"]


def test_a_crash_between_rows_and_ledger_repeats_nothing(spark, tmp_path):
    import pytest

    from flaskmill.streaming import ledger

    out, checkpoint = str(tmp_path / "out"), "c"
    make = lambda *ks: spark.createDataFrame([(k, 1) for k in ks], "k string, v int")

    def crash():
        raise RuntimeError("lost")

    ledger.append_once(make("a", "b"), 0, out, checkpoint, "k")
    with pytest.raises(RuntimeError):
        ledger.append_once(make("b", "c"), 1, out, checkpoint, "k", crash)
    assert sorted(r["k"] for r in ledger.committed(spark, out).collect()) == ["a", "b"]
    ledger.append_once(make("b", "c"), 1, out, checkpoint, "k")
    ledger.append_once(make("b", "c"), 1, out, checkpoint, "k")  # committed, but Spark's commit was lost
    ledger.append_once(make("c", "d"), 2, out, checkpoint, "k")
    assert sorted(r["k"] for r in ledger.committed(spark, out).collect()) == ["a", "b", "c", "d"]


def test_keys_that_arrive_later_stop_later_rows(spark, tmp_path):
    from flaskmill.streaming import ledger

    out = str(tmp_path / "out")
    write = lambda name, *ks: spark.createDataFrame([(k,) for k in ks], "k string").write.mode("append").parquet(str(tmp_path / name))
    for rows, keys in ((["a", "b", None], ["b", ""]), (["a", "b", "", "c"], ["c", None]), (["a"], ["a"])):
        write("rows", *rows)
        write("keys", *keys)
        read = lambda name: spark.readStream.schema("k string").parquet(str(tmp_path / name))
        ledger.stream_exclude_growing(read("rows"), read("keys"), out, str(tmp_path / "c"), "k").awaitTermination()
    got = sorted(str(r["k"]) for r in ledger.committed(spark, out).collect())
    assert got == ["", "None", "a", "a"]
