"""Every operator and stage over nulls, empties, long texts, repeats, empty tables, clashing names."""

import pytest
from rows_of import as_rows
from flaskmill.llm import (
    chosen_path,
    compression,
    decontaminate,
    licenses,
    link_graph,
    mixing,
    pii,
    quality_rules,
    suffix_arrays,
    tokens,
)
from flaskmill.llm.queries import tokenizer


@pytest.fixture(scope="module")
def benchmark(spark, awkward_rows):
    rows = [(1, awkward_rows[4][1]), (2, None), (3, ""), (4, "one two"), (None, "x y z"), (5, awkward_rows[4][1])]
    return spark.createDataFrame(rows, "item_id long, text string")


def blocks(docs, folder):
    tokens.write_blocks(docs, folder, tokenizer())
    return tokens.document_digests(tokens.read_blocks(docs.sparkSession, folder))


def runs(labels, benchmark, folder):
    """name: (operator, columns that must not change with extra columns)"""
    return {
        "licenses": (licenses.scan, ["doc_id", "scope", "line_no", "license"]),
        "decontaminate": (lambda d: decontaminate.leaks(d, benchmark), ["doc_id", "item_id", "first_word", "similarity"]),
        "tokens": (lambda d: blocks(d, str(folder)), ["doc_id", "start", "n_tokens", "ids_crc32"]),
        "quality_rules": (lambda d: quality_rules.judge(d, labels), ["doc_id", "n_words", "n_repeat_words", "base_failed", "kept"]),
        "compression": (lambda d: compression.classify(d, labels), ["doc_id", "held_out", "score", "predicted"]),
        "mixing": (mixing.mix, ["doc_id", "size", "source_size", "target", "taken"]),
        "pii": (pii.detect, ["doc_id", "n_email", "n_card", "spans"]),
        "chosen_path": (chosen_path.join, ["doc_id", "class_id", "n_links", "n_text_links"]),
        "suffix_arrays": (suffix_arrays.remove_repeats, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    }


NAMES = [
    "licenses", "decontaminate", "tokens", "quality_rules", "compression", "mixing", "pii", "chosen_path", "suffix_arrays",
]
PER_DOCUMENT = set(NAMES) - {"licenses", "decontaminate"}


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(name, awkward, clashing, empty, labels, benchmark, awkward_rows, tmp_path):
    operator, columns = runs(labels, benchmark, tmp_path / "a")[name]
    got = as_rows(operator(awkward), *columns)
    if name in PER_DOCUMENT:
        assert sorted((r[0] for r in got), key=repr) == sorted((r[0] for r in awkward_rows), key=repr)
    again, _ = runs(labels, benchmark, tmp_path / "b")[name]
    assert as_rows(again(clashing), *columns) == got
    none, _ = runs(labels, benchmark, tmp_path / "c")[name]
    assert none(empty).count() == 0


def filters(labels, benchmark):
    return {
        "compression": lambda d: compression.reject_bad(d, labels),
        "chosen_path": chosen_path.keep_one,
        "decontaminate": lambda d: decontaminate.drop_contaminated(d, benchmark),
        "mixing": mixing.mixed_documents,
    }


@pytest.mark.parametrize("name", ["compression", "chosen_path", "decontaminate", "mixing"])
def test_stages_keep_the_columns(name, awkward, clashing, empty, labels, benchmark):
    stage = filters(labels, benchmark)[name]
    plain = stage(awkward)
    assert plain.schema.simpleString() == awkward.schema.simpleString()
    more = stage(clashing)
    assert more.columns == clashing.columns
    assert as_rows(more, "doc_id", "text") == as_rows(plain, "doc_id", "text")
    assert stage(empty).count() == 0


def test_one_document_of_each_class_stays(awkward):
    kept = chosen_path.keep_one(awkward)
    classes = chosen_path.join(awkward)
    assert kept.count() == classes.select("class_id").distinct().count()
    ids = [r[0] for r in as_rows(kept, "doc_id")]
    assert {20, 21, 22, 23, 30, 31, 32, 33, 34, 54} & set(ids) == set()
    assert ids.count(3) == 1 and {0, 1, 53} <= set(ids)


def test_contaminated_documents_go(awkward, benchmark):
    kept = {r[0] for r in as_rows(decontaminate.drop_contaminated(awkward, benchmark), "doc_id")}
    assert {4, 53, 54} & kept == set()
    assert {0, 1, 2, 50, 51, 55} <= kept


def test_pages(spark):
    rows = [
        (1, "https://a.Example.com/x", None), (2, None, "<a href='http://b.org/'>"), (3, "no scheme", ""),
        (4, "x://", None), (5, "http://?q", None), (None, "http://n.net/es/1", None), (4, "x://", None),
        (6, "http://www.example.com/en/1", None), (7, "http://m.example.com/en/", None),
        (8, "http://q.net/de/://x", None), (9, "://c.com", None), (10, "http://É.COM/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in link_graph.judge(pages, rounds=3).collect()}
    at = lambda i: (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"])
    assert at(1) == ("a.example.com", "/x", "com/", "allow")
    assert at(2) == at(3) == at(4) == at(5) == ("", "", None, "allow")
    assert at(None) == ("n.net", "/es/1", "net/es/", "block")
    assert at(6) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert at(7) == ("m.example.com", "/en/", "example.com/en/", "block")
    assert at(8)[:3] == ("q.net", "/de/://x", None)
    assert at(9)[:3] == ("c.com", "", None)
    assert at(10)[:3] == ("É.com".replace("É", "É"), "/", "com/")
    extra = pages.selectExpr("*", "1 AS host", "2 AS path", "3 AS rules", "4 AS trust")
    assert as_rows(link_graph.judge(extra, rounds=2), "page_id", "host", "path", "rule") == as_rows(
        link_graph.judge(pages, rounds=2), "page_id", "host", "path", "rule"
    )
    assert link_graph.judge(spark.createDataFrame([], pages.schema), rounds=2).count() == 0
