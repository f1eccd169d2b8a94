"""The pipeline, stage by stage, against plain Python over what each stage is given."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from rows_of import as_rows, prose
from test_brute_force import bare, shingle_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with bad texts, copies, near copies and benchmark passages."""
    rng = random.Random(5)
    rows, labels = [], []
    items = [prose(rng, n) for n in (20, 35)]
    for i in range(420):
        text, good = prose(rng, rng.randint(80, 140)), i % 4 > 0
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if good and i % 40 == 1:
            text += "\n" + items[i % 2]
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    for i in range(30):
        copy = rows[3 if i % 2 else 5 + 4 * (i % 6)]
        rows.append((1000 + i, copy[1] + (" end" if i % 3 else ""), "en", "s1", 0))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Rows given to and made by each stage."""
    out, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    base = tmp_path_factory.mktemp("stages")
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        made.write.parquet(f"{base}/{at}")
        made = spark.read.parquet(f"{base}/{at}")
        out[name] = docs.collect(), made.collect(), made.columns
        docs = made
    return out


def test_names_and_columns(stages):
    assert len(stages) == 5
    for name in list(stages)[:-1]:
        assert stages[name][2] == COLUMNS


def test_good_documents_stay(stages):
    given, made, _ = stages["quality classifier"]
    kept = {r["doc_id"] for r in made}
    bad = {r["doc_id"] for r in given if r["doc_id"] < 1000 and r["doc_id"] % 4 == 0}
    good = {r["doc_id"] for r in given} - bad
    assert len(kept & bad) <= 0.03 * len(bad) and len(good - kept) <= 0.03 * len(good)


def test_one_of_each_group_stays(stages):
    given, made, _ = stages["n-gram Jaccard join"]
    sets = {r["doc_id"]: frozenset(shingle_counts(bare(r["text"]))) for r in given}
    near = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    root = {i: i for i in sets}
    links = {i: [j for j in sets if near(i, j)] for i in sets}
    for _ in range(10):
        for i in sets:
            root[i] = min(root[j] for j in links[i])
    assert {r["doc_id"] for r in made} == set(root.values())
    assert len(made) < len(given) - 25


def test_no_benchmark_passage_stays(stages, spark, folder):
    given, made, _ = stages["benchmark decontamination"]
    items = [" ".join(bare(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in given if not any(x in " ".join(bare(r["text"])) for x in items)}
    assert {r["doc_id"] for r in made} == clean and len(clean) < len(given)


def test_the_mix_is_taken(stages):
    given, made, _ = stages["mixing sources"]
    size = lambda rows: Counter({s: sum(len(WORD.findall(r["text"])) for r in rows if r["source"] == s) for s in {r["source"] for r in rows}})
    before, after = size(given), size(made)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(before))}
    total = sum(before.values())
    assert abs(sum(after.values()) - total) <= 0.02 * total
    free = [s for s in before if after[s] < 2.9 * before[s]]
    rates = [after[s] / weight[s] for s in free]
    assert max(rates) <= 1.05 * min(rates)
    assert all(r["n_chars"] == len(r["text"]) for r in made)


def test_tokens_read_back(stages):
    from flaskmill.llm.queries import tokenizer
    from tokenizers import Tokenizer

    given, made, _ = stages["token blocks"]
    whole = Tokenizer.from_str(tokenizer())
    want = Counter()
    for r in given:
        ids = np.asarray(whole.encode(r["text"], add_special_tokens=False).ids + [2], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in made) == want
    rows = sorted(made, key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)


def test_run_is_its_stages(spark, folder, stages):
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert as_rows(corpus_pipeline.run(spark, folder), *columns) == sorted((tuple(r) for r in stages["token blocks"][1]), key=repr)
    assert corpus_pipeline.ORACLE_SQL is None
