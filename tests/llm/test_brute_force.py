"""Operators against plain Python over the same rows."""

import hashlib
import heapq
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from flaskmill.llm import (
    chosen_path,
    components,
    compression,
    decontaminate,
    labelled,
    licenses,
    link_graph,
    mixing,
    pii,
    quality_rules,
    suffix_arrays,
    tokens,
)
from flaskmill.llm.queries import tokenizer
from pyspark.sql import functions as F
from rows_of import as_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BARE = str.maketrans("", "", string.punctuation)


def bare(text):
    return WORD.findall((text or "").lower().translate(BARE))


def shingle_counts(words):
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


# --- licences -----------------------------------------------------------------------------


def test_licenses(spark):
    mit = dict(licenses.license_texts.known())["MIT"]
    texts = [
        "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE"),
        "intro\n  Released under the MIT Licence!\nend",
        "SPDX-License-Identifier: Apache-2.0",
        "it was released under the MIT License yesterday",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert as_rows(licenses.scan(docs), "doc_id", "scope", "line_no", "license") == [
        (0, "text", 0, "MIT"), (1, "line", 2, "MIT"), (2, "line", 1, "Apache-2.0"), (2, "text", 0, "Apache-2.0"),
    ]


def test_licenses_full_texts_and_header_notices(spark):
    known, more = licenses.license_texts.known(), licenses.license_texts.more()
    full = {}
    for i, text in more:
        full[i] = max(full.get(i, ""), text, key=len)
    mit = next(t for i, t in known if i == "MIT" and t.startswith("MIT License"))
    apache = licenses.license_texts.APACHE_NOTICE.format("http")
    gpl = next(t for i, t in more if i == "GPL-3.0" and t.startswith("This program") and "copy of the" in t)
    held = ["Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    assert set(licenses.license_texts.NAMES) == {*held, *licenses.license_texts.FULL, *licenses.license_texts.NAMES_ONLY}
    texts = [full[i] for i in held]
    texts.append("#!/bin/sh\n" + "".join(f"# {x}\n" for x in apache.split("\n")) + "echo 1\n")
    texts.append("intro\n\n" + mit + "\n\nmore\nwords\n")
    texts.append(gpl.replace("modify\nit under", "modify it\nunder") + "\nint main;")
    texts += [mit, "x\n" + apache.rsplit("\n", 1)[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = as_rows(licenses.scan(docs), "doc_id", "scope", "line_no", "license")
    n = len(held)
    for d, i in enumerate(held):
        assert (d, "text", 0, i) in got
    assert sorted(r for r in got if r[0] >= n) == [
        (n, "line", 2, "Apache-2.0"), (n, "lines", 2, "Apache-2.0"),
        (n + 1, "lines", 3, "MIT"),
        (n + 2, "lines", 1, "GPL-3.0"), (n + 3, "text", 0, "MIT"), (n + 4, "line", 2, "Apache-2.0"),
    ]


# --- decontamination ----------------------------------------------------------------------


def test_hamming_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(5)
    index = decontaminate.Index([0], pa.array(["a b c d e f g"]))
    index.ids, index.length = np.arange(400), rng.integers(5, 8, 400)
    index.print = rng.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64)
    index.tables = []
    for low, high in index.blocks:
        key = index._keys(index.print, index.length, low, high)
        order = np.argsort(key)
        index.tables.append((key[order], order))
    prints = index.print[rng.integers(0, 400, 300)].copy()
    for i in range(300):
        for bit in rng.choice(64, rng.integers(0, 30), replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(bit)
    length = rng.integers(5, 8, 300)
    window, item = index.near(prints, length)
    want = {
        (w, i)
        for w in range(300)
        for i in range(400)
        if length[w] == index.length[i] and bin(int(prints[w] ^ index.print[i])).count("1") <= index.radius
    }
    assert set(zip(window.tolist(), item.tolist())) == want and len(window) == len(want)


def test_leaks(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (15, 22, 30, 38, 57)]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        item = list(items[i % 5])
        if i % 4 == 1:
            item[rng.randrange(len(item))] = "changed"
        if i % 4 == 2:
            item = item[rng.randint(0, 3) :]
        if i % 4:
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in item]
        docs.append((i, " ".join(words)))
    want = {}
    for i, text in docs:
        words = bare(text)
        for k, item in enumerate(items):
            n, b, best = min(len(item), len(words)), shingle_counts(item), 0
            for a in range(len(words) - n + 1):
                c = shingle_counts(words[a : a + n])
                both = sum((c & b).values())
                best = max(best, both / (sum(c.values()) + sum(b.values()) - both))
            if best >= 0.8:
                want[i, k] = best
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    for per_pass in (20_000, 2):
        rows = decontaminate.leaks(frame, bench, items=per_pass).collect()
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}
        assert got == pytest.approx(want) and len(rows) == len(want) > 20


def test_short_items_and_items_without_an_id(spark):
    long = "the item without an id has as many words as this"
    rows = [(1, "Red, blue"), (2, "red blue"), (3, "one"), (4, "a b c d"), (None, long), (None, "x y z"), (5, None)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    texts = [
        "some words stand before red blue and red blue again", "red", "blue red", "one", "w a b c d", "a b c",
        f"before it {long} after it", "x y z", "p q r s t u x y z", "red", "nothing of it stands in here at all", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {
        (0, 1, 4, 2), (0, 2, 4, 2), (3, 3, 0, 1), (4, 4, 1, 4), (6, None, 2, 11), (7, None, 0, 3), (8, None, 6, 3),
    }
    for per_pass in (20_000, 2):
        got = [tuple(r) for r in decontaminate.leaks(docs, bench, items=per_pass).collect()]
        assert {r[:4] for r in got} == want and len(got) == len(want)
        assert all(r[4] == 1.0 for r in got)
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {1, 2, 5, 9, 10, 11}


# --- token blocks -------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 24, 31, 32])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 777, dtype=np.uint64).astype(np.uint32)
    packed = tokens.pack(ids, width)
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    assert packed == np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    assert len(packed) == -(-777 * width // 8)
    assert (tokens.unpack(packed, width, 0, 777) == ids).all()
    assert (tokens.unpack(packed, width, 131, 64) == ids[131:195]).all()


def test_token_blocks(awkward, awkward_rows, spark, tmp_path):
    from tokenizers import Tokenizer

    model = tokenizer()
    whole = Tokenizer.from_str(model)
    encode = lambda t: whole.encode(t or "", add_special_tokens=False).ids + [2]
    tokens.write_blocks(awkward, str(tmp_path / "t"), model, block_ids=500)
    blocks = tokens.read_blocks(spark, str(tmp_path / "t"))
    rows = tokens.document_digests(blocks).orderBy("start").collect()
    texts = sorted(((r[0] is not None, r[0] or 0), r[1]) for r in awkward_rows if r[0] is not None)
    assert [r["doc_id"] for r in rows[2:]] == [i for (_, i), _ in texts]
    at = sum(r["n_tokens"] for r in rows[:2])
    for row, (_, text) in zip(rows[2:], texts, strict=True):
        ids = np.asarray(encode(text), "<u4")
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert [x.tolist() for x in tokens.read_document(blocks, 57)] == [encode(awkward_rows[27][1])] or at
    assert all((x == np.asarray(encode("one two"))).all() for x in tokens.read_document(blocks, 53))


@pytest.mark.parametrize(
    "text",
    ["'S it's isn't <|endoftext|>x a<|startoftext|>", "ÀÉ é́ İstanbul ΑΣ Σ", "a\x1cb c\x85d e", "10.5%!! $a_b-c~{}|", ""],
)
def test_word_encoder(text):
    from tokenizers import Tokenizer

    model = tokenizer()
    ids, counts = tokens.WordEncoder(model).encode(pa.array([text, text + " " + text]), 2)
    whole = Tokenizer.from_str(model)
    want = [whole.encode(t, add_special_tokens=False).ids + [2] for t in (text, text + " " + text)]
    assert ids.tolist() == want[0] + want[1] and counts.tolist() == [len(w) for w in want]


# --- quality ------------------------------------------------------------------------------


def test_base_rules(awkward, awkward_rows, labels):
    want = []
    for i, text, *_ in awkward_rows:
        t = text or ""
        w = WORD.findall(t)
        three = Counter(zip(w, w[1:], w[2:]))
        marked = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if three[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked), failed))
    got = quality_rules.judge(awkward, labels)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert as_rows(got, *columns) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def marked(spark):
    """Good prose and three kinds of bad text, by label."""
    rng = random.Random(11)
    words = ["stone", "river", "walks", "under", "old", "bridge", "the", "and", "light", "morning", "quiet", "road"]
    rows = []
    for i in range(600):
        w = [rng.choice(words) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(60, 120))]
        bad = i % 3 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + rng.choice(["###", "%%%", "$$$"]) for x in w]
        rows.append((i, " ".join(w), int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_compression_classifier_held_out(marked):
    rows = compression.classify(marked, marked).join(marked, "doc_id").collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    test = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in test) >= 0.97 * len(test) > 100
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_ngram_classifier_held_out(marked):
    rows = quality_rules.judge(marked, marked).join(marked, "doc_id").collect()
    test = [r for r in rows if held_out(r["doc_id"]) and not r["base_failed"]]
    assert sum(r["kept"] == r["quality"] for r in test) >= 0.97 * len(test) > 100


def test_held_out_labels_are_not_used(marked):
    """Wrong labels on held-out rows change no score."""
    from pyspark.sql import functions as F

    flipped = marked.withColumn("quality", F.when(labelled.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert as_rows(compression.classify(marked, marked), "doc_id", "score") == as_rows(compression.classify(marked, flipped), "doc_id", "score")


# --- fitting samples ----------------------------------------------------------------------


def test_samples_do_not_shrink_as_tables_grow(spark):
    """3,100 of 10^10 rows lie under the cut: all that are wanted come back, the lowest first."""
    step = 2**64 // 10**10
    rows = [(i, -(2**63) + i * step) for i in range(3100)] + [(10**6, 5), (10**6 + 1, 2**63 - 1)]
    df = spark.createDataFrame(rows, "doc_id long, place long").repartition(5)
    got = labelled.drawn(df, F.col("place"), "doc_id", 10**10, 1500).collect()
    assert [r["doc_id"] for r in got] == list(range(1500))
    tied = spark.createDataFrame([(i % 40, 0) for i in range(400)], "doc_id long, place long")
    got = labelled.drawn(tied, F.col("place"), "doc_id", 40, 30).collect()
    assert [r["doc_id"] for r in got] == list(range(30))


# --- mixing -------------------------------------------------------------------------------


def plain_seats(votes, caps, seats):
    heap = [(-v, i, 0) for i, v in enumerate(votes) if v > 0 and caps[i] > 0]
    heapq.heapify(heap)
    want = [0] * len(votes)
    for _ in range(seats):
        if not heap:
            break
        _, i, n = heapq.heappop(heap)
        want[i] = n + 1
        if n + 1 < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * n + 3), i, n + 1))
    return want


def test_sainte_lague(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(120):
        votes = [rng.choice([0.0, 1.0, 1.0, 5.0, 100 * rng.random()]) for _ in range(rng.randint(1, 9))]
        caps = [rng.choice([10**6, max(1, int(3 * v))]) for v in votes]
        seats = rng.randint(0, min(60, sum(c for v, c in zip(votes, caps, strict=True) if v)))
        rows += [(str(g), i, v, c, seats) for i, (v, c) in enumerate(zip(votes, caps, strict=True))]
        want |= {(str(g), i): q for i, q in enumerate(plain_seats(votes, caps, seats))}
    got = mixing.apportion(spark.createDataFrame(rows, "of string, name long, votes double, cap long, seats long"))
    assert {(r["of"], r["name"]): r["quota"] for r in got.collect()} == want


@pytest.mark.parametrize("sizes", [
    [1600, 160_000] + [2] * 3000,
    [1, 5, 18, 20, 33, 4000, 17, 2, 90],
    [7],
    [0, 0, 3],
])
def test_sources_of_any_size_come_near_their_targets(spark, sizes):
    """A large source, many of a few words, and such as are capped: no document above three times."""
    rng = random.Random(4)
    rows = []
    for s, size in enumerate(sizes):
        while size > 0 or not rows or rows[-1][3] != f"s{s:05}":
            n = min(size, rng.randint(1, 900))
            rows.append((len(rows), " ".join(["w"] * n), "en", f"s{s:05}", 1))
            size -= n
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs.repartition(8)).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        source = rows[r["doc_id"]][3]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
        target[source] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(sizes))
    assert sum(taken.values()) == sum(sizes)
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_sources_of_several_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing.targets, "__defaults__", (mixing.WEIGHTS, mixing.MOST, 500))
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", f"s{i % 3}", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"] % 3] += r["taken"]
        target[r["doc_id"] % 3] = r["target"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    words = Counter()
    for r in mixing.mixed_documents(docs).collect():
        words[r["doc_id"] % 3] += len(WORD.findall(r["text"]))
    assert words == taken


def test_mixing(awkward, awkward_rows):
    rows = mixing.mix(awkward).collect()
    again = mixing.mix(awkward.repartition(7)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(rows, key=key) == sorted(again, key=key)
    sizes = Counter()
    for _, text, _, source, _ in awkward_rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, total = {}, set(names), sum(sizes.values())
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            free.remove(s)
    taken = Counter()
    by_size = {sizes[s]: s for s in names}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        source = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(target[source])
        taken[source] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    words = Counter()
    for r in mixing.mixed_documents(awkward).collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == +taken


# --- personal data ------------------------------------------------------------------------


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    double = lambda d: d - 9 if d > 9 else d
    luhn = lambda s: sum(double(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(s))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("aa.@@1234.5-+ (é9") for _ in range(rng.randint(0, 40)))
        assert plain_spans(t) == pii.base_spans(t)
    assert pii.base_spans("a" * 50_000 + "@" + "1" * 50_000) == []


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(4)
    node, edges = rng.normal(size=(5, 3)), np.asarray([(0, 1), (1, 2), (1, 3), (3, 4)])
    factor = rng.normal(size=(4, 3, 3))
    want = np.zeros((5, 3))
    for at in np.ndindex(*[3] * 5):
        p = np.exp(sum(node[i, k] for i, k in enumerate(at)) + sum(f[at[a], at[b]] for (a, b), f in zip(edges, factor)))
        for i, k in enumerate(at):
            want[i, k] += p
    got = np.exp(pii.messages(node, edges, factor, rounds=60))
    assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_distant_repeats_take_the_label(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        card = "".join(str(rng.randint(0, 9)) for _ in range(15))
        card = next(card + str(d) for d in range(10) if pii.luhn(card + str(d)))
        filler = " ".join(rng.choice(["so", "it", "was", "then"]) for _ in range(40))
        rows.append((i, f"pay {card} now {filler} card {card} again room {rng.randint(1, 99)}"))
    card = rows[0][1].split()[1]
    # joined to other digits, the pattern fails on the second one
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    rows.append((999, f"pay {card} now and much later 5 {card} once more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(docs, model).collect()}
    text = rows[-1][1]
    at = text.rindex(card)
    assert f"card:{at}:{at + 16}" in got[999]["spans"].split(",")
    assert got[999]["n_card"] == 1 and got[999]["n_added"] == 1
    assert all(got[i]["n_added"] == 0 for i in range(150))


def test_the_last_of_many_repeats_takes_the_label():
    # one chain of equal words, the first is evidence: exact beliefs by forward products
    lift = np.full((pii.LABELS, pii.LABELS), -3.0)
    np.fill_diagonal(lift, 4.0)
    lift[pii.OUTSIDE, pii.OUTSIDE] = 0.2
    for n in (40, 100, 1000):
        node = np.zeros((n, pii.LABELS))
        node[0] = -30
        node[0, 2] = 0
        edges = np.stack([np.arange(n - 1), np.arange(1, n)], 1)
        got = pii.messages(node, edges, np.repeat(lift[None], n - 1, 0))
        assert (got.argmax(1) == 2).all()
        into = np.exp(node[0])
        for _ in range(n - 1):
            into = into @ np.exp(lift)
            into /= into.sum()
        assert np.allclose(np.exp(got[-1]), into)


def test_messages_that_swing_come_to_an_end():
    rng = np.random.default_rng(1)
    edges = rng.integers(0, 40, (80, 2))
    edges = edges[edges[:, 0] != edges[:, 1]]
    got = pii.messages(rng.normal(size=(40, 3)), edges, 6 * rng.normal(size=(len(edges), 3, 3)))
    assert np.isfinite(got).all()


def test_a_hundred_repeats_take_the_label():
    text = "pay 4111111111111111 now" + " and later x4111111111111111y" * 100
    found = pii.Nodes(text, pii.base_spans(text))
    assert len(found.word) == 101 and sum(k != pii.OUTSIDE for k in found.label) >= 1
    found.label = [2] + [pii.OUTSIDE] * 100
    lift = np.full((pii.LABELS, pii.LABELS), -3.0)
    np.fill_diagonal(lift, 4.0)
    weights = np.zeros((1 << pii.BITS, pii.LABELS))
    [spans] = pii.added_spans([found], {"weights": weights, "chain": np.zeros_like(lift), "skip": lift})
    assert len(spans) == 100 and all(kind == 2 for _, kind, _ in spans)


# --- similarity join ----------------------------------------------------------------------


def linked(rows):
    """(n_links, n_text_links, class) of each row by brute force."""
    sets = [frozenset(shingle_counts(bare(r[1]))) for r in rows]
    near = lambda a, b: a == b or (a and b and 10 * len(a & b) >= 8 * len(a | b))
    links = [{j for j in range(len(rows)) if j != i and near(sets[i], sets[j])} for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        for i, near_i in enumerate(links):
            root[i] = min([root[i], *(root[j] for j in near_i)])
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root[i]] = min(ids.get(root[i], r[0]), r[0])
    return sorted(
        ((r[0], ids.get(root[i]), len(links[i]), len({sets[j] for j in links[i]} - {sets[i]})) for i, r in enumerate(rows)),
        key=repr,
    )


@pytest.mark.parametrize("bucket, block", [(128, 256), (3, 4)])
def test_chosen_path_join(spark, awkward_rows, bucket, block, monkeypatch):
    monkeypatch.setattr(chosen_path, "BUCKET", bucket)
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    monkeypatch.setattr(chosen_path, "NODE_BLOCK", block)
    rng = random.Random(6)
    rows = [r[:2] for r in awkward_rows]
    words = [f"x{rng.randint(0, 5000)}" for _ in range(100)]
    for i in range(40):  # near copies around the threshold
        w = list(words)
        for _ in range(i % 5):
            w[rng.randrange(100)] = "new"
        rows.append((100 + i, " ".join(w)))
    got = chosen_path.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_rows(got, "doc_id", "class_id", "n_links", "n_text_links") == linked(rows)
    assert chosen_path.recall() > 0.999


def test_common():
    rng = np.random.default_rng(1)
    for n in (2, 5, 30):
        sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(n)]
        want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
        assert chosen_path.common(sets).tolist() == want


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)]
    pairs += [(500, j) for j in range(501, 600)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = components.connected(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"))
    assert dict(as_rows(got, "id", "root")) == root


# --- repeated passages --------------------------------------------------------------------


def plain_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        kept = bytes(x for x, c in zip(b, cover[:-1]) if not c)
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("together, length", [(1024, 400), (2, 400), (1024, 64)])
def test_repeated_passages(awkward, awkward_rows, together, length, monkeypatch):
    monkeypatch.setattr(suffix_arrays, "TOGETHER", together)
    monkeypatch.setattr(suffix_arrays, "SHARD_BYTES", 1 << 14)
    monkeypatch.setattr(suffix_arrays, "STEP", 1 << 13)
    want = [(r[0], *x) for r, x in zip(awkward_rows, plain_removal([r[1] for r in awkward_rows], length))]
    got = suffix_arrays.remove_repeats(awkward, length)
    assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for turn in range(60):
        depth = [9, 20, 64, 130, 200][turn % 5]
        pool = rng.integers(97, 97 + [2, 4, 20][turn % 3], 700, dtype=np.uint8)
        parts = [pool[s : s + k] for s, k in zip(rng.integers(0, 200, 4), rng.integers(0, 420, 4))]
        data, starts = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        if not len(data):
            continue
        windows = np.zeros(len(data), bool)
        for a, b in zip(starts[:-1], starts[1:]):
            windows[a : max(a, b - depth + 1)] = True
        count = Counter(data[i : i + depth].tobytes() for i in np.flatnonzero(windows))
        got, _ = suffix_arrays.repeated_windows(data, starts, windows, depth)
        assert got.tolist() == [bool(windows[i]) and count[data[i : i + depth].tobytes()] > 1 for i in range(len(data))]
        order, _ = suffix_arrays.suffix_array(data, depth)
        heads = [data[i : i + depth].tobytes().ljust(depth, b"\0") for i in order]
        assert heads == sorted(heads)


# --- link graph ---------------------------------------------------------------------------


def test_propagation(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "d", 3), ("d", "a", 1), ("e", "d", 1)]
    out = Counter()
    for s, _, n in links:
        out[s] += n
    table = spark.createDataFrame([("trust", s, t, n / out[s]) for s, t, n in links], "kind string, src string, dst string, share double")
    seeds = spark.createDataFrame([("trust", "a", 0.75), ("trust", "e", 0.25)], "kind string, host string, share double")
    score = {"a": 0.15 * 0.75, "e": 0.15 * 0.25}
    start = dict(score)
    for _ in range(12):
        new = Counter(start)
        for s, t, n in links:
            new[t] += 0.85 * score.get(s, 0) * n / out[s]
        score = new
    got = dict(as_rows(link_graph.propagate(seeds, table, 12), "host", "score"))
    assert got == pytest.approx({k: v for k, v in score.items() if v})


def test_links_spread_trust_and_distrust(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [
        (1, "http://good.com/", link("fine.org")), (2, "http://fine.org/a", ""), (3, "http://evil.example.com/en/", ""),
        (4, "http://shady.org/", link("evil.example.com")), (5, "http://alone.org/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in link_graph.judge(pages, rounds=4).collect()}
    assert got == {
        1: ("com/", "allow"), 2: (None, "allow"), 3: ("example.com/en/", "block"), 4: (None, "block"), 5: (None, "allow"),
    }


def test_a_long_chain_of_links_is_followed_to_its_end(spark):
    """Thirty hosts, each linking to the next, the last to a blocked one: all are distrusted."""
    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [(i, f"http://h{i}.org/", link(f"h{i + 1}.org" if i < 29 else "evil.example.com")) for i in range(30)]
    rows += [(30, "http://evil.example.com/en/", "x" * 2_500_000), (31, "http://far.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in link_graph.judge(pages).collect()}
    assert got == {i: "block" for i in range(31)} | {31: "allow"}
