"""Divergences against plain arithmetic over all kept terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from flaskmill.llm import source_divergence as sd
from pyspark.sql import functions as F
from rows_of import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows):
    docs = [((lang or "").encode(), (source or "").encode(), text or "") for _, text, lang, source, _ in rows]
    lower = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    terms = [[w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for _, _, t in docs]
    groups = {(lang, source): Counter() for lang, source, _ in docs}
    seen = defaultdict(Counter)
    for (lang, source, _), words in zip(docs, terms, strict=True):
        groups[lang, source].update(words)
        seen[lang].update(set(words))
    out = set()
    for lang in {lang for lang, _ in groups}:
        kept = sorted(w for w, n in seen[lang].items() if n >= sd.LEAST_DOCS)
        own = {s: c for (l, s), c in groups.items() if l == lang}
        whole = sum(own.values(), Counter())

        def weights(count, kept=kept):
            total = sum(count[w] for w in kept)
            return {w: 1 + sd.SCALE * (count[w] + 1) // (total + len(kept)) for w in kept}

        q_lang, p = weights(whole), {s: weights(c) for s, c in own.items()}
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in own:
            pairs = [(-sum(gap(p[s][w], p[o][w]) for w in kept), o) for o in own if o != s]
            best = [(-gap(p[s][w], q_lang[w]), w.encode()) for w in kept if own[s][w] and p[s][w] > q_lang[w]]
            for part, items, most in (("pair", pairs, 10**9), ("term", best, sd.TOP_TERMS)):
                for rank, (value, item) in enumerate(sorted(items)[:most], 1):
                    out.add((lang.decode(), s.decode(), part, item.decode(), -value, rank))
    return out


def documents():
    rng = random.Random(2)
    base = [prose(rng, rng.randint(5, 80)) for _ in range(60)]
    rows = [(i, rng.choice(base), rng.choice(["en", "de", None]), rng.choice(["a", "b", "É", "z~", None]), 1) for i in range(300)]
    rows += [(400 + i, base[0], "en", f"s{i % 7}", 1) for i in range(400)]  # copies over many sources
    rows += [(i, None, "xx", f"t{i}", 1) for i in range(3)] + [(None, "", None, "only", None)]
    rows += [(900, "Once Only words", "yy", "a", 1), (901, "other", "yy", "b", 1)]  # no kept terms
    rows += [(910, "ÀÉÎ aB_cDİ é x \x7fq 東京 東京", "zz", s, 1) for s in "abc"] * 2
    rows += [(920, "long " * 500_000 + "tail", "zz", "long", 1)]  # 2.5 MB
    return rows


def test_audit_equals_plain_arithmetic(spark, monkeypatch):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit("x"), "key": F.lit(1), "n": F.lit(2)})
    got = [tuple(r) for r in sd.audit(df.repartition(4)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(rows)


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_of_sources_add_up(spark, monkeypatch, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    rows = documents()[300:700]
    rows += [(i, prose(random.Random(i), 30), "en", f"s{i % 9}", 1) for i in range(80)]
    assert {tuple(r) for r in sd.audit(spark.createDataFrame(rows, SCHEMA)).collect()} == plain(rows)


def test_weights_beyond_64_bits(one):
    count, total = 10**12, 3 * 10**13
    got = one(sd.weight(F.lit(count).cast("long"), F.lit(total).cast("long"), F.lit(7).cast("long")))
    assert got == 1 + sd.SCALE * (count + 1) // (total + 7)


def test_empty_table(spark):
    assert sd.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_array_sums():
    key, a, b = sd._sums(np.array([3, 1, 3, 1]), np.array([1, 2, 3, 4]), np.array([5, 6, 7, 8]))
    assert key.tolist() == [1, 3] and a.tolist() == [6, 4] and b.tolist() == [14, 12]
