"""Repairs against a plain search over whole conversations, for chunks of any size."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from flaskmill.llm import conversation_repair as cr
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "n_repaired")
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    """{conv: rows after damage, in order}; keeps conversations of which nothing is left."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        by[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {conv: sorted(kept, key=key) for conv, kept in by.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit, repaired turns) by a forward search: a state is the initials so far, as
    far as they matter."""
    legal = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                for letter, role in (("u", "user"), ("a", "assistant")):
                    if letter in legal[state]:
                        new = (cost + 5, audit + "I", turns + [f"{role}:"])
                        if letter not in best or new[:2] < best[letter][:2]:
                            best[letter] = new
        return best

    best = with_inserts({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, found, strict=True):
        after = {}

        def offer(state, new, after=after):
            if state not in after or new[:2] < after[state][:2]:
                after[state] = new

        for state, (cost, audit, turns) in best.items():
            offer(state, (cost + 2, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            late = 5 if fault == "truncated" else 0
            if role[:1] in legal[state]:
                offer(legal[state][role[:1]], (cost + late, audit + "K", turns + [f"{role}:{text}"]))
            for letter, name in (("u", "user"), ("a", "assistant")):
                if letter in legal[state]:
                    offer(letter, (cost + late + 1, audit + "R", turns + [f"{name}:{text}"]))
        best = with_inserts(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])


def plain(rows):
    out = {}
    for conv, kept in damaged(rows).items():
        found = faults(kept)
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit, repaired = cheapest(kept, found)
        near = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        kinds = [found.count(k) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *kinds, near, cost, audit, sha, len(repaired))
    return out


def conversations():
    rng = random.Random(11)
    end = lambda: rng.choice([".", "!", "?\n", "", "  ", "."])
    rows = []
    for conv in range(250):
        for t in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "umpire"])
            rows.append((conv, t * rng.choice([1, 1, 2]), role, rng.choice(["", " ", "x", "say", "né"]) + str(rng.randint(0, 9)) + end()))
    rows += [(300, None, None, None), (300, None, "user", "a."), (300, 4, "assistant", "b."), (None, 1, "user", "q."), (None, None, None, None)]
    rows += [(301, 1, "assistant", "again.")] * 30  # repeated rows
    rows += [(302, t, "user", "again and again.") for t in range(50)]  # repeated texts
    rows += [(303, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(40)]  # all truncated
    rows += [(304, t, "assistant" if t % 2 else "user", f"turn {t}.") for t in range(90)]
    rows += [(305, t, "user", f"turn {t}.") for t in range(61)]
    rows += [(306, t, " ", "\t") for t in range(40)]  # nothing but deletions
    rows += [(307, 0, "user", "word " * 500_000), (307, 1, "assistant", "done.")]  # 2.5 MB
    rows += [(308, -(2**63), "user", "low."), (308, 2**63 - 1, "assistant", "high.")]
    rows += [(c, 5, "user", "alone.") for c in range(400, 460)]  # some lose their only row
    return rows


@pytest.fixture(scope="module")
def expected():
    return plain(conversations())


@pytest.mark.parametrize("chunk", [1, 3, 16, cr.CHUNK])
def test_repairs_equal_a_plain_search(spark, expected, chunk):
    df = spark.createDataFrame(conversations(), SCHEMA).withColumns({"conv": F.lit("x"), "copies": F.lit(9)})
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in cr.repair(df.repartition(5), chunk).collect()}
    assert set(got) == set(expected)
    for conv, row in expected.items():
        assert got[conv][1:] == row[1:], conv
        assert got[conv][0] == min(row[0], cr.LONGEST), conv


def test_some_conversations_lose_all_rows(expected):
    assert any(row == (0, 0, 0, 0, 0, 0, "", cr.NOTHING, 0) for row in expected.values())


def test_reruns_stop_where_vectors_differ_by_a_constant():
    rng = random.Random(5)
    for _ in range(300):
        codes = bytes(rng.randint(0, 8) for _ in range(rng.randint(0, 40)))
        old = cr.backward(codes, cr.UNKNOWN)
        assert cr.backward(codes, cr.END, cr.UNKNOWN, old) == cr.backward(codes, cr.END)
        # Costs of a whole are those of its halves, stitched.
        cut = rng.randint(0, len(codes))
        behind, added = cr.backward(codes[cut:], cr.END)
        front, more = cr.backward(codes[:cut], behind)
        assert (front, added + more) == cr.backward(codes, cr.END)


def test_repaired_turns_are_legal_and_empty_tables_work(spark):
    df = spark.createDataFrame(conversations(), SCHEMA)
    damaged = cr.damage(df)
    rows = cr.repaired_turns(damaged, cr.repairs(damaged, 8)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["conv"]].append((r["place"], r["role"][:1]))
    assert by
    for turns in by.values():
        assert [p for p, _ in turns] == list(range(len(turns)))
        assert re.fullmatch("s?(ua)+", "".join(i for _, i in turns))
    assert cr.repair(spark.createDataFrame([], SCHEMA)).count() == 0
