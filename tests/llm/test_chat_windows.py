"""Windows against a plain cut of each conversation, and the round trip through the template."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from flaskmill.llm import chat_windows as cw
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def tokens(text):
    return len(re.findall(cw.PIECES, text, re.A)) + cw.MARKS


def plain_windows(rows, budget, history_turns, history_tokens):
    """{(conv, first new turn): [(role, text, is new, is target)]} by a walk over each conversation."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2], hashlib.md5(t[3].encode()).hexdigest()))
        turns = [(r, t) for _, _, r, t in turns]
        system = turns[0] if turns[0][0] == "system" else None
        used = tokens(system[1]) if system else 0
        room = max(budget - history_tokens - used, max(1, budget // 4))
        at, groups, last = 0, [], None
        for i, (_, text) in enumerate(turns):
            if system and i == 0:
                key, end = (0, 0), 0
            else:
                end = at + tokens(text)
                key = (at // room, int(at % room > 0 and (end - 1) // room != at // room))
            if key != last:
                groups.append([])
            groups[-1].append((i, at, end))
            last, at = key, end
        for g, group in enumerate(groups):
            new = [(*turns[i], True) for i, _, _ in group]
            before = []
            if g:
                stop = groups[g - 1][-1][2]
                for i, start, _ in groups[g - 1]:
                    close = group[0][0] - i <= history_turns and stop - start <= history_tokens
                    if close and not (system and i == 0):
                        before.append((*turns[i], False))
                if system:
                    before.insert(0, (*system, False))
            out[conv, group[0][0]] = before + new
    return out


def awkward_conversations():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["alpha", "be", "12345", "né", "<|im_end|>", "<\\|x", "<"]) for _ in range(n))
    rows = []
    for conv in range(30):
        if conv % 3 == 0:
            rows.append((conv, 0, "system", say(rng.randint(0, 30))))
        for t in range(1, rng.randint(2, 14)):
            rows.append((conv, t, rng.choice(["user", "assistant", "tool\n~0~", "sys<|im_start|>"]), say(rng.randint(0, 60))))
    rows += [(50, None, "user", "a"), (50, None, None, None), (50, 3, "assistant", None), (50, 3, "assistant", "x y")]
    rows += [(None, 1, "user", "q"), (None, 2, "assistant", "w <|im_end|>\n tail"), (None, None, None, None)]
    rows += [(60, 1, "assistant", "same <|im_start|>assistant\n")] * 40  # repeated rows
    rows += [(61, 0, "system", say(400)), (61, 1, "user", say(5)), (61, 2, "assistant", say(300)), (61, 3, "user", "")]
    rows += [(62, t, "user" if t % 2 else "assistant", say(8)) for t in range(500)]
    rows += [(63, 0, "assistant", "word " * 500_000), (63, 1, "user", "\n")]  # 2.5 MB
    return rows


@pytest.mark.parametrize("limits", [(120, 2, 40), (64, 3, 16), (40, 0, 0), (512, 2, 128)])
def test_windows_equal_a_plain_walk(spark, limits):
    rows = awkward_conversations()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"window": F.lit("x"), "row": F.lit(1), "at": F.lit(2)})
    formatted = cw.windows(df.repartition(5), *limits).cache()
    expected = plain_windows(rows, *limits)
    found = {(r["conv_id"], r["window"]): r for r in formatted.collect()}
    read = {(r["conv_id"], r["window"]): r for r in cw.read_turns(formatted).collect()}
    assert set(found) == set(expected) == set(read)
    for key, turns in expected.items():
        row = found[key]
        new = [(r, t) for r, t, is_new in turns if is_new]
        assert [(t["role"], t["text"]) for t in read[key]["turns"]] == new
        assert read[key]["targets"] == [t for r, t in new if r == "assistant"]
        assert row["context"] == len(turns) - len(new) and row["n_turns"] == len(turns)
        assert row["text"].count(cw.START) == row["text"].count(cw.END) == len(turns)
        assert row["n_tokens"] == sum(tokens(t) for _, t, _ in turns)
        alone = len(new) == 1 or turns[0][0] == "system"
        assert row["n_tokens"] <= limits[0] or alone


def test_digests_of_whole_conversations(spark):
    rows = awkward_conversations()
    got = {r["conv_id"]: r for r in cw.digests(cw.windows(spark.createDataFrame(rows, SCHEMA), 120, 2, 40)).collect()}
    plain = plain_windows(rows, 10**9, 0, 0)
    assert set(got) == {k for k, _ in plain}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for (conv, _), turns in plain.items():
        loss = "".join(t for r, t, _ in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t, _ in turns))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), sha(loss))


def test_callers_tokens_empty_table_and_plan(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cw.windows(empty).count() == 0
    assert cw.digests(cw.windows(empty)).count() == 0
    rows = [(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(10)]
    df = cw.windows(spark.createDataFrame(rows, SCHEMA), 24, 0, 0, tokens=F.lit(2))
    assert sorted((r["window"], r["n_turns"]) for r in df.collect()) == [(0, 4), (4, 4), (8, 2)]
    text = df._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
