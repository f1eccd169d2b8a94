"""Damaged conversations repaired at the least cost, by a Viterbi pass that runs in parallel.

A conversation's roles must read ``(s?(ua)+)?`` (initials of system, user, assistant). Each row is
kept (0), given another role (1) or deleted (2), and empty turns may be inserted anywhere (5).
Blank and repeated rows must go; a truncated row that stays costs 5. That is a shortest path over
four states: nothing written yet, after the system turn, after a user turn, after an assistant
turn. The audit is the path's edits ``D I K R``; of the cheapest the least in ASCII is taken.

How it runs on conversations of any length:

1.  Equal rows of a turn become one row with a number of copies, and rows are dealt by range, so
    that a large conversation lies in several tasks. A task cuts its rows into *chunks* of one
    conversation and at most ``CHUNK`` rows, a byte each.
2.  Backward costs (from a place to the end) are computed in every chunk at once. Only the last
    chunk of a conversation knows its end; the others start from a speculative vector of zeros.
3.  Fix-up passes: a chunk whose successor begins with other costs than it assumed is run again,
    from the true ones, until its own vector differs from the one it had by a constant only (rank
    convergence); the rest of the chunk then differs by that constant as well and is not run. The
    passes end when no chunk changes. Vectors are kept less their minimum and the constants are
    added up, so costs of whole conversations are sums over chunks.
4.  With its costs right up to a constant, each chunk traces the least audit from every state;
    stitching the chunks' end states picks the one that applies.

Vectors without their minimum take few values, so steps are looked up by (vector, row) and a row
costs two lookups. Chunk rows and the stitching stream through tasks; a digest of a repaired
conversation is one sequential computation and streams its texts through one task.

Defined results: nulls in ``conv_id, turn, role, text`` count as one space wherever text is made
of them; a null ``conv_id`` is a conversation of its own and null turns come first. Rows of one
turn go by role, then by the digest of their text. Rows whose role has another initial than s, u
and a cannot be kept as they are. Other columns are not read. A conversation of which no row is
left has zeros and an empty audit; no rows give no conversations.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flaskmill.llm.texts import shared_rows
from flaskmill.operators.skew import join_spread

#: Rows of a chunk at most.
CHUNK = 1 << 18
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

START, SYSTEM, USER, ASSISTANT = range(4)
#: Initial of a row's role, as it is coded; a truncated row adds 4, a row that must go is GONE.
CLASSES = {"s": 0, "u": 1, "a": 2}
OTHER, GONE = 3, 8
#: The state that a kept row of a class leads to, by the state before; None where it may not stand.
KEPT = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None,) * 4)
#: The state that an inserted turn, or one with another role, leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs behind the last row: nothing, two turns, one turn, nothing.
END = (0, 2 * INSERT, INSERT, 0)
UNKNOWN = (0, 0, 0, 0)


def _plain(costs) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least for c in costs), least


def _edits(state: int, code: int, after):
    """(letter, cost to the end, next state) of what may be done with a row, least letter first."""
    yield "D", DELETE + after[state], state
    if code != GONE:
        late = TRUNCATED if code & 4 else 0
        kept = KEPT[code & 3][state]
        if kept is not None:
            yield "K", KEEP + late + after[kept], kept
        yield "R", REROLE + late + after[NEXT[state]], NEXT[state]


class Steps:
    """Remembered steps: costs before a row from those behind it, and the edits between them."""

    def __init__(self):
        self.costs: dict = {}
        self.moves: dict = {}

    def before(self, code: int, after: tuple) -> tuple[tuple, int]:
        """Costs before a row (less their minimum, and that minimum), turns inserted before the
        row included."""
        found = self.costs.get((code, after))
        if found is None:
            own = [min(cost for _, cost, _ in _edits(s, code, after)) for s in range(4)]
            user, assistant = own[USER], own[ASSISTANT]
            own[USER] = min(user, INSERT + assistant)
            own[ASSISTANT] = min(assistant, INSERT + user)
            own[START] = min(own[START], INSERT + own[USER])
            own[SYSTEM] = min(own[SYSTEM], INSERT + own[USER])
            found = self.costs[code, after] = _plain(own)
        return found

    def move(self, code: int, after: tuple, state: int) -> tuple[str, int]:
        """Least letters of a cheapest way through inserted turns and a row, and the next state."""
        found = self.moves.get((code, after, state))
        if found is None:
            costs, least = self.before(code, after)
            here, letters = state, ""
            while True:
                ways = [(letter, to) for letter, cost, to in _edits(here, code, after) if cost == costs[here] + least]
                if costs[here] == INSERT + costs[NEXT[here]]:
                    ways.append(("I", None))
                letter, to = min(ways, key=lambda w: w[0])
                letters += letter
                if to is not None:
                    break
                here = NEXT[here]
            found = self.moves[code, after, state] = (letters, to)
        return found


STEPS = Steps()


def backward(codes: bytes, end: tuple, old_end: tuple | None = None, old=None) -> tuple[tuple, int]:
    """Costs before the first row: a vector less its minimum, and what is to be added to it.

    With the ``end`` of an earlier run and its result ``old``, stops where the two runs' vectors
    are the same: what lies before only shifts by a constant.
    """
    vector, total = end, 0
    if old is None:
        for code in reversed(codes):
            vector, least = STEPS.before(code, vector)
            total += least
        return vector, total
    was, were = old_end, 0
    for code in reversed(codes):
        if vector == was:
            return old[0], old[1] + total - were
        vector, least = STEPS.before(code, vector)
        was, then = STEPS.before(code, was)
        total, were = total + least, were + then
    return vector, total


def trace(codes: bytes, copies: list[int], end: tuple, state: int) -> tuple[str, int]:
    """Least audit of a chunk entered in ``state``, and the state it is left in."""
    vectors, vector = [], end
    for code in reversed(codes):
        vectors.append(vector)
        vector, _ = STEPS.before(code, vector)
    out = []
    for code, n, after in zip(codes, copies, reversed(vectors), strict=True):
        letters, state = STEPS.move(code, after, state)
        out.append(letters)
        if n > 1:
            out.append("D" * (n - 1))
    return "".join(out), state


def closing(state: int) -> str:
    """Turns inserted behind the last row."""
    return "I" * (END[state] // INSERT)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, conv (as a key), turn, role, text, copies (0: dropped) after the seeded damage."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = (
        F.when(fault == 1, F.lit(""))
        .when(fault == 2, F.regexp_replace(space("text"), "[.!?]", ""))
        .otherwise(space("text"))
    )
    return conversations.select(
        "conv_id",
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, F.lit("user")).otherwise(space("role")).alias("role"),
        text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _runs(damaged: DataFrame) -> DataFrame:
    """Equal rows of a turn as one, without its text: copies, what is wrong with it, whether role
    and text were seen in an earlier turn."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    runs = shared_rows(
        damaged.where(F.col("copies") > 0)
        .withColumns({"digest": F.md5("text"), "last": last})
        .withColumns(
            {
                "blank": F.col("last") == "",
                "truncated": ~F.col("last").isin("", ".", "!", "?"),
                "said": F.md5(F.concat_ws("\x00", F.hex("conv"), F.hex("role"), "digest")),
            }
        )
        .groupBy("conv", "turn", "role", "digest", "said", "blank", "truncated")
        .agg(F.sum("copies").alias("copies"))
    )
    earlier = (
        runs.groupBy("said")
        .agg(F.count("*").alias("turns"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("earliest"))
        .where(F.col("turns") > 1)
        .select("said", "earliest")
    )
    seen = F.struct(F.col("turn").isNotNull(), F.col("turn")) > F.col("earliest")
    return join_spread(runs, earlier, "said", ["turn"]).withColumn("seen", F.coalesce(seen, F.lit(False)))


ORDER = ["turn", "role", "digest"]
CHUNKS = (
    "part int, place int, conv string, codes binary, copies array<long>, extra long, head string, tail string, "
    "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long"
)


def _chunks(size: int):
    def cut(batches):
        part, place, chunk = TaskContext.get().partitionId(), 0, None

        def close():
            nonlocal place
            row = chunk | {"part": part, "place": place, "codes": bytes(chunk["codes"])}
            place += 1
            return row

        arrow, rows = None, []
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for conv, turn, role, n, blank, truncated, seen in zip(
                *(columns[c] for c in ("conv", "turn", "role", "copies", "blank", "truncated", "seen")), strict=True
            ):
                initial = role[:1]
                if chunk is None or conv != chunk["conv"] or len(chunk["codes"]) >= size:
                    if chunk is not None:
                        rows.append(close())
                    chunk = {
                        "conv": conv, "codes": bytearray(), "copies": [], "extra": 0, "head": initial, "tail": None, "blank": 0,
                        "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None,
                    }
                if chunk["tail"] is not None and chunk["tail"] + initial not in ("su", "ua", "au"):
                    chunk["illegal"] += 1
                chunk["illegal"] += n - 1
                chunk["extra"] += n - 1
                chunk["tail"] = initial
                gone = blank or seen
                chunk["codes"].append(GONE if gone else CLASSES.get(initial, OTHER) + 4 * truncated)
                chunk["copies"].append(n)
                chunk["blank"] += n if blank else 0
                chunk["duplicate"] += 0 if blank else n - (not seen)
                chunk["truncated"] += int(truncated and not gone)
                if turn is not None and turn != chunk["high"]:
                    chunk["turns"] += 1
                    chunk["low"] = turn if chunk["low"] is None else chunk["low"]
                    chunk["high"] = turn
            if len(rows) >= 256:
                yield _batch(rows, CHUNK_TYPE)
                rows = []
        if chunk is not None:
            rows.append(close())
        if rows:
            yield _batch(rows, CHUNK_TYPE)

    return cut


CHUNK_TYPE = pa.schema(
    [
        ("part", pa.int32()), ("place", pa.int32()), ("conv", pa.string()), ("codes", pa.binary()),
        ("copies", pa.list_(pa.int64())), ("extra", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
        *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")),
    ]
)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _numbered(chunks: DataFrame) -> DataFrame:
    """Adds ``at`` (chunks of a conversation have numbers in a row), ``first`` and ``last``."""
    parts = chunks.groupBy("part").agg(F.count("*").alias("n"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    chunks = chunks.join(F.broadcast(parts), "part")  # a row for each task of the step before
    chunks = chunks.withColumn("at", F.col("ahead") + F.col("place")).drop("part", "place", "ahead")
    ends = chunks.groupBy("conv").agg(F.min("at").alias("from"), F.max("at").alias("to"))
    return (
        chunks.join(ends, "conv")
        .withColumns({"first": F.col("at") == F.col("from"), "last": F.col("at") == F.col("to")})
        .drop("from", "to")
    )


COSTS = "at long, conv string, end array<int>, costs array<int>, total long"
COST_TYPE = pa.schema(
    [
        ("at", pa.int64()), ("conv", pa.string()), ("end", pa.list_(pa.int32())),
        ("costs", pa.list_(pa.int32())), ("total", pa.int64()),
    ]
)


def _run(batches):
    """Costs of chunks: from ``want`` where that is known, else from the conversation's end or,
    inside it, from the speculative vector."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["want"] is not None:
                end = tuple(row["want"])
                costs, total = backward(row["codes"], end, tuple(row["end"]), (tuple(row["costs"]), row["total"]))
            else:
                end = END if row["last"] else UNKNOWN
                costs, total = backward(row["codes"], end)
            out.append({"at": row["at"], "conv": row["conv"], "end": end, "costs": costs, "total": total})
        yield _batch(out, COST_TYPE)


def _settled(chunks: DataFrame) -> DataFrame:
    """Costs of every chunk from the true costs behind it, up to a constant."""
    none = lambda kind: F.lit(None).cast(kind)
    state = shared_rows(
        chunks.select(
            "at", "conv", "codes", "last",
            *(none("array<int>").alias(n) for n in ("want", "end", "costs")), none("long").alias("total"),
        ).mapInArrow(_run, COSTS)
    )
    alone = chunks.where(F.col("first") & F.col("last")).select("at")
    done, moving = state.join(alone, "at", "left_semi"), shared_rows(state.join(alone, "at", "left_anti"))
    while True:
        behind = moving.select("conv", (F.col("at") - 1).alias("at"), F.col("costs").alias("want"))
        stale = moving.join(behind, ["conv", "at"]).where(F.col("want") != F.col("end"))
        again = shared_rows(
            stale.join(chunks.select("at", "codes", "last"), "at")
            .select("at", "conv", "codes", "last", "want", "end", "costs", "total")
            .mapInArrow(_run, COSTS)
        )
        if again.isEmpty():
            return done.unionByName(moving)
        moving = shared_rows(moving.join(again, "at", "left_anti").unionByName(again))


TRACED = "at long, audits array<string>, states array<int>"


def _trace(batches):
    schema = pa.schema([("at", pa.int64()), ("audits", pa.list_(pa.string())), ("states", pa.list_(pa.int32()))])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            starts = [START] if row["first"] else range(4)
            found = [trace(row["codes"], row["copies"], tuple(row["end"]), s) for s in starts]
            out.append({"at": row["at"], "audits": [a for a, _ in found], "states": [s for _, s in found]})
        yield _batch(out, schema)


REPAIRS = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNTED = ("blank", "duplicate", "truncated", "illegal")
LONGEST = (1 << 63) - 1


def _stitch(batches):
    """Chunks of whole conversations, in order: sums, and the audits that fit each other."""
    schema = pa.schema(
        [("conv", pa.string()), *((n, pa.int64()) for n in ("gaps", *COUNTED, "cost")), ("audit", pa.string())]
    )
    one, out = None, []

    def close():
        gaps = one["high"] - one["low"] + 1 - one["turns"] if one["low"] is not None else 0
        audit = "".join(one["audit"]) + closing(one["state"])
        own = {n: one[n] for n in ("conv", *COUNTED, "cost")}
        return own | {"gaps": min(gaps, LONGEST), "audit": audit}

    for batch in batches:
        for row in batch.to_pylist():
            if one is None or row["conv"] != one["conv"]:
                if one is not None:
                    out.append(close())
                one = dict.fromkeys((*COUNTED, "turns"), 0) | {
                    "conv": row["conv"], "cost": row["costs"][START], "state": START, "audit": [], "tail": None,
                    "low": None, "high": None,
                }
            for n in (*COUNTED, "turns"):
                one[n] += row[n]
            if one["tail"] is not None and one["tail"] + row["head"] not in ("su", "ua", "au"):
                one["illegal"] += 1
            one["tail"] = row["tail"]
            if row["low"] is not None:
                if one["low"] is None:
                    one["low"] = row["low"]
                elif one["high"] == row["low"]:
                    one["turns"] -= 1
                one["high"] = row["high"]
            one["cost"] += row["total"] + DELETE * row["extra"]
            at = 0 if len(row["audits"]) == 1 else one["state"]
            one["audit"].append(row["audits"][at])
            one["state"] = row["states"][at]
        if len(out) >= 1000:
            yield _batch(out, schema)
            out = []
    if one is not None:
        out.append(close())
    if out:
        yield _batch(out, schema)


def repairs(damaged: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit of conversations with rows."""
    runs = shared_rows(_runs(damaged).select("conv", *ORDER, "copies", "blank", "truncated", "seen"))
    dealt = runs.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    chunks = shared_rows(_numbered(shared_rows(dealt.mapInArrow(_chunks(chunk), CHUNKS))))
    costs = shared_rows(_settled(chunks))
    traced = (
        chunks.select("at", "codes", "copies", "first")
        .join(costs.select("at", "end"), "at")
        .select("at", "codes", "copies", "first", "end")
        .mapInArrow(_trace, TRACED)
    )
    whole = (
        chunks.drop("codes", "copies", "first", "last")
        .join(costs.drop("end", "conv"), "at")
        .join(traced, "at")
        .repartition("conv")
        .sortWithinPartitions("conv", "at")
    )
    return shared_rows(whole.mapInArrow(_stitch, REPAIRS))


REPAIRED = "conv string, place long, edit string, turn long, role string, text string"


def _apply(batches):
    """Walk each conversation's audit along its rows: the turns that stand afterwards, in order.

    Rows come by conversation, its audit first.
    """
    schema = pa.schema(
        [
            ("conv", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()),
            ("role", pa.string()), ("text", pa.string()),
        ]
    )
    conv, audit, at, state, place, out, size = None, "", 0, START, 0, [], 0

    def write(edit, turn, role, text):
        nonlocal place, size
        out.append({"conv": conv, "place": place, "edit": edit, "turn": turn, "role": role, "text": text})
        place, size = place + 1, size + len(text)

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = NEXT[state], at + 1
            write("I", None, ROLE[state], "")

    for batch in batches:
        columns = [batch.column(n) for n in ("conv", "audit", "copies", "turn", "role", "text")]
        for key, letters, n, turn, role, text in zip(*(c.to_pylist() for c in columns), strict=True):
            if letters is not None:
                inserted()
                conv, audit, at, state, place = key, letters, 0, START, 0
                continue
            inserted()
            edit = audit[at]
            at += n
            if edit == "K":
                state = KEPT[CLASSES[role[:1]]][state]
                write(edit, turn, role, text)
            elif edit == "R":
                state = NEXT[state]
                write(edit, turn, ROLE[state], text)
            if len(out) >= 4000 or size >= 1 << 22:
                yield _batch(out, schema)
                out, size = [], 0
    inserted()
    if out:
        yield _batch(out, schema)


def repaired_turns(damaged: DataFrame, found: DataFrame) -> DataFrame:
    """conv, place, edit (I, K or R), turn, role, text of the repaired conversations.

    A conversation's rows are in order in one partition, one after another.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = damaged.where(F.col("copies") > 0).select(
        "conv", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("digest"), none("string").alias("audit"),
        "copies", "text",
    )
    audits = found.select(
        "conv", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"),
        none("string").alias("digest"), "audit", none("long").alias("copies"), none("string").alias("text"),
    )
    ordered = audits.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "kind", *ORDER)
    return ordered.select("conv", "audit", "copies", "turn", "role", "text").mapInArrow(_apply, REPAIRED)


def _digest(batches):
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string()), ("n_repaired", pa.int64())])
    conv, sha, n, out = None, None, 0, []
    for batch in batches:
        for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if sha is None or key != conv:
                if sha is not None:
                    out.append({"conv": conv, "repaired_sha256": sha.hexdigest(), "n_repaired": n})
                conv, sha, n = key, hashlib.sha256(), 0
            sha.update((b"\n" if n else b"") + f"{role}:{text}".encode())
            n += 1
        if len(out) >= 1000:
            yield _batch(out, schema)
            out = []
    if sha is not None:
        out.append({"conv": conv, "repaired_sha256": sha.hexdigest(), "n_repaired": n})
    if out:
        yield _batch(out, schema)


NOTHING = hashlib.sha256(b"").hexdigest()


def repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_repaired
    of every conversation after the seeded damage."""
    damaged = damage(conversations)
    found = repairs(damaged, chunk)
    digests = repaired_turns(damaged, found).mapInArrow(_digest, "conv string, repaired_sha256 string, n_repaired long")
    every = damaged.groupBy("conv").agg(F.max("conv_id").alias("conv_id"))
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long")).alias(n)
    return (
        every.join(found, "conv", "left")
        .join(digests, "conv", "left")
        .select(
            "conv_id",
            *(zero(n) for n in ("gaps", *COUNTED, "cost")),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"),
            zero("n_repaired"),
        )
    )


def repair_sql() -> str:
    """The same in DuckDB, one row of every conversation at a time, backward and then forward."""
    spaces = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    late = f"CASE WHEN r.truncated THEN {TRUNCATED} ELSE 0 END"
    own = []
    for state in (START, SYSTEM, USER, ASSISTANT):
        ways = [f"{DELETE} + b[{state + 1}]", f"CASE WHEN NOT gone THEN late + {REROLE} + b[{NEXT[state] + 1}] END"]
        for initial, kept in ((i, KEPT[c][state]) for i, c in CLASSES.items()):
            if kept is not None:
                ways.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN late + {KEEP} + b[{kept + 1}] END")
        own.append(f"least({', '.join(ways)})")
    may_keep = " OR ".join(
        f"(initial = '{i}' AND state = {s} AND late + {KEEP} + after[{KEPT[c][s] + 1}] = before[{s + 1}])"
        for i, c in CLASSES.items() for s in range(4) if KEPT[c][s] is not None
    )
    to_next = f"[{', '.join(map(str, NEXT))}][state + 1]"
    kept_to = "CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END"
    crc = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(place, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), "
        "lambda x, n: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    )
    return rf"""
WITH RECURSIVE given AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations
), faulty AS (SELECT *, {crc} % 20 AS fault FROM given),
damaged AS (
  SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM faulty
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    left(role, 1) AS initial, rtrim(text, {spaces}) AS bare FROM damaged
), rows AS (
  SELECT *, bare = '' AS blank, bare <> '' AND right(bare, 1) NOT IN ('.', '!', '?') AS open,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
    lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM ordered
), flagged AS (
  SELECT *, blank OR again AS gone, open AND NOT again AS truncated FROM rows
), costs AS (
  SELECT conv, max(i) + 1 AS i, {list(END)}::BIGINT[] AS b FROM flagged GROUP BY conv
  UNION ALL
  SELECT conv, i, [least(c[1], {INSERT} + u), least(c[2], {INSERT} + u), u, least(c[4], {INSERT} + c[3])]
  FROM (SELECT conv, i, c, least(c[3], {INSERT} + c[4]) AS u FROM (
    SELECT conv, i, [{", ".join(own)}] AS c FROM (
      SELECT r.conv, r.i, r.gone, r.initial, {late} AS late, costs.b
      FROM costs JOIN flagged r ON r.conv = costs.conv AND r.i = costs.i - 1)))
), walk AS (
  SELECT conv, 1::BIGINT AS i, 0 AS state, '' AS audit, []::VARCHAR[] AS lines FROM flagged GROUP BY conv
  UNION ALL
  SELECT conv, CASE WHEN edit = 'I' THEN i ELSE i + 1 END,
    CASE edit WHEN 'D' THEN state WHEN 'K' THEN {kept_to} ELSE {to_next} END, audit || edit,
    CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, CASE {to_next} WHEN 2 THEN 'user' ELSE 'assistant' END || ':'
        || CASE edit WHEN 'I' THEN '' ELSE text END) END
  FROM (
    SELECT *, CASE
      WHEN after IS NOT NULL AND {DELETE} + after[state + 1] = before[state + 1] THEN 'D'
      WHEN before[state + 1] = {INSERT} + before[{to_next} + 1] THEN 'I'
      WHEN NOT gone AND ({may_keep}) THEN 'K' WHEN after IS NOT NULL THEN 'R' END AS edit
    FROM (
      SELECT w.*, r.gone, r.initial, r.role, r.text, {late} AS late, here.b AS before, behind.b AS after
      FROM walk w JOIN costs here ON here.conv = w.conv AND here.i = w.i
      LEFT JOIN flagged r ON r.conv = w.conv AND r.i = w.i
      LEFT JOIN costs behind ON behind.conv = w.conv AND behind.i = w.i + 1))
  WHERE edit IS NOT NULL
), finished AS (
  SELECT conv, audit, lines FROM walk QUALIFY row_number() OVER (PARTITION BY conv ORDER BY length(audit) DESC) = 1
), counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (illegal) AS illegal FROM flagged GROUP BY conv
)
SELECT g.conv_id, {", ".join(f"coalesce({n}, 0)::BIGINT AS {n}" for n in ("gaps", *COUNTED))},
  coalesce(b[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256, coalesce(len(lines), 0)::BIGINT AS n_repaired
FROM (SELECT DISTINCT conv, conv_id FROM given) g LEFT JOIN counts USING (conv) LEFT JOIN finished USING (conv)
LEFT JOIN costs ON costs.conv = g.conv AND costs.i = 1
"""
