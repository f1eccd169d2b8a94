"""Chat training text in budgeted windows of whole turns, with DataFrame functions only.

Prefix sums of turn tokens cut every conversation: a turn belongs to the window of the room
(a stretch of ``budget - history - system`` tokens) that it lies in, and a turn over the edge of
two rooms is a window of its own. So turns are never cut, windows are found without looking at
their neighbours, and no window exceeds the budget unless a single turn or the system turn does.
Every window but the first opens with the system turn and the last turns of the window before
it, as far as the history's limits go. Both are context: the loss mask covers assistant turns
only where they are new, so each is a target once.

A conversation may be larger than one task should sort. Its rows are dealt by range, sums are
taken inside each part, and the parts' totals (a row for each part) are summed before them.

Defined results: null text and role count as empty, a null ``conv_id`` is a conversation of its
own, null turns come first. Rows of one turn go by role, then by the digest of their text;
repeated rows are turns of their own. Only the first row of a conversation can be its system
turn. Columns other than ``conv_id, turn, role, text`` are not read. No rows give no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flaskmill.llm.texts import shared_rows
from flaskmill.operators.skew import join_spread

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET = 512
HISTORY_TURNS = 2
HISTORY_TOKENS = 128
#: Tokens of a turn's marks.
MARKS = 4
#: What a turn's tokens are counted by where the caller brings no count: runs of letters, numbers
#: and signs as a subword vocabulary would cut them.
PIECES = r"[A-Za-z]{1,6}|[0-9]{1,3}|[^A-Za-z0-9\x20\x09-\x0D]{1,2}"

ASSISTANT, SYSTEM = "assistant", "system"
CONTROL = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    """No ``<|`` is left in the text, so it holds no mark: a backslash goes between the two signs,
    one more than there are."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """One line, without marks."""
    return F.replace(F.replace(escape(role), F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~")))


def _turns(conversations: DataFrame, tokens: Column | None) -> DataFrame:
    """The turns with an id of their own (``row``), written once: later steps move ids only."""
    counted = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(PIECES)) if tokens is None else tokens
    return shared_rows(
        conversations.select(
            "conv_id",
            F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
            (F.coalesce(counted, F.lit(0)) + MARKS).cast("long").alias("tokens"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


ORDER = ["turn", "role", "digest", "row"]


def _placed(turns: DataFrame) -> DataFrame:
    """Rows (without texts) with place ``at``, tokens ``before`` it and what is known of the whole
    conversation: ``total`` rows and its first row ``head``."""
    narrow = turns.select("conv", "turn", "role", F.md5("text").alias("digest"), "row", "tokens")
    dealt = shared_rows(
        narrow.repartitionByRange("conv", *ORDER).withColumn("part", F.spark_partition_id())
    )
    inside = W.partitionBy("conv", "part").orderBy(*ORDER)
    before = W.unboundedPreceding, -1
    rows = dealt.withColumns(
        {
            "nth": F.row_number().over(inside) - 1,
            "within": F.coalesce(F.sum("tokens").over(inside.rowsBetween(*before)), F.lit(0)),
        }
    )
    upto, whole = W.partitionBy("conv").orderBy("part"), W.partitionBy("conv")
    sums = (
        dealt.groupBy("conv", "part")
        .agg(
            F.count("*").alias("n"),
            F.sum("tokens").alias("sum"),
            F.min(F.struct(*ORDER, "tokens")).alias("first"),
        )
        .select(
            "conv",
            "part",
            F.coalesce(F.sum("n").over(upto.rowsBetween(*before)), F.lit(0)).alias("n_before"),
            F.coalesce(F.sum("sum").over(upto.rowsBetween(*before)), F.lit(0)).alias("sum_before"),
            F.sum("n").over(whole).alias("total"),
            F.first("first").over(upto).alias("head"),
        )
    )
    return rows.join(sums, ["conv", "part"]).select(
        "conv",
        "row",
        "tokens",
        "total",
        "head",
        (F.col("n_before") + F.col("nth")).alias("at"),
        (F.col("sum_before") + F.col("within")).alias("before"),
    )


def _pieces(turns: DataFrame, budget: int, history_turns: int, history_tokens: int) -> DataFrame:
    """conv, window (place of its first new turn), slot, row, context: the turns of each window."""
    has_system = F.col("head.role") == SYSTEM
    opening = has_system & (F.col("at") == 0)
    system_tokens = F.when(has_system, F.col("head.tokens")).otherwise(F.lit(0))
    room = F.greatest(F.lit(budget - history_tokens) - system_tokens, F.lit(max(1, budget // 4)))
    rows = (
        _placed(turns)
        .withColumns({"room": room, "system": has_system, "opening": opening})
        .withColumn("start", F.when(opening, F.lit(0)).otherwise(F.col("before") - system_tokens))
        .withColumn("end", F.col("start") + F.when(opening, F.lit(0)).otherwise(F.col("tokens")))
    )
    over = (F.expr("start % room") > 0) & (F.expr("(end - 1) div room") != F.expr("start div room"))
    same = W.partitionBy("conv", "stretch")
    rows = rows.withColumn("stretch", F.expr("start div room") * 2 + over.cast("long")).withColumns(
        {
            "first": F.min("at").over(same),
            "next": F.max("at").over(same) + 1,
            "until": F.max("end").over(same),
        }
    )
    again = (
        (F.col("next") < F.col("total"))
        & ~F.col("opening")
        & (F.col("next") - F.col("at") <= history_turns)
        & (F.col("until") - F.col("start") <= history_tokens)
    )
    opens = F.col("system") & (F.col("at") == F.col("first")) & (F.col("at") > 0)
    piece = lambda window, slot, row, context: F.struct(
        F.col(window).alias("window"), slot.alias("slot"), F.col(row).alias("row"), F.lit(context).alias("context")
    )
    return rows.select(
        "conv",
        F.explode(
            F.array_compact(
                F.array(
                    piece("first", F.col("at"), "row", False),
                    F.when(again, piece("next", F.col("at"), "row", True)),
                    F.when(opens, piece("first", F.lit(-1).cast("long"), "head.row", True)),
                )
            )
        ).alias("piece"),
    ).select("conv", "piece.*")


def windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
    tokens: Column | None = None,
) -> DataFrame:
    """conv_id, window, text, context (turns at its start that are repeated), n_turns, n_tokens,
    loss (start and end of each target in the text, in code points).

    ``window`` is the place of the window's first new turn. ``tokens`` counts a row's tokens; by
    default the pieces of its text are counted.
    """
    turns = _turns(conversations, tokens)
    pieces = _pieces(turns, budget, history_turns, history_tokens)
    # A system turn is taken by every window of its conversation, all other rows by two at most.
    rows = join_spread(
        pieces, turns.select("row", "conv_id", "role", "text", "tokens"), "row", ["window"], "inner"
    )
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumns({"head": head, "body": escape(F.col("text"))}).withColumn(
        "long", F.char_length("head") + F.char_length("body") + len(END)
    )
    order = W.partitionBy("conv", "window").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("long").over(order), F.lit(0)) + F.char_length("head")
    target = ~F.col("context") & (F.col("role") == ASSISTANT)
    turn = F.struct(
        "slot",
        F.concat("head", "body", F.lit(END)).alias("text"),
        F.when(target, F.struct(F.col("begin").alias("start"), (F.col("begin") + F.char_length("body")).alias("end")))
        .alias("loss"),
    )
    return (
        rows.withColumn("begin", begin)
        .groupBy("conv", "window")
        .agg(
            F.max("conv_id").alias("conv_id"),
            F.sort_array(F.collect_list(turn)).alias("turns"),
            F.count_if("context").alias("context"),
            F.count("*").alias("n_turns"),
            F.sum("tokens").alias("n_tokens"),
        )
        .select(
            "conv_id",
            "window",
            F.array_join(F.col("turns.text"), "").alias("text"),
            F.col("context").cast("int").alias("context"),
            "n_turns",
            "n_tokens",
            F.array_compact(F.col("turns.loss")).alias("loss"),
        )
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of each new turn), targets (text under each span of
    the loss mask), formatted_chars: read from the texts of windows alone."""
    found = F.split("text", r"<\|im_end\|>\n", -1)
    new = F.slice(found, F.col("context") + 1, F.size(found) - 1 - F.col("context"))

    def turn(one: Column) -> Column:
        head = F.substring_index(one, "\n", 1)
        return F.struct(
            unescape_role(F.substr(head, F.lit(len(START) + 1))).alias("role"),
            unescape(F.substr(one, F.char_length(head) + 2)).alias("text"),
        )

    span = lambda s: unescape(F.substr(F.col("text"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))
    return formatted.select(
        "conv_id",
        "window",
        F.transform(new, turn).alias("turns"),
        F.transform("loss", span).alias("targets"),
        F.char_length("text").alias("formatted_chars"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    A digest of a whole conversation needs its text in one row, which bounds a conversation to
    two gigabytes here (the windows themselves have no such bound).
    """
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    windows_in_order = F.sort_array(
        F.collect_list(F.struct("window", F.array_join(lines, "").alias("turns"), F.array_join("targets", "").alias("loss")))
    )
    whole = read_turns(formatted).groupBy("conv_id").agg(
        F.sum(F.size("turns")).alias("n_turns"),
        windows_in_order.alias("all"),
        F.sum("formatted_chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
    loss = F.array_join(F.col("all.loss"), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.col("all.turns"), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """The rows of the table and conversation -1, whose texts hold the template's own marks."""
    extra = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def digests_sql() -> str:
    """The same digests in DuckDB: windows by the same sums, nothing parsed back."""
    room = f"greatest({BUDGET - HISTORY_TOKENS} - system_tokens, {BUDGET // 4})"
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')
), counted AS (
  SELECT *, len(regexp_extract_all(text, '{PIECES}')) + {MARKS} AS tokens FROM turns
), ordered AS (
  SELECT *, row_number() OVER o - 1 AS nth, count(*) OVER (PARTITION BY conv_id) AS total,
    coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    first_value(role) OVER o = 'system' AS has_system, first_value(tokens) OVER o AS head_tokens
  FROM counted WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))
), started AS (
  SELECT *, has_system AND nth = 0 AS opening, CASE WHEN has_system THEN head_tokens ELSE 0 END AS system_tokens
  FROM ordered
), roomed AS (
  SELECT *, CASE WHEN opening THEN 0 ELSE before - system_tokens END AS start, {room} AS room FROM started
), ended AS (
  SELECT *, start + CASE WHEN opening THEN 0 ELSE tokens END AS stop FROM roomed
), cut AS (
  SELECT *, (start // room) * 2 + CASE WHEN start % room > 0 AND (stop - 1) // room <> start // room
    THEN 1 ELSE 0 END AS stretch FROM ended
), edged AS (
  SELECT *, min(nth) OVER s AS first, max(nth) OVER s + 1 AS next, max(stop) OVER s AS until
  FROM cut WINDOW s AS (PARTITION BY conv_id, stretch)
), sized AS (
  SELECT *, {len(START) + 1 + len(END)}
    + length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '~', '~0'), chr(10), '~1'))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS chars FROM edged
), totals AS (
  SELECT conv_id, sum(chars * (1 + CASE WHEN next < total AND NOT opening AND next - nth <= {HISTORY_TURNS}
      AND until - start <= {HISTORY_TOKENS} THEN 1 ELSE 0 END)) AS own,
    sum(CASE WHEN opening THEN chars ELSE 0 END) AS head,
    count(DISTINCT first) AS n_windows
  FROM sized GROUP BY conv_id
), digests AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
    coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY nth), '')) AS loss_sha256
  FROM ordered GROUP BY conv_id
)
SELECT d.conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars,
  loss_sha256, CAST(own + head * (n_windows - 1) AS BIGINT) AS formatted_chars, CAST(n_windows AS BIGINT) AS n_windows
FROM digests d JOIN totals t ON d.conv_id IS NOT DISTINCT FROM t.conv_id
"""
