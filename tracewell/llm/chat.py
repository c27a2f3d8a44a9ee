"""Chat formatting by event-sourced reconstruction.

An event log has a row for each event of a conversation: ``conv_id``, ``turn`` (the message's place),
``seq`` (the order of events), ``kind``, ``role`` and ``text``.  Kinds: ``message`` sets a message's text,
``delta`` appends to it, ``edit`` replaces it, ``regenerate`` empties it and discards the later messages
that stood until then.  The log is partitioned by conversation and sorted by turn and sequence; a message
is the last text set and the deltas after it.

``render`` writes each conversation with a mark before and after every turn and escapes whatever in a text
or a role looks like a mark; ``parse`` undoes that.  Texts pass through a task one event at a time and a
formatted conversation leaves it in parts of ``PART_CHARS`` or more characters that end between turns, so a
conversation of any number of turns needs no more memory than its longest message and a part.

Defined results: null texts and roles are empty; events of one turn with equal ``seq`` apply in the order
message, edit, regenerate, delta, then by role and text, so repeated rows apply repeatedly; null conversations form one
conversation, null turns come first and null kinds are messages; texts of any length are one event each and stay whole;
of other columns none is kept, so no name can clash; an empty log gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART_CHARS = 4 << 20
KINDS = ("message", "edit", "regenerate", "delta")
FORMATTED = "conv_id long, part int, n_turns long, formatted string, loss_starts array<int>, loss_ends array<int>"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    """A backslash more in each ``<``, backslashes, ``|``: no ``<|`` is left."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation or part."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def surviving_events(events: DataFrame) -> DataFrame:
    """The events that still count, numbered within their conversation: ``conv_id, turn, role, text, message``."""
    kind = F.coalesce(F.lower("kind"), F.lit("message"))
    rows = events.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"),
        F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 62))).alias("seq"),
        F.array_position(F.array(*map(F.lit, KINDS)), kind).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    discarded = F.max(F.when(F.col("kind") == 3, F.col("seq"))).over(earlier)
    rows = rows.withColumn("discarded", discarded).where("discarded is null or seq > discarded")
    place = ["conv_id", "turn", "seq", "kind", "role", "text"]
    # All windows deal by conversation alone, so that the fold after them finds a conversation in one partition.
    upto = Window.partitionBy("conv_id").orderBy(*place[1:]).rowsBetween(Window.unboundedPreceding, 0)
    turn = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(0, 0)
    rows = rows.withColumn("set", F.sum(F.when(F.col("kind") < 4, 1).otherwise(0)).over(upto))
    return rows.withColumn("message", F.max("set").over(turn)).where("set = message").sortWithinPartitions(*place).select("conv_id", "turn", "kind", "role", "text")


def messages(log: DataFrame, order: list[str], kind: str | None = None) -> DataFrame:
    """A plain table of messages as an event log; ``order`` makes rows that share a turn messages of their own."""
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col(order[0]).asc_nulls_first(), *order[1:]))
    return log.withColumn("seq", number).withColumn("turn", number).withColumn("kind", F.lit(kind or "message"))


def render(events: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Formatted parts of every conversation, in order; the loss spans cover the texts of ``trained_role``."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        conv, part, turn, role, texts = None, 0, None, "", []
        pieces: list[str] = []
        chars, turns, starts, ends, open_ = 0, 0, [], [], False

        def close_turn() -> None:
            nonlocal chars, turns
            if turn is None:
                return
            head, body = f"{START}{escape_role(role)}\n", escape("".join(texts))
            if role == trained_role:
                starts.append(chars + len(head))
                ends.append(chars + len(head) + len(body))
            pieces.extend((head, body, END + "\n"))
            chars += len(head) + len(body) + len(END) + 1
            turns += 1

        def close_part() -> None:
            nonlocal chars, turns, part
            parts.append((conv, part, turns, "".join(pieces), list(starts), list(ends)))
            for x in (pieces, starts, ends):
                x.clear()
            chars, turns, part = 0, 0, part + 1

        for batch in batches:
            for c, t, k, r, x in zip(*(batch[n].to_pylist() for n in ("conv_id", "turn", "kind", "role", "text")), strict=True):
                if open_ and (c, t) != (conv, turn):
                    close_turn()
                    if c != conv or chars >= PART_CHARS:
                        close_part()
                if not open_ or c != conv:
                    part = 0
                if not open_ or (c, t) != (conv, turn):
                    conv, turn, role, texts, open_ = c, t, r, [], True
                if k < 4:
                    texts, role = [], r or role
                if k != 3:
                    texts.append(x)
            yield _parts(parts)
            parts.clear()
        if open_:
            close_turn()
            close_part()
            yield _parts(parts)

    return surviving_events(events).mapInArrow(fold, FORMATTED)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in FORMATTED.split(", ")])
