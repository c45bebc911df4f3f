"""Chat formatting by event-sourced reconstruction.

A log of events (conv_id, seq, kind, message, role, text) is folded into final messages, which are rendered under a template
whose control strings are escaped inside texts, reversibly. Kinds: ``message`` starts a message, ``delta`` adds to its text,
``edit`` replaces the text, ``regenerate`` replaces it and is followed by new deltas, ``delete`` removes the message.

Template: ``<s>text</s>`` for an assistant's turn, ``[INST]role\\ntext[/INST]`` for any other. In texts and roles, a backslash
goes into each control string after its first character (and one more where there are some); in roles, backslashes and line
feeds are written as two characters before that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitfold.shipping import ship

KINDS = ["message", "edit", "regenerate", "delta", "delete"]
ASSISTANT = "assistant"
_RAW = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>(.*?)</s>|\[INST\]([^\n]*)\n(.*?)\[/INST\]", re.S)


def escape(text: str) -> str:
    return _RAW.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of turns (role, text) and the code points (start, end) under the loss mask: the assistant's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == ASSISTANT:
            spans.append((at + 3, at + 3 + len(body)))
            piece = f"<s>{body}</s>"
        else:
            name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
            piece = f"[INST]{name}\n{body}[/INST]"
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that render() was given."""
    out = []
    for m in _TURN.finditer(formatted):
        if m.group(1) is not None:
            out.append((ASSISTANT, unescape(m.group(1))))
        else:
            role = re.sub(r"\\(.)", lambda x: "\n" if x.group(1) == "n" else x.group(1), unescape(m.group(2)))
            out.append((role, unescape(m.group(3))))
    return out


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, first_seq, message, role, text) of each message that isn't deleted in the end.

    Events of one message are folded in order of (seq, kind as in KINDS, text), nulls first; a null text is empty, a null role
    is empty unless another event of the message names one. Grouped by message, so a long conversation is no single group.
    """
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(1))
    rows = events.select("conv_id", "seq", "message", "role", F.struct("seq", kind.alias("k"), F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    starts = F.max(F.when(F.col("e.k") != 4, F.col("e")))
    folded = rows.groupBy("conv_id", "message").agg(F.min("seq").alias("first_seq"), F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "e.k"))).alias("role"), starts.alias("s"), F.collect_list("e").alias("all"))
    after = F.filter(F.sort_array("all"), lambda e: F.col("s").isNull() | (e >= F.col("s")))
    text = F.array_join(F.transform(after, lambda e: e["text"]), "")
    return folded.where("s IS NULL OR s.k <> 5").select("conv_id", "first_seq", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of each conversation; messages in order of (first_seq, role, text, message).

    Rows with a null conv_id are one conversation; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in x.as_py()]) for x in batch.column(1)]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in made], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["conv_id", "formatted", "loss_spans"])

    ship(events.sparkSession)
    turns = messages(events).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first_seq", "role", "text", "message"))).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted conversations hold, parsed from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": whole, "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    ship(formatted.sparkSession)
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(conversations: DataFrame) -> DataFrame:
    """Each row of conversations (conv_id, turn, role, text) as the event that starts its own message."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.monotonically_increasing_id().alias("message"), "role", "text")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1x\2\3', 'g')) AS n FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
