r"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<s>`` and, for each turn, ``<|turn|>role<|text|>text<|end|>``. The rendered string is
parsed again by a deterministic parser; if that fails or the turns differ from the source, conflicting content is
escaped and the conversation rendered anew, until the turns agree.

Escaping: a control string is an opener (``<`` or ``[``), k >= 0 backslashes and a tail. Escaping makes k one larger and
unescaping one smaller, so every text, also one that holds escaped controls already, comes back unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bounded_batches

BOS, TURN, TEXT, END = "<s>", "<|turn|>", "<|text|>", "<|end|>"
TAILS = r"(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|turn\|>|\|text\|>|\|end\|>)"
CONTROL = re.compile(r"([<\[])(\\*)" + TAILS)
ESCAPED = re.compile(r"([<\[])(\\*)\\" + TAILS)
BARE = re.compile(r"[<\[]" + TAILS)
#: Length of what the template adds to a conversation and to each turn.
CONVERSATION_CHARS, TURN_CHARS = len(BOS), len(TURN + TEXT + END)
MAX_ROUNDS = 3


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> str:
    return BOS + "".join(f"{TURN}{role}{TEXT}{text}{END}" for role, text in turns)


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn, unescaped, with the span of the text in rendered; None if not in the grammar."""
    if not rendered.startswith(BOS):
        return None
    at, turns, expected, role, begin = len(BOS), [], TURN, "", 0
    for m in BARE.finditer(rendered, at):
        if m.group() != expected:
            return None
        if expected == TURN:
            if m.start() != at:
                return None
            begin, expected = m.end(), TEXT
        elif expected == TEXT:
            role, begin, expected = unescape(rendered[begin : m.start()]), m.end(), END
        else:
            turns.append((role, unescape(rendered[begin : m.start()]), begin, m.start()))
            at, expected = m.end(), TURN
    return turns if expected == TURN and at == len(rendered) else None


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int]]]:
    """The rendered conversation and what the parser recovers from it, which equals turns."""
    now = turns
    for _ in range(MAX_ROUNDS):
        rendered = render(now)
        found = parse(rendered)
        if found is not None and [x[:2] for x in found] == turns:
            return rendered, found
        broken = range(len(turns)) if found is None or len(found) != len(turns) else [i for i, x in enumerate(found) if x[:2] != turns[i]]
        now = [tuple(map(escape, turns[i])) if i in broken else x for i, x in enumerate(now)]
    raise ValueError("the template can't represent this conversation")


SCHEMA = "conv_id string, formatted string, n_turns long, turns_sha256 string, loss_spans array<struct<start: long, end: long>>, loss_chars long, loss_sha256 string"


def _digest(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in rows:
        out = []
        for conv_id, turns in zip(frame["conv_id"], frame["turns"], strict=True):
            rendered, found = format_turns([(t["role"] or "", t["text"] or "") for t in turns])
            learned = [x for x in found if x[0] == "assistant"]
            loss = "".join(unescape(rendered[a:b]) for _, _, a, b in learned)
            whole = "".join(f"{role}\n{text}\n" for role, text, _, _ in found)
            out.append((conv_id, rendered, len(found), hashlib.sha256(whole.encode()).hexdigest(), [{"start": a, "end": b} for _, _, a, b in learned], len(loss), hashlib.sha256(loss.encode()).hexdigest()))
        result = pd.DataFrame(out, columns=["conv_id", "formatted", "n_turns", "turns_sha256", "loss_spans", "loss_chars", "loss_sha256"])
        yield result


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> one row per conversation with its formatted string and loss spans.

    Turns are ordered by turn (null first), equal ones by role and text; repeated rows are repeated turns. A null role
    or text is empty. Rows without conv_id form one conversation without id. Spans count code points of `formatted`
    and cover the assistant texts. Only the four columns are read; an empty table gives no rows. A conversation is one
    row of output, so one conversation's turns meet in one task.
    """
    rows = turns.select(F.col("conv_id").cast("long").cast("string"), F.struct(F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return bounded_batches(grouped).mapInPandas(_digest, SCHEMA).withColumn("conv_id", F.col("conv_id").cast("long"))
