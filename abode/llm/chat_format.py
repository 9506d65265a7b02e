r"""Chat formatting (operator 2): a role machine checks turn order, a template emits text segments.

``format_chats`` deals conversations out by id, sorts each partition by conversation and turn
and streams over the rows. Per turn it emits three segments, each with a loss flag: the
header, the escaped text and the footer. ``TEMPLATE`` states header, footer and loss of a role;
``TURNS`` states which roles may follow a role, and ``valid`` tells whether the conversation
has kept to it up to this turn (``ends_valid`` of the last turn: whether it may end there).

Control strings inside texts are escaped: a backslash before every backslash, ``###`` and
``</turn>`` of the text; dropping each escaping backslash restores the text. ``read_back``
parses the formatted output again, without the input, and gives roles, texts and the loss
mask; it raises on output that is not well formed.

Both passes are streams: a task holds one turn at a time, also of a very long conversation.
A conversation is one text, so its turns are one task's work in order; Spark's sort spills.

Defined results: null text is empty; a null or unknown role is formatted under its own name
(null: the empty name) and is never valid; a null conversation id is one conversation; rows
with equal turn are ordered by role, then text, nulls first; repeated rows are turns of their
own; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# role -> (header, footer, is the text trained on); "{role}" stands for the escaped role name
TEMPLATE = {
    "system": ("### System: ", "</turn>\n", False),
    "user": ("### User: ", "</turn>\n", False),
    "assistant": ("### Assistant: ", "</turn>\n", True),
    None: ("### ={role}: ", "</turn>\n", False),
}
# role -> roles that may follow; "start" and "end" are the machine's own states
TURNS = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "end")}
CONTROLS = ("\\", "###", "</turn>")
SEGMENTS = "conv_id bigint, turn_no bigint, segment int, text string, loss boolean, valid boolean, ends_valid boolean"
TURN_BLOCK = re.compile(r"### (?P<role>[A-Za-z]+|=(?:\\.|[^\\:])*): (?P<text>(?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str, controls=CONTROLS) -> str:
    for c in controls:
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turn_segments(role: str, text: str, template=TEMPLATE) -> list[tuple[str, bool]]:
    """(text, loss) of the three segments of a turn."""
    header, footer, loss = template.get(role, template[None])
    return [(header.replace("{role}", escape(role, (*CONTROLS, ":"))), False), (escape(text), loss), (footer, False)]


def _key(value):
    return None if pd.isna(value) else int(value)


def format_chats(df: DataFrame, template=TEMPLATE, turns=TURNS) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per segment, in order inside each partition."""
    rows = df.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(frames):
        conv, state, valid, number = object(), "start", True, 0
        for frame in frames:
            out = []
            for c, role, text in zip(frame["conv_id"], frame["role"], frame["text"]):
                c = _key(c)
                if c != conv:
                    conv, state, valid, number = c, "start", True, 0
                valid = valid and role in turns.get(state, ())
                state = role
                ends = valid and "end" in turns.get(state, ())
                out += [(c, number, k, t, loss, valid, ends) for k, (t, loss) in enumerate(turn_segments(role, text, template))]
                number += 1
            yield pd.DataFrame(out, columns=["conv_id", "turn_no", "segment", "text", "loss", "valid", "ends_valid"]).astype({"conv_id": "Int64"})

    return rows.mapInPandas(run, SEGMENTS)


def read_turn(block: str, template=TEMPLATE) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    found = TURN_BLOCK.fullmatch(block)
    if not found:
        raise ValueError("not a formatted turn")
    label, text = found["role"], unescape(found["text"])
    if label.startswith("="):
        return unescape(label[1:]), text
    for role, (header, _, _) in template.items():
        if header == f"### {label}: ":
            return role, text
    raise ValueError(f"unknown header {label!r}")


DIGESTS = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
           "formatted_chars bigint, valid boolean")


def read_back(segments: DataFrame, template=TEMPLATE) -> DataFrame:
    """Digests of each conversation from its segments alone; follows ``format_chats`` in the same stage."""
    def run(frames):
        conv, seen, block, masked = None, False, [], []
        n = loss_chars = chars = 0
        turns, loss, ok = hashlib.sha256(), hashlib.sha256(), False

        def result():
            return (conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, bool(ok))

        for frame in frames:
            out = []
            for c, segment, text, is_loss, ends in zip(frame["conv_id"], frame["segment"], frame["text"], frame["loss"], frame["ends_valid"]):
                c = _key(c)
                if not seen or c != conv:
                    if seen:
                        out.append(result())
                    conv, seen, n, loss_chars, chars = c, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                block.append(text)
                if is_loss:
                    masked.append(text)
                if segment == 2:
                    role, said = read_turn("".join(block), template)
                    turns.update(f"{role}\n{said}\n".encode())
                    trained = unescape("".join(masked))
                    loss.update(trained.encode())
                    loss_chars += len(trained)
                    n, ok = n + 1, ends
                    block.clear()
                    masked.clear()
            yield pd.DataFrame(out, columns=COLUMNS).astype({"conv_id": "Int64"})
        if seen:
            yield pd.DataFrame([result()], columns=COLUMNS).astype({"conv_id": "Int64"})

    return segments.mapInPandas(run, DIGESTS)


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
# Fixed value: the text of both turns of the contract's conversation -7.
PLANTED = r"\### Assistant: </turn> ok"


def oracle() -> str:
    """DuckDB SQL of the query; the formatted length is that of headers, footers and escaped texts."""
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
e AS (SELECT *, CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
    ELSE 1 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) END
  + 6 + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 8 AS chars,
  lag(role) OVER o AS before, lead(role) OVER o IS NULL AS last
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
v AS (SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
  WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END
  AND (NOT last OR role = 'assistant') AS ok FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(ok) AS valid
FROM v GROUP BY conv_id"""
