"""Conversations as training text, with a grammar whose parser gives the turns back.

    conversation = turn*
    turn = "### " role ": " body "</turn>" "\\n"

Headers and ``</turn>`` are control strings. In a body, a control string after an odd number of backslashes is text, with
half of the backslashes (rounded down) before it; after an even number it is a control. Each turn is rendered as it is,
parsed, and compared with its source; only if they differ is the conflicting content escaped, and the turn checked again.

A conversation is handled as the sorted stream of its turns, of which one is in memory at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
ROLES = {v: k for k, v in NAMES.items()}
END = "</turn>"
_HEADER = r"### (?:System|User|Assistant|Tool|role=[^\s:]*): "
# All backslashes before a control string; a run of them is looked at once, from its start.
_CONTROL = re.compile(rf"(?<!\\)(\\*+)({_HEADER}|{END})")
_START = re.compile(_HEADER)


def header(role: str) -> str:
    """The header of a role; roles without a name of their own are quoted."""
    return f"### {NAMES[role] if role in NAMES else 'role=' + quote(role, safe='')}: "


def escape(text: str) -> str:
    """Each control string gets 2 k + 1 backslashes for the k before it; k at the end of the text become 2 k."""
    text = _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
    tail = len(text) - len(text.rstrip("\\"))
    return text + "\\" * tail


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered text, None if it is none."""
    turns, at = [], 0
    while at < len(rendered):
        head = _START.match(rendered, at)
        if not head:
            return None
        name = head[0][4:-2]
        role = ROLES[name] if name in ROLES else unquote(name[5:])
        at, body = head.end(), []
        for control in _CONTROL.finditer(rendered, at):
            slashes = len(control[1])
            body += [rendered[at : control.start()], "\\" * (slashes // 2)]
            at = control.end()
            if slashes % 2:
                body.append(control[2])
            elif control[2] == END and rendered[at : at + 1] == "\n":
                at += 1
                turns.append((role, "".join(body)))
                break
            else:
                return None
        else:
            return None
    return turns


def render_turn(role: str, text: str) -> str:
    """The rendered turn, escaped only if the parser does not give it back as it is."""
    for body in (text, escape(text)):
        rendered = f"{header(role)}{body}{END}\n"
        if parse(rendered) == [(role, text)]:
            return rendered
    raise ValueError(f"a turn of {len(text)} characters is not given back by the parser")


def format_turns(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """The rendered turns of all conversations, in order within each partition, none of which shares a conversation.

    Columns: ``conv``, ``rendered``, ``start`` (code points of the conversation before it), ``loss_start`` and
    ``loss_chars`` (the body of a turn whose role is in ``learn``, as rendered; null for others). The conversation's
    text is its turns' one after the other.

    Turns are ordered by number (nulls first), role and text; null roles and texts count as empty; each row with a null
    conversation is one of its own. Repeated rows are turns of their own. An empty table gives an empty one. Other columns of
    ``df`` may have any names.
    """
    rows = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    kind = rows.schema["conv"].dataType.simpleString()
    learned = frozenset(learn)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, start = None, 0
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch[n].to_pylist() for n in ("conv", "role", "text")), strict=True):
                if c is None or c != conv:
                    conv, start = c, 0
                rendered = render_turn(role, text)
                loss = role in learned
                body = len(header(role))
                out.append((rendered, start, start + body if loss else None, len(rendered) - body - len(END) - 1 if loss else None))
                start += len(rendered)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch["conv"], *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=["conv", "rendered", "start", "loss_start", "loss_chars"]
            )

    # rows without a conversation are spread
    ordered = rows.repartition("conv", F.when(F.col("conv").isNull(), F.xxhash64("turn", "role", "text"))).sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(formatted, f"conv {kind}, rendered string, start long, loss_start long, loss_chars long")


def read_back(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of each conversation of ``format_turns``, from what the parser makes of the rendered text.

    Columns: the conversation, ``n_turns``, ``turns_sha256`` (role, newline, text, newline of each turn), ``loss_chars``
    and ``loss_sha256`` (the unescaped text under the loss mask) and ``formatted_chars``.
    """
    kind = turns.schema["conv"].dataType.simpleString()
    kinds = turns.schema["conv"].dataType

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [to_arrow_type(kinds), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        state: list | None = None  # conversation, turns, their hash, loss characters, their hash, characters
        close = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        for batch in batches:
            done = []
            for conv, rendered, start, at, n in zip(*(batch[c].to_pylist() for c in ("conv", "rendered", "start", "loss_start", "loss_chars")), strict=True):
                if state is None or conv is None or conv != state[0]:
                    if state is not None:
                        done.append(close(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(rendered):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if at is not None:
                    masked = rendered[at - start : at - start + n]
                    ((_, text),) = parse(f"{header('')}{masked}{END}\n")
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(rendered)
            if done:
                yield batch_of(done)
        if state is not None:
            yield batch_of([close(state)])

    return turns.mapInArrow(digests, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), r AS (
  SELECT *, '### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'Tool' END || ': '
    || regexp_replace(
         regexp_replace(text, '(\\*)(### (?:System|User|Assistant|Tool|role=[^\s:]*): |</turn>)', '\1\1\\\2', 'g'),
         '(\\+)$', '\1\1') || '</turn>' || chr(10) AS rendered
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(rendered))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
