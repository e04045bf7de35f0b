"""Chat formatting with a template that is a black box.

A template is any function of a list of turns that returns text.  The formatter renders
the prefixes of a conversation one turn longer each time and compares consecutive
outputs: what a prefix adds is the span of its last turn.  If an output doesn't begin
with the one before it, the template has rewritten history; the conversation is marked, and
spans begin where the outputs part.  Where a turn's own text stands inside its span is found
by rendering the prefix again with a probe in place of the text.  That gives the loss mask
without knowing the template.

``tagged`` is the template of the query.  It writes control strings around a turn and escapes
those inside texts with a backslash, reversibly; ``parse`` reads turns back.

Rows of a conversation meet in one partition, sorted, and are streamed: a task holds one
conversation at a time.  A conversation becomes one row of output, so it must fit in
memory; rendering takes time with the square of its turns, which is what a black box costs.

Defined results: rows are taken in the order of turn, role, text, nulls first; null role or text
counts as empty; repeated rows are turns of their own; a null conv_id is a conversation.
Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches, partitions, table

Turn = tuple[str, str]  # role, text
Template = Callable[[Sequence[Turn]], str]

_START, _END = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates use to mark turns; none of them survives whole inside a text.
CONTROLS = (_START, _END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("([<\\[])(" + "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True)) + ")")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PROBE = "probe"


def escape(text: str) -> str:
    """Doubles backslashes and puts one into every control string."""
    return _CONTROL.sub(r"\1\\\2", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def tagged(turns: Sequence[Turn]) -> str:
    return "".join(f"{_START}{escape(role).replace('\n', '\\\n')}\n{escape(text)}{_END}\n" for role, text in turns)


_TURN = re.compile(re.escape(_START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(_END) + r"\n", re.DOTALL)


def parse(formatted: str) -> list[Turn]:
    """Turns of a text that ``tagged`` has written."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


class Spans:
    """What comparing the renderings of successive prefixes shows."""

    def __init__(self, turns: Sequence[Turn], template: Template) -> None:
        self.text, self.rewrites = template([]) if not turns else "", 0
        self.spans: list[tuple[int, int, int, int]] = []  # start, end, start and end of the turn's own text (or -1, -1)
        before = ""
        for k, (role, _) in enumerate(turns):
            prefix = turns[: k + 1]
            after = template(prefix)
            start = len(before)
            if not after.startswith(before):
                self.rewrites += 1
                start = _common(before, after)
            probed = template([*turns[:k], (role, _PROBE)])
            own = (-1, -1)
            place = probed.find(_PROBE, start) if probed.startswith(after[:start]) else -1
            if place >= 0:
                tail = len(probed) - place - len(_PROBE)
                stop = len(after) - tail
                if stop >= place and after[:place] == probed[:place] and after[stop:] == probed[place + len(_PROBE) :]:
                    own = (place, stop)
            self.spans.append((start, len(after), *own))
            before = after
        self.text = before if turns else self.text


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Conversations of a sorted partition with columns conv_id, role, text."""
    current, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if turns and conv != current:
                yield current, turns
                turns = []
            current = conv
            turns.append((role or "", text or ""))
    if turns:
        yield current, turns


def format_conversations(df: DataFrame, template: Template = tagged, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id, formatted, rewrites (prefixes whose history changed) and ``spans``:
    (role, start, end, text_start, text_end, loss) in code points, -1 where the text can't be found."""
    spark = df.sparkSession
    bounded_batches(spark)
    dealt = df.select("conv_id", "turn", "role", "text").repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    span = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())])
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("rewrites", pa.int32()), ("spans", pa.list_(span))])

    def flush(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for conv, turns in conversations(batches):
            found = Spans(turns, template)
            spans = [dict(zip(("role", "start", "end", "text_start", "text_end", "loss"), (role, *s, role in loss_roles and s[2] >= 0), strict=True)) for (role, _), s in zip(turns, found.spans, strict=True)]
            rows.append((conv, found.text, found.rewrites, spans))
            size += len(found.text)
            if size > 1 << 20:
                yield flush(rows)
                rows, size = [], 0
        if rows:
            yield flush(rows)

    return dealt.mapInArrow(run, "conv_id long, formatted string, rewrites int, spans array<struct<role string, start long, end long, text_start long, text_end long, loss boolean>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the output back gives: turns by ``parse``, the loss text by the spans' mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, rewrites, spans in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                turns = parse(text)
                mask = np.zeros(len(text) + 1, bool)
                for s in spans:
                    if s["loss"]:
                        mask[s["text_start"] : s["text_end"]] = True
                edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0)).reshape(-1, 2).tolist()
                loss = "".join(unescape(text[a:b]) for a, b in edges)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), rewrites))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites int"
    return formatted.select("conv_id", "formatted", "rewrites", "spans").mapInArrow(run, schema)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(more)))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, turn AS t0, role AS r0, text AS x0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(\|endoftext\|>|\|im_start\|>|\|im_end\|>|<SYS>>|</SYS>>|/INST\]|INST\]|/s>|s>)', '\1\\\2', 'g') AS shown,
         replace(regexp_replace(replace(role, '\', '\\'), '([<\[])(\|endoftext\|>|\|im_start\|>|\|im_end\|>|<SYS>>|</SYS>>|/INST\]|INST\]|/s>|s>)', '\1\\\2', 'g'), chr(10), '\' || chr(10)) AS named
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY t0 NULLS FIRST, r0 NULLS FIRST, x0 NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY t0 NULLS FIRST, r0 NULLS FIRST, x0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(shown) + length(named) + 24)::BIGINT AS formatted_chars, 0::INTEGER AS rewrites
FROM e GROUP BY conv_id
"""
