"""Chat formatting (operator 7): a finite-state machine over roles and a declarative template.

A conversation becomes text segments, each with a loss flag.  Markers come from
the template; wherever a text itself holds a control string, a backslash goes
behind its first character (and one more where there already are some), so
formatted text reads back unambiguously.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``turns``: role -> (marker before, marker after, loss).  Other roles are written as ``other``: name between the first two markers, text up to the third."""

    begin: str = "<s>"
    turns: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]", False), "user": ("[INST]", "[/INST]", False), "assistant": ("", "</s>", True)})
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[END]")
    #: state -> roles that may follow; a state is the last role, or "" at the start.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        found = {self.begin, *self.other, *(m for a, b, _ in self.turns.values() for m in (a, b))}
        return sorted(found - {""}, key=lambda m: (-len(m), m))


class Codec:
    """Escaping and reading back for one template."""

    def __init__(self, template: Template):
        self.template = template
        heads = "".join(re.escape(c) for c in sorted({m[0] for m in template.controls()}))
        tails = "|".join(re.escape(m[1:]) for m in template.controls())
        self._live = re.compile(rf"([{heads}])(\\*)(?={tails})")
        self._dead = re.compile(rf"([{heads}])\\(\\*)(?={tails})")
        self._marker = re.compile("(" + "|".join(re.escape(m) for m in template.controls()) + ")")
        self._heads = {m[0] for m in template.controls()}

    def escape(self, text: str) -> str:
        return self._live.sub(r"\1\\\2", text) if any(c in text for c in self._heads) else text

    def unescape(self, text: str) -> str:
        return self._dead.sub(r"\1\2", text) if "\\" in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        if role in self.template.turns:
            before, after, loss = self.template.turns[role]
            out = [(before, False), (self.escape(text), loss), (after, False)]
        else:
            a, b, c = self.template.other
            out = [(a, False), (self.escape(role), False), (b, False), (self.escape(text), False), (c, False)]
        return out

    def parts(self, text: str) -> list[str]:
        """Markers and escaped texts in turn."""
        return self._marker.split(text)


class Reader:
    """Reads turns back from segments, in order, holding one text at a time."""

    def __init__(self, codec: Codec):
        self.codec, t = codec, codec.template
        self.open = {a: r for r, (a, _, _) in t.turns.items() if a}
        self.close = {b: r for r, (_, b, _) in t.turns.items()}
        self.pieces: list[str] = []
        self.role: str | None = None

    def feed(self, segment: str):
        t = self.codec.template
        for i, part in enumerate(self.codec.parts(segment)):
            if i % 2 == 0:
                if part:
                    self.pieces.append(part)
            elif part == t.begin or part in self.open or part == t.other[0]:
                self.pieces = []
            elif part == t.other[1]:
                self.role, self.pieces = self.codec.unescape("".join(self.pieces)), []
            else:
                yield (self.role if part == t.other[2] else self.close[part]), self.codec.unescape("".join(self.pieces))
                self.pieces = []


def _ordered(conversations: DataFrame) -> DataFrame:
    """One conversation's turns follow each other in one partition: by turn, then role, then text (null first)."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


_SEGMENT = "conv_id long, turn long, role string, seg long, text string, loss boolean, valid_so_far boolean"


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments ``conv_id, turn, role, seg, text, loss, valid_so_far``; a conversation's segments are consecutive rows in order.

    The state machine checks each turn against the role before it;
    ``valid_so_far`` turns false at the first turn out of order (such
    conversations are still formatted).  Null text or role: empty.  Equal turn
    numbers: by role, then text; repeated rows are kept.  Rows without
    ``conv_id`` form one conversation.  Turns stream through: nothing of a
    conversation but its state is held, however long it is.
    """
    t = template or Template()

    def run(batches):
        codec, none = Codec(t), object()
        conv, state, seg, valid = none, "", 0, True
        for batch in batches:
            out: list[tuple] = []
            for cid, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if cid != conv or conv is none:
                    conv, state, seg, valid = cid, "", 1, True
                    out.append((cid, turn, role, 0, t.begin, False, True))
                valid = valid and role in t.follows.get(state, ())
                state = role
                for s, loss in codec.segments(role, text):
                    out.append((cid, turn, role, seg, s, loss, valid))
                    seg += 1
            cols = list(zip(*out)) if out else [()] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, types)], names=[f.split()[0] for f in _SEGMENT.split(", ")])

    return _ordered(conversations).mapInArrow(run, _SEGMENT)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, from :func:`format_conversations`' segments alone: what a consumer of the text sees."""
    t = template or Template()

    def run(batches):
        codec, none = Codec(t), object()
        conv, now = none, None

        def end():
            return (conv, now["n"], now["turns"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"], now["valid"] and now["last"] in t.final)

        for batch in batches:
            done = []
            cols = [batch.column(i).to_pylist() for i in (0, 4, 5, 6)]
            for cid, text, loss, valid in zip(*cols):
                if cid != conv or conv is none:
                    if conv is not none:
                        done.append(end())
                    conv = cid
                    now = dict(n=0, turns=hashlib.sha256(), loss=hashlib.sha256(), loss_chars=0, chars=0, reader=Reader(codec), last="", valid=True)
                now["chars"] += len(text)
                now["valid"] = valid
                if loss:
                    plain = codec.unescape(text)
                    now["loss"].update(plain.encode())
                    now["loss_chars"] += len(plain)
                for role, plain in now["reader"].feed(text):
                    now["n"] += 1
                    now["last"] = role
                    now["turns"].update(f"{role}\n{plain}\n".encode())
            if done:
                yield _rows(done)
        if conv is not none:
            yield _rows([end()])

    return segments.mapInArrow(run, _DIGEST)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), types)], names=[f.split()[0] for f in _DIGEST.split(", ")])


EXTRA = "</s>[INST] ok [/INST]"


def chat_digest(conversations: DataFrame) -> DataFrame:
    extra = conversations.sparkSession.createDataFrame([(-7, 0, "user", EXTRA), (-7, 1, "assistant", EXTRA)], "conv_id long, turn long, role string, text string")
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(format_conversations(c.unionByName(extra)))


SQL = r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, lag(role, 1, '') OVER w AS before, lead(role) OVER w IS NULL AS is_last,
         length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|END\])'))
         + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 4 ELSE 18 + length(role) END AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(chars) AS BIGINT) AS formatted_chars,
       bool_and(CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE FALSE END
                AND (NOT is_last OR role = 'assistant')) AS valid
FROM o GROUP BY conv_id
"""
