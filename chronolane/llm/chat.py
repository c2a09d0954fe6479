"""Chat formatting: a finite-state machine over roles, and a declarative template with loss flags.

Turns are sorted inside their conversation and stream through the machine, which says of each turn whether its role
may come there. Each turn gives three segments: header, text, close; the template says whose texts count for the
loss. Control strings inside texts and roles are escaped by a backslash, so the output reads back exactly.

Defined cases: a null text or role is empty; an unknown role is written out behind a mark and is out of turn; turns
that tie are sorted by role and text; a null conversation id is a conversation; a null turn comes first; an empty
table gives no rows; columns besides conv_id, turn, role and text are ignored. Memory holds one turn at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """Marks of a turn, which roles count for the loss, and the machine: state and role to the next state."""

    open: str = "### "
    after_role: str = ": "
    close: str = " </turn>\n"
    control: tuple[str, ...] = ("\\", "### ", "</turn>")
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "ready", ("start", "user"): "asked", ("ready", "user"): "asked", ("asked", "assistant"): "ready"})
    ends: frozenset[str] = frozenset({"ready"})

    def escape(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, self.control)), lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(" + "|".join(map(re.escape, self.control)) + ")", lambda m: m[1], text)

    def header(self, role: str) -> str:
        """A known role by its label; any other behind "?", with what could end the header escaped."""
        label = self.labels.get(role)
        if label is None:
            label = "?" + self.escape(role).replace(":", "\\:")
        return f"{self.open}{label}{self.after_role}"

    def role(self, label: str) -> str:
        if label.startswith("?"):
            return self.unescape(label[1:].replace("\\:", ":"))
        return {v: k for k, v in self.labels.items()}[label]


DEFAULT = Template()
SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("segment", pa.string()), ("loss", pa.bool_()), ("in_order", pa.bool_()), ("complete", pa.bool_())])


def format_chats(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, seq, segment, loss, in_order, complete), three rows a turn, sorted inside each partition.

    ``in_order`` is false where the machine has no move (it then restarts from the turn's role); ``complete``
    tells whether the conversation could end here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, seq = object(), template.start, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != at:
                    at, state, seq = conv, template.start, 0
                after = template.moves.get((state, role))
                fine = after is not None
                state = after or template.moves.get((template.start, role)) or next((s for (_, r), s in template.moves.items() if r == role), template.start)
                for segment, loss in ((template.header(role), False), (template.escape(text), role in template.loss), (template.close, False)):
                    out.append((conv, seq, segment, loss, fine, state in template.ends))
                    seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(SEGMENTS), SEGMENTS, strict=True)], schema=SEGMENTS)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, seq long, segment string, loss boolean, in_order boolean, complete boolean")


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("first_wrong_turn", pa.int64())])


class _Reader:
    """Reads one conversation back from its segments, which may be cut anywhere, and keeps the digests."""

    def __init__(self, template: Template) -> None:
        one = "(?:" + r"\\(?:" + "|".join(map(re.escape, (*template.control, ":"))) + r")|[^\\])*?"
        self.turn = re.compile(re.escape(template.open) + f"({one})" + re.escape(template.after_role) + f"({one})" + re.escape(template.close), re.DOTALL)
        self.template = template
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.held, self.wrong, self.complete, self.seen = "", None, False, 0

    def add(self, segment: str, loss: bool, in_order: bool, complete: bool) -> None:
        self.chars += len(segment)
        self.held += segment
        if loss:
            text = self.template.unescape(segment)
            self.loss_chars += len(text)
            self.learned.update(text.encode("utf-8", "surrogatepass"))
        if not in_order and self.wrong is None:
            self.wrong = self.n
        self.complete = complete
        if self.held.endswith(self.template.close):
            self.read()

    def read(self) -> None:
        while m := self.turn.match(self.held):
            role, text = self.template.role(m[1]), self.template.unescape(m[2])
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
            self.held = self.held[m.end() :]

    def row(self, conv: int | None) -> tuple:
        if self.held:
            raise ValueError(f"conversation {conv} doesn't read back from {self.held[:80]!r}")
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars, self.wrong is None and self.complete, self.wrong


def read_back(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Digests of each conversation, read from the formatted segments; they stream in the order format_chats left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(DIGESTS), DIGESTS, strict=True)], schema=DIGESTS)

        at, reader = None, None
        for batch in batches:
            out = []
            for conv, seq, segment, loss, in_order, complete in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or conv != at or seq == 0:
                    if reader:
                        out.append(reader.row(at))
                    at, reader = conv, _Reader(template)
                reader.add(segment, loss, in_order, complete)
            yield packed(out)
        if reader:
            yield packed([reader.row(at)])

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_wrong_turn long")


#: The conversation that tries the escapes.
PROBE = "\\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_chats(turns.unionByName(probe)))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER w - 1 AS n, lag(role) OVER w AS prev FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (
  SELECT *, CASE WHEN prev = 'user' THEN role = 'assistant' WHEN prev IN ('system', 'assistant') THEN role = 'user' ELSE role IN ('system', 'user') END AS fine,
    CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 1 + length(regexp_replace(role, '(\\|### |</turn>|:)', '~\1', 'g')) END AS label,
    length(regexp_replace(text, '(\\|### |</turn>)', '~\1', 'g')) AS escaped FROM o
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + label + 2 + escaped + 9) AS BIGINT) AS formatted_chars, bool_and(fine) AND max_by(role, n) IN ('system', 'assistant') AS valid, min(n) FILTER (WHERE NOT fine) AS first_wrong_turn
FROM s GROUP BY conv_id
"""
