"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names the mark before a turn, the mark after it, each role's label, the
roles whose text counts for the loss, and the allowed role transitions.  Every turn
becomes three segments (mark, text, mark) with a loss flag each.  Control strings
inside texts are escaped by a backslash before them, backslashes are doubled, so a
formatted conversation reads back exactly.

Turns are shuffled by conversation and sorted inside partitions by the JVM; tasks
stream them, so a conversation of any length needs the memory of one turn.
"""

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "### "
    after_role: str = ": "
    end: str = "</turn>\n"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset = frozenset({"assistant"})
    #: state (last role; None at the start) -> roles that may follow
    turns: dict = field(default_factory=lambda: {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})

    @property
    def controls(self) -> tuple[str, str]:
        """Strings that must not stand in a text unescaped: the turn's marks."""
        return self.begin, self.end.rstrip("\n")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for mark in self.controls:
            text = text.replace(mark, "\\" + mark)
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text

    def label(self, role: str) -> str:
        """A known role's label; any other role stands escaped behind an at sign."""
        known = self.labels.get(role)
        return known if known is not None else "@" + re.sub(r"([\\:\n])", r"\\\1", role)

    def head(self, role: str) -> str:
        return self.begin + self.label(role) + self.after_role

    def next(self, state, role: str):
        """The state after ``role``, and whether the machine allows it there."""
        return role, role in self.turns.get(state, set())


class Reader:
    """Reads turns back from formatted text, piece by piece."""

    def __init__(self, template: Template):
        self.t, self.buffer = template, ""
        self.roles = {v: k for k, v in template.labels.items()}

    def feed(self, text: str):
        """Whole turns ``(role, text)`` that the text so far completes."""
        self.buffer += text
        t, at, turns = self.t, 0, []
        mark = t.controls[1]
        while True:
            head = re.compile(re.escape(t.begin) + r"((?:[^\\:]|\\.)*)" + re.escape(t.after_role), re.S).match(self.buffer, at)
            if not head:
                break
            to = head.end()
            while (to := self.buffer.find(mark, to)) >= 0:
                back = to
                while back > head.end() and self.buffer[back - 1] == "\\":
                    back -= 1
                if (to - back) % 2 == 0:
                    break
                to += 1
            if to < 0 or len(self.buffer) < to + len(t.end):
                break
            name = head.group(1)
            role = self.roles.get(name) if not name.startswith("@") else t.unescape(name[1:])
            turns.append((role, t.unescape(self.buffer[head.end() : to])))
            at = to + len(t.end)
        self.buffer = self.buffer[at:]
        return turns


def _kind(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def _same(a, b) -> bool:
    return a == b and (a is None) == (b is None)


def format_chat(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of all conversations: ``conv_id, turn, part (0 mark, 1 text, 2 mark),
    segment, loss, valid``, in order within a partition.

    ``valid`` is false from the first turn on that the machine does not allow.
    Turns go by ``turn``, then role and text, nulls first; null roles and texts are
    empty strings, a null ``conv_id`` is a conversation of its own, and ids may be of any
    type that sorts.  Repeated rows are turns like any others; other columns are left out.
    An empty table gives no segments.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        conv, state, valid, started = None, None, True, False
        for batch in batches:
            out = ([], [], [], [], [], [])
            for cid, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or not _same(cid, conv):
                    conv, state, valid, started = cid, None, True, True
                state, allowed = template.next(state, role)
                valid = valid and allowed
                for part, segment, loss in ((0, template.head(role), False), (1, template.escape(text), role in template.loss), (2, template.end, False)):
                    for column, value in zip(out, (cid, turn, part, segment, loss, valid)):
                        column.append(value)
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds)], names=["conv_id", "turn", "part", "segment", "loss", "valid"])

    shape = f"conv_id {_kind(rows)}, turn long, part int, segment string, loss boolean, valid boolean"
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, shape)


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of formatted conversations, read from the segments as ``format_chat`` orders them;
    segments in another order are an error."""

    def run(batches):
        conv, started = None, False
        reader = turns = loss = None
        n = loss_chars = chars = awaited = 0
        valid, body = True, ""

        def close():
            return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid and not reader.buffer

        for batch in batches:
            done = []
            for cid, part, segment, flag, ok in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if part != awaited or (part and not _same(cid, conv)):
                    raise ValueError(f"segments out of order in conversation {cid}")
                awaited = (part + 1) % 3
                if not started or not _same(cid, conv):
                    if started:
                        done.append(close())
                    conv, started = cid, True
                    reader, turns, loss = Reader(template), hashlib.sha256(), hashlib.sha256()
                    n = loss_chars = chars = 0
                    valid, body = True, ""
                chars += len(segment)
                valid = valid and ok
                if flag:
                    body = template.unescape(segment)
                    loss.update(body.encode())
                    loss_chars += len(body)
                for role, text in reader.feed(segment):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
            kind = batch.schema.field(0).type
            yield _digests(done, kind)
        if started:
            yield _digests([close()], kind)

    return segments.mapInArrow(run, f"conv_id {_kind(segments)}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def _digests(rows, kind) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds)], names=names)


PROBE = "\\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(rows.union(probe)))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS escaped,
         CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '@' || role END AS label,
         lag(role) OVER w AS before, row_number() OVER w AS place
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(label) + 2 + length(escaped) + 8) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
                     WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE FALSE END) AS valid
FROM shaped GROUP BY conv_id
"""
