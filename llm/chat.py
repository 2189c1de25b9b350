"""Chat formatting: a finite-state machine over roles and a declarative template. Native expressions only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How turns are written, which texts carry loss, and which role may follow which.

    A turn is ``open`` name ``after`` text ``close``. Roles outside ``names`` are written as ``other``
    and the role itself. ``order`` has the allowed steps (from, to) of the machine; its start is "".
    """

    open: str = "### "
    after: str = ": "
    close: str = "</turn>\n"
    other: str = "@"
    names: Mapping[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})
    order: frozenset[tuple[str, str]] = frozenset({
        ("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")})
    #: Control strings that may not appear in a text, with the letter that stands for their first character.
    marks: Mapping[str, str] = field(default_factory=lambda: {"### ": "h", "</turn>": "l"})

    def escape(self, text: Column, *more: tuple[str, str]) -> Column:
        """Double the escape character, then replace the first character of each control string."""
        text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
        for mark, letter in (*self.marks.items(), *more):
            text = F.replace(text, F.lit(mark), F.lit(ESCAPE + letter + mark[1:]))
        return text

    def unescape(self, text: Column) -> Column:
        """The text again: pairs of escape characters split it into parts without one."""
        def part(x: Column) -> Column:
            for mark, letter in (*self.marks.items(), (":", "c")):
                x = F.replace(x, F.lit(ESCAPE + letter), F.lit(mark[0]))
            return x

        parts = F.split(text, r"\\\\")
        return F.array_join(F.transform(parts, part), ESCAPE)

    def name(self, role: Column) -> Column:
        out = F.concat(F.lit(self.other), self.escape(role, (":", "c")))
        for known, name in self.names.items():
            out = F.when(role == known, name).otherwise(out)
        return out

    def role(self, name: Column) -> Column:
        out = self.unescape(F.substr(name, F.lit(len(self.other) + 1)))
        for known, written in self.names.items():
            out = F.when(name == written, known).otherwise(out)
        return out


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, formatted, segments, valid, bad_turn: one row per conversation.

    ``turns`` has conv_id, turn, role, text. ``segments`` are (text, loss) in order; joined, they are
    ``formatted``. The machine walks the roles in turn order: ``bad_turn`` is the position, from 0, of the
    first turn that may not stand there, and ``valid`` says that there is none. Turns are escaped where
    they are read; one shuffle by conversation brings them together, as a conversation's text is one value.

    Null text or role is empty. Turns of equal number follow role and text; a null number comes first;
    a null conv_id is a conversation of its own; repeated rows are repeated turns; further columns are
    ignored; no rows give no conversations.
    """
    t = template or Template()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    written = turns.select(
        "conv_id",
        F.struct(
            "turn", role.alias("role"), text.alias("raw"),
            F.concat(F.lit(t.open), t.name(role), F.lit(t.after)).alias("head"), t.escape(text).alias("body"),
        ).alias("turn"))
    chats = written.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        F.struct(x["head"].alias("text"), F.lit(False).alias("loss")),
        F.struct(x["body"].alias("text"), x["role"].isin(*t.loss).alias("loss")),
        F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")))))
    steps = F.array(*(F.lit(f"{a}>{b}") for a, b in sorted(t.order)))
    roles = F.transform("turns", lambda x: x["role"])
    walked = F.zip_with(
        F.concat(F.array(F.lit("")), roles), roles,
        lambda a, b: F.array_contains(steps, F.concat(a, F.lit(">"), b)))
    bad = F.array_position(F.slice(walked, 1, F.size("turns")), False) - 1
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"),
        F.when(bad >= 0, bad).alias("bad_turn"),
    ).select(
        "conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments", F.col("bad_turn").isNull().alias("valid"), "bad_turn")


def read_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """The turns (role, text) and the text under the loss mask, read back from ``formatted`` and ``segments``.

    Adds ``turns_read`` and ``loss_text`` to what ``format_chats`` returns.
    """
    t = template or Template()
    pattern = "(?s)^" + _literal(t.open) + "(.*?)" + _literal(t.after) + "(.*)$"
    blocks = F.filter(F.split("formatted", _literal(t.close)), lambda b: b != "")
    turns = F.transform(blocks, lambda b: F.struct(
        t.role(F.regexp_extract(b, pattern, 1)).alias("role"),
        t.unescape(F.regexp_extract(b, pattern, 2)).alias("text")))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescape(s["text"]))
    return formatted.withColumn("turns_read", turns).withColumn("loss_text", F.array_join(loss, ""))


def _literal(text: str) -> str:
    return r"\Q" + text + r"\E"


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, hashes of the turns and of the text under the loss mask, lengths, validity."""
    lines = F.array_join(F.transform("turns_read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns_read").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn")


#: The same rows in SQL: lengths and hashes from the turns as they are, the machine as pairs of neighbours.
DIGEST_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *,
    row_number() OVER w - 1 AS pos,
    coalesce(lag(role) OVER w, '') || '>' || role AS step,
    replace(replace(replace(text, '\', '\\'), '### ', '\h## '), '</turn>', '\l/turn>') AS body,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
      ELSE '@' || replace(replace(replace(replace(role, '\', '\\'), '### ', '\h## '), '</turn>', '\l/turn>'), ':', '\c')
    END AS name
  FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(name) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars,
  bool_and(step IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid,
  min(pos) FILTER (step NOT IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')) AS bad_turn
FROM placed GROUP BY conv_id
"""
