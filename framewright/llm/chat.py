"""Conversations as training text: a state machine over roles and a declarative template.

A :class:`ChatTemplate` says how a turn opens and closes, which role may follow which, which
roles are learnt from, and what stands for a control string inside a text.  Each turn gives
three segments: the opening and the closing without loss, and the text between with loss
where its role is learnt from.  The machine's state is named after the role last seen, so a
turn is in order if its role may follow the state before it; turns out of order are kept and
marked, never dropped.

Control strings are replaced by an escape character and a code.  The escape character goes
first and no control string holds it, so an escaped text holds no control string and every
escape character in it is followed by its code: reading back is exact.

Everything is DataFrame functions.  Turns are escaped where they are read; one exchange by
conversation serves the machine's window and the grouping.  :func:`segments` never gathers
a conversation (its window streams and spills); :func:`formatted` makes one string of it, so
a conversation has to fit a row there.

Null texts and roles are empty, turns without a number come first, rows with an equal number
follow by role and text, and rows with a null key are one conversation.  An empty table gives
an empty one; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = ""


@dataclass(frozen=True)
class ChatTemplate:
    """How a conversation is written.

    ``titles`` names roles in the opening; any other role is written as ``other`` and its
    escaped name, so it is read back too.  ``codes`` gives each control string the text that
    stands for it, escape character first; ``title_end`` is escaped in names only.
    """

    opening: str = "### "
    title_end: str = ": "
    closing: str = "</turn>\n"
    titles: Mapping[str, str] = field(default_factory=lambda: {
        "system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    other: str = "~"
    follows: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user", "tool"), "tool": ("assistant", "tool")})
    last: tuple[str, ...] = ("assistant",)
    learnt: tuple[str, ...] = ("assistant",)
    codes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("### ", "\\o"), ("</turn>", "\\c"))
    name_code: str = "\\t"

    def __post_init__(self):
        escape = self.codes[0][0]
        replaced = [c for c, _ in self.codes[1:]] + [self.title_end]
        stand_ins = [s for _, s in self.codes] + [self.name_code]
        if len(escape) != 1 or any(len(s) != 2 or s[0] != escape for s in stand_ins) or len(set(stand_ins)) < len(stand_ins):
            raise ValueError("a code is the escape character and one letter of its own")
        if any(escape in c for c in replaced) or any(s[1] == escape for s in stand_ins):
            raise ValueError("no control string and no code's letter may hold the escape character")
        if not any(c in self.closing for c, _ in self.codes[1:]) or not all(self.title_end not in t and not t.startswith(self.other) for t in self.titles.values()):
            raise ValueError("the closing has to hold an escaped control string, and titles must be told apart")

    def escaped(self, text: Column, name: bool = False) -> Column:
        for control, code in self.codes:
            text = F.replace(text, F.lit(control), F.lit(code))
        return F.replace(text, F.lit(self.title_end), F.lit(self.name_code)) if name else text

    def unescaped(self, text: Column, name: bool = False) -> Column:
        if name:
            text = F.replace(text, F.lit(self.name_code), F.lit(self.title_end))
        for control, code in reversed(self.codes):
            text = F.replace(text, F.lit(code), F.lit(control))
        return text

    def title(self, role: Column) -> Column:
        named = F.concat(F.lit(self.other), self.escaped(role, name=True))
        for known, title in self.titles.items():
            named = F.when(role == known, title).otherwise(named)
        return named

    def role(self, title: Column) -> Column:
        role = self.unescaped(F.substr(title, F.lit(len(self.other) + 1)), name=True)
        for known, shown in self.titles.items():
            role = F.when(title == shown, known).otherwise(role)
        return role

    def in_order(self, state: Column, role: Column) -> Column:
        """Whether ``role`` may come next in ``state``."""
        allowed = F.lit(False)
        for before, roles in self.follows.items():
            allowed = F.when(state == before, role.isin(*roles)).otherwise(allowed)
        return allowed


PLAIN = ChatTemplate()


def _turns(rows: DataFrame, template: ChatTemplate, key: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per turn, in order by ``place``: its three pieces of text, and whether its role is in order."""
    spelt = rows.select(
        F.col(key).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = Window.partitionBy("conv").orderBy("turn", "role", "text")
    body = template.escaped(F.col("text"))
    opening = F.concat(F.lit(template.opening), template.title(F.col("role")), F.lit(template.title_end))
    return spelt.select(
        "conv", "turn", "role", opening.alias("opening"), body.alias("body"), F.col("role").isin(*template.learnt).alias("loss"),
        F.row_number().over(ordered).alias("place"),
        template.in_order(F.lag("role", 1, START).over(ordered), F.col("role")).alias("in_order"),
    )


def segments(
    rows: DataFrame, template: ChatTemplate = PLAIN, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(key, turn, role, in_order, segment, text, loss): three rows per turn, numbered from 0
    in the order in which they are joined."""
    turns = _turns(rows, template, key, turn, role, text)
    parts = F.array(
        F.struct(F.col("opening").alias("text"), F.lit(False).alias("loss")),
        F.struct(F.col("body").alias("text"), F.col("loss").alias("loss")),
        F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")))
    return turns.select("*", F.posexplode(parts).alias("part", "piece")).select(
        F.col("conv").alias(key), F.col("turn").alias(turn), F.col("role").alias(role), "in_order",
        ((F.col("place") - 1) * 3 + F.col("part")).cast("long").alias("segment"), F.col("piece.text").alias("text"), F.col("piece.loss").alias("loss"))


def formatted(
    rows: DataFrame, template: ChatTemplate = PLAIN, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(key, formatted, segments, valid) per conversation: the whole text, its segments with
    their loss flags, and whether all turns are in order and the last one may end it."""
    turns = _turns(rows, template, key, turn, role, text)
    gathered = turns.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("place", "opening", "body", "loss"))).alias("turns"),
        F.min("in_order").alias("ordered"), F.max_by("role", "place").alias("ending"))
    pieces = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(t.opening.alias("text"), F.lit(False).alias("loss")),
        F.struct(t.body.alias("text"), t.loss.alias("loss")),
        F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")))))
    return gathered.select("conv", pieces.alias("segments"), (F.col("ordered") & F.col("ending").isin(*template.last)).alias("valid")).select(
        F.col("conv").alias(key), F.array_join(F.col("segments.text"), "").alias("formatted"), "segments", "valid")


def _literal(text: str) -> str:
    """A pattern that finds ``text`` itself."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def read_back(texts: DataFrame, template: ChatTemplate = PLAIN, key: str = "conv_id") -> DataFrame:
    """(key, formatted, turns, learnt, valid) from what :func:`formatted` wrote: roles and texts of
    the turns found in the text, and the text under the loss flags, all unescaped."""
    parts = F.split("formatted", _literal(template.closing))
    cut = texts.withColumn("_parts", F.slice(parts, 1, F.size(parts) - 1))

    def turn(part: Column) -> Column:
        head = F.substring_index(part, template.title_end, 1)
        body = F.substr(part, F.char_length(head) + len(template.title_end) + 1)
        return F.struct(template.role(F.substr(head, F.lit(len(template.opening) + 1))).alias("role"), template.unescaped(body).alias("text"))

    learnt = F.transform(F.filter("segments", lambda s: s.loss), lambda s: template.unescaped(s.text))
    return cut.select(key, "formatted", F.transform("_parts", turn).alias("turns"), F.array_join(learnt, "").alias("learnt"), "valid")


def digests(read: DataFrame, key: str = "conv_id") -> DataFrame:
    """Counts and digests of what :func:`read_back` found."""
    spelt = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        key, F.size("turns").cast("long").alias("n_turns"), F.sha2(spelt, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")
