"""Chat logs folded into final messages and rendered by a template, in DataFrame operations only.

A log holds events `(conv_id, seq, kind, message, role, text)`:

    message      opens message number `message` with a role and a text (which may be empty)
    delta        appends its text to the message
    edit         replaces the message's text
    regenerate   throws the message's text and all later messages away; later events make them anew

An event of message m counts if no `regenerate` of m or of an earlier message has a larger
`seq`. A message's text is that of its last counting `message`, `edit` or `regenerate` event
(the latter is empty) and of the counting deltas behind it, in the order of `seq`.
Events are first gathered by conversation and message, so a long conversation is split and
only the rows of one message meet; then the messages of a conversation meet, as a rendered
conversation is one value. Nothing is joined: what a conversation's `regenerate` events
undo is a running maximum along its messages.

`render` gives one row per conversation: the formatted text and, aligned with the turns, where
each turn's text stands and whether it is under the loss mask. Control strings within texts get a
backslash behind their first character, one more than they already have there, so no text can hold a
control string and `read_back` restores every text exactly. Roles are percent-encoded.

Defined cases: a null text is empty, a null role is the role "" ; a null conv_id is a
conversation of its own; events that tie in `seq` count in the order of kind and text; other kinds
are ignored; a message of which only deltas count is made of these; rows of `turns_as_events` that tie in `turn` follow
role and text, null first, and repeated rows are turns of their own; an empty table gives an empty one; other
columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import whole

BASES = ("edit", "message", "regenerate")
DELTA_CHARS = 512


@dataclass(frozen=True)
class Template:
    """start + role + newline + text + end for every turn; `control` lists further strings that no text may hold."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    trained: tuple[str, ...] = ("assistant",)

    @property
    def strings(self) -> tuple[str, ...]:
        return (self.start.strip(), self.end.strip(), *self.control)

    def __post_init__(self):
        marked = [s[0] + "\\" + s[1:] for s in self.strings]
        if any(len(s) < 2 or "\\" in s for s in self.strings) or any(s in m for s in self.strings for m in marked):
            raise ValueError("control strings need two characters, no backslash, and must not hold one another")

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._joined(r"{head}(\\*)(?={rest})")), F.lit(r"$0\\"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._joined(r"(?<={head})\\(?=\\*{rest})")), F.lit(""))

    def _joined(self, pattern: str) -> str:
        by_head: dict[str, list[str]] = {}
        for s in self.strings:
            by_head.setdefault(s[0], []).append(re.escape(s[1:]))
        return "|".join(pattern.format(head=re.escape(h), rest=f"(?:{'|'.join(rest)})") for h, rest in by_head.items())


CHAT = Template()


def turns_as_events(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text", delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The log of finished conversations as a server streams it: an opening event per turn, then its text in deltas."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), whole(text).alias("text"))
    along = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", F.row_number().over(along).alias("message"), "role",
                       F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{delta_chars}}}"), F.lit(0)).alias("deltas"))
    pieces = F.concat(F.array(F.lit("")), F.col("deltas"))
    rows = rows.select("conv_id", "message", "role", F.posexplode(pieces).alias("part", "text"))
    return rows.select("conv_id", F.struct("message", "part").alias("seq"),
                       F.when(F.col("part") == 0, F.lit("message")).otherwise(F.lit("delta")).alias("kind"),
                       "message", F.when(F.col("part") == 0, F.col("role")).alias("role"), "text")


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the messages that the log of each conversation ends with."""
    known = events.where(F.col("kind").isin("delta", *BASES))
    is_regeneration = F.col("kind") == "regenerate"
    entry = F.struct("seq", "kind", F.when(is_regeneration, F.lit("")).otherwise(whole("text")).alias("text"))
    logs = known.groupBy("conv_id", "message").agg(
        F.max(F.when(is_regeneration, F.col("seq"))).alias("undone"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.sort_array(F.collect_list(entry)).alias("log"))
    upto = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    logs = logs.withColumn("undone", F.max("undone").over(upto))
    logs = logs.select("conv_id", "message", "role", F.filter(
        "log", lambda e: F.col("undone").isNull() | (e["seq"] >= F.col("undone"))).alias("log"))
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i)))
    logs = logs.where(F.size("log") > 0)
    text = F.array_join(F.transform(F.slice("log", F.coalesce(last, F.lit(0)) + 1, F.size("log")), lambda e: e["text"]), "")
    return logs.select("conv_id", "message", F.coalesce(F.col("role"), F.lit("")).alias("role"), text.alias("text"))


def render(said: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, formatted, loss) of rows (conv_id, message, role, text).

    `loss` has an entry per turn: `start`, the code points of `formatted` before the turn's text, `offset`, those
    from the turn's own beginning, `length` of the escaped text, and whether it is `trained`.
    """
    head = F.concat(F.lit(template.start), F.url_encode("role"), F.lit("\n"))
    rows = said.select("conv_id", "message", head.alias("head"), template.escape(F.col("text")).alias("body"),
                       F.col("role").isin(*template.trained).alias("trained"))
    rows = rows.withColumn("turn", F.concat("head", "body", F.lit(template.end)))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.char_length("turn").cast("long")).over(before), F.lit(0).cast("long"))
    offset = F.char_length("head")
    span = F.struct((begin + offset).alias("start"), offset.alias("offset"), F.char_length("body").alias("length"), "trained")
    rows = rows.select("conv_id", "message", "turn", span.alias("span"))
    whole_conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "turn", "span"))).alias("turns"))
    return whole_conv.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["span"]).alias("loss"))


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, formatted, turns, learned): the turns (role, text) and the texts under the loss mask, from the output alone."""
    pieces = F.split("formatted", re.escape(template.end))
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    rows = formatted.withColumn("pieces", pieces)
    label = lambda p: F.substring_index(p, "\n", 1)
    turns = F.transform("pieces", lambda p: F.struct(
        F.url_decode(F.regexp_replace(label(p), "^" + re.escape(template.start), "")).alias("role"),
        template.unescape(F.regexp_replace(p, r"\A[^\n]*\n", "")).alias("text")))
    learned = F.zip_with("pieces", "loss", lambda p, s: F.when(
        s["trained"], template.unescape(F.substring(p, s["offset"] + 1, s["length"]))))
    return rows.select("conv_id", "formatted", turns.alias("turns"), F.filter(learned, lambda t: t.isNotNull()).alias("learned"))


def format_chats(events: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, formatted, loss) of a log of events."""
    return render(messages(events), template)
