"""Chat formatting from event logs (operator 7)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, short_batches

#: Strings that mark turns here or in other common templates. Each starts with a
#: character that it has nowhere else, so two never overlap.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
#: Event kinds; a null kind is a message.
KINDS = ("message", "delta", "edit", "regenerate", "delete")
ASSISTANT = "assistant"
NONE = "none"

_TOKENS = "|".join(f"{re.escape(c[0])}{{}}{re.escape(c[1:])}" for c in CONTROL)
_PLAIN = re.compile(_TOKENS.replace("{}", r"\\*"))
_ESCAPED = re.compile(_TOKENS.replace("{}", r"\\+"))


def escape(text: str) -> str:
    """Puts one more backslash after the first character of each control string,
    however many are there, so that none stands bare and all can be told apart."""
    return _PLAIN.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text starts and ends in it.

    A role is one line: line ends and backslashes in it are escaped too.
    """
    name = escape(role).replace("\\", "\\\\").replace("\n", "\\n")
    head, body = f"{OPEN}{name}\n", escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse(turn: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    head, _, rest = turn.removeprefix(OPEN).partition("\n")
    name = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head)
    return unescape(name), unescape(rest.removesuffix(f"{CLOSE}\n"))


@dataclass
class _Message:
    """One message while its events are folded; text is None once it is deleted."""

    conv_id: str | None
    message_id: str
    seq: str | None
    role: str | None = None
    text: list[str] | None = None

    def take(self, kind: str, role: str | None, text: str | None) -> None:
        self.role = self.role if role is None else role
        if kind == "delete":
            self.text = None
        elif kind == "regenerate":
            self.text = []
        elif kind == "delta" and self.text is not None:
            self.text.append(text or "")
        else:  # the first delta, an edit or a whole message
            self.text = [text or ""]

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "message_id": self.message_id, "seq": self.seq, "role": self.role, "text": "".join(self.text or ())}


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folds the sorted events of each message id; memory holds one message."""
    now, columns = None, ("conv_id", "message_id", "seq", "kind", "role", "text")
    for rows in batches:
        out = []
        for conv, mid, seq, kind, role, text in zip(*(_plain(rows[c]) for c in columns), strict=True):
            if now is None or (conv, mid) != (now.conv_id, now.message_id):
                if now is not None and now.text is not None:
                    out.append(now.row())
                now = _Message(conv, mid, seq)
            now.take(kind, role, text)
        if out:
            yield pd.DataFrame(out)
    if now is not None and now.text is not None:
        yield pd.DataFrame([now.row()])


def _plain(values: pd.Series) -> list:
    return [None if v is None or v != v else v for v in values]


def messages(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, seq, role, text)`` of a log.

    ``events`` has conv_id, seq, role, text, and may have kind and message_id. In
    order of seq, a ``delta`` adds text to its message, an ``edit`` or a
    ``message`` with the id of one sets it, a ``regenerate`` empties it and
    drops what began after it and before the event, a ``delete`` removes it until
    text comes again. A message stands where its first event stood. Without
    message_id an event is a message by itself; delta, edit, regenerate and delete
    without one are messages too, deletes and regenerations excepted, which do
    nothing. Messages that never got text are empty ones.

    Events are folded by message, and what a regeneration drops is found by a window
    over the starts of a conversation's messages: that gives what one fold of the
    conversation in order of seq gives, but texts of a conversation that holds most
    of the log are spread over the tasks. Events of one message and seq go by kind,
    then text. A null conv_id is a conversation of its own; a null seq comes first.
    Equal events are events of their own, extra columns are ignored, and no
    events give no messages.
    """
    have = set(events.columns)
    kind = F.coalesce(F.col("kind"), F.lit("message")) if "kind" in have else F.lit("message")
    mid = F.col("message_id").cast("string") if "message_id" in have else F.lit(None).cast("string")
    # a null conversation meets itself in joins under a name that no number has
    log = events.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(NONE)).alias("conv_id"), F.col("seq").cast("long").alias("seq"), kind.alias("kind"), mid.alias("message_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    number = F.when(F.col("conv_id") != NONE, F.col("conv_id")).cast("long").alias("conv_id")
    alone = log.where("message_id IS NULL AND kind NOT IN ('regenerate', 'delete')").select("conv_id", "message_id", "seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if not {"kind", "message_id"} <= have:
        return alone.drop("message_id").select(number, "seq", "role", "text")
    named = log.where("message_id IS NOT NULL")
    sort = ["conv_id", "message_id", "seq", "kind", "text"]
    folded = named.repartition("conv_id", "message_id").sortWithinPartitions(*sort).withColumn("seq", F.col("seq").cast("string"))
    folded = folded.mapInPandas(_fold, "conv_id string, message_id string, seq string, role string, text string")
    folded = folded.select("conv_id", "message_id", F.col("seq").cast("long").alias("seq"), F.coalesce("role", F.lit("")).alias("role"), "text")
    # a message goes if a later regeneration is of one that began before it
    starts = named.groupBy("conv_id", "message_id").agg(F.min("seq").alias("start"))
    again = named.where("kind = 'regenerate'").join(starts.alias("s"), ["conv_id", "message_id"]).select("conv_id", "seq", "start")
    line = Window.partitionBy("conv_id").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
    marks = named.select("conv_id", "message_id", "seq").unionByName(alone.select("conv_id", "message_id", "seq"))
    marks = marks.groupBy("conv_id", "message_id", F.when(F.col("message_id").isNull(), F.col("seq")).alias("own")).agg(F.min("seq").alias("seq"))
    marks = marks.join(again.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "message_id", "seq", F.lit(None).cast("long").alias("start"))
    marks = marks.unionByName(again.select("conv_id", F.lit(None).cast("string").alias("message_id"), "seq", "start"))
    marks = marks.withColumn("cutoff", F.min("start").over(line))
    gone = marks.where("start IS NULL AND cutoff < seq").select("conv_id", "message_id", "seq").distinct()
    both = folded.unionByName(alone)
    same = [both[c].eqNullSafe(gone[c]) for c in ("conv_id", "message_id", "seq")]
    left = both.join(gone, same[0] & same[1] & same[2], "left_anti")
    return left.select(number, "seq", "role", "text")


def turns(final: DataFrame) -> DataFrame:
    """Rendered turns ``(conv_id, seq, role, turn, start, loss_start, loss_end)`` of
    ``final(conv_id, seq, role, text)``, sorted by conversation inside partitions.

    The formatted conversation is its turns in order; start, loss_start and
    loss_end are offsets in it, in code points. The loss mask holds the
    assistant's texts and nothing else (null elsewhere). Turns of one seq follow
    by role and text; a null seq comes first, a null conv_id is a conversation of
    its own, null roles and texts are empty.
    """
    short_batches(final.sparkSession)
    final = final.select(F.col("conv_id").cast("long").cast("string").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    line = final.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text").withColumn("seq", F.col("seq").cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, at = (), 0
        for rows in batches:
            out = []
            for conv, seq, role, text in zip(*(_plain(rows[c]) for c in ("conv_id", "seq", "role", "text")), strict=True):
                if (conv,) != key:
                    key, at = (conv,), 0
                turn, a, b = render(role, text)
                lost = (str(at + a), str(at + b)) if role == ASSISTANT else (None, None)
                out.append((conv, seq, role, turn, at, *lost))
                at += len(turn)
            yield pd.DataFrame(out, columns=["conv_id", "seq", "role", "turn", "start", "loss_start", "loss_end"])

    shown = line.mapInPandas(run, "conv_id string, seq string, role string, turn string, start long, loss_start string, loss_end string")
    return shown.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), "role", "turn", "start", F.col("loss_start").cast("long").alias("loss_start"), F.col("loss_end").cast("long").alias("loss_end"))


def format_conversations(events: DataFrame) -> DataFrame:
    """Folds a log into final messages and renders them: see ``messages``, ``turns``.

    Nulls, ties, repeats and clashing columns are as stated there. A conversation is
    rendered and hashed by one task, as its offsets and its hash go in order; that
    task streams, and holds one turn.
    """
    return turns(messages(events))


def as_events(final: DataFrame) -> DataFrame:
    """A log ``(conv_id, seq, kind, message_id, role, text)`` that folds into the
    messages ``final(conv_id, seq, role, text)``, one for each row.

    Each text comes as two streamed drafts, an edit, a regeneration that overrules
    them and drops a stray message that began meanwhile, and then in three deltas.
    Rows of one seq stay messages of their own with that order; a null seq is the
    least one. The log is cut, so that its message ids are drawn once.
    """
    step, n = 8, F.length("text")
    base = F.coalesce(F.col("seq").cast("long") * step, F.lit(-(1 << 62)))
    third = F.floor(n / 3).cast("int")
    start = F.substring("text", 1, F.lit(16))
    event = lambda at, kind, text, stray=False: F.struct((base + at).alias("seq"), F.lit(kind).alias("kind"), F.concat("id", F.lit("s" if stray else "m")).alias("message_id"), F.lit("system").alias("role") if stray else F.col("role"), text.alias("text"))
    events = F.array(
        event(0, "delta", start), event(1, "delta", F.lit(" draft")), event(2, "message", start, stray=True), event(3, "edit", F.concat(start, F.lit(" edited"))), event(4, "regenerate", F.lit(None).cast("string")),
        event(5, "delta", F.substring("text", F.lit(1), third)), event(6, "delta", F.substring("text", third + 1, third)), event(7, "delta", F.substring("text", third * 2 + 1, n - third * 2)),
    )
    own = final.select("conv_id", F.col("seq"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().cast("string").alias("id"))
    return cut(own.select("conv_id", F.inline(events)))


def digests(shown: DataFrame) -> DataFrame:
    """What the rendered turns say, read back from them: one row a conversation.

    ``shown`` is as ``turns`` leaves it, sorted in its partitions; turns are
    parsed, unescaped and hashed as they pass, so memory holds one turn.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = n = said = lost = chars = total = None
        for rows in batches:
            out = []
            for conv, turn, start, a, b in zip(*(_plain(rows[c]) for c in ("conv_id", "turn", "start", "loss_start", "loss_end")), strict=True):
                if key != (conv,):
                    if key:
                        out.append((key[0], n, said.hexdigest(), chars, lost.hexdigest(), total))
                    key, n, chars, total, said, lost = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text = parse(turn)
                said.update(f"{role}\n{text}\n".encode())
                n, total = n + 1, int(start) + len(turn)
                if a is not None:
                    under = unescape(turn[int(a) - int(start) : int(b) - int(start)])
                    lost.update(under.encode())
                    chars += len(under)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if key:
            yield pd.DataFrame([(key[0], n, said.hexdigest(), chars, lost.hexdigest(), total)], columns=columns)

    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    told = shown.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "start", F.col("loss_start").cast("string").alias("loss_start"), F.col("loss_end").cast("string").alias("loss_end"))
    told = told.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return told.withColumn("conv_id", F.col("conv_id").cast("long"))
