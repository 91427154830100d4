"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template.

A ``Template`` says how turns of each role are marked, which of them are learned, and which role may follow which. ``write``
sorts the rows by conversation and turn over all tasks, a conversation of any size over as many as it needs, and writes one row
per turn: its segments, each with its text and whether it is under the loss mask. The machine runs within each task from every
state at once, because a task does not know in which state the conversation stood where its rows begin; the task before says so
afterwards (a row a task). ``read`` parses the segments' joint text back into roles and texts by the template alone.

Control strings inside texts get a backslash after their first character, one more than they have there already, and lose it
when they are read: every text comes back as it was, and no text can end a turn.

Nulls and odd rows: a null text or role is empty; a null turn comes before all others, rows of the same turn are ordered by
role and text and are turns of their own; rows without ``conv_id`` are one conversation. Roles that the template doesn't name
are marked by their name. A conversation whose roles the machine refuses is formatted all the same, with ``valid`` false and
the place of the turn that broke the order. Empty tables give no rows; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import forget, frugal, small_batches, written

#: Code points of role and text that tell rows of the same turn apart when turns are dealt to tasks.
_PREFIX = 64


@dataclass(frozen=True)
class Template:
    """Marks, loss and turn order.

    ``turns``: of each role what stands before and after its text. ``other``: the same for all other roles, with the role's name
    and what divides it from the text. ``begin`` opens a conversation. ``learned``: roles whose texts are under the loss mask.
    ``control``: the strings that marks are recognised by; every mark after a text holds one. ``follows``: the machine, the
    states and of each the next one by role; what it doesn't name is refused. ``start`` and ``final``: its ends.
    """

    turns: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    begin: str
    learned: frozenset[str]
    control: tuple[str, ...]
    follows: dict[str, dict[str, str]]
    start: str
    final: frozenset[str]
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "states", (*self.follows, "refused"))
        for a in self.control:
            for b in self.control:
                if any(a.endswith(b[:k]) for k in range(1, len(b))) or a != b and a in b:
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")
        for mark in (*(m for pair in self.turns.values() for m in pair), *self.other):
            if not any(c in mark for c in self.control):
                raise ValueError(f"the mark {mark!r} has no control string")
        prefixes = [self.begin, self.other[0], *(before for before, _ in self.turns.values())]
        if any(a.startswith(b) for k, a in enumerate(prefixes) for m, b in enumerate(prefixes) if k != m):
            raise ValueError("marks before texts must differ from their first characters on")

    @property
    def pattern(self) -> str:
        """A control string with backslashes after its first character; groups: that character, the backslashes, the rest."""
        heads = "".join(sorted({re.escape(c[0]) for c in self.control}))
        return rf"([{heads}])(\\*)({'|'.join(re.escape(c[1:]) for c in self.control)})"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern, r"$1\\$2$3")

    def unescaped(self, text: str) -> str:
        return re.sub(self.pattern.replace(r"(\\*)", r"\\(\\*)"), r"\1\2\3", text)

    def step(self) -> list[dict[str, int]]:
        """The machine by numbers of states; the last one is that of refused conversations."""
        number = {s: k for k, s in enumerate(self.states)}
        return [{role: number[to] for role, to in self.follows.get(s, {}).items()} for s in self.states]

    def parse(self, text: str) -> list[tuple[str, str]]:
        """(role, text) of the turns of a formatted text."""
        out, at = [], 0
        if text.startswith(self.begin):
            at = len(self.begin)
        while at < len(text):
            for role, (before, after) in self.turns.items():
                if text.startswith(before, at):
                    at += len(before)
                    break
            else:
                before, middle, after = self.other
                if not text.startswith(before, at):
                    raise ValueError(f"no mark at {at}")
                end = text.index(middle, at + len(before))
                role, at = self.unescaped(text[at + len(before) : end]), end + len(middle)
            end = text.index(after, at)
            out.append((role, self.unescaped(text[at:end])))
            at = end + len(after)
        return out


#: Marks of turns as instruction-tuned models have them; every turn is closed, so that any order of roles can be read back.
INSTRUCTIONS = Template(
    turns={"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", "</s>")},
    other=("[ROLE] ", " [SAYS] ", " [/ROLE]"),
    begin="<s>",
    learned=frozenset({"assistant"}),
    control=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[SAYS]", "[/ROLE]", "<s>", "</s>"),
    follows={"empty": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    start="empty",
    final=frozenset({"answered"}),
)


def _ordered(conversations: DataFrame, template: Template, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns in order, written: ``task``, ``place`` in it, ``first`` (of the task's conversations), ``k`` (turn of the
    conversation within the task) and ``ends``, the state after it from every state before the task's first turn of it."""
    steps, begin = template.step(), template.states.index(template.start)
    everything = list(range(len(steps)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place, first, k, states, last = TaskContext.get().partitionId(), 0, True, 0, everything, None
        for batch in batches:
            places, firsts, ks, ends = [], [], [], []
            for name, who in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()):
                if place and name != last:
                    first, k, states = False, 0, [begin]
                states = [steps[s].get(who, len(steps) - 1) for s in states]
                places.append(place)
                firsts.append(first)
                ks.append(k)
                ends.append(states)
                place, k, last = place + 1, k + 1, name
            more = [pa.array([task] * len(places), pa.int32()), pa.array(places, pa.int64()), pa.array(firsts, pa.bool_()), pa.array(ks, pa.int64()), pa.array(ends, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "task", "place", "first", "k", "ends"])

    said = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = said.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, _PREFIX)).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = StructType([*dealt.schema.fields, *StructType.fromDDL("task int, place long, first boolean, k long, ends array<int>").fields])
    return written(dealt.mapInArrow(frugal(run), schema), "chat-turns")


def _entered(turns: DataFrame, template: Template) -> list[tuple[int, int, int]]:
    """(task, state, turn): in which state, and after how many turns, the conversation stands that a task begins with.

    A row a task comes to the driver; the tasks' conversations at their ends follow one another.
    """
    seen = turns.groupBy("task").agg(F.min_by("conv_id", "place").alias("head"), F.max_by(F.struct("conv_id", "first", "k", "ends"), "place").alias("tail"))
    out, begin, before = [], template.states.index(template.start), None
    for row in sorted(seen.collect(), key=lambda r: r["task"]):
        same = before is not None and before[0] == row["head"]
        state, k = before[1:] if same else (begin, 0)
        out.append((row["task"], state, k))
        tail = row["tail"]
        before = (tail["conv_id"], tail["ends"][state if tail["first"] else 0], (k if tail["first"] else 0) + tail["k"] + 1)
    return out


def write(conversations: DataFrame, template: Template = INSTRUCTIONS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The formatted conversations, written: ``conv_id``, ``seq`` (from 0), ``segments`` (text, loss) and ``state`` of every turn.

    The texts of a conversation's segments, one after the other, are its formatted text.
    """
    spark = small_batches(conversations.sparkSession)
    turns = _ordered(conversations, template, conv, turn, role, text)
    entered = F.broadcast(spark.createDataFrame(_entered(turns, template), "task int, state int, turns long"))  # a row a task
    own = F.when(F.col("first"), F.get("ends", F.col("state"))).otherwise(F.get("ends", F.lit(0)))
    rows = turns.join(entered, "task").select("conv_id", "role", "text", (F.col("k") + F.when(F.col("first"), F.col("turns")).otherwise(0)).alias("seq"), F.get(F.array(*map(F.lit, template.states)), own).alias("state"))

    def segment(said: Column, loss: Column | bool = False) -> Column:
        return F.struct(said.alias("text"), F.lit(loss).alias("loss") if isinstance(loss, bool) else loss.alias("loss"))

    before, middle, after = template.other
    opened = F.concat(F.lit(before), template.escaped(F.col("role")), F.lit(middle))
    closed = F.lit(after)
    for name, (ahead, behind) in template.turns.items():
        opened, closed = F.when(F.col("role") == name, F.lit(ahead)).otherwise(opened), F.when(F.col("role") == name, F.lit(behind)).otherwise(closed)
    body = segment(template.escaped(F.col("text")), F.col("role").isin(*template.learned))
    opening = F.concat(F.when(F.col("seq") == 0, F.lit(template.begin)).otherwise(""), opened)
    out = written(rows.select("conv_id", "seq", F.array(segment(opening), body, segment(closed)).alias("segments"), "state"), "chat-segments")
    forget(turns)
    return out


def read(formatted: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """What ``write`` wrote, as conversations' digests: roles and texts parsed from the text, the learned ones from the mask.

    ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``, ``valid``, ``refused_at``.
    A digest is a chain over a whole conversation, so one task takes it turn by turn and holds one turn of it at a time.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "refused_at"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, begun, current, types = [], False, None, None

        def close():
            done.append([current, n, turns.hexdigest(), chars, loss.hexdigest(), size, refused is None and state in template.final, refused])

        def out():
            columns = list(zip(*done)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
            for name, seq, segments, now in zip(*(batch.column(c) for c in ("conv_id", "seq", "segments", "state"))):
                name, segments = name.as_py(), segments.as_py()
                if not begun or name != current:
                    if begun:
                        close()
                    begun, current, n, chars, size, refused = True, name, 0, 0, 0, None
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                said = "".join(s["text"] for s in segments)
                for who, what in template.parse(said):
                    turns.update(f"{who}\n{what}\n".encode())
                    n += 1
                size += len(said)
                for s in segments:
                    if s["loss"]:
                        learned = template.unescaped(s["text"])
                        chars += len(learned)
                        loss.update(learned.encode())
                state = now.as_py()
                if state == "refused" and refused is None:
                    refused = seq.as_py()
            if done:
                yield out()
                done.clear()
        if begun:
            close()
            yield out()

    more = StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, refused_at long")
    schema = StructType([StructField("conv_id", formatted.schema["conv_id"].dataType), *more.fields])
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(frugal(digest), schema)


def round_trip(conversations: DataFrame, template: Template = INSTRUCTIONS, **columns: str) -> DataFrame:
    """``read`` of what ``write`` wrote."""
    return read(write(conversations, template, **columns), template)
