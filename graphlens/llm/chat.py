"""Chat formatting in budgeted windows of whole turns.

Turns of a conversation are walked in order with the running sum of their tokens (words, and one for the
marks). A window holds the system turn if the conversation opens with one, then the last turns before its
own as history, up to ``history`` tokens and no more than leaves room for its first own turn, then its own turns:
at least one and as many as fit in ``budget``. So a window is over budget only if the system turn and a single
turn are, and then it has no history. Each turn is some window's own once. The loss mask covers the texts of own assistant turns;
the system turn and history repeat without loss.

Marks are control strings, so control strings inside roles and texts are escaped: a word joiner goes in
after the first character, one more if some are there already; taking one out undoes it. A role ends at the
first line break, so line breaks in roles become \\n, and backslashes double.

Conversations are streamed: rows come sorted by conversation and turn, and a task holds one window and
its history, never a conversation. Turns that tie go by role, then text. Null roles and texts are empty;
null ids are a conversation; a repeated row is a turn of its own; extra columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_table

BUDGET, HISTORY = 1024, 256
OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Strings that templates in use take as control, this one's first.
CONTROL = (OPEN, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>")
JOINER = "⁠"
_ANY = re.compile("|".join(re.escape(c[0]) + f"{JOINER}*" + re.escape(c[1:]) for c in CONTROL))
_WINDOW = "conv_id long, has_id boolean, window int, first_own int, text string, loss array<struct<start:int,stop:int>>"


def escape(text: str) -> str:
    return _ANY.sub(lambda m: m[0][0] + JOINER + m[0][1:], text)


def unescape(text: str) -> str:
    return _ANY.sub(lambda m: m[0][0] + (m[0][2:] if m[0][1] == JOINER else m[0][1:]), text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def _tokens(text: str) -> int:
    return len(text.split()) + 1


def windows_of(turns: Iterator[tuple[str, str]], budget: int, history: int) -> Iterator[tuple[int, list[tuple[str, str]], int]]:
    """Number, turns and index of the first own turn of each window of one conversation, in order."""
    system: tuple[str, str] | None = None
    past: list[tuple[str, str]] = []
    own: list[tuple[str, str]] = []
    number = used = 0
    fixed = 0
    for n, turn in enumerate(turns):
        cost = _tokens(turn[1])
        if own and used + cost > budget:
            head = [system] if system and number else []
            yield number, [*head, *past, *own], len(head) + len(past)
            recent, room = [], min(history, budget - fixed - cost)
            for t in reversed([*past, *own][1 if system and not number else 0 :]):
                if (room := room - _tokens(t[1])) < 0:
                    break
                recent.append(t)
            past, own, number = recent[::-1], [], number + 1
            used = fixed + sum(_tokens(t[1]) for t in past)
        if n == 0 and turn[0] == "system":
            system, fixed = turn, cost
        own.append(turn)
        used += cost
    if own:
        head = [system] if system and number else []
        yield number, [*head, *past, *own], len(head) + len(past)


def format_window(turns: list[tuple[str, str]], first_own: int) -> tuple[str, list[dict]]:
    parts, at, loss = [], 0, []
    for i, (role, text) in enumerate(turns):
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if i >= first_own and role == "assistant":
            loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), loss


def parse_window(text: str) -> Iterator[tuple[str, str]]:
    for part in text.split(OPEN)[1:]:
        role, _, body = part.partition("\n")
        assert body.endswith(CLOSE + "\n"), "a turn without its end"
        yield unescape_role(role), unescape(body[: -len(CLOSE) - 1])


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Rows as tuples."""
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns))


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Neighbours with equal first two values, each group an iterator that is read as it comes."""
    ahead = next(rows, None)

    def group(key):
        nonlocal ahead
        while ahead is not None and ahead[:2] == key:
            row, ahead = ahead, next(rows, None)
            yield row

    while ahead is not None:
        key = ahead[:2]
        mine = group(key)
        yield key, mine
        for _ in mine:
            pass


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, has_id, window, first_own, text, loss: the formatted windows, sorted within a partition."""
    schema = pa.schema([("conv_id", pa.int64()), ("has_id", pa.bool_()), ("window", pa.int32()), ("first_own", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for key, group in _groups(_runs(batches, ["conv_id", "has_id", "role", "text"])):
            for number, content, first in windows_of(((r[2], r[3]) for r in group), budget, history):
                text, loss = format_window(content, first)
                held.append((*key, number, first, text, loss))
                if len(held) >= 256:
                    yield out()
        if held:
            yield out()

    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNotNull().alias("has_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.repartition("conv_id", "has_id").sortWithinPartitions("conv_id", "has_id", "turn", "role", "text").select("conv_id", "has_id", "role", "text").mapInArrow(run, _WINDOW)


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from formatted windows, which
    come sorted as ``format_conversations`` leaves them; a conversation whose windows are not 0, 1, 2, ... in one
    partition is an error.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for key, group in _groups(_runs(batches, ["conv_id", "has_id", "window", "first_own", "text", "loss"])):
            turns, under = hashlib.sha256(), hashlib.sha256()
            n = chars = size = 0
            for number, (_, _, window, first, text, loss) in enumerate(group):
                if window != number:
                    raise ValueError(f"window {window} of conversation {key[0]} where {number} is due")
                size += len(text)
                for i, (role, body) in enumerate(parse_window(text)):
                    if i >= first:
                        n += 1
                        turns.update(f"{role}\n{body}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["stop"]])
                    chars += len(said)
                    under.update(said.encode())
            held.append((key[0] if key[1] else None, n, turns.hexdigest(), chars, under.hexdigest(), size))
            if len(held) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)
                held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """All conversations, and one numbered -1 whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = small_table(conversations.sparkSession, [{"conv_id": -1, "turn": i, "role": r, "text": said} for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
