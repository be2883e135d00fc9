"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: its context is all turns before it, and only its reply is trainable. Every
conversation is expanded into these examples, one row each, with the context written out:

* ``text``: what the example adds to the one before, the turns since the last reply and this reply, with the part that is trainable;
* ``context``: all formatted turns before ``text``, so ``context || text`` is the whole example;
* ``context_chars``: the length of the context.

The output grows with the square of a conversation's length; a task keeps one example, and hands over few of long ones at a time. Turns
after the last reply make a row without a target, and so does every ``PART_CHARS`` characters of turns without a reply: these are no
examples, and refer to the row in front instead of a context (``context_from`` is their own number).

``CONTEXT_CHARS`` may be set for a shared form: a longer context is not written then but begins at the row ``context_from`` of its
conversation, and the full example ``context_from - 1`` (its own context and text) comes before it. ``render`` gives those in full.

Rows are read in order, one after the other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import BLOCK_CHARS, map_texts

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
PART_CHARS = 1_000_000
#: Characters of a context at most; None writes every context whole.
CONTEXT_CHARS: int | None = None
TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)


def escape(text: str) -> str:
    """One backslash more in every ``<|``, ``<\\|``, ...: the result has no ``<|``."""
    return ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where its text begins and ends."""
    head = f"{OPEN}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(text)]


def in_order(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = conversations.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
          for c, n in ((role_col, "role"), (text_col, "text"))])
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def chat_examples(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """Rows conv_id, example (row number from 0), text, context_chars, n_turns, loss_start, loss_end (in ``text``; null without a
    target), context_from, context, as described above. Within a partition the rows of a conversation stand together, in order.

    Turns are ordered by turn (null first), then role and text; repeated rows are turns of their own. A null
    text or role is empty; a null conv_id is a conversation of its own. Other columns are ignored; an empty table
    gives an empty result.
    """
    source = in_order(conversations, conv_col, turn_col, role_col, text_col)
    limit = CONTEXT_CHARS
    names = ("conv_id", "example", "text", "context_chars", "n_turns", "loss_start", "loss_end", "context_from", "context")

    def expand(blocks) -> Iterator[dict]:
        at: object = None
        begun = False
        example = context = n = since = 0
        written: list[str] = []
        parts: list[str] = []
        size = held = 0

        def emit(out, loss):
            nonlocal example, context, n, parts, size, since, written, held
            text, before, begin = "".join(parts), "", example
            if limit is not None or loss[0] is not None:
                before, begin = "".join(written), since
                written = [before]
            for name, x in zip(names, (at, example, text, context, n, *loss, begin, before)):
                out[name].append(x)
            held += len(text) + len(before)
            example, context, n, parts, size = example + 1, context + size, 0, [], 0
            if limit is None or loss[0] is not None and len(before) + len(text) <= limit:
                written.append(text)
            else:
                since, written = example, []

        out: dict[str, list] = {k: [] for k in names}
        for convs, _, roles, block in blocks:
            for conv, role, text in zip(convs, roles, block):
                if not begun or conv != at:
                    if parts:
                        emit(out, (None, None))
                    at, begun, example, context, since, written = conv, True, 0, 0, 0, []
                marked, start, end = format_turn(role, text)
                parts.append(marked)
                n += 1
                if role == target_role:
                    loss = size + start, size + end
                    size += len(marked)
                    emit(out, loss)
                else:
                    size += len(marked)
                    if size >= PART_CHARS:
                        emit(out, (None, None))
                if held >= BLOCK_CHARS:
                    yield out
                    out, held = {k: [] for k in names}, 0
            yield out
            out, held = {k: [] for k in names}, 0
        if parts:
            emit(out, (None, None))
        yield out

    kind = source.schema["conv_id"].dataType.simpleString()
    return map_texts(source, expand, f"conv_id {kind}, example long, text string, context_chars long, n_turns long, "
                     "loss_start long, loss_end long, context_from long, context string", text_at=3)


ROW = ("conv_id", "example", "context_chars", "loss_start", "loss_end", "text", "context_from", "context")


def _by_row(examples: DataFrame) -> DataFrame:
    """The examples with a conversation's rows together and in order."""
    return examples.select(*ROW).repartition("conv_id").sortWithinPartitions("conv_id", "example")


def digests(examples: DataFrame, standing: bool = False) -> DataFrame:
    """Per conversation, read back from the examples of ``chat_examples``: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars (each turn once), n_examples, expanded_chars (all examples in full), contexts_sha256 (of the
    digests of the full contexts, in order).

    ``standing``: the examples come straight from ``chat_examples``, which leaves them together and in order; they are not shuffled then.
    """
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples",
             "expanded_chars", "contexts_sha256")

    def read_back(blocks) -> Iterator[dict]:
        at: object = None
        begun = False
        turns = loss = told = before = contexts = None
        n = loss_chars = chars = targets = expanded = since = 0

        def done(out):
            for name, x in zip(names, (at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, targets, expanded,
                                       contexts.hexdigest())):
                out[name].append(x)

        for convs, _, lengths, starts, ends, block, begins, written in blocks:
            out = {k: [] for k in names}
            for conv, length, start, end, text, begin, context in zip(convs, lengths, starts, ends, block, begins, written):
                if not begun or conv != at:
                    if begun:
                        done(out)
                    at, begun = conv, True
                    turns, loss, told, before, contexts = (hashlib.sha256() for _ in range(5))
                    n = loss_chars = chars = targets = expanded = since = 0
                if begin != since:
                    since, before = begin, told.copy() if begin else hashlib.sha256()
                if start is not None:
                    target = unescape(text[start:end])
                    loss.update(target.encode())
                    loss_chars += len(target)
                    targets += 1
                    expanded += length + len(text)
                    full = before.copy()
                    full.update(context.encode())
                    contexts.update(full.digest())
                for role, body in parse_turns(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                told.update(text.encode())
                chars += len(text)
            yield out
        out = {k: [] for k in names}
        if begun:
            done(out)
        yield out

    kind = examples.schema["conv_id"].dataType.simpleString()
    rows = examples.select(*ROW) if standing else _by_row(examples)
    return map_texts(rows, read_back, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                     "loss_sha256 string, formatted_chars long, n_examples long, expanded_chars long, contexts_sha256 string", text_at=7)


def render(examples: DataFrame) -> DataFrame:
    """Every example in full: conv_id, example, context, target_text (still escaped and marked), in tasks that read a
    conversation's rows in order. The output grows with the square of a conversation's length."""

    def unfold(blocks) -> Iterator[dict]:
        at: object = None
        before = last = ""
        since = 0
        for convs, numbers, _, starts, ends, block, begins, written in blocks:
            for conv, number, start, end, text, begin, context in zip(convs, numbers, starts, ends, block, begins, written):
                if conv != at or not number:
                    before = ""
                elif begin != since:
                    before = before + last if begin else ""
                at, since, last = conv, begin, context + text
                if start is not None:
                    yield {"conv_id": [conv], "example": [number], "context": [before + context + text[:start]],
                           "target_text": [text[start:end]]}

    kind = examples.schema["conv_id"].dataType.simpleString()
    return map_texts(_by_row(examples), unfold, f"conv_id {kind}, example long, context string, target_text string", text_at=5)
