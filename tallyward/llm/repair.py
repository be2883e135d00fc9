"""Conversation structure repair by depth-first branch and bound.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. The repair keeps (K), reroles (R) or deletes (D) each row
and inserts (I) empty rows; ``cheapest_repair`` finds the edits of least cost and, among those, of least audit string.

The search works on one byte per row (its initial and its fault), never on texts: a first pass shuffles ids, order and digests
only and finds each conversation's audit; a second one streams the rows of a conversation behind its audit and digests
what the edits make of them. A task so holds about 30 bytes per row of its longest conversation, beside an output
cell (the audit) of at least a byte per row. Whether a text was seen earlier is settled by an aggregation per conversation and
text before that, so no task gathers the texts of a conversation.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import map_texts

# The costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What the repaired prefix is: nothing yet, a system row, complete up to a user row, complete up to an assistant row.
START, SYSTEM, USER, REPLY = range(4)
#: The initial a row needs to extend the prefix (a user row, but for the second), and the prefix it makes.
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", REPLY), REPLY: ("u", USER)}
ROLE = {"u": "user", "a": "assistant"}
#: Faults of a row; blank and duplicate rows have to be deleted.
FINE, CUT_OFF, BLANK, REPEATED = range(4)
INITIALS = "?sua"
SPACES = r"\x20\x09-\x0D"


def row_code(initial: str, fault: int) -> int:
    return fault * len(INITIALS) + max(INITIALS.find(initial or "?"), 0)


def row_options(code: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits of a row in ASCII order; an insertion stays at the row."""
    fault, initial = code // len(INITIALS), INITIALS[code % len(INITIALS)]
    need, after = NEXT[state]
    out = [("D", DELETE, state), ("I", INSERT, after)]
    if fault in (FINE, CUT_OFF):
        extra = TRUNCATED if fault == CUT_OFF else 0
        if initial == need:
            out.append(("K", extra, after))
        elif initial == "s" and state == START:
            out.append(("K", extra, SYSTEM))
        out.append(("R", REROLE + extra, after))
    return out


OPTIONS = [[row_options(code, state) for state in range(4)] for code in range(4 * len(INITIALS))]


def suffix_bounds(codes: bytes) -> list[array]:
    """Per state, the least cost of the rows from each place on if the repaired conversation could end anywhere. The end
    condition is the only one relaxed, so the bound is at most two insertions below the truth."""
    n = len(codes)
    bound = [array("q", bytes(8 * (n + 1))) for _ in range(4)]
    for i in range(n - 1, -1, -1):
        later = [b[i + 1] for b in bound]
        here = [min(cost + later[to] for edit, cost, to in OPTIONS[codes[i]][state] if edit != "I") for state in range(4)]
        for _ in range(3):  # an insertion leads on to a state of the same row; three in a row reach all
            here = [min(here[state], INSERT + here[NEXT[state][1]]) for state in range(4)]
        for state in range(4):
            bound[state][i] = here[state]
    return bound


def cheapest_repair(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, of least audit where several cost the same.

    Depth first with an explicit stack, edits in ASCII order, so paths come in the order of their audits. A node is a place and
    a state; its dominance entry is the least cost that reached it, and a prefix that comes later and costs no less is cut
    off: it has the greater audit. So is one whose cost and suffix bound exceed the incumbent's cost. The first incumbent
    is a dive along the bounds.
    """
    n = len(codes)
    bound = suffix_bounds(codes)
    last = [("I", INSERT, NEXT[state][1]) for state in range(4)]
    # the dive: the cheapest edit by bound at each node
    at, state, cost, dive = 0, START, 0, bytearray()
    while at < n or state in (SYSTEM, USER):
        if at == n:
            edit, step, to = last[state]
        else:
            edit, step, to = min(OPTIONS[codes[at]][state], key=lambda o: o[1] + bound[o[2]][at + (o[0] != "I")])
        dive += edit.encode()
        cost, at, state = cost + step, at + (edit != "I"), to
    best, audit, final = cost, bytes(dive), False
    # the search; ``final`` tells that the incumbent was found in audit order, so that equal costs cannot better it
    dominance = [array("q", [-1]) * (n + 1) for _ in range(4)]
    path = bytearray()
    stack = [(0, START, 0, 0, 0)]
    while stack:
        at, state, cost, depth, edit = stack.pop()
        if cost + bound[state][at] + final > best:
            continue
        seen = dominance[state][at]
        if 0 <= seen <= cost:
            continue
        dominance[state][at] = cost
        del path[depth:]
        if edit:
            path.append(edit)
        if at == n:
            if state in (START, REPLY):  # further edits only cost more
                if cost < best or bytes(path) <= audit:
                    best, audit, final = cost, bytes(path), True
                continue
            options = [last[state]]
        else:
            options = OPTIONS[codes[at]][state]
        depth = len(path)
        for name, step, to in reversed(options):
            on = at + (name != "I")
            if cost + step + bound[to][on] + final <= best:
                stack.append((on, to, cost + step, depth, ord(name)))
    return best, audit.decode()


@lru_cache(maxsize=50_000)
def repair_of_short(codes: bytes) -> tuple[int, str]:
    """``cheapest_repair``, kept: short conversations repeat their codes."""
    return cheapest_repair(codes)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """The rows after the planned damage: conv_id, turn, role, text, dropped. By crc32 of ``conv_id:turn`` modulo 20: 0 drops the
    row (it stays here, marked), 1 empties the text, 2 removes its ``.!?``, 3 repeats the row, 4 sets the role user. A null
    reads as one space, but a null turn stays null for the order and a null conv_id stays null."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col))) % 20
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
                                blank(role_col).alias("role"), blank(text_col).alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
        .alias("text"), (F.col("kind") == 0).alias("dropped"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def judged_rows(rows: DataFrame) -> DataFrame:
    """Per row, without its text: conv_id, turn, initial, digest (of role and text), again (an earlier turn of the conversation said
    the same; equal rows of one turn stand side by side later and are told there), dropped, blank, cut_off."""
    slim = rows.select(
        "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "digest", "dropped",
        (~F.col("text").rlike(f"[^{SPACES}]")).alias("blank"),
        (~F.col("text").rlike(f"[.!?][{SPACES}]*\\z")).alias("cut_off"))
    said = rows.filter("not dropped").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(
        F.count(F.lit(1)).alias("times"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unplaced"))
    said = said.filter("times > 1").drop("times")
    again = F.col("turn").isNotNull() & (F.col("unplaced") | (F.col("turn") > F.col("first")))
    return slim.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left").select(
        "conv_id", "turn", "initial", "digest", F.coalesce(again, F.lit(False)).alias("again"), "dropped", "blank", "cut_off")


def plan_repairs(judged: DataFrame) -> DataFrame:
    """One row per conversation of ``judged_rows``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    slim = judged.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "digest")
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    legal = {"su", "ua", "au"}

    def plan(blocks) -> Iterator[dict]:
        at: object = None
        begun = False
        codes, counts, illegal, turns, low, previous = bytearray(), [0] * 4, 0, 0, None, None

        def done(out):
            cost, audit = repair_of_short(bytes(codes)) if len(codes) <= 64 else cheapest_repair(bytes(codes))
            gaps = 0 if low is None else previous[0] - low + 1 - turns
            for name, x in zip(names, (at, gaps, counts[BLANK], counts[REPEATED], counts[CUT_OFF], illegal, cost, audit)):
                out[name].append(x)

        for block in blocks:
            out = {k: [] for k in names}
            for conv, turn, initial, digest, again, dropped, blank, cut_off in zip(*block):
                if not begun or conv != at:
                    if begun:
                        done(out)
                    at, begun = conv, True
                    codes, counts, illegal, turns, low, previous = bytearray(), [0] * 4, 0, 0, None, None
                if dropped:
                    continue
                repeated = again or (previous is not None and previous[0] == turn and previous[2] == digest)
                fault = BLANK if blank else REPEATED if repeated else CUT_OFF if cut_off else FINE
                counts[fault] += 1
                codes.append(row_code(initial, fault))
                if previous is not None and previous[1] + initial not in legal:
                    illegal += 1
                if turn is not None:
                    low = turn if low is None else low
                    turns += previous is None or previous[0] != turn
                previous = (turn, initial, digest)
            yield out
        out = {k: [] for k in names}
        if begun:
            done(out)
        yield out

    kind = judged.schema["conv_id"].dataType.simpleString()
    return map_texts(slim, plan, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, "
                     "cost long, audit string", text_at=3)


def repaired_turns(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """What the edits make of a conversation's (role, text) rows, one after the other."""
    state = START
    for edit in audit:
        need, after = NEXT[state]
        if edit == "I":
            yield ROLE[need], ""
            state = after
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            after = SYSTEM
        yield (role if edit == "K" else ROLE[need]), text
        state = after


def repair_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", damage: bool = True,
                         keep_turns: bool = False) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; or, with
    ``keep_turns``, its repaired turns: conv_id, position, role, text.

    Rows are taken by turn (null first), rows of one turn by the digest of role and text. The first fault of a row counts: blank (no
    character other than white space), duplicate (same role and text earlier in the conversation), truncated (its last
    such character is no ``.!?``). Roles count by their first character, which is case-sensitive. A null role or text is one
    space, a null conv_id a conversation of its own. A conversation without rows after the damage has zeros, an empty audit
    and the digest of nothing. Gaps are those of the numbers between the least and the greatest turn. Other columns are
    ignored; an empty table gives an empty result. ``damage=False`` repairs the rows as they are.
    """
    rows = damaged(conversations, conv_col, turn_col, role_col, text_col) if damage else conversations.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
        F.lit(False).alias("dropped"))
    digest_of = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))
    rows = rows.withColumn("digest", F.unhex(digest_of))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    plans = plan_repairs(judged_rows(rows)).select(
        "conv_id", F.lit(0).alias("part"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
        F.lit(None).cast("binary").alias("digest"), F.lit("").alias("role"), F.col("audit").alias("text"), *counts)
    # the audit stands before the rows of its conversation
    body = rows.filter("not dropped").select("conv_id", F.lit(1).alias("part"), "turn", "digest", "role", "text",
                                             *[F.lit(None).cast("long").alias(c) for c in counts])
    both = plans.unionByName(body).repartition("conv_id").sortWithinPartitions(
        "conv_id", "part", F.asc_nulls_first("turn"), "digest").drop("digest", "turn")

    def conversations_of(blocks) -> Iterator[tuple]:
        """(conv_id, counts, audit, rows to be read before the next one is asked for)."""
        stream = (row for block in blocks for row in zip(*block))
        head = next(stream, None)
        while head is not None:
            conv, _, _, audit, *numbers = head
            head = None

            def body_rows():
                nonlocal head
                for row in stream:
                    if row[1] == 0:
                        head = row
                        return
                    yield row[2], row[3]

            rest = body_rows()
            yield conv, numbers, audit, rest
            for _ in rest:
                pass

    def digest(blocks) -> Iterator[dict]:
        names = ("conv_id", *counts, "audit", "repaired_sha256")
        out: dict[str, list] = {k: [] for k in names}
        for conv, numbers, audit, rest in conversations_of(blocks):
            sha = hashlib.sha256()
            for k, (role, text) in enumerate(repaired_turns(audit, rest)):
                sha.update(("\n" * (k > 0) + f"{role}:{text}").encode())
            for name, x in zip(names, (conv, *numbers, audit, sha.hexdigest())):
                out[name].append(x)
            if len(out["audit"]) == 10_000:
                yield out
                out = {k: [] for k in names}
        yield out

    def unfold(blocks) -> Iterator[dict]:
        names = ("conv_id", "position", "role", "text")
        out: dict[str, list] = {k: [] for k in names}
        size = 0
        for conv, _, audit, rest in conversations_of(blocks):
            for k, (role, text) in enumerate(repaired_turns(audit, rest)):
                for name, x in zip(names, (conv, k, role, text)):
                    out[name].append(x)
                size += len(text) + 50
                if size > 1_000_000:
                    yield out
                    out, size = {k: [] for k in names}, 0
        yield out

    kind = rows.schema["conv_id"].dataType.simpleString()
    if keep_turns:
        return map_texts(both, unfold, f"conv_id {kind}, position long, role string, text string", text_at=3)
    return map_texts(both, digest, f"conv_id {kind}, {', '.join(c + ' long' for c in counts)}, audit string, "
                     "repaired_sha256 string", text_at=3)
