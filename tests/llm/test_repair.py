"""Conversation repair against plain definitions."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tallyward.llm.repair import cheapest_repair, damaged, repair_conversations, row_code

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, audit double, digest int, `part` string"


def least(rows):
    """(cost, audit, repaired turns) by trying all edits; rows are (initial, role, text, must go, penalty)."""

    @lru_cache(None)
    def best(i, made, inserted):
        found = []
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made) or (i == len(rows) and made in ("R",)):
            found.append((0, "", ()))
        if i < len(rows):
            initial, role, text, gone, penalty = rows[i]
            choices = [(4, "D", made, ())]
            if not gone:
                choices += [(penalty, "K", made + initial if len(initial) == 1 else made + "?", ((role, text),))]
                choices += [(3 + penalty, "R", made + r[0], ((r, text),)) for r in ("user", "assistant")]
            for cost, edit, after, turns in choices:
                if re.fullmatch("s?(ua)*u?", after):
                    rest = best(i + 1, after, 0)
                    if rest:
                        found.append((cost + rest[0], edit + rest[1], turns + rest[2]))
        if inserted < 3:
            for r in ("user", "assistant"):
                if re.fullmatch("s?(ua)*u?", made + r[0]):
                    rest = best(i, made + r[0], inserted + 1)
                    if rest:
                        found.append((3 + rest[0], "I" + rest[1], ((r, ""),) + rest[2]))
        return min(found, key=lambda f: f[:2]) if found else None

    return best(0, "", 0)


def expected(rows, damage=True):
    """conv_id -> result, from (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if v is None else v for v in (role, text))
            key = ":".join(" " if v is None else str(v) for v in (c, turn))
            kind = zlib.crc32(key.encode()) % 20 if damage else 9
            if kind == 0:
                continue
            if kind == 1:
                text = ""
            if kind == 2:
                text = re.sub("[.!?]", "", text)
            if kind == 4:
                role = "user"
            kept += [(turn, role, text)] * (2 if kind == 3 else 1)
        order = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, order(r)))
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for turn, role, text in kept:
            bare = text.strip(SPACE)
            fault = None if bare and (role, text) not in seen and bare[-1] in ".!?" else \
                "blank" if not bare else "duplicate" if (role, text) in seen else "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role[:1], role, text, fault in ("blank", "duplicate"), 3 * (fault == "truncated")))
        turns = {r[0] for r in kept if r[0] is not None}
        cost, audit, repaired = least(tuple(marked))
        out[conv] = {
            "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **counts,
            "illegal": sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])), "cost": cost,
            "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()}
    return out


def results(df):
    return {r["conv_id"]: r.asDict() for r in df.collect()}


def make(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 7, "x") for r in rows], SCHEMA)


def test_search_equals_trying_everything():
    rng = random.Random(5)
    for _ in range(400):
        rows = [(rng.choice("suaxS"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(6))]
        codes = bytes(row_code(i, f) for i, f in rows)
        cost, audit, _ = least(tuple((i, i, "", f > 1, 3 * (f == 1)) for i, f in rows))
        assert cheapest_repair(codes) == (cost, audit), rows


@pytest.mark.parametrize("damage", [True, False])
def test_by_definition(spark, damage):
    rng = random.Random(11)
    texts = ["Fine.", "Fine!", "cut off", " ", "", None, "a. b", "Yes? \n", "ends ", "é."]
    rows = []
    for conv in [*range(60), None]:
        turns = rng.sample(range(12), rng.randrange(1, 6))
        for turn in turns:
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
                         rng.choice(texts)))
        if rng.random() < 0.3:
            rows += [(conv, None, "user", rng.choice(texts))] * rng.randrange(1, 3)
        if rng.random() < 0.3:
            rows.append(rng.choice(rows[-len(turns):]))
    rng.shuffle(rows)
    assert results(repair_conversations(make(spark, rows), damage=damage)) == expected(rows, damage)


def test_all_rows_dropped_and_empty_table(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = results(repair_conversations(make(spark, [(conv, 0, "user", "Hi.")])))
    assert got == {conv: {"conv_id": conv, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
                          "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}}
    assert repair_conversations(make(spark, [])).count() == 0


def test_one_long_conversation_and_its_turns(spark):
    """A conversation that holds most rows, one of them very long; the turns that come out read as they should."""
    rows = [(1, t, "user" if t % 3 else "assistant", f"Text {t}." + "x" * (500_000 if t == 50 else 0)) for t in range(5000)]
    rows += [(2, t, "user", "Same.") for t in range(30)]
    df = make(spark, rows)
    got = results(repair_conversations(df, damage=False))
    assert (got[2]["duplicate"], got[2]["cost"]) == (29, 4 * 29 + 3)
    assert got[2]["audit"] == "K" + "D" * 29 + "I"
    turns = repair_conversations(df, damage=False, keep_turns=True).orderBy("conv_id", "position").collect()
    for conv in (1, 2):
        mine = [r for r in turns if r["conv_id"] == conv]
        assert [r["position"] for r in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in mine))
        text = "\n".join(f"{r['role']}:{r['text']}" for r in mine)
        assert got[conv]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_damage_repeats_side_by_side(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 3)
    rows = damaged(make(spark, [(conv, 0, "user", "Hi.")])).collect()
    assert [(r["turn"], r["text"], r["dropped"]) for r in rows] == [(0, "Hi.", False)] * 2
