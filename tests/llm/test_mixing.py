"""Source mixing against plain definitions."""

import heapq
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyward.llm.mixing import BLOCK, apportion, first_true, mix_sources

SCHEMA = "doc_id long, text string, source string, target string, rank int, `end` double, votes int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5, 3) for r in rows], SCHEMA)


def targets(sizes):
    """By the definition: share by weight, cut at twice the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), {s for s in names if sizes[s]}, dict.fromkeys(names, 0.0)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit >= 2 * sizes[s]}
        if not full:
            out |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(rows, got, slack):
    size = {r[0]: len(re.findall(r"[^ \t-\r]+", r[1] or "")) for r in rows}
    total = defaultdict(int)
    for i, _, s in rows:
        total[s] += size[i]
    want, taken = targets(total), defaultdict(int)
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]]
        assert abs(r["target"] - want[r["source"]]) <= 1e-9 * max(want[r["source"]], 1)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in total:
        assert abs(taken[s] - want[s]) <= slack, (s, taken[s], want[s])


def test_targets_and_words_taken(spark):
    rng = random.Random(3)
    rows, i = [], 0
    for k, source in enumerate(["a", "b", "B", "é", "z", "long name", "", None, "none"]):
        for _ in range(rng.randrange(1, 40) if source != "a" else 400):
            text = rng.choice([None, "", " \t\n"]) if rng.random() < 0.1 or source == "none" else \
                " ".join(["w x"] * rng.randrange(1, 200))
            rows.append((i, text, source))
            i += 1
    rows.append((i, "word\n" * 50_000, "b"))
    df = frame(spark, rows)
    got = mix_sources(df).collect()
    check(rows, got, BLOCK)
    again = mix_sources(df.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    check(rows, mix_sources(df, docs_per_shard=50).collect(), 9 * BLOCK)


def test_repeated_rows_empty_table_and_no_words(spark):
    rows = [(1, "one two three", "a")] * 5 + [(2, "four", "b")] * 3
    got = mix_sources(frame(spark, rows), block=1).collect()
    assert len(got) == 8 and abs(sum(r["taken"] for r in got) - 27) <= 1
    assert mix_sources(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mix_sources(frame(spark, [(None, None, None), (1, "", "a")])).collect()] == [0, 0]


def test_quotas_are_the_highest_quotients(spark):
    """Many equal votes, so that ties decide; against a heap."""
    rng = random.Random(9)
    for votes, blocks in [([10.0] * 40, 95), ([rng.choice([1.0, 2.0, 5.0, 0.0]) for _ in range(60)], 77),
                          ([rng.random() * 1000 for _ in range(50)], 1234), ([3.0, 1e9], 5), ([0.0, 0.0], 3), ([7.0], 0)]:
        heap = [(-v / 0.5, p) for p, v in enumerate(votes) if v]
        heapq.heapify(heap)
        want = Counter()
        for _ in range(blocks if heap else 0):
            _, p = heap[0]
            want[p] += 1
            heapq.heapreplace(heap, (-votes[p] / (want[p] + 0.5), p))
        cells = spark.createDataFrame(list(enumerate(votes)), "place long, votes double")
        got = {r["place"]: r["quota"] for r in apportion(cells, blocks).collect()}
        assert got == {p: want[p] for p in range(len(votes))}


def test_first_true():
    for low, high, answer in [(0, 0, 0), (0, 10**18, 123_456_789_012), (-50, 1000, -50), (5, 70, 70)]:
        assert first_true(lambda xs: [x >= answer for x in xs], low, high) == answer


def test_no_python_in_the_plan(spark):
    df = mix_sources(frame(spark, [(1, "a b", "s"), (2, "c", None)]))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert df.filter(F.col("taken") > 2 * F.col("size")).count() == 0
