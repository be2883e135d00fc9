import random
from array import array

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402

from tallyward.llm.pretokens import load_tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of which it is known which stage takes them."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("bcdfghklmnprst", k=3)) + rng.choice("aeiou") + rng.choice("lmnr")
    pool = sorted({word() for _ in range(2500)})
    prose = lambda n: " ".join(rng.choices(pool, k=n))
    items = [(k, prose(30)) for k in range(8)]
    docs, labels, fate = [], [], {}

    def add(text, what):
        docs.append((len(docs), text, "en", f"src{len(docs) % 5}", len(text or ""), 0.5, "x"))
        fate[len(docs) - 1] = what
        return len(docs) - 1

    for k in range(240):
        toxic = k % 4 == 0
        words = prose(60).split()
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(["grobble", "snarfed"]))
        labels.append((add(" ".join(words), "toxicity" if toxic else "kept"), 1, int(toxic)))
    for _ in range(6):
        base = prose(80).split()
        add(" ".join(base), "kept")
        for k in range(4):
            base[k * 20] = "changed"
            add(" ".join(base).upper() if k == 0 else " ".join(base), "near_duplicates" if k < 1 else "maybe")
    for k, text in items:
        add(f"{prose(40)} {text.upper()} {prose(40)}", "decontamination")
    private = add(f"{prose(30)} write to someone@example.com or +1 (555) 010-9999 {prose(10)}", "kept")
    for text in (None, "", "...", "two words"):
        add(text, "kept")
    docs += [(None, prose(20), None, None, None, None, None), (len(docs) - 1, "two words", "en", "src1", 9, 0.5, "x")]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string") \
        .write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, {d[0]: d[1] for d in docs}, fate, private


def test_stages_take_what_they_should(spark, folder):
    path, texts, fate, private = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:4]:
        before = docs
        docs = cp.staged(stage(spark, docs, path), "test")
        assert docs.columns == columns
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        gone = {r["doc_id"] for r in before.select("doc_id").collect()} - left
        assert {i for i in gone if fate[i] != "maybe"} == {i for i, f in fate.items() if f == name}, name
        assert None in left
    assert docs.count() == docs.select("doc_id").distinct().count()  # one row of the repeated id is left
    row, = docs.filter(docs.doc_id == private).collect()
    assert "[EMAIL]" in row["text"] and "[PHONE]" in row["text"] and "example.com" not in row["text"]
    assert row["n_chars"] == len(row["text"])
    tokenizer = load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    pieces = cp.STAGES[4][1](spark, docs, path).collect()
    assert sum(p["length"] for p in pieces) == want


def test_stages_of_an_empty_table(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = cp.staged(stage(spark, docs, path), "empty")
        assert docs.count() == 0


def test_rows_without_id_and_texts_that_share_one(spark, folder):
    """Stages judge rows: two texts under one id, copies and leaks without an id."""
    path = folder[0]
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices("bcdfgklmnprstaeiou", k=6)) for _ in range(n))
    first, second, loose = prose(60), prose(60), prose(60)
    leak = spark.read.parquet(f"{path}/benchmark.parquet").first()["text"]
    rows = [(7, first), (7, second), (9, second.upper()), (8, first), (None, loose), (None, loose), (None, f"{prose(30)} {leak}"),
            (7, f"{prose(30)} {leak}"), (3, loose), (None, None), (None, None)]
    docs = cp.staged(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row_key string"), "shared")
    kept = cp.staged(cp.near_duplicate_groups(spark, docs, path), "kept")
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
    want = [(7, first), (7, second), (3, loose), rows[6], rows[7], (None, ""), (None, "")]
    assert got == sorted((str(i), t or "") for i, t in want)
    clean = cp.decontamination(spark, kept, path)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in clean.collect()) == sorted(
        (str(i), t or "") for i, t in want if leak not in (t or ""))


def test_marked_rows_shuffle_no_text(spark):
    """Exact for numbers far apart, as monotonically increasing ones are; rows meet broadcast bitmaps."""
    rng = random.Random(6)
    numbers = sorted({part << 33 | at for part in (0, 1, 7) for at in rng.sample(range(100_000), 400)} | {0, 32_767, 32_768, 65_536})
    chosen = set(rng.sample(numbers, 500)) | {0, 32_767}
    rows = spark.createDataFrame([(n, f"t{n}") for n in numbers], "n long, bits string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = cp.marked(rows, "n", spark.createDataFrame([(n,) for n in chosen], "k long"))
        assert {tuple(r) for r in found.collect()} == {(n, f"t{n}") for n in chosen}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert cp.marked(rows, "n", spark.createDataFrame([], "k long")).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
