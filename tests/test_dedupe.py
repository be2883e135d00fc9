"""Keep-latest with only the rows of repeated keys shuffled."""

import random

from pyspark.sql import functions as F

from tallyward.operators import dedupe as d


def versions(spark, n=4_000):
    """Keys that come once, twice or often, are null or empty; text keys."""
    key = F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 51 == 0, F.lit("")).when(
        F.col("id") % 3 == 0, (F.col("id") % 700).cast("string")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
    return spark.range(n).select(key.alias("k"), (F.col("id") % 4).alias("version"), F.col("id").alias("v"))


def rows(df):
    return sorted(tuple(r) for r in df.select("v", "version", F.coalesce("k", F.lit("-"))).collect())


def test_same_rows_as_one_window_whatever_bits_collide(spark, monkeypatch):
    df, order = versions(spark), [F.desc("version"), F.asc("v")]
    want = rows(d.keep_latest(df, ["k"], order))
    for bits, hot in ((8, 10_000), (1, 10_000), (8, 2)):
        monkeypatch.setattr(d, "BITS_PER_KEY", bits)
        monkeypatch.setattr(d, "MIN_BITS", 64 if bits == 1 else 2 ** 15)
        monkeypatch.setattr(d, "HOT_ROWS", hot)
        assert rows(d.keep_latest_repeated(df, ["k"], order)) == want


def test_rows_alone_under_their_key_are_not_shuffled(spark, tmp_path):
    rows_of = spark.range(1_000)
    text = F.when(F.col("id") < 20, "same").otherwise(F.col("id").cast("string"))
    path = str(tmp_path / "landing")
    rows_of.select(text.alias("id"), F.col("id").cast("string").alias("updated_on"), F.lit("d").alias("date"),
                   F.lit("c").alias("case_number")).write.parquet(path)
    out = d.dedupe_silver(spark.read.parquet(path))
    assert out.count() == 981
    assert {r["updated_on"] for r in out.filter("id = 'same'").collect()} == {"9"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Window [") == 1
    alone = spark.read.parquet(path).filter("id <> 'same'")
    assert "Window" not in d.dedupe_silver(alone)._jdf.queryExecution().optimizedPlan().toString()


def test_dropping_older_rows_keeps_the_rows_of_one_window(spark, monkeypatch):
    """Ties, nulls, null keys and keys of many rows, whatever bits collide."""
    monkeypatch.setattr(d, "MANY_ROWS", 1, raising=False)
    df = versions(spark, 1_500).withColumn("version", F.when(F.col("v") % 7 > 0, F.col("version")))
    order = [F.desc_nulls_last("version"), F.asc("v")]
    want = rows(d.keep_latest(df, ["k"], order))
    for bits, least, hot in ((8, 2 ** 15, 10_000), (1, 64, 10_000), (8, 2 ** 15, 2)):
        monkeypatch.setattr(d, "BITS_PER_KEY", bits)
        monkeypatch.setattr(d, "MIN_BITS", least)
        monkeypatch.setattr(d, "HOT_ROWS", hot)
        assert rows(d.keep_latest_repeated(df, ["k"], order, newest="version")) == want


def test_older_rows_of_many_repeated_facts_are_not_shuffled_whole(spark, monkeypatch):
    monkeypatch.setattr(d, "MANY_ROWS", 1, raising=False)
    whole, window = [], d.keep_latest
    monkeypatch.setattr(d, "keep_latest", lambda df, keys, order: whole.append(df.count()) or window(df, keys, order))
    now = F.timestamp_seconds(F.col("id") * 1_000)
    fact = spark.range(2_000).select(F.col("id").cast("string").alias("incident_id"), F.lit("c").alias("case_number"),
                                     F.lit(1).alias("date_key"), now.alias("incident_datetime"), F.lit("new").alias("crime_type"))
    older = fact.withColumns({"incident_datetime": F.col("incident_datetime") - F.expr("interval 1 day"), "crime_type": F.lit("OLD")})
    out = d.dedupe_fact(older.unionByName(fact))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, fact.collect()))
    assert sum(whole) < 400


def test_keep_one_takes_nulls_last_and_prunes(spark):
    """The row that an ordered window would keep; where only keys are used, the plan has neither a sort nor other columns."""
    rng = random.Random(3)
    pick = lambda *values: rng.choice(values)
    rows = [(pick(None, "a", "b"), pick(1, 2), pick(None, 1, 2), pick(None, "x", "y"), pick(None, 0.5, float("nan"))) for _ in range(120)]
    df = spark.createDataFrame(rows, "k string, j int, a int, b string, c double")
    for keys in (["k", "j"], ["j"], ["k", "j", "a", "b", "c"]):
        want = d.keep_latest(df, keys, d.full_order(df, skip=keys)) if len(keys) < 5 else df.distinct()
        got = d.keep_one(df, keys)
        assert got.schema.names == df.columns
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    plan = d.keep_one(df.repartition(2), ["k"]).select("k")._jdf.queryExecution().optimizedPlan().toString()
    assert "min(" not in plan and "Window" not in plan
