import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayloom.operators import sequence, skew


def rows(n=400, users=3, seed=7):
    rnd = random.Random(seed)
    return [(rnd.randrange(users), rnd.randrange(5000), i, rnd.random()) for i in range(n)]


@pytest.mark.parametrize("crowd", [4_000_000, 5])
def test_sliced_sessions_equal_a_plain_window(spark, monkeypatch, crowd):
    monkeypatch.setattr(sequence, "ROWS_PER_SLICE", crowd)
    df = spark.createDataFrame(rows(), "user_id long, t long, event_id long, v double")
    cut = sequence.assign_sessions(
        df, "user_id", "t", ["t", "event_id"], ["t", "v"], lambda p, c: (c.t - p.t > 30) | (c.v - p.v > 0.9), 97
    )
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    brk = F.coalesce((F.col("t") - F.lag("t").over(w) > 30) | (F.col("v") - F.lag("v").over(w) > 0.9), F.lit(True))
    want = df.withColumn("b", brk).withColumn("n", F.sum(F.col("b").cast("int")).over(w))
    first = Window.partitionBy("user_id", "n").orderBy("t", "event_id")
    want = want.withColumn("s", F.first("event_id").over(first)).select("event_id", "s", "b")
    got = cut.select("event_id", F.col("session_start.event_id").alias("s"), F.col("is_start").alias("b"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_sliced_previous_and_running_total(spark):
    df = spark.createDataFrame(rows(), "user_id long, t long, event_id long, v double")
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    got = sequence.with_previous(df, "user_id", "t", ["t", "event_id"], ["event_id"], 50)
    want = df.withColumn("p", F.lag("event_id").over(w))
    assert sorted(got.select("event_id", F.coalesce("prev.event_id", F.lit(-1))).collect()) == sorted(
        want.select("event_id", F.coalesce("p", F.lit(-1))).collect()
    )
    got = sequence.running_total(df, "user_id", "t", ["t", "event_id"], {"n": F.lit(1)}, 50)
    want = df.withColumn("n", F.row_number().over(w).cast("long"))
    assert sorted(got.select("event_id", "n").collect()) == sorted(want.select("event_id", "n").collect())


def test_dense_ids(spark):
    ids = random.Random(3).sample(range(10_000), 300)
    df = spark.createDataFrame([(i,) for i in ids], "way_id long")
    got = {r.way_id: r.n for r in sequence.dense_ids(df, "way_id", "n", 64).collect()}
    assert got == {w: k + 1 for k, w in enumerate(sorted(ids))}


def test_salted_join_equals_plain_join(spark):
    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(600)], "k long, a long")
    other = spark.createDataFrame([(k % 50, k) for k in range(200)], "k long, b long")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.salted_join(big, other, ["k"], ["a"], how, rows_per_task=20)
        want = big.join(other, "k", how)
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(got.select(want.columns).collect(), key=key) == sorted(want.collect(), key=key), how
