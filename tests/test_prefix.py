import random

from pyspark.sql import functions as F

from skuflow.operators.prefix import numbered, running


def test_running_sums_and_lows_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.choice([-1, 1])) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v long")
    got = running(df, ["k"], ["i"], {"s": F.col("v")}, {"low": "s"}).collect()
    state, want = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        s, low = state.get(k, (0, None))
        want[(k, i)] = (s + v, low)
        state[k] = (s + v, s + v if low is None else min(low, s + v))
    assert {(r.k, r.i): (r.s, r.low) for r in got} == want


def test_numbering_without_keys_and_descending(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 7 % 500)
    got = numbered(df, [], [F.desc("v")], "n").collect()
    assert all(r.n == 500 - r.v for r in got)


def test_null_keys_keep_their_rows(spark):
    rows = [(None if i % 3 == 0 else "a", None if i % 5 == 0 else i % 2, i, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, g int, i int, v long")
    got = {r.i: r.n for r in numbered(df, ["k", "g"], ["i"], "n").collect()}
    seen, want = {}, {}
    for k, g, i, _ in rows:
        seen[(k, g)] = want[i] = seen.get((k, g), 0) + 1
    assert got == want


def test_shared_folder_can_be_dropped(spark):
    import os

    from skuflow.session import drop_shared, materialize, shared_dir

    materialize(spark.range(3), "x")
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir")) and os.path.isdir(shared_dir(spark))
    assert drop_shared(spark) and not os.path.exists(shared_dir(spark))
