"""The bucketed algorithms must equal a plain global window. Tiny bucket
sizes force many bucket edges, empty buckets and hot keys."""

import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainlake.operators import analytics as A


def rows_of(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def numbers(spark, n=300, seed=1):
    rnd = random.Random(seed)
    nums = sorted(rnd.sample(range(0, 2000), n))
    data = [("c1" if i % 3 else "c2", x, rnd.randint(0, 50)) for i, x in enumerate(nums)]
    return spark.createDataFrame(data, "chain string, number long, v long")


def test_prev_in_order_matches_lag(spark):
    df = numbers(spark)
    got = A.prev_in_order(df, ["chain"], "number", ["v"], bucket_size=37)
    w = Window.partitionBy("chain").orderBy("number")
    want = df.withColumn("prev_number", F.lag("number").over(w)).withColumn("prev_v", F.lag("v").over(w))
    cols = ["chain", "number", "prev_number", "prev_v"]
    assert rows_of(got, cols) == rows_of(want, cols)


def test_block_gaps_multi_bucket(spark):
    df = numbers(spark).select("chain", "number")
    got = rows_of(A.block_gaps(df.withColumnRenamed("x", "x")), ["chain", "gap_from", "gap_to", "missing"])
    want = []
    for c in ("c1", "c2"):
        ns = sorted(r["number"] for r in df.where(F.col("chain") == c).collect())
        want += [(c, a + 1, b - 1, b - a - 1) for a, b in zip(ns, ns[1:]) if b - a > 1]
    assert got == sorted(want)


def test_moving_sum_matches_range_frame(spark):
    df = numbers(spark)
    got = A.moving_sum(df, ["chain"], "number", "v", 10, "m", bucket_size=25)
    w = Window.partitionBy("chain").orderBy("number").rangeBetween(-9, 0)
    want = df.withColumn("m", F.sum("v").over(w))
    assert rows_of(got, ["chain", "number", "m"]) == rows_of(want, ["chain", "number", "m"])


def test_running_sum_hot_key(spark):
    rnd = random.Random(3)
    data = [("hot" if i % 3 == 0 else f"k{i % 17}", i, rnd.randint(-5, 9)) for i in range(900)]
    df = spark.createDataFrame(data, "acct string, block_number long, delta long")
    got = A.running_sum(df, ["acct"], "block_number", "delta", "bal", bucket_size=50)
    w = Window.partitionBy("acct").orderBy("block_number").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("bal", F.sum("delta").over(w))
    cols = ["acct", "block_number", "bal"]
    assert rows_of(got, cols) == rows_of(want, cols)


def test_asof_join_matches_brute_force(spark):
    df = numbers(spark)
    markers = spark.createDataFrame([("c1", 0, 1), ("c1", 400, 2), ("c1", 1500, 3), ("c2", 100, 7)],
                                    "chain string, from_block long, ver long")
    got = A.asof_join(df, markers, ["chain"], "number", "from_block", "ver", "asof", bucket_size=64)
    m = {}
    for c, f, v in markers.collect():
        m.setdefault(c, []).append((f, v))
    want = []
    for r in df.collect():
        cands = [v for f, v in m.get(r["chain"], []) if f <= r["number"]]
        want.append((r["chain"], r["number"], cands[-1] if cands else None))
    assert rows_of(got, ["chain", "number", "asof"]) == sorted(want, key=lambda t: (t[0], t[1], t[2] or -1))


def test_range_join_matches_theta_join(spark):
    pts = spark.createDataFrame([("a", i, i * 7 % 1000) for i in range(200)], "g string, id long, t long")
    rng = spark.createDataFrame([("a", 1, 0, 120), ("a", 2, 100, 350), ("a", 3, 990, 1200),
                                 ("a", 4, 500, 500)], "g string, rid long, t0 long, t1 long")
    got = A.range_join(pts, rng, ["g"], "t", "t0", "t1", bin_size=64)
    want = pts.join(rng, "g").where((F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1")))
    assert rows_of(got, ["id", "rid"]) == rows_of(want, ["id", "rid"])


def test_exact_percentile(spark):
    df = spark.createDataFrame([("x", v) for v in [1, 2, 2, 3, 10, 11]], "g string, v long")
    got = A.exact_percentile(df, ["g"], "v", 0.5, "med").collect()[0]["med"]
    assert got == 2.5


def test_top_k_per_group_hot_group(spark):
    rnd = random.Random(5)
    data = [("hot" if i % 2 else f"g{i % 7}", f"s{i}", rnd.randint(0, 30)) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, s string, v long")
    order = [F.col("v").desc(), F.col("s")]
    got = A.top_k_per_group(df, ["g"], order, 4, salt_buckets=16, salt_col="s")
    w = Window.partitionBy("g").orderBy(*order)
    want = df.withColumn("rnk", F.row_number().over(w)).where("rnk <= 4")
    assert rows_of(got, ["g", "s", "v", "rnk"]) == rows_of(want, ["g", "s", "v", "rnk"])


def test_sessionize_matches_sequential(spark):
    rnd = random.Random(9)
    data, t = [], 0
    for i in range(700):
        t += rnd.choice([1, 2, 3, 15, 40])
        data.append(("hot" if i % 3 else f"k{i % 5}", t))
    df = spark.createDataFrame(data, "k string, t long")
    got = A.sessionize(df, ["k"], "t", gap=10, bucket=37)
    sess = sorted((r["k"], r["t"], r["session_id"]) for r in got.collect())
    want, last, sid = [], {}, {}
    for k, tt in sorted(data):
        if k not in last or tt - last[k] > 10:
            sid[k] = sid.get(k, -1) + 1
        last[k] = tt
        want.append((k, tt, sid[k]))
    assert sess == sorted(want)


def test_count_in_ranges_matches_theta_join(spark):
    rnd = random.Random(3)
    pts = spark.createDataFrame([(rnd.choice("ab"), rnd.randrange(-50, 900)) for _ in range(600)], "g string, t long")
    rng = spark.createDataFrame([(rnd.choice("abc"), i, *sorted(rnd.sample(range(-100, 1000), 2))) for i in range(60)]
                                + [("a", 60, 5, 5), ("b", 61, 9, 2)], "g string, rid long, t0 long, t1 long")
    got = A.count_in_ranges(pts, rng, ["g"], "t", "t0", "t1", "n", bucket_size=32)
    want = (rng.join(pts, "g", "left").groupBy("rid")
            .agg(F.count_if((F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1"))).alias("n")))
    rows = {r.rid: r.n for r in got.collect()}
    assert {k: v for k, v in rows.items() if k != 61} == {r.rid: r.n for r in want.collect() if r.rid != 61}


def test_percentile_matches_builtin(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(rnd.choice("abc"), rnd.randrange(-40, 400)) for _ in range(999)], "g string, v long")
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.g: r.m for r in A.exact_percentile(df, ["g"], "v", p, "m", bucket_size=16).collect()}
        want = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("v", p).alias("m")).collect()}
        assert got == pytest.approx(want)


def test_ancestors(spark):
    rows = [("c", n, f"h{n}", f"h{n - 1}") for n in range(6)] + [("c", 9, "h9", "x"), ("d", 1, "h1", "h0")]
    df = spark.createDataFrame(rows, "chain string, number long, hash string, parent_hash string")
    got = {(r.chain, r.start): (r.depth, r.farthest) for r in A.ancestors(df, 3).collect()}
    assert got == {("c", 0): (0, 0), ("c", 1): (1, 0), ("c", 2): (2, 0), ("c", 3): (3, 0), ("c", 4): (3, 1),
                   ("c", 5): (3, 2), ("c", 9): (0, 9), ("d", 1): (0, 1)}


def test_sessionize_matches_session_window(spark):
    rnd = random.Random(11)
    df = spark.createDataFrame([(rnd.choice("ab"), i, rnd.randrange(0, 40_000)) for i in range(400)], "k string, id long, t long")
    got = A.sessionize(df, ["k"], "t", 1000, 700, tiebreak=("id",)).groupBy("k", "session_id").agg(
        F.min("t").alias("a"), F.count("*").alias("n"))
    want = (df.withColumn("ts", F.timestamp_millis("t")).groupBy("k", F.session_window("ts", "1 second").alias("w"))
            .agg(F.min("t").alias("a"), F.count("*").alias("n")))
    assert rows_of(got, ["k", "a", "n"]) == rows_of(want, ["k", "a", "n"])


def test_running_success_shuffles_each_side_once(spark):
    rnd = random.Random(6)
    names = [("System", "ExtrinsicSuccess"), ("System", "ExtrinsicFailed"), ("Balances", "Transfer"), (None, "ExtrinsicSuccess")]
    ev = [(c, b, rnd.choice([None, 0, 1, 2, 3, 9]), *rnd.choices(names, [1, 4, 4, 1])[0]) for c in "xy" for b in range(60) for _ in range(rnd.randrange(6))]
    ex = [(c, b, i, f"{b}-{i}") for c in "xy" for b in range(60) for i in range(4)] + [("x", 0, 1, "twice"), ("x", None, 1, "none")]
    events = spark.createDataFrame(ev, "chain string, block_number long, extrinsic_index long, mod_name string, event_name string")
    extrinsics = spark.createDataFrame(ex, "chain string, block_number long, extrinsic_index long, id string")
    known, good = {}, set()
    for c, b, i, m, e in ev:
        if i is not None and not (m is None and e == "ExtrinsicSuccess"):
            known[c, b, i] = known.get((c, b, i), False) or (m, e) == ("System", "ExtrinsicSuccess")
    good = {k for k, v in known.items() if v}
    want = [(c, d, known.get((c, b, i)), any((c, b, j) in good for j in range(i + 1))) for c, b, i, d in ex]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = A.running_success(extrinsics, events)
        assert got.columns == ["chain", "block_number", "extrinsic_index", "id", "success", "result_running"]
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
        key = lambda r: (r[0], r[1], str(r[2:]))
        assert sorted(map(tuple, got.select("chain", "id", "success", "result_running").collect()), key=key) == sorted(want, key=key)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
