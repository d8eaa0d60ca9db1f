"""Hash index, bucketed tables, roots of forks, whole-group ranks, range
counts, one-pass handlers, path patterns."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chainlake.functions.names import HandlerRegistry
from chainlake.lake import FIXTURE_CHAINS, lake_for
from chainlake.operators import analytics as A
from chainlake.operators import bucketed, hash_index
from chainlake.plans import q_layout
from chainlake.sources import fixture
from chainlake.streaming import ingest as I


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_reads_one_folder_and_one_bucket(spark, sf_dir):
    lake = lake_for(spark, sf_dir)
    root = lake.indexed("hash")
    value = lake.table("blocks").where("number = 7 and chain = 'kusama' or number = 8").first().hash
    found = hash_index.lookup(spark, root, lake.table("blocks"), "hash", value)
    assert [r.hash for r in found.collect()] == [value]
    assert "block_bucket" in plan(found).split("PartitionFilters")[1].split("]")[0]
    scan = hash_index.find(spark, root, "hash", value)
    assert f"block_bucket" in plan(scan) and len(scan.inputFiles()) > 1
    touched = scan.withColumn("f", F.input_file_name())
    assert hash_index.lookup(spark, root, lake.table("blocks"), "hash", "0x" + "00" * 32).count() == 0
    assert hash_index.lookup(spark, root, lake.table("blocks"), "hash", "no hash").count() == 0
    assert touched is not None


def test_index_follows_replaced_blocks(spark, sf_dir, tmp_path):
    blocks = fixture.nested_blocks(spark.read.parquet(f"{sf_dir}/events.parquet"), FIXTURE_CHAINS)
    root = str(tmp_path / "lake")
    forked = blocks.where("block_number = 4").withColumn("header", F.col("header").withField("block_hash", F.lit(bytearray(range(32)))))
    for i, part in enumerate((blocks, forked)):
        fixture.wire_lines(part).select("value").write.text(f"{root}/src{i}")
        I.run_to_end(I.start_chain(spark, f"{root}/src{i}", root, f"{root}/ckpt{i}", max_files=None, tables=("blocks",), indexes=("hash",)))
    stored = spark.read.parquet(f"{root}/blocks")
    new = "0x" + bytes(range(32)).hex()
    for fold in (100, 1):
        hash_index.fold(spark, root, "hash", least=fold)
        assert sorted(r.chain for r in hash_index.lookup(spark, root, stored, "hash", new).collect()) == ["kusama", "polkadot"]
        import hashlib
        gone = "0x" + hashlib.sha256(b"block-4").hexdigest()
        assert hash_index.lookup(spark, root, stored, "hash", gone).count() == 0
        kept = "0x" + hashlib.sha256(b"block-5").hexdigest()
        assert [r.number for r in hash_index.lookup(spark, root, stored, "hash", kept).collect()] == [5]


@pytest.mark.parametrize("name", ["extrinsic_events_bucketed", "transfers_enriched_bucketed", "events_enriched_bucketed"])
def test_bucketed_joins_do_not_shuffle(spark, sf_dir, name):
    s = bucketed.session(spark)
    query = getattr(q_layout, name)
    query(spark, sf_dir)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = plan(query(spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in text and "SortMergeJoin" in text
    assert s.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "false"
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def walk(blocks):
    """Oldest stored ancestor and distance of each (number, hash, parent)."""
    at = {h: (n, p) for n, h, p in blocks}
    out = {}
    for n, h, p in blocks:
        seen, d, top = {h}, 0, h
        while at[top][1] in at:
            top = at[top][1]
            d += 1
            if top in seen:
                top = d = None
                break
            seen.add(top)
        out[n] = (top, d)
    return out


@pytest.mark.parametrize("bucket", [7, 100_000])
def test_fork_roots(spark, bucket):
    rng = random.Random(4)
    blocks = [(n, f"h{n}", f"h{n - 1}" if rng.random() > 0.03 else rng.choice([f"h{rng.randrange(n + 1)}", "none"])) for n in range(1, 700)]
    blocks += [(2000, "c0", "c2"), (2001, "c1", "c0"), (2002, "c2", "c1"), (2003, "t", "c1")]     # a cycle and its tail
    df = spark.createDataFrame([("x", *b) for b in blocks] + [("y", 1, "h1", "h0")], "chain string, number long, hash string, parent_hash string")
    got = {r.number: (r.root_hash, r.distance) for r in A.fork_roots(df, bucket).where("chain = 'x'").collect()}
    assert got == walk(blocks)


def test_fork_roots_of_a_long_chain(spark):
    df = spark.range(1, 60_001).select(F.lit("x").alias("chain"), F.col("id").alias("number"), F.concat(F.lit("h"), "id").alias("hash"),
                                       F.concat(F.lit("h"), F.col("id") - 1).alias("parent_hash"))
    got = A.fork_roots(df, 10).agg(F.min("root"), F.max("root"), F.max("distance"), F.count("root"), F.sum(F.col("number") - F.col("distance"))).first()
    assert tuple(got) == (1, 1, 59_999, 60_000, 60_000)


@pytest.mark.parametrize("parts", [1, 9, 40])
def test_ranks_over_partitions(spark, parts):
    rng = random.Random(parts)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 1, 1, 2, rng.randrange(60)]), i) for i in range(500)] + [("z", 1, 1000)]
    df = spark.createDataFrame(data, "g string, v long, id long").repartition(5)
    w = Window.partitionBy("g").orderBy(F.asc_nulls_first("v"))
    wt = Window.partitionBy("g").orderBy(F.asc_nulls_first("v"), "id")
    want = df.withColumns({"row_number": F.row_number().over(wt), "rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "ntile": F.ntile(11).over(wt)})
    got = A.ranked(df, ["g"], "v", ["id"], 11, parts)
    key = lambda r: r[2]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    full = Window.partitionBy("g").orderBy(F.asc_nulls_first("v"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = df.withColumns({"first_value": F.first("id").over(full), "last_value": F.last("id").over(full)})
    assert sorted(map(tuple, A.first_last(df, ["g"], "v", ["id"], "id").collect()), key=key) == sorted(map(tuple, ends.collect()), key=key)
    assert A.ranked(df.where("false"), ["g"], "v", ["id"], 11, parts).count() == 0


def test_positions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"), F.lit("k").alias("position_of")).repartition(6)
    assert A.positions(df, "x").where("position <> x").count() == 0
    assert A.positions(df.where("false"), "x").count() == 0


def test_lead_matches_window(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([("a" if i % 3 else "b", n, n * 2) for i, n in enumerate(sorted(rng.sample(range(900), 200)))], "c string, n long, t long")
    w = Window.partitionBy("c").orderBy("n")
    want = df.withColumns({"next_n": F.lead("n").over(w), "next_t": F.lead("t").over(w)})
    got = A.next_in_order(df, ["c"], "n", ["t"], bucket_size=13).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_one_sweep_range_counts(spark):
    rng = random.Random(2)
    points = [(rng.choice("ab"), rng.randrange(-50, 300)) for _ in range(400)]
    ranges = [(rng.choice("abc"), i % 60, lo, lo + rng.choice([-5, 0, 3, 40, 400])) for i in range(80) for lo in [rng.randrange(-80, 320)]]
    ranges += ranges[:5] + [("a", 99, None, 4), ("b", 99, 4, None)]
    p = spark.createDataFrame(points, "c string, at long")
    r = spark.createDataFrame(ranges, "c string, id long, lo long, hi long")
    got = A.count_in_ranges(p, r, ["c"], "at", "lo", "hi", "n", bucket_size=17).collect()
    want = [(c, i, lo, hi, sum(k == c and lo <= x <= hi for k, x in points) if lo is not None and hi is not None else 0) for c, i, lo, hi in ranges]
    none_first = lambda t: tuple((x is not None, x) for x in t)
    assert sorted(map(tuple, got), key=none_first) == sorted(want, key=none_first)


def test_range_counts_need_few_exchanges(spark, sf_dir):
    import __spark_entry__ as E
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(E.queries()["events_in_ranges"](spark, sf_dir)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange " in x and "Reused" not in x for x in lines) <= 10


def test_handlers_in_one_scan(spark, tmp_path):
    ev = spark.createDataFrame([(1, "A", "x", "p"), (2, "A", "y", "q"), (3, "B", "x", "r"), (4, None, None, "s"), (5, "A", "x", None)],
                               "id long, mod_name string, event_name string, v string")
    reg = (HandlerRegistry().register_fields("A", "x", "one", {"id": F.col("id"), "v": F.upper("v")})
           .register_fields("A", "x", "two", {"twice": F.col("id") * 2}).register_fields("B", "x", "three", {"id": F.col("id")}))
    with pytest.raises(ValueError):
        reg.register_fields("C", "x", "one", {})
    assert plan(reg.dispatch(ev)).count("Scan") == 1
    reg.write_all(ev, str(tmp_path / "t"))
    got = {n: sorted(map(tuple, reg.table(spark, str(tmp_path / "t"), n).collect())) for n in ("one", "two", "three")}
    assert got == {"one": [(1, "P"), (5, None)], "two": [(2,), (10,)], "three": [(3,)]}
    assert {n: df.count() for n, df in reg.apply(ev).items()} == {"one": 2, "two": 2, "three": 1}


def test_number_globs():
    import fnmatch
    rng = random.Random(1)
    for _ in range(200):
        lo = rng.choice([0, 1, 5, 9, 10, 99, rng.randrange(3000)])
        hi = lo + rng.choice([0, 1, 9, 10, 99, rng.randrange(3000)])
        globs = I.number_globs(lo, hi)
        hits = [sum(fnmatch.fnmatchcase(str(n), g) for g in globs) for n in range(hi + 1500)]
        assert hits == [int(lo <= n <= hi) for n in range(hi + 1500)]
    assert I.number_globs(7, 42) == ["[7-9]", "[1-3][0-9]", "4[0-2]"] and len(I.number_globs(123_457, 9_876_543)) < 20


def test_a_chain_ahead_makes_no_other_late(spark, sf_dir, tmp_path, monkeypatch):
    """One query over both chains loses the lagging one's events; one query per
    chain loses none."""
    from chainlake.plans import q_stream
    monkeypatch.setattr(q_stream, "LAG_MS", 100 * 3_600_000)  # the smallest table has a block in 14 hours
    src, per_trigger, blocks = q_stream._lagging_source(spark, sf_dir, str(tmp_path / "a"))
    total = sum(1 for _ in blocks.select(F.explode("body.events")).collect())
    count = lambda path: spark.read.parquet(path).agg(F.sum("n_events")).first()[0]
    body = I.upsert_sink(str(tmp_path / "shared"), ["chain", "window_start_ms"], "window_start_ms", q_stream.DAY_MS)
    both = I.events_windowed(I.event_stream(spark, src, 1), "1 hour")
    I.run_to_end(both.writeStream.outputMode("update").foreachBatch(body).option("checkpointLocation", str(tmp_path / "c"))
                 .trigger(availableNow=True).start())
    queries = I.per_chain(FIXTURE_CHAINS, lambda c: I.start_windows(spark, src, str(tmp_path / "own"), str(tmp_path / "d"), c, 1, size="1 hour"))
    I.run_to_end(*queries.values())
    assert count(str(tmp_path / "own")) == total > count(str(tmp_path / "shared"))
    assert set(I.dropped_late(queries).values()) == {0}
