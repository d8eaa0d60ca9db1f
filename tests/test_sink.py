"""Upsert properties: twice = once, NULL wins, partial update keeps the
first value, insert-only reports conflicts, order of non-conflicting input
does not matter."""

import pytest
from pyspark.sql import functions as F

from chainlake.operators import extract as X
from chainlake.operators import sink as S


def table(spark, rows):
    return spark.createDataFrame(rows, "chain string, block_bucket long, number long, "
                                       "v string, keep string")


def read(spark, path):
    return sorted((r["number"], r["v"], r["keep"]) for r in
                  spark.read.parquet(path).select("number", "v", "keep").collect())


def test_upsert_twice_is_once_and_null_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    base = S.with_order(table(spark, [("c", 0, 1, "a", "k1"), ("c", 0, 2, "b", "k2")]), 0, "number")
    redo = S.with_order(table(spark, [("c", 0, 2, None, "k9"), ("c", 1, 100001, "z", "k3")]), 1, "number")
    S.upsert(base, path, ["chain", "number"])
    S.upsert(redo, path, ["chain", "number"])
    once = read(spark, path)
    S.upsert(redo, path, ["chain", "number"])
    assert read(spark, path) == once == [(1, "a", "k1"), (2, None, "k9"), (100001, "z", "k3")]


def test_partial_update_keeps_first(spark, tmp_path):
    path = str(tmp_path / "t")
    keys = ["chain", "number"]
    S.upsert(S.with_order(table(spark, [("c", 0, 1, "a", "first")]), 0, "number"), path, keys, ["keep"])
    redo = S.with_order(table(spark, [("c", 0, 1, "b", "second")]), 1, "number")
    S.upsert(redo, path, keys, ["keep"])
    S.upsert(redo, path, keys, ["keep"])          # replay must not reset kept columns
    assert read(spark, path) == [(1, "b", "first")]


def test_only_touched_partitions_rewritten(spark, tmp_path):
    import os
    path = str(tmp_path / "t")
    keys = ["chain", "number"]
    S.upsert(S.with_order(table(spark, [("c", 0, 1, "a", "x"), ("c", 5, 500001, "b", "y")]), 0, "number"),
             path, keys)
    part5 = os.path.join(path, "chain=c", "block_bucket=5")
    before = sorted(os.listdir(part5))
    S.upsert(S.with_order(table(spark, [("c", 0, 1, "a2", "x")]), 1, "number"), path, keys)
    assert sorted(os.listdir(part5)) == before
    assert read(spark, path) == [(1, "a2", "x"), (500001, "b", "y")]


def test_latest_forms_agree(spark):
    rows = [("c", 0, n % 7, f"v{n}", "k") for n in range(40)]
    df = S.with_order(table(spark, rows), 0, None).withColumn("_pos", F.monotonically_increasing_id())
    a = S.latest(df, ["chain", "number"]).select("number", "v").collect()
    b = S.latest_window(df, ["chain", "number"]).select("number", "v").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_insert_only_conflicts(spark):
    existing = table(spark, [("c", 0, 1, "a", "x")])
    batch = table(spark, [("c", 0, 1, "a", "x"), ("c", 0, 2, "b", "y")])
    ins, conf = S.insert_only(batch, existing, ["chain", "number"])
    assert [r["number"] for r in ins.collect()] == [2]
    assert [r["number"] for r in conf.collect()] == [1]


def test_shuffled_input_same_table(spark, tmp_path):
    rows = [("c", n // 100000, n, f"v{n}", "k") for n in range(0, 300000, 7919)]
    p1, p2 = str(tmp_path / "a"), str(tmp_path / "b")
    S.upsert(S.with_order(table(spark, rows), 0, "number"), p1, ["chain", "number"])
    S.upsert(S.with_order(table(spark, list(reversed(rows))).repartition(3), 0, "number"), p2,
             ["chain", "number"])
    assert read(spark, p1) == read(spark, p2)


def test_legacy_block_upsert_projected_columns(spark, tmp_path):
    """IO-14: the legacy 5-column block table upserts like IO-07."""
    path = str(tmp_path / "legacy_block")
    cols = "chain string, block_bucket long, number long, hash string, parent_hash string, " \
           "timestamp long, spec_version int"
    base = spark.createDataFrame([("c", 0, 1, "h1", "p0", 10, 1), ("c", 0, 2, "h2", "h1", 20, 1)], cols)
    redo = spark.createDataFrame([("c", 0, 2, "h2", "h1", 21, 2)], cols)
    S.upsert(S.with_order(base, 0, "number"), path, ["chain", "number"])
    S.upsert(S.with_order(redo, 1, "number"), path, ["chain", "number"])
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("number", "timestamp", "spec_version").collect())
    assert got == [(1, 10, 1), (2, 21, 2)]


def test_fan_out_policies(spark, tmp_path):
    df = spark.range(5)
    seen = []

    def ok(name):
        return lambda d: seen.append((name, d.count()))

    def bad(_d):
        raise RuntimeError("down")
    cont = {r["sink"]: r["status"] for r in S.fan_out(df, {"a": ok("a"), "b": bad, "c": ok("c")},
                                                      on_error="continue").collect()}
    assert cont == {"a": "ok", "b": "error: RuntimeError", "c": "ok"}
    stop = {r["sink"]: r["status"] for r in S.fan_out(df, {"a": ok("a"), "b": bad, "c": ok("c")},
                                                      on_error="stop").collect()}
    assert stop == {"a": "ok", "b": "error: RuntimeError", "c": "skipped"}


def test_new_keys_are_appended_not_rewritten(spark, tmp_path):
    import os
    path = str(tmp_path / "t")
    keys = ["chain", "number"]
    S.upsert(S.with_order(table(spark, [("c", 0, 1, "a", "x"), ("c", 0, 2, "b", "y")]), 0, "number"),
             path, keys)
    part = os.path.join(path, "chain=c", "block_bucket=0")
    before = {f for f in os.listdir(part) if f.endswith(".parquet")}
    S.upsert(S.with_order(table(spark, [("c", 0, 3, "n", "z")]), 1, "number"), path, keys)
    after = {f for f in os.listdir(part) if f.endswith(".parquet")}
    assert before < after                               # old files kept, a file added
    S.upsert(S.with_order(table(spark, [("c", 0, 3, "n2", "z")]), 2, "number"), path, keys)
    assert read(spark, path) == [(1, "a", "x"), (2, "b", "y"), (3, "n2", "z")]


def test_upsert_reports_inserted_and_updated(spark, tmp_path):
    path = str(tmp_path / "t")
    keys = ["chain", "number"]
    first = S.upsert(S.with_order(table(spark, [("c", 0, n, "a", "k") for n in range(5)]), 0, "number"),
                     path, keys)
    assert first == {"inserted": 5, "updated": 0}
    second = S.upsert(S.with_order(table(spark, [("c", 0, n, "b", "k") for n in range(3, 8)]), 1,
                                   "number"), path, keys)
    assert second == {"inserted": 3, "updated": 2}


def test_incoming_beats_stored_whatever_its_batch_id(spark, tmp_path):
    path = str(tmp_path / "t")
    keys = ["chain", "number"]
    S.upsert(S.with_order(table(spark, [("c", 0, 1, "old", "k")]), 5), path, keys, commit="a-5")
    S.upsert(S.with_order(table(spark, [("c", 0, 1, "new", "k")]), 0), path, keys, commit="b-0")
    assert read(spark, path) == [(1, "new", "k")]
    S.upsert(S.with_order(table(spark, [("c", 0, 1, "old", "k")]), 5), path, keys, commit="a-5")   # a true replay
    assert read(spark, path) == [(1, "new", "k")]


def test_kept_columns_inside_one_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("c", 0, 1, "a", "first", 1), ("c", 0, 1, "b", "second", 2)],
                                 "chain string, block_bucket long, number long, v string, keep string, pos long")
    for df in (rows, rows.orderBy(F.desc("pos"))):
        S.upsert(S.with_order(df, 0, "pos").drop("pos"), path + str(df is rows), ["chain", "number"], ["keep"])
        assert read(spark, path + str(df is rows)) == [(1, "b", "first")]


def test_counts_over_many_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [("c", n, n * 100000, "a", "k") for n in range(60)]
    assert S.upsert(S.with_order(table(spark, first), 0), path, ["chain", "number"]) == {"inserted": 60, "updated": 0}
    again = [("c", n, n * 100000, "b", "k") for n in range(30, 90)]
    assert S.upsert(S.with_order(table(spark, again), 1), path, ["chain", "number"]) == {"inserted": 30, "updated": 30}
    assert len(read(spark, path)) == 90


def test_recovers_between_staging_and_swap(spark, tmp_path, monkeypatch):
    """A failure after some partitions were moved: nothing stored is lost, and
    the next attempt of the same batch finishes the move."""
    path = str(tmp_path / "t")
    keys = ["chain", "number"]
    base = [("c", n // 2, n, "a", "k") for n in range(8)] + [("odd name/=%", 0, 1, "a", "k")]
    S.upsert(S.with_order(table(spark, base), 0), path, keys, commit="s-0")
    redo = S.with_order(table(spark, [("c", n // 2, n, "b", "k") for n in range(0, 8, 2)] + [("c", 9, 18, "n", "k")]), 1)
    moves, real = [], S._rename

    def failing(spark_, src, dst):
        if "/data/" in src:
            moves.append(dst)
            if len(moves) == 3:
                raise OSError("lost")
        real(spark_, src, dst)
    monkeypatch.setattr(S, "_rename", failing)
    try:
        S.upsert(redo, path, keys, commit="s-1")
        raise AssertionError("the failure was swallowed")
    except OSError:
        pass
    monkeypatch.setattr(S, "_rename", real)
    monkeypatch.setattr(S, "_stage", None)              # must finish from what is staged
    assert S.upsert(redo, path, keys, commit="s-1") == {"inserted": 1, "updated": 4}
    want = sorted([(n, "b" if n % 2 == 0 else "a", "k") for n in range(8)] + [(1, "a", "k"), (18, "n", "k")])
    assert read(spark, path) == want
    assert S._names(spark, path + "__staging") == []


def test_swapped_files_keep_the_layout(spark, tmp_path):
    import pyarrow.parquet as pq
    path = str(tmp_path / "t")
    keys = ["chain", "number"]
    for i in range(2):
        S.upsert(S.with_order(table(spark, [("c", 0, n, str(i), "k") for n in range(50, 0, -1)]), i), path, keys)
    files = list((tmp_path / "t" / "chain=c" / "block_bucket=0").glob("*.parquet"))
    assert len(files) == 1
    meta = pq.ParquetFile(files[0]).metadata
    assert meta.row_group(0).column(0).compression == "ZSTD"
    assert pq.read_table(files[0])["number"].to_pylist() == list(range(1, 51))


# --- a merge leaves stored rows where they are ---------------------------------------
def _numbered(spark, lo, hi, tag, batch, step=1):
    rows = spark.range(lo, hi, step, 3).select(
        F.lit("polkadot").alias("chain"), F.col("id").alias("block_number"), F.lit(0).alias("index"),
        F.lit(tag).alias("value"), F.concat(F.lit(tag), F.col("id")).alias("first"))
    return S.with_order(rows.withColumn("block_bucket", X.block_bucket("block_number")), batch, "index")


def _stored(spark, path):
    return {r.block_number: (r.value, r.first) for r in spark.read.parquet(path).collect()}


@pytest.mark.parametrize("keys_at_once,files_of_a_unit", [(1_000_000, 8), (150, 8), (5, 8), (1_000_000, 0)])
def test_merge_in_place_equals_shuffled_merge(spark, tmp_path, monkeypatch, keys_at_once, files_of_a_unit):
    monkeypatch.setattr(S, "UNIT_BLOCKS", 100)
    monkeypatch.setattr(S, "MERGE_KEYS", keys_at_once)
    monkeypatch.setattr(S, "MERGE_FILES", files_of_a_unit)
    monkeypatch.setattr(S, "MERGE_BYTES", 0)
    path, keys = str(tmp_path / "t"), ["chain", "block_number", "index"]
    S.upsert(_numbered(spark, 0, 1000, "a", 0), path, keys, ["first"], dealt=True)
    for _ in range(2):
        counts = S.upsert(_numbered(spark, 300, 1100, "b", 1, 10), path, keys, ["first"], dealt=True)
    assert counts == {"inserted": 0, "updated": 80}
    want = {n: ("a", f"a{n}") for n in range(1000)} | {n: ("b", f"a{n}" if n < 1000 else f"b{n}") for n in range(300, 1100, 10)}
    assert _stored(spark, path) == want
    assert spark.read.parquet(path).count() == len(want)


def test_merge_and_dealt_rows_shuffle_no_stored_rows(spark, tmp_path, monkeypatch):
    plans = []
    write = S.write_partitioned

    def seen(df, *args, **options):
        plans.append((df._jdf.queryExecution().executedPlan().toString(), options.get("dealt")))
        write(df, *args, **options)
    monkeypatch.setattr(S, "write_partitioned", seen)
    monkeypatch.setattr(S, "MERGE_BYTES", 0)
    path, keys = str(tmp_path / "t"), ["chain", "block_number", "index"]
    S.upsert(_numbered(spark, 0, 1000, "a", 0), path, keys, ["first"])
    S.upsert(_numbered(spark, 0, 1000, "b", 1, 10), path, keys, ["first"])
    rest = [p for p, dealt in plans if dealt]
    assert len(plans) == 2 and len(rest) == 1
    assert "BroadcastHashJoin" in rest[0] and "Exchange hashpartitioning" not in rest[0]
    dealt = S.deduplicated(_numbered(spark, 0, 1000, "a", 0).repartitionByRange(4, "block_number"), keys, ["first"])
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
