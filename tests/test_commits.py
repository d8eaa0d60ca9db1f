"""Commits by content, recovery, change feeds, merge units."""

import os

import pytest
from pyspark.sql import functions as F

from chainlake.operators import commits, files
from chainlake.operators import sink as S

KEYS = ["chain", "number"]


def rows(spark, data, batch=0):
    df = spark.createDataFrame(data, "chain string, block_bucket long, number long, v string")
    return S.with_order(df, batch, "number")


def read(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("chain", "number", "v").collect())


def data_files(path):
    return sorted(f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_log_is_compact_and_complete(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "FOLD", 4)
    log = commits.CommitLog(spark, str(tmp_path / "log"))
    for i in range(11):
        log.record(f"s-{i}", f"d{i}", {"n": i})
    log.record("s-3", "other content", {"n": 33})
    log.record("odd name/=%", "d", {"n": -1})
    assert len(files.data_files(spark, f"{log.root}/recent")) < 4 and len(files.data_files(spark, f"{log.root}/folded")) == 1
    assert [log.find(f"s-{i}", f"d{i}") for i in range(11)] == [{"n": i} for i in range(11)]
    assert log.find("s-3", "other content") == {"n": 33} and log.find("odd name/=%", "d") == {"n": -1}
    assert log.find("s-3", "d4") is None and log.find("s-99", "d1") is None and log.find("t-1", "d1") is None
    assert log.table().count() == 13
    commits._HEADS.clear()                       # another process
    assert log.find("s-0", "d0") == {"n": 0} and log.maybe_known("s-2") and not log.maybe_known("s-50")


def test_digest_is_of_the_rows(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("t"))
    assert commits.content_digest(df) == commits.content_digest(df.orderBy(F.desc("id")).select("t", "id").repartition(7))
    assert commits.content_digest(df) != commits.content_digest(df.where("id <> 5"))
    assert commits.content_digest(df) != commits.content_digest(df.unionByName(df.where("id = 5")))
    assert commits.content_digest(df.where("false")) == "0-0-0"


def test_a_used_name_with_new_content_is_stored(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = [("p", 0, 1, "a")], [("p", 0, 2, "b")]
    assert S.upsert(rows(spark, one), path, KEYS, commit="polkadot-0") == {"inserted": 1, "updated": 0}
    assert S.upsert(rows(spark, two), path, KEYS, commit="polkadot-0") == {"inserted": 1, "updated": 0}
    assert read(spark, path) == [("p", 1, "a"), ("p", 2, "b")]
    before = data_files(path)
    assert S.upsert(rows(spark, one), path, KEYS, commit="polkadot-0") == {"inserted": 1, "updated": 0}   # a replay
    assert data_files(path) == before


@pytest.mark.parametrize("commit", [None, "s-1"])
@pytest.mark.parametrize("broken", ["_rename", "_delete"])
def test_the_next_upsert_finishes_a_broken_one(spark, tmp_path, monkeypatch, commit, broken):
    path = str(tmp_path / "t")
    S.upsert(rows(spark, [("c", n // 2, n, "old") for n in range(8)]), path, KEYS)
    real, calls = getattr(S, broken), []

    def failing(spark_, src, *rest):
        if src.endswith(".parquet"):
            calls.append(src)
            if len(calls) == 2:
                raise OSError("lost")
        real(spark_, src, *rest)
    monkeypatch.setattr(S, broken, failing)
    with pytest.raises(OSError):
        S.upsert(rows(spark, [("c", n // 2, n, "new") for n in range(0, 8, 2)], 1), path, KEYS, commit=commit)
    monkeypatch.setattr(S, broken, real)
    S.upsert(rows(spark, [("d", 0, 0, "x")], 2), path, KEYS)      # another batch
    assert read(spark, path) == [("c", n, "old" if n % 2 else "new") for n in range(8)] + [("d", 0, "x")]
    assert files.names(spark, path + "__staging") == []


def test_only_overlapping_files_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    S.upsert(rows(spark, [("c", 0, n, "a") for n in range(0, 50)]), path, KEYS)
    S.upsert(rows(spark, [("c", 0, n, "a") for n in range(50, 100)]), path, KEYS)          # beside: appended
    S.upsert(rows(spark, [("c", 0, n, "a") for n in range(20_000, 20_010)]), path, KEYS)   # another unit
    first = data_files(path)
    assert [f.split("_")[1:4] for f in first] == [["0", "0", "49"], ["0", "50", "99"], ["2", "20000", "20009"]]
    S.upsert(rows(spark, [("c", 0, 60, "b")]), path, KEYS)
    second = data_files(path)
    assert first[0] in second and first[2] in second and first[1] not in second and len(second) == 3
    S.write_partitioned(rows(spark, [("c", 0, 100, "w"), ("c", 0, 30_000, "w")]).drop("_pos"), path, mode="append")  # not named by an upsert
    assert S.upsert(rows(spark, [("c", 0, 100, "c"), ("c", 0, 101, "c")]), path, KEYS) == {"inserted": 1, "updated": 1}
    got = {n: v for _, n, v in read(spark, path)}
    assert (got[60], got[100], got[101], got[30_000]) == ("b", "c", "c", "w") and len(got) == 113


def test_no_join_where_ranges_lie_apart(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    S.upsert(rows(spark, [("c", 0, n, "a") for n in range(50)]), path, KEYS)
    monkeypatch.setattr(S, "_files_of", None)                     # stored rows are not read
    assert S.upsert(rows(spark, [("c", 0, n, "a") for n in range(50, 60)]), path, KEYS) == {"inserted": 10, "updated": 0}


def test_change_feed_and_counts(spark, tmp_path):
    path, sums = str(tmp_path / "t"), str(tmp_path / "sums")

    def batch(data, commit, digest):
        S.upsert(rows(spark, data), path, KEYS, commit=commit, digest=digest, feed=["v"])
        feed = S.changes(spark, path, commit, digest)
        deltas = S.signed_counts(feed.withColumns({s: F.when(F.col(s).isNotNull(), F.struct("chain", f"{s}.*")) for s in ("before", "after")}),
                                 ["chain", "v"])
        for _ in range(2):                                        # the second is a replay
            S.add_to(deltas, sums, ["chain", "v"], "n", commit, digest)
        S.drop_changes(spark, path, commit, digest)
    batch([("c", 0, 1, "a"), ("c", 0, 2, "a"), ("c", 0, 3, None)], "s-0", "x")
    batch([("c", 0, 2, "b"), ("c", 0, 3, None), ("c", 0, 4, "a")], "s-1", "y")
    batch([("c", 0, 1, "b"), ("c", 0, 4, "b")], "s-0", "z")
    got = {r.v: r.n for r in spark.read.parquet(sums).collect()}
    assert got == {"a": 0, "b": 3, None: 1}
