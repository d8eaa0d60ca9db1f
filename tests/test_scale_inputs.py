"""The inputs of ingest and streams are built without shuffling derived rows."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from chainlake import lake as L
from chainlake.functions import codec as C
from chainlake.operators import commits, files
from chainlake.plans import q_stream
from chainlake.sources import fixture


def _events(spark, n=2000):
    kinds = F.array(*[F.lit(k) for k in ("purchase", "signup", "error", "click", "view")])
    return spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"),
        (F.col("id") % 50).alias("user_id"), F.get(kinds, (F.col("id") % 5).cast("int")).alias("event_type"),
        (F.col("id") % 100 / 4).alias("value"), F.lit('{"k": 1}').alias("props"))


def _plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_blocks_of_dealt_events_shuffle_only_plain_events(spark):
    plan = _plan(fixture.nested_blocks(fixture.block_ranges(_events(spark), 4), L.FIXTURE_CHAINS))
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan
    assert "sha2" not in plan[plan.index("Exchange rangepartitioning"):]


def test_envelopes_need_no_stored_tables_and_raw_events_are_stored_when_read(spark, tmp_path):
    d = str(tmp_path / "sf")
    _events(spark).write.parquet(f"{d}/events.parquet")
    root = L.lake_root(spark, d)
    path = L.envelope_files(spark, d)
    assert files.names(spark, root) == ["envelopes"]
    assert spark.read.text(path).count() == 100 + 50 + 3 + 3     # blocks 5, 42, 79 and 7, 48, 89 add a bad line
    lake = L.lake_for(spark, d)
    assert "raw_event" not in files.names(spark, root)
    assert lake.table("raw_event").count() == 2000
    assert lake.table("blocks").count() == 150


def test_envelope_files_follow_block_order(spark, tmp_path):
    path = fixture.write_envelope_files(_events(spark), str(tmp_path / "env"), L.FIXTURE_CHAINS)
    names = files.data_files(spark, path)
    assert 1 < len(names) <= fixture.LEAST_FILES
    numbers = []
    for f in names:
        for r in spark.read.text(f"{path}/{f}").collect():
            if r.value.startswith('{"chain":"'):
                numbers.append(int(r.value.split('"block_number":')[1].split(",")[0]))
    assert numbers == sorted(numbers) and len(numbers) == 150


def test_landed_files_keep_their_order_without_a_checkpoint(spark, tmp_path):
    blocks = fixture.nested_blocks(_events(spark), L.FIXTURE_CHAINS)
    src = str(tmp_path / "src")
    assert q_stream._land(spark, blocks, src, -F.col("block_number"), least=3) == 1
    numbers = [int(r.value.split('"block_number":')[1].split(",")[0])
               for f in files.data_files(spark, src) for r in spark.read.text(f"{src}/{f}").collect()]
    assert numbers == sorted(numbers, reverse=True) and len(numbers) == 150


def test_ints_from_bytes_covers_every_byte(spark):
    rows = [(None,), (b"",), (bytes(range(256)),), (b"\x00",)]
    got = [r.x for r in spark.createDataFrame(rows, "b binary").select(C.ints_from_bytes("b").alias("x")).collect()]
    assert got == [None, [], list(range(256)), [0]]
    assert "conv(" not in _plan(spark.createDataFrame(rows, "b binary").select(C.ints_from_bytes("b").alias("x")))


def test_tables_of_dealt_blocks_are_written_where_they_lie(spark, tmp_path, monkeypatch):
    seen, write = [], L.write_partitioned

    def watched(df, path, **options):
        seen.append((df._jdf.queryExecution().executedPlan().toString(), options.get("dealt", False)))
        return write(df, path, **options)
    d, other = str(tmp_path / "sf"), str(tmp_path / "other")
    _events(spark).write.parquet(f"{d}/events.parquet")
    monkeypatch.setattr(L, "write_partitioned", watched)
    monkeypatch.setattr(L, "UNIT_BLOCKS", 25)
    lake = L.lake_for(spark, d)
    assert len(seen) == 4
    for plan, dealt in seen:
        assert dealt and plan.count("Exchange ") == 1 and "sha2" not in plan[plan.index("Exchange rangepartitioning"):]
    monkeypatch.undo()
    L.ingest_blocks(fixture.nested_blocks(spark.read.parquet(f"{d}/events.parquet"), L.FIXTURE_CHAINS), other)
    assert "_nested" not in files.names(spark, lake.root) + files.names(spark, other)
    for name in ("blocks", "block_logs", "extrinsics", "events"):
        assert commits.content_digest(lake.table(name)) == commits.content_digest(L.ChainLake(spark, other).table(name))


def test_hash_filters_are_as_large_as_a_file_needs(spark, tmp_path):
    d = str(tmp_path / "sf")
    _events(spark).write.parquet(f"{d}/events.parquet")
    lake = L.lake_for(spark, d)
    folders = [f"{lake.path('blocks')}/chain={c}/block_bucket=0" for c in L.FIXTURE_CHAINS]
    sizes = [n for f in folders for n in files.data_sizes(spark, f).values()]
    assert len(sizes) >= 2 and max(sizes) < 300_000     # two filters of 1 MB each before
    some = lake.table("blocks").where("number = 42 and chain = 'kusama'").first()
    assert lake.table("blocks").where(F.col("hash") == some["hash"]).count() == 1
    assert lake.table("blocks").where(F.col("hash") == "0x00").count() == 0
