"""Registered queries: idempotent storage.

Each query ingests the fixture chain into a fresh table folder under the
shared checkpoint dir, applies the re-delivery batch (blocks with
``B % 10 = 0`` again: spec_version + 1, validator NULL), replays it once
more, and returns the stored table read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import extract as X
from ..lake import FIXTURE_CHAINS, lake_for
from ..operators import sink as S
from ..session import checkpoint_dir
from ..sources import envelope as V
from ..sources import fixture
from .registry import query


def work_dir(spark, tag: str) -> str:
    return f"{checkpoint_dir(spark)}/chainlake/work/{tag}-{uuid.uuid4().hex[:10]}"


def _blocks(spark, sf):
    """Fixture blocks of all chains and the re-delivery batch derived from them."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    blocks = fixture.nested_blocks(events, FIXTURE_CHAINS)
    return blocks, fixture.redelivery(blocks)


def _upsert_twice(base, redo, path, keys, keep_old=None, dealt=False):
    S.upsert(base, path, keys, keep_old, commit="base-0", dealt=dealt)
    S.upsert(redo, path, keys, keep_old, commit="redo-1", dealt=dealt)
    S.upsert(redo, path, keys, keep_old, commit="redo-1", dealt=dealt)      # replay of the same batch: no change
    S.upsert(redo, path, keys, keep_old, dealt=dealt)                       # the same rows as a new batch: no change


_BLOCKS_AFTER_SQL = """
SELECT chain, number, hash,
       CASE WHEN number % 10 = 0 THEN spec_version + 1 ELSE spec_version END AS spec_version,
       CASE WHEN number % 10 = 0 THEN NULL ELSE validator END AS validator,
       number % 10 = 0 OR validator IS NULL AS validator_bytes_null
FROM o_blocks"""


@query("upsert_blocks", _BLOCKS_AFTER_SQL)
def upsert_blocks(spark, sf):
    blocks, redo = _blocks(spark, sf)
    path = work_dir(spark, "upsert-blocks") + "/blocks"
    _upsert_twice(S.with_order(X.extract_headers(blocks), 0, "number"),
                  S.with_order(X.extract_headers(redo), 1, "number"), path, S.TABLE_KEYS["blocks"])
    return spark.read.parquet(path).select("chain", "number", "hash", "spec_version", "validator",
                                           F.col("validator_bytes").isNull().alias("validator_bytes_null"))


@query("latest_wins", _BLOCKS_AFTER_SQL)
def latest_wins(spark, sf):
    """N-03 on DataFrames: batch 0 then batch 1, latest per key, NULL wins."""
    blocks, redo = _blocks(spark, sf)
    both = S.with_order(X.extract_headers(blocks), 0, "number").unionByName(
        S.with_order(X.extract_headers(redo), 1, "number"))
    return S.latest(both, ["chain", "number"]).select(
        "chain", "number", "hash", "spec_version", "validator",
        F.col("validator_bytes").isNull().alias("validator_bytes_null"))


@query("latest_wins_window", _BLOCKS_AFTER_SQL)
def latest_wins_window(spark, sf):
    """The ``row_number() = 1`` form of N-03 (same result as ``latest``)."""
    blocks, redo = _blocks(spark, sf)
    both = S.with_order(X.extract_headers(blocks), 0, "number").unionByName(
        S.with_order(X.extract_headers(redo), 1, "number"))
    return S.latest_window(both, ["chain", "number"]).select(
        "chain", "number", "hash", "spec_version", "validator",
        F.col("validator_bytes").isNull().alias("validator_bytes_null"))


@query("upsert_block_logs", """
SELECT chain, id, block_number, type, data, engine FROM o_logs""")
def upsert_block_logs(spark, sf):
    blocks, redo = _blocks(spark, sf)
    path = work_dir(spark, "upsert-logs") + "/block_logs"
    _upsert_twice(S.with_order(X.extract_logs(blocks), 0), S.with_order(X.extract_logs(redo), 1),
                  path, S.TABLE_KEYS["block_logs"])
    return spark.read.parquet(path).select("chain", "id", "block_number", "type", "data", "engine")


@query("upsert_extrinsics", """
SELECT chain, id, block_number, extrinsic_hash, is_signed, mod_name, call_name, result, call_params
FROM o_extrinsics""")
def upsert_extrinsics(spark, sf):
    blocks, redo = _blocks(spark, sf)
    path = work_dir(spark, "upsert-extrinsics") + "/extrinsics"
    _upsert_twice(S.with_order(X.extract_extrinsics(blocks), 0),
                  S.with_order(X.extract_extrinsics(redo), 1), path, S.TABLE_KEYS["extrinsics"])
    return spark.read.parquet(path).select("chain", "id", "block_number", "extrinsic_hash", "is_signed",
                                           "mod_name", "call_name", "result", "call_params")


@query("upsert_events", """
SELECT chain, id, block_number, extrinsic_id, mod_name, event_name, phase, "values" FROM o_events""")
def upsert_events(spark, sf):
    blocks, redo = _blocks(spark, sf)
    path = work_dir(spark, "upsert-events") + "/events"
    _upsert_twice(S.with_order(X.extract_events(blocks), 0),
                  S.with_order(X.extract_events(redo), 1), path, S.TABLE_KEYS["events"])
    return spark.read.parquet(path).select("chain", "id", "block_number", "extrinsic_id", "mod_name",
                                           "event_name", "phase", "values")


@query("upsert_counts", """
SELECT 'inserted' AS action, count(*) FILTER (WHERE number % 2 = 1) AS n FROM o_blocks
UNION ALL SELECT 'updated', count(*) FILTER (WHERE number % 2 = 0) FROM o_blocks""")
def upsert_counts(spark, sf):
    """IO-18: store the even blocks, then upsert all blocks; report how many
    keys were inserted vs updated (computed before the write)."""
    blocks, _ = _blocks(spark, sf)
    headers = X.extract_headers(blocks)
    path = work_dir(spark, "upsert-counts") + "/blocks"
    keys = S.TABLE_KEYS["blocks"]
    S.upsert(S.with_order(headers.where(F.col("number") % 2 == 0), 0, "number"), path, keys)
    batch = S.with_order(headers, 1, "number")
    counts = S.upsert_counts(batch, spark.read.parquet(path), keys).checkpoint()
    S.upsert(batch, path, keys)
    return counts


# --- legacy partial upserts / insert-only (IO-11 … IO-13) -----------------------------
def _raw(spark, sf):
    raw = X.extract_raw_events(fixture.raw_event_rows(fixture.block_ranges(spark.read.parquet(f"{sf}/events.parquet"))))
    return (raw.withColumn("chain", F.lit("polkadot"))
            .withColumn("block_bucket", X.block_bucket("block_number")))


@query("upsert_raw_event_partial", """
SELECT block_number, "index", block_time, pallet_index,
       CASE WHEN block_number % 10 = 0 THEN upper(event_name) ELSE event_name END AS event_name,
       topic0
FROM o_raw""")
def upsert_raw_event_partial(spark, sf):
    """``block_time`` and ``pallet_index`` keep their first value; the other
    columns take the re-delivered one."""
    raw = _raw(spark, sf)
    redo = (raw.where(F.col("block_number") % 10 == 0)
            .withColumn("block_time", F.lit(1).cast("bigint"))
            .withColumn("pallet_index", (F.col("pallet_index") + 100).cast("smallint"))
            .withColumn("event_name", F.upper("event_name")))
    path = work_dir(spark, "upsert-raw") + "/raw_event"
    _upsert_twice(S.with_order(raw, 0, "index"), S.with_order(redo, 1, "index"), path,
                  S.TABLE_KEYS["raw_event"], keep_old=["block_time", "pallet_index"], dealt=True)
    return spark.read.parquet(path).select("block_number", "index", "block_time", "pallet_index",
                                           "event_name", "topic0")


@query("insert_transfer_conflicts", """
SELECT chain, block_number, "index", block_number % 10 = 0 AS conflict FROM o_transfers""")
def insert_transfer_conflicts(spark, sf):
    """Insert without conflict clause (IO-12): all blocks but those of
    ``B % 10 = 0`` are stored, then these come twice: first their new keys are
    written, then all of them are conflicts (the reference fails the
    statement). Returns the stored table, refused keys marked."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    tr = (X.extract_transfers(X.extract_events(fixture.nested_blocks(events, FIXTURE_CHAINS)))
          .withColumn("block_bucket", X.block_bucket("block_number")))
    path = work_dir(spark, "insert-transfer") + "/transfer"
    keys = S.TABLE_KEYS["transfer"]
    first, _ = S.insert_only(tr.where("block_number % 10 <> 0"), None, keys)
    S.write_partitioned(first, path)
    again = tr.where("block_number % 10 = 0")
    inserted, _ = S.insert_only(again, spark.read.schema(tr.schema).parquet(path), keys)
    S.write_partitioned(inserted, path, mode="append")
    stored = spark.read.schema(tr.schema).parquet(path)
    _, conflicts = S.insert_only(again, stored, keys)
    return stored.join(conflicts.select(*keys, F.lit(True).alias("conflict")), keys, "left").select(
        "chain", "block_number", "index", F.coalesce("conflict", F.lit(False)).alias("conflict"))


@query("upsert_withdraw_partial", """
SELECT chain, block_number, "index", amount + CASE WHEN block_number % 10 = 0 THEN 1 ELSE 0 END AS amount,
       success, 'Withdraw' AS event_name
FROM o_withdrawals""")
def upsert_withdraw_partial(spark, sf):
    """``success`` and ``event_name`` keep the first value; ``amount`` is replaced."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    wd = (X.extract_withdrawals(X.extract_events(fixture.nested_blocks(events, FIXTURE_CHAINS)))
          .withColumn("event_name", F.lit("Withdraw"))
          .withColumn("block_bucket", X.block_bucket("block_number")))
    redo = (wd.where(F.col("block_number") % 10 == 0)
            .withColumn("amount", (F.col("amount") + 1).cast("decimal(38,0)"))
            .withColumn("success", ~F.col("success"))
            .withColumn("event_name", F.lit("Withdrawn")))
    path = work_dir(spark, "upsert-withdraw") + "/withdraw"
    _upsert_twice(S.with_order(wd, 0, "index"), S.with_order(redo, 1, "index"), path,
                  S.TABLE_KEYS["withdraw"], keep_old=["success", "event_name"])
    return spark.read.parquet(path).select("chain", "block_number", "index", "amount", "success", "event_name")


# --- fan-out (IO-16, IO-17) -------------------------------------------------------
def _sinks(root, plan):
    """Ordered sinks from ``[(name, format or None)]``; None is a sink that fails."""
    def writer(fmt, name):
        def write(df):
            df.write.mode("overwrite").format(fmt).save(f"{root}/{name}")
            return df.sparkSession.read.schema(df.schema).format(fmt).load(f"{root}/{name}").count()
        return write

    def fail(_df):
        raise RuntimeError("sink unavailable")
    return {name: (writer(fmt, name) if fmt else fail) for name, fmt in plan}


@query("fan_out_counts", """
SELECT 'parquet_engine' AS sink, count(*) AS "rows", 'ok' AS status FROM o_events
UNION ALL SELECT 'broken_engine', 0, 'error: RuntimeError'
UNION ALL SELECT 'json_engine', count(*), 'ok' FROM o_events""")
def fan_out_counts(spark, sf):
    """Engine fan-out: one copy per engine, an engine error is logged and
    swallowed (``on_error='continue'``)."""
    ev = lake_for(spark, sf).table("events").drop("_batch_id")
    root = work_dir(spark, "fan-out")
    sinks = _sinks(root, [("parquet_engine", "parquet"), ("broken_engine", None),
                          ("json_engine", "json")])
    return S.fan_out(ev, sinks, on_error="continue")


@query("fan_out_stop", """
SELECT 'node_a' AS sink, count(*) AS "rows", 'ok' AS status FROM o_events
UNION ALL SELECT 'node_b', 0, 'error: RuntimeError'
UNION ALL SELECT 'node_c', 0, 'skipped'""")
def fan_out_stop(spark, sf):
    """Storage-node fan-out: sequential, the first failing node stops the rest."""
    ev = lake_for(spark, sf).table("events").drop("_batch_id")
    root = work_dir(spark, "fan-out-stop")
    sinks = _sinks(root, [("node_a", "parquet"), ("node_b", None), ("node_c", "parquet")])
    return S.fan_out(ev, sinks, on_error="stop")


# --- upsert order (IO-07 … IO-13, N-03, T-03, T-04) ---------------------------------
@query("upsert_fresh_checkpoint", """
SELECT chain, number, CASE WHEN number % 10 = 0 THEN spec_version + 1 ELSE spec_version END AS spec_version,
       CASE WHEN number % 10 = 0 THEN NULL ELSE validator END AS validator FROM o_blocks""")
def upsert_fresh_checkpoint(spark, sf):
    """The later write wins although its stream starts counting anew: blocks
    stored as batch 5 of one stream, re-delivered as batch 0 of another."""
    blocks, redo = _blocks(spark, sf)
    path = work_dir(spark, "upsert-fresh") + "/blocks"
    keys = S.TABLE_KEYS["blocks"]
    S.upsert(S.with_order(X.extract_headers(blocks), 5), path, keys, commit="a-5")
    S.upsert(S.with_order(X.extract_headers(redo), 0), path, keys, commit="b-0")
    S.upsert(S.with_order(X.extract_headers(blocks), 5), path, keys, commit="a-5")     # a true replay
    return spark.read.parquet(path).select("chain", "number", "spec_version", "validator")


def _twice_in_one_batch(spark, sf, df_of):
    """Every block in one file as an envelope, those of ``B % 10 = 0`` again
    in a later file; read as one batch."""
    blocks, redo = _blocks(spark, sf)
    src = work_dir(spark, "one-batch") + "/lines"
    for part in (blocks, redo):
        fixture.wire_lines(part).select("value").write.mode("append").text(src)
    env, _ = V.split_valid(V.read_envelopes(spark, src), FIXTURE_CHAINS)
    return S.with_order(df_of(V.blocks_of(env)), 0)


@query("latest_in_one_batch", """
SELECT chain, number, CASE WHEN number % 10 = 0 THEN spec_version + 1 ELSE spec_version END AS spec_version,
       CASE WHEN number % 10 = 0 THEN NULL ELSE validator END AS validator FROM o_blocks""")
def latest_in_one_batch(spark, sf):
    """Two versions of a block in one batch: the later line wins, by file,
    split, line and place in the envelope."""
    path = work_dir(spark, "latest-batch") + "/blocks"
    S.upsert(_twice_in_one_batch(spark, sf, X.extract_headers), path, S.TABLE_KEYS["blocks"])
    return spark.read.parquet(path).select("chain", "number", "spec_version", "validator")


@query("partial_in_one_batch", """
SELECT chain, number, spec_version, CASE WHEN number % 10 = 0 THEN NULL ELSE validator END AS validator FROM o_blocks""")
def partial_in_one_batch(spark, sf):
    """A partial update inside one batch: ``spec_version`` keeps the first
    version's value, the other columns take the later one's."""
    path = work_dir(spark, "partial-batch") + "/blocks"
    S.upsert(_twice_in_one_batch(spark, sf, X.extract_headers), path, S.TABLE_KEYS["blocks"], keep_old=["spec_version"])
    return spark.read.parquet(path).select("chain", "number", "spec_version", "validator")


@query("legacy_block_upsert", """
SELECT number, hash, parent_hash, "timestamp", CASE WHEN number % 10 = 0 THEN spec_version + 1 ELSE spec_version END AS spec_version
FROM o_blocks WHERE chain = 'polkadot'""")
def legacy_block_upsert(spark, sf):
    """IO-14: the legacy five-column block table (of one chain, as it has no
    chain column), upserted like IO-07."""
    blocks, redo = _blocks(spark, sf)
    path = work_dir(spark, "legacy-block") + "/block"
    cols = ["chain", "block_bucket", "number", "hash", "parent_hash", "timestamp", "spec_version"]
    for name, part in (("base", blocks), ("redo", redo)):
        rows = X.extract_headers(part.where("chain = 'polkadot'")).select(*cols)
        S.upsert(S.with_order(rows, 0), path, S.TABLE_KEYS["blocks"], commit=name)
    return spark.read.parquet(path).select("number", "hash", "parent_hash", "timestamp", "spec_version")
