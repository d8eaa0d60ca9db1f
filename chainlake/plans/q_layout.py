"""Registered queries over derived layouts: bucketed tables (J-01, J-06, J-07),
stored sketches (D-07, D-09), the hash index kept by the stream (D-01) and
handlers in one pass (F-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..lake import FIXTURE_CHAINS, lake_for
from ..operators import analytics as A
from ..operators import extract as X
from ..operators import hash_index, rollups
from ..sources import fixture
from ..streaming import ingest as I
from .q_analytics import _FEE_SQL, _INTERVAL_SQL
from .q_sink import work_dir
from .q_stream import _ordered_source
from .registry import query

KEYS = ["chain", "block_number", "extrinsic_index"]


# --- J-01 / J-06 / J-07 without exchanges -------------------------------------------
@query("extrinsic_events_bucketed", """
SELECT x.chain, x.id, count(e.id) AS n_events, min(e.event_index) AS first_event, max(e.event_index) AS last_event
FROM o_extrinsics x LEFT JOIN o_events e
  ON e.chain = x.chain AND e.block_number = x.block_number AND e.extrinsic_index = x.extrinsic_index
GROUP BY x.chain, x.id""")
def extrinsic_events_bucketed(spark, sf):
    """J-01 on the bucketed tables: neither the aggregate nor the join shuffles."""
    lake = lake_for(spark, sf)
    e = lake.bucketed("events").groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_index").alias("first_event"), F.max("event_index").alias("last_event"))
    x = lake.bucketed("extrinsics").select(*KEYS, "id")
    return x.join(e, KEYS, "left").select("chain", "id", F.coalesce("n", F.lit(0)).alias("n_events"), "first_event", "last_event")


@query("transfers_enriched_bucketed", """
SELECT t.chain, t.id, b.hash AS block_hash, b."timestamp" AS block_time, x.extrinsic_hash AS x_hash,
       x.call_name, t."from", t."to", t.amount, coalesce(f.fee, 0) AS fee, t.success
FROM o_transfers t
JOIN o_blocks b ON b.chain = t.chain AND b.number = t.block_number
LEFT JOIN o_extrinsics x ON x.chain = t.chain AND x.block_number = t.block_number AND x.extrinsic_index = t.extrinsic_index
LEFT JOIN """ + _FEE_SQL + """ f ON f.chain = t.chain AND f.block_number = t.block_number AND f.extrinsic_index = t.extrinsic_index""")
def transfers_enriched_bucketed(spark, sf):
    """J-06 on the bucketed tables: three joins and the fee aggregate, no shuffle."""
    lake = lake_for(spark, sf)
    events = lake.bucketed("events")
    t = A.enrich_transfers(X.extract_transfers(events), lake.bucketed("blocks"), lake.bucketed("extrinsics"), events)
    return t.select("chain", "id", "block_hash", "block_time", "x_hash", "call_name", "from", "to", "amount", "fee", "success")


@query("events_enriched_bucketed", """
SELECT e.chain, e.id, x.extrinsic_hash AS x_hash, x.call_name, b."timestamp" AS block_time, b.is_finalized
FROM o_events e
LEFT JOIN o_extrinsics x ON x.chain = e.chain AND x.block_number = e.block_number AND x.extrinsic_index = e.extrinsic_index
LEFT JOIN o_blocks b ON b.chain = e.chain AND b.number = e.block_number""")
def events_enriched_bucketed(spark, sf):
    """J-07 on the bucketed tables."""
    lake = lake_for(spark, sf)
    e = A.enrich_events(lake.bucketed("events"), lake.bucketed("extrinsics"), lake.bucketed("blocks"))
    return e.select("chain", "id", "x_hash", "call_name", "block_time", "is_finalized")


# --- D-07 / D-09: any range of days from stored sketches ------------------------------
FIRST_DAY_SQL = "(SELECT min(block_timestamp) // 86400000 FROM o_events)"


@query("validators_any_range", f"""
, days AS (SELECT chain, validator, "timestamp" // 86400000 - {FIRST_DAY_SQL} AS d FROM o_blocks)
SELECT chain, r.first_day, r.last_day, count(DISTINCT validator) AS validators, true AS within_bound
FROM days JOIN (VALUES (0, 29), (3, 9), (12, 12)) r(first_day, last_day) ON d BETWEEN r.first_day AND r.last_day
GROUP BY ALL""")
def validators_any_range(spark, sf):
    """D-07: distinct validators of three ranges of days (counted from the
    first) from stored daily sketches; the exact count beside it, and whether
    the estimate is within three standard errors of it."""
    lake = lake_for(spark, sf)
    blocks = lake.table("blocks").withColumn("day", rollups.day_of(F.col("timestamp")))
    first = blocks.agg(F.min("day")).first()[0] or 0
    out = None
    for lo, hi in ((0, 29), (3, 9), (12, 12)):
        est = rollups.distinct_validators(rollups.days(lake.sketches(), first + lo, first + hi), ["chain"])
        exact = blocks.where(F.col("day").between(first + lo, first + hi)).groupBy("chain").agg(F.count_distinct("validator").alias("exact"))
        ok = F.abs(F.col("validators") - F.col("exact")) <= F.ceil(F.col("exact") * rollups.HLL_BOUND)
        part = est.join(exact, "chain").select("chain", F.lit(lo).alias("first_day"), F.lit(hi).alias("last_day"),
                                               F.col("exact").alias("validators"), ok.alias("within_bound"))
        out = part if out is None else out.unionByName(part)
    return out


@query("interval_quantiles_any_range", f"""
, iv AS (SELECT chain, interval_ms, t // 86400000 - {FIRST_DAY_SQL} AS d
         FROM (SELECT chain, "timestamp" AS t, "timestamp" - lag("timestamp") OVER (PARTITION BY chain ORDER BY number) AS interval_ms FROM o_blocks)
         WHERE interval_ms IS NOT NULL)
SELECT chain, r.first_day, r.last_day, p, count(*) AS n, true AS within_bound
FROM iv JOIN (VALUES (0, 29), (5, 6)) r(first_day, last_day) ON d BETWEEN r.first_day AND r.last_day,
     (VALUES (CAST(0.5 AS DOUBLE)), (0.9), (0.99)) q(p) GROUP BY ALL""")
def interval_quantiles_any_range(spark, sf):
    """D-09: quantiles of the block interval over ranges of days from stored
    KLL sketches, each checked against the exact ranks."""
    lake = lake_for(spark, sf)
    blocks = lake.table("blocks").select("chain", "number", "timestamp")
    iv = A.prev_in_order(blocks, ["chain"], "number", ["timestamp"]).select(
        "chain", rollups.day_of(F.col("timestamp")).alias("day"), (F.col("timestamp") - F.col("prev_timestamp")).alias("interval_ms"))
    iv = iv.where("interval_ms is not null")
    first = blocks.agg(F.min(rollups.day_of(F.col("timestamp")))).first()[0] or 0
    out = None
    for lo, hi in ((0, 29), (5, 6)):
        est = rollups.interval_quantiles(rollups.days(lake.sketches(), first + lo, first + hi), ["chain"], [0.5, 0.9, 0.99])
        inside = iv.where(F.col("day").between(first + lo, first + hi))
        n = inside.groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
        part = (rollups.rank_error(inside, est, ["chain"], "interval_ms").join(n, "chain")
                .select("chain", F.lit(lo).alias("first_day"), F.lit(hi).alias("last_day"), "p", "n",
                        (F.col("error") <= rollups.RANK_BOUND).alias("within_bound")))
        out = part if out is None else out.unionByName(part)
    return out


# --- D-01: the index kept by the stream ----------------------------------------------
@query("stream_hash_index", """
SELECT chain, number, hash, block_number_found FROM (
  SELECT chain, number, hash, number AS block_number_found FROM o_blocks)""")
def stream_hash_index(spark, sf):
    """The index of block hashes kept in the same commits as the blocks, partly
    folded; every stored block is found through it at its place."""
    root = work_dir(spark, "stream-index")
    src, _, per_trigger = _ordered_source(spark, sf, root)
    run = lambda ckpt: I.run_to_end(I.start_chain(
        spark, f"{root}/_source", root, f"{root}/{ckpt}", max_files=2 * per_trigger, tables=("blocks",), stream="indexed", indexes=("hash",)))
    run("_checkpoint")
    hash_index.fold(spark, root, "hash", least=2)
    found = hash_index.read(spark, root, "hash").select("hash", "chain", F.col("at_block").alias("block_number_found")).distinct()
    return spark.read.parquet(f"{root}/blocks").select("chain", "number", "hash").join(found, ["chain", "hash"])


# --- F-01: all handlers in one scan ---------------------------------------------------
@query("handlers_one_pass", """
SELECT 'transfer' AS handler, chain, id, amount, "from" AS who FROM o_transfers
UNION ALL SELECT 'outgoing', chain, id, amount, "from" FROM o_transfers
UNION ALL SELECT 'withdraw', chain, id, amount, who FROM o_withdrawals""")
def handlers_one_pass(spark, sf):
    """Three handlers, two of them of one event, over one scan of the events;
    their tables are written by one job and read back."""
    transfer = X.transfer_fields(parsed=True)
    reg = (N.HandlerRegistry()
           .register_fields("Balances", "Transfer", "transfer", transfer)
           .register_fields("Balances", "Transfer", "outgoing", {
               "chain": F.col("chain"), "id": F.col("id"), "who": transfer["from"], "amount": transfer["amount"]})
           .register_fields("Balances", "Withdraw", "withdraw", X.withdrawal_fields(parsed=True)))
    root = work_dir(spark, "handlers") + "/tables"
    reg.write_all(lake_for(spark, sf).table("events", parsed=True), root)
    out = None
    for name, who in (("transfer", "from"), ("outgoing", "who"), ("withdraw", "who")):
        part = reg.table(spark, root, name).select(F.lit(name).alias("handler"), "chain", "id", "amount", F.col(who).alias("who"))
        out = part if out is None else out.unionByName(part)
    return out


# --- D-10 / D-11 / D-03 ---------------------------------------------------------------
_RANK_SQL = """
SELECT chain, id, row_number() OVER (PARTITION BY chain ORDER BY block_timestamp, block_number, event_index) AS rn,
       rank() OVER (PARTITION BY chain ORDER BY block_timestamp) AS rnk,
       dense_rank() OVER (PARTITION BY chain ORDER BY block_timestamp) AS drnk FROM o_events"""


def _ranked_events(spark, sf, parts=None, tiles=None):
    ev = lake_for(spark, sf).table("events").select("chain", "id", "block_timestamp", "block_number", "event_index")
    return A.ranked(ev, ["chain"], "block_timestamp", ["block_number", "event_index"], tiles, parts)


@query("chain_rank", _RANK_SQL)
def chain_rank(spark, sf):
    """D-10: row number, rank and dense rank of a whole chain's events by block
    time; the chain is spread over range partitions."""
    return _ranked_events(spark, sf).select("chain", "id", F.col("row_number").alias("rn"), F.col("rank").alias("rnk"),
                                            F.col("dense_rank").alias("drnk"))


@query("chain_rank_many_parts", _RANK_SQL)
def chain_rank_many_parts(spark, sf):
    """The same over 60 small partitions: ties and chains run across them."""
    return _ranked_events(spark, sf, parts=60).select("chain", "id", F.col("row_number").alias("rn"), F.col("rank").alias("rnk"),
                                                      F.col("dense_rank").alias("drnk"))


@query("chain_ntile", """
SELECT chain, id, ntile(7) OVER (PARTITION BY chain ORDER BY block_timestamp, block_number, event_index) AS tile FROM o_events""")
def chain_ntile(spark, sf):
    """D-10: sevenths of each chain."""
    return _ranked_events(spark, sf, tiles=7).select("chain", "id", F.col("ntile").alias("tile"))


@query("chain_first_last", """
SELECT chain, number, first_value(hash) OVER w AS first_hash, last_value(hash) OVER w AS last_hash FROM o_blocks
WINDOW w AS (PARTITION BY chain ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def chain_first_last(spark, sf):
    """D-11: the first and the last block of the chain beside each block."""
    b = lake_for(spark, sf).table("blocks").select("chain", "number", "hash")
    return A.first_last(b, ["chain"], "number", [], "hash").select(
        "chain", "number", F.col("first_value").alias("first_hash"), F.col("last_value").alias("last_hash"))


@query("block_lead", """
SELECT chain, number, lead(number) OVER w AS next_number, lead("timestamp") OVER w - "timestamp" AS wait_ms FROM o_blocks
WINDOW w AS (PARTITION BY chain ORDER BY number)""")
def block_lead(spark, sf):
    """D-11: the next stored block and the wait for it, over 16-block buckets."""
    b = lake_for(spark, sf).table("blocks").select("chain", "number", "timestamp")
    return A.next_in_order(b, ["chain"], "number", ["timestamp"], bucket_size=16).select(
        "chain", "number", "next_number", (F.col("next_timestamp") - F.col("timestamp")).alias("wait_ms"))


@query("chains_full_join", """
SELECT coalesce(p.number, k.number) AS number, p.hash AS polkadot_hash, k.hash AS kusama_hash
FROM (SELECT * FROM o_blocks WHERE chain = 'polkadot' AND number % 3 <> 0) p
FULL JOIN (SELECT * FROM o_blocks WHERE chain = 'kusama') k ON k.number = p.number""")
def chains_full_join(spark, sf):
    """D-03: the chains' blocks side by side by number, each kept without the other."""
    b = lake_for(spark, sf).table("blocks").select("chain", "number", "hash")
    p = b.where("chain = 'polkadot' and number % 3 <> 0").select("number", F.col("hash").alias("polkadot_hash"))
    k = b.where("chain = 'kusama'").select("number", F.col("hash").alias("kusama_hash"))
    return p.join(k, "number", "full").select("number", "polkadot_hash", "kusama_hash")


@query("withdrawals_right_join", """
SELECT b.chain, b.number, coalesce(sum(w.amount), 0) AS withdrawn, count(w.id) AS n
FROM o_withdrawals w RIGHT JOIN o_blocks b ON b.chain = w.chain AND b.number = w.block_number GROUP BY b.chain, b.number""")
def withdrawals_right_join(spark, sf):
    """D-03: withdrawals per block, blocks without any kept by the right side."""
    lake = lake_for(spark, sf)
    w = lake.table("withdrawals").groupBy("chain", F.col("block_number").alias("number")).agg(
        F.sum("amount").alias("withdrawn"), F.count(F.lit(1)).alias("n"))
    return w.join(lake.table("blocks").select("chain", "number"), ["chain", "number"], "right").select(
        "chain", "number", F.coalesce("withdrawn", F.lit(0).cast("decimal(38,0)")).alias("withdrawn"), F.coalesce("n", F.lit(0)).alias("n"))


@query("events_near_incidents", """
SELECT l.chain, l.block_number AS incident, e.id FROM o_logs l
JOIN o_blocks b ON b.chain = l.chain AND b.number = l.block_number
JOIN o_events e ON e.chain = l.chain AND e.block_timestamp BETWEEN b."timestamp" - 600000 AND b."timestamp" + 600000
WHERE l.type = 'Consensus' AND l.engine IS NULL""")
def events_near_incidents(spark, sf):
    """D-05 as pairs: the events within ten minutes of blocks whose consensus
    engine has no text; ranges meet points by half-hour bins."""
    lake = lake_for(spark, sf)
    logs = lake.table("block_logs").where((F.col("type") == "Consensus") & F.col("engine").isNull())
    inc = (lake.table("blocks").join(logs.select("chain", F.col("block_number").alias("number")), ["chain", "number"], "left_semi")
           .select("chain", F.col("number").alias("incident"), (F.col("timestamp") - 600_000).alias("t0"), (F.col("timestamp") + 600_000).alias("t1")))
    ev = lake.table("events").select("chain", "id", "block_timestamp")
    return A.range_join(ev, inc, ["chain"], "block_timestamp", "t0", "t1", 1_800_000).select("chain", "incident", "id")
