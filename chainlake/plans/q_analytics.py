"""Registered queries: chain analytics over the stored tables (SURVEY §2.3 -
§2.7, §2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lake import FIXTURE_CHAINS, lake_for
from ..operators import hash_index
from .registry import query

HOUR_MS = 3_600_000
DAY_MS = 86_400_000


@query("events_per_pallet_hour", """
SELECT e.chain, e.mod_name, (b."timestamp" // 3600000) * 3600000 AS hour_ms, count(*) AS n_events,
       count(DISTINCT CASE WHEN x.result THEN x.id END) AS n_success_extrinsics
FROM o_events e
JOIN o_blocks b ON b.chain = e.chain AND b.number = e.block_number
JOIN o_extrinsics x ON x.chain = e.chain AND x.block_number = e.block_number AND x.extrinsic_index = e.extrinsic_index
GROUP BY 1, 2, 3""")
def events_per_pallet_hour(spark, sf):
    """Flagship (M0): events of extrinsics with their block's time and their
    extrinsic's success, counted per chain, pallet and hour. Extraction stored
    both with the event, so no join is needed. Events are first reduced to one
    row per (extrinsic, pallet) by a map-side partial aggregate; after that
    step the distinct count of successful extrinsics is a plain ``count_if``."""
    ev = (lake_for(spark, sf).table("events").where("extrinsic_index is not null")
          .groupBy("chain", "block_number", "extrinsic_index", "mod_name", "block_timestamp", "extrinsic_success")
          .agg(F.count(F.lit(1)).alias("n")))
    return (ev.groupBy("chain", "mod_name", (F.expr(f"block_timestamp div {HOUR_MS}") * HOUR_MS).alias("hour_ms"))
            .agg(F.sum("n").alias("n_events"),
                 F.count_if(F.col("extrinsic_success")).alias("n_success_extrinsics")))


# --- helpers -----------------------------------------------------------------
from pyspark.sql import Window  # noqa: E402

from ..functions import names as N  # noqa: E402
from ..operators import analytics as A  # noqa: E402
from ..operators import extract as X  # noqa: E402
from ..operators import sink as S  # noqa: E402
from ..sources import fixture  # noqa: E402
from .q_sink import work_dir  # noqa: E402


def _t(spark, sf, name):
    """A stored table, all chains."""
    return lake_for(spark, sf).table(name)


def _count():
    return F.count(F.lit(1))


# --- success (A-01, N-01) -----------------------------------------------------
@query("extrinsic_success", """
SELECT chain, block_number, extrinsic_index, ok AS success FROM o_ok""")
def extrinsic_success(spark, sf):
    return X.success_by_extrinsic(_t(spark, sf, "events")).select(
        "chain", "block_number", "extrinsic_index", "success")


_RUNNING_SQL = """
SELECT x.chain, x.id, coalesce(bool_or(ok.ok) OVER (PARTITION BY x.chain, x.block_number ORDER BY x.extrinsic_index
                                            ROWS UNBOUNDED PRECEDING), false) AS result_running
FROM o_extrinsics x
LEFT JOIN o_ok ok ON ok.chain = x.chain AND ok.block_number = x.block_number
                 AND ok.extrinsic_index = x.extrinsic_index"""


@query("extrinsic_success_running", _RUNNING_SQL)
def extrinsic_success_running(spark, sf):
    """N-01 over the stored tables (aggregate + window per block)."""
    return A.running_success(_t(spark, sf, "extrinsics"), _t(spark, sf, "events")).select(
        "chain", "id", "result_running")


@query("extrinsic_success_running_extract", _RUNNING_SQL)
def extrinsic_success_running_extract(spark, sf):
    """N-01 / T-05 at extraction time: no shuffle, the block is one row."""
    blocks = fixture.nested_blocks(spark.read.parquet(f"{sf}/events.parquet"), FIXTURE_CHAINS)
    return X.extract_extrinsics(blocks, "block_running").select(
        "chain", "id", F.col("result").alias("result_running"))


@query("success_scopes_differ", """
SELECT count(*) AS n_events, count(*) FILTER (WHERE r.result_running <> x.result) AS n_differ
FROM o_events e
JOIN o_extrinsics x ON x.chain = e.chain AND x.block_number = e.block_number AND x.extrinsic_index = e.extrinsic_index
JOIN (""" + _RUNNING_SQL + """) r ON r.chain = x.chain AND r.id = x.id""")
def success_scopes_differ(spark, sf):
    """Event rows whose extrinsic's success differs between the two scopes."""
    ev = _t(spark, sf, "events").select("chain", "block_number", "extrinsic_index")
    x = A.running_success(_t(spark, sf, "extrinsics"), _t(spark, sf, "events"))
    j = ev.join(x, ["chain", "block_number", "extrinsic_index"])
    return j.agg(_count().alias("n_events"),
                 F.count_if(F.col("result_running") != F.col("result")).alias("n_differ"))


# --- per-extrinsic / per-block aggregates (A-02, A-03, A-04, J-01) ----------------
@query("events_per_extrinsic", """
SELECT chain, extrinsic_id, count(*) AS n_events FROM o_events GROUP BY ALL""")
def events_per_extrinsic(spark, sf):
    return _t(spark, sf, "events").groupBy("chain", "extrinsic_id").agg(_count().alias("n_events"))


@query("block_counts", """
SELECT b.chain, b.number, coalesce(e.n, 0) AS event_num, coalesce(x.n, 0) AS extrinsics_num
FROM o_blocks b
LEFT JOIN (SELECT chain, block_number, count(*) AS n FROM o_events GROUP BY ALL) e
  ON e.chain = b.chain AND e.block_number = b.number
LEFT JOIN (SELECT chain, block_number, count(*) AS n FROM o_extrinsics GROUP BY ALL) x
  ON x.chain = b.chain AND x.block_number = b.number""")
def block_counts(spark, sf):
    return A.block_counts(_t(spark, sf, "blocks"), _t(spark, sf, "extrinsics"),
                          _t(spark, sf, "events"))


@query("batch_stats", """
SELECT chain, CAST(0 AS BIGINT) AS batch_id, count(*) AS n_blocks, min(number) AS min_number,
       max(number) AS max_number FROM o_blocks GROUP BY chain""")
def batch_stats(spark, sf):
    """A-04: per ingest batch, block count and range (``observe`` exposes the
    same metrics on a running query without an extra job)."""
    b = _t(spark, sf, "blocks")
    return b.groupBy("chain", F.col("_batch_id").alias("batch_id")).agg(
        _count().alias("n_blocks"), F.min("number").alias("min_number"),
        F.max("number").alias("max_number"))


@query("extrinsic_events_join", """
SELECT x.chain, x.id, count(e.id) AS n_events, min(e.event_index) AS first_event,
       max(e.event_index) AS last_event
FROM o_extrinsics x LEFT JOIN o_events e
  ON e.chain = x.chain AND e.block_number = x.block_number AND e.extrinsic_index = x.extrinsic_index
GROUP BY x.chain, x.id""")
def extrinsic_events_join(spark, sf):
    """J-01: each extrinsic with its events (count, first and last index);
    events are aggregated per extrinsic before the join (map-side partial
    aggregate), so the join sees one row per extrinsic on each side."""
    keys = ["chain", "block_number", "extrinsic_index"]
    x = _t(spark, sf, "extrinsics").select(*keys, "id")
    e = (_t(spark, sf, "events").groupBy(*keys)
         .agg(_count().alias("n"), F.min("event_index").alias("first_event"),
              F.max("event_index").alias("last_event")))
    return (x.join(e, keys, "left")
            .select("chain", "id", F.coalesce("n", F.lit(0)).alias("n_events"), "first_event", "last_event"))


# --- transfers / withdrawals (X-12, X-13, J-06, J-07, F-01) -----------------------
@query("transfers", """
SELECT chain, block_number, "index", id, extrinsic_id, "from", "to", amount, success FROM o_transfers""")
def transfers(spark, sf):
    return _t(spark, sf, "transfers").select("chain", "block_number", "index", "id", "extrinsic_id",
                                             "from", "to", "amount", "success")


@query("withdrawals", """
SELECT chain, block_number, "index", id, extrinsic_id, who, amount, success FROM o_withdrawals""")
def withdrawals(spark, sf):
    return _t(spark, sf, "withdrawals").select("chain", "block_number", "index", "id", "extrinsic_id",
                                               "who", "amount", "success")


@query("transfers_joined_success", """
SELECT chain, block_number, "index", success FROM o_transfers""")
def transfers_joined_success(spark, sf):
    """X-12 with success from the A-01 aggregate + join (events without the
    denormalised flag), to check both paths agree."""
    ev = _t(spark, sf, "events").drop("extrinsic_success")
    return X.extract_transfers(ev).select("chain", "block_number", "index", "success")


_FEE_SQL = """(SELECT chain, block_number, extrinsic_index,
          sum(CAST(json_extract_string("values", '$.actual_fee') AS DECIMAL(38,0))) AS fee
   FROM o_events WHERE mod_name = 'TransactionPayment' AND event_name = 'TransactionFeePaid'
   GROUP BY ALL)"""


@query("transfers_enriched", """
SELECT t.chain, t.id, b.hash AS block_hash, b."timestamp" AS block_time, x.extrinsic_hash AS x_hash,
       x.call_name, t."from", t."to", t.amount, coalesce(f.fee, 0) AS fee, t.success
FROM o_transfers t
JOIN o_blocks b ON b.chain = t.chain AND b.number = t.block_number
LEFT JOIN o_extrinsics x ON x.chain = t.chain AND x.block_number = t.block_number AND x.extrinsic_index = t.extrinsic_index
LEFT JOIN """ + _FEE_SQL + """ f ON f.chain = t.chain AND f.block_number = t.block_number AND f.extrinsic_index = t.extrinsic_index""")
def transfers_enriched(spark, sf):
    t = A.enrich_transfers(_t(spark, sf, "transfers"), _t(spark, sf, "blocks"), _t(spark, sf, "extrinsics"),
                           lake_for(spark, sf).table("events", parsed=True))
    return t.select("chain", "id", "block_hash", "block_time", "x_hash", "call_name", "from", "to",
                    "amount", "fee", "success")


@query("events_enriched", """
SELECT e.chain, e.id, x.extrinsic_hash AS x_hash, x.call_name, b."timestamp" AS block_time, b.is_finalized
FROM o_events e
LEFT JOIN o_extrinsics x ON x.chain = e.chain AND x.block_number = e.block_number AND x.extrinsic_index = e.extrinsic_index
LEFT JOIN o_blocks b ON b.chain = e.chain AND b.number = e.block_number""")
def events_enriched(spark, sf):
    e = A.enrich_events(_t(spark, sf, "events"), _t(spark, sf, "extrinsics"), _t(spark, sf, "blocks"))
    return e.select("chain", "id", "x_hash", "call_name", "block_time", "is_finalized")


@query("handler_registry", """
SELECT 'transfer' AS handler, count(*) AS n_rows, sum(amount) AS total_amount FROM o_transfers
UNION ALL
SELECT 'withdraw', count(*), sum(amount) FROM o_withdrawals""")
def handler_registry(spark, sf):
    reg = (N.HandlerRegistry()
           .register("Balances", "Transfer", "transfer", X.extract_transfers)
           .register("Balances", "Withdraw", "withdraw", X.extract_withdrawals))
    out = reg.apply(_t(spark, sf, "events"))
    parts = [df.agg(F.lit(name).alias("handler"), _count().alias("n_rows"),
                    F.sum("amount").alias("total_amount")) for name, df in out.items()]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def _name_values_sql() -> str:
    rows = ", ".join(f"('{p}', '{e}', '{k}', '{c}')" for p, e, k, c in N.name_rows())
    return f"(VALUES {rows}) d(dim_pallet, dim_event, canonical_pallet, canonical_event)"


@query("event_name_map", """
SELECT e.chain, e.mod_name, e.event_name,
       coalesce(d.canonical_pallet, CASE e.mod_name WHEN 'System' THEN 'system'
                WHEN 'Balances' THEN 'balances' WHEN 'TransactionPayment' THEN 'transaction_payment'
                WHEN 'Utility' THEN 'utility' END) AS canonical_pallet,
       coalesce(d.canonical_event, 'Unsupport') AS canonical_event, count(*) AS n
FROM o_events e LEFT JOIN """ + _name_values_sql() + """
  ON d.dim_pallet = e.mod_name AND d.dim_event = e.event_name
GROUP BY ALL""")
def event_name_map(spark, sf):
    # count per (pallet, event) first; the dimension join then sees a few rows
    per = _t(spark, sf, "events").groupBy("chain", "mod_name", "event_name").agg(_count().alias("n"))
    return N.canonical_event_name(per).select("chain", "mod_name", "event_name", "canonical_pallet",
                                              "canonical_event", "n")


# --- block structure (J-08, J-09, T-06, U-02) ------------------------------------
@query("asof_spec_version", """
SELECT e.chain, e.id, v.spec_version AS spec_asof
FROM o_events e ASOF LEFT JOIN
  (SELECT chain, spec_version, min(number) AS from_block FROM o_blocks GROUP BY ALL) v
  ON e.chain = v.chain AND e.block_number >= v.from_block""")
def asof_spec_version(spark, sf):
    """Runtime version in effect at each event's block, from the upgrade
    points (first stored block per version)."""
    versions = A.runtime_versions(_t(spark, sf, "blocks"))
    ev = _t(spark, sf, "events").select("chain", "id", "block_number")
    return A.asof_join(ev, versions, ["chain"], "block_number", "from_block", "spec_version",
                       "spec_asof").select("chain", "id", "spec_asof")


@query("asof_bucket_edges", """
SELECT e.chain, e.id, v.spec_version AS spec_asof
FROM o_events e ASOF LEFT JOIN
  (SELECT chain, spec_version, min(number) AS from_block FROM o_blocks GROUP BY ALL) v
  ON e.chain = v.chain AND e.block_number >= v.from_block""")
def asof_bucket_edges(spark, sf):
    """The same as-of join in buckets of 16 blocks, so nearly every version is
    carried over bucket edges."""
    versions = A.runtime_versions(_t(spark, sf, "blocks"))
    ev = _t(spark, sf, "events").select("chain", "id", "block_number")
    return A.asof_join(ev, versions, ["chain"], "block_number", "from_block", "spec_version",
                       "spec_asof", bucket_size=16).select("chain", "id", "spec_asof")


@query("parent_links", """
SELECT c.chain, c.number AS child, p.number AS parent
FROM o_blocks c JOIN o_blocks p ON p.chain = c.chain AND p.hash = c.parent_hash""")
def parent_links(spark, sf):
    return A.parent_links(_t(spark, sf, "blocks")).select("chain", "child", "parent")


@query("orphan_blocks", """
SELECT chain, number, parent_hash FROM o_blocks c
WHERE NOT EXISTS (SELECT 1 FROM o_blocks p WHERE p.chain = c.chain AND p.hash = c.parent_hash)""")
def orphan_blocks(spark, sf):
    return A.orphan_blocks(_t(spark, sf, "blocks")).select("chain", "number", "parent_hash")


_GAPS_SQL = """
SELECT chain, prev + 1 AS gap_from, number - 1 AS gap_to, number - prev - 1 AS missing
FROM (SELECT chain, number, lag(number) OVER (PARTITION BY chain ORDER BY number) AS prev
      FROM o_blocks WHERE number % 97 <> 96)
WHERE number - prev > 1"""


def _blocks_with_gaps(spark, sf):
    """The stored blocks without those of ``B % 97 = 96``, so that there are
    gaps to find (kusama, which has every other block, has more)."""
    return _t(spark, sf, "blocks").where(F.col("number") % fixture.GAP_MOD != fixture.GAP_REM)


@query("block_gaps", _GAPS_SQL)
def block_gaps(spark, sf):
    return A.block_gaps(_blocks_with_gaps(spark, sf))


@query("block_gaps_bucket_edges", _GAPS_SQL)
def block_gaps_bucket_edges(spark, sf):
    """The same audit in buckets of 8 blocks: gaps cross bucket edges."""
    return A.block_gaps(_blocks_with_gaps(spark, sf), bucket_size=8)


@query("multi_chain_union", """
SELECT b.chain, b.n_blocks, e.n_events
FROM (SELECT chain, count(*) AS n_blocks FROM o_blocks GROUP BY chain) b
JOIN (SELECT chain, count(*) AS n_events FROM o_events GROUP BY chain) e USING (chain)""")
def multi_chain_union(spark, sf):
    """U-02: every stored chain side by side, whatever its name."""
    nb = _t(spark, sf, "blocks").groupBy("chain").agg(_count().alias("n_blocks"))
    ne = _t(spark, sf, "events").groupBy("chain").agg(_count().alias("n_events"))
    return nb.join(ne, "chain")


@query("derived_chain_union", """
SELECT chain, count(*) AS n_blocks, min(number) AS first_block, max(spec_version) AS last_version FROM (
  SELECT chain, number, spec_version FROM o_blocks
  UNION ALL SELECT 'westend', number, spec_version FROM o_blocks WHERE chain = 'polkadot' AND number % 3 = 0)
GROUP BY chain""")
def derived_chain_union(spark, sf):
    """U-02 with a third chain, derived from the first one's blocks and stored
    beside the others in a table of its own."""
    root = work_dir(spark, "third-chain") + "/blocks"
    b = _t(spark, sf, "blocks")
    third = b.where((F.col("chain") == "polkadot") & (F.col("number") % 3 == 0)).withColumn("chain", F.lit("westend"))
    S.write_partitioned(b.unionByName(third), root)
    return spark.read.parquet(root).groupBy("chain").agg(
        _count().alias("n_blocks"), F.min("number").alias("first_block"), F.max("spec_version").alias("last_version"))


# --- §2.12 proof analytics ---------------------------------------------------------
def _block_hash_literal(n: int) -> str:
    import hashlib
    return "0x" + hashlib.sha256(f"block-{n}".encode()).hexdigest()


@query("block_by_hash", """
SELECT chain, number, hash, "timestamp" FROM o_blocks WHERE hash = '0x' || sha256('block-42')""")
def block_by_hash(spark, sf):
    """Point look-up: the equality reaches the Parquet scan as a pushed filter."""
    return _t(spark, sf, "blocks").where(F.col("hash") == _block_hash_literal(42)).select(
        "chain", "number", "hash", "timestamp")


@query("block_by_hash_indexed", """
SELECT chain, number, hash, "timestamp" FROM o_blocks WHERE hash = '0x' || sha256('block-42')""")
def block_by_hash_indexed(spark, sf):
    """D-01 through the index: the folder of the hash's first byte, then one
    partition of the blocks."""
    lake = lake_for(spark, sf)
    return hash_index.lookup(spark, lake.indexed("hash"), lake.table("blocks"), "hash", _block_hash_literal(42)).select(
        "chain", "number", "hash", "timestamp")


@query("blocks_by_parent_indexed", """
SELECT chain, number, parent_hash FROM o_blocks WHERE parent_hash = '0x' || sha256('block-30')""")
def blocks_by_parent_indexed(spark, sf):
    """The children of a block, through the index of parent hashes."""
    lake = lake_for(spark, sf)
    return hash_index.lookup(spark, lake.indexed("parent_hash"), lake.table("blocks"), "parent_hash",
                             _block_hash_literal(30)).select("chain", "number", "parent_hash")


@query("fork_roots", """
SELECT * FROM (WITH RECURSIVE walk AS (
  SELECT chain, number, hash, number AS root, 0 AS distance FROM o_blocks b
  WHERE NOT EXISTS (SELECT 1 FROM o_blocks p WHERE p.chain = b.chain AND p.hash = b.parent_hash)
  UNION ALL
  SELECT b.chain, b.number, b.hash, w.root, w.distance + 1 FROM walk w JOIN o_blocks b ON b.chain = w.chain AND b.parent_hash = w.hash)
SELECT chain, number, root, distance FROM walk)""")
def fork_roots(spark, sf):
    """D-16 / J-09: each block's oldest stored ancestor and the way to it."""
    return A.fork_roots(_t(spark, sf, "blocks")).select("chain", "number", "root", "distance")


@query("fork_roots_tiny_buckets", """
SELECT * FROM (WITH RECURSIVE walk AS (
  SELECT chain, number, hash, hash AS root_hash, 0 AS distance FROM o_blocks b
  WHERE NOT EXISTS (SELECT 1 FROM o_blocks p WHERE p.chain = b.chain AND p.hash = b.parent_hash)
  UNION ALL
  SELECT b.chain, b.number, b.hash, w.root_hash, w.distance + 1 FROM walk w JOIN o_blocks b ON b.chain = w.chain AND b.parent_hash = w.hash)
SELECT chain, number, root_hash, distance FROM walk)""")
def fork_roots_tiny_buckets(spark, sf):
    """The same with buckets of 3 blocks, so that pointers are doubled often."""
    return A.fork_roots(_t(spark, sf, "blocks"), bucket_size=3).select("chain", "number", "root_hash", "distance")


@query("events_by_call", """
SELECT e.chain, x.mod_name AS call_pallet, x.call_name, e.event_name, count(*) AS n
FROM o_events e JOIN o_extrinsics x ON x.chain = e.chain AND x.block_number = e.block_number
 AND x.extrinsic_index = e.extrinsic_index GROUP BY ALL""")
def events_by_call(spark, sf):
    keys = ["chain", "block_number", "extrinsic_index"]
    e = _t(spark, sf, "events").groupBy(*keys, "event_name").agg(_count().alias("n"))
    x = _t(spark, sf, "extrinsics").select(*keys, F.col("mod_name").alias("call_pallet"), "call_name")
    return (e.join(x, keys).groupBy("chain", "call_pallet", "call_name", "event_name")
            .agg(F.sum("n").alias("n")))


@query("blocks_left_transfers", """
SELECT b.chain, b.number, count(t.id) AS n_transfers, coalesce(sum(t.amount), 0) AS volume
FROM o_blocks b LEFT JOIN o_transfers t ON t.chain = b.chain AND t.block_number = b.number GROUP BY b.chain, b.number""")
def blocks_left_transfers(spark, sf):
    tv = _t(spark, sf, "transfers").groupBy("chain", "block_number").agg(
        _count().alias("n_transfers"), F.sum("amount").alias("volume"))
    b = _t(spark, sf, "blocks").select("chain", F.col("number").alias("block_number"))
    return (b.join(tv, ["chain", "block_number"], "left")
            .select("chain", F.col("block_number").alias("number"),
                    F.coalesce("n_transfers", F.lit(0)).alias("n_transfers"),
                    F.coalesce("volume", F.lit(0).cast("decimal(38,0)")).alias("volume")))


@query("events_in_ranges", """
, inc AS (SELECT b.chain, b.number AS incident, b."timestamp" - 600000 AS t0, b."timestamp" + 600000 AS t1
          FROM o_blocks b JOIN o_logs l ON l.chain = b.chain AND l.block_number = b.number
          WHERE l.type = 'Consensus' AND l.engine IS NULL)
SELECT inc.chain, incident, count(*) AS n_events FROM inc JOIN o_events e
  ON e.chain = inc.chain AND e.block_timestamp BETWEEN inc.t0 AND inc.t1 GROUP BY inc.chain, incident""")
def events_in_ranges(spark, sf):
    """Events within +-10 minutes of blocks whose consensus engine has no text
    (D-05): prefix sums over block time and two as-of look-ups per block."""
    logs = _t(spark, sf, "block_logs").where((F.col("type") == "Consensus") & F.col("engine").isNull())
    inc = (_t(spark, sf, "blocks").join(logs.select("chain", F.col("block_number").alias("number")),
                                        ["chain", "number"], "left_semi")
           .select("chain", F.col("number").alias("incident"),
                   (F.col("timestamp") - 600_000).alias("t0"), (F.col("timestamp") + 600_000).alias("t1")))
    ev = _t(spark, sf, "events").select("chain", "block_timestamp")
    out = A.count_in_ranges(ev, inc, ["chain"], "block_timestamp", "t0", "t1", "n_events", bucket_size=DAY_MS)
    return out.select("chain", "incident", "n_events")


@query("events_per_pallet_hour_filter", """
SELECT e.chain, mod_name, ("timestamp" // 3600000) * 3600000 AS hour_ms,
       count(*) FILTER (WHERE event_name <> 'ExtrinsicFailed') AS n_ok_events,
       count(*) AS n_events
FROM o_events e JOIN o_blocks b ON b.chain = e.chain AND b.number = e.block_number
GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def events_per_pallet_hour_filter(spark, sf):
    """GROUP BY with FILTER and HAVING. The block time is read from the
    events table, where extraction stored it, so no join is needed."""
    e = _t(spark, sf, "events").select("chain", "mod_name", "event_name", "block_timestamp")
    g = (e.groupBy("chain", "mod_name", (F.expr(f"block_timestamp div {HOUR_MS}") * HOUR_MS).alias("hour_ms"))
         .agg(F.count_if(F.col("event_name") != "ExtrinsicFailed").alias("n_ok_events"),
              _count().alias("n_events")))
    return g.where(F.col("n_events") > 1)


@query("distinct_validators", """
SELECT chain, ("timestamp" // 86400000) * 86400000 AS day_ms, count(DISTINCT validator) AS n_validators,
       count(*) AS n_blocks FROM o_blocks GROUP BY ALL""")
def distinct_validators(spark, sf):
    b = _t(spark, sf, "blocks")
    return b.groupBy("chain", (F.expr(f"timestamp div {DAY_MS}") * DAY_MS).alias("day_ms")).agg(
        F.count_distinct("validator").alias("n_validators"), _count().alias("n_blocks"))


@query("distinct_validators_approx", """
SELECT chain, ("timestamp" // 86400000) * 86400000 AS day_ms, count(DISTINCT validator) AS n_validators,
       true AS within_bound FROM o_blocks GROUP BY ALL""")
def distinct_validators_approx(spark, sf):
    """HyperLogLog estimate beside the exact count: it has to lie within three
    of its standard errors (5 %), or one validator, of it."""
    b = _t(spark, sf, "blocks")
    g = b.groupBy("chain", (F.expr(f"timestamp div {DAY_MS}") * DAY_MS).alias("day_ms")).agg(
        F.count_distinct("validator").alias("n_validators"), F.approx_count_distinct("validator", 0.05).alias("n"))
    off = F.abs(F.col("n") - F.col("n_validators"))
    return g.select("chain", "day_ms", "n_validators",
                    (off <= F.greatest(F.lit(1.0), 0.15 * F.col("n_validators"))).alias("within_bound"))


def _grouped(df, cols):
    # input is pre-aggregated to one row per (pallet, event) with count ``n``
    return [F.grouping(c).cast("int").alias(f"g_{c}") for c in cols] + [F.sum("n").alias("n")]


def _pallet_event_counts(spark, sf):
    """Counts per (pallet, event) first (map-side partial aggregate), so the
    Expand of cube / rollup / grouping sets runs over a handful of rows
    instead of every event."""
    return _t(spark, sf, "events").groupBy("chain", "mod_name", "event_name").agg(_count().alias("n"))


@query("pallet_event_rollup", """
SELECT chain, mod_name, event_name, CAST(grouping(chain) AS INTEGER) AS g_chain,
       CAST(grouping(mod_name) AS INTEGER) AS g_mod_name,
       CAST(grouping(event_name) AS INTEGER) AS g_event_name, count(*) AS n
FROM o_events GROUP BY ROLLUP (chain, mod_name, event_name)""")
def pallet_event_rollup(spark, sf):
    e = _pallet_event_counts(spark, sf)
    return e.rollup("chain", "mod_name", "event_name").agg(*_grouped(e, ["chain", "mod_name", "event_name"]))


@query("pallet_event_cube", """
SELECT chain, mod_name, event_name, CAST(grouping(chain) AS INTEGER) AS g_chain,
       CAST(grouping(mod_name) AS INTEGER) AS g_mod_name,
       CAST(grouping(event_name) AS INTEGER) AS g_event_name, count(*) AS n
FROM o_events GROUP BY CUBE (chain, mod_name, event_name)""")
def pallet_event_cube(spark, sf):
    e = _pallet_event_counts(spark, sf)
    return e.cube("chain", "mod_name", "event_name").agg(*_grouped(e, ["chain", "mod_name", "event_name"]))


@query("pallet_event_grouping_sets", """
SELECT chain, mod_name, event_name, CAST(grouping(chain) AS INTEGER) AS g_chain,
       CAST(grouping(mod_name) AS INTEGER) AS g_mod_name,
       CAST(grouping(event_name) AS INTEGER) AS g_event_name, count(*) AS n
FROM o_events GROUP BY GROUPING SETS ((chain, mod_name), (chain, event_name), (chain), ())""")
def pallet_event_grouping_sets(spark, sf):
    e = _pallet_event_counts(spark, sf)
    return e.groupingSets([["chain", "mod_name"], ["chain", "event_name"], ["chain"], []],
                          "chain", "mod_name", "event_name").agg(*_grouped(e, ["chain", "mod_name", "event_name"]))


_INTERVAL_SQL = """(SELECT chain, number, lag(number) OVER w AS prev_number,
           "timestamp" - lag("timestamp") OVER w AS interval_ms
    FROM o_blocks WINDOW w AS (PARTITION BY chain ORDER BY number))"""


@query("block_interval", """
SELECT chain, number, prev_number, interval_ms FROM """ + _INTERVAL_SQL + """ i""")
def block_interval(spark, sf):
    return A.block_intervals(_t(spark, sf, "blocks")).select("chain", "number", "prev_number", "interval_ms")


@query("block_interval_median", """
SELECT chain, quantile_cont(interval_ms, 0.5) AS median_ms FROM """ + _INTERVAL_SQL + """ i
WHERE interval_ms IS NOT NULL GROUP BY chain""")
def block_interval_median(spark, sf):
    iv = A.block_intervals(_t(spark, sf, "blocks"))
    return A.exact_percentile(iv, ["chain"], "interval_ms", 0.5, "median_ms", bucket_size=HOUR_MS)


@query("calls_per_block", """
SELECT chain, block_number, string_agg(call_name, ',' ORDER BY extrinsic_index) AS calls
FROM o_extrinsics GROUP BY chain, block_number""")
def calls_per_block(spark, sf):
    x = _t(spark, sf, "extrinsics")
    g = x.groupBy("chain", "block_number").agg(
        F.array_sort(F.collect_list(F.struct("extrinsic_index", "call_name"))).alias("_c"))
    return g.select("chain", "block_number", F.array_join(F.transform("_c", lambda c: c["call_name"]), ",")
                    .alias("calls"))


@query("top_senders_per_day", """
SELECT chain, day_ms, sender, total, rnk FROM (
  SELECT chain, day_ms, sender, total,
         row_number() OVER (PARTITION BY chain, day_ms ORDER BY total DESC, sender) AS rnk
  FROM (SELECT chain, (block_timestamp // 86400000) * 86400000 AS day_ms, "from" AS sender,
               sum(amount) AS total FROM o_transfers GROUP BY 1, 2, 3))
WHERE rnk <= 3""")
def top_senders_per_day(spark, sf):
    t = _t(spark, sf, "transfers")
    per = t.groupBy("chain", (F.expr(f"block_timestamp div {DAY_MS}") * DAY_MS).alias("day_ms"),
                    F.col("from").alias("sender")).agg(F.sum("amount").alias("total"))
    return A.top_k_per_group(per, ["chain", "day_ms"], [F.col("total").desc(), F.col("sender")], 3,
                             salt_col="sender")


_FLOWS_SQL = """(SELECT chain, account, block_number, sum(delta) AS delta FROM (
      SELECT chain, "from" AS account, block_number, -amount AS delta FROM o_transfers
      UNION ALL SELECT chain, "to", block_number, amount FROM o_transfers) GROUP BY 1, 2, 3)"""


@query("account_running_balance", """
SELECT chain, account, block_number, delta,
       sum(delta) OVER (PARTITION BY chain, account ORDER BY block_number ROWS UNBOUNDED PRECEDING) AS balance
FROM """ + _FLOWS_SQL + """ f""")
def account_running_balance(spark, sf):
    """Net transfer flow per account as a running balance. Pre-aggregated per
    (account, block); the running sum is two-level so a hot account is
    spread over its block buckets."""
    t = _t(spark, sf, "transfers")
    legs = F.explode(F.array(F.struct(F.col("from").alias("account"), (-F.col("amount")).alias("delta")),
                             F.struct(F.col("to").alias("account"), F.col("amount").alias("delta"))))
    flows = (t.select("chain", "block_number", legs.alias("leg"))         # one scan, two legs per transfer
             .groupBy("chain", F.col("leg.account").alias("account"), "block_number")
             .agg(F.sum("leg.delta").alias("delta")))
    return A.running_sum(flows, ["chain", "account"], "block_number", "delta", "balance")


@query("moving_event_count", """
SELECT chain, block_number AS number, n_events,
       sum(n_events) OVER (PARTITION BY chain ORDER BY block_number RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS moving_10
FROM (SELECT chain, block_number, count(*) AS n_events FROM o_events GROUP BY ALL)""")
def moving_event_count(spark, sf):
    per = _t(spark, sf, "events").groupBy("chain", "block_number").agg(_count().alias("n_events"))
    m = A.moving_sum(per, ["chain"], "block_number", "n_events", 10, "moving_10")
    return m.select("chain", F.col("block_number").alias("number"), "n_events", "moving_10")


@query("top_transfers", """
SELECT chain, id, amount, "from", "to" FROM o_transfers ORDER BY amount DESC, chain, id LIMIT 10""")
def top_transfers(spark, sf):
    return (_t(spark, sf, "transfers").select("chain", "id", "amount", "from", "to")
            .orderBy(F.col("amount").desc(), "chain", "id").limit(10))


@query("accounts_both", """
SELECT chain, "from" AS account FROM o_transfers INTERSECT SELECT chain, "to" FROM o_transfers""")
def accounts_both(spark, sf):
    t = _t(spark, sf, "transfers")
    return t.select("chain", F.col("from").alias("account")).intersect(t.select("chain", F.col("to").alias("account")))


@query("accounts_only_send", """
SELECT chain, "from" AS account FROM o_transfers EXCEPT SELECT chain, "to" FROM o_transfers""")
def accounts_only_send(spark, sf):
    t = _t(spark, sf, "transfers")
    return t.select("chain", F.col("from").alias("account")).subtract(t.select("chain", F.col("to").alias("account")))


@query("accounts_all", """
SELECT chain, "from" AS account FROM o_transfers UNION SELECT chain, "to" FROM o_transfers""")
def accounts_all(spark, sf):
    t = _t(spark, sf, "transfers")
    return t.select("chain", F.col("from").alias("account")).union(
        t.select("chain", F.col("to").alias("account"))).distinct()


@query("blocks_above_avg", """
, per AS (SELECT chain, block_number, count(*) AS n_extrinsics FROM o_extrinsics GROUP BY ALL)
SELECT chain, block_number AS number, n_extrinsics FROM per
WHERE n_extrinsics > (SELECT avg(n_extrinsics) FROM per)""")
def blocks_above_avg(spark, sf):
    """Blocks with more extrinsics than the average block (scalar subquery)."""
    per = _t(spark, sf, "extrinsics").groupBy("chain", "block_number").agg(_count().alias("n_extrinsics"))
    avg = per.select(F.avg("n_extrinsics")).scalar()
    return per.where(F.col("n_extrinsics") > avg).select("chain", F.col("block_number").alias("number"),
                                                         "n_extrinsics")


@query("blocks_exists_subquery", """
SELECT chain, number FROM o_blocks b WHERE EXISTS (
  SELECT 1 FROM o_extrinsics x WHERE x.chain = b.chain AND x.block_number = b.number AND x.extrinsic_index = 5)""")
def blocks_exists_subquery(spark, sf):
    """Correlated EXISTS subquery through Spark SQL (decorrelated to a semi join)."""
    s = spark.newSession()
    lake_for(spark, sf).register(None, s)
    return s.sql("""SELECT chain, number FROM blocks b WHERE EXISTS (SELECT 1 FROM extrinsics x
        WHERE x.chain = b.chain AND x.block_number = b.number AND x.extrinsic_index = 5)""")


@query("ancestor_walk", """
SELECT * FROM (
  WITH RECURSIVE walk(chain, start, depth, ancestor, parent_hash) AS (
    SELECT chain, number, 0, number, parent_hash FROM o_blocks
    UNION ALL
    SELECT w.chain, w.start, w.depth + 1, p.number, p.parent_hash
    FROM walk w JOIN o_blocks p ON p.chain = w.chain AND p.hash = w.parent_hash WHERE w.depth < 3)
  SELECT chain, start, max(depth) AS depth, arg_max(ancestor, depth) AS farthest FROM walk GROUP BY chain, start)""")
def ancestor_walk(spark, sf):
    """Walk parent links up to 3 steps from every block (D-16): the depth is
    known, so the recursion is three equi-joins."""
    return A.ancestors(_t(spark, sf, "blocks"), 3)


@query("json_amounts", """
SELECT chain, event_name, sum(CAST(coalesce(json_extract_string("values", '$.amount'),
                                     json_extract_string("values", '$.actual_fee')) AS DECIMAL(38,0))) AS total,
       count(*) AS n
FROM o_events WHERE mod_name IN ('Balances', 'TransactionPayment') GROUP BY chain, event_name""")
def json_amounts(spark, sf):
    """D-17: fields of the JSON values, read from the VARIANT written at ingest."""
    e = lake_for(spark, sf).table("events", parsed=True).where(F.col("mod_name").isin("Balances", "TransactionPayment"))
    amt = F.coalesce(*X.json_values(True, "amount", "actual_fee")).try_cast("decimal(38,0)")
    return e.groupBy("chain", "event_name").agg(F.sum(amt).alias("total"), _count().alias("n"))


@query("hash_prefix_hist", """
SELECT chain, substring(hash, 3, 2) AS prefix, count(*) AS n FROM o_blocks GROUP BY ALL""")
def hash_prefix_hist(spark, sf):
    b = _t(spark, sf, "blocks")
    return b.groupBy("chain", F.substring("hash", 3, 2).alias("prefix")).agg(_count().alias("n"))


@query("daily_volume", """
SELECT chain, strftime(make_timestamp(block_timestamp * 1000), '%Y-%m-%d') AS day, count(*) AS n_transfers,
       sum(amount) AS volume FROM o_transfers GROUP BY ALL""")
def daily_volume(spark, sf):
    t = _t(spark, sf, "transfers")
    return t.groupBy("chain", F.date_format(F.timestamp_millis("block_timestamp"), "yyyy-MM-dd").alias("day")).agg(
        _count().alias("n_transfers"), F.sum("amount").alias("volume"))


@query("fee_buckets", """
SELECT chain, CASE WHEN fee < 1000 THEN 'small' WHEN fee < 5000 THEN 'medium' ELSE 'large' END AS bucket,
       count(*) AS n, sum(fee) AS total
FROM (SELECT chain, CAST(json_extract_string("values", '$.actual_fee') AS DECIMAL(38,0)) AS fee
      FROM o_events WHERE event_name = 'TransactionFeePaid') GROUP BY 1, 2""")
def fee_buckets(spark, sf):
    fee = X.json_values(True, "actual_fee")[0].try_cast("decimal(38,0)")
    e = lake_for(spark, sf).table("events", parsed=True).where(F.col("event_name") == "TransactionFeePaid").select("chain", fee.alias("fee"))
    bucket = F.when(F.col("fee") < 1000, "small").when(F.col("fee") < 5000, "medium").otherwise("large")
    return e.groupBy("chain", bucket.alias("bucket")).agg(_count().alias("n"), F.sum("fee").alias("total"))


@query("blocks_with_pallets", """
SELECT chain, block_number AS number FROM o_events GROUP BY chain, block_number
HAVING bool_or(mod_name = 'Balances') AND bool_or(mod_name = 'Utility')""")
def blocks_with_pallets(spark, sf):
    g = _t(spark, sf, "events").groupBy("chain", "block_number").agg(F.collect_set("mod_name").alias("p"))
    return g.where(F.array_contains("p", "Balances") & F.array_contains("p", "Utility")).select(
        "chain", F.col("block_number").alias("number"))


# The inline label table of the VALUES proof query.
EVENT_LABELS = [("Transfer", "value"), ("Withdraw", "value"), ("TransactionFeePaid", "fee"),
                ("ExtrinsicSuccess", "status"), ("ExtrinsicFailed", "status")]


@query("labelled_events", """
SELECT e.chain, l.label, count(*) AS n FROM o_events e
JOIN (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in EVENT_LABELS) + """) l(event_name, label)
  ON l.event_name = e.event_name GROUP BY e.chain, l.label""")
def labelled_events(spark, sf):
    labels = spark.createDataFrame(EVENT_LABELS, "event_name string, label string")
    e = _t(spark, sf, "events")
    return e.join(F.broadcast(labels), "event_name").groupBy("chain", "label").agg(_count().alias("n"))


# --- block-time windows in batch (T-07) ----------------------------------------------
def _ev_time(spark, sf):
    return _t(spark, sf, "events").withColumn("t", F.timestamp_millis("block_timestamp"))


@query("window_tumbling", """
SELECT chain, (block_timestamp // 3600000) * 3600000 AS window_start_ms, count(*) AS n_events
FROM o_events GROUP BY ALL""")
def window_tumbling(spark, sf):
    g = _ev_time(spark, sf).groupBy("chain", F.window("t", "1 hour").alias("w")).agg(_count().alias("n_events"))
    return g.select("chain", F.unix_millis(F.col("w.start")).alias("window_start_ms"), "n_events")


@query("window_sliding", """
SELECT chain, s AS window_start_ms, count(*) AS n_events FROM (
  SELECT chain, (block_timestamp // 1800000) * 1800000 AS s FROM o_events
  UNION ALL SELECT chain, (block_timestamp // 1800000) * 1800000 - 1800000 FROM o_events)
GROUP BY 1, 2""")
def window_sliding(spark, sf):
    g = _ev_time(spark, sf).groupBy("chain", F.window("t", "1 hour", "30 minutes").alias("w")).agg(
        _count().alias("n_events"))
    return g.select("chain", F.unix_millis(F.col("w.start")).alias("window_start_ms"), "n_events")


_SESSION_SQL = """
, tx AS (SELECT chain, "from" AS sender, block_timestamp AS t, id FROM o_transfers),
  marked AS (SELECT chain, sender, t, id, CASE WHEN t - lag(t) OVER (PARTITION BY chain, sender ORDER BY t, id) <= 86400000
                                       THEN 0 ELSE 1 END AS brk FROM tx),
  grouped AS (SELECT chain, sender, t, sum(brk) OVER (PARTITION BY chain, sender ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS sid
              FROM marked)
SELECT chain, sender, min(t) AS session_start_ms, max(t) + 86400000 AS session_end_ms, count(*) AS n
FROM grouped GROUP BY chain, sender, sid"""


def _sessions(spark, sf, bucket_ms):
    t = _t(spark, sf, "transfers").select("chain", F.col("from").alias("sender"), "id",
                                         F.col("block_timestamp").alias("t"))
    s = A.sessionize(t, ["chain", "sender"], "t", DAY_MS, bucket_ms, tiebreak=("id",))
    return s.groupBy("chain", "sender", "session_id").agg(
        F.min("t").alias("session_start_ms"), (F.max("t") + DAY_MS).alias("session_end_ms"),
        _count().alias("n")).drop("session_id")


@query("window_session", _SESSION_SQL)
def window_session(spark, sf):
    """Per-sender activity sessions (gap 1 day) over transfer time, with the
    bucketed sessionizer (a hot sender is spread over weekly buckets)."""
    return _sessions(spark, sf, 7 * DAY_MS)


@query("window_session_builtin", _SESSION_SQL)
def window_session_builtin(spark, sf):
    """What Spark's ``session_window`` gives (a test compares them), without
    its one task per sender; buckets of six hours, so sessions cross edges."""
    return _sessions(spark, sf, DAY_MS // 4)


@query("transfers_page", """
SELECT chain, id, amount FROM o_transfers ORDER BY amount DESC, chain, id LIMIT 10 OFFSET 10""")
def transfers_page(spark, sf):
    """Second page of the largest transfers (ORDER BY + LIMIT + OFFSET)."""
    return (_t(spark, sf, "transfers").select("chain", "id", "amount")
            .orderBy(F.col("amount").desc(), "chain", "id").offset(10).limit(10))


@query("string_functions", """
SELECT chain, split_part(id, '-', 2) AS position, count(*) AS n,
       count(*) FILTER (WHERE event_name LIKE 'Extrinsic%') AS n_extrinsic_events,
       count(*) FILTER (WHERE regexp_matches(mod_name, '^[A-Z][a-z]+$')) AS n_simple_pallet,
       max(length(extrinsic_hash)) AS hash_len
FROM o_events GROUP BY 1, 2""")
def string_functions(spark, sf):
    e = _t(spark, sf, "events")
    return e.groupBy("chain", F.split_part("id", F.lit("-"), F.lit(2)).alias("position")).agg(
        _count().alias("n"),
        F.count_if(F.col("event_name").like("Extrinsic%")).alias("n_extrinsic_events"),
        F.count_if(F.col("mod_name").rlike("^[A-Z][a-z]+$")).alias("n_simple_pallet"),
        F.max(F.length("extrinsic_hash")).alias("hash_len"))


@query("date_functions", """
SELECT chain, hour(make_timestamp("timestamp" * 1000)) AS hour_of_day,
       CAST(dayofweek(make_timestamp("timestamp" * 1000)) AS INTEGER) AS dow,
       count(*) AS n_blocks,
       min(strftime(date_trunc('week', make_timestamp("timestamp" * 1000)), '%Y-%m-%d')) AS first_week
FROM o_blocks GROUP BY 1, 2, 3""")
def date_functions(spark, sf):
    """extract / date_trunc over block time (UTC)."""
    t = F.timestamp_millis("timestamp")
    return _t(spark, sf, "blocks").groupBy(
        "chain", F.hour(t).alias("hour_of_day"), (F.dayofweek(t) - 1).alias("dow")).agg(
        _count().alias("n_blocks"),
        F.min(F.date_format(F.date_trunc("week", t), "yyyy-MM-dd")).alias("first_week"))
