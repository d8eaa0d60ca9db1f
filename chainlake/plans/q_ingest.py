"""Registered queries: sources, envelope handling and extraction
(SURVEY §2.1, §2.2, §2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec as C
from ..lake import FIXTURE_CHAINS, envelope_files, lake_for
from ..operators import extract as X
from ..sources import envelope as V
from ..sources import fixture
from .registry import query


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def _nested(spark, sf):
    return fixture.nested_blocks(_events(spark, sf), FIXTURE_CHAINS)


def _envelopes(spark, sf):
    return V.read_envelopes(spark, envelope_files(spark, sf))


# --- extraction straight from nested blocks (X-01 … X-09) -------------------
@query("extract_blocks", """
SELECT chain, number, "timestamp", hash, parent_hash, extrinsics_root, state_root, is_finalized,
       validator, spec_version, hash AS hash_bytes_hex, validator AS validator_bytes_hex
FROM o_blocks""")
def extract_blocks(spark, sf):
    b = X.extract_headers(_nested(spark, sf))
    return b.select("chain", "number", "timestamp", "hash", "parent_hash", "extrinsics_root", "state_root",
                    "is_finalized", "validator", "spec_version",
                    C.hex0x("hash_bytes").alias("hash_bytes_hex"),
                    C.hex0x("validator_bytes").alias("validator_bytes_hex"))


@query("blocks_without_validator", """
SELECT chain, number, validator, true AS validator_bytes_null FROM o_blocks WHERE validator IS NULL""")
def blocks_without_validator(spark, sf):
    b = X.extract_headers(_nested(spark, sf))
    return b.where(F.col("validator").isNull()).select(
        "chain", "number", "validator", F.col("validator_bytes").isNull().alias("validator_bytes_null"))


@query("blocks_per_spec_version", """
SELECT chain, spec_version, count(*) AS n_blocks, min(number) AS first_block, max(number) AS last_block
FROM o_blocks GROUP BY chain, spec_version""")
def blocks_per_spec_version(spark, sf):
    b = lake_for(spark, sf).table("blocks")
    return b.groupBy("chain", "spec_version").agg(F.count(F.lit(1)).alias("n_blocks"),
                                         F.min("number").alias("first_block"),
                                         F.max("number").alias("last_block"))


@query("extract_block_logs", """
SELECT chain, id, block_number, type, data, engine, log_index FROM o_logs""")
def extract_block_logs(spark, sf):
    return X.extract_logs(_nested(spark, sf)).select("chain", "id", "block_number", "type", "data",
                                                     "engine", "log_index")


@query("log_engines", """
SELECT chain, type, engine, count(*) AS n FROM o_logs GROUP BY ALL""")
def log_engines(spark, sf):
    return lake_for(spark, sf).table("block_logs").groupBy("chain", "type", "engine").agg(
        F.count(F.lit(1)).alias("n"))


@query("extract_extrinsics", """
SELECT chain, id, block_number, extrinsic_hash, is_signed, mod_name, call_name, result, call_params,
       block_timestamp, extrinsic_index, signer, extrinsic_hash AS extrinsic_hash_bytes_hex
FROM o_extrinsics""")
def extract_extrinsics(spark, sf):
    x = X.extract_extrinsics(_nested(spark, sf), "extrinsic")
    return x.select("chain", "id", "block_number", "extrinsic_hash", "is_signed", "mod_name", "call_name",
                    "result", "call_params", "block_timestamp", "extrinsic_index", "signer",
                    C.hex0x("extrinsic_hash_bytes").alias("extrinsic_hash_bytes_hex"))


@query("extract_events", """
SELECT chain, id, block_number, extrinsic_id, mod_name, event_name, phase, "values", block_timestamp,
       extrinsic_hash, event_index, extrinsic_index, extrinsic_success
FROM o_events""")
def extract_events(spark, sf):
    e = X.extract_events(_nested(spark, sf))
    return e.select("chain", "id", "block_number", "extrinsic_id", "mod_name", "event_name", "phase",
                    "values", "block_timestamp", "extrinsic_hash", "event_index",
                    "extrinsic_index", "extrinsic_success")


@query("signed_ratio", """
SELECT chain, mod_name, count(*) AS n_extrinsics, count(*) FILTER (WHERE is_signed) AS n_signed
FROM o_extrinsics GROUP BY chain, mod_name""")
def signed_ratio(spark, sf):
    x = lake_for(spark, sf).table("extrinsics")
    return x.groupBy("chain", "mod_name").agg(F.count(F.lit(1)).alias("n_extrinsics"),
                                     F.count_if("is_signed").alias("n_signed"))


@query("extrinsics_with_events", """
SELECT x.chain, x.id FROM o_extrinsics x
WHERE EXISTS (SELECT 1 FROM o_events e WHERE e.chain = x.chain AND e.block_number = x.block_number
              AND e.extrinsic_index = x.extrinsic_index)""")
def extrinsics_with_events(spark, sf):
    lake = lake_for(spark, sf)
    return X.with_events_only(lake.table("extrinsics"), lake.table("events")).select("chain", "id")


@query("extrinsics_without_events", """
SELECT x.chain, x.id, x.block_number, x.extrinsic_index FROM o_extrinsics x
WHERE NOT EXISTS (SELECT 1 FROM o_events e WHERE e.chain = x.chain AND e.block_number = x.block_number
                  AND e.extrinsic_index = x.extrinsic_index)""")
def extrinsics_without_events(spark, sf):
    lake = lake_for(spark, sf)
    return X.without_events(lake.table("extrinsics"), lake.table("events")).select(
        "chain", "id", "block_number", "extrinsic_index")


# --- legacy raw events (X-11, L-01, S-06, S-08) -------------------------------
@query("extract_raw_events", """
SELECT block_number, block_hash, block_time, extrinsic_hash, data, "index", topic0, topic1, topic2,
       topic3, topic4, phase, pallet_name, pallet_index, event_name FROM o_raw""")
def extract_raw_events(spark, sf):
    return X.extract_raw_events(fixture.raw_event_rows(_events(spark, sf)))


@query("five_topics", """
SELECT least(n_topics, 5) AS topics_kept, n_topics AS topics_in, count(*) AS n
FROM o_raw GROUP BY 1, 2""")
def five_topics(spark, sf):
    raw = lake_for(spark, sf).table("raw_event")
    r = raw.select(F.size("topics").alias("topics_in"), *C.five_topics(F.col("topics")))
    kept = sum((F.col(f"topic{i}") != "").cast("int") for i in range(5))
    return r.groupBy(kept.alias("topics_kept"), "topics_in").agg(F.count(F.lit(1)).alias("n"))


@query("phase_text", """
SELECT phase, count(*) AS n FROM o_raw GROUP BY phase""")
def phase_text(spark, sf):
    raw = lake_for(spark, sf).table("raw_event")
    return raw.groupBy(C.phase_text("phase_kind", "phase_index").alias("phase")).agg(
        F.count(F.lit(1)).alias("n"))


@query("phase_codes", """
SELECT CASE phase WHEN 0 THEN 'ApplyExtrinsic' WHEN 1 THEN 'Finalization' ELSE 'Initialization' END AS phase_kind,
       phase, count(*) AS n FROM o_events WHERE chain = 'polkadot' GROUP BY phase""")
def phase_codes(spark, sf):
    raw = lake_for(spark, sf).table("raw_event")
    return raw.groupBy("phase_kind", C.phase_code("phase_kind").alias("phase")).agg(
        F.count(F.lit(1)).alias("n"))


# --- scalar codecs over the data (S-01, S-02, S-09, S-07) ---------------------
@query("hash_text", """
SELECT chain, number, hash, hash AS hash_roundtrip, length(hash) AS hash_len FROM o_blocks""")
def hash_text(spark, sf):
    b = lake_for(spark, sf).table("blocks")
    return b.select("chain", "number", "hash", C.hex0x(C.unhex0x("hash")).alias("hash_roundtrip"),
                    F.length("hash").alias("hash_len"))


@query("bytes_roundtrip", """
SELECT chain, number, hash AS hash_from_ints, 32 AS n_ints, true AS ints_in_range FROM o_blocks""")
def bytes_roundtrip(spark, sf):
    b = lake_for(spark, sf).table("blocks")
    ints = C.ints_from_bytes("hash_bytes")
    return b.select("chain", "number", C.hex0x(C.bytes_from_ints(ints)).alias("hash_from_ints"),
                    F.size(ints).alias("n_ints"),
                    F.forall(ints, lambda v: (v >= 0) & (v <= 255)).alias("ints_in_range"))


@query("wrap_cast", """
SELECT chain, number,
  CAST(CASE WHEN CAST("timestamp" AS HUGEINT) * 10000000 > 9223372036854775807
            THEN CAST("timestamp" AS HUGEINT) * 10000000 - 18446744073709551616
            ELSE CAST("timestamp" AS HUGEINT) * 10000000 END AS BIGINT) AS wrapped,
  CAST(spec_version AS INTEGER) AS spec_i32
FROM o_blocks""")
def wrap_cast(spark, sf):
    """u64 values from the data (block ms x 10^7 exceeds i64) narrowed like ``as i64``."""
    b = lake_for(spark, sf).table("blocks")
    u64 = (F.col("timestamp").cast("decimal(20,0)") * F.lit(10_000_000)).cast("decimal(20,0)")
    return b.select("chain", "number", C.wrap_i64(u64).alias("wrapped"),
                    C.wrap_i32("spec_version").alias("spec_i32"))


@query("json_or_null", """
SELECT chain, event_name, count(*) FILTER (WHERE "values" IS NULL) AS n_null,
       count(*) FILTER (WHERE "values" IS NOT NULL) AS n_json
FROM o_events GROUP BY chain, event_name""")
def json_or_null(spark, sf):
    e = lake_for(spark, sf).table("events")
    checked = C.json_or_null("values")
    return e.groupBy("chain", "event_name").agg(F.count_if(checked.isNull()).alias("n_null"),
                                       F.count_if(checked.isNotNull()).alias("n_json"))


# --- envelopes (IO-02 … IO-04, X-15) -------------------------------------------
@query("envelope_ingest", """
, lines AS (
  SELECT CASE chain WHEN 'polkadot' THEN 'Polkadot' ELSE 'Kusama' END AS chain, 'Polkadot' AS chain_kind,
         false AS corrupt, 1 AS n_blocks FROM o_blocks
  UNION ALL SELECT 'Polkadot', 'Polkadot', false, 1 FROM o_bad_blocks
  UNION ALL SELECT NULL, NULL, true, NULL FROM o_bad_envelopes WHERE kind = 0
  UNION ALL SELECT 'Polkadot', 'Polkadot', false, NULL FROM o_bad_envelopes WHERE kind = 1
  UNION ALL SELECT 'Polkadot', 'Ethereum', false, 0 FROM o_bad_envelopes WHERE kind = 2
  UNION ALL SELECT NULL, 'Polkadot', false, 0 FROM o_bad_envelopes WHERE kind = 3
  UNION ALL SELECT 'Nowhere/../x', 'Polkadot', false, 0 FROM o_bad_envelopes WHERE kind = 4
  UNION ALL SELECT 'Kusama', NULL, false, 0 FROM o_bad_envelopes WHERE kind = 5)
SELECT chain, chain_kind, corrupt, count(*) AS n_envelopes, CAST(sum(n_blocks) AS BIGINT) AS n_blocks
FROM lines GROUP BY ALL""")
def envelope_ingest(spark, sf):
    return _envelopes(spark, sf).groupBy("chain", "chain_kind", F.col(V.CORRUPT).isNotNull().alias("corrupt")).agg(
        F.count(F.lit(1)).alias("n_envelopes"), F.sum(F.size("polkadot_blocks")).cast("bigint")
        .alias("n_blocks"))


@query("envelope_rejects", """
SELECT CASE kind WHEN 0 THEN 'unparseable' WHEN 1 THEN 'polkadot_without_blocks' WHEN 2 THEN 'unimplemented_chain_kind'
       WHEN 3 THEN 'missing_chain' WHEN 4 THEN 'unknown_chain' ELSE 'missing_chain_kind' END AS reason, count(*) AS n
FROM o_bad_envelopes GROUP BY 1""")
def envelope_rejects(spark, sf):
    _, rejected = V.split_valid(_envelopes(spark, sf), FIXTURE_CHAINS)
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("envelope_blocks", """
SELECT b.chain, b.number AS block_number, x.n_extrinsics, e.n_events
FROM o_blocks b
JOIN (SELECT chain, block_number, count(*) AS n_extrinsics FROM o_extrinsics GROUP BY ALL) x
  ON x.chain = b.chain AND x.block_number = b.number
JOIN (SELECT chain, block_number, count(*) AS n_events FROM o_events GROUP BY ALL) e
  ON e.chain = b.chain AND e.block_number = b.number""")
def envelope_blocks(spark, sf):
    env, _ = V.split_valid(_envelopes(spark, sf), FIXTURE_CHAINS)
    good, _ = V.quarantine(V.blocks_of(env))
    return good.select("chain", "block_number", F.size("body.extrinsics").cast("bigint")
                       .alias("n_extrinsics"), F.size("body.events").cast("bigint").alias("n_events"))


@query("bad_blocks", """
SELECT 'polkadot' AS chain, CASE kind WHEN 0 THEN 'missing_block_number' WHEN 1 THEN 'bad_block_hash'
       ELSE 'bad_parent_hash' END AS problem, count(*) AS n FROM o_bad_blocks GROUP BY ALL""")
def bad_blocks(spark, sf):
    env, _ = V.split_valid(_envelopes(spark, sf), FIXTURE_CHAINS)
    _, bad = V.quarantine(V.blocks_of(env))
    return bad.groupBy("chain", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("envelope_roundtrip", """
SELECT b.chain, number, hash, parent_hash, validator, spec_version, "timestamp",
       coalesce(string_agg(l.engine, ',' ORDER BY l.log_index), '') AS engines
FROM o_blocks b LEFT JOIN o_logs l ON l.chain = b.chain AND l.block_number = b.number GROUP BY ALL""")
def envelope_roundtrip(spark, sf):
    """Wire JSON -> blocks -> header and log extraction equals the direct derivation."""
    env, _ = V.split_valid(_envelopes(spark, sf), FIXTURE_CHAINS)
    good, _ = V.quarantine(V.blocks_of(env))
    logs = X.extract_logs(good).groupBy("chain", F.col("block_number").alias("number")).agg(
        F.array_sort(F.collect_list(F.struct("log_index", "engine"))).alias("l"))
    engines = F.array_join(F.transform("l", lambda x: x["engine"]), ",")     # NULL engines are left out
    return X.extract_headers(good).join(logs, ["chain", "number"], "left").select(
        "chain", "number", "hash", "parent_hash", "validator", "spec_version", "timestamp",
        F.coalesce(engines, F.lit("")).alias("engines"))


# --- stored table scan (IO-05) ----------------------------------------------------
@query("scan_blocks", """
SELECT chain, number // 100000 AS block_bucket, count(*) AS n_blocks, min(number) AS min_number,
       max(number) AS max_number FROM o_blocks GROUP BY ALL""")
def scan_blocks(spark, sf):
    b = lake_for(spark, sf).table("blocks")
    return b.groupBy("chain", "block_bucket").agg(F.count(F.lit(1)).alias("n_blocks"),
                                                  F.min("number").alias("min_number"),
                                                  F.max("number").alias("max_number"))
