"""Flatten nested blocks into the stored tables.

All extraction is narrow: ``posexplode`` over arrays that live inside one
block row, plus column expressions. No shuffle, no Python. Success flags
are computed from the block's own events with higher-order functions, so
even the "success" column needs no join (decision D1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import (amount38, five_topics, hex0x, item_id, json_or_null, phase_text,
                               wrap_i16, wrap_i32)

BUCKET_SIZE = 100_000  # block_bucket = block_number div BUCKET_SIZE (SURVEY §4.3)

SUCCESS_SCOPES = ("extrinsic", "block_running")


def block_bucket(col: str | Column = "block_number") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / BUCKET_SIZE).cast("bigint")


def _bn(blocks: DataFrame) -> Column:
    # Prefer the top-level key: it keeps the shuffle partitioning of the
    # block build visible to the planner.
    return F.col("block_number") if "block_number" in blocks.columns else F.col("header.block_number")


def _chain(blocks: DataFrame) -> Column:
    return F.col("chain") if "chain" in blocks.columns else F.lit("polkadot")


def _src(blocks: DataFrame) -> list[Column]:
    """The block's position in its source, carried along where it is known."""
    return [F.col("_src")] if "_src" in blocks.columns else []


# X-01 … X-05 --------------------------------------------------------------
def extract_headers(blocks: DataFrame) -> DataFrame:
    """``blocks`` table rows: hex text and raw bytes of every hash."""
    h = F.col("header")
    bn = _bn(blocks)
    return blocks.select(
        _chain(blocks).alias("chain"),
        bn.alias("number"),
        F.coalesce(h["block_timestamp"], F.lit(0)).cast("bigint").alias("timestamp"),   # X-02
        hex0x(h["block_hash"]).alias("hash"),
        hex0x(h["parent_hash"]).alias("parent_hash"),
        hex0x(h["extrinsics_root"]).alias("extrinsics_root"),
        hex0x(h["state_root"]).alias("state_root"),
        h["is_finished"].alias("is_finalized"),                                         # X-05
        hex0x(h["validator"]).alias("validator"),                                       # X-03
        wrap_i32(h["spec_version"]).alias("spec_version"),                              # X-04
        h["block_hash"].alias("hash_bytes"),
        h["parent_hash"].alias("parent_hash_bytes"),
        h["extrinsics_root"].alias("extrinsics_root_bytes"),
        h["state_root"].alias("state_root_bytes"),
        h["validator"].alias("validator_bytes"),
        block_bucket(bn).alias("block_bucket"),
        *_src(blocks),
    )


def _items(blocks: DataFrame, cols: list[Column], items: str, pos: str, out: str) -> DataFrame:
    """``cols`` and one row per item of the array ``items``, with its position.
    An inner ``posexplode`` lets Spark filter empty arrays first, which derives
    the array twice more where it is not stored; the outer form does not, and the
    rows it adds for empty arrays have no position."""
    return blocks.select(*cols, F.posexplode_outer(F.col(items)).alias(pos, out)).where(F.col(pos).isNotNull())


# X-06 / N-02 ---------------------------------------------------------------
def extract_logs(blocks: DataFrame) -> DataFrame:
    """Digest items, indexed by position; an empty list gives no rows."""
    bn = _bn(blocks)
    return (_items(blocks, [_chain(blocks).alias("chain"), bn.alias("block_number"), *_src(blocks)], "logs", "pos", "log")
            .select(
                "chain",
                item_id(F.col("block_number"), F.col("pos")).alias("id"),
                "block_number",
                F.col("log.type").alias("type"),
                hex0x(F.col("log.data")).alias("data"),
                F.col("log.engine").alias("engine"),
                F.col("pos").alias("log_index"),
                block_bucket("block_number").alias("block_bucket"), *_src(blocks)))


# X-07 / X-09 / A-01 / N-01 ---------------------------------------------------
def ok_indexes(events: Column) -> Column:
    """Extrinsic indexes of the block that emitted System.ExtrinsicSuccess:
    one pass over the block's events, shared by all its rows."""
    return F.filter(F.transform(events, lambda e: F.when(
        (e["mod_name"] == "System") & (e["event_name"] == "ExtrinsicSuccess"),
        e["extrinsic_index"].cast("bigint"))), lambda i: i.isNotNull())


def _success(ok_idx: Column, idx: Column, scope: str) -> Column:
    """``extrinsic``: its own events hold a success (A-01). ``block_running``:
    any of extrinsics 0..i does (N-01). Both are codegen'd array lookups."""
    if scope not in SUCCESS_SCOPES:
        raise ValueError(f"success_scope must be one of {SUCCESS_SCOPES}")
    if scope == "extrinsic":
        return F.array_contains(ok_idx, idx.cast("bigint"))
    return F.coalesce(F.array_min(ok_idx) <= idx.cast("bigint"), F.lit(False))


def extract_extrinsics(blocks: DataFrame, success_scope: str = "extrinsic", parsed: bool = False) -> DataFrame:
    """``extrinsics`` rows (``parsed``: also ``call_params_v``, the JSON as VARIANT). ``result`` is recomputed from the block's events:
    ``extrinsic`` = a System.ExtrinsicSuccess among its own events (A-01);
    ``block_running`` = among the events of extrinsics 0..i of the block, as
    the reference's never-reset flag produces (N-01)."""
    bn = _bn(blocks)
    x = F.col("x")
    return (_items(blocks, [_chain(blocks).alias("chain"), bn.alias("block_number"), *_src(blocks),
                            ok_indexes(F.col("body.events")).alias("_ok")], "body.extrinsics", "extrinsic_index", "x")
            .select(
                "chain",
                item_id(F.col("block_number"), F.col("extrinsic_index")).alias("id"),
                "block_number",
                hex0x(x["extrinsic_hash"]).alias("extrinsic_hash"),
                x["signature"].isNotNull().alias("is_signed"),                     # X-09
                x["mod_name"].alias("mod_name"),
                x["call_name"].alias("call_name"),
                _success(F.col("_ok"), F.col("extrinsic_index"), success_scope).alias("result"),
                json_or_null(x["call_params"]).alias("call_params"),
                *([F.try_parse_json(x["call_params"]).alias("call_params_v")] if parsed else []),
                x["extrinsic_hash"].alias("extrinsic_hash_bytes"),
                x["block_timestamp"].cast("bigint").alias("block_timestamp"),
                F.col("extrinsic_index").cast("bigint").alias("extrinsic_index"),
                hex0x(x["signature"]).alias("signer"),
                block_bucket("block_number").alias("block_bucket"), *_src(blocks)))


# X-08 ---------------------------------------------------------------------
def extract_events(blocks: DataFrame, parsed: bool = False) -> DataFrame:
    """``events`` rows (``parsed``: also ``values_v``, the JSON as VARIANT). ``extrinsic_success`` is denormalised here, where the
    whole block is at hand, so transfer/withdraw tables need no join. An event
    outside extrinsics (phase 1 or 2) has no extrinsic id and no success."""
    bn = _bn(blocks)
    e = F.col("e")
    return (_items(blocks, [_chain(blocks).alias("chain"), bn.alias("block_number"), *_src(blocks),
                            ok_indexes(F.col("body.events")).alias("_ok")], "body.events", "_at", "e")
            .select(
                "chain",
                item_id(F.col("block_number"), e["event_index"]).alias("id"),
                "block_number",
                item_id(F.col("block_number"), e["extrinsic_index"]).alias("extrinsic_id"),
                e["mod_name"].alias("mod_name"),
                e["event_name"].alias("event_name"),
                wrap_i16(e["phase"]).alias("phase"),                               # S-09
                json_or_null(e["values"]).alias("values"),
                *([F.try_parse_json(e["values"]).alias("values_v")] if parsed else []),
                e["block_timestamp"].cast("bigint").alias("block_timestamp"),
                hex0x(e["extrinsic_hash"]).alias("extrinsic_hash"),
                e["event_index"].cast("bigint").alias("event_index"),
                e["extrinsic_index"].cast("bigint").alias("extrinsic_index"),
                F.coalesce(_success(F.col("_ok"), e["extrinsic_index"], "extrinsic"),
                           F.lit(False)).alias("extrinsic_success"),
                block_bucket("block_number").alias("block_bucket"), *_src(blocks)))


# X-10 ---------------------------------------------------------------------
def with_events_only(extrinsics: DataFrame, events: DataFrame) -> DataFrame:
    """Legacy rule: drop extrinsics without events (semi join on the key)."""
    keys = events.where("extrinsic_index is not null").select("chain", "block_number", "extrinsic_index").distinct()
    return extrinsics.join(keys, ["chain", "block_number", "extrinsic_index"], "left_semi")


def without_events(extrinsics: DataFrame, events: DataFrame) -> DataFrame:
    keys = events.where("extrinsic_index is not null").select("chain", "block_number", "extrinsic_index").distinct()
    return extrinsics.join(keys, ["chain", "block_number", "extrinsic_index"], "left_anti")


# X-11 / L-01 / S-08 -----------------------------------------------------------
def extract_raw_events(raw: DataFrame) -> DataFrame:
    """Legacy ``raw_event`` rows: hex data, first five topics, phase text;
    ``block_time`` is hard-coded 0 like the reference."""
    return raw.select(
        "block_number", "block_hash",
        F.lit(0).cast("bigint").alias("block_time"),
        "extrinsic_hash",
        hex0x(F.col("data")).alias("data"),
        "index",
        *five_topics(F.col("topics")),
        phase_text(F.col("phase_kind"), F.col("phase_index")).alias("phase"),
        "pallet_name", "pallet_index", "event_name")


# X-12 / X-13 ----------------------------------------------------------------
def success_by_extrinsic(events: DataFrame) -> DataFrame:
    """A-01 over the flat table: ``bool_or`` per (chain, block, extrinsic)."""
    return (events.where("extrinsic_index is not null").groupBy("chain", "block_number", "extrinsic_index")
            .agg(F.bool_or((F.col("mod_name") == "System") &
                           (F.col("event_name") == "ExtrinsicSuccess")).alias("success")))


def _with_success(sel: DataFrame, events: DataFrame) -> DataFrame:
    if "extrinsic_success" in sel.columns:
        return sel.withColumn("success", F.col("extrinsic_success"))
    ok = success_by_extrinsic(events)
    return (sel.join(ok, ["chain", "block_number", "extrinsic_index"], "left")
            .withColumn("success", F.coalesce(F.col("success"), F.lit(False))))


def _moved(event: dict[str, Column]) -> dict[str, Column]:
    """The columns of a balance table: where the event stands, its own values
    ``event``, and whether its extrinsic succeeded."""
    place = ("chain", "block_number", "index", "id", "extrinsic_id", "extrinsic_index", "extrinsic_hash", "block_timestamp")
    return {c: F.col("event_index" if c == "index" else c) for c in place} | event


def json_values(parsed: bool, *names: str) -> list[Column]:
    """Fields of an event's ``values`` as text: read from the VARIANT column
    where there is one, else by one parse of the JSON."""
    if parsed:
        return [F.try_variant_get("values_v", f"$.{n}", "string") for n in names]
    v = F.from_json("values", ", ".join(f"`{n}` string" for n in names))
    return [v[n] for n in names]


def transfer_fields(success: str = "extrinsic_success", parsed: bool = False) -> dict[str, Column]:
    """X-12 as columns of an event row."""
    source, target, amount = json_values(parsed, "from", "to", "amount")
    return _moved({"from": source, "to": target, "amount": amount38(amount), "success": F.col(success)})


def withdrawal_fields(success: str = "extrinsic_success", parsed: bool = False) -> dict[str, Column]:
    """X-13 as columns of an event row."""
    who, amount = json_values(parsed, "who", "amount")
    return _moved({"who": who, "amount": amount38(amount), "success": F.col(success)})


def extract_transfers(events: DataFrame) -> DataFrame:
    """Balances.Transfer -> from, to, amount DECIMAL(38,0), success."""
    tr = events.where((F.col("mod_name") == "Balances") & (F.col("event_name") == "Transfer"))
    return _with_success(tr, events).select(*[c.alias(k) for k, c in transfer_fields("success", "values_v" in events.columns).items()])


def extract_withdrawals(events: DataFrame) -> DataFrame:
    """Balances.Withdraw -> who, amount, success."""
    wd = events.where((F.col("mod_name") == "Balances") & (F.col("event_name") == "Withdraw"))
    return _with_success(wd, events).select(*[c.alias(k) for k, c in withdrawal_fields("success", "values_v" in events.columns).items()])
