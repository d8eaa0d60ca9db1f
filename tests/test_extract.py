"""Extraction from nested blocks: golden cases on the fixture chain."""

from pyspark.sql import functions as F

from chainlake.operators import extract as X
from chainlake.sources import envelope as V
from chainlake.sources import fixture


def blocks(spark, sf_dir, chains=("polkadot",)):
    return fixture.nested_blocks(spark.read.parquet(f"{sf_dir}/events.parquet"), chains)


def test_block_event_bound(spark, sf_dir):
    b = blocks(spark, sf_dir)
    mx = b.select(F.max(F.size("body.events")).alias("m")).first()["m"]
    assert mx <= fixture.EVENTS_PER_BLOCK


def test_empty_logs_give_no_rows(spark, sf_dir):
    b = blocks(spark, sf_dir)
    empty = b.where(F.size("logs") == 0).select("block_number").collect()
    assert empty, "fixture has blocks with B % 53 = 0"
    logs = X.extract_logs(b)
    assert logs.where(F.col("block_number").isin([r[0] for r in empty])).count() == 0


def test_null_validator(spark, sf_dir):
    h = X.extract_headers(blocks(spark, sf_dir))
    rows = h.where(F.col("number") % 7 == 0).select("validator", "validator_bytes").collect()
    assert rows and all(r["validator"] is None and r["validator_bytes"] is None for r in rows)


def test_ids_unique(spark, sf_dir):
    b = blocks(spark, sf_dir, ("polkadot", "kusama"))
    for df, key in [(X.extract_events(b), ["chain", "id"]), (X.extract_extrinsics(b), ["chain", "id"]),
                    (X.extract_logs(b), ["chain", "id"]), (X.extract_headers(b), ["chain", "number"])]:
        assert df.count() == df.select(*key).distinct().count()


def test_success_scopes(spark):
    """Success in extrinsic 1 does not mark extrinsic 2 by default, and does
    in the reference's running mode."""
    ev = lambda i, name: (i, "System", name)
    rows = [(7, [ev(1, "ExtrinsicSuccess"), ev(2, "ExtrinsicFailed")])]
    df = spark.createDataFrame(rows, "block_number long, evs array<struct<extrinsic_index:long,"
                                     "mod_name:string,event_name:string>>")
    b = df.select("block_number", F.lit("polkadot").alias("chain"), F.struct(
        F.array(*[F.struct(F.lit(None).cast("binary").alias("signature"),
                           F.lit(None).cast("binary").alias("extrinsic_hash"),
                           F.lit("M").alias("mod_name"), F.lit("c").alias("call_name"),
                           F.lit(None).cast("string").alias("call_params"),
                           F.lit(0).cast("long").alias("block_timestamp")) for _ in range(3)]
                ).alias("extrinsics"), F.col("evs").alias("events")).alias("body"))
    d = {r["extrinsic_index"]: r["result"] for r in X.extract_extrinsics(b, "extrinsic").collect()}
    r = {r["extrinsic_index"]: r["result"] for r in X.extract_extrinsics(b, "block_running").collect()}
    assert d == {0: False, 1: True, 2: False}
    assert r == {0: False, 1: True, 2: True}


def test_wire_roundtrip(spark, sf_dir, tmp_path):
    from chainlake.sources import envelope as V
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = fixture.write_envelope_files(events, str(tmp_path / "env"), ("polkadot",))
    env, rejected = V.split_valid(V.read_envelopes(spark, path), ("polkadot", "kusama"))
    numbers = [r[0] for r in events.selectExpr("event_id div 20").distinct().collect()]
    assert rejected.count() == sum(b % 37 == 5 for b in numbers) > 0
    good, bad = V.quarantine(V.blocks_of(env))
    assert bad.count() == sum(b % 41 == 7 for b in numbers) > 0
    direct = X.extract_headers(blocks(spark, sf_dir)).drop("block_bucket")
    wire = X.extract_headers(good).drop("block_bucket", "_src")
    assert direct.exceptAll(wire).count() == 0 and wire.exceptAll(direct).count() == 0


def test_batch_stats(spark, sf_dir, tmp_path):
    """A-04: a micro-batch reports its block count and range, and keeps them;
    the batch is applied once."""
    from chainlake.streaming import ingest as I
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = fixture.write_envelope_files(events, str(tmp_path / "env"), ("polkadot",))
    root = str(tmp_path / "lake")
    lines = V.read_envelopes(spark, path).withColumn("_line", F.col("_line").dropFields("line"))
    stats = I.write_batch(lines, 7, root, stream="s")
    b = X.extract_headers(blocks(spark, sf_dir))
    want = b.agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("lo"),
                 F.max("number").alias("hi")).first()
    assert (stats["n_blocks"], stats["min_block"], stats["max_block"]) == (want["n"], want["lo"], want["hi"])
    assert stats["blocks_inserted"] == want["n"] and I.batch_stats(root, spark) == {"s-7": stats}
    assert I.write_batch(lines, 7, root, stream="s") == stats
    assert I.write_batch(lines, 0, root, stream="t")["blocks_updated"] == want["n"]
    n = spark.read.parquet(f"{root}/_bad_blocks").groupBy("stream").count().collect()
    assert len(n) == 2 and len({r["count"] for r in n}) == 1       # each stream keeps its own dead letters


def _envelope_line(values_json: str, ts: str = "1700000000000") -> str:
    h = list(range(32))
    ev = ('{"id": "5-0", "block_number": 5, "block_timestamp": ' + ts + ', "extrinsic_index": 0, '
          '"extrinsic_id": "5-0", "mod_name": "Balances", "event_name": "Transfer", "event_index": 0, '
          '"phase": 0, "extrinsic_hash": ' + str(h) + ', "values": ' + values_json + '}')
    ex = ('{"id": "5-0", "block_number": 5, "extrinsic_hash": ' + str(h) + ', "block_timestamp": ' + ts +
          ', "mod_name": "Balances", "call_name": "transfer", "call_params": {"dest": "0xab", "value": 7}, '
          '"signature": [1, 2], "result": true}')
    header = ('{"block_number": 5, "block_timestamp": ' + ts + ', "block_hash": ' + str(h) +
              ', "parent_hash": ' + str(h) + ', "extrinsics_root": ' + str(h) + ', "state_root": ' + str(h) +
              ', "is_finished": true, "validator": null, "spec_version": 9430}')
    return ('{"chain": "Polkadot", "chain_kind": "Polkadot", "polkadot_blocks": [{"header": ' + header +
            ', "body": {"extrinsics": [' + ex + '], "events": [' + ev + ']}, "logs": null}]}')


def test_reference_wire_json_objects(spark, tmp_path):
    """The reference sends ``values`` / ``call_params`` as JSON objects; the
    reader keeps their text and the extraction reads fields from it."""
    from chainlake.sources import envelope as V
    p = tmp_path / "env.json"
    p.write_text(_envelope_line('{"from": "0x01", "to": "0x02", "amount": 340282366920938463463374607431768211455}') + "\n")
    env, rejected = V.split_valid(V.read_envelopes(spark, str(p)))
    assert rejected.count() == 0
    blocks = V.blocks_of(env)
    ev = X.extract_events(blocks).first()
    assert F is not None and '"amount"' in ev["values"]
    tr = X.extract_transfers(X.extract_events(blocks)).first()
    assert (tr["from"], tr["to"]) == ("0x01", "0x02")
    assert tr["amount"] is None                      # u128 max has 39 digits: NULL, not a failure
    x = X.extract_extrinsics(blocks).first()
    assert '"dest"' in x["call_params"] and x["is_signed"] and x["signer"] == "0x0102"
    assert X.extract_logs(blocks).count() == 0        # logs: null -> no rows


def test_missing_timestamp_defaults_to_zero(spark, tmp_path):
    """X-02: a block whose storage has no timestamp is stored with 0."""
    from chainlake.sources import envelope as V
    p = tmp_path / "env.json"
    p.write_text(_envelope_line('{"k": 1}', ts="null") + "\n")
    env, _ = V.split_valid(V.read_envelopes(spark, str(p)))
    h = X.extract_headers(V.blocks_of(env)).first()
    assert h["timestamp"] == 0 and h["spec_version"] == 9430 and h["validator"] is None


def test_events_outside_extrinsics(spark, sf_dir):
    e = X.extract_events(blocks(spark, sf_dir))
    outside = e.where("phase <> 0")
    assert {r.phase for r in outside.select("phase").distinct().collect()} == {1, 2}
    assert outside.where("extrinsic_id is not null or extrinsic_index is not null or extrinsic_success").count() == 0
    assert e.where("phase = 0 and extrinsic_id is null").count() == 0


def test_phase_wraps(spark, sf_dir):
    b = blocks(spark, sf_dir).limit(1).withColumn("body", F.col("body").withField("events", F.transform(
        F.col("body.events"), lambda x: x.withField("phase", F.lit(65535)))))
    assert {r.phase for r in X.extract_events(b).select("phase").collect()} == {-1}


def test_wire_engine_is_text_and_bad_envelopes_are_refused(spark, tmp_path):
    lines = ['{"chain": "Polkadot", "chain_kind": "Polkadot", "polkadot_blocks": [{"header": {"block_number": 1, "block_timestamp": 1, '
             '"block_hash": [' + ",".join(["1"] * 32) + '], "parent_hash": [' + ",".join(["2"] * 32) + ']}, "body": {"extrinsics": [], '
             '"events": []}, "logs": [{"type": "Seal", "engine": "BABE", "data": [1, 255]}, {"type": "Other"}]}]}',
             '{"chain": null, "chain_kind": "Polkadot", "polkadot_blocks": []}', '{"chain": "Polkadot", "polkadot_blocks": []}',
             '{"chain": "a/../b", "chain_kind": "Polkadot", "polkadot_blocks": []}', "{", ""]
    (tmp_path / "a.json").write_text("\n".join(lines))
    env = V.read_envelopes(spark, str(tmp_path / "a.json"))
    ok, bad = V.split_valid(env, ("polkadot", "kusama"))
    assert sorted(r.reason for r in bad.collect()) == ["missing_chain", "missing_chain_kind", "unknown_chain", "unparseable"]
    logs = X.extract_logs(V.blocks_of(ok)).orderBy("log_index").collect()
    assert [(r.type, r.engine, r.data) for r in logs] == [("Seal", "BABE", "0x01ff"), ("Other", None, None)]


def test_items_that_are_derived_are_derived_once(spark):
    item = "struct(cast(1 as bigint) as event_index, cast(0 as bigint) as extrinsic_index, 'System' as mod_name, 'ExtrinsicSuccess' as event_name, " \
           "0 as phase, '{}' as values, cast(5 as bigint) as block_timestamp, cast('x' as binary) as extrinsic_hash)"
    blocks = spark.range(3).selectExpr(
        "'c' as chain", "id as block_number", f"named_struct('events', transform(sequence(1, cast(id as int), 1), i -> {item})) as body").where(
        "block_number > 0").unionByName(spark.sql(f"select 'c' as chain, cast(9 as bigint) as block_number, "
                                                  f"named_struct('events', slice(array({item}), 1, 0)) as body"))
    assert sorted(r.block_number for r in X.extract_events(blocks).collect()) == [1, 2, 2]   # an empty list gives no rows
    plan = X.extract_events(blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan.replace("array_size(", "")
