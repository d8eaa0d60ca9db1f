"""Live counts that follow re-delivered blocks: the rows, and what lies on disk."""

import glob
from collections import Counter

from pyspark.sql import functions as F

from chainlake.lake import FIXTURE_CHAINS
from chainlake.operators import sink as S
from chainlake.plans import q_stream as Q
from chainlake.session import SHUFFLE_CLEANUP
from chainlake.sources import envelope as V
from chainlake.streaming import ingest as I

KINDS = ("signup", "error", "click", "view", "purchase")
NAMES = {"signup": ("System", "ExtrinsicSuccess"), "error": ("System", "ExtrinsicFailed"), "click": ("Utility", "ItemCompleted"),
         "view": ("TransactionPayment", "TransactionFeePaid")}


def test_redelivered_counts_keep_little_on_disk(spark, tmp_path, monkeypatch):
    n = 4_000
    k = F.col("id")
    kind = F.get(F.array(*[F.lit(x) for x in KINDS]), (k * 7 % 5).cast("int"))
    spark.range(n).select(k.alias("event_id"), F.timestamp_seconds(k * 6 + 1_700_000_000).alias("ts"), (k % 11).alias("user_id"),
                          kind.alias("event_type"), (k % 100 / 10).alias("value"), F.lit("{}").alias("props")
                          ).write.parquet(str(tmp_path / "events.parquet"))
    want = Counter()
    for i in range(n):
        block = i // 20
        pallet, name = NAMES.get(KINDS[i * 7 % 5], ("Balances", "Withdraw" if i % 11 % 3 == 0 else "Transfer"))
        name = "ItemFailed" if name == "ItemCompleted" and block % 10 == 0 else name
        want.update((chain, pallet, name) for chain in FIXTURE_CHAINS if chain == "polkadot" or block % 2 == 0)

    plans, write = [], S.write_partitioned

    def seen(df, path, *args, **options):
        if "/events/data/" in path:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, path, *args, **options)

    def kept(*_):
        raise AssertionError("a batch's lines are kept")
    monkeypatch.setattr(S, "write_partitioned", seen)
    monkeypatch.setattr(S, "MERGE_BYTES", 0)
    monkeypatch.setattr(type(spark.range(1)), "persist", kept)
    monkeypatch.setattr(Q, "work_dir", lambda *_: str(tmp_path / "work"))
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    got = {(r.chain, r.mod_name, r.event_name): r.n for r in Q.stream_event_counts_redelivered(spark, str(tmp_path)).collect()}
    assert got == want
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == before
    assert I.stats_table(str(tmp_path / "work"), spark).where("stats['events_updated'] > 0").count() == 2
    # stored rows are written anew where they are read, and the batch's beside them as they were staged
    assert len(plans) == 2 and all("BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p for p in plans)
    lines = [f for folder in ("_source", "_again0", "_again1") for f in glob.glob(str(tmp_path / "work" / folder / "part-*"))]
    assert lines and all(f.endswith(".gz") for f in lines)


def test_contents_of_odd_lines(spark, tmp_path):
    whole = "[" + ",".join(["7"] * 32) + "]"

    def line(*blocks, chain='"Polkadot"'):
        return f'{{"chain": {chain}, "chain_kind": "Polkadot", "polkadot_blocks": [{", ".join(blocks)}]}}'

    def block(number, parent=whole):
        return f'{{"header": {{"block_number": {number}, "block_hash": {whole}, "parent_hash": {parent}}}}}'
    (tmp_path / "a.json").write_text("\n".join([
        line(block(7), block(3), block(1, "null")), line(), line("null", block(9)), line(block(4), chain="null"), "not json",
        '{"chain": "Polkadot", "chain_kind": "Polkadot", "polkadot_blocks": null}', line("{}")]))
    (tmp_path / "b.json").write_text(line())
    got = {r.file.rsplit("/", 1)[1]: (r.n, r.refused, r.good, r.bad, r.lo, r.hi) for r in I._contents(
        V.read_envelopes(spark, str(tmp_path)).withColumn("reason", V.reject_reason())).collect()}
    assert got == {"a.json": (7, 3, 3, 3, 3, 9), "b.json": (1, 0, 0, 0, None, None)}
