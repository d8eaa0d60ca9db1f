"""Deterministic Substrate-style chain derived from the ``events`` table.

Every value is a pure function of one ``events`` row (or of the block it
falls in), so the DuckDB oracle states the same formulas in SQL
(FIXTURES.md §3). With ``k = event_id``: block ``B = k div 20``, event index
``k % 20``, extrinsic index ``(k % 20) div 4``.

Scale notes: the per-event derivation is a narrow projection. Building the
nested block is one ``groupBy(block_number)``; a block holds at most
``EVENTS_PER_BLOCK`` events by the rule above, so the collected list per
group is bounded no matter how large ``events`` grows. Chains share the
groups. Where everything is written out (:func:`block_ranges`) the plain event
rows are dealt out by block, and hashes and JSON are derived after that
shuffle: they are many times the size of what they are derived from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import engine_name, ints_from_bytes, sha256_0x, sha256_bytes

# Fixed values of the fixture rules (FIXTURES.md §3).
EVENTS_PER_BLOCK = 20
EVENTS_PER_EXTRINSIC = 4
GAP_MOD, GAP_REM = 97, 96          # the gap audit leaves out blocks with B % 97 = 96
ACCOUNTS = 150                     # transfer target: (u*7+1) % 150
FORK_MOD, FORK_REM = 50, 7         # parent link broken when B % 50 = 7
VALIDATOR_NULL_MOD = 7
VALIDATOR_MOD = 13
SPEC_BASE, SPEC_STEP, SPEC_EVERY = 9000, 10, 150
EXTRA_EXTRINSIC_MOD = 4            # event-less extrinsic 5 when B % 4 = 0
NULL_VALUES_MOD = 41               # ItemCompleted values NULL when k % 41 = 0
KUSAMA_MOD = 2                     # kusama carries blocks with B % 2 = 0
REDELIVER_MOD = 10                 # re-delivery batch: B % 10 = 0
TOPICS_MOD = 7                     # raw event has k % 7 topics
FINAL_INDEX, FINAL_MOD = 19, 2     # last event of odd blocks: phase Finalization
INIT_INDEX, INIT_MOD = 0, 3        # first event of blocks with B % 3 = 0: phase Initialization
BAD_ENVELOPE_MOD, BAD_ENVELOPE_REM = 37, 5
BAD_BLOCK_MOD, BAD_BLOCK_REM = 41, 7
CHAIN_PREFIX = {"polkadot": "", "kusama": "ksm-"}
CHAIN_TITLE = {"polkadot": "Polkadot", "kusama": "Kusama"}
CALLS = [("Balances", "transfer_keep_alive"), ("Utility", "batch"), ("Staking", "bond")]
# event_type -> (pallet, event); purchase splits on user_id % 3.
EVENT_MAP = {
    "signup": ("System", "ExtrinsicSuccess"),
    "error": ("System", "ExtrinsicFailed"),
    "click": ("Utility", "ItemCompleted"),
    "view": ("TransactionPayment", "TransactionFeePaid"),
}
# Public pallet indices of the Polkadot runtime (legacy raw_event.pallet_index).
PALLET_INDEX = {"System": 0, "Balances": 5, "Staking": 7, "Utility": 26, "TransactionPayment": 32,
                "Timestamp": 2}


def _s(x) -> Column:
    return x.cast("string")


def account_hash(u: Column) -> Column:
    return sha256_0x(F.concat(F.lit("acct-"), _s(u)))


def event_rows(events: DataFrame) -> DataFrame:
    """Per-event derivation; one output row per ``events`` row."""
    k = F.col("event_id")
    u = F.col("user_id")
    et = F.col("event_type")
    amount = F.round(F.col("value") * 100).cast("bigint")
    purchase = et == "purchase"
    mod_name = F.when(purchase, "Balances")
    event_name = F.when(purchase & (u % 3 == 0), "Withdraw").when(purchase, "Transfer")
    for typ, (pallet, ev) in EVENT_MAP.items():
        mod_name = mod_name.when(et == typ, pallet)
        event_name = event_name.when(et == typ, ev)
    b, i = F.expr(f"event_id div {EVENTS_PER_BLOCK}"), k % EVENTS_PER_BLOCK
    phase = (F.when((i == FINAL_INDEX) & (b % FINAL_MOD == 1), 1)
             .when((i == INIT_INDEX) & (b % INIT_MOD == 0), 2).otherwise(0))
    df = (events
          .select(
              k.alias("k"),
              b.alias("block_number"),
              i.alias("event_index"),
              phase.cast("int").alias("phase"),
              F.when(phase == 0, F.expr(f"(event_id % {EVENTS_PER_BLOCK}) div {EVENTS_PER_EXTRINSIC}"))
              .alias("extrinsic_index"),
              F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ts_ms"),
              u.alias("user_id"),
              mod_name.alias("mod_name"),
              event_name.alias("event_name"),
              amount.alias("amount"),
              F.col("props")))
    who = account_hash(F.col("user_id"))
    values = (
        F.when(F.col("event_name") == "Transfer", F.to_json(F.struct(
            who.alias("from"),
            account_hash((F.col("user_id") * 7 + 1) % ACCOUNTS).alias("to"),
            F.col("amount").alias("amount"))))
        .when(F.col("event_name") == "Withdraw", F.to_json(F.struct(
            who.alias("who"), F.col("amount").alias("amount"))))
        .when(F.col("event_name") == "TransactionFeePaid", F.to_json(F.struct(
            who.alias("who"), F.col("amount").alias("actual_fee"))))
        .when((F.col("event_name") == "ItemCompleted") & (F.col("k") % NULL_VALUES_MOD == 0),
              F.lit(None).cast("string"))
        .otherwise(F.col("props")))
    return df.withColumn("values", values).drop("props")


BLOCK_OF_EVENT = f"event_id div {EVENTS_PER_BLOCK}"
TASK_EVENTS = 100_000  # events that a task derives at once, about


def block_ranges(events: DataFrame, count: int | None = None, task_events: int = TASK_EVENTS) -> DataFrame:
    """``events`` dealt out by ranges of blocks, ``count`` of them or one for
    about ``task_events`` events; what is grouped by block after it is not
    shuffled again."""
    if count is None:
        count = max(1, -(-events.count() // task_events))
    return events.repartitionByRange(count, F.expr(BLOCK_OF_EVENT))


def _chain_tags(chains: tuple[str, ...]) -> Column:
    """The chains that carry a block, by name."""
    tags = []
    for c in sorted(chains):
        if c == "polkadot":
            tags.append(F.lit(c))
        elif c == "kusama":
            tags.append(F.when(F.col("block_number") % KUSAMA_MOD == 0, F.lit(c)))
        else:
            raise ValueError(f"unknown fixture chain {c!r}")
    return F.filter(F.array(*tags), lambda x: x.isNotNull())


def _chain_rows(rows: DataFrame, chains: tuple[str, ...]) -> DataFrame:
    """Tag rows with their chain(s): polkadot carries every block, kusama
    the blocks with ``B % 2 = 0``. One pass, no union of two scans."""
    if tuple(chains) == ("polkadot",):
        return rows.withColumn("chain", F.lit("polkadot"))
    return rows.withColumn("chain", F.explode(_chain_tags(chains)))


def _h(prefix: Column, *parts) -> Column:
    """Chain-scoped hash bytes: sha256(prefix || parts...)."""
    return sha256_bytes(F.concat(prefix, *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def grouped_events(events: DataFrame, chains: tuple[str, ...]) -> DataFrame:
    """``block_number, ts_ms, evs, chain``: the events of each block, once per
    chain that carries it."""
    grouped = event_rows(events).groupBy("block_number").agg(
        F.max("ts_ms").alias("ts_ms"),
        F.collect_list(F.struct("event_index", "extrinsic_index", "phase", "mod_name",
                                "event_name", "values")).alias("evs"))
    return _chain_rows(grouped, chains)


def nested_blocks(events: DataFrame, chains: tuple[str, ...] = ("polkadot",)) -> DataFrame:
    """One row per block: ``chain, block_number, header, body{extrinsics,
    events}, logs`` - the in-memory shape of a decoded finalized block."""
    return block_structs(grouped_events(events, chains))


def block_structs(grouped: DataFrame) -> DataFrame:
    B = F.col("block_number")
    ts = F.col("ts_ms")
    pfx = F.coalesce(F.create_map(*[x for kv in CHAIN_PREFIX.items()
                                    for x in (F.lit(kv[0]), F.lit(kv[1]))])[F.col("chain")], F.lit(""))
    sB = _s(B)
    header = F.struct(
        B.alias("block_number"),
        ts.alias("block_timestamp"),
        _h(pfx, "block-", sB).alias("block_hash"),
        F.when(B % FORK_MOD == FORK_REM, _h(pfx, "fork-", sB))
         .otherwise(_h(pfx, "block-", _s(B - 1))).alias("parent_hash"),
        _h(pfx, "xroot-", sB).alias("extrinsics_root"),
        _h(pfx, "state-", sB).alias("state_root"),
        F.lit(True).alias("is_finished"),
        F.when(B % VALIDATOR_NULL_MOD != 0, _h(pfx, "validator-", _s(B % VALIDATOR_MOD)))
         .alias("validator"),
        (F.lit(SPEC_BASE) + F.lit(SPEC_STEP) * F.expr(f"block_number div {SPEC_EVERY}"))
        .cast("bigint").alias("spec_version"),
    )
    evs = F.array_sort(F.col("evs"))
    first_ok = F.array_min(F.filter(F.transform(evs, lambda e: F.when(
        (e["mod_name"] == "System") & (e["event_name"] == "ExtrinsicSuccess"),
        e["extrinsic_index"])), lambda v: v.isNotNull()))
    n_ext = F.when(B % EXTRA_EXTRINSIC_MOD == 0, 6).otherwise(5)
    call_pallets = F.array(*[F.lit(p) for p, _ in CALLS])
    call_names = F.array(*[F.lit(c) for _, c in CALLS])

    def extrinsic(i: Column) -> Column:
        sel = ((B + i) % len(CALLS)).cast("int")
        return F.struct(
            F.concat_ws("-", sB, _s(i)).alias("id"),
            B.alias("block_number"),
            F.when(i == 5, _h(pfx, "ext5-", sB))
             .otherwise(_h(pfx, "ext-", _s(B * 5 + i))).alias("extrinsic_hash"),
            ts.alias("block_timestamp"),
            F.when(i == 0, F.lit("Timestamp")).otherwise(F.get(call_pallets, sel)).alias("mod_name"),
            F.when(i == 0, F.lit("set")).otherwise(F.get(call_names, sel)).alias("call_name"),
            F.to_json(F.struct(B.alias("block"), i.alias("index"))).alias("call_params"),
            F.when(i != 0, sha256_bytes(F.concat(F.lit("acct-"), _s((B + i) % ACCOUNTS))))
             .alias("signature"),
            # wire ``result`` as the reference's builder sets it (running flag)
            F.coalesce(first_ok <= i, F.lit(False)).alias("result"),
        )

    def event(e: Column) -> Column:
        xi = e["extrinsic_index"]
        return F.struct(
            F.concat_ws("-", sB, _s(e["event_index"])).alias("id"),
            B.alias("block_number"),
            ts.alias("block_timestamp"),
            xi.alias("extrinsic_index"),
            F.concat(sB, F.lit("-"), _s(xi)).alias("extrinsic_id"),
            e["mod_name"].alias("mod_name"),
            e["event_name"].alias("event_name"),
            e["event_index"].alias("event_index"),
            e["phase"].alias("phase"),
            _h(pfx, "ext-", _s(B * 5 + xi)).alias("extrinsic_hash"),
            e["values"].alias("values"),
        )

    # the decoder turns 4-byte engine ids into text (S-04)
    babe = engine_name(F.lit(bytearray(b"BABE")))
    beef = engine_name(F.when(B % 25 == 0, F.lit(bytearray(b"\xff\x80\x00\x01")))
                       .otherwise(F.lit(bytearray(b"BEEF"))))
    no_bytes, no_engine = F.lit(None).cast("binary"), F.lit(None).cast("string")

    def log(kind: str, engine: Column, data: Column, present: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), engine.alias("engine"),
                        data.alias("data"), present.alias("present"))

    candidates = F.array(
        log("PreRuntime", babe, _h(pfx, "pre-", sB), F.lit(True)),
        log("Seal", babe, _h(pfx, "seal-", sB), F.lit(True)),
        log("Consensus", beef, _h(pfx, "beef-", sB), B % 5 == 0),
        log("Other", no_engine, _h(pfx, "other-", sB), B % 11 == 0),
        log("RuntimeEnvironmentUpdated", no_engine, no_bytes, B % 50 == 0),
    )
    logs = F.when(B % 53 == 0, F.array().cast(
        "array<struct<type:string,engine:string,data:binary>>")).otherwise(
        F.transform(F.filter(candidates, lambda c: c["present"]),
                    lambda c: F.struct(c["type"].alias("type"), c["engine"].alias("engine"),
                                       c["data"].alias("data"))))
    return grouped.select(
        "chain", "block_number",
        header.alias("header"),
        F.struct(
            F.transform(F.sequence(F.lit(0), n_ext - 1), extrinsic).alias("extrinsics"),
            F.transform(evs, event).alias("events"),
        ).alias("body"),
        logs.alias("logs"),
    )


def redelivery(blocks: DataFrame) -> DataFrame:
    """Re-delivery batch: blocks with ``B % 10 = 0`` again, spec_version + 1
    and the validator removed (the NULL must win on upsert)."""
    return (blocks.where(F.col("block_number") % REDELIVER_MOD == 0)
            .withColumn("header", F.col("header")
                        .withField("spec_version", F.col("header.spec_version") + 1)
                        .withField("validator", F.lit(None).cast("binary"))))


def renamed_events(blocks: DataFrame) -> DataFrame:
    """A re-delivery that changes stored rows: blocks with ``B % 10 = 0`` again,
    their ``ItemCompleted`` events now ``ItemFailed``."""
    events = F.transform(F.col("body.events"), lambda e: e.withField(
        "event_name", F.when(e["event_name"] == "ItemCompleted", F.lit("ItemFailed")).otherwise(e["event_name"])))
    return (blocks.where(F.col("block_number") % REDELIVER_MOD == 0)
            .withColumn("body", F.col("body").withField("events", events)))


def raw_event_rows(events: DataFrame) -> DataFrame:
    """Legacy raw events (bytes + topics) for the polkadot chain."""
    ev = event_rows(events)
    B = F.col("block_number")
    k = F.col("k")
    topic_pool = F.array(*[sha256_bytes(F.concat(F.lit("topic-"), _s(k), F.lit(f"-{j}")))
                           for j in range(TOPICS_MOD - 1)])
    pidx = F.create_map(*[x for kv in PALLET_INDEX.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return ev.select(
        B.alias("block_number"),
        sha256_0x(F.concat(F.lit("block-"), _s(B))).alias("block_hash"),
        sha256_0x(F.concat(F.lit("ext-"), _s(B * 5 + F.col("extrinsic_index")))).alias("extrinsic_hash"),
        sha256_bytes(F.concat(F.lit("data-"), _s(k))).alias("data"),
        F.col("event_index").cast("int").alias("index"),
        F.slice(topic_pool, 1, (k % TOPICS_MOD).cast("int")).alias("topics"),
        F.when(F.col("phase") == 1, "Finalization").when(F.col("phase") == 2, "Initialization")
        .otherwise("ApplyExtrinsic").alias("phase_kind"),
        F.col("extrinsic_index").alias("phase_index"),
        F.col("mod_name").alias("pallet_name"),
        pidx[F.col("mod_name")].cast("smallint").alias("pallet_index"),
        F.col("event_name").alias("event_name"),
        F.col("values"),
    )


# Wire form (JSON envelope) -------------------------------------------------
def to_wire(blocks: DataFrame, order: Column | None = None) -> DataFrame:
    """Nested blocks -> envelope rows, one block per envelope as the
    reference sends them; bytes travel as arrays of numbers. ``order`` says
    when they are delivered (default: by block number)."""
    ib = ints_from_bytes
    h = F.col("header")
    header = F.struct(
        h["block_number"].alias("block_number"), h["block_timestamp"].alias("block_timestamp"),
        ib(h["block_hash"]).alias("block_hash"), ib(h["parent_hash"]).alias("parent_hash"),
        ib(h["extrinsics_root"]).alias("extrinsics_root"), ib(h["state_root"]).alias("state_root"),
        h["is_finished"].alias("is_finished"), ib(h["validator"]).alias("validator"),
        h["spec_version"].alias("spec_version"))
    exts = F.transform(F.col("body.extrinsics"), lambda x: x.withField(
        "extrinsic_hash", ib(x["extrinsic_hash"])).withField("signature", ib(x["signature"])))
    evs = F.transform(F.col("body.events"), lambda e: e.withField(
        "extrinsic_hash", ib(e["extrinsic_hash"])))
    logs = F.transform(F.col("logs"), lambda g: F.struct(
        g["type"].alias("type"), g["engine"].alias("engine"), ib(g["data"]).alias("data")))
    title = F.create_map(*[x for kv in CHAIN_TITLE.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    block = F.struct(header.alias("header"), F.struct(exts.alias("extrinsics"), evs.alias("events"))
                     .alias("body"), logs.alias("logs"))
    return blocks.select(
        title[F.col("chain")].alias("chain"),
        F.lit("Polkadot").alias("chain_kind"),
        F.array(block).alias("polkadot_blocks"),
        (F.col("block_number") if order is None else order).alias("_order"))


def bad_lines(number: str) -> Column:
    """The lines of malformed input that a block ``B`` (column ``number``) adds, as
    an array: an envelope that is refused where ``B % 37 = 5``, of the kind
    ``(B div 37) % 6``; one whose block is quarantined where ``B % 41 = 7``, of the
    kind ``(B div 41) % 3``."""
    B = F.col(number)
    n = _s(B)
    empty = '"polkadot_blocks": []}'
    kinds = [F.concat(F.lit("this is not json "), n),
             F.lit('{"chain": "Polkadot", "chain_kind": "Polkadot", "polkadot_blocks": null}'),
             F.lit('{"chain": "Polkadot", "chain_kind": "Ethereum", ' + empty),
             F.lit('{"chain": null, "chain_kind": "Polkadot", ' + empty),
             F.lit('{"chain": "Nowhere/../x", "chain_kind": "Polkadot", ' + empty),
             F.lit('{"chain": "Kusama", "chain_kind": null, ' + empty)]
    full = F.array_join(F.array_repeat(F.lit("7"), 32), ",")

    def block(number: Column, block_hash: Column, parent: Column) -> Column:
        return F.concat(
            F.lit('{"chain": "Polkadot", "chain_kind": "Polkadot", "polkadot_blocks": [{"header": {"block_number": '),
            number, F.lit(', "block_timestamp": 1, "block_hash": '), block_hash, F.lit(', "parent_hash": '), parent,
            F.lit(', "is_finished": true, "spec_version": 1}, "body": {"extrinsics": [], "events": []}, "logs": []}]}'))

    whole = F.concat(F.lit("["), full, F.lit("]"))
    faults = [block(F.lit("null"), whole, whole), block(n, F.lit("[1]"), whole), block(n, whole, F.lit("null"))]
    pick = lambda options, i: F.get(F.array(*options), i)
    refused = F.when(B % BAD_ENVELOPE_MOD == BAD_ENVELOPE_REM,
                     pick(kinds, F.expr(f"cast((`{number}` div {BAD_ENVELOPE_MOD}) % 6 as int)")))
    bad = F.when(B % BAD_BLOCK_MOD == BAD_BLOCK_REM,
                 pick(faults, F.expr(f"cast((`{number}` div {BAD_BLOCK_MOD}) % 3 as int)")))
    return F.array_sort(F.filter(F.array(refused, bad), lambda x: x.isNotNull()))


def wire_lines(blocks: DataFrame, order: Column | None = None) -> DataFrame:
    """``(value, _order)``: one envelope per line, NULL fields left out."""
    wire = to_wire(blocks, order)
    cols = [c for c in wire.columns if c != "_order"]
    return wire.select(F.to_json(F.struct(*cols)).alias("value"), "_order")


def write_envelope_files(events: DataFrame, path: str, chains: tuple[str, ...] = ("polkadot",),
                         with_bad: bool = True) -> str:
    """Write the fixture chain as JSON-lines envelope files (the ingest
    source format): a file is a contiguous block range and file names follow
    block order, like a chain follower's (see :func:`file_count`)."""
    write_in_block_order(events, path, chains, file_count(events, chains), with_bad)
    return path


FILE_EVENTS = 1_000_000  # events of one file, at most about
LEAST_FILES = 12


def file_count(events: DataFrame, chains: tuple[str, ...], least: int = LEAST_FILES) -> int:
    """Files grow with the input up to ``FILE_EVENTS`` events, then their number."""
    weight = sum(1 if c == "polkadot" else 1 / KUSAMA_MOD for c in chains)
    return max(least, -int(-events.count() * weight // FILE_EVENTS))


def write_in_block_order(events: DataFrame, path: str, chains: tuple[str, ...], count: int,
                         with_bad: bool = False) -> None:
    """The blocks' envelope lines in ``count`` files in block order. The plain
    events are dealt out by block and the blocks sorted before their lines are
    written as JSON, so neither shuffle nor sort carries the lines."""
    grouped = grouped_events(block_ranges(events, count), chains).sortWithinPartitions("block_number", "chain")
    # the wire form has the title for the chain; bad lines stand before their block's first line
    wire = to_wire(block_structs(grouped))
    value = F.to_json(F.struct("chain", "chain_kind", "polkadot_blocks"))
    if with_bad:
        titles = F.transform(_chain_tags(chains), lambda c: F.initcap(c))
        wire = wire.withColumnRenamed("_order", "block_number").withColumn("_first", F.col("chain") == F.get(titles, F.lit(0)))
        bad = F.when(F.col("_first"), bad_lines("block_number")).otherwise(F.array().cast("array<string>"))
        lines = wire.select(F.explode(F.concat(bad, F.array(value))).alias("value"))
    else:
        lines = wire.select(value.alias("value"))
    lines.write.mode("overwrite").text(path)
    stamp_in_order(events.sparkSession, path)


def stamp_in_order(spark, path: str) -> None:
    """Give the files of a folder modification times in the order of their
    names, as if they had landed one after the other."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted(((st.getPath().getName(), st.getModificationTime(), st.getPath()) for st in fs.listStatus(fs_path)
                   if st.isFile() and not st.getPath().getName().startswith(("_", "."))), key=lambda f: f[0])
    last = max((t for _, t, _ in files), default=0)
    for i, (_, _, file) in enumerate(files):
        fs.setTimes(file, last - 1000 * (len(files) - i), -1)


def interleave(spark, path: str, other: str) -> None:
    """Move the files of ``other`` into ``path``, each right behind the file of
    its rank, in name and time."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder, tag in ((path, "a"), (other, "b")):
        names = sorted(n.getPath().getName() for n in fs.listStatus(fs_path(folder)) if not n.getPath().getName().startswith(("_", ".")))
        for i, name in enumerate(names):
            if not fs.rename(fs_path(f"{folder}/{name}"), fs_path(f"{path}/{i:06d}{tag}-{name}")):
                raise OSError(f"cannot move {folder}/{name}")
    stamp_in_order(spark, path)


ARCHIVE_BLOCKS = 100  # blocks of one archive folder


def write_archive(blocks: DataFrame, path: str) -> str:
    """Envelope lines in one folder per ``ARCHIVE_BLOCKS`` blocks
    (``range=<block div 100>``), so a back-fill reads only its range."""
    (wire_lines(blocks).withColumn("range", F.expr(f"_order div {ARCHIVE_BLOCKS}")).repartition("range")
     .sortWithinPartitions("range", "_order").select("value", "range").write.mode("overwrite").partitionBy("range").text(path))
    return path
