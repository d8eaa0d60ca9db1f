"""Structured Streaming ingest.

The chain follower's output (envelope files) is a file source. Each
micro-batch goes through ``write_batch``: validate envelopes, explode
blocks, quarantine bad blocks, then upsert header -> logs -> extrinsics ->
events. The checkpoint gives at-least-once delivery, and a batch is stored once
under its stream, number and content: the effect is exactly once - where the
reference is at-most-once - and a checkpoint that starts anew loses nothing.

Chains are independent: ``per_chain`` runs one query, with a watermark of its
own, for each.
"""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.codec import chain_key
from ..operators import commits, files, hash_index
from ..operators import extract as X
from ..operators import sink as S
from ..sources import envelope as V
from ..session import SHUFFLE_CLEANUP
from ..tables import PARSED

TABLE_STEPS = (
    ("blocks", X.extract_headers, "number"),
    ("block_logs", X.extract_logs, None),
    ("extrinsics", X.extract_extrinsics, None),
    ("events", X.extract_events, None),
)


def write_batch(batch: DataFrame, batch_id: int, root: str,
                tables: tuple[str, ...] = ("blocks", "block_logs", "extrinsics", "events"),
                stream: str = "all", known_chains: tuple[str, ...] | None = None,
                feeds: dict[str, list[str]] | None = None, indexes: tuple[str, ...] = ()) -> dict:
    """IO-15: one micro-batch of the stream ``stream`` into the stored tables
    (plus dead letters). The lines are parsed once, tagged and kept for the
    batch, or, for a single table, parsed by each pass, as what is kept of a
    large batch fills the disk; the tables are staged side by side, and one plan and one commit
    cover them all: a batch that is run again (same name, same files) changes
    nothing or finishes what it had begun, wherever it broke off. ``feeds``:
    columns per table whose values before and after are kept (see
    ``sink.changes``). ``indexes``: hash columns of ``blocks`` whose index is
    kept along, in the same commit. Returns the batch's block count and range
    (A-04) and the keys inserted and updated, which the commit log keeps (see
    :func:`batch_stats`)."""
    return commit_batch(batch, batch_id, root, tables, stream, known_chains, feeds, indexes)[0]


def commit_batch(batch: DataFrame, batch_id: int, root: str, tables: tuple[str, ...], stream: str,
                 known_chains: tuple[str, ...] | None, feeds: dict[str, list[str]] | None,
                 indexes: tuple[str, ...]) -> tuple[dict, str]:
    """:func:`write_batch`; its statistics and the digest of its content."""
    spark = batch.sparkSession
    finish_batches(spark, root)
    name = f"{stream}-{batch_id}"
    batch = batch.withColumn("_line", F.struct("_line.*", F.monotonically_increasing_id().alias("line")))
    steps = [(t, fn) for t, fn, _ in TABLE_STEPS if t in tables]
    tagged = batch.withColumn("reason", V.reject_reason(known_chains))
    if len(steps) > 1:
        tagged = tagged.persist(StorageLevel.MEMORY_AND_DISK)
    stage = f"{root}__staging/{uuid.uuid4().hex}"
    S._ACTIVE.add(stage)
    try:
        # what the batch delivers: the lines of each piece of each file, and their blocks
        what = _contents(tagged).agg(
            *commits.digest_columns(["file", "time", "split", "n"]), F.sum("refused").alias("refused"),
            F.sum("good").alias("n"), F.sum("bad").alias("bad"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
        digest = commits.digest_of(what)
        log = commits.CommitLog(spark, f"{root}/_commits")
        stored = log.find(name, digest) if log.maybe_known(name) else None
        if stored is not None:
            return stored, digest
        good, bad = V.quarantine(V.blocks_of(tagged.where("reason is null")))

        def one(step):
            table, fn = step
            rows = fn(good, **({"parsed": True} if table in PARSED else {}))
            return table, S._stage(S.with_order(rows, batch_id), S.TABLE_KEYS[table], [], f"{stage}/{table}")

        def dead_letters(refused: int, faulty: int):
            for folder in ("_rejected_envelopes", "_bad_blocks"):  # readable also while empty
                fs, p = files.fs_of(spark, f"{root}/{folder}")
                fs.mkdirs(p)
            if refused:
                rows = tagged.where("reason is not null").select("reason", F.coalesce(V.CORRUPT, F.to_json(F.struct(
                    "chain", "chain_kind"))).alias("payload"))
                _dead_letters(rows, f"{root}/_rejected_envelopes", stream, batch_id, digest)
            if faulty:
                _dead_letters(bad.select("chain", "problem", F.to_json("header").alias("payload")),
                              f"{root}/_bad_blocks", stream, batch_id, digest)
        # independent tables and the dead letters are written by concurrent jobs
        with ThreadPoolExecutor(max_workers=len(steps) + 1) as pool:
            staged = pool.map(one, steps)
            letters = pool.submit(dead_letters, what["refused"] or 0, what["bad"] or 0)
            staged = dict(staged)
            letters.result()
        stats = {"n_blocks": what["n"] or 0, "min_block": what["lo"], "max_block": what["hi"]}
        with S._LOCKS[root], ThreadPoolExecutor(max_workers=max(1, len(steps))) as pool:
            plans = dict(pool.map(lambda t: (t, S.plan_swap(spark, f"{root}/{t}", staged[t], S.TABLE_KEYS[t], [],
                                                            (feeds or {}).get(t), by_block=True)), staged))
            for table, plan in plans.items():       # IO-18: inserted vs updated keys
                stats.update({f"{table}_{k}": v for k, v in plan["counts"].items()})
            for column in indexes:
                plans[f"index_{column}"] = hash_index.plan_append(
                    spark, S.staged_rows(spark, staged["blocks"]), root, column, f"{stage}/index_{column}")
            files.write_json(spark, f"{stage}/_READY", {"commit": name, "digest": digest, "stats": stats, "plans": plans})
            _carry_out(spark, stage, root)
        for column in indexes:
            hash_index.fold(spark, root, column)
        return stats, digest
    finally:
        S._ACTIVE.discard(stage)
        tagged.unpersist()


def _contents(tagged: DataFrame) -> DataFrame:
    """One row per piece of a file: its lines, how many are refused, and the
    good and bad blocks of the others with the good ones' range. Only headers
    are looked at."""
    heads = tagged.select("_line", "reason", F.posexplode_outer(F.when(
        F.col("reason").isNull(), F.col("polkadot_blocks.header"))).alias("pos", "wire"))
    first = F.coalesce("pos", F.lit(0)) == 0   # a line without blocks has one row too
    header = F.when(F.col("pos").isNotNull(), V.from_wire_header(F.col("wire")))
    return (heads.withColumn("header", header).withColumn("fault", F.when(F.col("pos").isNotNull(), V.block_problem()))
            .withColumn("good", F.col("pos").isNotNull() & F.col("fault").isNull())
            .groupBy("_line.file", "_line.time", "_line.split").agg(
                F.count_if(first).alias("n"), F.count("reason").alias("refused"), F.count_if("good").alias("good"),
                F.count("fault").alias("bad"), F.min(F.when(F.col("good"), F.col("header.block_number"))).alias("lo"),
                F.max(F.when(F.col("good"), F.col("header.block_number"))).alias("hi")))


def finish_batches(spark: SparkSession, root: str) -> None:
    """Finish the batches whose plan was stored but not carried out."""
    S.finish_pending(spark, root, _carry_out)


def _carry_out(spark: SparkSession, stage: str, root: str) -> None:
    ready = files.read_json(spark, f"{stage}/_READY")
    for table, plan in ready["plans"].items():
        S.swap_in(spark, f"{root}/{table}", plan)
        if files.exists(spark, f"{stage}/{table}/feed"):
            S.keep_feed(spark, f"{stage}/{table}", f"{root}/{table}", ready["commit"], ready["digest"])
    commits.CommitLog(spark, f"{root}/_commits").record(ready["commit"], ready["digest"], ready["stats"])
    files.delete(spark, stage)


def batch_stats(root: str, spark: SparkSession) -> dict[str, dict]:
    """A-04: the stored statistics of each ``stream-batch``, by one scan."""
    return {f"{r['stream']}-{r['batch']}": r["stats"] for r in stats_table(root, spark).collect()}


def stats_table(root: str, spark: SparkSession) -> DataFrame:
    """A-04: ``(stream, batch, stats)`` of the stored batches, ``stats`` a map."""
    return commits.CommitLog(spark, f"{root}/_commits").table().select(
        "stream", "batch", F.from_json("value", "map<string,bigint>").alias("stats"))


def _dead_letters(df: DataFrame, path: str, stream: str, batch_id: int, digest: str) -> None:
    # Each delivery (stream, batch, content) has a folder of its own and
    # overwrites it: a replay replaces its own dead letters, and nobody else's.
    (df.withColumns({"stream": F.lit(stream), "batch": F.lit(batch_id).cast("bigint"), "delivery": F.lit(digest)})
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("stream", "batch", "delivery").parquet(path))


def start_chain(spark: SparkSession, src: str, root: str, checkpoint: str,
                chain: str | None = None, max_files: int | None = 1, available_now: bool = True,
                tables: tuple[str, ...] = ("blocks", "block_logs", "extrinsics", "events"),
                block_range: tuple[int, int] | None = None, stream: str | None = None,
                known_chains: tuple[str, ...] | None = None, indexes: tuple[str, ...] = ()) -> StreamingQuery:
    """T-01 / T-02 / T-10: one streaming query, for all chains or (``chain``)
    for one, so a slow chain never blocks another. Lines that belong to no
    known chain are not a per-chain stream's: :func:`start_rejects` takes them.
    ``block_range`` keeps only blocks in ``[start, end]`` (back-fill).
    ``stream`` names the query's batches (default: drawn from the
    checkpoint's path)."""
    lines = V.read_block_stream(spark, src, max_files)
    if chain is not None:
        lines = lines.where(chain_key(F.col("chain")) == chain)
    stream = stream or f"{chain or 'all'}-{hashlib.sha1(checkpoint.encode()).hexdigest()[:12]}"

    def body(df: DataFrame, bid: int) -> None:
        if block_range is not None:
            lo, hi = block_range
            df = df.withColumn("polkadot_blocks", F.filter(
                "polkadot_blocks", lambda b: b["header"]["block_number"].between(lo, hi)))
        write_batch(df, bid, root, tables, stream, known_chains, indexes=indexes)

    return _start(lines, body, checkpoint, f"ingest_{chain}" if chain else None, available_now)


def start_rejects(spark: SparkSession, src: str, root: str, checkpoint: str, chains: tuple[str, ...],
                  max_files: int | None = 1, available_now: bool = True, stream: str = "rejects") -> StreamingQuery:
    """The dead letters that no per-chain stream of ``chains`` sees: lines that
    don't parse, have no chain, or name another one."""
    lines = V.read_block_stream(spark, src, max_files).where(
        ~F.coalesce(chain_key(F.col("chain")).isin(*chains), F.lit(False)))

    def body(df: DataFrame, bid: int) -> None:
        write_batch(df, bid, root, (), stream, chains)

    return _start(lines, body, checkpoint, f"ingest_{stream}", available_now)


def start_backfill(spark: SparkSession, archive: str, root: str, checkpoint: str, block_range: tuple[int, int],
                   archive_blocks: int = 100, **options) -> StreamingQuery:
    """T-10: replay blocks ``start..end`` from an archive with a folder
    ``range=<block div archive_blocks>`` per block range. Only the folders of
    the range are listed and read: a few patterns over the folder number, whose
    number grows with its digits, not with the range."""
    lo, hi = (b // archive_blocks for b in block_range)
    src = f"{archive}/{{{','.join(f'range={p}' for p in number_globs(lo, hi))}}}"
    return start_chain(spark, src, root, checkpoint, block_range=block_range, max_files=None, **options)


def number_globs(lo: int, hi: int) -> list[str]:
    """Path patterns that match exactly the numbers ``lo`` to ``hi`` (not
    negative) written in decimal: ``[7-9]``, ``[1-3][0-9]``, ``4[0-2]`` for 7 to 42."""
    out = []
    while lo <= hi:
        # the largest block of numbers that share all digits but the last k + 1
        k = 0
        while lo and lo % 10 ** (k + 1) == 0 and lo + 10 ** (k + 1) - 1 <= hi and len(str(lo + 10 ** (k + 1) - 1)) == len(str(lo)):
            k += 1
        step = 10 ** k
        digit = lo // step % 10
        last = min(9, digit + (hi - lo + 1) // step - 1)
        head = str(lo // (step * 10)) if lo >= step * 10 else ""
        out.append(head + (f"[{digit}-{last}]" if last > digit else str(digit)) + "[0-9]" * k)
        lo += (last - digit + 1) * step
    return out


def _start(lines: DataFrame, body, checkpoint: str, name: str | None, available_now: bool) -> StreamingQuery:
    w = lines.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_to_end(*queries: StreamingQuery) -> None:
    for q in queries:
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()


# --- T-07 / T-08 / T-09: stream analytics -------------------------------------------
def _chain_lines(spark: SparkSession, src: str, max_files: int | None, chain: str | None) -> DataFrame:
    lines = V.read_block_stream(spark, src, max_files)
    return lines if chain is None else lines.where(chain_key(F.col("chain")) == chain)


def event_stream(spark: SparkSession, src: str, max_files: int | None = None, chain: str | None = None) -> DataFrame:
    """Flat events (with event time) from the envelope stream, of all chains or
    of one."""
    env, _ = V.split_valid(_chain_lines(spark, src, max_files, chain))
    good, _ = V.quarantine(V.blocks_of(env))
    return X.extract_events(good.drop(V.SOURCE)).withColumn("t", F.timestamp_millis("block_timestamp"))


def block_stream(spark: SparkSession, src: str, max_files: int | None = None, chain: str | None = None) -> DataFrame:
    env, _ = V.split_valid(_chain_lines(spark, src, max_files, chain))
    good, _ = V.quarantine(V.blocks_of(env))
    return X.extract_headers(good.drop(V.SOURCE)).withColumn("t", F.timestamp_millis("timestamp"))


def per_chain(chains: tuple[str, ...], start: Callable[[str], StreamingQuery]) -> dict[str, StreamingQuery]:
    """T-01: ``start(chain)`` for each chain: independent queries side by side.

    A watermark belongs to a query, and follows the newest event the query has
    seen. In one query over several chains the chain that is ahead would make
    events of a chain that lags late; with one query per chain each has a
    watermark of its own, and a chain that stands still holds up nobody's."""
    return {c: start(c) for c in chains}


def dropped_late(queries: dict[str, StreamingQuery]) -> dict[str, int]:
    """Rows per chain that came after their watermark and were left out, as far
    as Spark's progress reports go back (``spark.sql.streaming.numRecentProgressUpdates``)."""
    return {c: sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in q.recentProgress for op in p["stateOperators"])
            for c, q in queries.items()}


def start_windows(spark: SparkSession, src: str, out: str, checkpoint: str, chain: str, max_files: int | None = 1,
                  available_now: bool = True, bucket_ms: int = 86_400_000, **window) -> StreamingQuery:
    """T-07 for one chain: windowed event counts (``window`` as for
    :func:`events_windowed`) into the keyed table ``out``, which the chains
    share."""
    counts = events_windowed(event_stream(spark, src, max_files, chain), **window)
    body = upsert_sink(out, ["chain", "window_start_ms"], "window_start_ms", bucket_ms, stream=f"windows-{chain}")
    w = counts.writeStream.outputMode("update").foreachBatch(body).option("checkpointLocation", f"{checkpoint}/{chain}")
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def start_dedup(spark: SparkSession, src: str, out: str, checkpoint: str, chain: str, max_files: int | None = 1,
                available_now: bool = True, delay: str = "1 hour") -> StreamingQuery:
    """T-09 for one chain: its blocks without re-deliveries, appended to
    ``<out>/<chain>`` (see :func:`read_chains`)."""
    rows = dedup_blocks(block_stream(spark, src, max_files, chain), delay)
    w = (rows.writeStream.format("parquet").option("path", f"{out}/{files.escape(spark, chain)}")
         .option("checkpointLocation", f"{checkpoint}/{chain}"))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def read_chains(spark: SparkSession, out: str, chains: tuple[str, ...]) -> DataFrame:
    """What the chains' own queries appended, side by side. A folder is read by
    its sink's log, so files of attempts that failed don't show."""
    parts = [spark.read.parquet(f"{out}/{files.escape(spark, c)}") for c in chains]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def events_windowed(events: DataFrame, size: str | None = None, slide: str | None = None,
                    gap: str | None = None, delay: str = "1 hour",
                    by: tuple[str, ...] = ("chain",)) -> DataFrame:
    """T-07: tumbling (``size``), sliding (``size`` + ``slide``) or session
    (``gap``) counts over block time, with a watermark bounding the state."""
    if (size is None) == (gap is None):
        raise ValueError("give either a window size or a session gap")
    w = (F.session_window("t", gap) if gap else
         F.window("t", size, slide) if slide else F.window("t", size))
    return (events.withWatermark("t", delay).groupBy(*by, w.alias("w"))
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(*by, F.unix_millis(F.col("w.start")).alias("window_start_ms"),
                    F.unix_millis(F.col("w.end")).alias("window_end_ms"), "n_events"))


def live_event_counts(events: DataFrame) -> DataFrame:
    """T-08: running counts per (chain, pallet, event) of what is delivered, for
    update mode; a block delivered twice counts twice (see
    :func:`start_live_counts` for counts of what is stored)."""
    return events.groupBy("chain", "mod_name", "event_name").agg(F.count(F.lit(1)).alias("n"))


def start_live_counts(spark: SparkSession, src: str, root: str, out: str, checkpoint: str, by: tuple[str, ...] = ("chain", "mod_name", "event_name"),
                      max_files: int | None = 1, available_now: bool = True, stream: str = "counts",
                      known_chains: tuple[str, ...] | None = None) -> StreamingQuery:
    """T-08: store the events (``<root>/events``) and keep, in the table
    ``out``, their number per group equal to a count over the stored table,
    re-deliveries and changed rows included: each batch's change feed gives
    what rows were before and are now, and the difference is added once. A
    batch's shuffle files go as soon as the step that wrote them ends."""
    keep = [c for c in by if c != "chain"]

    def body(df: DataFrame, bid: int) -> None:
        spark = df.sparkSession  # the stream's own
        spark.conf.set(SHUFFLE_CLEANUP, "true")
        _, digest = commit_batch(df, bid, root, ("events",), stream, known_chains, {"events": keep}, ())
        commit = (f"{stream}-{bid}", digest)
        table = f"{root}/events"
        if files.exists(spark, S.changes_path(table, *commit)):
            feed = S.changes(spark, table, *commit)
            sides = {side: F.when(F.col(side).isNotNull(), F.struct("chain", f"{side}.*")) for side in ("before", "after")}
            S.add_to(S.signed_counts(feed.withColumns(sides), list(by)), out, list(by), "n", *commit)
            S.drop_changes(spark, table, *commit)

    return _start(V.read_block_stream(spark, src, max_files), body, checkpoint, None, available_now)


def dedup_blocks(blocks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """T-09: drop re-delivered blocks (same chain + hash) within the delay."""
    return blocks.withWatermark("t", delay).dropDuplicatesWithinWatermark(["chain", "hash"])


def upsert_sink(root: str, keys: list[str], bucket: str | None = None, width: int = 1, stream: str = "all"):
    """foreachBatch sink for update-mode aggregates: the latest value per key
    across micro-batches (T-07 / T-08 results). The result table is bucketed
    by ``bucket div width`` (a window's start, say), so a batch rewrites only
    the buckets it touches."""
    def body(df: DataFrame, bid: int) -> None:
        if "chain" not in df.columns:
            df = df.withColumn("chain", F.lit("all"))
        slot = F.floor(F.col(bucket) / width) if bucket else F.lit(0)
        rows = (df.withColumn("block_bucket", slot.cast("bigint"))
                .withColumn("_batch_id", F.lit(bid).cast("bigint"))
                .withColumn("_pos", F.lit(0).cast("bigint")))
        S.upsert(rows, root, keys, commit=f"{stream}-{bid}")
    return body
