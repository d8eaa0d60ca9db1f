"""Idempotent upserts on plain Parquet.

Plain Parquet has no MERGE, so an upsert is:

1. keep the last write per key inside the batch (``max_by`` over the row's
   position in its source: file, split, line, block), an aggregate, so a hot
   key is reduced map-side, and write the result once to a staging folder in
   the final layout (partitions, units, sorting, compression, bloom filters);
   everything after reads it from there;
2. find the stored files it can meet. A *unit* is a range of ``UNIT_BLOCKS``
   blocks of a partition; a file holds rows of one unit and its name tells the
   unit and the range of block numbers inside. Units whose new rows lie beside
   all stored ranges (a live chain's usual batch) gain files, without a look
   at stored rows;
3. elsewhere join the stored keys of the overlapping files. Where keys are hit,
   those files (not the unit, not the partition) are written anew with the
   batch's rows in place of theirs; the incoming row replaces the stored one
   whatever batch ids either carries (a new checkpoint, another stream or a
   back-fill starts counting anew), apart from the columns a partial update
   keeps;
4. store the plan (files to move in, files to drop) beside the staged files,
   move the new files in, drop the old ones, record the commit.

A batch written under a commit name (stream and number) is applied once: name
*and content* tell a replay, which changes nothing, from new data under a number
that was used before (a checkpoint that starts anew), which is stored. A plan
that was stored is carried out by whoever comes next, the batch's own retry or
the next upsert of the table, named or not; files move in before others are
dropped. So a failure at any point loses no stored row. One driver process
writes a table at a time; its threads may share it.
"""

from __future__ import annotations

import threading
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits, files
from .files import delete as _delete, exists as _exists, fs_of as _fs, names as _names, rename as _rename  # noqa: F401

PARTITION_COLS = ["chain", "block_bucket"]
ORDER_COLS = ["_batch_id", "_pos"]

# Upsert keys of the stored tables (primary key / unique id of the DDL).
TABLE_KEYS = {
    "blocks": ["chain", "number"],
    "block_logs": ["chain", "id"],
    "extrinsics": ["chain", "id"],
    "events": ["chain", "id"],
    "raw_event": ["chain", "block_number", "index"],
    "transfer": ["chain", "block_number", "index"],
    "withdraw": ["chain", "block_number", "index"],
}


def with_order(df: DataFrame, batch_id: int, pos_col: str | None = None) -> DataFrame:
    """Stamp the hidden ordering columns: ``_pos`` is the row's position in its
    source (``_src``, see ``sources.envelope``) where it is known, else
    ``pos_col`` or the block number (sources without re-deliveries inside one
    batch)."""
    if pos_col is None and "_src" in df.columns:
        pos = F.col("_src")
    else:
        pos = F.col(pos_col or ("block_number" if "block_number" in df.columns else "number")).cast("bigint")
    return df.withColumn("_batch_id", F.lit(batch_id).cast("bigint")).withColumn("_pos", pos).drop("_src")


# N-03 -----------------------------------------------------------------------
def latest(df: DataFrame, keys: list[str], order: list[str] = ORDER_COLS,
           keep_old: list[str] | None = None, first_order: list[str] | None = None) -> DataFrame:
    """Last write wins per key (``ON CONFLICT DO UPDATE``). Columns in
    ``keep_old`` keep the first written value instead (partial update,
    IO-11 / IO-13), ordered by ``first_order`` (default: ``order``). A NULL
    in the winning row wins, as in the reference."""
    keep_old = [c for c in (keep_old or []) if c in df.columns]
    first_order = first_order or order
    hidden = set(order) | set(first_order)
    others = [c for c in df.columns if c not in keys and c not in keep_old and c not in hidden]
    carried = [c for c in order if c in df.columns]
    aggs = [F.max_by(F.struct(*[F.col(c) for c in others + carried]),
                     F.struct(*[F.col(c) for c in order])).alias("_new")]
    if keep_old:
        aggs.append(F.min_by(F.struct(*[F.col(c) for c in keep_old]),
                             F.struct(*[F.col(c) for c in first_order])).alias("_old"))
    out = df.groupBy(*keys).agg(*aggs)
    cols = [F.col(k) for k in keys] + [F.col(f"_new.{c}").alias(c) for c in others + carried]
    cols += [F.col(f"_old.{c}").alias(c) for c in keep_old]
    final = [c for c in df.columns if c not in hidden or c in carried]
    return out.select(*cols).select(*final)


def latest_window(df: DataFrame, keys: list[str], order: list[str] = ORDER_COLS) -> DataFrame:
    """Window form of N-03 (``row_number() = 1``); same result as
    :func:`latest`, kept for comparison in tests and plans."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# IO-12 / IO-18 ----------------------------------------------------------------
def split_new_existing(batch: DataFrame, existing: DataFrame | None, keys: list[str]
                       ) -> tuple[DataFrame, DataFrame]:
    """(keys new to the table, keys already present) for a batch."""
    bkeys = batch.select(*keys).distinct()
    if existing is None:
        return bkeys, bkeys.limit(0)
    ekeys = existing.select(*keys)
    return bkeys.join(ekeys, keys, "left_anti"), bkeys.join(ekeys, keys, "left_semi")


def insert_only(batch: DataFrame, existing: DataFrame | None, keys: list[str]
                ) -> tuple[DataFrame, DataFrame]:
    """INSERT without a conflict clause: rows whose key exists are errors.
    Returns (insertable rows, conflicting rows)."""
    if existing is None:
        return batch, batch.limit(0)
    ekeys = existing.select(*keys)
    return batch.join(ekeys, keys, "left_anti"), batch.join(ekeys, keys, "left_semi")


def upsert_counts(batch: DataFrame, existing: DataFrame | None, keys: list[str]) -> DataFrame:
    """IO-18: how many keys of the batch were inserted vs updated."""
    new, old = split_new_existing(batch, existing, keys)
    return (new.select(F.lit("inserted").alias("action"))
            .unionByName(old.select(F.lit("updated").alias("action")))
            .groupBy("action").agg(F.count(F.lit(1)).alias("n")))


# IO-07 … IO-11, IO-13: the physical upsert -------------------------------------
MAX_RECORDS_PER_FILE = 2_000_000
# Columns looked up by equality although files are sorted by block number
# (min/max statistics cannot prune them): Parquet bloom filters let the
# reader skip row groups for a hash look-up.
BLOOM_COLUMNS = ("hash", "extrinsic_hash", "parent_hash")
UNIT_BLOCKS = 10_000  # block numbers of a unit: what one task writes, and an upsert's least range
MERGE_KEYS = 1_000_000  # keys of a batch that a merge sends to all tasks at once, at most
MERGE_BYTES = 1_000_000  # stored bytes of a unit from which on a merge leaves rows in their places
MERGE_FILES = 8  # stored files of a unit that a merge rewrites one by one; more are put together


def number_column(columns: list[str]) -> str | None:
    """The column that holds a row's block number."""
    return next((c for c in ("block_number", "number") if c in columns), None)


def write_partitioned(df: DataFrame, path: str, mode: str = "overwrite",
                      sort_col: str | None = None, files_per_write: int | None = None,
                      partition_cols: list[str] | None = None, dealt: bool = False) -> None:
    """Write partitioned by (chain, block_bucket). A bucket is a fixed range
    of block numbers, so hashing on the partition columns gives tasks of
    bounded size even when one chain holds most rows (no sampling pass as a
    range shuffle would need). Rows are sorted by the block key inside each
    file, so Parquet min/max statistics prune point look-ups, and files are
    capped at ``MAX_RECORDS_PER_FILE`` rows. ``dealt``: the rows lie in ranges of
    blocks already and are not shuffled."""
    parts = partition_cols or PARTITION_COLS
    key = sort_col or number_column(df.columns)
    # Repartition by columns (no fixed count) so AQE sizes the write tasks
    # at run time; ``files_per_write`` pins the count when asked.
    lead = [files_per_write] if files_per_write else []
    # a large bucket is split into units of UNIT_BLOCKS blocks, each written by
    # its own task (several bounded files per partition)
    unit = [F.floor(F.col(key) / UNIT_BLOCKS)] if key is not None else []
    df = df if dealt else df.repartition(*lead, *dict.fromkeys([*PARTITION_COLS, *parts][:2]), *unit)
    df = df.sortWithinPartitions(*dict.fromkeys(parts), *([key] if key is not None else []))
    _writer(df).mode(mode).partitionBy(*parts).parquet(path)


def _writer(df: DataFrame):
    w = (df.write.option("partitionOverwriteMode", "dynamic")
         .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).option("compression", "zstd"))
    # filters are as large as a file's values need, else each takes 1 MB whatever the file's size
    w = w.option("parquet.bloom.filter.adaptive.enabled", "true")
    for c in BLOOM_COLUMNS:
        if c in df.columns:
            w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return w


_LOCKS: dict[str, threading.RLock] = defaultdict(threading.RLock)  # per table or lake, of this process
_ACTIVE: set[str] = set()  # staging folders that a thread of this process is at work in


def upsert(batch: DataFrame, path: str, keys: list[str], keep_old: list[str] | None = None,
           commit: str | None = None, digest: str | None = None, feed: list[str] | None = None,
           dealt: bool = False) -> dict:
    """Merge ``batch`` (stamped by :func:`with_order`) into the Parquet table at
    ``path``. Columns in ``keep_old`` keep their first written value, inside
    the batch too. ``commit`` names the batch (its stream and number): under a
    name, the same content (``digest``, computed if not given) is applied
    exactly once, see the module's docstring. ``feed``: columns whose values
    before and after the batch are kept for :func:`changes`. ``dealt``: the rows
    lie in ranges of blocks already and are not shuffled by unit again. Returns
    the number of keys inserted and updated (IO-18)."""
    spark = batch.sparkSession
    order = keep_old or []
    finish_pending(spark, path)
    log = commits.CommitLog(spark, f"{path}__commits") if commit else None
    if log and log.maybe_known(commit):
        digest = digest or commits.content_digest(deduplicated(batch, keys, order))
        done = log.find(commit, digest)
        if done is not None:
            return done
    stage = f"{path}__staging/{uuid.uuid4().hex}"
    _ACTIVE.add(stage)
    try:
        staged = _stage(batch, keys, order, stage, digest=log is not None and digest is None, dealt=dealt)
        digest = digest or staged["digest"]
        with _LOCKS[path]:
            plan = plan_swap(spark, path, staged, keys, order, feed)
            files.write_json(spark, f"{stage}/_READY", plan | {"commit": commit, "digest": digest})
            _carry_out(spark, stage, path)
    finally:
        _ACTIVE.discard(stage)
    return plan["counts"]


def finish_pending(spark: SparkSession, path: str, carry_out=None) -> None:
    """Carry out the plans that were stored for the table at ``path`` but not
    finished, and drop the remains of attempts without one."""
    with _LOCKS[path]:
        for name in _names(spark, f"{path}__staging"):
            stage = f"{path}__staging/{name}"
            if stage in _ACTIVE:
                continue
            if _exists(spark, f"{stage}/_READY"):
                (carry_out or _carry_out)(spark, stage, path)
            else:
                _delete(spark, stage)


def _carry_out(spark: SparkSession, stage: str, path: str) -> None:
    plan = files.read_json(spark, f"{stage}/_READY")
    swap_in(spark, path, plan)
    if plan["commit"]:
        if _exists(spark, f"{stage}/feed"):
            keep_feed(spark, stage, path, plan["commit"], plan["digest"])
        commits.CommitLog(spark, f"{path}__commits").record(plan["commit"], plan["digest"], plan["counts"])
    _delete(spark, stage)


def swap_in(spark: SparkSession, path: str, plan: dict) -> None:
    """Move the plan's new files into the table, then drop those they replace.
    Repeatable: what was moved is no longer in the staging folder."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    for src, dst in plan["moves"]:
        if _exists(spark, src):
            _rename(spark, src, dst)
    for name in plan["drops"]:
        _delete(spark, name)


def deduplicated(batch: DataFrame, keys: list[str], keep_old: list[str]) -> DataFrame:
    """The batch's last row per key, without the hidden position."""
    return latest(batch, keys, order=["_pos"], keep_old=keep_old, first_order=["_pos"]).drop("_pos")


def _stage(batch: DataFrame, keys: list[str], keep_old: list[str], stage: str, digest: bool = False,
           dealt: bool = False) -> dict:
    """Write the batch's last row per key below ``<stage>/data/new``, in the final
    layout; what was staged, as :func:`plan_swap` takes it, with a digest of the
    rows if asked. Rows are shuffled once, by unit: a key lies in one unit, so
    the last row per key is found where the unit is written. Rows that are
    ``dealt`` out by block are not, if their keys hold the block."""
    number = number_column(batch.columns)
    place = [*PARTITION_COLS, "_unit"]
    units = batch.withColumn("_unit", _unit_of(number))
    if not dealt:
        units = units.repartition(*place)
    new = deduplicated(units, list(dict.fromkeys([*place, *keys])), keep_old).select(
        *[c for c in batch.columns if c != "_pos"], "_unit")
    _writer(new.sortWithinPartitions(*place, *([number] if number else []))).partitionBy(*place).parquet(f"{stage}/data/new")
    staged = {"stage": stage, "schema": new.drop("_unit").schema, "number": number}
    rows = _units(staged_rows(batch.sparkSession, staged), number, digest)
    sums = {k: sum(int(u[k] or 0) for u in rows) for k in ("_n", "_h1", "_h2")} if digest else None
    return staged | {"units": rows, "digest": commits.digest_of(sums) if digest else None}


def staged_rows(spark: SparkSession, staged: dict, part: str = "new") -> DataFrame:
    """Staged rows read back, without the unit folders' column."""
    schema = staged["schema"]
    return spark.read.schema(schema).parquet(f"{staged['stage']}/data/{part}").select(*schema.names)


def plan_swap(spark: SparkSession, path: str, staged: dict, keys: list[str], keep_old: list[str],
              feed: list[str] | None = None, by_block: bool = False) -> dict:
    """How the table at ``path`` takes in what was staged: files to move, files
    to drop, keys inserted and updated. Merged units are written below
    ``<stage>/data/merged`` and, where stored rows stay in their places,
    ``<stage>/data/rest<i>`` (see :func:`_rest_in_place`). ``by_block``: the keys
    hold the block number inside an id, not as a column."""
    stage, schema, number, gained = staged["stage"], staged["schema"], staged["number"], staged["units"]
    by_block = by_block or number in keys
    new = staged_rows(spark, staged)
    total = sum(u["n"] for u in gained)
    # stored files that may hold keys of the batch
    stored = {b: _unit_files(spark, f"{path}/{files.partition_folder(spark, list(zip(PARTITION_COLS, b)))}")
              for b in {u["bucket"] for u in gained}}
    meets = {}
    for u in gained:
        hit = [f for f in stored[u["bucket"]]
               if f["unit"] is None or f["unit"] == u["unit"] and f["lo"] <= u["hi"] and u["lo"] <= f["hi"]]
        if hit:
            meets[u["bucket"], u["unit"]] = hit
    updated, drops, moves, found = 0, [], [], None
    tag = uuid.uuid4().hex[:8]

    def moves_of(part):
        return _moves(spark, f"{stage}/data/{part}", path, _units(staged_rows(spark, staged, part), number), tag)

    def inside(units):
        return F.concat_ws("|", *PARTITION_COLS, _unit_of(number)).isin(
            sorted("|".join(str(v) for v in (*b, u)) for b, u in units))
    if meets:
        if feed is None:
            old = _files_of(spark, path, schema, {f["path"] for hit in meets.values() for f in hit})
            hit_rows = new.join(old.select(*keys), keys).select(*PARTITION_COLS, _unit_of(number).alias("_unit"))
        else:
            hit_rows = found = _look_up(spark, path, staged, keys, feed, meets, by_block, inside)
        hits = hit_rows.groupBy(*PARTITION_COLS, "_unit").agg(F.count(F.lit(1)).alias("n")).collect()
        updated = sum(r["n"] for r in hits)
        conflict = {((r["chain"], r["block_bucket"]), r["_unit"]) for r in hits}
        # a file of several units (written by others) is replaced whole
        drops = sorted({f["path"] for c in conflict for f in meets[c]})
    if drops:
        replaced = _files_of(spark, path, schema, drops)
        kept_places, shuffled = _rest_in_place([u for u in gained if (u["bucket"], u["unit"]) in conflict], meets, by_block)
        # beside stored rows in their places the batch's rows are moved in as staged, unless columns keep old values
        beside = set() if keep_old else {u for _, units in kept_places for u in units}
        rows = new.where(inside(conflict - beside))
        if keep_old:
            kept = replaced.select(*keys, F.struct(*keep_old).alias("_old"))
            rows = rows.join(kept, keys, "left").withColumns({
                c: F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(c)) for c in keep_old}).drop("_old")
        rows = rows.select(*schema.names)
        for i, (names, units) in enumerate(kept_places):
            mine = new.where(inside(units)).select(*keys)
            rest = _files_of(spark, path, schema, names).join(F.broadcast(mine), keys, "left_anti").select(*schema.names)
            _write_units(rest, f"{stage}/data/rest{i}", number, dealt=True)
            moves += moves_of(f"rest{i}")
        if shuffled:
            rest = _files_of(spark, path, schema, shuffled).join(new.select(*keys), keys, "left_anti")
            rows = rows.unionByName(rest.select(*schema.names))
        if conflict - beside:
            _write_units(rows, f"{stage}/data/merged", number)
            moves += moves_of("merged")
        gained = [u for u in gained if (u["bucket"], u["unit"]) not in conflict - beside]
    if feed is not None:
        rows = new.select(*keys, F.struct(*feed).alias("after"))
        kind = rows.schema["after"].dataType
        rows = (rows.join(found.select(*keys, "before"), keys, "left") if found is not None
                else rows.withColumn("before", F.lit(None).cast(kind)))
        rows.write.parquet(f"{stage}/feed")
    return {"moves": _moves(spark, f"{stage}/data/new", path, gained, tag) + moves, "drops": drops,
            "counts": {"inserted": total - updated, "updated": updated}}


def _rest_in_place(units: list[dict], meets: dict, by_block: bool) -> tuple[list[tuple[list[str], list]], list[str]]:
    """How the stored rows of conflicting ``units`` lose the keys that a batch
    brings: groups of files, with their buckets and units, that are each written
    anew where they are read, since the group's keys (``MERGE_KEYS`` at
    most) fit into every task; and the files whose rows are shuffled and put
    together with the batch's. These are small units, units of many files or
    keys, files that hold several units, and tables whose keys (not
    ``by_block``) don't hold the block number."""
    def together(hit):
        return sum(f["size"] for f in hit) < MERGE_BYTES or len(hit) > MERGE_FILES
    return _key_groups(units, meets, {f["path"] for u in units for hit in (meets[u["bucket"], u["unit"]],)
                                      if not by_block or together(hit) for f in hit})


def _key_groups(units: list[dict], meets: dict, others: set[str]) -> tuple[list[tuple[list[str], list]], list[str]]:
    """Groups of stored files, with their buckets and units, that a batch brings
    ``MERGE_KEYS`` keys at most; and the files whose keys are joined instead:
    ``others``, those of a unit of more keys, and files that hold several units."""
    groups, shuffled, left = [], set(others), 0
    for u in units:
        hit = meets[u["bucket"], u["unit"]]
        if u["n"] > MERGE_KEYS or any(f["unit"] is None for f in hit):
            shuffled |= {f["path"] for f in hit}
    for u in units:
        names = [f["path"] for f in meets[u["bucket"], u["unit"]]]
        if shuffled.intersection(names):
            shuffled |= set(names)
            continue
        if not groups or u["n"] > left:
            groups.append(([], []))
            left = MERGE_KEYS
        groups[-1][0].extend(names)
        groups[-1][1].append((u["bucket"], u["unit"]))
        left -= u["n"]
    return groups, sorted(shuffled)


def _look_up(spark: SparkSession, path: str, staged: dict, keys: list[str], columns: list[str], meets: dict,
             by_block: bool, inside) -> DataFrame:
    """The batch's keys that are stored, with their place and, as ``before``, what
    is stored in ``columns``; written below ``<stage>/found<i>``. Where keys hold
    the block number, stored rows are not shuffled for it (see :func:`_key_groups`)."""
    place = [F.col(c) for c in PARTITION_COLS if c not in keys] + [_unit_of(staged["number"]).alias("_unit")]
    new = staged_rows(spark, staged)
    met = [u for u in staged["units"] if (u["bucket"], u["unit"]) in meets]
    every = {f["path"] for hit in meets.values() for f in hit}
    groups, joined = _key_groups(met, meets, set() if by_block else every)
    parts = [(names, F.broadcast(new.where(inside(units)).select(*keys, *place))) for names, units in groups]
    if joined:
        parts.append((joined, new.select(*keys, *place)))
    for i, (names, mine) in enumerate(parts):
        old = _files_of(spark, path, staged["schema"], names).select(*keys, F.struct(*columns).alias("before"))
        found = mine.join(old, keys)
        found.write.parquet(f"{staged['stage']}/found{i}")
    return spark.read.schema(found.schema).parquet(*[f"{staged['stage']}/found{i}" for i in range(len(parts))])


def _files_of(spark: SparkSession, path: str, schema, names) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(*sorted(names))


def _unit_of(number: str | None) -> F.Column:
    return F.floor(F.col(number) / UNIT_BLOCKS).cast("bigint") if number else F.lit(0).cast("bigint")


def _write_units(rows: DataFrame, path: str, number: str | None, dealt: bool = False) -> None:
    write_partitioned(rows.withColumn("_unit", _unit_of(number)), path, partition_cols=[*PARTITION_COLS, "_unit"], dealt=dealt)


def _units(rows: DataFrame, number: str | None, digest: bool = False) -> list[dict]:
    """Rows and block range of each unit written (and the sums of a digest):
    one entry per staged folder."""
    at = F.col(number) if number else F.lit(0)
    got = rows.groupBy(*PARTITION_COLS, _unit_of(number).alias("_unit")).agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"),
        *(commits.digest_columns(commits.hashable(rows)) if digest else [])).collect()
    return [r.asDict() | {"bucket": (r["chain"], r["block_bucket"]), "unit": r["_unit"]} for r in got]


def _unit_files(spark: SparkSession, folder: str) -> list[dict]:
    """The data files of a partition; unit and block range by name, None for
    files that were not named by an upsert."""
    out = []
    for name, size in files.data_sizes(spark, folder).items():
        tag = name.split("_", 4)
        known = name.startswith("unit_") and len(tag) == 5
        unit, lo, hi = (int(v) for v in tag[1:4]) if known else (None, None, None)
        out.append({"path": f"{folder}/{name}", "unit": unit, "lo": lo, "hi": hi, "size": size})
    return out


def _moves(spark: SparkSession, staged: str, path: str, units: list[dict], tag: str) -> list[list[str]]:
    """(staged file, place in the table) of every file of ``units``."""
    out = []
    for u in units:
        folder = files.partition_folder(spark, list(zip(PARTITION_COLS, u["bucket"])))
        src = f"{staged}/{folder}/_unit={u['unit']}"
        for name in files.data_files(spark, src):
            out.append([f"{src}/{name}", f"{path}/{folder}/unit_{u['unit']}_{u['lo']}_{u['hi']}_{tag}-{name}"])
    return out


# T-08: what a batch changed ------------------------------------------------------
def keep_feed(spark: SparkSession, stage: str, path: str, commit: str, digest: str) -> None:
    """Move a staged change feed to where :func:`changes` finds it."""
    target = changes_path(path, commit, digest)
    _delete(spark, target)
    _rename(spark, f"{stage}/feed", target)


def changes_path(path: str, commit: str, digest: str) -> str:
    return f"{path}__changes/{commit}.{digest}"


def changes(spark: SparkSession, path: str, commit: str, digest: str) -> DataFrame:
    """The change feed of one commit: the keys, and ``before`` (NULL where the
    key is new) and ``after`` with the columns that :func:`upsert` was asked to
    feed. It stays until :func:`drop_changes`."""
    return spark.read.parquet(changes_path(path, commit, digest))


def drop_changes(spark: SparkSession, path: str, commit: str, digest: str) -> None:
    _delete(spark, changes_path(path, commit, digest))


def signed_counts(feed: DataFrame, by: list[str], out: str = "n") -> DataFrame:
    """By how much a change feed moves the row count of each group: one for a
    row's new values, less one for those it had."""
    sides = F.array(F.struct(F.col("after").alias("row"), F.lit(1).alias("sign")),
                    F.struct(F.col("before").alias("row"), F.lit(-1).alias("sign")))
    moved = feed.select(F.explode(sides).alias("s")).where("s.row is not null")
    return (moved.groupBy(*[F.col(f"s.row.{c}").alias(c) for c in by]).agg(F.sum("s.sign").cast("bigint").alias(out))
            .where(F.col(out) != 0))


def add_to(deltas: DataFrame, path: str, keys: list[str], value: str, commit: str, digest: str) -> dict:
    """Add ``deltas(keys, value)`` to a table of sums, exactly once per commit:
    a replay finds the commit recorded. Groups that fall to zero stay, as zero."""
    spark = deltas.sparkSession
    if "chain" not in deltas.columns:
        deltas = deltas.withColumn("chain", F.lit("all"))
    rows = deltas.withColumn("block_bucket", F.lit(0).cast("bigint"))
    with _LOCKS[path]:
        finish_pending(spark, path)
        if _exists(spark, path):
            had = spark.read.schema(rows.schema).parquet(path).select(*keys, F.col(value).alias("_had"))
            rows = rows.join(had, keys, "left").withColumn(value, F.col(value) + F.coalesce("_had", F.lit(0))).drop("_had")
        return upsert(with_order(rows.withColumn("_at", F.lit(0)), 0, "_at").drop("_at"), path, keys, commit=commit, digest=digest)


# IO-16 / IO-17 ------------------------------------------------------------------
def fan_out(batch: DataFrame, sinks: dict, on_error: str = "continue") -> DataFrame:
    """Write one batch to several sinks. A sink is a function of the batch
    that returns how many rows it holds after the write, read back.
    ``on_error='continue'`` logs and swallows a sink error like the engine
    controller; ``'stop'`` aborts the remaining sinks like the node fan-out.
    Returns one status row per sink (sink, rows, status)."""
    rows = []
    stopped = False
    for name, fn in sinks.items():
        if stopped:
            rows.append((name, 0, "skipped"))
            continue
        try:
            rows.append((name, int(fn(batch) or 0), "ok"))
        except Exception as err:  # noqa: BLE001 - policy decides
            rows.append((name, 0, f"error: {type(err).__name__}"))
            stopped = on_error == "stop"
    return batch.sparkSession.createDataFrame(rows, "sink string, rows bigint, status string")
