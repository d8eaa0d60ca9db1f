"""The chain lake: stored tables under one root.

Layout ``<root>/<table>/chain=<c>/block_bucket=<n>/part-*.parquet``. The
root lives under the shared ``spark.checkpoint.dir`` so every executor sees
it. ``lake_for`` ingests the fixture chain derived from ``events`` once per
process and data folder (the batch form of the ingest stream), then every
analytic reads Parquet with partition pruning and pushed filters.
"""

from __future__ import annotations

import hashlib
import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import extract as X
from .operators import analytics as A
from .operators import bucketed, files, hash_index, rollups
from .operators.files import delete as _delete, exists as _exists, fs_of as _fs, names as _names
from .operators.sink import UNIT_BLOCKS, with_order, write_partitioned
from .session import checkpoint_dir
from .sources import fixture
from .tables import PARSED, TABLES, schema_of

STORED = ("blocks", "block_logs", "extrinsics", "events", "raw_event")
LAKE_VERSION = "v8"
FIXTURE_CHAINS = ("polkadot", "kusama")


class ChainLake:
    STORED = STORED
    DERIVED = ("transfers", "withdrawals")

    def __init__(self, spark: SparkSession, root: str, sf_dir: str | None = None):
        self.spark = spark
        self.root = root
        self.sf_dir = sf_dir

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, chain: str | None = None, parsed: bool = False) -> DataFrame:
        """A stored table, of all chains or of one (pruned at scan); ``parsed``:
        with the VARIANT column of its JSON."""
        if name == "transfers":
            return X.extract_transfers(self.table("events", chain, parsed=True))
        if name == "withdrawals":
            return X.extract_withdrawals(self.table("events", chain, parsed=True))
        if name == "raw_event":
            self._raw_events()
        df = self.spark.read.schema(schema_of(name, parsed)).parquet(self.path(name))
        if chain is not None:
            df = df.where(F.col("chain") == chain)
        return df

    def chains(self, table: str = "blocks") -> set[str]:
        """Chains stored, from the ``chain=`` folder names (no data read)."""
        return {n.split("=", 1)[1] for n in _names(self.spark, self.path(table)) if n.startswith("chain=")}

    def version(self) -> str:
        """Changes with every commit to the lake: the names of its latest
        commits (a listing of two small folders)."""
        log = f"{self.root}/_commits"
        return "|".join([*_names(self.spark, f"{log}/folded"), *_names(self.spark, f"{log}/recent"), str(_exists(self.spark, f"{self.root}/_DONE"))])

    def source(self, name: str) -> DataFrame:
        """A driver input table of the data folder (e.g. ``events``)."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def envelopes(self) -> str:
        """JSON-lines envelope files of the fixture chains (both chains plus
        the malformed lines), written once next to the tables."""
        return envelope_files(self.spark, self.sf_dir, self.root)

    def _raw_events(self) -> None:
        """Store the legacy raw events (of one chain) when they are first read:
        most of a row are hashes, which no other table needs. Events are
        dealt out by block before the hashes are derived."""
        path = self.path("raw_event")
        with _LOCK:
            # writes that replace partitions leave no _SUCCESS
            if self.sf_dir and not _exists(self.spark, f"{path}/_built"):
                raw = fixture.raw_event_rows(fixture.block_ranges(self.source("events"))).withColumn("chain", F.lit("polkadot")) \
                    .withColumn("block_bucket", X.block_bucket("block_number"))
                write_partitioned(with_order(raw, 0).drop("_pos"), path, dealt=True)
                files.write_json(self.spark, f"{path}/_built", {})

    def indexed(self, column: str) -> str:
        """The root of the lake, with the index of the blocks' hash column
        ``column`` built once beside the tables."""
        with _LOCK:
            done = f"{self.root}/index_{column}/_SUCCESS"
            if not _exists(self.spark, done):
                _delete(self.spark, hash_index.index_path(self.root, column))
                hash_index.build(self.table("blocks"), self.root, column)
        return self.root

    def bucketed(self, name: str, buckets: int = 64) -> DataFrame:
        """A stored table bucketed by block (``blocks``: its number is called
        ``block_number``), built once beside the tables; of the session that
        ``operators.bucketed`` holds."""
        rows = self.table(name, parsed=True).drop("block_bucket", "_batch_id")
        rows = rows.withColumnRenamed("number", "block_number") if name == "blocks" else rows
        return bucketed.table(self.spark, rows, f"{self.root}/bucketed_{buckets}/{name}", buckets)

    def sketches(self) -> DataFrame:
        """The daily sketches of the blocks, built once."""
        path = f"{self.root}/daily_sketches"
        with _LOCK:
            if not _exists(self.spark, f"{path}/_built"):
                blocks = self.table("blocks")
                prev = A.prev_in_order(blocks.select("chain", "number", "timestamp"), ["chain"], "number", ["timestamp"])
                rollups.store(rollups.daily_sketches(blocks, prev.withColumn(
                    "interval_ms", F.col("timestamp") - F.col("prev_timestamp"))), path)
                files.write_json(self.spark, f"{path}/_built", {})
        return rollups.read(self.spark, path)

    def register(self, chain: str | None = None, spark: SparkSession | None = None) -> None:
        """Temp views for SQL, over one chain (Q-01) or all."""
        view_lake = ChainLake(spark or self.spark, self.root, self.sf_dir)
        for name in self.STORED + self.DERIVED:
            view_lake.table(name, chain).createOrReplaceTempView(name)


def ingest_blocks(blocks: DataFrame, root: str, batch_id: int = 0, dealt: bool = False) -> None:
    """Batch ingest: nested blocks -> the four stored tables (IO-15 order:
    header, logs, extrinsics, events). The nested rows are built once, as a
    table in the shared folder that the four extractions read, so a lost
    executor costs no rebuild; it is dropped at the end. Blocks that are
    ``dealt`` out by ranges of their numbers are not stored: each table derives
    its own part of them and is written where its rows lie, so only what the
    blocks are made of is shuffled."""
    spark = blocks.sparkSession
    nested = f"{root}/_nested"
    if not dealt:
        blocks.write.mode("overwrite").option("compression", "zstd").parquet(nested)
    steps = [("blocks", X.extract_headers, "number"), ("block_logs", X.extract_logs, None),
             ("extrinsics", X.extract_extrinsics, None), ("events", X.extract_events, None)]

    def one(step):
        name, fn, pos = step
        options = {"parsed": True} if name in PARSED else {}
        source = blocks if dealt else spark.read.schema(blocks.schema).parquet(nested)
        rows = with_order(fn(source, **options), batch_id, pos)
        write_partitioned(rows.drop("_pos"), f"{root}/{name}", dealt=dealt)
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        list(pool.map(one, steps))
    if not dealt:
        _delete(spark, nested)


def create_tables(spark: SparkSession, root: str) -> None:
    """IO-19: the empty tables of the layout, ready to be read and upserted."""
    for name, schema in TABLES.items():
        if not _exists(spark, f"{root}/{name}"):
            write_partitioned(spark.createDataFrame([], schema), f"{root}/{name}")
            fs, p = _fs(spark, f"{root}/{name}")
            fs.mkdirs(p)


_LOCK = threading.Lock()
_LAKES: dict[tuple[str, str], ChainLake] = {}


def source_files(spark: SparkSession, sf_dir: str, table: str = "events") -> list[str]:
    """Name, size and time of the source's files: other data, another lake."""
    fs, p = _fs(spark, f"{sf_dir}/{table}.parquet")
    return sorted(f"{st.getPath().getName()} {st.getLen()} {st.getModificationTime()}" for st in fs.listStatus(p))


def lake_root(spark: SparkSession, sf_dir: str, tag: str = "lake") -> str:
    key = "|".join([sf_dir, LAKE_VERSION, *source_files(spark, sf_dir)])
    digest = hashlib.sha1(key.encode()).hexdigest()[:12]
    return f"{checkpoint_dir(spark)}/chainlake/{tag}-{digest}"


def envelope_files(spark: SparkSession, sf_dir: str, root: str | None = None) -> str:
    """The envelope files of ``sf_dir`` (see :meth:`ChainLake.envelopes`), which need
    none of the stored tables."""
    sf_dir = sf_dir.rstrip("/")
    path = f"{root or lake_root(spark, sf_dir)}/envelopes"
    with _LOCK:
        if not _exists(spark, f"{path}/_SUCCESS"):
            fixture.write_envelope_files(spark.read.parquet(f"{sf_dir}/events.parquet"), path, FIXTURE_CHAINS)
    return path


def lake_for(spark: SparkSession, sf_dir: str) -> ChainLake:
    """Ingest the fixture chain of ``sf_dir`` once, then reuse it."""
    sf_dir = sf_dir.rstrip("/")
    root = lake_root(spark, sf_dir)
    key = (root, sf_dir)
    with _LOCK:
        lake = _LAKES.get(key)
        if lake is not None:
            return ChainLake(spark, root, sf_dir)
        if not _exists(spark, f"{root}/_DONE"):
            events = spark.read.parquet(f"{sf_dir}/events.parquet")
            ranges = fixture.block_ranges(events, task_events=UNIT_BLOCKS * fixture.EVENTS_PER_BLOCK)
            ingest_blocks(fixture.nested_blocks(ranges, FIXTURE_CHAINS), root, dealt=True)
            spark.createDataFrame([(LAKE_VERSION,)], "v string").coalesce(1) \
                .write.mode("overwrite").text(f"{root}/_DONE")
        lake = ChainLake(spark, root, sf_dir)
        _LAKES[key] = lake
        return lake
