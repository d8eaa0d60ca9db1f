"""Secondary index of a block table by a hash column (D-01).

An index row says where the blocks with a hash are: ``(hash, chain, at_bucket,
at_block)``. Rows stand in ``<root>/index_<column>``, partitioned like every
table here by ``(chain, block_bucket)``, the bucket being the hash's first
byte: a look-up opens the folder of one byte and then one partition of the
block table, instead of a footer and a bloom filter of each of its files.

New rows are appended as one file a batch to the bucket ``RECENT`` and folded
into the folders of their bytes after ``FOLD`` files, so batches leave no
hundreds of tiny files. Rows are never updated: a look-up compares the block it
finds with the hash, so rows of replaced blocks do no harm.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from . import sink as S

RECENT = -1
FOLD = 64
SCHEMA = "hash string, at_bucket bigint, at_block bigint, chain string, block_bucket bigint"


def index_path(root: str, column: str) -> str:
    return f"{root}/index_{column}"


def prefix_of(hash_text) -> F.Column:
    """The first byte of a ``0x`` hash."""
    return F.conv(F.substring(hash_text, 3, 2), 16, 10).cast("bigint")


def entries(blocks: DataFrame, column: str, recent: bool) -> DataFrame:
    """Index rows of ``blocks(chain, block_bucket, number, <column>)``."""
    bucket = F.lit(RECENT).cast("bigint") if recent else prefix_of(F.col(column))
    return blocks.where(F.col(column).isNotNull()).select(
        F.col(column).alias("hash"), F.col("block_bucket").cast("bigint").alias("at_bucket"),
        F.col("number").cast("bigint").alias("at_block"), "chain", bucket.alias("block_bucket"))


def _write(rows: DataFrame, path: str) -> None:
    (rows.repartition("chain", "block_bucket").sortWithinPartitions("chain", "block_bucket", "hash")
     .write.option("compression", "zstd").option("parquet.bloom.filter.enabled#hash", "true")
     .partitionBy("chain", "block_bucket").parquet(path))


def _plan(spark: SparkSession, staged: str, path: str, drops: list[str]) -> dict:
    tag, moves = uuid.uuid4().hex[:8], []
    for chain in files.data_files(spark, staged):
        for bucket in files.data_files(spark, f"{staged}/{chain}"):
            for name in files.data_files(spark, f"{staged}/{chain}/{bucket}"):
                moves.append([f"{staged}/{chain}/{bucket}/{name}", f"{path}/{chain}/{bucket}/{tag}-{name}"])
    return {"moves": moves, "drops": drops, "counts": {}}


def plan_append(spark: SparkSession, blocks: DataFrame, root: str, column: str, stage: str) -> dict:
    """Stage the index rows of a batch of blocks; the plan that adds them."""
    _write(entries(blocks, column, recent=True), f"{stage}/data/index")
    return _plan(spark, f"{stage}/data/index", index_path(root, column), [])


def build(blocks: DataFrame, root: str, column: str) -> None:
    """The index of a whole block table, written into the folders of its bytes."""
    _write(entries(blocks, column, recent=False), index_path(root, column))


def fold(spark: SparkSession, root: str, column: str, least: int = FOLD) -> int:
    """Move the recent rows of chains with ``least`` recent files or more into
    the folders of their first bytes; how many files went. Repeatable: the plan
    is stored before it is carried out."""
    path = index_path(root, column)
    with S._LOCKS[path]:
        S.finish_pending(spark, path, _carry_out)
        old = []
        for chain in files.data_files(spark, path):
            folder = f"{path}/{chain}/block_bucket={RECENT}"
            names = files.data_files(spark, folder)
            old += [f"{folder}/{n}" for n in names] if len(names) >= least else []
        if not old:
            return 0
        stage = f"{path}__staging/{uuid.uuid4().hex}"
        rows = spark.read.schema(SCHEMA).option("basePath", path).parquet(*old)
        _write(rows.distinct().withColumn("block_bucket", prefix_of(F.col("hash"))), f"{stage}/data/index")
        files.write_json(spark, f"{stage}/_READY", _plan(spark, f"{stage}/data/index", path, old))
        _carry_out(spark, stage, path)
        return len(old)


def _carry_out(spark: SparkSession, stage: str, path: str) -> None:
    S.swap_in(spark, path, files.read_json(spark, f"{stage}/_READY"))
    files.delete(spark, stage)


def read(spark: SparkSession, root: str, column: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(index_path(root, column))


def find(spark: SparkSession, root: str, column: str, value: str) -> DataFrame:
    """``(chain, at_bucket, at_block)`` of the blocks with a hash: a scan of the
    folder of its first byte and of the recent rows."""
    try:
        prefix = int(value[2:4], 16)
    except ValueError:
        prefix = None
    hit = F.col("block_bucket").isin([RECENT] + ([] if prefix is None else [prefix])) & (F.col("hash") == value)
    return read(spark, root, column).where(hit).select("chain", "at_bucket", "at_block").distinct()


def lookup(spark: SparkSession, root: str, blocks: DataFrame, column: str, value: str) -> DataFrame:
    """The rows of ``blocks`` whose ``column`` is ``value``. The places (a
    handful: blocks of one hash, or of one parent) become literals, so the scan
    of the block table is pruned to their partitions and row groups."""
    places = find(spark, root, column, value).collect()
    at = [(F.col("chain") == p.chain) & (F.col("block_bucket") == p.at_bucket) & (F.col("number") == p.at_block) for p in places]
    return blocks.where(reduce(lambda a, b: a | b, at, F.lit(False)) & (F.col(column) == value))
