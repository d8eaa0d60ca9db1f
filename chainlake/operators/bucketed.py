"""The flat tables bucketed by ``(chain, block_number)``.

The path-based Parquet tables carry no bucketing, so joins between them shuffle
both sides. As catalog tables bucketed by block, with the same number of
buckets, blocks, extrinsics and events meet bucket by bucket: no exchange under
the joins, and none under aggregates per block or extrinsic either.

A join on ``(chain, block_number, extrinsic_index)`` needs only the first two
columns to be co-located, which Spark accepts when
``spark.sql.requireAllClusterKeysForCoPartition`` is off; :func:`session` gives
a session with that setting and leaves the caller's as it is.
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession

from . import files

KEYS = ["chain", "block_number"]
_LOCK = threading.Lock()
_SESSIONS: dict[str, SparkSession] = {}


def session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` (same catalog, same SQL options), in which
    joins may use the buckets."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app not in _SESSIONS:
            s = spark.newSession()
            for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"):
                s.conf.set(k, spark.conf.get(k))
            s.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
            s.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
            _SESSIONS[app] = s
        s = _SESSIONS[app]
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return s


def table(spark: SparkSession, rows: DataFrame, path: str, buckets: int) -> DataFrame:
    """The bucketed table at ``path``, written from ``rows`` (with the columns
    ``chain`` and ``block_number``) if it is not there yet. Files of a bucket
    are sorted, so a merge join of single files needs no sort either."""
    name = "chainlake_" + hashlib.sha1(f"{path}|{buckets}".encode()).hexdigest()[:16]
    s = session(spark)
    with _LOCK:
        if not s.catalog.tableExists(name):
            if files.exists(s, f"{path}/_SUCCESS"):
                cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
                s.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY ({', '.join(KEYS)}) SORTED BY ({', '.join(KEYS)}) "
                      f"INTO {buckets} BUCKETS LOCATION '{path}'")
            else:
                files.delete(s, path)
                # one task per bucket writes one file
                (rows.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS).format("parquet")
                 .option("path", path).option("compression", "zstd").saveAsTable(name))
    return s.table(name)
