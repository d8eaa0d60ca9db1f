"""Which batches a table (or a lake) holds: one compact commit log.

A commit is named by its stream and batch number, ``<stream>-<batch>``, and by
its content: a digest of what the batch delivered. Batch numbers restart with a
new checkpoint, so the name alone doesn't tell a replay from new data; name and
digest do.

Recent commits are one small file each; after ``FOLD`` of them they are folded
into one Parquet table (a new version is written whole before the old files
go), so a folder never holds more than a few dozen files and statistics are
read by one scan. One driver process writes a log at a time; its threads may
share it.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

FOLD = 64  # recent commits that are folded into the table
SCHEMA = "name string, stream string, batch bigint, digest string, value string"

_LOCKS: dict[str, threading.RLock] = {}
_HEADS: dict[str, dict[str, int]] = {}
_GUARD = threading.Lock()


def content_digest(rows: DataFrame) -> str:
    """Digest of a table's rows whatever their order: their number and two sums
    of row hashes."""
    return digest_of(rows.agg(*digest_columns(hashable(rows))).first())


def hashable(rows: DataFrame) -> list[str]:
    """The columns of a digest: all but VARIANT ones, which are parsed from others."""
    return [c for c, kind in rows.dtypes if kind != "variant"]


def digest_columns(columns: list[str]) -> list:
    """The aggregates that :func:`digest_of` turns into a digest."""
    cols = [F.col(f"`{c}`") for c in sorted(columns)]
    return [F.count(F.lit(1)).alias("_n"),
            *[F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")).alias(f"_h{seed}") for seed in (1, 2)]]


def digest_of(row) -> str:
    return "-".join(f"{int(v or 0) % (1 << 64):x}" for v in (row["_n"], row["_h1"], row["_h2"]))


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        with _GUARD:
            self.lock = _LOCKS.setdefault(self.root, threading.RLock())

    @staticmethod
    def _split(name: str) -> tuple[str, int]:
        stream, _, batch = name.rpartition("-")
        return (stream, int(batch)) if stream and batch.isdecimal() else (name, 0)

    def _file(self, name: str, digest: str) -> str:
        return f"{self.root}/recent/{files.escape(self.spark, name)}.{digest}.json"

    def _folded(self) -> str | None:
        """The newest whole version of the folded table."""
        done = [v for v in files.names(self.spark, f"{self.root}/folded") if files.exists(self.spark, f"{self.root}/folded/{v}/_SUCCESS")]
        return f"{self.root}/folded/{max(done)}" if done else None

    def table(self) -> DataFrame:
        """All commits: ``name, stream, batch, digest, value`` (JSON)."""
        parts = [p for p in (self._folded(),) if p]
        out = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        if files.data_files(self.spark, f"{self.root}/recent"):
            out = out.unionByName(self.spark.read.schema(SCHEMA).json(f"{self.root}/recent"))
        return out.dropDuplicates(["name", "digest"])

    def _heads(self) -> dict[str, int]:
        """The highest folded batch of each stream: above it nothing needs to
        be looked up in the table."""
        if self.root not in _HEADS:
            path = self._folded()
            rows = [] if path is None else self.spark.read.schema(SCHEMA).parquet(path).groupBy("stream").agg(F.max("batch").alias("b")).collect()
            _HEADS[self.root] = {r["stream"]: r["b"] for r in rows}
        return _HEADS[self.root]

    def maybe_known(self, name: str) -> bool:
        """Whether a commit of this name may be recorded."""
        stream, batch = self._split(name)
        with self.lock:
            start = f"{files.escape(self.spark, name)}."
            return batch <= self._heads().get(stream, -1) or any(
                n.startswith(start) for n in files.data_files(self.spark, f"{self.root}/recent"))

    def find(self, name: str, digest: str) -> dict | None:
        """What was recorded for this commit, None if it was not."""
        stream, batch = self._split(name)
        with self.lock:
            got = files.read_json(self.spark, self._file(name, digest))
            if got is not None:
                return json.loads(got["value"])
            if batch > self._heads().get(stream, -1):
                return None
            row = self.spark.read.schema(SCHEMA).parquet(self._folded()).where(
                (F.col("name") == name) & (F.col("digest") == digest)).select("value").first()
        return json.loads(row["value"]) if row else None

    def record(self, name: str, digest: str, value: dict) -> None:
        stream, batch = self._split(name)
        entry = {"name": name, "stream": stream, "batch": batch, "digest": digest, "value": json.dumps(value)}
        with self.lock:
            files.write_json(self.spark, self._file(name, digest), entry)
            if len(files.data_files(self.spark, f"{self.root}/recent")) >= FOLD:
                self._fold()

    def _fold(self) -> None:
        """Recent commits and the folded table become its next version. Done
        again after a failure at any point: a version without ``_SUCCESS`` is
        overwritten, and commits in both places count once."""
        old = self._folded()
        taken = files.data_files(self.spark, f"{self.root}/recent")
        version = int(old.rsplit("=", 1)[1]) + 1 if old else 0
        (self.table().coalesce(1).sortWithinPartitions("stream", "batch")
         .write.mode("overwrite").parquet(f"{self.root}/folded/v={version:09d}"))
        _HEADS.pop(self.root, None)
        for n in taken:
            files.delete(self.spark, f"{self.root}/recent/{n}")
        if old:
            files.delete(self.spark, old)
