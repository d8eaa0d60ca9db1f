"""File operations of the storage layer, through Hadoop's file system API, so
they work on whatever store holds the tables."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def fs_of(spark: SparkSession, path: str):
    """(file system, path object) of a path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = fs_of(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder (none if it does not exist)."""
    fs, p = fs_of(spark, path)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def data_files(spark: SparkSession, path: str) -> list[str]:
    return [n for n in names(spark, path) if not n.startswith(("_", "."))]


def data_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """The bytes of each data file of a folder, by name."""
    fs, p = fs_of(spark, path)
    found = {st.getPath().getName(): st.getLen() for st in fs.listStatus(p)} if fs.exists(p) else {}
    return {n: found[n] for n in sorted(found) if not n.startswith(("_", "."))}


def delete(spark: SparkSession, path: str) -> None:
    fs, p = fs_of(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, src: str, dst: str) -> None:
    fs, s = fs_of(spark, src)
    _, d = fs_of(spark, dst)
    fs.mkdirs(d.getParent())
    if not fs.rename(s, d):
        raise OSError(f"cannot move {src} to {dst}")


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small JSON file, written whole or not at all."""
    folder, name = path.rsplit("/", 1)
    fs, p = fs_of(spark, f"{folder}/.{name}.tmp")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    delete(spark, path)
    rename(spark, f"{folder}/.{name}.tmp", path)


def read_json(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, path):
        return None
    fs, p = fs_of(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def escape(spark: SparkSession, value: str) -> str:
    """A value as Spark writes it in the name of a partition folder."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def partition_folder(spark: SparkSession, pairs: list[tuple[str, object]]) -> str:
    """``a=1/b=x``: the folder of a partition's values."""
    return "/".join(f"{k}={'__HIVE_DEFAULT_PARTITION__' if v is None else escape(spark, str(v))}" for k, v in pairs)
