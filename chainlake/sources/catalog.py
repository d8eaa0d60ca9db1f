"""Catalog of storage nodes, engines and chains (SURVEY IO-06, X-14,
J-02 … J-05, A-06, S-14).

The catalog is configuration: a few rows per chain, so its frames are
broadcast (the size is checked). It is read from a JSON file with an
explicit schema and flattened into three frames that join with the data.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import chain_key

SAMPLE_CATALOG = os.path.join(os.path.dirname(__file__), "data", "catalog.json")

_CONN = T.StructType([T.StructField(n, t) for n, t in [
    ("name", T.StringType()), ("username", T.StringType()), ("password", T.StringType()),
    ("host", T.StringType()), ("port", T.IntegerType())]])
_SUPPORT = T.StructType([T.StructField(n, t) for n, t in [
    ("id", T.LongType()), ("name", T.StringType()), ("use_connection", T.StringType()),
    ("dbname", T.StringType()), ("enabled", T.BooleanType())]])
_ENGINE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("postgres", T.StructType([
        T.StructField("connections", T.ArrayType(_CONN)),
        T.StructField("support_chains", T.ArrayType(_SUPPORT))]))])
_NODE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("rpc", T.StructType([T.StructField("url", T.StringType()),
                                       T.StructField("scheme", T.StringType())])),
    T.StructField("apiserver", T.StructType([T.StructField("url", T.StringType())])),
    T.StructField("data_engines", T.ArrayType(_ENGINE))])
_CHAIN = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("polkadot_runtime", T.StructType([T.StructField("config", T.StringType())])),
    T.StructField("storage_nodes", T.ArrayType(T.StringType())),
    T.StructField("enabled", T.BooleanType())])
CATALOG_SCHEMA = T.StructType([
    T.StructField("storage", T.StructType([T.StructField("nodes", T.ArrayType(_NODE))])),
    T.StructField("chain", T.ArrayType(_CHAIN))])


class CatalogError(ValueError):
    pass


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """IO-06: JSON only; any other extension is rejected. The file is small
    configuration and is read by the driver (a path with a scheme through
    Spark's file systems), so executors need not see it."""
    if not path.lower().endswith(".json"):
        raise CatalogError(f"catalog must be a .json file: {path}")
    if "://" in path:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    row = spark.createDataFrame([(text,)], "text string").select(
        F.from_json("text", CATALOG_SCHEMA, {"mode": "FAILFAST"}).alias("c"))
    return row.select("c.*")


def chains(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.explode("chain").alias("c")).select(
        "c.id", "c.name", chain_key(F.col("c.name")).alias("chain"),
        chain_key(F.col("c.kind")).alias("kind"), "c.url", "c.enabled",
        F.col("c.storage_nodes").alias("storage_nodes"))


def nodes(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.explode("storage.nodes").alias("n")).select(
        F.col("n.id").alias("node_id"), F.col("n.name").alias("node_name"),
        F.col("n.rpc.url").alias("rpc_url"), F.col("n.apiserver.url").alias("api_url"),
        F.col("n.data_engines").alias("data_engines"))


def engine_chains(catalog: DataFrame) -> DataFrame:
    """Support chains per engine, one row each (disabled ones included)."""
    e = nodes(catalog).select("node_name", F.explode("data_engines").alias("e"))
    return e.select("node_name", F.col("e.kind").alias("engine"),
                    F.explode("e.postgres.support_chains").alias("s"),
                    F.col("e.postgres.connections").alias("connections")).select(
        "node_name", "engine", F.col("s.id").alias("id"), F.col("s.name").alias("name"),
        chain_key(F.col("s.name")).alias("chain"), F.col("s.use_connection").alias("use_connection"),
        F.col("s.dbname").alias("dbname"), F.col("s.enabled").alias("enabled"), "connections")


def enabled(df: DataFrame) -> DataFrame:
    """X-14."""
    return df.where(F.col("enabled"))


def route_chains(catalog: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """J-02 / J-03 / U-01: (chain, node) routes that resolve to a configured
    node, and the ones that do not. ``strict`` raises on any miss or on an
    enabled chain without a node list, like the ETL controller."""
    c = enabled(chains(catalog)).select("chain", "name", F.col("storage_nodes"))
    wanted = c.select("chain", F.explode_outer("storage_nodes").alias("node_name"))
    n = F.broadcast(nodes(catalog).select("node_name", "rpc_url"))
    matched = wanted.join(n, "node_name", "inner")
    unmatched = wanted.join(n, "node_name", "left_anti")
    if strict:
        bad = unmatched.limit(1).collect()
        if bad:
            raise CatalogError(f"chain {bad[0]['chain']} routes to unknown storage node "
                               f"{bad[0]['node_name']!r}")
    return matched, unmatched


def chain_connections(catalog: DataFrame) -> DataFrame:
    """J-04: enabled support chain of a node's engine -> its named connection
    of that engine; a miss keeps the row with ``matched = false`` (the engine
    logs it and skips the chain)."""
    s = enabled(engine_chains(catalog))
    hit = F.try_element_at(F.filter("connections", lambda k: k["name"] == F.col("use_connection")), F.lit(1))
    return (s.withColumn("k", hit).drop("connections")
            .withColumns({"host": F.col("k.host"), "port": F.col("k.port"), "matched": F.col("k").isNotNull()}).drop("k"))


def known_chains(catalog: DataFrame) -> tuple[str, ...]:
    """S-14: the chain keys the catalog names (configuration, a few rows)."""
    return tuple(sorted(r.chain for r in chains(catalog).select("chain").distinct().collect()))


def node(catalog: DataFrame, name: str) -> DataFrame:
    """J-05: node look-up by name."""
    return nodes(catalog).where(F.col("node_name") == name)


def list_engines(catalog: DataFrame) -> DataFrame:
    """Q-08 / A-06: support chains grouped per engine kind (disabled chains
    included). An empty engine list is an error, as in the reference."""
    e = engine_chains(catalog)
    if not e.limit(1).collect():
        raise CatalogError("data engines is empty")
    return e.groupBy("engine").agg(F.array_sort(F.collect_set("chain")).alias("chains"))
