"""Registered queries: catalog, routing and engines (SURVEY IO-06, X-14,
J-02 … J-04, U-01, A-06, Q-08), each joined with the blocks stored per chain
so the report reflects the data, not only the configuration."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..lake import lake_for
from ..sources import catalog as K
from .registry import query

_CAT = f"read_json_auto('{K.SAMPLE_CATALOG}')"
_SQL_PARTS = f"""
, o_cat AS (SELECT * FROM {_CAT}),
  o_cchains AS (SELECT c.id, c.name, lower(trim(c.name)) AS chain, lower(trim(c.kind)) AS kind,
                       c.url, c.enabled, c.storage_nodes
                FROM (SELECT unnest(chain) AS c FROM o_cat)),
  o_nodes AS (SELECT n.name AS node_name, n.rpc.url AS rpc_url, n.data_engines
              FROM (SELECT unnest(storage.nodes) AS n FROM o_cat)),
  o_engines AS (SELECT node_name, e.kind AS engine, e.postgres AS pg
                FROM (SELECT node_name, unnest(data_engines) AS e FROM o_nodes)),
  o_support AS (SELECT node_name, engine, s.id, s.name, lower(trim(s.name)) AS chain,
                       s.use_connection, s.dbname, s.enabled, pg.connections AS connections
                FROM (SELECT node_name, engine, pg, unnest(pg.support_chains) AS s FROM o_engines)),
  o_stored AS (SELECT chain, count(*) AS n_blocks FROM o_blocks GROUP BY chain)
"""


def _catalog(spark):
    return K.read_catalog(spark, K.SAMPLE_CATALOG)


def _stored(spark, sf):
    return lake_for(spark, sf).table("blocks").groupBy("chain").agg(
        F.count(F.lit(1)).alias("n_blocks"))


def _with_blocks(df, spark, sf):
    return (df.join(F.broadcast(_stored(spark, sf)), "chain", "left")
            .withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)).cast("bigint")))


@query("catalog_chains", _SQL_PARTS + """
SELECT c.id, c.name, c.chain, c.kind, c.enabled, coalesce(s.n_blocks, 0) AS n_blocks
FROM o_cchains c LEFT JOIN o_stored s USING (chain)""")
def catalog_chains(spark, sf):
    c = K.chains(_catalog(spark)).select("id", "name", "chain", "kind", "enabled")
    return _with_blocks(c, spark, sf)


@query("catalog_enabled", _SQL_PARTS + """
SELECT c.chain, s.dbname, coalesce(st.n_blocks, 0) AS n_blocks
FROM o_cchains c JOIN o_support s ON s.chain = c.chain AND s.enabled
LEFT JOIN o_stored st ON st.chain = c.chain
WHERE c.enabled""")
def catalog_enabled(spark, sf):
    cat = _catalog(spark)
    c = K.enabled(K.chains(cat)).select("chain")
    s = K.enabled(K.engine_chains(cat)).select("chain", "dbname")
    return _with_blocks(c.join(s, "chain"), spark, sf)


@query("route_matched", _SQL_PARTS + """
SELECT w.chain, w.node_name, n.rpc_url, coalesce(st.n_blocks, 0) AS n_blocks
FROM (SELECT chain, unnest(storage_nodes) AS node_name FROM o_cchains WHERE enabled) w
JOIN o_nodes n USING (node_name) LEFT JOIN o_stored st ON st.chain = w.chain""")
def route_matched(spark, sf):
    matched, _ = K.route_chains(_catalog(spark))
    return _with_blocks(matched.select("chain", "node_name", "rpc_url"), spark, sf)


@query("route_unmatched", _SQL_PARTS + """
SELECT w.chain, w.node_name, coalesce(st.n_blocks, 0) AS n_blocks
FROM (SELECT chain, unnest(storage_nodes) AS node_name FROM o_cchains WHERE enabled) w
LEFT JOIN o_stored st ON st.chain = w.chain
WHERE w.node_name NOT IN (SELECT node_name FROM o_nodes)""")
def route_unmatched(spark, sf):
    _, unmatched = K.route_chains(_catalog(spark))
    return _with_blocks(unmatched.select("chain", "node_name"), spark, sf)


@query("chain_connections", _SQL_PARTS + """
SELECT s.node_name, s.chain, s.use_connection, k.host, k.port, k.host IS NOT NULL AS matched,
       coalesce(st.n_blocks, 0) AS n_blocks
FROM o_support s
LEFT JOIN (SELECT node_name, engine, chain, k0.name AS cname, k0.host AS host, k0.port AS port
           FROM (SELECT node_name, engine, chain, unnest(connections) AS k0 FROM o_support)) k
  ON k.node_name = s.node_name AND k.engine = s.engine AND k.chain = s.chain AND k.cname = s.use_connection
LEFT JOIN o_stored st ON st.chain = s.chain
WHERE s.enabled""")
def chain_connections(spark, sf):
    c = K.chain_connections(_catalog(spark)).select("node_name", "chain", "use_connection", "host",
                                                    "port", "matched")
    return _with_blocks(c, spark, sf)


@query("route_strict", _SQL_PARTS + """
SELECT w.chain, min(w.node_name) AS unknown_node, coalesce(max(st.n_blocks), 0) AS n_blocks
FROM (SELECT chain, unnest(storage_nodes) AS node_name FROM o_cchains WHERE enabled) w
LEFT JOIN o_stored st ON st.chain = w.chain
WHERE w.node_name NOT IN (SELECT node_name FROM o_nodes) GROUP BY w.chain""")
def route_strict(spark, sf):
    """J-03: strict routing stops at a route to an unknown node; the error
    names it."""
    try:
        K.route_chains(_catalog(spark), strict=True)
        rows = []
    except K.CatalogError as err:
        rows = [re.fullmatch(r"chain (\S+) routes to unknown storage node '(.*)'", str(err)).groups()]
    return _with_blocks(spark.createDataFrame(rows, "chain string, unknown_node string"), spark, sf)


@query("node_lookup", _SQL_PARTS + """
SELECT n.node_name, n.rpc_url, s.chain, coalesce(st.n_blocks, 0) AS n_blocks
FROM o_nodes n JOIN o_support s USING (node_name) LEFT JOIN o_stored st ON st.chain = s.chain
WHERE n.node_name = 'lake-b'""")
def node_lookup(spark, sf):
    """J-05: a node by name, with the chains it stores."""
    cat = _catalog(spark)
    n = K.node(cat, "lake-b").select("node_name", "rpc_url")
    return _with_blocks(n.join(K.engine_chains(cat).select("node_name", "chain"), "node_name"), spark, sf)


@query("engine_chains", _SQL_PARTS + """
SELECT s.engine, string_agg(DISTINCT s.chain, ',' ORDER BY s.chain) AS chains,
       count(DISTINCT s.chain) AS n_chains, sum(coalesce(st.n_blocks, 0)) AS n_blocks
FROM (SELECT DISTINCT engine, chain FROM o_support) s LEFT JOIN o_stored st ON st.chain = s.chain GROUP BY s.engine""")
def engine_chains(spark, sf):
    engines = K.list_engines(_catalog(spark))            # raises when empty
    per_chain = _with_blocks(engines.select("engine", F.explode("chains").alias("chain")), spark, sf)
    g = per_chain.groupBy("engine").agg(F.array_sort(F.collect_set("chain")).alias("cs"),
                                        F.count_distinct("chain").alias("n_chains"),
                                        F.sum("n_blocks").alias("n_blocks"))
    return g.select("engine", F.array_join("cs", ",").alias("chains"), "n_chains", "n_blocks")
