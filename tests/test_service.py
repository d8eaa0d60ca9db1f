"""Query service and catalog behaviour."""

import pytest
from pyspark.sql import functions as F

from chainlake.lake import lake_for
from chainlake.plans import service as Q
from chainlake.sources import catalog as K


def test_empty_query_rejected(spark, sf_dir):
    with pytest.raises(Q.QueryError):
        Q.run_query(spark, lake_for(spark, sf_dir), "polkadot", "   ")


def test_writes_and_chaining_rejected(spark, sf_dir):
    lake = lake_for(spark, sf_dir)
    for bad in ["DROP TABLE blocks", "INSERT INTO blocks SELECT * FROM blocks",
                "SELECT 1; DROP TABLE blocks"]:
        with pytest.raises(Q.QueryError):
            Q.run_query(spark, lake, "polkadot", bad)


def test_unknown_chain(spark, sf_dir):
    with pytest.raises(Q.QueryError):
        Q.run_query(spark, lake_for(spark, sf_dir), "westend", "SELECT 1", {"polkadot"})


def test_sessions_isolated(spark, sf_dir):
    lake = lake_for(spark, sf_dir)
    a = Q.run_query(spark, lake, "polkadot", "SELECT count(*) AS n FROM blocks").first()["n"]
    b = Q.run_query(spark, lake, "kusama", "SELECT count(*) AS n FROM blocks").first()["n"]
    assert a > b > 0


def test_empty_result_keeps_schema(spark, sf_dir):
    df = Q.run_query(spark, lake_for(spark, sf_dir), "polkadot",
                     "SELECT number, hash FROM blocks WHERE number < 0")
    assert df.count() == 0 and df.columns == ["number", "hash"]
    assert Q.column_types(df) == [("number", "BIGINT"), ("hash", "TEXT")]


def test_duplicate_columns_suffixed(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS a, 3 AS b")
    assert Q.result_columns(df).columns == ["a", "a_2", "b"]
    assert Q.encode_result(df).first()["row_json"] == '{"a":1,"a_2":2,"b":3}'


def test_type_codes_and_encoding(spark):
    df = spark.sql("SELECT CAST(1 AS SMALLINT) s, 2.5D d, CAST(3.5 AS FLOAT) f, "
                   "CAST(12345678901234567890123 AS DECIMAL(38,0)) n, X'00FF' b, array(1, 2) ai, "
                   "named_struct('k', 1) j, true t, CAST(NULL AS STRING) z")
    codes = dict(Q.column_types(df))
    assert codes == {"s": "SMALLINT", "d": "FLOAT8", "f": "FLOAT4", "n": "NUMERIC", "b": "BYTEA",
                     "ai": "INT_ARRAY", "j": "JSON", "t": "BOOL", "z": "TEXT"}
    js = Q.encode_result(df).first()["row_json"]
    assert js == ('{"s":1,"d":2.5,"f":3.5,"n":"12345678901234567890123","b":[0,255],'
                  '"ai":[1,2],"j":{"k":1},"t":true,"z":null}')


def test_nan_in_result_is_error(spark):
    df = spark.sql("SELECT CAST('NaN' AS DOUBLE) x")
    with pytest.raises(Exception):
        Q.encode_result(df).collect()


def test_catalog_rejects_non_json(spark, tmp_path):
    p = tmp_path / "cat.toml"
    p.write_text("x = 1")
    with pytest.raises(K.CatalogError):
        K.read_catalog(spark, str(p))


def test_strict_routing_raises(spark):
    cat = K.read_catalog(spark, K.SAMPLE_CATALOG)
    with pytest.raises(K.CatalogError):
        K.route_chains(cat, strict=True)
    matched, unmatched = K.route_chains(cat)
    assert [(r["chain"], r["node_name"]) for r in unmatched.collect()] == [("kusama", "lake-z")]


def test_node_lookup(spark):
    cat = K.read_catalog(spark, K.SAMPLE_CATALOG)
    assert K.node(cat, "lake-a").count() == 1
    assert K.node(cat, "nope").count() == 0


def test_schema_report(spark, sf_dir):
    rep = Q.schema_report(spark, lake_for(spark, sf_dir))
    t = {(r["table_name"], r["column_name"]): r["data_type"] for r in rep.collect()}
    assert t[("blocks", "hash_bytes")] == "binary"
    assert t[("events", "values")] == "string"
    assert rep.where(F.col("column_name").startswith("_")).count() == 0


def test_no_implicit_limit(spark, sf_dir):
    """L-02: every row is returned unless a limit is asked for."""
    lake = lake_for(spark, sf_dir)
    full = Q.run_query(spark, lake, "polkadot", "SELECT id FROM events").count()
    assert full == lake.table("events", "polkadot").count()
    assert Q.run_query(spark, lake, "polkadot", "SELECT id FROM events", limit=3).count() == 3


def test_outer_order_by_survives_wrap(spark, sf_dir):
    rows = Q.run_query(spark, lake_for(spark, sf_dir), "polkadot",
                       "SELECT number FROM blocks ORDER BY number DESC").collect()
    nums = [r["number"] for r in rows]
    assert nums == sorted(nums, reverse=True)


def test_cte_inside_wrapped_query(spark, sf_dir):
    df = Q.run_query(spark, lake_for(spark, sf_dir), "polkadot",
                     "WITH t AS (SELECT number FROM blocks) SELECT count(*) AS n FROM t")
    assert df.first()["n"] == lake_for(spark, sf_dir).table("blocks", "polkadot").count()


def test_lake_chains_from_folders(spark, sf_dir):
    assert lake_for(spark, sf_dir).chains() == {"polkadot", "kusama"}


def test_empty_engine_list_is_error(spark, tmp_path):
    p = tmp_path / "empty.json"
    p.write_text('{"storage": {"nodes": [{"id": 1, "name": "n", "rpc": {"url": "x"}, '
                 '"apiserver": {"url": "y"}, "data_engines": []}]}, "chain": []}')
    with pytest.raises(K.CatalogError):
        K.list_engines(K.read_catalog(spark, str(p)))
    engines = K.list_engines(K.read_catalog(spark, K.SAMPLE_CATALOG)).collect()
    assert [(r["engine"], r["chains"]) for r in engines] == [
        ("Postgres", ["acala", "astar", "kusama", "polkadot"])]


def test_files_by_path_are_out_of_reach(spark, sf_dir):
    lake = lake_for(spark, sf_dir)
    with pytest.raises(Q.QueryError):
        Q.run_query(spark, lake, "polkadot", f"SELECT number FROM parquet.`{lake.root}/blocks`")


def test_nested_values_are_typed(spark):
    df = spark.sql("SELECT named_struct('b', X'00FF', 'd', CAST(1.5 AS DECIMAL(4,1)), 'n', CAST(NULL AS BINARY)) AS s, "
                   "map('k', X'01') AS m, CAST(NULL AS STRUCT<b: BINARY>) AS z, DATE'2024-01-02' AS day")
    assert Q.encode_result(df).first()["row_json"] == (
        '{"s":{"b":[0,255],"d":"1.5","n":null},"m":{"k":[1]},"z":null,"day":"2024-01-02"}')


def test_connections_are_of_the_node(spark):
    c = K.chain_connections(K.read_catalog(spark, K.SAMPLE_CATALOG))
    got = sorted((r.node_name, r.chain, r.host) for r in c.collect() if r.matched)
    assert got == [("lake-a", "kusama", "db2.example.org"), ("lake-a", "polkadot", "db1.example.org"),
                   ("lake-b", "polkadot", "db3.example.org")]
    assert [r.chain for r in c.where("not matched").collect()] == ["astar"]
    assert K.known_chains(K.read_catalog(spark, K.SAMPLE_CATALOG)) == ("acala", "astar", "kusama", "polkadot")
