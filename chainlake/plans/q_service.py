"""Registered queries: the SQL service re-aimed as library calls
(SURVEY §2.11 Q-01 … Q-09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lake import FIXTURE_CHAINS, create_tables, lake_for
from ..operators import extract as X
from ..operators import sink as S
from ..sources import fixture
from ..tables import TABLES
from . import service as Q
from .q_sink import work_dir
from .registry import query


@query("run_sql_blocks", """
SELECT spec_version, count(*) AS n_blocks, max("timestamp") AS last_ts FROM p_blocks GROUP BY spec_version""")
def run_sql_blocks(spark, sf):
    """A user's SQL text against one chain's tables ("ident" quoting on)."""
    return Q.run_query(spark, lake_for(spark, sf), "polkadot",
                       'SELECT spec_version, count(*) AS n_blocks, max("timestamp") AS last_ts '
                       "FROM blocks GROUP BY spec_version")


@query("run_sql_json_columns", """
SELECT to_json(struct_pack(id := id, block_number := block_number, phase := phase,
                           "values" := "values", extrinsic_success := extrinsic_success)) AS row_json
FROM p_events""")
def run_sql_json_columns(spark, sf):
    """JSON columns in a result (the reference panics on them): encoded rows."""
    df = Q.run_query(spark, lake_for(spark, sf), "polkadot",
                     "SELECT id, block_number, phase, values, extrinsic_success FROM events")
    return Q.encode_result(df)


@query("encode_result", """
SELECT to_json(struct_pack(number := number,
         hash_bytes := list_transform(range(32), lambda i: ('0x' || substr(hash, 3 + 2 * i, 2))::INTEGER),
         spec_version := spec_version, is_finalized := is_finalized,
         big := (CAST(number AS DECIMAL(38,0)) * 100000000000000000000)::VARCHAR,
         validator_bytes := CASE WHEN validator IS NULL THEN NULL
              ELSE list_transform(range(32), lambda i: ('0x' || substr(validator, 3 + 2 * i, 2))::INTEGER) END
       )) AS row_json
FROM p_blocks""")
def encode_result(spark, sf):
    """Typed JSON rows: BYTEA as numbers, NUMERIC as text, NULL kept."""
    df = Q.run_query(spark, lake_for(spark, sf), "polkadot",
                     "SELECT number, hash_bytes, spec_version, is_finalized, "
                     "CAST(number AS DECIMAL(38,0)) * 100000000000000000000 AS big, validator_bytes "
                     "FROM blocks")
    return Q.encode_result(df)


@query("empty_result", """
SELECT number, hash FROM p_blocks WHERE number < 0""")
def empty_result(spark, sf):
    """No rows, schema kept (the reference returns empty columns)."""
    return Q.run_query(spark, lake_for(spark, sf), "polkadot",
                       "SELECT number, hash FROM blocks WHERE number < 0")


# Q-07 / A-05: what the report has to say, from the layout (IO-19); the views
# of transfers and withdrawals have no bucket.
_VIEWS = {"transfers": "transfer", "withdrawals": "withdraw"}
_REPORT_COLUMNS = [
    (t, c.name, c.dataType.simpleString())
    for t in ("blocks", "block_logs", "extrinsics", "events", "raw_event", *_VIEWS)
    for c in TABLES[_VIEWS.get(t, t)].fields
    if not c.name.startswith("_") and not (t in _VIEWS and c.name == "block_bucket")]
_COUNT_OF = {"blocks": "o_blocks", "block_logs": "o_logs", "extrinsics": "o_extrinsics", "events": "o_events",
             "raw_event": "o_raw", "transfers": "o_transfers", "withdrawals": "o_withdrawals"}


@query("table_schemas", ", r AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{c}', '{k}')" for t, c, k in _REPORT_COLUMNS) + ") v(table_name, column_name, data_type)), n AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {v}" for t, v in _COUNT_OF.items())
    + ") SELECT table_name, column_name, data_type, n_rows FROM r JOIN n USING (table_name)")
def table_schemas(spark, sf):
    """Schema report of every registered table, name and type of each column,
    with the stored row count of its table."""
    lake = lake_for(spark, sf)
    counts = None
    for t in (*lake.STORED, *lake.DERIVED):
        c = lake.table(t).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(t))
        counts = c if counts is None else counts.unionByName(c)
    return Q.schema_report(spark, lake).drop("ordinal").join(counts, "table_name")


@query("create_tables", "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{c.name}', '{c.dataType.simpleString()}')" for t, schema in TABLES.items() for c in schema.fields
    if not c.name.startswith("_")) + ") v(table_name, column_name, data_type), (SELECT count(*) AS n_blocks FROM o_blocks) b")
def create_tables_query(spark, sf):
    """IO-19: the empty layout, then the blocks of the source upserted into it;
    every table is read back."""
    root = work_dir(spark, "layout")
    create_tables(spark, root)
    b = X.extract_headers(fixture.nested_blocks(spark.read.parquet(f"{sf}/events.parquet"), FIXTURE_CHAINS))
    S.upsert(S.with_order(b, 0), f"{root}/blocks", S.TABLE_KEYS["blocks"])
    n = spark.read.parquet(f"{root}/blocks").count()
    rows = [(t, f.name, f.dataType.simpleString(), n) for t, schema in TABLES.items()
            for f in spark.read.schema(schema).parquet(f"{root}/{t}").schema.fields if not f.name.startswith("_")]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, n_blocks bigint")


@query("no_implicit_limit", """
SELECT id, block_number FROM p_events""")
def no_implicit_limit(spark, sf):
    """L-02: every row of a result is returned."""
    return Q.run_query(spark, lake_for(spark, sf), "polkadot", "SELECT id, block_number FROM events")


@query("result_column_names", """
SELECT number, number AS number_2, hash, number + 1 AS number_3 FROM p_blocks""")
def result_column_names(spark, sf):
    """Q-03: repeated names in a result are told apart, none is lost."""
    return Q.result_columns(Q.run_query(spark, lake_for(spark, sf), "polkadot",
                                        "SELECT number, number, hash, number + 1 AS number FROM blocks"))


def _outcome(spark, lake, chain, text):
    try:
        return "ok", Q.run_query(spark, lake, chain, text).count()
    except Q.QueryError:
        return "error", 0


_STATEMENTS = [
    ("polkadot", "SELECT number FROM blocks", "p_blocks"), ("kusama", "SELECT number FROM blocks;", "k"),
    ("polkadot", "   ", None), ("polkadot", "", None), ("polkadot", "SELEC number FROM blocks", None),
    ("polkadot", "SELECT nothing FROM blocks", None), ("nowhere", "SELECT number FROM blocks", None)]
_WRITES = [
    ("polkadot", "DROP VIEW blocks", None), ("polkadot", "INSERT INTO blocks SELECT * FROM blocks", None),
    ("polkadot", "SELECT 1; DROP VIEW blocks", None), ("polkadot", "CREATE TABLE t AS SELECT 1 AS a", None),
    ("polkadot", "SELECT number FROM parquet.`{root}/blocks`", None), ("polkadot", "SELECT number FROM blocks", "p_blocks")]


def _outcome_sql(statements):
    n = {"p_blocks": "(SELECT count(*) FROM p_blocks)", "k": "(SELECT count(*) FROM o_blocks WHERE chain = 'kusama')", None: "0"}
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS statement, '{'ok' if view else 'error'}' AS outcome, CAST({n[view]} AS BIGINT) AS n_rows"
        for i, (_, _, view) in enumerate(statements)) + ")"


def _outcomes(spark, sf, statements):
    lake = lake_for(spark, sf)
    rows = [(i, *_outcome(spark, lake, chain, text.replace("{root}", lake.root))) for i, (chain, text, _) in enumerate(statements)]
    return spark.createDataFrame(rows, "statement int, outcome string, n_rows bigint")


@query("query_errors", _outcome_sql(_STATEMENTS))
def query_errors(spark, sf):
    """Q-05: empty and faulty statements give an error, others their rows."""
    return _outcomes(spark, sf, _STATEMENTS)


@query("writes_rejected", _outcome_sql(_WRITES))
def writes_rejected(spark, sf):
    """Q-09: nothing but one SELECT over the chain's own tables is run."""
    return _outcomes(spark, sf, _WRITES)


@query("encode_nested", """
SELECT to_json(struct_pack(number := number, s := struct_pack(b := [('0x' || substr(hash, 3, 2))::INTEGER, ('0x' || substr(hash, 5, 2))::INTEGER],
         d := CAST(number AS VARCHAR)), m := json_object('k' || number, CAST(spec_version AS VARCHAR)),
         day := strftime(make_timestamp("timestamp" * 1000), '%Y-%m-%d'))) AS row_json
FROM p_blocks""")
def encode_nested(spark, sf):
    """Q-02 inside structs and maps: bytes as numbers, NUMERIC as text; dates."""
    df = Q.run_query(spark, lake_for(spark, sf), "polkadot", """
        SELECT number, named_struct('b', substring(hash_bytes, 1, 2), 'd', CAST(number AS DECIMAL(20,0))) AS s,
               map(concat('k', number), CAST(spec_version AS DECIMAL(10,0))) AS m,
               CAST(timestamp_millis(timestamp) AS DATE) AS day FROM blocks""")
    return Q.encode_result(df)
