"""Read-only SQL per chain and typed JSON results.

``run_query`` gives each chain its own session (temp views are
session-local) with the stored tables registered as views, and wraps the
user's text as a subquery so DDL, DML and statement chaining fail to parse.
Results stay DataFrames: ``encode_result`` is a column transformation, only
the caller collects.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import decimal_text, ints_from_bytes, json_number
from ..session import SQL_CONF


class QueryError(Exception):
    """Maps to the reference's ``{code: Error, reason}`` envelope."""


_SESSIONS: dict[tuple[str, str, str], tuple[str, SparkSession]] = {}
_LOCK = threading.Lock()


def chain_session(spark: SparkSession, lake, chain: str, known_chains: set[str] | None = None
                  ) -> SparkSession:
    """Q-01 / D8: an isolated session whose views are the chain's tables. It is
    kept, and its views are registered anew only after a commit to the lake, so
    a call lists no table (the text of a query can't change the session)."""
    key = (spark.sparkContext.applicationId, lake.root, chain)
    version = lake.version()
    with _LOCK:
        kept = _SESSIONS.get(key)
    if kept is not None and kept[0] == version and (known_chains is None or chain in known_chains):
        return kept[1]
    if known_chains is None:
        known_chains = lake.chains()
    if chain not in known_chains:
        raise QueryError(f"unknown chain {chain!r}")
    s = kept[1] if kept is not None else spark.newSession()
    for k, v in SQL_CONF.items():
        try:
            s.conf.set(k, v)
        except Exception:  # noqa: BLE001
            pass
    # the chain's views are all there is: no other chain's files by path
    s.conf.set("spark.sql.runSQLOnFiles", "false")
    lake.register(chain, s)
    with _LOCK:
        _SESSIONS[key] = (version, s)
    return s


def run_query(spark: SparkSession, lake, chain: str, sql: str,
              known_chains: set[str] | None = None, limit: int | None = None) -> DataFrame:
    """Run one read-only SELECT for a chain. Empty text is rejected (Q-05);
    no limit is applied unless asked (L-02)."""
    if sql is None or not sql.strip():
        raise QueryError("query is empty")
    s = chain_session(spark, lake, chain, known_chains)
    body = sql.strip().rstrip(";")
    try:
        df = s.sql(f"SELECT * FROM (\n{body}\n)")
    except Exception as err:  # noqa: BLE001 - reported as the error envelope
        raise QueryError(str(err).splitlines()[0]) from err
    return df.limit(limit) if limit is not None else df


# --- Q-03: column names -------------------------------------------------------------
def result_columns(df: DataFrame) -> DataFrame:
    """Unique column names in query order: a repeated name gets ``_2``,
    ``_3`` … instead of being lost (the reference's row maps keep the last)."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        seen[c] = seen.get(c, 0) + 1
        names.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    return df.toDF(*names)


# --- Q-02: result typing ----------------------------------------------------------------
_SIMPLE_CODES = [
    (T.BooleanType, "BOOL"), (T.ShortType, "SMALLINT"), (T.ByteType, "SMALLINT"),
    (T.IntegerType, "INT"), (T.LongType, "BIGINT"), (T.DecimalType, "NUMERIC"),
    (T.StringType, "TEXT"), (T.VarcharType, "VARCHAR"), (T.CharType, "TEXT"),
    (T.FloatType, "FLOAT4"), (T.DoubleType, "FLOAT8"), (T.BinaryType, "BYTEA"),
    (T.DateType, "DATE"), (T.TimestampType, "TIMESTAMP"), (T.TimestampNTZType, "TIMESTAMP"),
]


def type_code(dt: T.DataType) -> str:
    for cls, code in _SIMPLE_CODES:
        if isinstance(dt, cls):
            return code
    if isinstance(dt, T.ArrayType):
        inner = type_code(dt.elementType)
        return "JSON" if inner == "JSON" else f"{inner}_ARRAY"
    return "JSON"   # struct, map, variant: encoded with to_json


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, type_code(f.dataType)) for f in df.schema.fields]


def _encode(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.DecimalType):
        return decimal_text(c)                        # S-11: NUMERIC as text
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return json_number(c)                         # S-12: NaN / Inf raise
    if isinstance(dt, T.BinaryType):
        return ints_from_bytes(c)                     # S-13: bytes as numbers
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _encode(x, dt.elementType))
    if isinstance(dt, T.StructType):
        fields = F.struct(*[_encode(c[f.name], f.dataType).alias(f.name) for f in dt.fields])
        return F.when(c.isNotNull(), fields)
    if isinstance(dt, T.MapType):
        # JSON keys are text; values are typed like any other
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(
            _encode(e["key"], dt.keyType).cast("string").alias("key"), _encode(e["value"], dt.valueType).alias("value"))))
    return c


def encode_result(df: DataFrame) -> DataFrame:
    """One JSON object per row (``row_json``) with the reference's value
    typing; NULLs are written, not dropped."""
    df = result_columns(df)
    cols = [_encode(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("row_json"))


# --- Q-07: schema report -------------------------------------------------------------------
def schema_report(spark: SparkSession, lake, chain: str | None = None) -> DataFrame:
    """Columns of every registered table with their type (A-05): what the
    stored files hold, without a data scan; hidden columns are left out."""
    rows = []
    for t in (*lake.STORED, *lake.DERIVED):
        shown = [f for f in lake.table(t, chain).schema.fields if not f.name.startswith("_")]
        rows += [(t, f.name, f.dataType.simpleString(), i) for i, f in enumerate(shown)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, "
                                       "ordinal int")
