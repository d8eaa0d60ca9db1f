"""Golden unit cases for the scalar expressions (FIXTURES.md §4)."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chainlake.functions import codec as C
from chainlake.functions import names as N


def one(spark, col, rows=None, schema=None):
    df = spark.createDataFrame(rows or [(1,)], schema or "x int")
    return df.select(col.alias("v")).collect()[0]["v"]


def test_hex_roundtrip_bytes(spark):
    df = spark.createDataFrame([([0, 15, 255],)], "a array<smallint>")
    b = df.select(C.bytes_from_ints("a").alias("b"))
    row = b.select(C.hex0x("b").alias("h"), C.ints_from_bytes("b").alias("i")).collect()[0]
    assert row["h"] == "0x000fff"
    assert row["i"] == [0, 15, 255]


def test_hex_of_null_is_null(spark):
    assert one(spark, C.hex0x(F.lit(None).cast("binary"))) is None
    assert one(spark, C.ints_from_bytes(F.lit(None).cast("binary"))) is None


def test_invalid_utf8_engine_is_null(spark):
    assert one(spark, C.engine_name(F.lit(bytearray(b"\xff\x80\x00\x01")))) is None
    assert one(spark, C.engine_name(F.lit(bytearray(b"BABE")))) == "BABE"


def test_u64_wrap(spark):
    df = spark.createDataFrame([(Decimal(18446744073709551615),), (Decimal(5),),
                                (Decimal(9223372036854775808),)], "x decimal(20,0)")
    got = [r["v"] for r in df.select(C.wrap_i64("x").alias("v")).collect()]
    assert got == [-1, 5, -9223372036854775808]


def test_u32_wrap(spark):
    df = spark.createDataFrame([(4294967295,), (7,)], "x bigint")
    assert [r["v"] for r in df.select(C.wrap_i32("x").alias("v")).collect()] == [-1, 7]


def test_nan_raises(spark):
    df = spark.createDataFrame([(float("nan"),)], "x double")
    with pytest.raises(Exception):
        df.select(C.json_number("x")).collect()
    ok = spark.createDataFrame([(1.5,)], "x double").select(C.json_number("x").alias("v")).first()
    assert ok["v"] == 1.5 and not math.isnan(ok["v"])


@pytest.mark.parametrize("n", [0, 5, 6])
def test_topics(spark, n):
    topics = [bytes([i]) * 2 for i in range(n)]
    df = spark.createDataFrame([(topics,)], "t array<binary>")
    row = df.select(*C.five_topics(F.col("t"))).collect()[0]
    got = [row[f"topic{i}"] for i in range(5)]
    want = [("0x" + bytes([i]).hex() * 2) if i < n else "" for i in range(5)]
    assert got == want


def test_amount_38_and_39_digits(spark):
    df = spark.createDataFrame([("9" * 38,), ("1" + "0" * 38,)], "s string")
    got = [r["v"] for r in df.select(C.amount38("s").alias("v")).collect()]
    assert got[0] == Decimal("9" * 38)
    assert got[1] is None


def test_phase(spark):
    df = spark.createDataFrame([("ApplyExtrinsic", 3), ("Finalization", None),
                                ("Initialization", None)], "k string, i int")
    rows = df.select(C.phase_code("k").alias("c"), C.phase_text("k", "i").alias("t")).collect()
    assert [(r["c"], r["t"]) for r in rows] == [(0, "ApplyExtrinsic(3)"), (1, "Finalization"),
                                               (2, "Initialization")]


def test_json_or_null(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("not json",), (None,)], "s string")
    assert [r["v"] for r in df.select(C.json_or_null("s").alias("v")).collect()] == \
        ['{"a": 1}', None, None]


def test_item_id(spark):
    assert one(spark, C.item_id(F.lit(12), F.lit(3))) == "12-3"


def test_name_map_rows_and_quirk(spark):
    assert len(N.name_rows()) == 33
    ev = spark.createDataFrame([("Balances", "Upgraded"), ("Balances", "Nope"), ("Indices", "X"),
                                ("System", "ExtrinsicSuccess")], "mod_name string, event_name string")
    got = {(r["mod_name"], r["event_name"]): (r["canonical_pallet"], r["canonical_event"])
           for r in N.canonical_event_name(ev).collect()}
    assert got[("Balances", "Upgraded")] == ("balances", "Upgraded")
    assert got[("Balances", "Nope")] == ("balances", "Unsupport")
    assert got[("Indices", "X")] == (None, "Unsupport")
    assert got[("System", "ExtrinsicSuccess")] == ("system", "ExtrinsicSuccess")
    quirk = {(r["mod_name"], r["event_name"]): r["canonical_event"]
             for r in N.canonical_event_name(ev, reference_quirk=True).collect()}
    assert quirk[("Balances", "Upgraded")] == "ReserveRepatriated"


def test_bytes_from_ints_looks_bytes_up_and_spells_out_the_rest(spark):
    rows = [(None,), ([],), (list(range(256)),), ([0, None, 255],), ([7, 256, 300, -1, 12],)]
    df = spark.createDataFrame(rows, "a array<smallint>").select(
        C.bytes_from_ints("a").alias("new"),
        F.expr("unhex(array_join(transform(a, x -> lpad(lower(hex(cast(x as int))), 2, '0')), ''))").alias("spelled"))
    got = [(r.new, r.spelled) for r in df.collect()]
    assert all(a == b for a, b in got) and got[2][0] == bytearray(range(256))
