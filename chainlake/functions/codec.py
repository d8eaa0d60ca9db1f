"""Scalar column expressions.

Every function maps ``Column -> Column`` and stays a built-in Catalyst
expression, so it runs inside whole-stage codegen: no Python per row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = 18446744073709551616
I64_MAX = 9223372036854775807


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# S-01 -------------------------------------------------------------------
def hex0x(b) -> Column:
    """``0x`` + lowercase hex of a BINARY column; NULL stays NULL."""
    return F.concat(F.lit("0x"), F.lower(F.hex(_c(b))))


def unhex0x(s) -> Column:
    """Inverse of :func:`hex0x` (accepts text with or without ``0x``)."""
    s = _c(s)
    return F.unhex(F.regexp_replace(s, r"^0x", ""))


def sha256_bytes(s) -> Column:
    """32 raw bytes of SHA-256 of a string."""
    return F.unhex(F.sha2(_c(s).cast("string"), 256))


def sha256_0x(s) -> Column:
    """``0x`` + SHA-256 hex of a string (the fixture's ``h(s)``)."""
    return F.concat(F.lit("0x"), F.sha2(_c(s).cast("string"), 256))


# S-02 / S-13 --------------------------------------------------------------
def bytes_from_ints(a) -> Column:
    """Wire form of ``Vec<u8>`` (array of 0..255 numbers) -> BINARY: a look-up per
    number; numbers that are no bytes are spelled out."""
    a = _c(a)
    digits = F.array(*[F.lit(f"{i:02x}") for i in range(256)])
    return F.unhex(F.array_join(F.transform(a, lambda x: F.coalesce(
        F.get(digits, x.cast("int")), F.lpad(F.lower(F.hex(x.cast("int"))), 2, "0"))), ""))


def ints_from_bytes(b) -> Column:
    """BINARY -> array of byte values 0..255 (result encoding of BYTEA): the
    code points of the bytes read as Latin-1."""
    b = _c(b)
    values = F.transform(F.split(F.decode(b, "ISO-8859-1"), ""), lambda c: F.ascii(c))
    return F.when(b.isNotNull(), F.when(F.length(b) > 0, values).otherwise(F.array().cast("array<int>")))


# S-03 -------------------------------------------------------------------
def item_id(block, index) -> Column:
    """Composite id ``{block}-{index}``; NULL when either part is."""
    return F.concat(_c(block).cast("string"), F.lit("-"), _c(index).cast("string"))


# S-04 -------------------------------------------------------------------
def engine_name(b) -> Column:
    """4-byte consensus engine id as UTF-8 text; NULL when not valid UTF-8."""
    return F.try_validate_utf8(_c(b).cast("string"))


# S-05 / S-06 --------------------------------------------------------------
# Phase codes of the stored ``events.phase`` column.
PHASE_CODES = {"ApplyExtrinsic": 0, "Finalization": 1, "Initialization": 2}


def phase_code(kind) -> Column:
    """Phase kind text -> SMALLINT code (ApplyExtrinsic 0, Finalization 1,
    Initialization 2)."""
    k = _c(kind)
    return (F.when(k == "ApplyExtrinsic", 0)
            .when(k == "Finalization", 1)
            .when(k == "Initialization", 2)).cast("smallint")


def phase_text(kind, index) -> Column:
    """Legacy text form: ``ApplyExtrinsic(n)``, ``Finalization``, ``Initialization``."""
    k = _c(kind)
    return F.when(k == "ApplyExtrinsic",
                  F.format_string("ApplyExtrinsic(%d)", _c(index).cast("bigint"))).otherwise(k)


# S-07 -------------------------------------------------------------------
def json_or_null(s) -> Column:
    """Keep a JSON text only when it parses; any failure becomes NULL."""
    s = _c(s)
    return F.when(F.try_parse_json(s).isNotNull(), s)


# S-08 -------------------------------------------------------------------
def topic_hex(topics, i: int) -> Column:
    """Topic ``i`` (0-based) as 0x-hex, ``''`` when absent (only five kept)."""
    return F.coalesce(hex0x(F.get(_c(topics), i)), F.lit(""))


def five_topics(topics) -> list[Column]:
    return [topic_hex(topics, i).alias(f"topic{i}") for i in range(5)]


# S-09 -------------------------------------------------------------------
def wrap_i64(x) -> Column:
    """Unsigned 64-bit (DECIMAL(20,0)) -> signed BIGINT with wrap-around,
    as a Rust ``as i64`` cast does; ANSI ``cast`` would raise instead."""
    x = _c(x).cast("decimal(20,0)")
    return F.when(x > F.lit(Decimal(I64_MAX)).cast("decimal(20,0)"),
                  x - F.lit(Decimal(U64)).cast("decimal(21,0)")).otherwise(x).cast("bigint")


def wrap_i32(x) -> Column:
    """Unsigned 32-bit -> signed INT with wrap-around (``as i32``)."""
    x = _c(x).cast("bigint")
    return F.when(x > 2147483647, x - 4294967296).otherwise(x).cast("int")


def wrap_i16(x) -> Column:
    x = _c(x).cast("bigint")
    return F.when(x > 32767, x - 65536).otherwise(x).cast("smallint")


# S-10 / S-11 --------------------------------------------------------------
def amount38(s) -> Column:
    """u128 amount text -> DECIMAL(38,0); NULL when beyond 38 digits."""
    return _c(s).cast("string").try_cast("decimal(38,0)")


def decimal_text(d) -> Column:
    return _c(d).cast("string")


# S-12 -------------------------------------------------------------------
def json_number(f) -> Column:
    """Float for a JSON result: NaN / +-Inf raise an error instead of
    turning into the string ``"NaN"``."""
    f = _c(f)
    bad = F.isnan(f) | (f == float("inf")) | (f == float("-inf"))
    return F.when(bad, F.raise_error(F.lit("float value is NaN or infinite"))).otherwise(f)


# S-14 -------------------------------------------------------------------
def chain_key(name) -> Column:
    """Chain kind / chain name -> lowercase key."""
    return F.lower(F.trim(_c(name)))
