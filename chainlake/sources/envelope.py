"""Envelope source: JSON lines ``{chain, chain_kind, polkadot_blocks}``
(SURVEY IO-01 … IO-04, X-15).

The schema is explicit (no inference pass over the input). Bytes arrive as
arrays of numbers and become BINARY; u64 numbers arrive as DECIMAL(20,0)
and are narrowed to BIGINT with the reference's wrap-around.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import bytes_from_ints, chain_key, wrap_i64

WIRE_BYTES = T.ArrayType(T.ShortType())
U64 = T.DecimalType(20, 0)

LOG_WIRE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("engine", T.StringType()),
    T.StructField("data", WIRE_BYTES),
])
EXTRINSIC_WIRE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("block_number", U64),
    T.StructField("extrinsic_hash", WIRE_BYTES),
    T.StructField("block_timestamp", U64),
    T.StructField("mod_name", T.StringType()),
    T.StructField("call_name", T.StringType()),
    T.StructField("call_params", T.StringType()),
    T.StructField("signature", WIRE_BYTES),
    T.StructField("result", T.BooleanType()),
])
EVENT_WIRE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("block_number", U64),
    T.StructField("block_timestamp", U64),
    T.StructField("extrinsic_index", T.LongType()),
    T.StructField("extrinsic_id", T.StringType()),
    T.StructField("mod_name", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("event_index", T.LongType()),
    T.StructField("phase", T.IntegerType()),
    T.StructField("extrinsic_hash", WIRE_BYTES),
    T.StructField("values", T.StringType()),
])
HEADER_WIRE = T.StructType([
    T.StructField("block_number", U64),
    T.StructField("block_timestamp", U64),
    T.StructField("block_hash", WIRE_BYTES),
    T.StructField("parent_hash", WIRE_BYTES),
    T.StructField("extrinsics_root", WIRE_BYTES),
    T.StructField("state_root", WIRE_BYTES),
    T.StructField("is_finished", T.BooleanType()),
    T.StructField("validator", WIRE_BYTES),
    T.StructField("spec_version", T.LongType()),
])
BLOCK_WIRE = T.StructType([
    T.StructField("header", HEADER_WIRE),
    T.StructField("body", T.StructType([
        T.StructField("extrinsics", T.ArrayType(EXTRINSIC_WIRE)),
        T.StructField("events", T.ArrayType(EVENT_WIRE)),
    ])),
    T.StructField("logs", T.ArrayType(LOG_WIRE)),
])
CORRUPT = "_corrupt_record"
ENVELOPE_SCHEMA = T.StructType([
    T.StructField("chain", T.StringType()),
    T.StructField("chain_kind", T.StringType()),
    T.StructField("polkadot_blocks", T.ArrayType(BLOCK_WIRE)),
    T.StructField(CORRUPT, T.StringType()),
])


SOURCE = "_src"


def with_source(lines: DataFrame) -> DataFrame:
    """The arrival order of envelope lines as one sortable column: time and
    name of the file, its split, and the line within the split."""
    return lines.withColumn("_line", F.struct(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")))


# IO-02 --------------------------------------------------------------------
def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Batch read; a line that is not a valid envelope keeps its text in
    ``_corrupt_record`` instead of failing the job."""
    return with_source(spark.read.schema(ENVELOPE_SCHEMA).option("mode", "PERMISSIVE")
                       .option("columnNameOfCorruptRecord", CORRUPT).json(path))


# IO-01 / T-02 ----------------------------------------------------------------
def read_block_stream(spark: SparkSession, path: str, max_files: int | None = 1) -> DataFrame:
    """Streaming read of envelope files as they land; ``max_files`` bounds a
    micro-batch (back-pressure the reference lacks)."""
    r = (spark.readStream.schema(ENVELOPE_SCHEMA).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", CORRUPT))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(path).withColumn("_line", F.struct(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split")))


# IO-03 --------------------------------------------------------------------
def reject_reason(known_chains: Iterable[str] | None = None) -> F.Column:
    """Why an envelope is refused (NULL: it is not). Chain and chain kind are
    mandatory; with ``known_chains`` any other chain is refused."""
    reason = (F.when(F.col(CORRUPT).isNotNull(), F.lit("unparseable"))
              .when(F.col("chain").isNull(), F.lit("missing_chain"))
              .when(F.col("chain_kind").isNull(), F.lit("missing_chain_kind")))
    if known_chains is not None:
        reason = reason.when(~chain_key(F.col("chain")).isin(sorted(known_chains)), F.lit("unknown_chain"))
    return (reason.when(F.col("chain_kind") == "Ethereum", F.lit("unimplemented_chain_kind"))
            .when(F.col("chain_kind") != "Polkadot", F.lit("unknown_chain_kind"))
            .when(F.col("polkadot_blocks").isNull(), F.lit("polkadot_without_blocks")))


def split_valid(envelopes: DataFrame, known_chains: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid envelopes, rejected envelopes with a ``reason`` column)."""
    tagged = envelopes.withColumn("reason", reject_reason(known_chains))
    return (tagged.where(F.col("reason").isNull()).drop("reason"),
            tagged.where(F.col("reason").isNotNull()))


# IO-04 --------------------------------------------------------------------
def from_wire_header(h: F.Column) -> F.Column:
    return F.struct(
        wrap_i64(h["block_number"]).alias("block_number"),
        wrap_i64(h["block_timestamp"]).alias("block_timestamp"),
        bytes_from_ints(h["block_hash"]).alias("block_hash"),
        bytes_from_ints(h["parent_hash"]).alias("parent_hash"),
        bytes_from_ints(h["extrinsics_root"]).alias("extrinsics_root"),
        bytes_from_ints(h["state_root"]).alias("state_root"),
        h["is_finished"].alias("is_finished"),
        bytes_from_ints(h["validator"]).alias("validator"),
        h["spec_version"].alias("spec_version"))


def from_wire_block(b: F.Column) -> dict[str, F.Column]:
    header = from_wire_header(b["header"])
    exts = F.transform(b["body"]["extrinsics"], lambda x: x
                       .withField("block_number", wrap_i64(x["block_number"]))
                       .withField("block_timestamp", wrap_i64(x["block_timestamp"]))
                       .withField("extrinsic_hash", bytes_from_ints(x["extrinsic_hash"]))
                       .withField("signature", bytes_from_ints(x["signature"])))
    evs = F.transform(b["body"]["events"], lambda e: e
                      .withField("block_number", wrap_i64(e["block_number"]))
                      .withField("block_timestamp", wrap_i64(e["block_timestamp"]))
                      .withField("extrinsic_hash", bytes_from_ints(e["extrinsic_hash"])))
    logs = F.transform(b["logs"], lambda g: F.struct(
        g["type"].alias("type"), g["engine"].alias("engine"),
        bytes_from_ints(g["data"]).alias("data")))
    return {"header": header, "body": F.struct(exts.alias("extrinsics"), evs.alias("events")),
            "logs": logs}


def blocks_of(envelopes: DataFrame) -> DataFrame:
    """One row per block, tagged with the chain key and its position in the
    source (``_src``: line, then block in the envelope); internal (BINARY /
    BIGINT) form, same shape as the fixture."""
    line = [F.col("_line")] if "_line" in envelopes.columns else []
    ex = envelopes.select(chain_key(F.col("chain")).alias("chain"), *line,
                          F.posexplode(F.col("polkadot_blocks")).alias("block_pos", "b"))
    parts = from_wire_block(F.col("b"))
    src = [F.struct(*line, "block_pos").alias(SOURCE)] if line else []
    return ex.select("chain", parts["header"]["block_number"].alias("block_number"),
                     parts["header"].alias("header"), parts["body"].alias("body"),
                     parts["logs"].alias("logs"), "block_pos", *src)


# X-15 ---------------------------------------------------------------------
def block_problem() -> F.Column:
    h = F.col("header")
    return (F.when(h["block_number"].isNull(), F.lit("missing_block_number"))
            .when(h["block_hash"].isNull() | (F.length(h["block_hash"]) != 32), F.lit("bad_block_hash"))
            .when(h["parent_hash"].isNull() | (F.length(h["parent_hash"]) != 32), F.lit("bad_parent_hash")))


def quarantine(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A block is accepted or rejected whole (D3); rejected rows carry a
    ``problem`` and go to a dead-letter table instead of being dropped."""
    tagged = blocks.withColumn("problem", block_problem())
    return (tagged.where(F.col("problem").isNull()).drop("problem"),
            tagged.where(F.col("problem").isNotNull()))
