"""The stored tables: column names and types of the layout.

``chain`` and ``block_bucket`` are partition columns; ``_batch_id`` is the
hidden number of the batch that wrote a row. ``PARSED`` names the hidden VARIANT
column that holds a JSON column parsed, written once at ingest, so queries read
fields without parsing text.
"""

from __future__ import annotations

from pyspark.sql import types as T

_PARTITION = "chain string, block_bucket bigint, _batch_id bigint"

# The columns of the stored tables.
DDL = {
    "blocks": "number bigint, timestamp bigint, hash string, parent_hash string, extrinsics_root string, "
              "state_root string, is_finalized boolean, validator string, spec_version int, hash_bytes binary, "
              "parent_hash_bytes binary, extrinsics_root_bytes binary, state_root_bytes binary, validator_bytes binary",
    "block_logs": "id string, block_number bigint, type string, data string, engine string, log_index int",
    "extrinsics": "id string, block_number bigint, extrinsic_hash string, is_signed boolean, mod_name string, "
                  "call_name string, result boolean, call_params string, extrinsic_hash_bytes binary, "
                  "block_timestamp bigint, extrinsic_index bigint, signer string",
    "events": "id string, block_number bigint, extrinsic_id string, mod_name string, event_name string, "
              "phase smallint, `values` string, block_timestamp bigint, extrinsic_hash string, event_index bigint, "
              "extrinsic_index bigint, extrinsic_success boolean",
    "raw_event": "block_number bigint, block_hash string, extrinsic_hash string, data binary, index int, "
                 "topics array<binary>, phase_kind string, phase_index bigint, pallet_name string, "
                 "pallet_index smallint, event_name string, `values` string",
    "transfer": "block_number bigint, index bigint, id string, extrinsic_id string, extrinsic_index bigint, "
                "extrinsic_hash string, block_timestamp bigint, `from` string, `to` string, amount decimal(38,0), "
                "success boolean",
    "withdraw": "block_number bigint, index bigint, id string, extrinsic_id string, extrinsic_index bigint, "
                "extrinsic_hash string, block_timestamp bigint, who string, amount decimal(38,0), success boolean",
}
_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "smallint": T.ShortType(),
          "boolean": T.BooleanType(), "binary": T.BinaryType(), "decimal(38": T.DecimalType(38, 0),
          "array<binary>": T.ArrayType(T.BinaryType())}


def _schema(columns: str) -> T.StructType:
    fields = [c.split() for c in columns.replace(",0)", "").split(", ")]
    return T.StructType([T.StructField(name.strip("`"), _TYPES[kind]) for name, kind in fields])


TABLES = {name: _schema(f"{cols}, {_PARTITION}") for name, cols in DDL.items()}

PARSED = {"events": "values_v", "extrinsics": "call_params_v"}


def schema_of(name: str, parsed: bool = False) -> T.StructType:
    """A stored table's columns, with its parsed JSON column if asked."""
    extra = [T.StructField(PARSED[name], T.VariantType())] if parsed and name in PARSED else []
    return T.StructType(TABLES[name].fields + extra)
