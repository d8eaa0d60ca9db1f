"""chainlake: Substrate-style chain ingest, storage and analytics on Spark.

Blocks arrive as nested records (batch files or a stream), are flattened
into ``blocks`` / ``block_logs`` / ``extrinsics`` / ``events`` with native
Spark expressions, upserted idempotently into Parquet partitioned by
``(chain, block_bucket)``, and queried with DataFrames or Spark SQL.
"""

__version__ = "0.1.0"
