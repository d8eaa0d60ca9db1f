"""Mergeable daily roll-ups: sketches stored per chain and day.

Distinct counts (HyperLogLog) and quantiles (KLL) of a day are stored as
sketches, a few kilobytes each whatever the day's size; any range of days is
answered by merging them, without a scan of the blocks. Days whose blocks
change are sketched anew and replace their partition.

Bounds: HyperLogLog with 2^LG_K registers has a relative standard error of
1.04 / sqrt(2^LG_K) (1.6 % for 12); KLL with k = 400 a rank error of about
0.7 % at 99 % confidence, the merge of any number of sketches included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
LG_K = 12
KLL_K = 400
HLL_BOUND = 3 * 1.04 / 2 ** (LG_K / 2)  # three standard errors
RANK_BOUND = 0.01


def day_of(ms) -> F.Column:
    return F.floor(ms / DAY_MS).cast("bigint")


def daily_sketches(blocks: DataFrame, intervals: DataFrame) -> DataFrame:
    """``(chain, day, validators, intervals, n_blocks)``: sketches of the
    distinct validators of ``blocks(chain, timestamp, validator)`` and of
    ``intervals(chain, timestamp, interval_ms)``, per day of block time."""
    b = blocks.groupBy("chain", day_of(F.col("timestamp")).alias("day")).agg(
        F.hll_sketch_agg("validator", F.lit(LG_K)).alias("validators"), F.count(F.lit(1)).alias("n_blocks"))
    i = intervals.where("interval_ms is not null").groupBy("chain", day_of(F.col("timestamp")).alias("day")).agg(
        F.kll_sketch_agg_bigint("interval_ms", F.lit(KLL_K)).alias("intervals"))
    return b.join(i, ["chain", "day"], "left")


def store(sketches: DataFrame, path: str) -> None:
    """Write or replace the days that ``sketches`` holds."""
    (sketches.repartition("chain", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("chain", "day").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("validators binary, n_blocks bigint, intervals binary, chain string, day bigint").parquet(path)


def days(sketches: DataFrame, first: int, last: int) -> DataFrame:
    """The sketches of a range of days (both ends included): a filter on the
    partition column, so only their folders are read."""
    return sketches.where(F.col("day").between(first, last))


def distinct_validators(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("validators", True)).alias("validators"))


def interval_quantiles(sketches: DataFrame, by: list[str], ranks: list[float]) -> DataFrame:
    """``(by, p, interval_ms)``: estimated quantiles of the merged sketches."""
    merged = sketches.where("intervals is not null").groupBy(*by).agg(F.kll_merge_agg_bigint("intervals").alias("s"))
    asked = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_bigint("s", F.lit(float(p))).alias("interval_ms"))
                      for p in ranks])
    return merged.select(*by, F.explode(asked).alias("q")).select(*by, "q.*")


def rank_error(values: DataFrame, estimates: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by, p, value, error)``: how far ``p`` lies outside the ranks that an
    estimated quantile really has among ``values`` (0: it is a right one)."""
    freq = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    est = estimates.select(*by, "p", F.col(value).alias("_q"))
    got = (freq.join(est, by).groupBy(*by, "p", "_q")
           .agg(F.sum(F.when(F.col(value) < F.col("_q"), F.col("_n")).otherwise(0)).alias("_lt"),
                F.sum(F.when(F.col(value) <= F.col("_q"), F.col("_n")).otherwise(0)).alias("_le"), F.sum("_n").alias("_all")))
    error = F.greatest(F.col("_lt") / F.col("_all") - F.col("p"), F.col("p") - F.col("_le") / F.col("_all"), F.lit(0.0))
    return got.select(*by, "p", F.col("_q").alias(value), error.alias("error"))
