"""Chain analytics as DataFrame functions.

Ordered computations over the whole chain (lag, running sums, moving
windows, as-of) never use a window partitioned by ``chain`` alone - that
would put a whole chain, a third of all rows or more, into one task.
Instead they run inside ``block_bucket`` ranges and stitch the bucket edges
through a one-row-per-bucket summary table:

* ``prev_in_order``   - lag within the bucket + the previous bucket's last row
* ``moving_sum``      - range frame within the bucket + a halo of the
                        previous bucket's tail rows
* ``running_sum``     - running sum within (key, bucket) + the sum of the
                        key's earlier buckets (two-level prefix sum), so a hot
                        key is spread over its buckets
* ``asof_join``       - union + ``last(ignorenulls)`` within the bucket +
                        the last marker of earlier buckets
* ``range_join``      - ranges exploded into fixed-width bins, equi-join on
                        the bin, then the exact range predicate
* ``count_in_ranges`` - one sweep over points and range ends: no pairs at all
* ``positions``       - a global sort by range partitions, row numbers inside
                        them and the counts of the partitions before

No plan here depends on the data's size: joins with the summaries are plain
equi-joins, which Spark broadcasts when it sees at run time that they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import BUCKET_SIZE, json_values


def _bucket_of(col: str, size: int) -> Column:
    return F.floor(F.col(col) / size).cast("bigint")


# --- positions in a global order ----------------------------------------------
def positions(df: DataFrame, *order, out: str = "position") -> DataFrame:
    """``df`` with each row's 0-based position in the total order ``order``
    (include a unique tiebreak). The rows are sorted by range partitions; the
    partitions' row counts, one row per task, turn their row numbers into
    global ones. The sorted rows are checkpointed, so both reads agree."""
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    # monotonically_increasing_id holds the partition above bit 33, the row below
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return (placed.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_row"))
            .drop("_at", "_part", "_row", "_before"))


# --- ranks and first / last values over whole groups -----------------------------
def ranked(df: DataFrame, by: list[str], order: str, tiebreak: list[str], tiles: int | None = None,
           parts: int | None = None) -> DataFrame:
    """``df`` with ``row_number``, ``rank`` and ``dense_rank`` over ``order``
    (ascending, NULLs first) inside ``by``, row numbers of ties by
    ``tiebreak`` (which makes the order total), and ``ntile`` if ``tiles`` is
    given.

    No group is one task: rows are sorted globally by range partitions
    (:func:`positions`), each partition numbers its own rows and ties, and a
    table of one row per partition carries what a group or a tie has already
    counted in the partitions before. ``parts``: how many range partitions
    (default: Spark chooses)."""
    line = [*by, F.asc_nulls_first(order), *tiebreak]
    placed = df.repartitionByRange(parts, *line).sortWithinPartitions(*line) if parts else df.orderBy(*line)
    placed = placed.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)),
                                 "_g": F.struct(*by), "_v": F.struct(*by, order)})
    w = Window.partitionBy("_part").orderBy("_row")
    prior = F.lag(F.struct("_g", "_v")).over(w)
    # NULL: the partition's first row, which only the partitions before can tell
    placed = placed.withColumn("_prior", prior).withColumns({
        "_newg": F.when(F.col("_prior").isNotNull(), ~F.col("_prior._g").eqNullSafe(F.col("_g"))),
        "_newv": F.when(F.col("_prior").isNotNull(), ~F.col("_prior._v").eqNullSafe(F.col("_v")))}).drop("_prior")
    parts = placed.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("_g", "_v"), "_row").alias("_first"), F.max_by(F.struct("_g", "_v"), "_row").alias("_last"),
        F.max(F.when(F.col("_newg"), F.col("_row"))).alias("_gat"), F.max(F.when(F.col("_newv"), F.col("_row"))).alias("_vat"),
        F.count_if("_newv").alias("_vs"))
    seq = Window.orderBy("_part")
    before = seq.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_base": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_end": F.lag("_last").over(seq)})
    # a partition's first row starts a group / a value unless the row before it has the same
    parts = parts.withColumns({"_g0": ~F.coalesce(F.col("_end._g").eqNullSafe(F.col("_first._g")) & F.col("_end").isNotNull(), F.lit(False)),
                               "_v0": ~F.coalesce(F.col("_end._v").eqNullSafe(F.col("_first._v")) & F.col("_end").isNotNull(), F.lit(False))})
    at = lambda last, first: F.when(F.col(last).isNotNull(), F.col("_base") + F.col(last)).when(F.col(first), F.col("_base"))
    parts = parts.withColumns({"_gs": at("_gat", "_g0"), "_vs_at": at("_vat", "_v0"), "_vsum": F.col("_vs") + F.col("_v0").cast("int")})
    parts = parts.select("_part", "_base", "_g0", "_v0", F.last("_gs", ignorenulls=True).over(before).alias("_gc"),
                         F.last("_vs_at", ignorenulls=True).over(before).alias("_vc"),
                         F.coalesce(F.sum("_vsum").over(before), F.lit(0)).alias("_vbefore"))
    d = placed.join(F.broadcast(parts), "_part").withColumn("_at", F.col("_base") + F.col("_row"))
    first = F.col("_row") == 0
    d = d.withColumns({"_newg": F.when(first, F.col("_g0")).otherwise(F.col("_newg")), "_newv": F.when(first, F.col("_v0")).otherwise(F.col("_newv"))})
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = lambda new, carried: F.coalesce(F.last(F.when(F.col(new), F.col("_at")), ignorenulls=True).over(upto), F.col(carried))
    d = d.withColumns({"_gstart": start("_newg", "_gc"), "_vstart": start("_newv", "_vc"),
                       "_vno": F.col("_vbefore") + F.sum(F.col("_newv").cast("int")).over(upto)})
    # values and rows of a group: small tables of one row per group
    groups = d.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.min("_vno").alias("_v1"), F.count(F.lit(1)).alias("_rows"))
    on = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    for cond in on[1:]:
        on[0] = on[0] & cond
    out = d.join(groups, on[0]).withColumns({
        "row_number": F.col("_at") - F.col("_gstart") + 1, "rank": F.col("_vstart") - F.col("_gstart") + 1,
        "dense_rank": F.col("_vno") - F.col("_v1") + 1})
    if tiles:
        # the first (rows mod tiles) tiles hold one row more
        small, extra = F.expr(f"_rows div {tiles}"), F.col("_rows") % tiles
        i, wide = F.col("row_number") - 1, extra * (small + 1)
        out = out.withColumn("ntile", F.when(i < wide, F.floor(i / (small + 1))).otherwise(
            extra + F.floor((i - wide) / F.greatest(small, F.lit(1)))).cast("bigint") + 1)
    return out.select(*df.columns, "row_number", "rank", "dense_rank", *(["ntile"] if tiles else []))


def first_last(df: DataFrame, by: list[str], order: str, tiebreak: list[str], value: str) -> DataFrame:
    """``df`` with ``first_value`` and ``last_value`` of ``value`` over
    ``order`` inside ``by`` (the whole group as frame): one aggregate,
    reduced map-side, joined back."""
    place = F.struct(*[F.struct(F.col(c).isNotNull().alias("there"), F.col(c).alias("v")) for c in [order, *tiebreak]])  # NULLs first
    held = F.struct(F.col(value).alias("v"))
    ends = df.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(
        F.min_by(held, place)["v"].alias("first_value"), F.max_by(held, place)["v"].alias("last_value"))
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return df.join(ends, on).select(*df.columns, "first_value", "last_value")


def next_in_order(df: DataFrame, by: list[str], order: str, cols: list[str], bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """``lead``: ``next_<c>`` for ``order`` and each of ``cols``, the values of
    the following row by ``order`` within ``by`` (NULL for the last row);
    :func:`prev_in_order` along the reversed axis."""
    turned = prev_in_order(df.withColumn("_turned", -F.col(order)), by, "_turned", [order, *cols], bucket_size, prefix="next_")
    return turned.drop("_turned", "next__turned")


# --- lag with stitched bucket edges ------------------------------------------
def prev_in_order(df: DataFrame, by: list[str], order: str, cols: list[str],
                  bucket_size: int = BUCKET_SIZE, prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` for ``order`` and each of ``cols``: the values of the
    preceding row by ``order`` within ``by`` (NULL for the first row)."""
    keep = [order] + [c for c in cols if c != order]
    d = df.withColumn("_bkt", _bucket_of(order, bucket_size))
    w = Window.partitionBy(*by, "_bkt").orderBy(order)
    for c in keep:
        d = d.withColumn(f"_lag_{c}", F.lag(c).over(w))
    last = d.groupBy(*by, "_bkt").agg(
        F.max_by(F.struct(*keep), F.col(order)).alias("_last"))
    wb = Window.partitionBy(*by).orderBy("_bkt")
    carry = last.select(*by, "_bkt", F.lag("_last").over(wb).alias("_carry"))
    d = d.join(carry, [*by, "_bkt"], "left")
    first = F.col(f"_lag_{order}").isNull()
    for c in keep:
        d = d.withColumn(f"{prefix}{c}", F.when(first, F.col("_carry")[c]).otherwise(F.col(f"_lag_{c}")))
    return d.drop("_bkt", "_carry", *[f"_lag_{c}" for c in keep])


# T-06 ------------------------------------------------------------------------
def block_gaps(blocks: DataFrame, bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """Missing block-number ranges per chain: (gap_from, gap_to, missing)."""
    b = prev_in_order(blocks.select("chain", "number"), ["chain"], "number", [], bucket_size)
    return (b.where(F.col("number") - F.col("prev_number") > 1)
            .select("chain", (F.col("prev_number") + 1).alias("gap_from"),
                    (F.col("number") - 1).alias("gap_to"),
                    (F.col("number") - F.col("prev_number") - 1).alias("missing")))


def block_intervals(blocks: DataFrame, bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """Time since the previous stored block (analytic-window proof)."""
    b = prev_in_order(blocks.select("chain", "number", "timestamp"), ["chain"], "number",
                      ["timestamp"], bucket_size)
    return b.select("chain", "number", "prev_number",
                    (F.col("timestamp") - F.col("prev_timestamp")).alias("interval_ms"))


# --- moving window with halo ----------------------------------------------------
def moving_sum(df: DataFrame, by: list[str], order: str, value: str, width: int,
               out: str, bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """Sum of ``value`` over ``order`` in ``[x - width + 1, x]`` (a RANGE
    frame). Rows in the last ``width - 1`` positions of a bucket are copied
    into the next bucket as halo, so each bucket is computed on its own."""
    if width - 1 > bucket_size:
        raise ValueError("window wider than a bucket")
    bkt = _bucket_of(order, bucket_size)
    base = df.select(*by, order, value, bkt.alias("_bkt"), F.lit(False).alias("_halo"))
    halo = (df.where((F.col(order) % bucket_size) >= bucket_size - (width - 1))
            .select(*by, order, value, (bkt + 1).alias("_bkt"), F.lit(True).alias("_halo")))
    u = base.unionByName(halo)
    w = Window.partitionBy(*by, "_bkt").orderBy(order).rangeBetween(-(width - 1), 0)
    return (u.withColumn(out, F.sum(value).over(w)).where(~F.col("_halo"))
            .drop("_bkt", "_halo"))


# --- two-level running sum (skew-safe) -------------------------------------------
def running_sum(df: DataFrame, key: list[str], order: str, value: str, out: str,
                bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """Running total of ``value`` per ``key`` ordered by ``order`` (unique
    per key). Inner level: window per (key, bucket). Outer level: per key,
    the sum of all earlier buckets from a (key, bucket) summary. A key holding
    a third of the rows is thus split across its buckets."""
    d = df.withColumn("_bkt", _bucket_of(order, bucket_size))
    inner = Window.partitionBy(*key, "_bkt").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_in", F.sum(value).over(inner))
    tot = d.groupBy(*key, "_bkt").agg(F.sum(value).alias("_tot"))
    outer = Window.partitionBy(*key).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*key, "_bkt", F.coalesce(F.sum("_tot").over(outer), F.lit(0))
                     .cast(d.schema[value].dataType).alias("_off"))
    return (d.join(off, [*key, "_bkt"], "left")
            .withColumn(out, F.col("_in") + F.col("_off")).drop("_bkt", "_in", "_off"))


# --- as-of join -----------------------------------------------------------------
def asof_join(left: DataFrame, markers: DataFrame, by: list[str], left_key: str,
              marker_key: str, value: str, out: str, bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """For each left row, ``value`` of the marker with the greatest
    ``marker_key <= left_key`` (same ``by``); NULL when there is none.

    Left rows and markers are unioned and resolved by ``last(ignorenulls)``
    inside (by, bucket); the last marker of the earlier buckets comes from a
    summary of one row per bucket. Only the columns needed are shuffled with
    the left rows."""
    mk = markers.select(*by, F.col(marker_key).alias("_k"), F.struct(F.col(value).alias("v")).alias("_v"))
    lk = left.select(*by, F.col(left_key).alias("_k"), F.struct(*left.columns).alias("_row"))
    u = (lk.withColumn("_v", F.lit(None).cast(mk.schema["_v"].dataType))
         .unionByName(mk.withColumn("_row", F.lit(None).cast(lk.schema["_row"].dataType)))
         .withColumn("_bkt", _bucket_of("_k", bucket_size)))
    w = Window.partitionBy(*by, "_bkt").orderBy(F.col("_k"), F.col("_row").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    u = u.withColumn("_cur", F.last("_v", ignorenulls=True).over(w))
    # buckets with a row of either kind, and the last marker before each
    per = (lk.select(*by, _bucket_of("_k", bucket_size).alias("_bkt"), F.lit(None).cast("bigint").alias("_k"),
                     F.lit(None).cast(mk.schema["_v"].dataType).alias("_v")).distinct()
           .unionByName(mk.select(*by, _bucket_of("_k", bucket_size).alias("_bkt"), F.col("_k").cast("bigint").alias("_k"), "_v"))
           .groupBy(*by, "_bkt").agg(F.max_by("_v", "_k").alias("_last")))
    wb = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*by, "_bkt", F.last("_last", ignorenulls=True).over(wb).alias("_carry"))
    return (u.where(F.col("_row").isNotNull()).join(carry, [*by, "_bkt"], "left")
            .select("_row.*", F.coalesce("_cur", "_carry")["v"].alias(out)))


# --- binned range join ------------------------------------------------------------
def range_join(points: DataFrame, ranges: DataFrame, by: list[str], point: str, start: str,
               end: str, bin_size: int) -> DataFrame:
    """Pairs (point, range) with ``start <= point <= end``. Each range is
    exploded into the bins it overlaps (bounded by its width / ``bin_size``),
    each point falls in one bin, so the equi-join on the bin is exact and
    emits every matching pair once."""
    r = ranges.withColumn("_bin", F.explode(F.sequence(
        F.floor(F.col(start) / bin_size).cast("bigint"), F.floor(F.col(end) / bin_size).cast("bigint"))))
    p = points.withColumn("_bin", F.floor(F.col(point) / bin_size).cast("bigint"))
    return (p.join(r, [*by, "_bin"])
            .where((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))).drop("_bin"))


def count_in_ranges(points: DataFrame, ranges: DataFrame, by: list[str], point: str, start: str, end: str,
                    out: str, bucket_size: int) -> DataFrame:
    """``ranges`` with the number of points in ``[start, end]`` (integers).

    One sweep: points, counted per position, and both ends of the ranges stand
    on one axis; a running count per bucket, plus the points of all earlier
    buckets, says how many points lie at or before each end, and a range takes
    the difference. The work is linear in points and ranges, however much they
    overlap. Equal ranges are swept together and come out as often as they
    went in; a range whose end is NULL or lies before its start counts none."""
    # a range takes away what lies before its start and adds what lies up to its end
    at = lambda c, weight, copy: F.struct(c.cast("bigint").alias("_at"), F.lit(weight).alias("_w"), F.lit(copy).alias("_copy"))
    ends = F.when(F.col(start) <= F.col(end), F.array(at(F.col(start) - 1, -1, 0), at(F.col(end), 1, 1))).otherwise(
        F.array(at(F.lit(0), 0, 1)))
    probes = (ranges.select(*by, F.struct(*ranges.columns).alias("_row"), F.explode(ends).alias("_e"))
              .select(*by, "_e.*", F.lit(0).cast("bigint").alias("_n"), "_row"))
    per = points.groupBy(*by, F.col(point).cast("bigint").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumns({"_w": F.lit(0), "_copy": F.lit(0), "_row": F.lit(None).cast(probes.schema["_row"].dataType)})
    axis = per.select(*probes.columns).unionByName(probes).withColumn("_bkt", _bucket_of("_at", bucket_size)).checkpoint()
    upto = Window.partitionBy(*by, "_bkt").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = axis.withColumn("_upto", F.sum("_n").over(upto)).where("_row is not null")
    earlier = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carry = axis.groupBy(*by, "_bkt").agg(F.sum("_n").alias("_n")).select(
        *by, "_bkt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    swept = (inside.join(carry, [*by, "_bkt"])
             .groupBy("_row").agg(F.sum(F.col("_w") * (F.col("_upto") + F.col("_before"))).alias("_all"), F.sum("_copy").alias("_copies"))
             .withColumn(out, F.expr("_all div _copies")))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    return swept.select("_row", out, copies.alias("_i")).select("_row.*", out)


# --- exact percentile from a frequency table -------------------------------------------
def exact_percentile(df: DataFrame, group: list[str], col: str, p: float, out: str,
                     bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """Exact percentile of a whole-number column (linear interpolation, like
    ``percentile_cont``). Values are counted per distinct value, the counts
    summed up in value order in two levels, and the two values at the wanted
    positions picked by an aggregate: no task holds a group's values. The
    frequency table is computed once."""
    freq = df.where(F.col(col).isNotNull()).groupBy(*group, col).agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    upto = running_sum(freq, group, col, "_n", "_upto", bucket_size)
    total = freq.groupBy(*group).agg(F.sum("_n").alias("_all"))
    at = F.lit(p) * (F.col("_all") - 1)
    picked = upto.join(total, group).groupBy(*group, "_all").agg(
        F.min(F.when(F.col("_upto") > F.floor(at), F.col(col))).alias("_lo"),
        F.min(F.when(F.col("_upto") > F.ceil(at), F.col(col))).alias("_hi"))
    return picked.select(*group, (F.col("_lo") + (at - F.floor(at)) * (F.col("_hi") - F.col("_lo"))).alias(out))


# --- J-06 / J-07 / A-03 -----------------------------------------------------------------
def fees_per_extrinsic(events: DataFrame) -> DataFrame:
    fee = json_values("values_v" in events.columns, "actual_fee")[0].try_cast("decimal(38,0)")
    return (events.where((F.col("mod_name") == "TransactionPayment") &
                         (F.col("event_name") == "TransactionFeePaid"))
            .groupBy("chain", "block_number", "extrinsic_index").agg(F.sum(fee).alias("fee")))


def _number(blocks: DataFrame) -> Column:
    """The block number of a block table, bucketed or not."""
    return F.col("block_number" if "block_number" in blocks.columns else "number").alias("block_number")


def enrich_transfers(transfers: DataFrame, blocks: DataFrame, extrinsics: DataFrame,
                     events: DataFrame) -> DataFrame:
    """README transfer shape: block hash + time, extrinsic id + hash, fee."""
    b = blocks.select("chain", _number(blocks), F.col("hash").alias("block_hash"), F.col("timestamp").alias("block_time"))
    x = extrinsics.select("chain", "block_number", "extrinsic_index",
                          F.col("extrinsic_hash").alias("x_hash"), "call_name")
    fees = fees_per_extrinsic(events)
    keys = ["chain", "block_number", "extrinsic_index"]
    return (transfers.join(b, ["chain", "block_number"])
            .join(x, keys, "left").join(fees, keys, "left")
            .withColumn("fee", F.coalesce(F.col("fee"), F.lit(0).cast("decimal(38,0)"))))


def enrich_events(events: DataFrame, extrinsics: DataFrame, blocks: DataFrame) -> DataFrame:
    x = extrinsics.select("chain", "block_number", "extrinsic_index",
                          F.col("extrinsic_hash").alias("x_hash"), "call_name")
    b = blocks.select("chain", _number(blocks), F.col("timestamp").alias("block_time"), "is_finalized")
    return (events.join(x, ["chain", "block_number", "extrinsic_index"], "left")
            .join(b, ["chain", "block_number"], "left"))


def block_counts(blocks: DataFrame, extrinsics: DataFrame, events: DataFrame) -> DataFrame:
    """event_num / extrinsics_num per block, 0 when none (aggregate first,
    then join: the join sees one row per block on each side)."""
    ne = events.groupBy("chain", "block_number").agg(F.count(F.lit(1)).alias("event_num"))
    nx = extrinsics.groupBy("chain", "block_number").agg(F.count(F.lit(1)).alias("extrinsics_num"))
    b = blocks.select("chain", F.col("number").alias("block_number"))
    return (b.join(ne, ["chain", "block_number"], "left").join(nx, ["chain", "block_number"], "left")
            .select("chain", F.col("block_number").alias("number"),
                    F.coalesce("event_num", F.lit(0)).alias("event_num"),
                    F.coalesce("extrinsics_num", F.lit(0)).alias("extrinsics_num")))


def running_success(extrinsics: DataFrame, events: DataFrame) -> DataFrame:
    """N-01 over flat tables: any success among extrinsics 0..i of the block.
    One block is bounded: its events become one row, the extrinsics that
    succeeded and those that did not, so extrinsics meet it and the window runs
    in one and the same shuffle, by block."""
    key = ["chain", "block_number"]
    good = (F.col("mod_name") == "System") & (F.col("event_name") == "ExtrinsicSuccess")
    of_block = events.where("extrinsic_index is not null").groupBy(*key).agg(
        F.collect_set(F.when(good, F.col("extrinsic_index"))).alias("_good"),
        F.collect_set(F.when(~good, F.col("extrinsic_index"))).alias("_bad"))
    w = Window.partitionBy(*key).orderBy("extrinsic_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    index = F.col("extrinsic_index")
    success = F.when(F.array_contains("_good", index), True).when(F.array_contains("_bad", index), False)
    first = [*key, "extrinsic_index"]
    return (extrinsics.join(of_block, key, "left")
            .select(*first, *[c for c in extrinsics.columns if c not in first], success.alias("success"))
            .withColumn("result_running", F.coalesce(F.max("success").over(w), F.lit(False))))


# J-09 ----------------------------------------------------------------------------
def parent_links(blocks: DataFrame) -> DataFrame:
    child = blocks.select("chain", F.col("number").alias("child"), "parent_hash")
    parent = blocks.select("chain", F.col("number").alias("parent"), F.col("hash").alias("parent_hash"))
    return child.join(parent, ["chain", "parent_hash"])


def orphan_blocks(blocks: DataFrame) -> DataFrame:
    parent = blocks.select("chain", F.col("hash").alias("parent_hash"))
    return blocks.join(parent, ["chain", "parent_hash"], "left_anti")


def ancestors(blocks: DataFrame, steps: int = 3) -> DataFrame:
    """Up to ``steps`` parent links from every block, one equi-join a step:
    (chain, start, depth, farthest)."""
    walk = blocks.select("chain", F.col("number").alias("start"), F.lit(0).alias("depth"),
                         F.col("number").alias("farthest"), F.col("parent_hash").alias("_up"))
    up = blocks.select("chain", F.col("hash").alias("_up"), F.col("number").alias("_n"), F.col("parent_hash").alias("_next"))
    for _ in range(steps):
        walk = (walk.join(up, ["chain", "_up"], "left")
                .select("chain", "start", (F.col("depth") + F.col("_n").isNotNull().cast("int")).alias("depth"),
                        F.coalesce("_n", "farthest").alias("farthest"), F.col("_next").alias("_up")))
    return walk.drop("_up")


def fork_roots(blocks: DataFrame, bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """``(chain, number, hash, root, root_hash, distance)``: each block's oldest
    stored ancestor and the number of parent links to it, for chains of any
    length. Blocks on a cycle of parent links have no root (NULL).

    Runs of blocks whose parent is the block stored before them are contracted
    inside buckets (one window); only the runs' heads are linked by hash. The
    heads then reach their roots by pointer doubling: a head that points at an
    ancestor takes over that ancestor's pointer, so after k rounds pointers
    span 2^k runs. Heads that have arrived don't take part again, so their
    root is no hot key of the joins."""
    b = blocks.select("chain", "number", "hash", "parent_hash").withColumn("_bkt", _bucket_of("number", bucket_size))
    w = Window.partitionBy("chain", "_bkt").orderBy("number")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = ~F.coalesce(F.lag("hash").over(w) == F.col("parent_hash"), F.lit(False))
    place = F.row_number().over(w)
    b = b.withColumns({"_head": F.when(head, F.struct(F.col("hash").alias("hash"), place.alias("at"))), "_at": place})
    b = b.withColumn("_head", F.last("_head", ignorenulls=True).over(upto)).withColumns(
        {"run": F.col("_head.hash"), "pos": F.col("_at") - F.col("_head.at")}).drop("_head", "_at").checkpoint()
    heads = b.where("pos = 0").select("chain", "run", F.col("parent_hash").alias("_up"))
    stored = b.select("chain", F.col("hash").alias("_up"), F.col("run").alias("to"), F.col("pos").alias("_p"))
    # to: the run that the pointer has reached (NULL: none, the run starts at a root); steps: links from head to head
    state = (heads.join(stored, ["chain", "_up"], "left").groupBy("chain", "run")
             .agg(F.min(F.struct("to", "_p")).alias("m"))
             .select("chain", "run", F.col("m.to").alias("to"), F.coalesce(F.col("m._p") + 1, F.lit(0)).cast("bigint").alias("steps"))
             .withColumns({"done": F.col("to").isNull(), "to": F.coalesce("to", "run")}).checkpoint())
    left, rounds = state.where("not done").count(), 0
    limit = left.bit_length() + 1
    while left and rounds < limit:
        ahead = state.select("chain", F.col("run").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_s"),
                             F.col("done").alias("_d"))
        moved = state.where("not done").join(ahead, ["chain", "to"]).select(
            "chain", "run", F.col("_to").alias("to"), (F.col("steps") + F.col("_s")).alias("steps"), F.col("_d").alias("done"))
        state = state.where("done").unionByName(moved).checkpoint()
        left, rounds = state.where("not done").count(), rounds + 1
    roots = state.select("chain", "run", F.when(F.col("done"), F.col("to")).alias("root_hash"),
                         F.when(F.col("done"), F.col("steps")).alias("steps"))
    number = b.where("pos = 0").groupBy("chain", F.col("run").alias("root_hash")).agg(F.min("number").alias("root"))
    roots = roots.join(number, ["chain", "root_hash"], "left")
    return b.join(roots, ["chain", "run"]).select(
        "chain", "number", "hash", "root", "root_hash", (F.col("steps") + F.col("pos")).alias("distance"))


# J-08 ----------------------------------------------------------------------------
def runtime_versions(blocks: DataFrame) -> DataFrame:
    """Upgrade points: the first block stored with each spec_version."""
    return blocks.groupBy("chain", "spec_version").agg(F.min("number").alias("from_block"))


# --- skew-safe top-k per group -------------------------------------------------------------
def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "rnk",
                    salt_buckets: int = 64, salt_col: str | None = None) -> DataFrame:
    """``row_number() <= k`` per group in two stages: first the top k inside
    (group, salt) - a hot group is spread over ``salt_buckets`` tasks - then
    the top k of those at most ``k * salt_buckets`` survivors per group.
    ``order`` must be a total order (include a unique tiebreak)."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in ([salt_col] if salt_col else df.columns)]), F.lit(salt_buckets))
    d = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    pre = d.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return pre.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= k)


# --- skew-safe sessionization ---------------------------------------------------------------
def sessionize(df: DataFrame, key: list[str], t: str, gap: int, bucket: int, out: str = "session_id",
               tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """Session ids per ``key`` over a numeric time ``t``: a new session starts
    when the gap to the previous event exceeds ``gap`` (like
    ``session_window``). Sessions are cut inside (key, time bucket) with
    ``lag``; the per-(key, bucket) summary (first/last time, local session
    count) is small and turns into a global numbering by a prefix sum, so a
    key holding a third of all rows is spread over its buckets."""
    d = df.withColumn("_b", F.floor(F.col(t) / bucket).cast("bigint"))
    w = Window.partitionBy(*key, "_b").orderBy(t, *tiebreak)
    brk = F.when(F.lag(t).over(w).isNull() | ((F.col(t) - F.lag(t).over(w)) > gap), 1).otherwise(0)
    d = d.withColumn("_brk", brk).withColumn(
        "_local", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    summ = d.groupBy(*key, "_b").agg(F.min(t).alias("_first"), F.max(t).alias("_last"),
                                     F.sum("_brk").alias("_n"))
    wb = Window.partitionBy(*key).orderBy("_b")
    summ = summ.withColumn("_cont", F.when(
        (F.col("_first") - F.lag("_last").over(wb)) <= gap, 1).otherwise(0))
    # global id of the bucket's local session 0 = sessions before it - merges so far
    before = F.coalesce(F.sum("_n").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    merges = F.sum("_cont").over(wb.rowsBetween(Window.unboundedPreceding, 0))
    off = summ.select(*key, "_b", (before - merges).alias("_off"))
    return (d.join(off, [*key, "_b"]).withColumn(out, F.col("_off") + F.col("_local"))
            .drop("_b", "_brk", "_local", "_off"))
