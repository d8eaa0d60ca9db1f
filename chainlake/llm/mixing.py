"""Mixing sources to target weights by entropy balancing.

Of all ways to take documents at rates between 0 and 3 copies so that every
source yields its target of words, the one nearest to one copy of each (in
relative entropy) tilts exponentially: a document of ``size`` words in source
``s`` has rate ``min(3, exp(tilt_s * size / mean_s))``. The convex dual has one
unknown per source, its tilt; Newton steps solve it, each a distributed
aggregate. Rates depend on source and size only, so the steps run on the table
of ``(source, size)`` counts, not on the documents.

Rates are then rounded into copies along the order (size, part of a large
group, hash of doc_id) of each source: a document gets as many copies as whole
numbers are passed by the running sum of rates, begun at an offset. Running
sums of rates and of copies differ by less than one anywhere, so the words
taken from a source differ from its target by no more than about its largest
document (Abel summation), and no document gets more than 3 copies. Of 16
offsets each source takes the one that comes nearest to its target.

DataFrame functions only. Sums are of integers (rates in units of 2^-30) and so
do not depend on the order in which tasks finish: reruns agree exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.analytics import positions
from .common import attach, cut, pick

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3  # copies of a document, and targets over sizes, at most
UNIT = 1 << 30  # rates are whole numbers of 1/UNIT
STEPS = 60  # bound of the Newton steps; a dozen are usual
OFFSETS = 16  # roundings tried per source
SHARE = 1000  # groups of over one row in SHARE are split


def big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, h)`` per row: words of the text (null: 0) and a
    hash that orders rows."""
    src = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    return src.select("doc_id", F.col("source").cast("string").alias("source"),
                      F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                      F.xxhash64("doc_id", F.lit(12)).alias("h"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sources(source, source_size, ...)`` with ``pos`` (place by code point,
    null last) and ``target``: all words shared by the weights, which repeat
    along the places; what a source gets beyond ``cap`` times its words goes to
    the others by weight, until none is above. Each round is one aggregate of
    two numbers; the level (words per weight) only rises."""
    named = cut(positions(sources, F.asc_nulls_last("source"), out="pos"))
    ranks = F.array(*[F.lit(w) for w in weights])
    named = named.withColumn("w", F.element_at(ranks, (F.col("pos") % len(weights)).cast("int") + 1))
    top = F.col("source_size") * cap
    total, level, last = named.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        full = level * F.col("w") > top
        got = named.agg(F.sum(F.when(full, top).otherwise(0)).alias("held"), F.sum(F.when(full, 0).otherwise(F.col("w"))).alias("w"),
                        F.count_if(full).alias("n")).first()
        if got.n == last or not got.w:
            break
        last, level = got.n, (total - got.held) / got.w
    share = level * F.col("w")
    return named.withColumn("target", F.when(share > top, top.cast("double")).otherwise(share)).drop("w")


def rate(tilt: Column, size: Column, mean: Column, cap: int = CAP) -> tuple[Column, Column]:
    """The rate of a document in units, and whether it lies below the cap."""
    z = tilt * size / mean
    below = z < math.log(cap)
    return F.when(below, F.floor(F.exp(F.least(z, F.lit(math.log(cap)))) * UNIT)).otherwise(F.lit(cap * UNIT)).cast("long"), below


def tilts(cells: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``(pos, mean, tilt)`` of every source of ``sources(pos, source_size,
    source_rows, target)``, solved on ``cells(pos, size, n)``. A target at the
    cap has an infinite tilt (every rate is the cap), a target of nothing a
    rate that no longer matters (all its documents are empty)."""
    mean = F.greatest(F.col("source_size") / F.col("source_rows"), F.lit(1e-9))
    full = (F.col("source_size") > 0) & (F.col("target") >= F.col("source_size") * cap)
    state = sources.select(
        "pos", mean.alias("mean"), "target", full.alias("done"),
        F.when(full, float("inf")).otherwise(0.0).alias("tilt"),
        F.when(F.col("target") < F.col("source_size"), float("-inf")).otherwise(0.0).alias("lo"),
        F.when(F.col("target") < F.col("source_size"), 0.0).otherwise(mean * math.log(cap)).alias("hi"))
    for k in range(1, STEPS + 1):
        units, below = rate(F.col("tilt"), F.col("size"), F.col("mean"), cap)
        words = big("n") * big("size")
        slope = big(F.floor(F.col("size") / F.col("mean") * units))
        sums = (cells.join(state.where("not done").select("pos", "mean", "tilt"), "pos").groupBy("pos")
                .agg((F.sum(words * big(units)).cast("double") / UNIT).alias("got"),
                     (F.sum(F.when(below, words * slope).otherwise(0)).cast("double") / UNIT).alias("slope")))
        joined = state.join(sums, "pos", "left")
        lo = F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(F.col("got") > F.col("target"), F.col("tilt")).otherwise(F.col("hi"))
        done = F.col("done") | F.col("got").isNull() | (F.abs(F.col("got") - F.col("target")) <= F.greatest(F.lit(0.5), F.col("target") * 1e-9))
        # Newton on log(got) = log(target); outside the bracket, its middle
        newton = F.when(F.col("slope") > 0, F.col("tilt") - F.try_divide(
            (F.log("got") - F.log("target")) * F.col("got"), F.col("slope")))
        inside = (newton > lo) & (newton < hi)
        middle = F.when(lo > float("-inf"), (lo + hi) / 2).otherwise(2 * hi - 1)
        step = F.when(done, F.col("tilt")).when(F.coalesce(inside, F.lit(False)), newton).otherwise(middle)
        state = joined.select("pos", "mean", "target", done.alias("done"), step.alias("tilt"), lo.alias("lo"), hi.alias("hi"))
        if k % 3 == 0:  # three steps a job
            state = cut(state)
            if state.where("not done").isEmpty():
                break
    return cut(state).select("pos", "mean", "tilt")


def running_units(parts: DataFrame) -> DataFrame:
    """``parts(pos, size, part, n, units)`` with ``before``: the rates (in units)
    of all documents of the source that come before the part, by size and part,
    of which only the fraction of a copy is kept. Summed in two levels, by
    ranges of sizes."""
    whole = big("n") * big("units")
    ranged = parts.withColumns({"_band": F.floor(F.col("size") / 1024), "_all": whole})
    inner = W.partitionBy("pos", "_band").orderBy("size", "part").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("pos").orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    bands = ranged.groupBy("pos", "_band").agg(F.sum("_all").alias("_sum")).select(
        "pos", "_band", F.coalesce(big(F.sum("_sum").over(outer)), big(F.lit(0))).alias("_low"))
    return (ranged.withColumn("_in", F.coalesce(big(F.sum("_all").over(inner)), big(F.lit(0))))
            .join(bands, ["pos", "_band"]).withColumn("before", F.pmod(big(F.col("_low") + F.col("_in")), big(F.lit(UNIT))).cast("long"))
            .drop("_band", "_all", "_in", "_low"))


def copies(offset: Column) -> Column:
    """How many whole numbers the running sum of rates passes at a row of
    ``(before, units, rank)``."""
    whole = lambda k: F.shiftright(F.col("before") + k.cast("long") * F.col("units") + offset, 30)
    return whole(F.col("rank")) - whole(F.col("rank") - 1)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` per row
    of ``docs``: ``copies`` (0 to ``cap``) of the whole document are taken,
    ``taken`` words in all. A null text has no words; null sources are one
    source, the last; rows that repeat an id are documents of their own, and
    among rows of equal id, source and size it does not matter which gets a
    copy more. An empty table gives no rows."""
    base = cut(sized(docs, id_col, text_col, source_col))
    per_source = cut(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")))
    named = cut(targets(per_source, weights, cap))
    rows = cut(attach(base, named.select("source", "pos", F.col("source_rows").alias("_n")), ["source"], SHARE))
    cells = cut(rows.groupBy("pos", "size").agg(F.count("*").alias("n")))
    solved = tilts(cells, named, cap)
    # a (source, size) group of over one row in SHARE is cut into parts by hash
    total = cells.agg(F.sum("n")).first()[0] or 0
    piece = max(1, -(-total // SHARE))
    split = cut(cells.select("pos", "size", F.col("n").alias("_n"), F.ceil(F.col("n") / piece).cast("int").alias("parts")))
    dealt = cut(attach(rows, split, ["pos", "size"], SHARE).withColumn("part", F.pmod(F.col("h"), F.col("parts")).cast("int")))
    units, _ = rate(F.col("tilt"), F.col("size"), F.col("mean"), cap)
    parts = (dealt.groupBy("pos", "size", "part").agg(F.count("*").alias("n"))
             .join(solved, "pos").withColumn("units", units).drop("tilt", "mean"))
    starts = (running_units(parts).join(named.select("pos", "source_size", "target"), "pos"))
    key = ["pos", "size", "part"]
    rank = F.row_number().over(W.partitionBy(*key).orderBy("h", "doc_id"))
    placed = cut(dealt.withColumn("rank", rank).join(starts, key)
                 .select("doc_id", "source", "pos", "size", "source_size", "target", "before", "units", "rank"))
    # the offset that brings each source nearest to its target
    tried = [F.lit((2 * k + 1) * UNIT // (2 * OFFSETS)) for k in range(OFFSETS)]
    miss = [F.struct(F.abs(F.sum(copies(o) * F.col("size")) - F.col("target")).alias("miss"), o.alias("offset")) for o in tried]
    best = placed.groupBy("pos", "target").agg(F.count("*").alias("_n"), F.least(*miss)["offset"].alias("offset")).drop("target")
    out = attach(placed, cut(best), ["pos"], SHARE).withColumn("copies", copies(F.col("offset")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def expand(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: each row of ``docs`` (unique ids) as often as ``mixed``
    says, columns as in ``docs``."""
    often = mixed.where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("copies").alias("_n"))
    return (docs.join(often, docs[id_col] == F.col("_id"))
            .withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_id", "_n"))
