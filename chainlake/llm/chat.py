"""Chat formatting into budgeted windows, in DataFrame functions only.

A turn is written as ``### <role>: <text></turn>`` and a line break. Inside
roles and texts the escape sign and the first signs of the control strings are
written ``\\b``, ``\\h`` and ``\\l`` (for ``\\``, ``#`` and ``<``; in roles also
``\\c`` for ``:``), so control strings occur nowhere else and the escape can be
undone.

Prefix sums of turn tokens choose the windows. With ``step = budget - history
- system``, the token axis is cut into cells of ``step`` tokens: the turns that
lie within one cell form a window, and a turn that lies across a border forms
its own. So every span is turn-aligned and keeps to the budget, unless a single
turn alone exceeds it (turns are never cut). Each window begins with the system
turn, if the conversation begins with one, then repeats the turns of the last
``history`` tokens before it, then has its new turns. Only new assistant turns
are under the loss mask; repeated ones are not.

The unit of work is a block of ``BLOCK`` turn numbers of a conversation: the
token axis begins anew there, so a conversation that holds a large part of all
rows is spread over its blocks. Texts are shuffled once, by block; between
blocks go only their sizes, the system turn, and the last ``history`` tokens of
a block to the next one (history reaches back one block at most). Tokens are
estimated as a quarter of the UTF-8 bytes.

Null roles and texts count as empty; rows of a null conv_id form one
conversation; null turns come first, in a block of their own; rows that share
conversation and turn are ordered by role, length, then text; repeated rows are
turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick

BUDGET = 2048
HISTORY = 256
BLOCK = 64
END = "</turn>\n"
TURN = "### "
KEY = ["ck", "cn"]  # conversation: conv_id or 0, and whether it is null


def escape(text: Column, role: bool = False) -> Column:
    pairs = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")] + [(":", "\\c")] * role
    for plain, escaped in pairs:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    """Every escape sign is followed by its letter, so the others can go
    first and the escape sign's own last."""
    pairs = [("#", "\\h"), ("<", "\\l")] + [(":", "\\c")] * role + [("\\", "\\b")]
    for plain, escaped in pairs:
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def turns(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per turn: conversation, block, order columns, ``tokens`` and the
    turn as written (``head`` and ``body``)."""
    src = pick(rows, conv="conv_id", turn="turn", role="role", text="text")
    turn = F.col("turn").cast("long")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    src = src.select(
        F.coalesce(F.col("conv").cast("long"), F.lit(0)).alias("ck"), F.col("conv").isNull().alias("cn"),
        F.coalesce(F.floor(turn / block), F.lit(-2**62)).alias("blk"), turn.alias("turn"), role.alias("role"),
        F.concat(F.lit(TURN), escape(role, True), F.lit(": ")).alias("head"), escape(text).alias("body"))
    return src.withColumn("tokens", F.ceil((F.octet_length("head") + F.octet_length("body") + len(END)) / 4).cast("long"))


def block_sizes(src: DataFrame) -> DataFrame:
    """One row per block: its ``total`` tokens, whether it is its conversation's
    ``first``, the ``next`` block, and ``sys``, the tokens of the system turn."""
    per = src.groupBy(*KEY, "blk").agg(F.sum("tokens").alias("total"), F.min(F.struct("turn", "role", "tokens")).alias("m"))
    o = W.partitionBy(*KEY).orderBy("blk")
    return per.select(*KEY, "blk", "total", F.lag("blk").over(o).isNull().alias("first"), F.lead("blk").over(o).alias("next"),
                      F.first(F.when(F.col("m.role") == "system", F.col("m.tokens"))).over(o).alias("sys"))


def placed(src: DataFrame) -> DataFrame:
    """``before``, the tokens of the block's earlier turns, and ``system``,
    whether the turn is its conversation's system turn."""
    o = (W.partitionBy(*KEY, "blk").orderBy(F.asc_nulls_first("turn"), "role", "tokens", "body")
         .rowsBetween(W.unboundedPreceding, W.currentRow))
    src = src.withColumn("before", F.sum("tokens").over(o) - F.col("tokens"))
    return src.withColumn("system", F.col("first") & (F.col("before") == 0) & (F.col("role") == "system"))


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """``(conv_id, block, window, text, n_repeated, loss)``: the windows of
    every conversation, in the order of ``block`` and ``window``. The first
    ``n_repeated`` turns of ``text`` are the system turn and history; ``loss``
    holds ``(start, chars)``, the code points of ``text`` that are targets."""
    if not 0 <= history < budget // 4:
        raise ValueError("history has to be less than a quarter of the budget")
    src = turns(rows, block)
    sizes = block_sizes(src)
    unit = [*KEY, "blk"]
    shown = lambda new: F.struct(
        F.concat("head", "body", F.lit(END)).alias("text"), F.length("head").alias("head"), F.length("body").alias("chars"),
        (F.lit(new) & (F.col("role") == "assistant")).alias("target"))

    # the windows of each block, and which later windows repeat a turn
    t = placed(src.join(sizes.select(*unit, "first", "sys"), unit))
    # a system turn that leaves little room takes no part in the reckoning
    step = F.greatest(F.lit(budget - history) - F.coalesce("sys", F.lit(0)), F.lit(budget // 4)).cast("long")
    cell, last = F.floor(F.col("before") / step), F.floor((F.col("before") + F.col("tokens") - 1) / step)
    t = t.withColumn("w", 2 * cell + F.when(last > cell, 1).otherwise(0))
    o = W.partitionBy(*unit).orderBy("before")
    begins = F.coalesce(F.lag("w").over(o) != F.col("w"), F.lit(True))
    t = t.withColumn("begins", begins).select(
        *unit, "before", "w", "system", shown(True).alias("new"), shown(False).alias("old"),
        # windows that begin within the next ``history`` tokens
        F.collect_list(F.when(F.col("begins"), F.col("w"))).over(o.rangeBetween(1, max(history, 1))).alias("later"),
        F.first(F.when(F.col("system"), shown(False))).over(o).alias("lead"))
    later = F.when(F.col("system") | F.lit(history == 0), F.array().cast("array<bigint>")).otherwise(F.col("later"))
    t = t.select(*unit, "before", "w", "new", "old", "lead", F.explode(F.concat(F.array("w"), later)).alias("at"))
    fresh = F.col("at") == F.col("w")
    # bounded by the budget: every turn counts three tokens at least
    made = t.groupBy(*unit, "at").agg(
        F.array_sort(F.collect_list(F.struct("before", F.when(fresh, F.col("new")).otherwise(F.col("old")).alias("x"),
                                             fresh.alias("fresh")))).alias("t"),
        F.min(F.when(fresh, F.col("before"))).alias("start"), F.first("lead").alias("lead"))

    # what later blocks take over: the system turn, and the end of the block before
    more = sizes.where(~F.col("first"))
    system = (src.where("role = 'system'").join(sizes.where("first and next is not null and sys is not null")
                                                .select(*unit, "first"), unit))
    system = (placed(system).where("system").groupBy(*KEY).agg(F.first(shown(False)).alias("carried"))
              .join(more.select(*unit), KEY))
    ends = placed(src.join(sizes.where("next is not null").select(*unit, "first", "next", "total"), unit))
    left = F.col("total") - F.col("before")
    ends = (ends.where(~F.col("system") & (left <= history))
            .groupBy(*KEY, F.col("next").alias("blk"))
            .agg(F.sort_array(F.collect_list(F.struct(left.alias("left"), shown(False).alias("x"))), asc=False).alias("ends")))
    made = made.join(system, unit, "left").join(ends, unit, "left")

    none = F.array().cast("array<struct<text:string,head:int,chars:int,target:boolean>>")
    lead = F.coalesce("carried", F.when(F.col("start") > 0, F.col("lead")))
    before = F.transform(F.filter("ends", lambda e: e["left"] + F.col("start") <= history), lambda e: e["x"])
    made = made.select(
        *unit, "at", F.concat(F.when(lead.isNotNull(), F.array(lead)).otherwise(none), F.coalesce(before, none),
                              F.transform("t", lambda x: x["x"])).alias("turns"),
        F.size(F.filter("t", lambda x: x["fresh"])).alias("n_new"))
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,chars:int>>)").alias("s")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["text"])).cast("int").alias("at"),
            F.when(x["target"], F.concat(acc["s"], F.array(F.struct(
                (acc["at"] + x["head"]).cast("int").alias("start"), x["chars"].cast("int").alias("chars")))))
            .otherwise(acc["s"]).alias("s")),
        lambda acc: acc["s"])
    return made.select(
        F.when(~F.col("cn"), F.col("ck")).alias("conv_id"), F.col("blk").alias("block"), F.col("at").alias("window"),
        F.array_join(F.transform("turns", lambda x: x["text"]), "").alias("text"),
        (F.size("turns") - F.col("n_new")).alias("n_repeated"), spans.alias("loss"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: ``array<struct<role, text>>``."""
    parts = F.split(text, F.lit(END))
    parts = F.slice(parts, 1, F.size(parts) - 1)  # nothing follows the last end mark
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, ": ", 1), len(TURN) + 1, 2**31 - 1), True).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, ": ", 1)) + 3, F.length(p))).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: its turns (repeated ones
    once), the text under the loss mask and the length of the output."""
    turn_list = read_turns(F.col("text"))
    own = F.slice(turn_list, F.col("n_repeated") + 1, F.greatest(F.size(turn_list), F.lit(1)))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["chars"]))), "")
    per_window = formatted.select("conv_id", F.struct(
        "block", "window", own.alias("turns"), loss.alias("loss"), F.length("text").cast("long").alias("chars")).alias("w"))
    whole = per_window.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return whole.select(
        "conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"),
        F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss_text"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + x["chars"]).alias("formatted_chars"))
