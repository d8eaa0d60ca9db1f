"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Select columns by exact name under new names: ``pick(df, key="doc_id")``.

    Columns are addressed by position, so further columns of ``df`` whose
    names differ only in case, repeat, or equal an operator's own names do no
    harm.
    """
    cols = df.columns
    missing = [n for n in names.values() if n not in cols]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {cols}")
    flat = df.toDF(*[f"_c{i}" for i in range(len(cols))])
    return flat.select(*[F.col(f"_c{cols.index(n)}").alias(new) for new, n in names.items()])


def indexed(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed ``_c0 .. _cn`` (see :func:`restore`)."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def restore(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of an :func:`indexed` frame under ``like``'s names."""
    n = len(like.columns)
    return df.select(*[f"_c{i}" for i in range(n)]).toDF(*like.columns)


def col_of(like: DataFrame, name: str):
    """The column ``name`` of ``like`` in its :func:`indexed` form."""
    if name not in like.columns:
        raise ValueError(f"missing column {name}; there are {like.columns}")
    return F.col(f"_c{like.columns.index(name)}")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder named by
    ``spark.checkpoint.dir``, so a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def attach(rows: DataFrame, per_key: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """``rows`` joined with ``per_key``, which holds one row for every key of
    ``rows``, nulls included, and in ``_n`` how many rows have it. Keys with more than one row
    in ``share`` are fewer than ``share`` whatever the data, so they are
    broadcast and hot keys stay where they are; the others meet by a shuffle in
    which no key is large. Both frames are read twice: cut them before."""
    total = per_key.agg(F.sum("_n")).first()[0] or 0
    heavy = F.col("_n") * share > total
    named = per_key.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})

    def on(right: DataFrame):
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & F.col(k).eqNullSafe(right[f"_k{i}"])
        return cond

    drop = [f"_k{i}" for i in range(len(keys))]
    big, small = F.broadcast(named.where(heavy)), named.where(~heavy)
    first = rows.join(big, on(big)).drop(*drop)
    rest = rows.join(big, on(big), "left_anti").join(small, on(small)).drop(*drop)
    return first.unionByName(rest).drop("_n")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)`` (two longs).

    Repeated contraction: in each round every node takes the neighbour (or
    itself) that is smallest in an order re-drawn by hash for the round, and
    the edges are rewritten to those labels; an expected constant share of the
    nodes disappears per round, chains included. Hubs are reduced map-side
    (``min_by``); nothing is collected but one row count per round. The
    component is named by one of its nodes. Null ends are ignored.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        seed = F.lit(len(maps) + 1)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("v"))
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
                   .select("node", F.least("m", rank("node"))["v"].alias("label")))
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = cut(edges.join(left, "a").join(right, "b")
                    .select(F.col("la").alias("a"), F.col("lb").alias("b"))
                    .where("a <> b").distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[-1].select("node", F.col("label").alias("component"))
    for step in reversed(maps[:-1]):
        up = out.select(F.col("node").alias("label"), F.col("component"))
        out = step.join(up, "label", "left").select("node", F.coalesce("component", "label").alias("component"))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
