"""Divergence between the sources of each language, by cube partitioning.

The smoothed term rates of a language form a matrix, groups (sources) by terms.
The divergence of every two groups is a sum over terms, so the work is a cube
(group, group, term). It is cut into cells of a block of groups, a block of
groups and a block of terms; a task owns a cell, gets the two slices of the
matrix that meet there (each slice is replicated to the cells of its row and
column), and returns the partial divergence of its pairs of groups. Partial
sums are then reduced along the term axis. Only cells with first block <=
second block exist, the divergence being symmetric.

Slices hold the counts that occur; the terms of a block that neither group
has add the same value each, so their number is enough. All arithmetic is on
integers and exact.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, cut, pick

LEAST_DOCS = 10  # documents of the language that hold a kept term
TERM_BLOCK = 4096  # terms of a cell, about
GROUP_BLOCK = 32  # groups on a side of a cell, about
UNIT = 1_000_000_000
RANKS = 10
HELD = 500_000  # counts that a task holds before it hands them on
PIECE = 1 << 20  # bytes of a text split at a time

# Bytes of terms stay (A-Z lower-cased, and all bytes of non-ASCII characters),
# all others become spaces.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str | None) -> Counter:
    """How often each term (as UTF-8) occurs in a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(LETTERS)
    if len(raw) <= PIECE:
        return Counter(raw.split())
    found, at = Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        found.update(raw[at:end].split())
        at = end
    return found


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                source_col: str = "source") -> DataFrame:
    """``(lang, term, docs, counts array<struct<source, n>>)``: what a task has
    found of a term in a language, several rows a term (one per task, or more
    of a task that holds ``HELD`` counts): documents with it, and its
    occurrences by source. The empty term, which no text holds, lists every
    source that occurs. Nulls read as ''."""
    names = ["lang", "term", "docs", "counts"]
    pair = pa.struct([("source", pa.string()), ("n", pa.int64())])

    def run(batches):
        held: dict[str, dict[str, dict[bytes, int]]] = {}
        docs: dict[str, Counter] = {}
        size = 0

        def out():
            for lang, groups in held.items():
                by_term: dict[bytes, list[tuple[str, int]]] = {}
                for source, found in groups.items():
                    for term, n in found.items():
                        by_term.setdefault(term, []).append((source, n))
                keys = list(by_term)
                for lo in range(0, len(keys), 65536):
                    part = keys[lo:lo + 65536]
                    lists = [by_term[k] for k in part]
                    ends = np.cumsum([0, *(len(x) for x in lists)]).astype(np.int32)
                    source, n = zip(*(p for x in lists for p in x))
                    pairs = pa.StructArray.from_arrays([pa.array(source, pa.string()), pa.array(n, pa.int64())], fields=list(pair))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                         pa.array([docs[lang][k] for k in part], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pairs)], names)

        for batch in batches:
            for text, lang, source in zip(*(batch.column(i) for i in range(3))):
                lang, found = lang.as_py(), terms(text.as_py())
                group = held.setdefault(lang, {}).setdefault(source.as_py(), {b"": 0})
                size -= len(group)
                for term, n in found.items():
                    group[term] = group.get(term, 0) + n
                size += len(group)
                docs.setdefault(lang, Counter()).update(found.keys())
                if size > HELD:
                    yield from out()
                    held, docs, size = {}, {}, 0
        yield from out()

    src = pick(docs, text=text_col, lang=lang_col, source=source_col).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return src.mapInArrow(run, "lang string, term string, docs long, counts array<struct<source: string, n: long>>")


def kept_counts(docs: DataFrame, least: int) -> DataFrame:
    """``(lang, term, source, n)`` of the terms in at least ``least`` documents
    of their language, and of the empty term. Tasks' findings are dealt by
    term once; what follows stays where it is."""
    found = term_counts(docs).repartition("lang", "term")
    whole = F.sum("docs").over(W.partitionBy("lang", "term"))
    kept = found.withColumn("_docs", whole).where((F.col("_docs") >= least) | (F.col("term") == ""))
    return (kept.select("lang", "term", F.explode("counts").alias("c")).groupBy("lang", "term", F.col("c.source").alias("source"))
            .agg(F.sum("c.n").alias("n")))


def rate(count: str, total: str, kept: str) -> Column:
    """``1 + floor(UNIT * (count + 2) / (total + 2 * kept))``, exact."""
    whole = lambda c: f"cast({c} as decimal(28,0))"
    return F.expr(f"1 + (({whole(count)} + 2) * {whole(UNIT)}) div ({whole(total)} + 2 * {whole(kept)})").cast("long")


def model(docs: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rates(lang, source, term, n, p)`` of kept terms that occur in a group,
    ``groups(lang, source, total, kept, rows, p0)`` of all groups (p0: rate of
    an absent term; null where the language keeps no term), and
    ``whole(lang, term, q)``, the language's own rates."""
    counts = cut(kept_counts(docs, least))
    inside = counts.where("term <> ''")
    vocabulary = cut(inside.groupBy("lang", "term").agg(F.sum("n").alias("all_n")))
    langs = cut(vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("lang_total")))
    totals = inside.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = cut(counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left")
                 .join(langs, "lang", "left").select("lang", "source", zero("total"), zero("kept"), zero("rows"))
                 .withColumn("p0", F.when(F.col("kept") > 0, rate("0", "total", "greatest(kept, 1)"))))
    known = groups.select("lang", "source", "total", "kept", F.col("rows").alias("_n"))
    rates = attach(inside, known, ["lang", "source"]).select("lang", "source", "term", "n", rate("n", "total", "kept").alias("p"))
    whole = attach(vocabulary, langs.withColumn("_n", F.col("kept")), ["lang"]).select(
        "lang", "term", rate("all_n", "lang_total", "kept").alias("q"))
    return cut(rates), groups, cut(whole)


def cell_pairs(table: pa.Table) -> pa.Table:
    """Partial divergences of a cell: ``(lang, a, b, value)`` for its pairs of
    groups. Rows with a null term describe the cell's groups (p: the rate of an
    absent term; n: the terms of the cell's block)."""
    side, source = table["side"].to_numpy(), np.array(table["source"].to_pylist(), object)
    p, n = table["p"].to_numpy(), table["n"].to_numpy()
    meta = np.asarray(table["term"].combine_chunks().is_null())
    coded = table["term"].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    term = np.asarray(coded.indices.fill_null(0)).astype(np.int64)
    width = len(coded.dictionary)
    absent = int(n[meta][0]) - width  # kept terms of the block that no row mentions
    sides, names, zeros = [], [], []
    for s in (0, 1):
        own = meta & (side == s)
        names.append(source[own].tolist())
        zeros.append(p[own])
        rows = (side == s) & ~meta
        at = {g: i for i, g in enumerate(names[s])}
        m = np.repeat(zeros[s][:, None], width, 1)
        m[[at[g] for g in source[rows]], term[rows]] = p[rows]
        sides.append(m)
    square = table["i"][0].as_py() == table["j"][0].as_py()  # rows of the one block are there once
    out = []
    for i, a in enumerate(names[0]):
        lo = i + 1 if square else 0
        other, base = (sides[0], zeros[0]) if square else (sides[1], zeros[1])
        if len(other) <= lo:
            continue
        q, q0 = other[lo:], base[lo:]
        d = sides[0][i] - q
        value = (d * d // (sides[0][i] + q)).sum(1)
        d0 = zeros[0][i] - q0
        value = value + absent * (d0 * d0 // (zeros[0][i] + q0))
        out += [(a, b, int(v)) for b, v in zip((names[0] if square else names[1])[lo:], value)]
    lang = table["lang"][0].as_py()
    a, b, v = zip(*out) if out else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "a": pa.array(a, pa.string()),
                     "b": pa.array(b, pa.string()), "value": pa.array(v, pa.int64())})


def pair_divergences(rates: DataFrame, groups: DataFrame, whole: DataFrame, group_block: int = GROUP_BLOCK,
                     term_block: int = TERM_BLOCK) -> DataFrame:
    """``(lang, a, b, value)`` for every two groups of a language, both ways."""
    # blocks of each language: how many, and how many terms each holds
    sizes = cut(groups.groupBy("lang").agg(F.count("*").alias("g"), F.max("kept").alias("kept"), F.sum("rows").alias("rows")).select(
        "lang", "kept", "rows", F.ceil(F.col("g") / group_block).cast("int").alias("nb"),
        F.ceil(F.col("kept") / term_block).cast("int").alias("nk")))
    plan = lambda n: sizes.where("kept > 0").select("lang", "nb", "nk", F.col(n).alias("_n"))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    held = attach(whole, plan("kept"), ["lang"]).groupBy("lang", block("term", "nk").alias("k")).agg(F.count("*").alias("n"))
    slices = attach(rates, plan("rows"), ["lang"]).select("lang", "nb", block("source", "nb").alias("own"), block("term", "nk").alias("k"),
                                                                  "source", "term", "n", "p")
    edges = groups.join(plan("kept"), "lang").join(held, "lang").select(
        "lang", "nb", block("source", "nb").alias("own"), "k", "source", F.lit(None).cast("string").alias("term"), "n",
        F.col("p0").alias("p"))
    to = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    cells = slices.unionByName(edges).withColumn("other", to).select(
        "lang", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "k",
        (F.col("own") > F.col("other")).cast("int").alias("side"), "source", "term", "n", "p")
    partial = cells.groupBy("lang", "i", "j", "k").applyInArrow(cell_pairs, "lang string, a string, b string, value long")
    pairs = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # languages without kept terms: every value is 0
    bare = groups.where("kept = 0").select("lang", "source")
    none = bare.withColumnRenamed("source", "a").join(bare.withColumnRenamed("source", "b"), "lang").where("a <> b").select(
        "lang", "a", "b", F.lit(0).cast("long").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.select("lang", "value", both.alias("s")).select("lang", "s.a", "s.b", "value").unionByName(none)


def audit(docs: DataFrame, ranks: int = RANKS, least: int = LEAST_DOCS, group_block: int = GROUP_BLOCK,
          term_block: int = TERM_BLOCK) -> DataFrame:
    """``(lang, source, part, item, value, rank)``. Part ``pair``: the
    divergence of a group from each other source of its language, all ranks.
    Part ``term``: the terms in which a group exceeds its language most, up to
    ``ranks``. Ranks go by value, descending, then by item. Null texts,
    languages and sources count as ''; texts without terms still make a group;
    a language that keeps no term has values of 0 and no ``term`` rows; an
    empty table gives no rows."""
    rates, groups, whole = model(docs, least)
    pair = pair_divergences(rates, groups, whole, group_block, term_block).select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = (rates.join(whole, ["lang", "term"]).where("p > q")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                    F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks))
    return pair.withColumn("rank", F.row_number().over(best)).unionByName(term)
