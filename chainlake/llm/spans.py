"""Substring dedup by sliding sentence spans.

Every document is cut into parts of ``LEAST_WORDS`` to ``MAX_WORDS`` words (a
text of fewer is one part). Cuts are at sentence marks followed by white space
and at line breaks; of several within ``LEAST_WORDS`` words only the one before
the word with the least hash counts, line breaks first. Longer sentences are
also cut before words with the least hash of all within ``PIECE_WORDS`` words.
So cuts depend on the words around them, not on where a text or sentence
begins: a passage is cut alike wherever it stands, but for its two ends. Where
equal words give no least hash, the least one in reach of the last cut is
taken. Every run of ``RUN`` consecutive parts with at least ``SPAN_WORDS``
words (with these sizes, every run) is hashed, and the spans are joined
globally on the 128-bit hash.
The first occurrence, in the order of (doc_id, text hash,
position), stays; parts covered by any other occurrence are removed
(``min_words`` keeps covered stretches of fewer words; off by default).

Spans with many occurrences are reduced map-side (count and first place), so
a hot span costs one row per task; what is repeated is cut off as a table of
its own, so that the join back is a plain equi-join of two shuffles, whose
large partitions Spark splits.

A document is identified by (doc_id, hash of its text): rows that repeat both
are one document and fare alike. Null doc_ids sort first; null and empty
texts have no spans; an empty table gives an empty result. Words are
compared lower-cased, white space between them does not matter but for line
breaks, which are places to cut.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col_of, cut, indexed, restore

RUN = 3
SPAN_WORDS = 12
MIN_WORDS = 0  # every covered part goes
LEAST_WORDS = 4  # RUN parts never hold less than SPAN_WORDS
PIECE_WORDS = 5
MAX_WORDS = 16

MARK = re.compile(r"[.!?…。！？][^\s\w]*\s")
SPACE = np.array([chr(c).isspace() for c in range(0x3002)])  # no white space beyond
LINE, SENTENCE, INSIDE = 1 << 61, 2 << 61, 3 << 61


def least(keys: np.ndarray, radius: int) -> np.ndarray:
    """Where a key is the least within ``radius`` places (the first of equals)."""
    n, end = len(keys), np.full(radius, 2**64 - 1, np.uint64)
    wide, out = np.concatenate((end, keys, end)), np.ones(n, bool)
    for d in range(1, radius + 1):
        out &= (keys < wide[radius - d:radius - d + n]) & (keys <= wide[radius + d:radius + d + n])
    return out


def places(keys: np.ndarray) -> list[int]:
    """The words before which a text is cut, the first one and the end
    included, ``LEAST_WORDS`` to ``MAX_WORDS`` apart."""
    n = len(keys)
    at = least(keys, LEAST_WORDS - 1) & (keys < INSIDE)
    at |= least(np.where(at, np.uint64(0), keys), PIECE_WORDS - 1)
    at[:LEAST_WORDS] = at[max(n - LEAST_WORDS + 1, 0):] = False
    out = [0]
    for c in [*np.flatnonzero(at).tolist(), n]:
        while c - out[-1] > MAX_WORDS:  # equal or steadily falling keys
            a = out[-1] + PIECE_WORDS
            out.append(a + int(np.argmin(keys[a:min(out[-1] + MAX_WORDS, c - LEAST_WORDS) + 1])))
        out.append(c)
    return out


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """``(start, end, lower-cased words)`` of each part; the parts cover the
    text from its first word on (white space belongs to the part before)."""
    words = text.lower().split()
    if not words:
        return []
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = SPACE[np.minimum(codes, len(SPACE) - 1)]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(3)
    kind = np.full(len(words) + 1, INSIDE, np.uint64)
    kind[np.searchsorted(starts, [m.end() for m in MARK.finditer(text)])] = SENTENCE
    kind[np.searchsorted(starts, np.flatnonzero(codes == 10))] = LINE
    at = places(keys | kind[:-1])
    edges = [*starts[at[:-1]].tolist(), len(text)]
    return [(lo, hi, words[a:b]) for lo, hi, a, b in zip(edges, edges[1:], at, at[1:])]


def spans(parts: list[tuple[int, int, list[str]]], run: int = RUN, span_words: int = SPAN_WORDS):
    """``[(first sentence, hash 1, hash 2)]``: the spans of a document."""
    buf = b"".join(xxhash.xxh3_128_digest(" ".join(w)) for _, _, w in parts)
    size = [len(w) for _, _, w in parts]
    out = []
    for i in range(len(parts) - run + 1):
        if sum(size[i:i + run]) >= span_words:
            h = xxhash.xxh3_128_intdigest(buf[16 * i:16 * (i + run)])
            out.append((i, (h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63)))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` indexed, with the document key ``_id, _no, _th`` and ``_text``."""
    return indexed(docs).withColumns({
        "_id": F.coalesce(col_of(docs, "doc_id").cast("long"), F.lit(0)),
        "_no": col_of(docs, "doc_id").isNotNull(),  # false < true: null ids first
        "_th": F.xxhash64(col_of(docs, "text")),
        "_text": F.coalesce(col_of(docs, "text").cast("string"), F.lit("")),
    })


def all_spans(src: DataFrame, run: int, span_words: int) -> DataFrame:
    """A row per span: document key, first sentence, hash."""
    schema = "_id long, _no boolean, _th long, i int, h1 long, h2 long"

    def cut_up(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [spans(sentences(t.as_py()), run, span_words) for t in part.column(3)]
                flat = [s for f in found for s in f]
                if not flat:
                    continue
                rows = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                i, h1, h2 = zip(*flat)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k).take(rows) for k in range(3)], pa.array(i, pa.int32()),
                     pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["_id", "_no", "_th", "i", "h1", "h2"])

    return src.select("_id", "_no", "_th", "_text").where("_text <> ''").mapInArrow(cut_up, schema)


def repeated(src: DataFrame, run: int, span_words: int) -> DataFrame:
    """A row per document with non-first spans: its key and ``spans(i,
    kept_in)``, the first sentence of each and the doc_id that keeps it."""
    found = all_spans(src, run, span_words)
    place = F.struct("_no", "_id", "_th", "i")
    first = cut(found.groupBy("h1", "h2").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n"))
    again = found.join(first, ["h1", "h2"]).where(place != F.col("f"))
    return again.groupBy("_id", "_no", "_th").agg(
        F.collect_set(F.struct("i", F.expr("if(f._no, f._id, null)").alias("kept_in"))).alias("spans"))


def removed(text, found, run: int, min_words: int):
    """What is left of a text, and what goes: a scalar Arrow helper. Null
    where nothing goes."""
    def strip(t: str, found) -> dict | None:
        if not found:
            return None
        parts = sentences(t)
        hit = np.zeros(len(parts) + 1, np.int64)
        for x in found:
            hit[x["i"]] += 1
            hit[x["i"] + run] -= 1
        hit = np.cumsum(hit[:-1]) > 0
        cuts, k = [], 0
        while k < len(parts):
            end = k
            while end < len(parts) and hit[end]:
                end += 1
            if end > k and sum(len(w) for _, _, w in parts[k:end]) >= min_words:
                cuts.append((k, end))
            k = max(end, k + 1)
        if not cuts:
            return None
        lo, left, gone = 0, [], []
        for a, b in cuts:
            start, end = parts[a][0], parts[b - 1][1]
            left.append(t[lo:start])
            gone.append({"start": start, "chars": end - start})
            lo = end
        left.append(t[lo:])
        by = {x["kept_in"] for x in found if any(a <= x["i"] < b for a, b in cuts)} - {None}
        return {"text": "".join(left).rstrip(), "removed": gone, "n_sentences": sum(b - a for a, b in cuts), "kept_in": sorted(by)}

    schema = "text string, removed array<struct<start int, chars int>>, n_sentences int, kept_in array<long>"

    @F.udf(schema, useArrow=True)
    def call(t, found):
        return strip(t or "", found)

    # so declared, it is called once per row, not again for each use of its result
    return call.asNondeterministic()(text, found)


def duplicates(docs: DataFrame, run: int = RUN, span_words: int = SPAN_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per row of ``docs`` that loses sentences: ``doc_id``, its text
    without them, the character ranges ``removed(start, chars)``,
    ``n_sentences`` removed and ``kept_in``, the doc_ids of the documents that
    keep the first occurrences (null ids left out)."""
    src = keyed(docs)
    out = src.join(repeated(src, run, span_words), ["_id", "_no", "_th"])
    out = out.select(col_of(docs, "doc_id").alias("doc_id"), removed(F.col("_text"), F.col("spans"), run, min_words).alias("r"))
    return out.where("r is not null").select("doc_id", "r.text", "r.removed", "r.n_sentences", "r.kept_in")


def dedup(docs: DataFrame, run: int = RUN, span_words: int = SPAN_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated sentences: the same rows and columns, texts
    cut, ``n_chars`` (where present) counted anew for texts that changed."""
    src = keyed(docs)
    cols = [f"_c{i}" for i in range(len(docs.columns))]
    out = src.join(repeated(src, run, span_words), ["_id", "_no", "_th"], "left").select(*cols, "_text", "spans")
    out = out.withColumn("new", removed(F.col("_text"), F.col("spans"), run, min_words)["text"])
    at = f"_c{docs.columns.index('text')}"
    put = {at: F.coalesce("new", at)}
    if "n_chars" in docs.columns:
        n = f"_c{docs.columns.index('n_chars')}"
        put[n] = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.dtypes[docs.columns.index("n_chars")][1])).otherwise(F.col(n))
    return restore(out.withColumns(put), docs)
