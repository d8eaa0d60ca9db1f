"""SimHash near-duplicates through Golay-code fuzzy hashing.

Fingerprints of 64 bits link at a Hamming distance of ``max_bits`` = 4 or
less. The binary Golay code [23,12,7] is perfect: every 23-bit word lies
within 3 bits of exactly one of 4,096 codewords. ``N1(x)``, the codewords
nearest to ``x`` and to its 23 one-bit neighbours, holds 1 (13 % of words) or
6 (87 %) codewords, and

* words 2 bits apart share a member of ``N1`` (the word between them);
* for words at most 1 bit apart it is enough to keep, besides a word's own
  codeword, the members of ``N1`` with a larger index.

The fingerprint is cut into three segments of 22, 21 and 21 bits (padded to
23). At most 4 wrong bits leave, by the pigeonhole principle, two segments
that have

* 0 and at most 2 errors: key = (raw first segment, codeword of the second),
  for each of the 6 ordered pairs, or
* 1 error each: key = (codeword, codeword), for each of the 3 pairs.

So every link shares a key, of 24 to 35 bits besides its kind, about 60 per
distinct fingerprint. Keys are joined by one shuffle; within each key, links
are verified by exact bit distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, col_of, connected_components, cut, indexed, pick, restore

SHINGLE = 4
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits) of each segment
GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, of the [23,12] Golay code
EXPLODED = 16384  # fingerprints whose keys one task makes
SMALL = 8  # keys with up to so many fingerprints are compared pair by pair


# -- fingerprints -----------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text (unsigned): A-Z lower-cased, words split
    at ASCII white space, a vote per ``shingle``-word shingle (repeats count),
    a bit set if more than half the shingles set it. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    buf = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = ends[min(shingle, len(words)) - 1:].tolist()
    h64 = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):  # a bounded block of hashes at a time
        h = np.array([h64(buf[s:e], 42) for s, e in zip(starts[lo:lo + 65536], last[lo:lo + 65536])], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(id, fp)`` per row; ``fp`` holds the 64 bits as a signed long."""
    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(run, "id long, fp long")


# -- Golay keys -------------------------------------------------------------

def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every 23-bit word: its 11-bit syndrome's (a) error pattern and, for
    each of the 2,048 syndromes, (b) the codeword shifts that its one-bit
    neighbours decode to, (c) how many distinct ones there are (1 or 6).

    Returned: ``lead[syndrome]``, ``shift[syndrome, 6]``, ``count[syndrome]``:
    the nearest codewords of ``x`` and its neighbours are
    ``x ^ shift[syndrome(x), :count]``, the first being that of ``x`` itself.
    """
    lead = np.zeros(2048, np.uint32)
    bits = [1 << i for i in range(23)]
    for i in range(23):
        lead[syndrome(np.array([bits[i]], np.uint32))[0]] = bits[i]
        for j in range(i):
            e = bits[i] | bits[j]
            lead[syndrome(np.array([e], np.uint32))[0]] = e
            for k in range(j):
                lead[syndrome(np.array([e | bits[k]], np.uint32))[0]] = e | bits[k]
    one = syndrome(np.array(bits, np.uint32))
    shift, count = np.zeros((2048, 6), np.uint32), np.zeros(2048, np.int64)
    for s in range(2048):
        found = list(dict.fromkeys([int(lead[s]), *(bits[i] ^ int(lead[s ^ int(one[i])]) for i in range(23))]))
        shift[s, :len(found)], count[s] = found, len(found)
    return lead, shift, count


def syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    r = x.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        r ^= np.where((r >> np.uint32(bit)) & 1 == 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    return r


def golay_keys(fp: np.ndarray, tables=None) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of fingerprints (uint64): see the module's docstring.
    The codeword index is the codeword's upper 12 bits (the code is
    systematic); key = kind (4 bits) | first part (24) | codeword (12).
    ``tables``: those of :func:`golay_tables`, if there already."""
    _, shift, count = tables or golay_tables()
    raw, words, valid = [], [], []
    for first, n in SEGMENTS:
        x = ((fp >> np.uint64(first)) & np.uint64((1 << n) - 1)).astype(np.uint32)
        s = syndrome(x)
        raw.append(x.astype(np.int64))
        words.append(((x[:, None] ^ shift[s]) >> np.uint32(11)).astype(np.int64))
        valid.append(np.arange(6) < count[s][:, None])
    rows, keys = [], []

    def put(kind: int, a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> None:
        at = np.nonzero(ok)
        rows.append(at[0])
        keys.append(((kind << 36) | (a << 12) | b)[at])

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:  # i without an error, j with at most 2
                put(kind, raw[i][:, None], words[j], valid[j])
                kind += 1
    up = [v & ((w > w[:, :1]) | (np.arange(6) == 0)) for v, w in zip(valid, words)]
    for i in range(3):
        for j in range(i + 1, 3):  # 1 error each
            put(kind, words[i][:, :, None], words[j][:, None, :], up[i][:, :, None] & up[j][:, None, :])
            kind += 1
    return np.concatenate(rows), np.concatenate(keys)


# -- links ------------------------------------------------------------------

def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected at ``max_bits`` within one key:
    breadth-first, each fingerprint is linked once, when first reached."""
    left, a, b = fps, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = distance(left, x) <= max_bits
            if near.any():
                got = left[near]
                a.append(np.full(len(got), x, np.uint64))
                b.append(got)
                queue.extend(got)
                left = left[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def key_links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of sorted ``keys`` with their fingerprints: small keys pair by
    pair (one vectorised pass per offset), larger ones by :func:`forest`."""
    if not len(keys):
        return fps[:0], fps[:0]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    a, b = [], []
    small = np.repeat((size > 1) & (size <= SMALL), size)
    k, f = keys[small], fps[small]
    for off in range(1, SMALL):
        same = k[off:] == k[:-off]
        if not same.any():
            break
        x, y = f[:-off][same], f[off:][same]
        near = distance(x, y) <= max_bits
        a.append(x[near])
        b.append(y[near])
    for at in np.flatnonzero(size > SMALL):
        x, y = forest(np.unique(fps[first[at]:first[at] + size[at]]), max_bits)
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fps(fp)`` that keep
    every connection at ``max_bits`` or less (not every pair)."""
    if max_bits > MAX_BITS:
        raise ValueError("three Golay segments guarantee links up to 4 bits only")

    tables = golay_tables()  # goes to the tasks with the function

    def explode(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fp), 4096):
                part = fp[lo:lo + 4096]
                row, key = golay_keys(part, tables)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64))], ["k", "fp"])

    def verify(batches):
        def out(x, y):
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            two = np.unique(np.stack([lo, hi]), axis=1) if len(lo) else np.stack([lo, hi])
            return pa.RecordBatch.from_arrays([pa.array(two[0].view(np.int64)), pa.array(two[1].view(np.int64))], ["a", "b"])

        held_k, held_f = [], []  # rows of the key that the last batch ended in
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(k):
                continue
            if held_k and held_k[0][0] == k[-1]:  # one key over whole batches
                held_k.append(k)
                held_f.append(f)
                continue
            k, f = np.concatenate([*held_k, k]), np.concatenate([*held_f, f])
            end = int(np.searchsorted(k, k[-1]))
            yield out(*key_links(k[:end], f[:end], max_bits))
            held_k, held_f = [k[end:]], [f[end:]]
        if held_k:
            yield out(*key_links(np.concatenate(held_k), np.concatenate(held_f), max_bits))

    one = fps.select("fp").distinct()
    # each fingerprint becomes some 60 keys: bounded tasks, whatever the table's bytes
    tasks = max(1, -(-one.count() // EXPLODED))
    keys = one.repartition(tasks, "fp").mapInArrow(explode, "k long, fp long")
    return keys.repartition("k").sortWithinPartitions("k").mapInArrow(verify, "a long, b long").distinct()


def components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` per row of ``docs``.

    Texts whose fingerprints are at most ``max_bits`` apart are linked;
    ``component_id`` is the smallest id reachable, the row's own included
    (null if all ids of the component are null). Null and empty texts have
    fingerprint 0 and link like any other; repeated rows and ids are kept;
    an empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, shingle, id_col, text_col))
    names = cut(named_fps(fps, max_bits)).withColumnRenamed("n", "_n")
    return attach(fps, names, ["fp"]).select("id", "fp", "component_id")


def named_fps(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, n, component, component_id)`` of the distinct fingerprints of
    ``fps(id, fp)``: how many rows have it; one of the component's fingerprints;
    its least id. A component that holds many fingerprints is no hot key: its
    name is broadcast (see :func:`attach`)."""
    by_fp = cut(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    comp = connected_components(links(by_fp, max_bits))
    named = cut(by_fp.join(comp, by_fp["fp"] == comp["node"], "left").select(
        "fp", "n", "least", F.coalesce("component", "fp").alias("component")))
    least = cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("_n")))
    return attach(named, least, ["component"]).select("fp", "n", "component", "component_id")


def hex16(fp):
    """A long's 64 bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document per component, columns as in ``docs``: the row with the
    smallest doc_id; among rows that repeat that id, the one of smallest text
    hash; of rows that repeat both, the smallest by its other columns. A
    component without any id keeps one row in the same way."""
    src = indexed(docs)
    key = {"_id": F.coalesce(col_of(docs, "doc_id").cast("long"), F.lit(0)),
           "_no": col_of(docs, "doc_id").isNull(),
           "_th": F.xxhash64(F.coalesce(col_of(docs, "text"), F.lit("")))}
    src = src.withColumns(key)
    fps = cut(fingerprints_keyed(src, col_of(docs, "text"), shingle))
    names = named_fps(fps.select(F.expr("if(_no, null, _id)").alias("id"), "fp"), max_bits)
    names = cut(names).select("fp", "component", F.col("n").alias("_n"))
    best = (attach(fps, names, ["fp"]).groupBy("component")
            .agg(F.min(F.struct("_no", "_id", "_th")).alias("k")).select("k.*"))
    cols = [f"_c{i}" for i in range(len(docs.columns))]
    kept = src.join(best, ["_id", "_no", "_th"], "left_semi")
    order = F.struct(*[F.col(c).cast("string") for c in cols])
    one = kept.groupBy("_id", "_no", "_th").agg(F.min_by(F.struct(*cols), order).alias("r")).select("r.*")
    return restore(one, docs)


def fingerprints_keyed(src: DataFrame, text, shingle: int) -> DataFrame:
    """``(_id, _no, _th, fp)`` of a frame with those three key columns."""
    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(3)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps.view(np.int64))], ["_id", "_no", "_th", "fp"])

    return src.select("_id", "_no", "_th", text.cast("string").alias("text")).mapInArrow(
        run, "_id long, _no boolean, _th long, fp long")
