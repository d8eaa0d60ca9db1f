"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit check.

Texts are compared as sequences of lower-cased words. A benchmark item of
``n`` words leaks into a document if some passage is within
``floor(MAX_EDITS * n)`` word insertions, deletions or substitutions of it.

* Item-sized windows: at every word of a document, for every item length. Of
  the item's words an edit spoils one, of its neighbouring pairs at most two,
  and the window may end as many words too early: windows with fewer pairs
  from items of their length than that leaves are discarded (no loss).
* Pieces: items are cut into so many pieces that by the pigeonhole principle
  one piece of a leak has at most ``PIECE_EDITS`` edits; the pieces' windows
  are taken at every word that a leak in a window that was kept can reach.
* CGK random walk: a walk over a piece's window repeats or advances a word by the
  hashed coin of (step, word) and writes down the word it stands on; two
  sequences at a small edit distance get walks at a small Hamming distance.
* Bit-sampling LSH on the walks: each of the repetitions (a walk of its own)
  draws several tables, a table's key being the words at ``SAMPLED`` steps.
  The number of tables follows from ``RECALL`` at a share of ``AGREE`` equal
  steps, which a piece with its few edits keeps whatever the item's length and
  the kind of edits.
* Exact check: where a window's key is a piece's, the whole item is verified by
  bit-parallel approximate matching within its window and the allowed edits
  around it.

The benchmark is read in blocks of at most ``BLOCK_ITEMS`` items, so what goes
to the tasks is bounded whatever its size; each block takes one pass over the
documents, a map without a shuffle.

Null and empty texts hold no leak; items without words (or null) take no
part; items that repeat are all reported; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col_of, indexed, pick, restore

MAX_EDITS = 0.2
RECALL = 0.999
PIECE_EDITS = 1
AGREE = 0.55  # share of equal steps assumed between the walks of a piece and its copy
SAMPLED = 3
PER_WALK = 4  # tables drawn from one walk
BLOCK_ITEMS = 5000
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def n_tables(recall: float = RECALL, agree: float = AGREE, sampled: int = SAMPLED) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agree ** sampled))


def walks(ids: np.ndarray, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seeds: np.ndarray,
          steps: int) -> np.ndarray:
    """CGK walks of the windows ``words[start : start + length]``, each with
    the coins of its seed: ``out[step, window]``, the code of the word that
    the walk stands on, -2 once it has run off its window. ``ids`` maps a word
    code + 2 to a 64-bit hash."""
    out = np.empty((steps, len(starts)), np.int32)
    pos, end = starts.copy(), starts + lengths
    coins = seeds.astype(np.uint64) * np.uint64(16382) + np.uint64(1)
    for j in range(steps):
        inside = pos < end
        now = np.where(inside, words[np.minimum(pos, end - 1)], -2)
        out[j] = now
        odd = (coins + np.uint64(2 * j)) * np.uint64(0x9E3779B97F4A7C15)
        pos += ((ids[now + 2] * odd) >> np.uint64(63)).astype(np.int64) & inside
    return out


def union(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The places in any of the ranges ``lo .. hi`` (both ascending)."""
    lo = np.maximum(lo, np.concatenate(([0], hi[:-1])))
    size = np.maximum(hi - lo, 0)
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


def pieces_of(n: int, edits: int) -> list[tuple[int, int]]:
    """``(offset, length)`` of the pieces of an item of ``n`` words, one of
    which has at most ``PIECE_EDITS`` of ``edits`` edits."""
    k = min(edits // (PIECE_EDITS + 1) + 1, n)
    at = [n * j // k for j in range(k + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


class Index:
    """LSH index of one block of items (bounded by the block)."""

    def __init__(self, items: list[tuple[int, list[str]]], max_edits: float = MAX_EDITS,
                 recall: float = RECALL, agree: float = AGREE, sampled: int = SAMPLED):
        self.items = items
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        codes = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in items]
        pairs_of = [c[:-1] * len(self.vocabulary) + c[1:] for c in codes]
        self.pairs = np.unique(np.concatenate([np.empty(0, np.int64), *pairs_of]))
        self.item_pairs = [np.unique(p) for p in pairs_of]
        rng = np.random.default_rng(7)
        self.hashes = rng.integers(1, 2**64, len(self.vocabulary) + 2, dtype=np.uint64)  # of -2, -1 (foreign), words
        self.edits = [int(max_edits * len(ws)) for _, ws in items]
        tables = n_tables(recall, agree, sampled)
        self.seeds = math.ceil(tables / PER_WALK)
        by_length = defaultdict(list)
        for i, c in enumerate(codes):
            by_length[len(c)].append(i)
        self.longest = max(by_length, default=0)
        #: per length: which of the pairs of words its items have
        self.pairs_in = {n: np.isin(self.pairs, np.concatenate([pairs_of[i] for i in of])) for n, of in by_length.items()}
        #: per length of items: allowed edits, and per length of their pieces [(seed, steps of a table)],
        #: per table its sorted keys and key -> (item, offset of the piece)
        self.lengths: dict[int, tuple] = {}
        for n, of in sorted(by_length.items()):
            edits, of_size = int(max_edits * n), defaultdict(list)
            for offset, m in pieces_of(n, int(max_edits * n)):
                of_size[m].append(offset)
            joined, at = np.concatenate([codes[i] for i in of]), np.arange(len(of)) * n
            sizes = []
            for m, offsets in sorted(of_size.items()):
                # a walk passes a window in about 2m steps; its first 1.5m rarely run off
                tables_of = [(t // PER_WALK, rng.choice(self.steps(m), sampled, replace=False)) for t in range(tables)]
                places = [(i, offset) for offset in offsets for i in of]
                w = self.all_walks(joined, np.concatenate([at + offset for offset in offsets]), m)
                found = []
                for seed, steps in tables_of:
                    keys: dict[int, list[tuple[int, int]]] = {}
                    for place, key in zip(places, self.key(w[steps, seed * len(places):(seed + 1) * len(places)]).tolist()):
                        keys.setdefault(key, []).append(place)
                    found.append((np.array(sorted(keys), np.int64), keys))
                sizes.append((m, tables_of, found))
            self.lengths[n] = (edits, sizes)
        self.masks = []  # per item: word -> bits of its places
        for _, ws in items:
            mask: dict[str, int] = defaultdict(int)
            for p, w in enumerate(ws):
                mask[w] |= 1 << p
            self.masks.append(dict(mask))

    @staticmethod
    def steps(n: int) -> int:
        return max(n * 3 // 2, SAMPLED)

    def key(self, walked: np.ndarray) -> np.ndarray:
        h = np.zeros(walked.shape[1], np.uint64)
        for row in walked:
            h = (h ^ self.hashes[row + 2]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def all_walks(self, codes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """Walks of windows of length ``n`` with each seed, seed after seed."""
        m = len(starts)
        return walks(self.hashes, codes, np.tile(starts, self.seeds), np.full(m * self.seeds, n),
                     np.repeat(np.arange(self.seeds), m), self.steps(n))

    def windows(self, codes: np.ndarray):
        """Per item length the starts of the windows that may hold a leak."""
        at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
        both = codes[at] * len(self.vocabulary) + codes[at + 1]
        place = np.minimum(np.searchsorted(self.pairs, both), max(len(self.pairs) - 1, 0))
        if len(self.pairs):
            at, place = at[self.pairs[place] == both], place[self.pairs[place] == both]
        for n, (edits, _) in self.lengths.items():
            need = n - 1 - 3 * edits
            if need > 0:  # so many pairs of this length's items within n words
                q = at[self.pairs_in[n][place]] if len(self.pairs) else at[:0]
                if len(q) < need:
                    continue
                tight = np.flatnonzero(q[need - 1:] - q[:len(q) - need + 1] <= n - 2)
                lo = np.maximum(q[tight + need - 1] - (n - 2), 0)
                hi = np.minimum(q[tight], len(codes) - n)
                lo, hi = lo[lo <= hi], hi[lo <= hi]
                starts = np.unique(np.concatenate([np.empty(0, np.int64), *map(np.arange, lo, hi + 1)]))
            elif len(codes) >= n:
                known = np.concatenate(([0], np.cumsum(codes >= 0)))
                starts = np.flatnonzero(known[n:] - known[:-n] >= max(n - 2 * edits, 1))
            else:
                continue
            if len(starts):
                yield n, starts

    def candidates(self, codes: np.ndarray):
        """``(item, window start)`` of all windows with a piece that shares a table key."""
        both = np.where((codes[:-1] >= 0) & (codes[1:] >= 0), codes[:-1] * len(self.vocabulary) + codes[1:], -1)
        for n, starts in self.windows(codes):
            edits, sizes = self.lengths[n]
            for m, tables_of, found in sizes:
                # where pieces of a leak in these windows may be
                at = union(np.maximum(starts - edits, 0), np.minimum(starts + n - m + edits, len(codes) - m) + 1)
                hits = defaultdict(list)
                for lo in range(0, len(at), 10_000):
                    part = at[lo:lo + 10_000]
                    w = self.all_walks(codes, part, m)
                    for (seed, steps), (keys, places) in zip(tables_of, found):
                        key = self.key(w[steps, seed * len(part):(seed + 1) * len(part)])
                        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        same = np.flatnonzero(keys[k] == key)
                        if not len(same):
                            continue
                        k, hit = k[same], part[same]
                        order = np.argsort(k, kind="stable")
                        k, hit = k[order], hit[order]
                        edge = np.flatnonzero(np.diff(k, prepend=-1, append=-1))
                        for x, y in zip(edge[:-1], edge[1:]):
                            for item, offset in places[int(keys[k[x]])]:
                                hits[item].append(hit[x:y] - offset)
                for item, at_item in hits.items():
                    start = np.unique(np.concatenate(at_item))
                    # the item's window is one of those kept, or a leak's edits away from one
                    q = np.minimum(np.searchsorted(starts, start - edits), len(starts) - 1)
                    start = start[np.abs(starts[q] - start) <= edits]
                    if not len(start):
                        continue
                    # an edit spoils at most two of the item's pairs
                    lo = np.clip(start - edits, 0, len(both))
                    hi = np.clip(start + n + edits - 1, 0, len(both))
                    near = union(lo, hi)
                    near = near[np.isin(both[near], self.item_pairs[item])]
                    have = np.searchsorted(near, hi) - np.searchsorted(near, lo)
                    for x in start[have >= n - 1 - 2 * edits].tolist():
                        yield item, x

    def match(self, item: int, words: list[str]) -> tuple[int, int] | None:
        """The smallest edit distance of the whole item to any passage of
        ``words``, and the (first) end of such a passage; None beyond the
        allowed edits. Bit-parallel over the item (Myers 1999)."""
        n, mask = len(self.items[item][1]), self.masks[item]
        ones = (1 << n) - 1
        up, down, dist, top = ones, 0, n, 1 << (n - 1)
        best = (n, 0)
        for j, w in enumerate(words):
            eq = mask.get(w, 0)
            x = eq | down
            d0 = ((((eq & up) + up) ^ up) | x) & ones
            hp = (down | ~(d0 | up)) & ones
            hn = up & d0
            if hp & top:
                dist += 1
            elif hn & top:
                dist -= 1
            hp, hn = (hp << 1) & ones, (hn << 1) & ones
            up, down = (hn | ~(d0 | hp)) & ones, hp & d0
            if dist < best[0]:
                best = (dist, j + 1)
        return best if best[0] <= self.edits[item] else None

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """``(row, item, first word, past last word, distance)``: per text and
        item the best passage of every run of overlapping candidate windows."""
        words = [words_of(t) for t in texts]
        # one foreign word before each text, and so many at the end that the
        # last text has windows of each length
        code = self.vocabulary.get
        flat: list[int] = []
        begin = []
        for ws in words:
            flat.append(-1)
            begin.append(len(flat))
            flat.extend([code(w, -1) for w in ws])
        flat.extend([-1] * self.longest)
        found = defaultdict(set)
        begin_at = np.array(begin, np.int64)
        for item, start in self.candidates(np.array(flat, np.int64)):
            n = len(self.items[item][1])
            row = int(np.searchsorted(begin_at, start, "right")) - 1
            for r in range(max(row, 0), len(words)):  # the texts that the window meets
                if begin[r] >= start + n:
                    break
                if words[r]:
                    found[r, item].add(start - begin[r])
        out = []
        for (row, item), starts in sorted(found.items()):
            n, edits = len(self.items[item][1]), self.edits[item]
            runs: list[list[int]] = []
            for s in sorted(starts):
                lo, hi = max(s - edits, 0), min(s + n + edits, len(words[row]))
                if runs and lo <= runs[-1][1] and lo - runs[-1][0] < n:
                    runs[-1][1] = max(hi, runs[-1][1])
                elif lo < hi:
                    runs.append([lo, hi])
            last_end = -1
            for lo, hi in runs:
                got = self.match(item, words[row][lo:hi])
                if got and lo + got[1] != last_end:
                    last_end = lo + got[1]
                    out.append((row, item, max(last_end - n, 0), last_end, got[0]))
        return out


def by_size(batch: pa.RecordBatch, column: int = 1, most: int = 4_000_000):
    """Slices of a batch with up to so many bytes of text (one row at least)."""
    lo, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if total and total + n > most:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def item_blocks(benchmark: DataFrame, block_items: int = BLOCK_ITEMS):
    """The benchmark's items with words, in blocks of bounded size."""
    src = pick(benchmark, item_id="item_id", text="text").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    blocks = max(1, math.ceil(src.count() / block_items))
    # ranges of a hash hold about block_items each; one block at a time is on the driver
    for b in range(blocks):
        part = src.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = sorted(((r.item_id, words_of(r.text)) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        items = [x for x in rows if x[1]]
        if items:
            yield items


def leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, item_id, word_from, word_to, distance)``: one row per leaked
    passage (words counted from 0, the end exclusive)."""
    spark = docs.sparkSession
    src = pick(docs, doc_id=id_col, text="text").select("doc_id", F.col("text").cast("string"))
    kind = dict(src.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, word_from int, word_to int, distance int"
    out = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark):
        # bounded by the block; pickled by value, as the tasks' functions are
        sent = spark.sparkContext.broadcast({"pickled": cloudpickle.dumps(Index(items, max_edits))})

        def run(batches, sent=sent):
            kept = sent.value  # stays with the worker from task to task
            if "index" not in kept:
                kept["index"] = cloudpickle.loads(kept["pickled"])
            index = kept["index"]
            for b in batches:
                for part in by_size(b):
                    got = index.leaks(part.column(1).to_pylist())
                    if got:
                        rows, item, a, z, d = (list(x) for x in zip(*got))
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(rows)), pa.array([index.items[i][0] for i in item], pa.int64()),
                             pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(d, pa.int32())],
                            ["doc_id", "item_id", "word_from", "word_to", "distance"])

        out = out.unionByName(src.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """The rows of ``docs`` without a leak, columns as given. Rows with equal
    doc_id and text fare alike."""
    src = indexed(docs).withColumns({"_id": F.coalesce(col_of(docs, "doc_id").cast("long"), F.lit(0)),
                                     "_no": col_of(docs, "doc_id").isNull(), "_th": F.xxhash64(col_of(docs, "text"))})
    keyed = src.select(F.struct("_id", "_no", "_th").alias("key"), col_of(docs, "text").alias("text"))
    bad = leaks(keyed, benchmark, max_edits, id_col="key").select("doc_id.*").distinct()
    return restore(src.join(bad, ["_id", "_no", "_th"], "left_anti"), docs)
