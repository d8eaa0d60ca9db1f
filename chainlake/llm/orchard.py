"""Vector code compression: product codes found by Orchard search.

A vector of integers is cut into equal parts; each part is replaced by the
index of its nearest entry in the part position's codebook. The nearest entry
is found by Orchard's method: every entry has a list of the other entries
sorted by distance; a search stands at its best entry so far and walks that
entry's list, jumps to the list of any entry that is nearer, marks entries it
has visited, and stops where the list's distance exceeds twice the current
distance (beyond it, by the triangle inequality, nothing is nearer or equal).
The searches of a block of vectors advance together in numpy.

Codebooks follow by rounds of assignment and mean. A round is one pass over
the vectors: each task adds up its own parts per entry, Spark adds up the
tasks' sums, and the driver holds the codebooks only, whose size does not
depend on the rows. All arithmetic is on integers and exact; where 64 bits
could overflow, Python's integers step in.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, pick
from .topk import matrix

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SLICE = 4096  # vectors searched together
TOP = 2**63 - 1


def integer_rows(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding",
                 keep: str = "label") -> DataFrame:
    """``(vec_id, label, v array<long>)``, components ``floor(scale * x)``, x as
    double (held within 64 bits). Rows whose vector is null or holds a null or
    non-finite component are left out; null ids, null labels and repeated rows
    stay."""
    src = pick(vectors, vec_id=id_col, label=keep, v=vec_col).withColumn("v", F.col("v").cast("array<double>"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    return src.where(F.col("v").isNotNull() & F.coalesce(whole, F.lit(False))).select("vec_id", "label", ints.alias("v"))


# -- search ------------------------------------------------------------------

def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis."""
    d = a - b
    return (d * d).sum(-1)


def roomy(x: np.ndarray, book: np.ndarray) -> bool:
    """Whether four times any squared distance fits 64 bits."""
    most = max(float(np.abs(a.astype(np.float64)).max(initial=0)) for a in (x, book))
    return x.shape[-1] * (2 * most + 1) ** 2 < 2.0**59


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry the other entries by distance (ties: lower index), and
    their squared distances."""
    m = len(book)
    far = np.stack([squares(book, e) for e in book])
    order = np.empty((m, m - 1), np.int64)
    for i in range(m):
        ranked = sorted((far[i, j], j) for j in range(m) if j != i)
        order[i] = [j for _, j in ranked]
    return order, np.stack([far[i, order[i]] for i in range(m)])


def nearest(x: np.ndarray, book: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, ties to the
    lower index (see the module's docstring). A search starts at the entry
    nearest in the component in which the entries differ most."""
    n, m = len(x), len(book)
    if not n or not x.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order, far = lists
    spread = [int(c.max()) - int(c.min()) for c in book.T]
    axis = spread.index(max(spread))
    by = np.argsort(book[:, axis], kind="stable")
    line = book[by, axis]
    at = by[np.searchsorted(line[:-1] + (line[1:] - line[:-1]) // 2, x[:, axis])]
    best = squares(x, book[at])
    seen = np.zeros((n, m), bool)
    seen[np.arange(n), at] = True
    step = np.zeros(n, np.int64)
    live = np.arange(n if m > 1 else 0)
    while len(live):
        c, s = at[live], step[live]
        within = (far[c, s] <= 4 * best[live]).astype(bool)  # distances doubled, so squares by four
        live, c, s = live[within], c[within], s[within]
        to = order[c, s]
        step[live] = s + 1
        fresh = ~seen[live, to]
        row, to = live[fresh], to[fresh]
        seen[row, to] = True
        d = squares(x[row], book[to])
        nearer = ((d < best[row]) | ((d == best[row]) & (to < at[row]))).astype(bool)
        row, to = row[nearer], to[nearer]
        at[row], best[row], step[row] = to, d[nearer], 0  # jump to the improved entry's list
        live = live[step[live] < m - 1]
    return at, best


def slices(column: pa.ChunkedArray, parts: int, width: int):
    """Blocks of a list column as arrays (parts, rows, components), shorter
    vectors padded with zeros."""
    for lo in range(0, len(column), SLICE):
        some = column.slice(lo, SLICE)
        x = matrix(some, parts * width)
        yield np.ascontiguousarray(x.reshape(parts, width, len(some)).transpose(0, 2, 1))


def assign(x: np.ndarray, books: np.ndarray, lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, (parts, rows), of a block of vectors."""
    if not roomy(x, books):
        x, books = x.astype(object), books.astype(object)
        lists = [neighbour_lists(b) for b in books]
    found = [nearest(p, b, li) for p, b, li in zip(x, books, lists)]
    return np.stack([f[0] for f in found]), np.stack([f[1] for f in found])


# -- codebooks and codes -------------------------------------------------------

def as_array(books: list) -> np.ndarray:
    """Codebooks (parts, entries, components) as 64-bit integers."""
    return np.array(books, np.int64)


def first_books(rows: DataFrame, parts: int, entries: int) -> tuple[list, int]:
    """The parts of the vectors of the smallest ids (ties: smallest vector;
    null ids last), and the components of a part."""
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    vectors = [list(r.v) + [0] * (parts * width - len(r.v)) for r in first]
    return [[v[p * width:(p + 1) * width] for v in vectors] for p in range(parts)], width


def round_sums(rows: DataFrame, books: list, parts: int, width: int) -> DataFrame:
    """``(part, entry, pos, total, n)``: per entry that is nearest to some part
    the sum of those parts' components, and their number."""
    def run(batches):
        own, entries = as_array(books), len(books[0])
        lists = [neighbour_lists(b) for b in own] if roomy(own, own) else [None] * parts
        total = np.zeros((parts, entries, width), object)
        n = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for x in slices(pa.chunked_array([batch.column(0)]), parts, width):
                codes, _ = assign(x, own, lists)
                kind = np.int64 if float(np.abs(x.astype(np.float64)).max(initial=0)) * SLICE < 2.0**62 else object
                for p in range(parts):
                    some = np.zeros((entries, width), kind)
                    np.add.at(some, codes[p], x[p].astype(kind))
                    total[p] += some.astype(object)
                    n[p] += np.bincount(codes[p], minlength=entries)
        p, e = np.nonzero(n)
        if len(p):
            k = np.tile(np.arange(width), len(p))
            sums = pa.array([Decimal(int(t)) for t in total[p, e].ravel()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(p, width).astype(np.int32)), pa.array(np.repeat(e, width).astype(np.int32)),
                 pa.array(k.astype(np.int32)), sums, pa.array(np.repeat(n[p, e], width))], ["part", "entry", "pos", "total", "n"])

    partial = rows.select("v").mapInArrow(run, "part int, entry int, pos int, total decimal(38,0), n long")
    return partial.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list, int]:
    """Codebooks ``[part][entry][component]`` of ``rows`` (:func:`integer_rows`,
    cut) and the components of a part. Fewer vectors than ``entries`` give
    fewer entries; a vector that is not as long as the longest, or whose length
    ``parts`` does not divide, counts as padded with zeros; no vectors give
    empty codebooks."""
    books, width = first_books(rows, parts, entries)
    for _ in range(rounds if width and books[0] else 0):
        for r in round_sums(rows, books, parts, width).collect():  # codebook-sized
            books[r.part][r.entry][r.pos] = int(r.total) // r.n
    return books, width


def encode(rows: DataFrame, books: list, width: int) -> DataFrame:
    """``(vec_id, label, code array<int>, error)`` of every row: the nearest
    entry's index in each part, and the summed squared distances (at most
    2^63 - 1)."""
    parts = len(books)
    kinds = dict(rows.dtypes)

    def run(batches):
        own = as_array(books)
        lists = [neighbour_lists(b) for b in own] if width and roomy(own, own) else [None] * parts
        for batch in batches:
            done = 0
            for x in slices(pa.chunked_array([batch.column(2)]), parts, width):
                n = x.shape[1]
                codes, far = assign(x, own, lists)
                error = [min(int(e), TOP) for e in far.astype(object).sum(0)]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * parts, parts, dtype=np.int32)),
                                                pa.array(codes.T.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), batch.column(1).slice(done, n), flat,
                                                  pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])
                done += n

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, error long")


def decode(codes: DataFrame, books: list, width: int, scale: int = SCALE) -> DataFrame:
    """``codes(vec_id, code, ...)`` with ``approx``, the vectors that the codes
    stand for, in the original scale."""
    flat = F.lit([float(c) / scale for book in books for entry in book for c in entry])
    entries = len(books[0]) if books else 0
    parts = F.transform("code", lambda c, p: F.slice(flat, ((p * entries + c) * width + 1).cast("int"), F.lit(width)))
    return codes.withColumn("approx", F.flatten(parts))


def books_sha256(books: list) -> str:
    """Hex digest of all entries' components by part, entry and position."""
    flat = ",".join(str(c) for book in books for entry in book for c in entry)
    return hashlib.sha256(flat.encode()).hexdigest()


def hex_code(code):
    """Two lowercase hex digits per part."""
    return F.lower(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over equal labels,
    nulls together (at most 2^63 - 1). Frequent labels are broadcast."""
    coded = cut(coded)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(TOP).cast("decimal(38,0)")).cast("long")
    per_label = cut(coded.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("_n")))
    return attach(coded, per_label, ["label"])


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, list]:
    """``(vec_id, label, code, error, label_error)`` of every kept row, and the
    codebooks. An empty table gives no rows."""
    rows = cut(integer_rows(vectors, scale))
    books, width = train(rows, parts, entries, rounds)
    return with_label_error(encode(rows, books, width)), books
