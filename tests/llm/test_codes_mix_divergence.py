"""Vector codes, mixing and the divergence audit against brute force, and on
nulls, ties, repeated rows, empty tables and clashing names."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType)

from chainlake.llm import common, divergence, mixing, orchard, queries

SF = "/root/testdata/sf0.01"


# -- 11 ----------------------------------------------------------------------

def plain_codes(vectors, parts, entries, rounds):
    """``vectors``: (rows, components), in the order that starts the codebooks."""
    x = np.array(vectors, object).reshape(len(vectors), parts, -1)
    books = [[list(x[i, p]) for i in range(min(entries, len(x)))] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(row[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for row in x]

    for _ in range(rounds):
        best = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [row[p] for row, b in zip(x, best) if b[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    return assign(), books


def test_orchard_finds_the_nearest():
    rng = np.random.default_rng(5)
    for m, w, top in ((16, 8, 300), (1, 4, 10), (2, 1, 3), (40, 3, 4), (16, 2, 2**40)):
        book = rng.integers(-top, top, (m, w))
        book[m // 2] = book[0]  # equal entries
        x = np.concatenate([rng.integers(-top, top, (400, w)), book, (book + np.roll(book, 1, 0)) // 2])
        kind = np.int64 if orchard.roomy(x, book) else object
        x, book = x.astype(kind), book.astype(kind)
        at, far = orchard.nearest(x, book, orchard.neighbour_lists(book))
        for row, a, f in zip(x, at, far):
            assert (int(f), int(a)) == min((int(sum((int(p) - int(q)) ** 2 for p, q in zip(row, e))), k) for k, e in enumerate(book))


def test_codes_as_by_brute_force(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(-9, 9, (150, 12))
    v[40:80] = v[:40]
    rows = [(int(i) - 20, [float(c) / 4 for c in r], int(i) % 5 or None) for i, r in enumerate(v)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "vec_id long, embedding array<float>, label int").repartition(5)
    out, books = orchard.compress(df, 4, 6, 3, 4)
    best, want = plain_codes(v.tolist(), 4, 6, 3)
    assert books == want
    got = {r.vec_id: r for r in out.collect()}
    per = collections.Counter()
    for (i, _, label), b in zip(rows, best):
        assert got[i].code == [k for _, k in b] and got[i].error == sum(d for d, _ in b)
        per[label] += got[i].error
    assert all(got[i].label_error == per[label] for i, _, label in rows)
    width = 3
    approx = orchard.decode(out, books, width, 4).where("vec_id = 0").first()
    assert approx.approx == [c / 4 for p, k in enumerate(approx.code) for c in books[p][k]]


def test_codes_edge_cases(spark):
    schema = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", IntegerType()),
                         StructField("code", StringType()), StructField("_n", IntegerType()), StructField("Label", StringType())])
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0, 3.0], 1), (3, [1.0, 2.0, 3.0], 1), (3, [0.0], None), (None, [1.0, 1.0, 1.0], None), (4, None, 1), (5, [nan], 1),
            (6, [inf, 1.0], 1), (7, [None, 1.0], 2), (8, [], 2), (9, [3e38, -3e38, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)
    out, books = orchard.compress(df, 2, 4, 2)
    got = out.collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 3)] * 3 + [(False, 8), (False, 9), (True, 0)]
    assert len(books) == 2 and all(len(b) == 4 and len(b[0]) == 2 for b in books)  # padded to two parts of two
    assert all(len(r.code) == 2 and r.error >= 0 for r in got)
    assert [r.error for r in got if r.vec_id == 9] == [0]  # an entry of its own after two rounds
    far = orchard.compress(df, 2, 4, 0)[0].collect()
    assert [r.error for r in far if r.vec_id == 9] == [2**63 - 1]  # beyond 64 bits
    assert [r.label_error for r in far if r.vec_id in (8, 9)] == [2**63 - 1] * 2
    assert {r.label_error for r in got if r.label is None} == {sum(r.error for r in got if r.label is None)}
    for empty in (df.where("false"), df.where("vec_id = 8")):
        out, books = orchard.compress(empty)
        assert out.count() == empty.count() and len(books) == 8
    assert [r.code for r in orchard.compress(df.where("vec_id = 8"))[0].collect()] == [[0] * 8]


# -- 12 ----------------------------------------------------------------------

def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = {s: sum(sizes.values()) * w[s] / sum(w.values()) for s in order}
    held = set()
    while over := {s for s in order if s not in held and target[s] > cap * sizes[s] + 1e-9}:
        extra = sum(target[s] - cap * sizes[s] for s in over)
        held |= over
        target.update({s: cap * sizes[s] for s in over})
        free = [s for s in order if s not in held]
        for s in free:
            target[s] += extra * w[s] / sum(w[f] for f in free)
    return target


def check_mix(rows):
    """Targets as by rounds of resharing; words near them; copies within the
    bounds and tilted: solved by bisection, rates and copies never part by one."""
    per = collections.defaultdict(list)
    for r in rows:
        per[r.source].append(r)
    sizes = {s: sum(r.size for r in own) for s, own in per.items()}
    want = plain_targets(sizes)
    for s, own in per.items():
        assert {r.source_size for r in own} == {sizes[s]}
        assert all(math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-6) for r in own)
        assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 1.01 * max(r.size for r in own) + 1
        if not 0 < want[s] < 3 * sizes[s]:
            assert all(r.copies == 3 for r in own if want[s] and r.size)
            continue
        lo, hi = -60 / min(r.size for r in own if r.size), math.log(3) / min(r.size for r in own if r.size)
        for _ in range(200):
            mid = (lo + hi) / 2
            got = sum(r.size * min(3.0, math.exp(min(mid * r.size, 2))) for r in own)
            lo, hi = (mid, hi) if got < want[s] else (lo, mid)
        run = 0.0
        for r in sorted(own, key=lambda r: r.size):
            rate = min(3.0, math.exp(min(lo * r.size, 2)))
            assert math.floor(rate - 1e-3) <= r.copies <= math.ceil(rate + 1e-3)
            run += r.copies - rate
        assert abs(run) <= 1.01


def test_mixing_on_the_table(spark):
    rows = mixing.mix(common.table(spark, SF, "documents")).collect()
    texts = dict(common.table(spark, SF, "documents").select("doc_id", "text").collect())
    word = re.compile(r"[^\x20\x09-\x0D]+")
    assert {r.doc_id: r.size for r in rows} == {k: len(word.findall(t or "")) for k, t in texts.items()}
    check_mix(rows)
    again = mixing.mix(common.table(spark, SF, "documents").repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)


def test_mixing_hot_groups_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARE", 20)  # groups of over one row in 20 are split and broadcast
    rng = random.Random(3)
    rows = [(i, "w " * 40, "hot") for i in range(300)]  # one (source, size) group
    rows += [(1000 + i, "w " * rng.randint(1, 300), rng.choice("abcdefgh")) for i in range(300)]
    rows += [(2000 + i, "w " * rng.randint(1, 5), f"tiny{i % 4}") for i in range(12)]  # targets at the cap
    check_mix(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect())


def test_mixing_edge_cases(spark):
    schema = "doc_id long, text string, source string, size int, h int, pos int, Source string, n int"
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "other words", None), (None, "a", None), (2, None, "x"), (3, "", "empty"),
            (4, " \t\n\x0b\x0c\r ", "empty"), (5, "a\xa0b c", "Zebra"), (6, "long " * 60_000, "Zebra"), (7, "ü", "ä")]
    df = spark.createDataFrame([(*r, 0, 0, 0, "q", 0) for r in rows], schema)
    got = mixing.mix(df).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 1), (1, 2), (1, 3), (1, 3), (2, 0), (3, 0), (4, 0), (5, 2), (6, 60_000), (7, 1)]
    check_mix(got)
    assert {r.target for r in got if r.source == "empty"} == {0.0}
    assert mixing.mix(df.where("false")).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix(df.where("doc_id = 3")).collect()] == [(0.0, 0)]
    mixed = mixing.mix(df.where("doc_id >= 5"))
    plain = df.where("doc_id >= 5").toDF("doc_id", "text", "source", *[f"x{i}" for i in range(5)])
    assert collections.Counter(r.doc_id for r in mixing.expand(plain, mixed).collect()) == collections.Counter(
        {r.doc_id: r.copies for r in mixed.collect() if r.copies})


# -- 13 ----------------------------------------------------------------------

def plain_audit(rows, least, ranks):
    word, lower = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    n, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = collections.Counter(word.findall((text or "").translate(lower)))
        n.update({(lang, source, t): c for t, c in found.items()})
        docs.update((lang, t) for t in found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (la, t), c in docs.items() if la == lang and c >= least]
        own = sorted(s for la, s in groups if la == lang)

        def rates(sources):
            c = {t: sum(n[lang, s, t] for s in sources) for t in kept}
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: rates([s]) for s in own}, rates(own)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if n[lang, s, t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(sorted(pair))]
            out += [(lang, s, "term", t, -v, r + 1) for r, (v, _, t) in enumerate(sorted(term)[:ranks])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(32, 4096), (2, 7), (1, 1)])
def test_divergence_by_cells(spark, blocks):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("Ab", "é", "ß", "zz", "日本") for b in "abcdefgh"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice(["en", "de", None]), rng.choice(["a", "B", "ä", "c", "d", None]))
            for _ in range(400)]
    rows += [("rare once", "fr", "x"), (None, "fr", "y"), ("123 --", "fr", "z"), ("", "en", "silent")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = divergence.audit(df, 3, 4, *blocks).collect()
    assert sorted(tuple(r) for r in got) == plain_audit(rows, 4, 3)


def test_divergence_edge_cases(spark):
    schema = "text string, lang string, source string, n int, p int, term string, Lang string, i int"
    rows = [("One[two]three{four}FIVE\x00six'seven", "en", "a"), ("x " * 700_000 + "y", "en", "b"), (None, None, None), ("a_b`c\x7fd@e", "en", "a")]
    df = spark.createDataFrame([(*r, 0, 0, "t", "l", 0) for r in rows], schema)
    counts = {(r.lang, r.source, r.term): r.n for r in divergence.kept_counts(df, 1).collect()}
    assert counts["en", "b", "x"] == 700_000 and counts["en", "b", "y"] == 1 and counts["", "", ""] == 0
    assert {(r.lang, r.source, r.term) for r in divergence.kept_counts(df, 2).collect()} == {("en", "a", ""), ("en", "b", ""), ("", "", "")}
    assert {t for la, s, t in counts if s == "a"} == {"", "one", "two", "three", "four", "five", "six", "seven", "a", "b", "c", "d", "e"}
    assert sorted(tuple(r) for r in divergence.audit(df, 10, 1).collect()) == plain_audit(rows, 1, 10)
    assert {r.value for r in divergence.audit(df, 10, 5).collect()} == {0}  # no term is kept
    assert divergence.audit(df.where("false")).count() == 0


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "PIECE", 16)
    rows = [(" ".join(f"t{chr(97 + (i * j) % 26)}" for j in range(40)), "en", f"s{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(2)
    assert sorted(tuple(r) for r in divergence.audit(df, 10, 10).collect()) == plain_audit(rows, 10, 10)


def test_registered():
    assert {"op11_vector_codes", "op12_mixing", "op13_divergence"} <= set(queries.QUERIES)
