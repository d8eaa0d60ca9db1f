"""Each operator against a brute-force version, a library, an exact round
trip, or held-out labels."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chainlake.llm import (chat, common, decontam, pages, quality, queries, sentencepiece_bpe, sharding, simhash, spans,
                           topk, toxicity)
from chainlake.llm.labelled_pages import Page

SF = "/root/testdata/sf0.01"


def classes(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


# -- SQL twins ---------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    rel = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(rel.fetchall())


# -- 1 -----------------------------------------------------------------------

def test_topk_blocks_and_ties(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-3, 4, (300, 40))
    v[100:200] = v[:100]  # many ties
    rows = [(int(i), [float(x) / 64 for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(topk.integer_vectors(df), F.col("vec_id") % 20 == 0, 7, query_block=4, block=60).collect()
    want = set()
    for q in range(0, 300, 20):
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-int(v[q] @ v[i]), i))[:7]
        want |= {(q, r + 1, i, int(v[q] @ v[i])) for r, i in enumerate(order)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want


def test_topk_beyond_double_precision():
    q = np.array([[2**40], [1]])
    x = np.array([[2**20, 2**20, 2**20], [1, 2, 3]])
    got = list(topk.search_block(np.array([9]), q, np.array([3, 2, 1]), x, 2, 1))
    assert [(i, s) for _, i, s in got] == [(2, 2**60 + 3), (1, 2**60 + 2)]


# -- 2 -----------------------------------------------------------------------

def test_crf_on_held_out_pages():
    model, wrong, total = pages.trained(), 0, 0
    for seed in range(5000, 5100):
        html, labels = Page(seed).build()
        page = pages.blocks(html)
        wrong += sum(labels.get(b[0], 0) != y for b, y in zip(page, model.viterbi(pages.features(page))))
        total += len(page)
    assert wrong < 0.02 * total


def test_viterbi_is_the_best_sequence():
    rng = random.Random(1)
    for _ in range(50):
        names = [f"f{i}" for i in range(6)]
        model = pages.ChainCRF({n: rng.uniform(-2, 2) for n in names}, np.array([[rng.uniform(-2, 2) for _ in "ab"] for _ in "ab"]))
        page = [rng.sample(names, 2) for _ in range(7)]

        def worth(ys):
            node = sum(y * sum(model.weights[f] for f in b) for y, b in zip(ys, page))
            return node + sum(model.trans[a, b] for a, b in zip(ys, ys[1:]))

        best = max(worth([m >> i & 1 for i in range(7)]) for m in range(128))
        assert abs(worth(model.viterbi(page)) - best) < 1e-9


def test_articles_of_the_table(spark):
    import html

    rows = queries.op2_html(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(b.replace("<br>", " ").replace("<b>", "")).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


# -- 3 -----------------------------------------------------------------------

def told(turns):
    return hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()


def test_chat_digests(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    probe = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    by = collections.defaultdict(list)
    for c, _, role, text in sorted(rows):
        by[c].append((role, text))
    got = {r.conv_id: r for r in queries.op3_chat(spark, SF).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars) == (len(turns), told(turns), len(loss))
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_windows(spark):
    """Small budget and blocks of 8 turns: windows keep to the budget, begin
    with the system turn, repeat limited history (of their block and the one
    before), and hold every turn anew exactly once, in order."""
    rng = random.Random(4)
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 150 if c < 3 else 12)):
            role = "system" if t == 0 and c % 2 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, "w#<\\é " * rng.choice([0, 1, 5, 20, 20, 90])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(df, budget=200, history=40, block=8).withColumn("turns", chat.read_turns(F.col("text")))
    by = collections.defaultdict(list)
    for r in made.collect():
        by[r.conv_id].append(r)
    tokens = lambda t: -(-len(f"### {t[0]}: {escaped(t[1])}</turn>\n".encode()) // 4)
    escaped = lambda x: x.replace("\\", "\\b").replace("#", "\\h").replace("<", "\\l")
    for c, ws in by.items():
        turns = [(r[2], r[3]) for r in rows if r[0] == c]
        ws.sort(key=lambda r: (r.block, r.window))
        fresh = []
        for i, w in enumerate(ws):
            old, new = [tuple(t) for t in w.turns[:w.n_repeated]], [tuple(t) for t in w.turns[w.n_repeated:]]
            assert new
            system = turns[:1] if turns[0][0] == "system" and i else []
            assert old[:len(system)] == system
            history = old[len(system):]
            before = turns[:len(fresh)]
            assert history == (before[-len(history):] if history else [])
            assert sum(map(tokens, history)) <= 40
            longer = before[-len(history) - 1:-len(history) or None]  # one turn more would be too much
            in_reach = len(before) - max(8 * (w.block - 1), len(system))
            if longer and len(history) < in_reach:
                assert sum(map(tokens, longer + history)) > 40
            if len(new) > 1 and sum(map(tokens, system)) <= 110:
                assert sum(map(tokens, system + history + new)) <= 200
            targets = [w.text[s.start:s.start + s.chars] for s in w.loss]
            assert targets == [escaped(x) for r, x in new if r == "assistant"]
            fresh += new
        assert fresh == turns


# -- 4 -----------------------------------------------------------------------

def edits_to_passage(item, words):
    """Smallest edit distance of ``item`` to any passage of ``words``."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(4000)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randrange(10, 60))]) for i in range(60)]
    docs = []
    for d in range(400):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(80))]
        if d % 2:
            words = list(items[d % 60][1])
            for _ in range(rng.randrange(int(0.25 * len(words)) + 1)):
                p = rng.randrange(len(words))
                words[p:p + rng.choice([0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1])
            at = rng.randrange(len(text) + 1)
            text[at:at] = words
        docs.append((d, text))
    df = spark.createDataFrame([(d, ", ".join(t).title()) for d, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(df, bench).collect()}
    want = {}
    for d, t in docs:
        for i, item in items:
            e = edits_to_passage(item, t)
            if e <= int(decontam.MAX_EDITS * len(item)):
                want[d, i] = e
    assert set(got) <= set(want)
    assert all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.98 * len(want) and len(want) > 100
    assert all(k in got for k, e in want.items() if e == 0)


def test_every_leak_of_the_table(spark):
    docs = [(r.doc_id, " " + " ".join(decontam.words_of(r.text)) + " ") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, " " + " ".join(decontam.words_of(r.text)) + " ") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    assert {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, SF).collect()} >= want and want


# -- 5 -----------------------------------------------------------------------

def slow_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())[:400]
    df = spark.createDataFrame([*rows, (1000, "İ ÀB\x0bcd\x85x"), (1001, "")], "doc_id long, text string")
    got = {r.id: r for r in simhash.components(df).collect()}
    fps = {d: slow_fingerprint(t) for d, t in [*rows, (1000, "İ ÀB\x0bcd\x85x"), (1001, "")]}
    assert {d: r.fp % 2**64 for d, r in got.items()} == fps
    ids = sorted(fps)
    root = classes(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= 4])
    assert [got[d].component_id for d in ids] == [ids[r] for r in root]


def test_links_lose_no_connection(spark):
    """Random walks of 1 to 4 flipped bits, a large dense group, and noise."""
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(1500):
        fps.append(fps[rng.randrange(len(fps))] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
    centre = rng.getrandbits(64)
    fps += [centre ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(700)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    at = {f: i for i, f in enumerate(fps)}
    a = np.array(fps, np.uint64)
    every = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 4)]
    assert classes(len(fps), [(at[x], at[y]) for x, y in edges]) == classes(len(fps), every)
    assert len(edges) < len(every)


def test_golay_keys_guarantee():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    keys = [collections.defaultdict(set) for _ in range(2)]
    for k, v in zip(keys, (x, y)):
        for row, key in zip(*simhash.golay_keys(v)):
            k[row].add(key)
    assert all(keys[0][i] & keys[1][i] for i in range(len(x)))


def test_connected_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    edges += [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(350)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in common.connected_components(df).collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    root = classes(len(nodes), [(at[a], at[b]) for a, b in edges])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == linked
    pairs = {(got[n], root[at[n]]) for n in linked}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


# -- 6, 7 --------------------------------------------------------------------

@pytest.mark.parametrize("module, label, query, least", [(toxicity, "toxic", queries.op6_toxicity, 0.9), (quality, "quality", queries.op7_quality, 0.95)])
def test_held_out_accuracy(spark, module, label, query, least):
    sf = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else SF
    out = query(spark, sf).where("held_out")
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", label).collect()
    y, p = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    assert (p[y == 1]).mean() >= least and (1 - p[y == 0]).mean() >= 0.95
    s = np.array([r[0] for r in rows])
    pos, neg = s[y == 1], s[y == 0]
    assert np.mean([(pos > n).mean() + 0.5 * (pos == n).mean() for n in neg]) > 0.95


def test_rules_as_columns(spark):
    """The compiled expression equals the rules applied in numpy."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5)).astype(int)
    rules = quality.fit_rules(x, y, ["a", "b", "c"])
    names = {"a": 0, "b": 1, "c": 2}
    z = rules.intercept + sum(w * np.logical_and.reduce([(x[:, names[n]] > c) == g for n, g, c in rule]) for w, rule in rules.rules)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    got = [r.s for r in df.select("i", rules.column({n: F.col(n) for n in names}).alias("s")).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z)))
    assert (((np.array(got) > 0.5) == y).mean()) > 0.97


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " tras": 3.0}, [toxicity.fold("pocket trash")], (0.0, 1.0, 0.0))
    auto = lexicon.automaton()
    score = lambda t: toxicity.Lexicon.features(auto, t)[0]
    assert score("You IDIOT!") == score("you 1d10t") == score("you іdiоt") == score("you ｉｄｉｏｔ") == score("i​diot") == 5
    assert score("idiotic trashy") == 3 and score("pocket trash") == 0 and score("trash, pocket trash") == 3
    assert score(None) == score("") == 0


# -- 8 -----------------------------------------------------------------------

def test_encoding_equals_the_library():
    import sentencepiece

    path = queries.tokenizer_path()
    with open(path, "rb") as f:
        mine = sentencepiece_bpe.Encoder(f.read())
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(8)
    alphabet = list("aeiounrst  ▁\n\t.,<>/0123éß漢字😀\x00﻿ﬁ") + ["the ", "ing", "  ", " a", "<s>", "<0x41>", "▁▁"]
    texts = ["", " ", " " * 40 + "x", "aaaa" * 300, "ab" * 900, "0" * 700, "́" * 9]
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(5000)]
    for t in texts:
        ids = lib.encode(t)
        assert mine.encode(t) == ids, t
        assert mine.decode(ids) == lib.decode(ids)
    some = ["".join(rng.choices("etaoin shr", k=rng.randrange(2, 14))).replace(" ", "▁") for _ in range(2000)]
    assert all(mine.pieces(c) == mine.merge(c) for c in some if c)


def test_tokens_of_the_table(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    got = {r.doc_id: r for r in queries.op8_sentencepiece(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = lib.encode(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


# -- 9 -----------------------------------------------------------------------

def slow_spans(rows):
    """Sentences to remove per document, every run compared as text."""
    places, parts = collections.defaultdict(list), {}
    for d, text in rows:
        p = parts[d] = spans.sentences(text)
        for a in range(len(p) - 2):
            run = tuple(tuple(w) for _, _, w in p[a:a + 3])
            if sum(map(len, run)) >= spans.SPAN_WORDS:
                places[run].append((d, a))
    hit = collections.defaultdict(set)
    for v in places.values():
        for d, a in sorted(v)[1:]:
            hit[d].update(range(a, a + 3))
    gone = {}
    for d, h in hit.items():
        stretches = []
        for k in sorted(h):
            if stretches and stretches[-1][-1] == k - 1:
                stretches[-1].append(k)
            else:
                stretches.append([k])
        whole = {k for s in stretches for k in s if sum(len(parts[d][i][2]) for i in s) >= spans.MIN_WORDS}
        if whole:
            gone[d] = whole
    return parts, gone


def test_substring_dedup(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(1, 7)))
    say = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice(". . . ! ?".split()) + rng.choice([" ", " ", "\n"])
    passages = ["".join(say(rng.choice([1, 4, 9, 14, 40])) for _ in range(6)) for _ in range(8)] + [say(60), say(55) + say(3)]
    rows = []
    for d in range(120):
        body = [say(rng.choice([1, 5, 12, 20])) for _ in range(rng.randrange(12))]
        for p in rng.sample(passages, rng.randrange(3)):
            body.insert(rng.randrange(len(body) + 1), "\n" + (p.upper() if d % 5 == 0 else p) + "\n")
        rows.append((d, "".join(body)))
    rows += [(200, rows[3][1]), (201, rows[7][1] + " And more.")]
    got = {r.doc_id: r for r in spans.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    parts, gone = slow_spans(rows)
    assert set(got) == set(gone) and len(gone) > 40
    for d, text in rows:
        if d in gone:
            p = parts[d]
            keep = text[:p[0][0]] + "".join(text[a:b] for k, (a, b, _) in enumerate(p) if k not in gone[d])
            assert got[d].text == keep.rstrip() and got[d].n_sentences == len(gone[d])
            assert all(k in range(d + 1) for k in got[d].kept_in) and got[d].kept_in
    # every later copy of a passage of over 50 words goes as a whole
    for p in passages:
        flat = " ".join(p.lower().split())
        if len(flat.split()) > 50:
            whole = [d for d, t in rows if flat in " ".join(t.lower().split())]
            assert all(flat not in " ".join(got[d].text.lower().split()) for d in whole[1:])


# -- 10 ----------------------------------------------------------------------

def test_lookup_table():
    names = sharding.shard_names(7)
    table = sharding.lookup_table(names, 101)
    counts = collections.Counter(table)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    # claims in turns, slot by slot, by each shard's own permutation
    orders = [[(sharding.number("offset " + s) % 101 + j * (sharding.number("skip " + s) % 100 + 1)) % 101 for j in range(101)] for s in names]
    assert all(sorted(o) == list(range(101)) for o in orders)
    owner = {}
    while len(owner) < 101:
        for i, o in enumerate(orders):
            if len(owner) < 101:
                owner[next(s for s in o if s not in owner)] = i
    assert table == [owner[s] for s in range(101)]


def test_few_keys_move():
    full, less = (sharding.lookup_table(sharding.shard_names(n), 65537) for n in (64, 63))
    moved = sum(a != b for a, b in zip(full, less) if a != 63)
    assert moved < 0.05 * 65537


def test_write_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/out", sharding.shard_names(8))
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count()
    want = {r.doc_id: r.shard for r in sharding.place(docs, sharding.shard_names(8)).collect()}
    assert {r.doc_id: r.shard for r in back.select("doc_id", "shard").collect()} == want


# -- pipeline ----------------------------------------------------------------

def test_pipeline(spark):
    import sentencepiece

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, rules).where("score >= 0.3").collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in good]
    fps = [slow_fingerprint(t) for _, t in rows]
    root = classes(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    parts, gone = slow_spans(rows)
    rows = [(d, (t[:parts[d][0][0]] + "".join(t[a:b] for k, (a, b, _) in enumerate(parts[d]) if k not in gone[d])).rstrip() if d in gone else t) for d, t in rows]
    items = [decontam.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not any(edits_to_passage(i, decontam.words_of(t)) <= int(decontam.MAX_EDITS * len(i)) for i in items)]
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    want = {d: (lib.encode(t), lib.decode(lib.encode(t))) for d, t in rows}
    got = {r.doc_id: (list(r.ids), r.decoded) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 50 < len(got) < docs.count()
    assert corpus_pipeline.ORACLE_SQL is None


# -- 6: folding and matching ---------------------------------------------------

def plain_matches(lexicon, text):
    """Lexicon.features by search at every place of the folded text."""
    t = toxicity.fold(text)
    spared = [(i, i + len(p)) for p in lexicon.exceptions for i in range(len(t)) if t.startswith(p, i)]
    total = 0.0
    for i in range(len(t)):
        found = [w for term, w in lexicon.terms.items() if t.startswith(term, i)]
        if found and not any(lo <= i < hi - 1 for lo, hi in spared):
            total += max(found)
    return total, float(len(t.split()))


def test_matching_by_search():
    rng = random.Random(66)
    word = lambda: "".join(rng.choices("abil1!$ 0", k=rng.randint(1, 4)))
    for _ in range(200):
        terms = {(" " + toxicity.fold(word()).strip() + rng.choice([" ", ""])): round(rng.uniform(0.5, 5), 2) for _ in range(rng.randint(0, 12))}
        terms = {k: v for k, v in terms.items() if k.strip()}
        phrases = [p for p in (toxicity.fold(word() + " " + word()) for _ in range(rng.randint(0, 4))) if p.strip() and p not in terms]
        lexicon = toxicity.Lexicon(terms, phrases, (0.0, 1.0, 0.0))
        auto = lexicon.automaton()
        for _ in range(20):
            text = " ".join(word() for _ in range(rng.randint(0, 12)))
            got, want = toxicity.Lexicon.features(auto, text), plain_matches(lexicon, text)
            assert abs(got[0] - want[0]) < 1e-9 and got[1] == want[1], (text, terms, phrases)


def test_folding_of_disguises():
    same = lambda *words: len({toxicity.fold(w) for w in words}) == 1
    assert same("clown", "c1own", "c|own", "c!own", "CLOWN", "clówn", "ｃｌｏｗｎ", "𝐜𝐥𝐨𝐰𝐧", "𝐂𝐋𝐎𝐖𝐍")
    assert same("trash", "tra$h", "tr4$h", "7rash") and same("scum", "$cum", "5cum") and same("pigs", "pi9s", "pi6$", "p|gs")
    assert toxicity.fold("Really! I paid $ 5 | no").split() == ["reaiiy", "i", "paid", "s", "no"]


def test_disguised_toxic_rows_are_found(spark):
    """Recall on the labelled toxic rows with their words disguised, against
    the plain spelling; clean rows with the same disguises stay clean."""
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    lexicon = toxicity.train(docs, labels)
    auto = lexicon.automaton()
    rows = docs.join(labels.where("toxic is not null"), "doc_id").select("text", "toxic").collect()
    def share(toxic, disguise):
        own = [toxicity.Lexicon.features(auto, disguise(r.text or "")) for r in rows if r.toxic == toxic]
        total, words = (np.array(c) for c in zip(*own))
        return float((lexicon.score(total, words) >= toxicity.THRESHOLD).mean())
    ways = [lambda t: t, lambda t: t.replace("l", "1"), lambda t: re.sub(r"(?<=\w)i(?=\w)", "!", t).replace("s", "$"),
            lambda t: t.replace("a", "á").replace("e", "ê"), lambda t: t.replace("g", "9").replace("o", "0")]
    found, wrong = [share(1, w) for w in ways], [share(0, w) for w in ways]
    assert min(found) >= found[0] - 0.05 and found[0] > 0.9, found
    assert max(wrong) <= wrong[0] + 0.01 and wrong[0] < 0.01, wrong
