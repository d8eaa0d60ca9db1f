"""Nulls in any column, empty and very long texts, ties, repeated rows, empty
tables and further columns with clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType)

import corpus_pipeline
from chainlake.llm import (chat, decontam, pages, quality, queries, sentencepiece_bpe, sharding, simhash, spans, topk,
                           toxicity)

PROSE = " ".join(f"Sentence number {i} speaks of rivers and of hills that nobody counted." for i in range(12))
LONG = " ".join(f"w{i % 977} and." if i % 9 == 0 else f"w{i * 7919 % 10007}" for i in range(60_000))
DOCS = [(1, PROSE, "en", "a", 10), (1, PROSE, "en", "a", 10), (1, "other text of the same id", None, "a", None),
        (2, None, "en", None, None), (3, "", None, "b", 0), (None, PROSE, "en", "b", 1), (None, None, None, None, None),
        (None, PROSE, "en", "b", 1), (4, " \n\t ", "en", "b", 3), (5, LONG, "de", "c", len(LONG)), (6, LONG, "de", "c", len(LONG)),
        (7, "\x00 ﻿ 😀 \\### </turn> ▁▁ ﬁ", "fr", "d", 5), (8, "the item text that benchmark eight words long holds", "en", "d", 9)]
CLASH = ["id", "fp", "key", "_id", "_th", "_no", "h1", "score", "spans", "component_id", "slot", "shard", "TEXT", "Doc_Id", "_c0", "new", "y"]
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType())]
                    + [StructField(c, IntegerType()) for c in CLASH])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *range(len(CLASH))) for r in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "Item text that benchmark EIGHT words, long holds"), (2, None), (3, ""), (None, "item TEXT that benchmark eight words long holds")],
                                 "item_id long, text string").withColumn("doc_id", F.lit(0))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i % 9, i % 2, i % 3 == 0) for i in range(20)] + [(None, 1, True), (3, None, None)]
    return spark.createDataFrame([(a, b, None if c is None else int(c)) for a, b, c in rows], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))


def keys(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: tuple((x is None, x) for x in t))


def same_columns(out, docs):
    assert out.dtypes == docs.dtypes
    return plain(out)


def plain(df):
    """The table without name clashes."""
    return df.toDF(*df.columns[:5], *[f"x{i}" for i in range(len(df.columns) - 5)])


def test_simhash(docs, none):
    rows = simhash.components(docs).collect()
    assert len(rows) == len(DOCS)
    by = {}
    for r in rows:
        by.setdefault((r.id, r.fp), set()).add(r.component_id)
    assert all(len(v) == 1 for v in by.values())
    empty = [r for r in rows if r.fp == 0]
    assert len(empty) == 4 and {r.component_id for r in empty} == {2}  # ids 2, 3, 4 and a null
    assert {r.component_id for r in rows if r.id is None and r.fp != 0} == {1}
    kept = same_columns(simhash.dedup(docs), docs)
    assert [k[0] for k in keys(kept, "doc_id")] == [1, 1, 2, 5, 7, 8]
    assert simhash.components(none).count() == 0 and plain(simhash.dedup(none)).count() == 0


def test_simhash_without_any_id(docs):
    got = simhash.dedup(plain(docs).where("doc_id is null").toDF(*docs.columns))
    assert got.count() == 2  # the empty text and the prose


def test_spans(docs, none):
    out = {(r.doc_id): r for r in spans.duplicates(docs).collect()}
    assert out[1].text == "" and out[1].kept_in == []  # the rows without id come first and keep the passage
    assert out[6].text.strip() == "" and 5 in out[6].kept_in
    assert 2 not in out and 3 not in out and 4 not in out and 7 not in out
    cut = same_columns(spans.dedup(docs), docs)
    assert cut.count() == len(DOCS)
    assert cut.where("doc_id is null and text like 'Sentence%'").count() == 2  # copies of one row fare alike
    assert cut.where("doc_id = 6").first().n_chars == len(out[6].text)
    assert spans.duplicates(none).count() == 0 and plain(spans.dedup(none)).count() == 0


def test_decontamination(docs, none, bench):
    got = decontam.leaks(docs, bench)
    assert keys(got, "doc_id", "item_id", "distance") == [(8, 1, 0), (8, None, 0)]
    left = same_columns(decontam.clean(docs, bench), docs)
    assert left.count() == len(DOCS) - 1 and left.where("doc_id = 8").count() == 0
    assert decontam.leaks(none, bench).count() == 0
    assert decontam.leaks(docs, bench.where("false")).count() == 0
    assert decontam.leaks(docs, bench.where("item_id in (2, 3)")).count() == 0


def test_quality(docs, none, labels):
    rules = quality.train(docs, labels)
    out = quality.score(docs, rules)
    assert out.count() == len(DOCS) and out.where("score is null or score < 0 or score > 1 or isnan(score)").count() == 0
    assert same_columns(quality.keep_good(docs, rules, 0.0), docs).count() == len(DOCS)
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(docs, labels.where("false")).where("held_out is null or score <> 0.5").count() == 0


def test_toxicity(docs, none, labels):
    out = toxicity.classify(docs, labels)
    assert out.count() == len(DOCS) and out.where("score is null or score < 0 or score > 1 or predicted is null").count() == 0
    assert toxicity.classify(none, labels).count() == 0
    assert toxicity.classify(docs, labels.where("false")).where("abs(score - 0.5) > 1e-9").count() == 0


def test_tokenizer(docs, none):
    out = sentencepiece_bpe.tokenize(docs, queries.tokenizer_path())
    assert out.count() == len(DOCS)
    assert {tuple(r.ids) for r in out.where("doc_id in (2, 3)").collect()} == {()}
    assert out.where("doc_id = 5").first().decoded == LONG
    assert sentencepiece_bpe.tokenize(none, queries.tokenizer_path()).count() == 0


def test_sharding(docs, none):
    out = sharding.place(docs)
    assert out.columns == docs.columns + ["slot", "shard"]
    rows = out.toDF(*[f"c{i}" for i in range(len(out.columns))]).collect()
    assert len(rows) == len(DOCS) and all(r[-1] for r in rows)
    assert len({r[-1] for r in rows if r[0] == 1}) == 1  # one key, one shard
    assert sharding.place(none).count() == 0


def test_topk(spark):
    v = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("score", IntegerType())])
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 1), (2, [1.0, 1.0], 1), (3, None, 1), (4, [nan, 1.0], 1),
            (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (None, [1.0, 1.0], 1), (7, [], 1), (8, [3.0], 1), (9, [-1.0, 0.5, 2.0], 1)]
    df = spark.createDataFrame(rows, v)
    got = topk.search(topk.integer_vectors(df), F.col("vec_id") % 20 == 0, 4).collect()
    # rows that repeat an id are candidates of their own: every row but the query's
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 12288), (2, 2, 12288), (3, 2, 12288), (4, 8, 12288)]
    two = df.where("vec_id in (0, 1)").unionByName(df.where("vec_id = 1").withColumn("vec_id", F.lit(0).cast("long")))
    found = topk.search(topk.integer_vectors(two), F.col("vec_id") % 20 == 0, 4).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [
        (0, 1, 0, 12288), (0, 1, 0, 12288), (0, 2, 1, 8192), (0, 2, 1, 12288)]
    assert topk.search(topk.integer_vectors(df.where("false")), F.col("vec_id") % 20 == 0, 4).count() == 0
    assert topk.search(topk.integer_vectors(df.where("vec_id > 0")), F.col("vec_id") % 20 == 0, 4).count() == 0


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain words, no tags at all."), (3, "u", "<p>a<p>b</div></p>&am; &amp x"),
            (4, "u", "<article><h1>T&eacute;st</h1><p>" + "long text. " * 50_000 + "</article><!-- never closed"),
            (4, "u", "<script>var x = '<p>hidden</p>'"), (5, "u", "<" * 1000 + "</" * 1000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text int")
    out = pages.extract(df)
    assert out.count() == len(rows) and out.where("text is null").count() == 0
    long = max((r.text for r in out.collect()), key=len)
    assert long.startswith("Tést\n\nlong text. long") and long.count("long") == 50_000
    assert pages.extract(df.where("false")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 1, "user", None), (1, 2, None, "x"), (1, None, "assistant", "early"),
            (None, 0, "assistant", "</turn>\n### user: "), (None, None, None, None), (2, 0, "as:si\\c#st", "\\b\\h\\l<#\\"),
            (3, 0, "assistant", ""), (3, 1, "assistant", "long " * 40_000), (3, 2, "user", "q"), (3, 3, "assistant", "tail")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, before int")
    got = {r.conv_id: r for r in chat.read_back(chat.windows(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("assistant", "early"), ("system", "be kind"), ("user", ""), ("user", ""), ("", "x")]
    assert [tuple(t) for t in got[None].turns] == [("", ""), ("assistant", "</turn>\n### user: ")]
    assert [tuple(t) for t in got[2].turns] == [("as:si\\c#st", "\\b\\h\\l<#\\")]
    assert got[3].loss_text == "long " * 40_000 + "tail" and len(got[3].turns) == 4
    assert chat.windows(df.where("false")).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, docs, none, labels, bench, stage, tmp_path):
    """Each stage over the same rows, its other tables beside them."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
    assert out.count() <= len(DOCS)
    if stage < len(corpus_pipeline.STAGES) - 1:
        same_columns(out, docs)
    assert corpus_pipeline.STAGES[stage][1](spark, none, str(tmp_path)).count() == 0
