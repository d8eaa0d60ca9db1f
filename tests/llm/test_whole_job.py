"""Inputs on which an operator once did less than its whole job."""

from __future__ import annotations

import random

from chainlake.llm import decontam, spans


def left_of_copy(spark, rng, passages, joint=" "):
    """Per passage the share of its words that the second of two documents
    keeps; it stands behind 3 words in one and behind 10 in the other."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    around = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for k, p in enumerate(passages):
        rows += [(2 * k, around(3) + joint + p + joint + around(9)), (2 * k + 1, around(10) + joint + p + joint + around(4))]
    got = {r.doc_id: r.text for r in spans.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(d % 2 == 0 for d in got)
    return [max(len(got.get(2 * k + 1, rows[2 * k + 1][1]).split()) - 14, 0) / len(p.split()) for k, p in enumerate(passages)]


def test_passages_begun_mid_sentence(spark):
    rng = random.Random(21)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    plain = left_of_copy(spark, rng, [say(n) for n in (60, 120, 300, 1000) for _ in range(5)])
    assert max(plain) < 0.65 and max(plain[10:]) < 0.12
    assert max(left_of_copy(spark, rng, [say(30) + ". " + say(30) for _ in range(10)])) < 0.65
    assert max(left_of_copy(spark, rng, [". ".join(say(15) for _ in range(4)) for _ in range(10)])) < 0.65


def test_passages_of_short_lines(spark):
    rng = random.Random(22)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    verse = ["\n".join(" ".join(word() for _ in range(n)) for _ in range(400 // n)) for n in (1, 2, 3)]
    verse.append(" ".join(word() + "." for _ in range(200)))
    assert all(sum(len(w) for _, _, w in run) >= spans.SPAN_WORDS
               for v in verse for p in [spans.sentences(v)] for run in zip(p, p[1:], p[2:]))
    assert max(left_of_copy(spark, rng, verse, "\n")) < 0.12
    # a passage that repeats inside one document stays once
    text = "\n".join(["Yes.\nNo.\nWho knows?"] * 100)
    got = spans.duplicates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(got.text.split()) < 80


def test_leaks_with_every_allowed_edit():
    """Exactly the allowed number of edits, of one kind, in items of any length."""
    rng = random.Random(23)
    word = lambda: f"w{int(4000 * rng.random() ** 3)}"
    for n in (10, 15, 45, 59, 100, 200, 300):
        items = [[word() for _ in range(n)] for _ in range(10)]
        index, texts = decontam.Index(list(enumerate(items))), []
        for kind in ("deleted", "inserted", "replaced", "mixed", "spread"):
            for item in items * 2:
                edits, words = int(decontam.MAX_EDITS * n), list(item)
                for p in [k * n // edits for k in range(edits)][::-1] if kind == "spread" else sorted(rng.sample(range(n), edits))[::-1]:
                    how = {"mixed": rng.choice(["deleted", "inserted", "replaced"]), "spread": "deleted"}.get(kind, kind)
                    words[p:p + (how != "inserted")] = [] if how == "deleted" else [f"x{rng.random()}".replace(".", "")]
                texts.append(" ".join([*(word() for _ in range(9)), *words, *(word() for _ in range(9))]))
        got = {(row, item) for row, item, *_ in index.leaks(texts)}
        assert sum((k, k % 10) in got for k in range(len(texts))) >= decontam.RECALL * len(texts)


def test_deep_and_broken_pages_take_linear_time():
    import time

    from chainlake.llm import pages

    model = pages.trained()
    article = "<p>" + "A long enough sentence of the article, with commas, and an end. " * 6 + "</p>"

    def seconds(n):
        worst = 0.0
        for html in ("<div class='a'>" * n + article + "</div>" * n, "".join(f"<div class='c{i} x'>" for i in range(n)) + article,
                     "<b><table>" + "<i>t" * n + "</b>" * n, "<section>x" * n + "</span>" * n, "<ul>" + "<li>one<p>two" * n,
                     "<p>a" * n + article + "</div>" * n):
            t = time.process_time()
            pages.main_text(html, model)
            worst = max(worst, time.process_time() - t)
        return worst
    seconds(200)
    assert seconds(16_000) < 20 * max(seconds(2_000), 0.05)


def test_pages_without_head_end_or_body():
    from chainlake.llm import pages

    model = pages.trained()
    inner = ("<article><h1>A heading</h1>" + "".join(f"<p>Paragraph {i} of the article has a few words, and it ends here.</p>" for i in range(6)) + "</article>")
    whole = pages.main_text(f"<html><head><title>t</title><meta charset=x></head><body>{inner}</body></html>", model)
    assert whole.count("Paragraph") == 6
    for start in ("<html><head><title>t</title><meta charset=x>", "<head><script>var a = '<p>';</script><title>t</title><link rel=x>", "<title>t</title>"):
        assert pages.main_text(start + inner, model) == whole
    assert "Loose words" in "".join(t for t, _, _ in pages.blocks("<head><meta a=b>Loose words first<p>then more"))
    assert pages.blocks("<head><noscript><img src=x></noscript><style>p {}</style><p>text") == pages.blocks("<head></head><p>text")


def test_short_repeated_runs_go_too(spark):
    """Three repeated sentences of 18 words: the first document keeps them; a
    least number of words can be asked for."""
    own = lambda k: " ".join(f"Document {k} says{k}{i} something{i}{k} of its own{k} here." for i in range(6))
    run = "Rivers carry silt down to plains. Hills keep their snow until spring. Valleys wait for both of them. "
    df = spark.createDataFrame([(k, f"{own(k)} {run}{own(k + 100)}") for k in range(3)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in spans.duplicates(df).collect()}
    assert set(got) == {1, 2} and all("Hills keep their snow" not in t and f"Document {k} says" in t for k, t in got.items())
    assert spans.duplicates(df, min_words=25).count() == 0
