"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first, and the lexicon is learned on folded texts, so both
sides agree: lower case, compatibility forms decomposed and marks stripped
(accents, mathematical and full-width letters), homoglyphs (Cyrillic, Greek)
and digit substitutions to the plain letter, ``i l 1 ! |`` to one class, ``$``
to s, invisible characters removed, punctuation to spaces. ``! | $`` stand for
letters only beside other letters of a word. The lexicon is learned on a
bounded sample of labelled documents: whole words and word beginnings that
occur mostly in toxic rows, counted by rows and by contexts (the word before),
so that the words of a toxic text with many copies stay out. Phrases of a term
and the word before it that stand in clean documents only are exceptions and
cancel the match inside them, as do the given ones (``EXCEPTIONS``).

The score is a logistic function, fitted on the same sample, of the summed
weights of all matches and of that sum per hundred words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick
from .labelled import TRAIN_ROWS, held_out, training_rows

MODULUS, REMAINDER = 3, 1  # held-out part of the labels
THRESHOLD = 0.7
LEAST_SHARE = 0.5  # least toxic share of a pattern's support
GAIN = 10.0  # least log-likelihood ratio of a pattern
SHORTEST, LONGEST = 4, 10  # characters of a word's beginning

# Look-alikes of Latin letters, and digits written for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ո": "n", "ӏ": "i", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
    "l": "i", "ø": "o", "đ": "d", "ł": "i", "ħ": "h", "ß": "ss",
}
# Phrases of everyday speech that hold a harsh word without being toxic.
EXCEPTIONS = ("kill time", "kill the process", "killer app", "killer feature", "dead line", "dead end", "die cast", "shoot a photo",
              "trash can", "garbage collector", "blood test", "master slave", "bloody mary", "damn good", "hell of a")


def folding() -> dict[int, str]:
    table = {ord(k): v for k, v in LOOK_ALIKES.items()}
    table |= {c: "" for c in range(0x300, 0x370)}  # marks that a decomposition leaves
    for c in [*range(0x20), *range(0x20, 0x7F), *range(0xA0, 0xC0), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        if c not in table and not chr(c).isalnum():
            table[c] = " "
    for c in [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]:
        table[c] = ""
    return table


FOLDING = folding()  # a plain value: it goes to the tasks with the functions that use it
STROKE = re.compile(r"(?<![^\s\w@$])[!|](?=[\w@$])")  # in a word or at its start, before a letter
DOLLAR = re.compile(r"\$+(?=[^\W\d_])|(?<=\w)\$+")


def fold(text: str | None) -> str:
    """The folded text between two spaces; words are separated by spaces."""
    t = (text or "").lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t).lower()
    if "$" in t:
        t = DOLLAR.sub(lambda m: "s" * len(m.group()), t)
    if "!" in t or "|" in t:
        t = STROKE.sub("i", t)
    return f" {t.translate(FOLDING)} "


@dataclass
class Lexicon:
    """Patterns over folded text: `` word `` or `` beginning``, with weights,
    exception phrases, and the logistic coefficients of the score."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        a = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            a.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None))
        if len(a):
            a.make_automaton()
        return a

    @staticmethod
    def features(automaton, text: str | None) -> tuple[float, float]:
        """Summed weights of the matches outside exceptions (of overlapping
        matches that begin together, the longest), and words of the text."""
        t = fold(text)
        words = float(len(t.split()))
        if not len(automaton):
            return 0.0, words
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, weight) in automaton.iter(t):
            if weight is None:
                spared.append((end + 1 - n, end + 1))
            else:
                hits[end + 1 - n] = max(weight, hits.get(end + 1 - n, 0.0))
        if spared and hits:
            hits = {at: w for at, w in hits.items() if not any(lo <= at < hi - 1 for lo, hi in spared)}
        return sum(hits.values()), words

    def score(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(total, words) @ np.array(self.coefficients), -30, 30)))


def design(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    rate = 100 * total / np.maximum(words, 1)
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(rate)], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; slopes are not negative."""
    w = np.zeros(x.shape[1])
    free = np.ones(x.shape[1], bool)
    for _ in range(2):
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - y) + ridge * w
            h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            w[free] -= np.clip(np.linalg.solve(h[np.ix_(free, free)], g[free]), -2, 2)
        free = free & ((w >= 0) | (np.arange(len(w)) == 0))
        w[~free] = 0
    return tuple(float(v) for v in w)


def candidates(text: str) -> Iterable[tuple[str, str]]:
    """Distinct ``(pattern, word before)`` of a text: each whole word and its
    beginnings."""
    before, seen = "", set()
    for word in fold(text).split():
        if (word, before) not in seen and len(word) >= SHORTEST - 1:
            seen.add((word, before))
            yield f" {word} ", before
            for n in range(SHORTEST, min(len(word), LONGEST) + 1):
                yield f" {word[:n]}", before
        before = word


def support(rows: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """``(term, n)``: in how many rows, and after how many different words,
    each pattern occurs; the smaller of both numbers. So neither one long text
    nor the many copies of a text make a pattern look well supported."""
    def run(batches):
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pairs = [p for p in candidates(t) if only is None or p[0] in only]
                if pairs:
                    term, before = zip(*pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(before), pa.array([doc] * len(pairs), pa.int64())],
                                                     ["term", "before", "doc"])

    pairs = rows.select("doc_id", "text").mapInArrow(run, "term string, before string, doc long")
    return pairs.groupBy("term").agg(F.least(F.count_distinct("before"), F.count_distinct("doc")).alias("n"))


def choose(counts: list[tuple[str, int, int]], share: float) -> dict[str, float]:
    """The lexicon: patterns with far more than their share of toxic support,
    by likelihood ratio. Of a word and its beginnings, only those are taken
    that say more: after a beginning an extension of higher weight, after a
    longer pattern a shorter one with 1.3 times its support."""
    found = []
    for term, t, c in counts:
        p = t / (t + c)
        gain = t * np.log(p / share) + (c * np.log((1 - p) / (1 - share)) if c else 0)
        if p >= max(LEAST_SHARE, 2 * share) and gain >= GAIN:
            found.append((gain, term, t, float(np.log((t + 0.5) / (c + 0.5) * (1 - share) / share))))
    chosen: dict[str, tuple[float, int]] = {}
    for _, term, t, weight in sorted(found, key=lambda f: (-round(f[0], 6), -len(f[1]), f[1])):
        covered = any((term.startswith(k) and weight < w + 0.7) or (k.startswith(term) and t < 1.3 * n)
                      for k, (w, n) in chosen.items())
        if not covered:
            chosen[term] = (weight, t)
    return {k: w for k, (w, _) in chosen.items()}


def exception_phrases(rows: DataFrame, terms: list[str], least: int = 5) -> list[str]:
    """`` before term`` phrases that stand in at least ``least`` clean training
    rows and in no toxic one."""
    if not terms:
        return []

    def run(batches):
        auto = ahocorasick.Automaton()
        for term in terms:
            auto.add_word(term, len(term))
        auto.make_automaton()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = " ".join(fold(t).split())
                f = f" {f} "
                found = set()
                for end, n in auto.iter(f):
                    at = end + 1 - n
                    before = f.rfind(" ", 0, at)
                    if before >= 0 and at > 0:
                        found.add(f[before:end + 1])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(found)), pa.array([y] * len(found), pa.int32())], ["phrase", "y"])

    counts = (rows.select("text", "y").mapInArrow(run, "phrase string, y int").groupBy("phrase")
              .agg(F.sum("y").alias("t"), F.count("*").alias("n")).where(f"t = 0 and n >= {least}"))
    return sorted(r.phrase for r in counts.collect())


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS,
          exceptions: Iterable[str] = EXCEPTIONS) -> Lexicon:
    """Learn on at most ``max_rows`` labelled rows outside the held-out part;
    the patterns with enough support among these rows and two numbers per
    training row come to the driver. Without both classes the score is
    constant. ``exceptions``: further phrases that are never toxic."""
    rows = cut(training_rows(docs, labels, "toxic", MODULUS, REMAINDER, max_rows))  # read several times
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < toxic < n:
        share = min(max(toxic / n if n else 0.5, 0.01), 0.99)
        return Lexicon({}, [], (float(np.log(share / (1 - share))), 0.0, 0.0))
    share = toxic / n
    # patterns with enough support in toxic rows, then the same in clean ones
    toxic_n = {r.term: r.n for r in support(rows.where("y = 1")).where(F.col("n") >= GAIN / -np.log(share)).collect()}
    clean_n = {r.term: r.n for r in support(rows.where("y <> 1"), frozenset(toxic_n)).collect()}
    terms = choose([(k, t, clean_n.get(k, 0)) for k, t in sorted(toxic_n.items())], share)
    phrases = [fold(p) for p in exceptions] + exception_phrases(rows, list(terms))
    lexicon = Lexicon(terms, phrases)
    data = np.array(sorted((r.total, r.words, r.y) for r in matches(rows, lexicon, "y").collect()), float)
    lexicon.coefficients = logistic(design(data[:, 0], data[:, 1]), data[:, 2])
    return lexicon


def matches(rows: DataFrame, lexicon: Lexicon, keep: str) -> DataFrame:
    """``(keep, total, words)`` per row of ``rows(keep, text)``."""
    kind = dict(rows.dtypes)[keep]

    def run(batches):
        auto = lexicon.automaton()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                got = [Lexicon.features(auto, t.as_py()) for t in part.column(1)]
                total, words = zip(*got)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.float64()), pa.array(words, pa.float64())],
                                                 [keep, "total", "words"])

    return rows.select(keep, F.col("text").cast("string")).mapInArrow(run, f"{keep} {kind}, total double, words double")


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(doc_id, score)`` per row of ``docs``. Null and empty texts score as
    the empty text, repeated rows repeat, an empty table gives no rows."""
    a, b, c = lexicon.coefficients
    found = matches(pick(docs, doc_id="doc_id", text="text"), lexicon, "doc_id")
    rate = 100 * F.col("total") / F.greatest("words", F.lit(1.0))
    z = F.lit(a) + b * F.log1p("total") + c * F.log1p(rate)
    return found.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
