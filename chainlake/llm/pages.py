"""Main text of web pages by a linear-chain conditional random field.

A page is parsed into its leaf blocks, the runs of text between block-level
tags, in page order. Each block gets features of its ancestors (tags, and the
words of their classes, ids and roles) and of its text (length, share of link
text, punctuation, marks such as ©); a two-label chain CRF with these as node
potentials and learned transitions, trained on labelled pages by gradient
ascent on the log-likelihood (forward-backward), is decoded by Viterbi. The
blocks labelled as article are the page's text.

Scripts, styles, templates, comments and the head have no blocks. Character
references are decoded, white space inside a block becomes one space, blocks
are joined by a blank line; nothing else is dropped or cut.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .labelled_pages import labelled_pages

BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe ins label legend li main menu nav ol optgroup option p
pre section select summary table tbody td textarea tfoot th thead tr ul""".split())
SILENT = frozenset("script style template noscript head title svg math object canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}  # open elements that a new one ends
FENCE = {"p": set(), "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
         "th": {"table", "tr"}, "option": {"select"}}
HEAD_TAGS = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
WALLS = ("table", "body")  # a stray end tag doesn't close what lies outside
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Blocks(HTMLParser):
    """Leaf blocks of a page: ``[(text, ancestor features, link share)]``.

    The work is linear in the page: an open element holds the marks of all its
    ancestors (of those in ``known``, if given: features that a model has
    weights for), and of every tag the places where it is open are known, so
    no tag walks the stack."""

    def __init__(self, known: frozenset[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.known = known
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.open: dict[str, list[int]] = {}  # places of each open tag in the stack
        self.fenced: list[int] = []  # places of open block tags but p
        self.silent = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.out: list[tuple[str, frozenset[str], float]] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                marks = self.stack[-1][1] if self.stack else frozenset()
                self.out.append((text, marks, min(self.linked / max(len(text), 1), 1.0)))
            self.parts, self.linked = [], 0

    def push(self, tag: str, attrs) -> None:
        marks = [f"in:{tag}"] if tag in BLOCK_TAGS else []
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                marks += [f"named:{w.lower()}" for w in NAME.findall(v)]
            elif k in ("hidden", "aria-hidden") and v != "false" or k == "style" and v and HIDDEN.search(v):
                marks.append("hidden")
        above = self.stack[-1][1] if self.stack else frozenset()
        new = {m for m in marks if m not in above and (self.known is None or m in self.known)}
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK_TAGS and tag != "p":
            self.fenced.append(len(self.stack))
        self.stack.append((tag, above | new if new else above))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, _ = self.stack.pop()
            self.open[tag].pop()
            if tag in BLOCK_TAGS and tag != "p":
                self.fenced.pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"

    def last(self, tags) -> int:
        """The innermost place where one of ``tags`` is open, -1 if none is."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def leave_head(self) -> None:
        """What cannot stand in a head ends it, also where its end tag and the
        body's tag are left out."""
        if self.stack and self.stack[-1][0] == "head":
            self.pop(len(self.stack) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD_TAGS:
            self.leave_head()
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.flush()
            ended = self.last(CLOSES.get(tag, ()))
            if ended > self.last(FENCE.get(tag, ())):
                self.pop(ended)
            ended = self.last(("p",))
            if ended > (self.fenced[-1] if self.fenced else -1):
                self.pop(ended)
        if tag == "body" and self.open.get("head"):  # an unclosed head ends here
            self.pop(self.open["head"][0])
        if tag not in VOID:
            self.push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        at = self.last((tag,))
        if at >= 0 and (tag in ("html", "body") or at >= self.last(WALLS)):
            self.pop(at)

    def handle_data(self, data):
        if data.strip():
            self.leave_head()
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks(html: str | None, known: frozenset[str] | None = None) -> list[tuple[str, frozenset[str], float]]:
    parser = Blocks(known)
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out


def text_features(text: str, link: float, place: float) -> list[str]:
    n = len(text)
    ends = text[-1] in ".!?…:;\"”»"
    return ["bias", f"chars:{min(n.bit_length(), 11)}", f"link:{round(link * 3)}", f"ends:{ends}",
            f"commas:{min(text.count(','), 3)}", f"stops:{min(text.count('. '), 3)}", f"place:{int(place * 4)}",
            *(["mark:©"] if "©" in text else []), f"ends:{ends} chars:{min(n.bit_length(), 11)}"]


def features(page: list[tuple[str, frozenset[str], float]]) -> list[list[str]]:
    n = max(len(page) - 1, 1)
    return [[*sorted(marks), *text_features(text, link, i / n)] for i, (text, marks, link) in enumerate(page)]


class ChainCRF:
    """Labels 0 and 1; the node potential of label 1 is the sum of its
    features' weights (label 0: zero), ``trans[a, b]`` scores neighbours."""

    def __init__(self, weights: dict[str, float], trans: np.ndarray):
        self.weights, self.trans = weights, trans
        self.known = frozenset(weights)

    @classmethod
    def train(cls, pages: list[tuple[list[list[str]], list[int]]], l2: float = 0.02, steps: int = 250,
              rate: float = 0.15) -> ChainCRF:
        """Adam on the mean penalised log-likelihood; all pages side by side,
        one vectorised forward-backward step per position."""
        pages = [p for p in pages if p[0]]
        names = sorted({f for fs, _ in pages for block in fs for f in block})
        at = {f: i for i, f in enumerate(names)}
        rows, cols, slot = [], [], 0
        longest = max(len(y) for _, y in pages)
        mask = np.zeros((len(pages), longest))
        gold = np.zeros((len(pages), longest))
        slots = np.zeros((len(pages), longest), int)
        for i, (fs, y) in enumerate(pages):
            for t, block in enumerate(fs):
                rows += [slot] * len(block)
                cols += [at[f] for f in block]
                mask[i, t], gold[i, t], slots[i, t] = 1, y[t], slot
                slot += 1
        rows, cols = np.array(rows), np.array(cols)
        both = mask[:, 1:] * mask[:, :-1]
        seen = np.array([[(both * (gold[:, :-1] == a) * (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
        theta = np.zeros(len(names) + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1):
            w, trans = theta[:-4], theta[-4:].reshape(2, 2)
            node = np.bincount(rows, w[cols], slot)[slots] * mask
            pot = np.stack([np.zeros_like(node), node], 2)
            alpha, beta = pot.copy(), np.zeros_like(pot)
            for t in range(1, longest):
                step = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + pot[:, t]
                alpha[:, t] = np.where(mask[:, t, None] > 0, step, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                nxt = beta[:, t + 1] + pot[:, t + 1]
                step = np.logaddexp(trans[:, 0] + nxt[:, 0, None], trans[:, 1] + nxt[:, 1, None])
                beta[:, t] = np.where(mask[:, t + 1, None] > 0, step, 0)
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * mask
            want = np.zeros(slot)
            want[slots[mask > 0]] = (gold - p1)[mask > 0]
            pair = alpha[:, :-1, :, None] + trans + (pot + beta)[:, 1:, None, :] - z[:, None, None, None]
            expected = (np.exp(np.minimum(pair, 0)) * both[:, :, None, None]).sum((0, 1))
            grad = np.concatenate([np.bincount(cols, want[rows], len(names)), (seen - expected).ravel()]) / len(pages)
            grad -= l2 * theta / np.sqrt(len(pages))
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return cls(dict(zip(names, theta[:-4].tolist())), theta[-4:].reshape(2, 2).copy())

    def viterbi(self, page: list[list[str]]) -> list[int]:
        """The best label sequence."""
        if not page:
            return []
        get = self.weights.get
        (t00, t01), (t10, t11) = self.trans.tolist()
        back = []
        s0, s1 = 0.0, sum(get(f, 0.0) for f in page[0])
        for block in page[1:]:
            node = sum(get(f, 0.0) for f in block)
            b0, b1 = s1 + t10 > s0 + t00, s1 + t11 > s0 + t01
            s0, s1 = (s1 + t10 if b0 else s0 + t00), (s1 + t11 if b1 else s0 + t01) + node
            back.append((b0, b1))
        out = [int(s1 > s0)]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


@lru_cache(1)
def trained(n_pages: int = 400) -> ChainCRF:
    """The CRF fitted on the labelled pages (bounded, on the driver)."""
    data = []
    for html, labels in labelled_pages(n_pages):
        page = blocks(html)
        data.append((features(page), [labels.get(text, 0) for text, _, _ in page]))
    return ChainCRF.train(data)


def main_text(html: str | None, model: ChainCRF) -> str:
    page = blocks(html, model.known)
    return "\n\n".join(text for (text, _, _), y in zip(page, model.viterbi(features(page))) if y)


def extract(pages: DataFrame, model: ChainCRF | None = None) -> DataFrame:
    """``(page_id, url, text)`` per row of ``pages``; null and empty pages,
    and pages without an article, give the empty text; repeated rows repeat;
    an empty table gives no rows."""
    model = model or trained()
    src = pick(pages, page_id="page_id", url="url", html="html").withColumn("html", F.col("html").cast("string"))
    kinds = dict(src.dtypes)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [main_text(h.as_py(), model) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 ["page_id", "url", "text"])

    return src.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
