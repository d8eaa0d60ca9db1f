"""Exact SentencePiece BPE encoding and decoding by backtracking.

A token sequence is the BPE encoding of a text exactly if every token encodes
to itself and every two neighbours stay apart when their joined text is merged
anew: the first merge across a boundary, if there were one, would also happen
when the two tokens are merged alone (see ``compatible``). So the encoder walks over the text,
takes the longest token that Aho-Corasick found at each place, and checks it
against the token before it by re-merging the pair (memoised); if no token
fits, it marks the place as failed in a bitfield and steps back.

No piece holds the space mark after another character, so a text splits into
chunks (space marks, then other characters) that encode independently; chunks
that recur are kept in a bounded cache per Python worker.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

SPACE = "▁"
CACHE = 1_000_000  # chunks kept per Python worker (some 300 MB)
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def normalizer_flags(model: bytes) -> dict[str, object]:
    """The few settings of a model file that decide how a text is prepared
    (a protobuf message: field 3 is the normalizer)."""
    def fields(data: bytes):
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, varint()
            elif kind == 2:
                n = varint()
                at += n
                yield tag >> 3, data[at - n:at]
            else:
                at += {1: 8, 5: 4}[kind]
                yield tag >> 3, data[at - {1: 8, 5: 4}[kind]:at]

    flags = {"name": b"", "map": b"", "dummy_prefix": 1, "remove_extra": 1, "escape": 1}
    trainer = {"suffix": 0, "bytes": 0, "type": 1}
    for number, value in fields(model):
        if number == 3:
            flags |= {{1: "name", 2: "map", 3: "dummy_prefix", 4: "remove_extra", 5: "escape"}.get(n, n): v for n, v in fields(value)}
        elif number == 2:
            trainer |= {{3: "type", 24: "suffix", 35: "bytes"}.get(n, n): v for n, v in fields(value)}
    return flags | trainer


class Encoder:
    """One per Python worker, from the bytes of a model file."""

    def __init__(self, model: bytes):
        flags = normalizer_flags(model)
        if flags["map"] or flags["remove_extra"] or not flags["escape"] or flags["suffix"] or flags["type"] != 2:
            raise ValueError("only BPE models with identity normalisation and escaped leading spaces are supported")
        self.prefix = SPACE if flags["dummy_prefix"] else ""
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        normal = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        if any(lib.is_unused(i) for i in normal):
            raise ValueError("models with unused pieces are not supported")
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in normal}
        self.ids = {lib.id_to_piece(i): i for i in normal}
        self.split = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(lib.is_byte, range(n))) else None
        self.unknown = lib.unk_id()
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1 and len(self.merge(piece)) == 1:  # others never come out of merging
                self.automaton.add_word(piece, (piece, len(piece) - 1))
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.last: dict[str, tuple[str, str] | None] = {}
        self.prefix_of: dict[str, str | None] = {}
        self.known: dict[str, list[int]] = {}

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """Plain BPE: merge the best-scored pair, the leftmost of equals, down
        to ``stop`` parts."""
        parts, score = list(text), self.score
        while len(parts) > stop:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The last merge by which ``piece`` comes about; None if its merges
        are not in the order of their scores."""
        parts = self.last.get(piece, False)
        if parts is False:
            two = self.merge(piece, stop=2)
            parts = tuple(two) if all(len(p) == 1 or (self.score[p] > self.score[piece] and self.halves(p)) for p in two) else None
            self.last[piece] = parts
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Do ``a`` and ``b`` stay apart when merged anew? The merges inside
        both are undone from the last to the first; at each stage the pair at
        the boundary must score below the merge that was undone (a left merge
        wins a tie, a right one loses it)."""
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) >= 300_000:
                self.fits.clear()
            ok = self.fits[a, b] = self.apart(a, b)
        return ok

    def apart(self, a: str, b: str) -> bool:
        if b[0] == SPACE or (len(a) > 1 and not self.halves(a)) or (len(b) > 1 and not self.halves(b)):
            return self.merge(a + b) == [a, b]  # tied scores, or merges out of order
        x, y, limit, right = a, b, None, False
        while True:
            s = self.score.get(x + y)
            if s is not None and (limit is None or s > limit or (right and s == limit)):
                return False
            if len(x) == 1 and len(y) == 1:
                return True
            right = len(x) == 1 or (len(y) > 1 and self.score[y] <= self.score[x])
            if right:
                limit, y = self.score[y], self.last[y][0]
            else:
                limit, x = self.score[x], self.last[x][1]

    def shorter(self, piece: str) -> str | None:
        """The next shorter token that ``piece`` begins with, one character
        at least; None for a single character."""
        found = self.prefix_of.get(piece, False)
        if found is False:
            found = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.automaton), None)
            self.prefix_of[piece] = found
        return found

    def pieces(self, chunk: str) -> list[str]:
        """Backtracking over the Aho-Corasick matches of one chunk."""
        if chunk in self.automaton:  # the longest match is the chunk itself
            return [chunk]
        longest = list(chunk)  # a character without a longer match stands for itself
        for end, (piece, back) in self.automaton.iter(chunk):
            longest[end - back] = piece
        fits, n = self.fits, len(chunk)
        out: list[str] = []
        last, pos, failed, piece = None, 0, 0, longest[0]
        while True:
            while piece is not None:
                end = pos + len(piece)
                if not failed >> end & 1:
                    if last is None:
                        break
                    ok = fits.get((last, piece))
                    if ok or (ok is None and self.compatible(last, piece)):
                        break
                piece = self.shorter(piece)
            if piece is not None:
                out.append(piece)
                if end == n:
                    return out
                last, pos, piece = piece, end, longest[end]
            else:  # nothing fits here after ``last``: step back
                failed |= 1 << pos
                piece = out.pop()
                pos -= len(piece)
                piece = self.shorter(piece)
                last = out[-1] if out else None

    def encode_chunk(self, chunk: str) -> list[int]:
        pieces = self.pieces(chunk)
        try:
            return [self.ids[p] for p in pieces]
        except KeyError:  # characters without a piece: their bytes
            out = []
            for piece in pieces:
                if piece in self.ids:
                    out.append(self.ids[piece])
                elif self.bytes:
                    out.extend(self.bytes[b] for b in piece.encode("utf-8", "replace"))
                else:
                    out.append(self.unknown)
            return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = self.prefix + text.replace(" ", SPACE)
        out: list[int] = []
        known = self.known
        for chunk in CHUNK.findall(text) if self.split else (text,):
            ids = known.get(chunk)
            if ids is None:
                ids = self.encode_chunk(chunk)
                if len(chunk) <= 40:
                    if len(known) >= CACHE:
                        known.clear()
                    known[chunk] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


def tokenize(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, decoded)`` per row of ``docs``: the ids of
    the whole text without begin or end ids, and the text they decode to.
    Null texts count as empty (no ids, empty text); repeated rows repeat; an
    empty table gives no rows. The model file is read on the driver and sent
    with the tasks (its size is that of the vocabulary)."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast({"model": f.read()})
    src = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string"))

    def run(batches):
        kept = shared.value  # stays with the worker from task to task, and so do the encoder's caches
        if "encoder" not in kept:
            kept["encoder"] = Encoder(kept["model"])
        encoder = kept["encoder"]
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [encoder.encode(t.as_py()) for t in part.column(1)]
                decoded = [encoder.decode(ids) for ids in found]
                flat = np.concatenate([np.array(ids, np.int32) for ids in found]) if found else np.empty(0, np.int32)
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    kind = dict(src.dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
