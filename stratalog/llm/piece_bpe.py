"""Merge-type SentencePiece models: encoding by a score-ordered agenda of adjacent symbol pairs, and decoding.

A text is written with ``▁`` for blanks and one in front. Its characters are the first symbols; of all adjacent pairs whose
joined text is a piece, the one with the best score (of equal ones the leftmost) is joined until none is left. A character that is no
piece becomes its bytes' pieces.

No piece holds two characters of different *kinds* side by side (the kinds follow from the pieces), and none has a blank after
another character, so a text is cut there without changing any pair. Agendas of many short segments advance together, each by its
best pair a round; a long segment has a heap of its own.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import tidy
from .bpe import read_listing, slices

BLANK = "▁"
#: Kinds of pieces and of models in the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE, MERGES = 1, 2, 3, 6, 2
#: Segments that a worker keeps, and the length from which a segment is not kept and has an agenda of its own.
MOST_SEGMENTS, LONG = 300_000, 48
NEVER = np.int64(1) << 40


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields, nested messages as bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        if key & 7 == 0:
            value, at = varint(data, at)
        else:
            size, at = varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Segments(dict):
    """Segment -> ids as little-endian 32-bit integers; one that is not kept is encoded by itself."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, segment: str) -> bytes:
        m = self.model
        return np.array([i for s in m.alone(segment.replace(" ", BLANK)) for i in m.pieces_of(s)], "<i4").tobytes()


class Model:
    """Pieces of a model file with their ranks by score, and all pairs that join to a piece."""

    def __init__(self, data: bytes):
        message = list(fields(data))
        trainer = next((dict(fields(v)) for k, v in message if k == 2), {})
        rules = next((dict(fields(v)) for k, v in message if k == 3), {})
        listed = [dict(fields(v)) for k, v in message if k == 1]
        self.pieces = [p[1].decode() for p in listed]
        self.kinds = [p.get(3, NORMAL) for p in listed]
        scores = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in listed]
        if trainer.get(3) != MERGES or not trainer.get(35) or trainer.get(24) or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a merge-type model with byte fallback, without unused or user-defined pieces, is needed")
        if rules.get(2) or rules.get(4, 1) or not rules.get(3, 1) or not rules.get(5, 1):
            raise ValueError("the model's rules must leave texts as they are, but for blanks and the one in front")
        self.id = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.end = self.pieces.index("</s>")
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        place = {s: n for n, s in enumerate(sorted({scores[i] for i in self.id.values()}, reverse=True))}
        #: Symbols are pieces and, numbered after them, characters that stand in pieces only.
        more = sorted({c for p in self.id for c in p} - set(self.id))
        self.symbol = self.id | {c: len(self.pieces) + n for n, c in enumerate(more)}
        self.join = {(a, b): (place[scores[i]], i) for p, i in self.id.items() for k in range(1, len(p)) if (a := self.symbol.get(p[:k])) is not None and (b := self.symbol.get(p[k:])) is not None}
        found = sorted((a << 32 | b, rank, i) for (a, b), (rank, i) in self.join.items())
        self.keys, self.ranks, self.joined = (np.array(x, np.int64) for x in zip(*found, strict=True))
        self.of_char = np.full(0x110000, -1, np.int64)
        for c, s in self.symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        self.cut = self.kinds_of_characters()
        self.known = Segments(self)
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(BLANK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.raw[self.kinds.index(UNKNOWN)] = trainer.get(44, " ⁇ ".encode())

    def kinds_of_characters(self) -> re.Pattern:
        """Matches segments: blanks with the run of characters of one kind after them. Characters are of one kind if pieces have them side by side."""
        kind: dict[str, str] = {}

        def top(c: str) -> str:
            while (up := kind.setdefault(c, c)) != c:
                kind[c] = kind[up]
                c = up
            return c

        for a, b in {x for p in self.id for x in itertools.pairwise(p)}:
            if b == BLANK and a != BLANK:
                return re.compile("(?s).+")
            if a != BLANK:
                kind[top(a)] = top(b)
        runs: dict[str, list[str]] = {}
        for c in kind:
            runs.setdefault(top(c), []).append(c)
        return re.compile("(?s) *(?:" + "|".join("[" + "".join(map(re.escape, r)) + "]+" for r in sorted(runs.values(), key=len, reverse=True)) + "|[^ ])| +")

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair's joined piece (``NEVER`` without one) and its id."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NEVER), self.joined[at]

    def together(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All segments' agendas, each joining its best pair a round: symbols, their segments' numbers, and characters for symbols below 0."""
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        seg = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        sym = self.of_char[chars]
        sym = np.where(sym < 0, -1 - chars, sym)
        rank, joined = np.full(len(sym), NEVER), np.zeros(len(sym), np.int64)
        same = np.flatnonzero(seg[1:] == seg[:-1])
        rank[same], joined[same] = self.ranked(sym[same], sym[same + 1])
        done = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.minimum.reduceat(rank << 20 | np.arange(len(sym)), starts)
            busy = best < NEVER << 20
            if not busy.all():
                stays = np.repeat(busy, np.diff(np.r_[starts, len(sym)]))
                done.append((sym[~stays], seg[~stays]))
                at = np.cumsum(stays) - 1
                sym, seg, rank, joined = sym[stays], seg[stays], rank[stays], joined[stays]
                p = at[best[busy] & 0xFFFFF]
            else:
                p = best & 0xFFFFF
            if not len(p):
                break
            sym[p] = joined[p]
            keep = np.ones(len(sym), bool)
            keep[p + 1] = False
            sym, seg, rank, joined = sym[keep], seg[keep], rank[keep], joined[keep]
            p = p - np.arange(len(p))  # each has lost one symbol before it for every segment before it
            rank[p] = NEVER
            t = np.concatenate([p[p > 0] - 1, p[p < len(sym) - 1]])  # one pair a round and segment, so none comes twice
            t = t[seg[t] == seg[t + 1]]
            rank[t], joined[t] = self.ranked(sym[t], sym[t + 1])
        sym, seg = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (sym, seg)
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def alone(self, segment: str) -> list[int]:
        """One segment's symbols by a heap of its pairs."""
        sym = [self.symbol.get(c, -1 - ord(c)) for c in segment]
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        agenda = [(*hit, i, i + 1) for i, pair in enumerate(itertools.pairwise(sym)) if (hit := self.join.get(pair))]
        agenda = [(rank, i, j, sym[i], sym[j], new) for rank, new, i, j in agenda]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, a, b, new = heapq.heappop(agenda)
            if sym[i] != a or after[i] != j or sym[j] != b:
                continue  # one of its symbols has been joined since
            sym[i], sym[j] = new, None
            after[i] = k = after[j]
            if k < len(sym):
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < len(sym) and (hit := self.join.get((sym[x], sym[y]))):
                    heapq.heappush(agenda, (hit[0], x, y, sym[x], sym[y], hit[1]))
        return [s for s in sym if s is not None]

    def pieces_of(self, symbol: int) -> list[int]:
        """A symbol's ids: itself, or the bytes of a character that is no piece."""
        if 0 <= symbol < len(self.pieces):
            return [symbol]
        c = chr(-1 - symbol) if symbol < 0 else next(c for c, s in self.symbol.items() if s == symbol)
        return [self.byte[x] for x in c.encode()]

    def learn(self, found: set[str]) -> None:
        """Encode and keep those segments that are new and short."""
        new = found - self.known.keys()
        if len(self.known) + len(new) > MOST_SEGMENTS:
            self.known.clear()
            new = found
        short = [s for s in new if len(s) <= LONG]
        for begin in range(0, len(short), 8192):  # 2**20 characters at most, as the rounds number them
            some = short[begin : begin + 8192]
            sym, seg = self.together([s.replace(" ", BLANK) for s in some])
            if (odd := (sym < 0) | (sym >= len(self.pieces))).any():
                parts = [self.pieces_of(s) for s in sym[odd].tolist()]
                size = np.ones(len(sym), np.int64)
                size[odd] = [len(p) for p in parts]
                inside = np.repeat(odd, size)
                sym, seg = np.repeat(sym, size), np.repeat(seg, size)
                sym[inside] = list(itertools.chain.from_iterable(parts))
            data, ends = sym.astype("<i4").tobytes(), np.searchsorted(seg, np.arange(1, len(some) + 1)) * 4
            begin = 0
            for s, end in zip(some, ends.tolist(), strict=True):
                self.known[s] = data[begin:end]
                begin = end

    def encode(self, texts: list[str | None], end: bool = True) -> list[np.ndarray]:
        """Ids of each text, ``end``: with the end id; null counts as empty, and an empty text has no pieces."""
        cut = [self.cut.findall(" " + t.replace(BLANK, " ")) if t else [] for t in texts]
        self.learn(set().union(*cut))
        last = np.array([self.end] if end else [], "<i4").tobytes()
        return [np.frombuffer(b"".join(map(self.known.__getitem__, segments)) + last, "<i4") for segments in cut]

    def decode(self, ids: np.ndarray | list[int] | None) -> str:
        """The ids' text without the blank in front; bytes that are no UTF-8 become one replacement character each."""
        ids = np.asarray([] if ids is None else ids, np.int64).tolist()
        raw, kinds = self.raw, self.kinds
        parts = list(map(raw.__getitem__, ids))
        for n, i in enumerate(ids):
            if kinds[i] == BYTE or parts[n]:
                if kinds[i] == NORMAL and self.pieces[i].startswith(BLANK):
                    parts[n] = parts[n][1:]
                break
        try:
            if not self.controls.isdisjoint(ids[:-1]):  # they part bytes that would make a character
                raise UnicodeDecodeError("utf-8", b"", 0, 0, "")
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            runs = itertools.groupby(zip(ids, parts, strict=True), lambda x: kinds[x[0]] == BYTE)
            return "".join(valid(b"".join(p for _, p in run)) if is_bytes else b"".join(p for _, p in run).decode() for is_bytes, run in runs)


def valid(data: bytes) -> str:
    """UTF-8 with a replacement character for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@functools.lru_cache(1)
def model(data: bytes) -> Model:
    """One per Python worker."""
    return Model(data)


CODED = pa.struct({"ids": pa.list_(pa.int32()), "decoded": pa.string()})


def structs(ids: list[np.ndarray], decoded: list[str]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array(decoded, pa.string())], fields=list(CODED))


def coded(text: Column, shared, end: bool) -> Column:
    """``ids`` of each whole text and ``decoded``, the text of those ids."""

    @F.arrow_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(shared.value)
        for batch in tidy(batches):
            out = [structs(ids := m.encode(part, end), [m.decode(i) for i in ids]) for part in slices(batch)]
            yield pa.concat_arrays(out) if out else pa.array([], CODED)
        m.known.clear()  # the worker stays for other tasks

    return both.asNondeterministic()(text)


def library_coded(text: Column, shared, end: bool) -> Column:
    """The same from the sentencepiece library."""

    @F.arrow_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in tidy(batches):
            out = []
            for part in slices(batch):
                ids = m.encode([t or "" for t in part], add_eos=end, num_threads=1)
                out.append(structs([np.array(i, np.int32) for i in ids], [m.decode(i) for i in ids]))
            yield pa.concat_arrays(out) if out else pa.array([], CODED)

    return both.asNondeterministic()(text)


def shared_model(df: DataFrame, path: str):
    """The model file, read by Spark and sent to all workers; its size doesn't depend on the data."""
    return df.sparkSession.sparkContext.broadcast(read_listing(df, path))


def round_trip(docs: DataFrame, path: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text", encoder=coded) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded`` for every row; ``end``: ids end with the model's end id.

    A null text counts as empty: it has the end id alone and decodes to an empty text. Whole texts of any length are encoded. Null and repeated ids,
    and repeated rows, pass; other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    both = docs.select(F.col(id_col).alias("doc_id"), encoder(F.col(text_col), shared_model(docs, path), end).alias("b"))
    return both.select("doc_id", "b.ids", F.size("b.ids").cast("bigint").alias("n_tokens"), "b.decoded")


def unlike_library(docs: DataFrame, path: str, end: bool = True, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose ids or decoded text differ from the sentencepiece library's: none, if all is well."""
    shared = shared_model(docs, path)
    both = docs.select(F.struct("*").alias("row"), coded(F.col(text_col), shared, end).alias("own"), library_coded(F.col(text_col), shared, end).alias("other"))
    return both.filter(~F.col("own").eqNullSafe(F.col("other"))).select("row.*")
