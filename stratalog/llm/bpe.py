"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece's bytes there is exactly one token that can be last in the prefix's encoding. It is
the suffix token whose pair with the last token of the shorter prefix is *stable*: encoding the two tokens'
bytes together gives these two tokens again. The table of last tokens gives every prefix's encoding by walking
back, so bytes can be appended without changing what is stored, and an edit needs only the entries after it.

Pieces are the matches of the tokenizer's pattern, each encoded by itself, without special tokens.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import tidy

#: The tokenizer's published pattern with its classes of letters and numbers in the standard library's terms. They are the
#: same for texts without the characters of ``ODD``; other texts are matched by the pattern itself.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: White space as Unicode has it, which is what the tokenizer's pattern means by \s.
SPACE = r"\t-\r \x85\xa0  -     　"
FULL = regex.compile(PATTERN.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]"))
ODD = re.compile("[\x1c-\x1f\x85" + "".join(re.escape(c) for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) in ("Nl", "No", "Cn")) + "\U00010000-\U0010ffff]")
ODD_ASCII = re.compile("[\x1c-\x1f]")
#: Pieces that a task keeps, and pairs that a Python worker keeps from task to task.
MOST_PIECES = MOST_PAIRS = 150_000
#: Rows, and characters unless one text is longer, that a task holds as Python objects at once.
SLICE, SLICE_CHARS = 256, 1_000_000
#: Longer pieces are not kept.
SHORT = 64


def pieces(text: str) -> list[str]:
    """The pattern's matches, which together are the whole text."""
    return (FULL if (ODD_ASCII if text.isascii() else ODD).search(text) else PLAIN).findall(text)


class Vocabulary:
    """Tokens by rank, with what the dynamic programme asks of them."""

    def __init__(self, listing: bytes):
        """listing: lines of a token in base64 and its rank."""
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, listing.splitlines())}
        self.token = {i: t for t, i in self.rank.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[int, list[tuple[bytes, int, int]]] = {}
        self.stable: dict[int, bool] = {}
        self.sizes = {i: len(t) for i, t in self.token.items()}
        self.packed = {i: struct.pack("<I", i) for i in self.token}
        self.known = Pieces(self)

    @functools.cached_property
    def suffixes(self) -> dict[bytes, int]:
        """All suffixes of tokens, with the rank of those that are tokens and -1 for others."""
        return dict.fromkeys((t[k:] for t in self.rank for k in range(len(t))), -1) | self.rank

    def split(self, t: int) -> tuple[int, int] | None:
        """The two tokens of the merge that makes ``t``; None for a single byte; (t, -1) if no merges make it."""
        if t not in self.halves:
            word = self.token[t]
            self.halves[t] = None
            if len(word) > 1:
                cuts = ((self.rank.get(word[:k]), self.rank.get(word[k:])) for k in range(1, len(word)))
                self.halves[t] = next((c for c in cuts if None not in c and max(c) < t and self.made(c[0]) and self.made(c[1]) and self.apart(*c, t)), (t, -1))
        return self.halves[t]

    def made(self, t: int) -> bool:
        """Merges of bytes make ``t``."""
        half = self.split(t)
        return half is None or half[1] >= 0

    def edge(self, t: int, side: int) -> list[tuple[bytes, int, int]]:
        """Tokens that stand at one end of ``t`` while it is built: bytes, rank from which, rank until which each stands."""
        key = 2 * t + side
        if key not in self.edges:
            out, until, now = [], 1 << 60, t
            while (half := self.split(now)) is not None:
                out.append((self.token[now], now, until))
                now, until = half[side], now
            self.edges[key] = [*out, (self.token[now], -1, until)]
        return self.edges[key]

    def apart(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """No merge under rank ``below`` joins bytes of ``left`` and ``right`` while each is built from bytes.

        Two tokens at the boundary merge if their merge's rank comes while both stand. Of equal ranks the
        one further left is merged first: the boundary's before the right token's own, but after the left's own.
        """
        rank, right_edge = self.rank, self.edge(right, 0)
        for a, a_from, a_until in self.edge(left, 1):
            for b, b_from, b_until in right_edge:
                both = rank.get(a + b)
                if both is not None and a_from < both < a_until and b_from < both <= b_until and both < below:
                    return False
        return True

    def can_follow(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        out = self.stable.get(pair)
        if out is None:
            if len(self.stable) >= MOST_PAIRS:
                self.stable.clear()
            out = self.stable[pair] = self.made(right) and self.apart(left, right)
        return out


def extend(v: Vocabulary, data: bytes, last: list[int]) -> list[int]:
    """Add to ``last``, which has the last tokens of some of the shorter prefixes of ``data``, those of the others."""
    suffixes, stable = v.suffixes, v.stable
    for end in range(len(last) + 1, len(data) + 1):
        begin, found = end - 1, -1
        while begin >= 0 and (t := suffixes.get(data[begin:end])) is not None:
            if t >= 0:
                if begin:
                    fits = stable.get(last[begin - 1] << 32 | t)
                    if fits is None:
                        fits = v.can_follow(last[begin - 1], t)
                else:
                    fits = v.made(t)
                if fits:
                    found = t
                    break
            begin -= 1
        last.append(found)
    return last


def walk(v: Vocabulary, data: bytes, last: list[int]) -> list[int]:
    """The encoding. A whole piece that is in the vocabulary is one token even where merges don't make it."""
    if (whole := v.rank.get(data)) is not None:
        return [whole]
    out, end, sizes = [], len(data), v.sizes
    while end:
        out.append(last[end - 1])
        end -= sizes[out[-1]]
    return out[::-1]


class LastTokens:
    """A piece's bytes with each prefix's last token."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, data, extend(vocabulary, data, [])

    def append(self, more: bytes) -> None:
        """Add bytes; entries of shorter prefixes stay as they are."""
        self.data += more
        extend(self.vocabulary, self.data, self.last)

    def truncate(self, length: int) -> None:
        """Keep a prefix; its encoding needs no further work."""
        self.data = self.data[:length]
        del self.last[length:]

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Change bytes; only entries from ``begin`` on are computed again."""
        tail = self.data[end:]
        self.truncate(begin)
        self.append(new + tail)

    def tokens(self) -> list[int]:
        return walk(self.vocabulary, self.data, self.last)


class Pieces(dict):
    """Piece -> ids as little-endian 32-bit integers, kept for short pieces; forgets everything when full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        out = np.array(LastTokens(self.vocabulary, piece.encode()).tokens(), "<u4").tobytes()
        if len(piece) <= SHORT:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = out
        return out

    def learn(self, found: set[str]) -> None:
        """Keep the short ones of these pieces. In order, each takes over the entries of the prefix that it shares with the one before.

        Beside each prefix's last token stands its whole encoding, which is that of the prefix before this token and the token.
        """
        new = found - self.keys()
        if len(self) + len(new) > MOST_PIECES:
            self.clear()
            new = found
        v = self.vocabulary
        rank, suffixes, stable, packed = v.rank, v.suffixes, v.stable, v.packed
        before, last, ids = b"", [], []
        for piece in sorted(new):
            if len(piece) > SHORT:
                continue
            data = piece.encode()
            if (whole := rank.get(data)) is not None:
                self[piece] = packed[whole]
                continue
            same = 0
            for a, b in zip(before, data):
                if a != b:
                    break
                same += 1
            del last[same:], ids[same:]
            for end in range(same + 1, len(data) + 1):
                begin = end - 1
                while True:
                    t = suffixes[data[begin:end]]  # each byte is a token, so one of the suffixes follows
                    if t >= 0:
                        if not begin:
                            if v.made(t):
                                ids.append(packed[t])
                                break
                        else:
                            left = last[begin - 1]
                            fits = stable.get(left << 32 | t)
                            if fits is None:
                                fits = v.can_follow(left, t)
                            if fits:
                                ids.append(ids[begin - 1] + packed[t])
                                break
                    begin -= 1
                last.append(t)
            self[piece] = ids[-1]
            before = data


class TokenizedText:
    """A text with its pieces and their ids, for appends and edits that re-encode only what they touch."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text, self.parts, self.recoded = vocabulary, "", [], 0
        self.replace(0, 0, text)

    def replace(self, begin: int, end: int, new: str) -> None:
        """Put ``new`` in place of text[begin:end].

        A piece ends by what follows within three characters of its start or two of its end, so pieces that end
        before ``begin`` by that much stay, and so do those from the first old piece boundary after
        the edit at which a new piece ends too.
        """
        text = self.text[:begin] + new + self.text[end:]
        kept = at = 0
        for piece, _ in self.parts:
            if at + max(len(piece) + 2, 3) > begin:
                break
            at += len(piece)
            kept += 1
        shift, old, place = len(new) - (end - begin), {}, 0
        for i, (piece, _) in enumerate(self.parts):
            if place >= end:
                old[place + shift] = i
            place += len(piece)
        fresh, tail = [], []
        find = FULL if ODD.search(text) else PLAIN
        while at < len(text):
            if at in old and at >= begin + len(new):
                tail = self.parts[old[at] :]
                break
            piece = find.match(text, at)[0]
            fresh.append((piece, self.vocabulary.known[piece]))
            at += len(piece)
        self.recoded = len(fresh)
        self.text, self.parts = text, self.parts[:kept] + fresh + tail

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def ids(self) -> np.ndarray:
        return np.frombuffer(b"".join(b for _, b in self.parts), "<u4")


@functools.lru_cache(1)
def vocabulary(listing: bytes) -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(listing)


def encode(texts: list[str | None], v: Vocabulary) -> list[bytes]:
    """Ids of each text; null and empty texts have none."""
    found = [pieces(t) if t else [] for t in texts]
    v.known.learn(set(itertools.chain.from_iterable(found)))
    return [b"".join(map(v.known.__getitem__, p)) for p in found]


def decode(ids: bytes | None, v: Vocabulary) -> bytes:
    return b"".join(map(v.token.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def read_listing(df: DataFrame, path: str) -> bytes:
    """The vocabulary file, read by Spark, so any path that Spark reads will do; its size doesn't depend on the data."""
    return bytes(df.sparkSession.read.format("binaryFile").load(path).select("content").first()[0])


def slices(batch: pa.Array) -> Iterator[list]:
    """The same rows as short lists."""
    part, size = [], 0
    for row in batch:
        row = row.as_py()
        if part and (len(part) >= SLICE or size + len(row or "") > SLICE_CHARS):
            yield part
            part, size = [], 0
        part.append(row)
        size += len(row or "")
    if part:
        yield part


def token_ids(text: Column, shared) -> Column:
    """Ids of each whole text as binary: little-endian unsigned 32-bit integers. shared: a broadcast vocabulary file."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(shared.value)
        for batch in tidy(batches):
            yield pa.array([ids for part in slices(batch) for ids in encode(part, v)], pa.binary())
        v.known.clear()  # the worker stays for other tasks

    return ids.asNondeterministic()(text)


def token_bytes(ids: Column, shared) -> Column:
    @F.arrow_udf("binary")
    def data(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(shared.value)
        for batch in tidy(batches):
            yield pa.array((decode(t, v) for part in slices(batch) for t in part), pa.binary())

    return data.asNondeterministic()(ids)


def both_ways(text: Column, shared) -> Column:
    """``ids`` of each whole text and ``decoded``, the bytes that those ids decode to, in one Python worker with one vocabulary."""
    kinds = pa.struct({"ids": pa.binary(), "decoded": pa.binary()})

    @F.arrow_udf("ids binary, decoded binary")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(shared.value)
        for batch in tidy(batches):
            yield pa.array(({"ids": i, "decoded": decode(i, v)} for part in slices(batch) for i in encode(part, v)), kinds)
        v.known.clear()  # the worker stays for other tasks

    return coded.asNondeterministic()(text)


def prefix_tokens(text: Column, shared) -> Column:
    """For each byte of a text, the last token of the encoding of its piece up to that byte."""

    @F.arrow_udf("array<int>")
    def table(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(shared.value)
        for batch in tidy(batches):
            yield pa.array(([t for p in pieces(x or "") for t in LastTokens(v, p.encode()).last] for part in slices(batch) for x in part), pa.list_(pa.int32()))

    return table.asNondeterministic()(text)


def share_vocabulary(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(read_listing(df, path))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens`` for every row; ``ids`` as in ``token_ids``.

    A null or empty text has no ids. Null and repeated ids, and repeated rows, pass through; other columns are
    ignored; an empty table gives an empty result.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), token_ids(F.col(text_col), share_vocabulary(docs, path)).alias("ids"))
    return out.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens, decoded``: ``encode_documents`` and ``decode_documents`` in one step; cases as there."""
    both = docs.select(F.col(id_col).alias("doc_id"), both_ways(F.col(text_col), share_vocabulary(docs, path)).alias("b"))
    return both.select("doc_id", "b.ids", (F.octet_length("b.ids") / 4).cast("bigint").alias("n_tokens"), "b.decoded")


def decode_documents(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """``keep`` columns and ``decoded``: the bytes of the ids; null ids decode to nothing."""
    return encoded.select(*keep, token_bytes(F.col(ids_col), share_vocabulary(encoded, path)).alias("decoded"))
