"""Language of each word by a linear-chain conditional random field, and of each text by its words' marginals.

A word's features are its affixes, letter n-grams and itself (lexicon), hashed to ``BUCKETS``; labels of
neighbouring words are tied by learned transitions. Forward-backward gives each word's label probabilities.
Recursions over long texts run in blocks of words: each block's transfer matrix first, then the blocks' chain, then
the words inside all blocks at once, which is exact for texts of any length.
"""

from __future__ import annotations

import functools
import json
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .batches import tidy
from .common import materialize, small_side
from .shingles import STEP, mix

BUCKETS = 1 << 15
#: Bounds of the training sample: documents, and consecutive words of each.
SAMPLE_DOCS, SAMPLE_WORDS = 1600, 48
STEPS, RATE, DECAY = 20, 0.5, 1e-4
BLOCK = 64
UNKNOWN = "und"


@functools.cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all tokens' features, the token each belongs to, and each token's number of letters.

    Only letters count. A word stands between two marks; its features are its n-grams of 1 to 3 characters, its first and last
    1 to 4 letters with the mark, and the whole word. A token without letters has none.
    """
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    code = np.frombuffer("".join(tokens).encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(len(tokens)), lengths)
    keep = is_letter()[code]
    code, owner = code[keep].astype(np.uint64), owner[keep]
    count = np.bincount(owner, minlength=len(tokens))
    words = np.flatnonzero(count)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), count
    span = count[words] + 2
    start = np.concatenate([[0], np.cumsum(span)[:-1]])
    whose = np.repeat(np.arange(len(words)), span)
    place = np.arange(len(whose)) - start[whose]
    text = np.ones(len(whose), np.uint64)  # both marks are 1
    text[(place > 0) & (place < span[whose] - 1)] = code
    found, of = [], []

    def add(value: np.ndarray, kind: int, word: np.ndarray) -> None:
        found.append(mix(value * STEP + np.uint64(kind)))
        of.append(words[word])

    gram = text
    for n in (1, 2, 3, 4, 5):
        if n > 1:
            gram = gram[:-1] * np.uint64(0x1F4A7C15) + text[n - 1 :]
        if len(gram) == 0:
            break
        if n <= 3:
            inside = np.flatnonzero(whose[: len(gram)] == whose[n - 1 :])
            add(gram[inside], n, whose[inside])
        if n >= 2:
            long = np.flatnonzero(span > n)
            add(gram[start[long]], 10 + n, long)
            add(gram[start[long] + span[long] - n], 20 + n, long)
    power = np.cumprod(np.full(int(span.max()), 0x9E3779B97F4A7C15, np.uint64))
    add(np.add.reduceat(text * power[place], start), 30, np.arange(len(words)))
    return (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(of), count


def chain(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of all words of sequences laid end to end; then what each word gets from its left, itself
    included, and from its right, itself included (both but for a factor).

    scores: (words, labels); lengths: words of each sequence, each at least 1.
    """
    n, k = scores.shape
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    total, most = int(blocks.sum()), int(blocks.max(initial=0))
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    in_seq = np.arange(n) - np.repeat(start, lengths)
    row, col = np.repeat(first, lengths) + in_seq // BLOCK, in_seq % BLOCK
    local = np.ones((BLOCK, total, k))
    local[col, row] = np.maximum(np.exp(scores - scores.max(1, keepdims=True)), 1e-30)
    end = np.full(total, BLOCK - 1)
    tails = first + blocks - 1
    end[tails] = (lengths - 1) % BLOCK
    step = np.exp(transitions)
    opens = np.zeros(total, bool)
    opens[first] = True
    inner = np.ones(total, bool)
    inner[tails] = False
    full = np.flatnonzero(inner)
    # Transfer matrices of full blocks that have a successor: from the label before the block to that of its last word.
    through = np.tile(np.eye(k), (len(full), 1, 1))
    for t in range(BLOCK if len(full) else 0):
        through = (through.reshape(-1, k) @ step).reshape(-1, k, k) * local[t, full, None, :]
        if t == 0:
            through[opens[full]] = local[0, full[opens[full]], None, :] * np.ones((1, k, 1))
        if t % 8 == 7:
            through /= through.sum((1, 2), keepdims=True)
    at_full = np.zeros(total, np.int64)
    at_full[full] = np.arange(len(full))

    def backward(rows: np.ndarray | slice, right: np.ndarray, out: np.ndarray | None) -> np.ndarray:
        """Run blocks from their last words, where ``right`` enters; gives what leaves them on the left."""
        now, last = right.copy(), end[rows]
        order = np.argsort(last, kind="stable")
        bounds = np.searchsorted(last[order], np.arange(BLOCK + 1))
        for t in range(BLOCK - 1, -1, -1):
            begin = order[bounds[t] : bounds[t + 1]]
            now[begin] = right[begin]
            if out is not None:
                out[t] = now
            now = (local[t, rows] * now) @ step.T
            if t % 4 == 0:
                now /= now.sum(1, keepdims=True)
        return now

    # Chain of blocks: vectors that enter each block from the left and from the right.
    enter, leave = np.full((total, k), 1 / k), np.ones((total, k))
    for b in range(1, most):
        at = first[blocks > b] + b
        v = np.einsum("bi,bij->bj", enter[at - 1], through[at_full[at - 1]])
        enter[at] = v / v.sum(1, keepdims=True)
    several = tails[blocks > 1]
    leave[several - 1] = backward(several, leave[several], None)
    for b in range(most - 3, -1, -1):
        at = first[blocks > b + 2] + b
        v = np.einsum("bij,bj->bi", through[at_full[at + 1]], leave[at + 1])
        leave[at] = v / v.sum(1, keepdims=True)
    # Words inside all blocks.
    forward, now = np.empty((BLOCK, total, k)), enter
    for t in range(BLOCK):
        now = (now @ step) * local[t]
        if t == 0:
            now[opens] = local[0, opens]
        if t % 4 == 3:
            now /= now.sum(1, keepdims=True)
        forward[t] = now
    back = np.empty((BLOCK, total, k))
    backward(slice(None), leave, back)
    left, right = forward[col, row], back[col, row]
    both = left * right
    return both / both.sum(1, keepdims=True), left, local[col, row] * right


def prepared(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


class Numbers(dict):
    """Token -> its row; new tokens get the next rows and are listed in ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = out = len(self)
        self.fresh.append(token)
        return out


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS, labels)
    transitions: np.ndarray
    index: Numbers = field(default_factory=Numbers)
    table: np.ndarray | None = None
    chars: int = 0

    @functools.cached_property
    def columns(self) -> list[np.ndarray]:
        return [np.ascontiguousarray(c) for c in self.weights.T]

    def make_room(self) -> None:
        """Forget all tokens once they are many; called between texts, never between a look-up and its use."""
        if self.table is None or len(self.index) > 150_000 or self.chars > 4_000_000:
            self.index, self.table, self.chars = Numbers(), np.zeros((1024, len(self.labels) + 1), np.float32), 0

    def look_up(self, tokens: list[str]) -> np.ndarray:
        """Row of ``table`` for each token: its score for each label and its number of letters."""
        base, k = len(self.index), len(self.labels)
        out = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        if fresh := self.index.fresh:
            bucket, owner, count = features(fresh)
            while len(self.table) < base + len(fresh):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for i in range(k):
                self.table[base : base + len(fresh), i] = np.bincount(owner, self.columns[i][bucket], len(fresh))
            self.table[base : base + len(fresh), k] = count
            self.chars += sum(map(len, fresh))
            self.index.fresh = []
        return out

    def words(self, text: str) -> tuple[list[str], np.ndarray]:
        """The text's words (with letters) and their label probabilities."""
        self.make_room()
        tokens = prepared(text).split()
        rows = self.look_up(tokens)
        some = self.table[rows]
        spoken = np.flatnonzero(some[:, -1])
        if not len(spoken):
            return [], np.zeros((0, len(self.labels)))
        return [tokens[i] for i in spoken], chain(some[spoken, :-1].astype(float), np.array([len(spoken)]), self.transitions)[0]

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and score of each text: the share of letters that its words' probabilities give to the label."""
        self.make_room()
        found = [prepared(t or "").split() for t in texts]
        lengths = np.array([len(r) for r in found], np.int64)
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if lengths.sum() == 0:
            return names, scores
        rows = self.look_up([t for ts in found for t in ts])
        some = self.table[rows]
        owner = np.repeat(np.arange(len(texts)), lengths)
        spoken = some[:, -1] > 0  # words without letters say nothing and stand between no words
        some, owner = some[spoken], owner[spoken]
        lengths = np.bincount(owner, minlength=len(texts))
        full = lengths > 0
        if not full.any():
            return names, scores
        marginals = chain(some[:, :-1].astype(float), lengths[full], self.transitions)[0]
        weight = some[:, -1].astype(float)
        mass = np.stack([np.bincount(owner, weight * m, len(texts)) for m in marginals.T], 1)
        total = np.bincount(owner, weight, len(texts))
        best = mass.argmax(1)
        for i in np.flatnonzero(full):
            names[i], scores[i] = self.labels[best[i]], min(1.0, mass[i, best[i]] / total[i])
        return names, scores

    def dump(self) -> bytes:
        head = json.dumps(self.labels).encode()
        return len(head).to_bytes(4, "little") + head + self.transitions.astype("<f4").tobytes() + self.weights.astype("<f4").tobytes()


def load(data: bytes) -> Model:
    n = int.from_bytes(data[:4], "little")
    labels = json.loads(data[4 : 4 + n])
    k, rest = len(labels), np.frombuffer(data[4 + n :], "<f4")
    return Model(labels, rest[k * k :].reshape(BUCKETS, k), rest[: k * k].reshape(k, k).astype(float))


def train(rows: list[tuple[str, list[str]]]) -> Model:
    """Fit by gradient steps (Adagrad) on the conditional likelihood of (language, words) rows.

    Every word of a row has the row's language. Rows of unlike languages are joined end to end in pairs, so
    transitions between languages are seen and learned as well.
    """
    labels = sorted({lang for lang, _ in rows})
    number = {name: i for i, name in enumerate(labels)}
    clean = [(number[lang], words) for lang, ws in rows if (words := [w for w in prepared(" ".join(ws)).split() if any(map(str.isalpha, w))])]
    k = len(labels)
    if not clean:
        return Model(labels or [UNKNOWN], np.zeros((BUCKETS, max(k, 1))), np.zeros((max(k, 1), max(k, 1))))
    joined, spare = [], {}
    for y, words in clean:
        other = next((z for z in spare if z != y), None)
        if other is None:
            spare.setdefault(y, []).append(words)
        else:
            first = spare[other].pop()
            if not spare[other]:
                del spare[other]
            joined.append([(other, first), (y, words)])
    joined += [[(y, w)] for y, ws in spare.items() for w in ws]
    tokens = [w for s in joined for _, ws in s for w in ws]
    gold = np.array([y for s in joined for y, ws in s for _ in ws])
    lengths = np.array([sum(len(ws) for _, ws in s) for s in joined])
    types = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
    of = np.array([types[w] for w in tokens])
    feat, owner, _ = features(list(types))
    weights, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    seen_w, seen_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    ends = np.cumsum(lengths) - 1
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    inner = np.flatnonzero(inner)
    true_moves = np.zeros((k, k))
    np.add.at(true_moves, (gold[inner], gold[inner + 1]), 1)
    one_hot = np.eye(k)[gold]
    for _ in range(STEPS):
        scores = np.stack([np.bincount(owner, c[feat], len(types)) for c in weights.T], 1)[of]
        marginals, from_left, from_right = chain(scores, lengths, moves)
        miss = one_hot - marginals
        by_type = np.stack([np.bincount(of, m, len(types)) for m in miss.T], 1)
        grad = np.stack([np.bincount(feat, g[owner], BUCKETS) for g in by_type.T], 1) / len(tokens) - DECAY * weights
        pair = from_left[inner][:, :, None] * np.exp(moves)[None] * from_right[inner + 1][:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        grad_m = (true_moves - pair.sum(0)) / len(tokens) - DECAY * moves
        seen_w += grad**2
        seen_m += grad_m**2
        weights += RATE * grad / np.sqrt(seen_w)
        moves += RATE * grad_m / np.sqrt(seen_m)
    return Model(labels, weights, moves)


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, n_docs: int, n_words: int) -> list[tuple[str, list[str]]]:
    """At most ``n_docs`` labelled documents, chosen by a hash, with ``n_words`` consecutive words of each from a hashed place.

    Each language gives an equal part of the sample, or all its rows if they are fewer, so rare languages are learned too. The labelled rows are
    counted by language first; only about twice as many rows as wanted leave the tasks.
    """
    words = F.split(F.trim(F.col("t")), r"\s+")
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(F.col(text_col), F.col(id_col)).alias("o"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))
    counts = materialize(docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")))
    n_langs = counts.count()
    part = math.ceil(n_docs / max(n_langs, 1))
    share = F.least(F.lit(1.0), F.lit(2.0 * part) / F.col("n"))
    chosen = labelled.join(small_side(counts, n_langs), "lang").filter(F.col("o") / 2.0**64 + 0.5 <= share).select("o", "lang", words.alias("w"))
    place = F.pmod("o", F.greatest(F.size("w") - n_words + 1, F.lit(1))).cast("int") + 1
    rows = chosen.select("o", "lang", F.slice("w", place, F.lit(n_words)).alias("w"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("o", "w"))
    rows = rows.withColumn("nth", nth).filter(F.col("nth") <= part).orderBy("o", "lang", "w").limit(n_docs)
    return [(r.lang, r.w) for r in rows.collect()]


def predict(text: Column, model: Model, spark) -> Column:
    """struct<lang_pred: string, score: double> for a text column."""
    shared = spark.sparkContext.broadcast(model.dump())

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = load(shared.value)
        for batch in tidy(batches):
            names, scores, some, size = [], [], [], 0
            for i, t in enumerate(batch):
                some.append(t.as_py())
                size += len(some[-1] or "")
                if size > 400_000 or i == len(batch) - 1:
                    n, s = held.texts(some)
                    names += n
                    scores += s.tolist()
                    some, size = [], 0
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        held.index, held.table, held.chars = Numbers(), None, 0  # the worker stays for other stages

    return judge.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """Rows that training may not see: CRC-32 of the id as text, modulo 3, is 1. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n_docs: int = SAMPLE_DOCS, n_words: int = SAMPLE_WORDS) -> Model:
    """Train on a bounded sample of labelled rows that are not held out. Without such rows every text is ``und``."""
    return train(training_rows(docs.filter(~held_out(F.col(id_col))), id_col, text_col, lang_col, n_docs, n_words))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``; other columns, whatever their names, are ignored.

    ``und`` with score 0 for a null text or one without a letter. Whole texts of any length are labelled; of equally likely
    languages the first by name is taken. Null ids are never held out. Repeated rows get the same result each; an empty
    table gives an empty result.
    """
    model = fit(docs, id_col, text_col, lang_col)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col), model, docs.sparkSession).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def word_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, words``: for each row the words with letters in order, as array<struct<word, lang, p>>; empty for a null text.

    For texts that switch languages: each word has the label of the highest marginal probability, given the whole text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col).dump())
    one = pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())])

    @F.arrow_udf("array<struct<word: string, lang: string, p: double>>")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = load(shared.value)
        for batch in tidy(batches):
            out = []
            for t in batch:
                words, likely = held.words(t.as_py() or "")
                best = likely.argmax(1) if len(words) else []
                out.append([{"word": w, "lang": held.labels[b], "p": min(1.0, float(m[b]))} for w, b, m in zip(words, best, likely, strict=True)])
            yield pa.array(out, pa.list_(one))

    return docs.select(F.col(id_col).alias("doc_id"), label.asNondeterministic()(F.col(text_col)).alias("words"))
