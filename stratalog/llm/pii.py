"""Personal data by fixed base patterns and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments (their kind, boundaries and features of the span as a whole) and its
dynamic programme picks the best set of segments that do not overlap. Segments are bounded: at most ``MOST_TOKENS`` tokens and
``MOST_CHARS`` characters, blanks of at most ``MOST_BLANKS`` inside, no letter or digit right before or after, and without an
at sign or cue no letters, no plus inside and at most ``MOST_DIGITS`` digits (no other kind has).
It works on *regions*: runs of words with a digit or an at sign, and what may be a spelled-out address: the words that at and dot
cues join, with or without brackets, digits or not; nothing else can hold a candidate. Without brackets, an at cue counts only beside
a dot cue, as "look at example.com" names a site. Base spans that a region touches belong to it as fixed segments, so they always
stay and no added span overlaps one. All steps are linear in the length of the text, whatever its words are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import tidy

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is entered at its start only; further in, the rest of the pattern would fail or match just the same.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK, WORD, GAP = re.compile("[0-9@]"), re.compile(r"\S+"), re.compile("[ \t]+")
MOST_TOKENS, MOST_CHARS, MOST_BLANKS, MOST_DIGITS, MOST_BEFORE = 18, 128, 8, 19, 160
B, B1 = f"[ \t]{{0,{MOST_BLANKS}}}", f"[ \t]{{1,{MOST_BLANKS}}}"
#: A cue with its brackets and blanks is one token.
CUE = rf"(?i:{B}[\[({{<]{B}(?:at|dot){B}[\])}}>]{B}|{B1}(?:at|dot){B1})"
TOKEN = re.compile(rf"{CUE}|[A-Za-z]+|[0-9]+|\s+|.", re.S)
CUES = re.compile(CUE)
CUE_WORD = re.compile(r"[\[({<]?(?i:at|dot)[\])}>]?[.,;]?")
CUED, GOES_ON = re.compile(rf"(?:{CUE}|[.@])\Z"), re.compile(rf"(?:{CUE}|[.@])[A-Za-z0-9]")
AT = re.compile(r"@|[Aa][Tt](?=[ \t\])}>])")
DOT = rf"(?i:\.|{B}[\[({{<]{B}dot{B}[\])}}>]{B}|{B1}dot{B1})"
NAME = r"[A-Za-z0-9_%+-]+"
#: What stands before and after an at cue; the first is looked for in the ``MOST_BEFORE`` characters before it.
BEFORE = re.compile(rf"{NAME}(?:{DOT}{NAME})*({B}[\[({{<]?{B})\Z")
AFTER = re.compile(rf"({B}[\])}}>]?{B}){NAME}(?:{DOT}{NAME})+")
NOT_DIGITS, DIGITS, LETTERS, ALNUM = re.compile("[^0-9]+"), re.compile("[0-9]+"), re.compile("[A-Za-z]+"), re.compile("[A-Za-z0-9]+")
AT_CUE, CUE_ENDS = re.compile(r"(?i)[\[({< \t]at[\])}> \t]"), re.compile(r"(?i)(^|[ \t({<\[])(at|dot)$")
HOST = re.compile(r"(?i:[.]|[ \t\[({<]dot[ \t\])}>])[ ]?[A-Za-z]{2,}$")
#: Bound of the training sample, and the passes over it.
SAMPLE_REGIONS, PASSES, RATE = 600, 6, 0.3

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of the email pattern, found from the at signs, so long words cost no more than others."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and LOCAL.match(text, begin - 1):
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end(), "email"
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[Span]:
    """Matches of each kind that pass the kind's test, by start and then by kind as listed."""
    text = text or ""
    out = list(emails(text)) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map("0123456789".__contains__, m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def features(text: str, begin: int, end: int) -> tuple[str, ...]:
    """Features of a candidate as a whole; () if it can't be one (it must start and end as an entity does)."""
    span, before, after = text[begin:end], text[begin - 1 : begin], text[end : end + 1]
    opened = "a" if before.isalnum() else before if before and before in ".-+@_=" else " "  # a region's edge is a blank or an end of the text
    closed = "a" if after.isalnum() else after if after and after in "@-_=" else " "
    out = span_features(span)
    if not out:
        return ()
    # whether an address goes on before or after the candidate
    at = out[0] == "atTrue"
    goes = (f"from{at and CUED.search(text[max(0, begin - 12) : begin]) is not None}", f"on{at and GOES_ON.match(text, end) is not None}")
    return (*out, f"open{opened}", f"close{closed}", *goes)


@lru_cache(20_000)
def span_features(span: str) -> tuple[str, ...]:
    """Those that do not depend on what stands around the span; the first one tells whether it has an at sign or cue."""
    digits = NOT_DIGITS.sub("", span)
    at = "@" in span or AT_CUE.search(span) is not None
    if not (span[0].isalnum() or span[0] in "+(") or not span[-1].isalnum() or not at and len(digits) < 4 or "\n" in span or CUE_ENDS.search(span):
        return ()
    parts, plain = NOT_DIGITS.split(span), LETTERS.search(span) is None
    shape = LETTERS.sub("a", DIGITS.sub("0", span))
    out = (f"at{at}", f"digits{min(len(digits), 20)}", f"letters{not plain}", f"plus{span[0] == '+'}", f"luhn{len(digits) >= 14 and luhn(digits)}")
    out += (f"marks{''.join(sorted(set(ALNUM.sub('', span))))[:6]}", f"shape{shape[:24]}", f"host{not plain and HOST.search(span) is not None}")
    return (*out, f"octets{len(parts) == 4 and all(p and len(p) < 4 and int(p) < 256 for p in parts)}", f"groups{min(len(parts), 6)}")


class Region:
    """A stretch of text as tokens, with its candidate segments and fixed ones; without ``all_candidates`` only those beside the fixed ones."""

    def __init__(self, text: str, fixed: list[tuple[int, int, str]], all_candidates: bool = True):
        cuts = {0, len(text)} | {m.start() for m in TOKEN.finditer(text)} | {p for b, e, _ in fixed for p in (b, e)}
        self.text, self.at, self.fixed = text, sorted(cuts), fixed
        place = {p: i for i, p in enumerate(self.at)}
        self.kept = {(place[b], place[e], k) for b, e, k in fixed}
        self.ending: dict[int, list[tuple[int, tuple[str, ...]]]] = defaultdict(list)
        tokens = [text[b:e] for b, e in zip(self.at, self.at[1:], strict=False)]
        taken = [False] * len(tokens)
        for b, e, _ in () if all_candidates else self.kept:
            taken[b:e] = [True] * (e - b)
        joints = [i for i, t in enumerate(tokens) if t == "@" or CUES.fullmatch(t)]
        for i, t in enumerate(tokens):
            if taken[i] or not (t[0].isalnum() or t[0] in "+(") or self.at[i] and t[0].isalnum() and text[self.at[i] - 1].isalnum():
                continue
            near = bisect_left(joints, i)
            joined = near < len(joints) and joints[near] < i + MOST_TOKENS
            chars = digits = 0
            for j in range(i, min(i + MOST_TOKENS, len(tokens))):
                own = tokens[j]
                if taken[j] or (own[0].isalpha() or own == "+" and j > i) and not joined:
                    break
                chars += len(own)
                digits += len(own) if own[0].isdigit() else 0
                if chars > MOST_CHARS or own.isspace() and (len(own) > MOST_BLANKS or "\n" in own) or digits > MOST_DIGITS and not joined:
                    break
                end = self.at[j + 1]
                if text[end : end + 1].isalnum() or not own[-1].isalnum() or not joined and digits < 4:
                    continue
                if f := features(text, self.at[i], end):
                    self.ending[j + 1].append((i, f))


class Field:
    """Weights of (kind, feature); a token outside of segments scores 0."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = defaultdict(float, weights or {})
        self.table: dict[str, list[float]] | None = None

    def score(self, kind: str, found: tuple[str, ...]) -> float:
        return sum(self.weights.get(f"{kind} {f}", 0.0) for f in ["bias", *found])

    def by_feature(self) -> dict[str, list[float]]:
        """The weights of each feature for all kinds in order."""
        out: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(KINDS))
        for name, w in self.weights.items():
            kind, _, feature = name.partition(" ")
            out[feature][KINDS.index(kind)] = w
        return dict(out)

    def fit(self, regions: list[Region]) -> None:
        """Gradient steps on the log-likelihood of the regions' fixed segments, by forward and backward sums over segments."""
        seen: dict[str, float] = defaultdict(lambda: 1.0)
        self.table = None
        for _ in range(PASSES):
            for r in regions:
                n = len(r.at)
                edges = [(i, j, k, f, self.score(k, f)) for j, found in r.ending.items() for i, f in found for k in KINDS]
                into, out = defaultdict(list), defaultdict(list)
                for e in edges:
                    into[e[1]].append(e)
                    out[e[0]].append(e)
                left, right = [0.0] * n, [0.0] * n
                for j in range(1, n):
                    left[j] = add_logs([left[j - 1], *(left[e[0]] + e[4] for e in into[j])])
                for i in range(n - 2, -1, -1):
                    right[i] = add_logs([right[i + 1], *(right[e[1]] + e[4] for e in out[i])])
                step: dict[str, float] = defaultdict(float)
                for i, j, k, f, s in edges:
                    miss = ((i, j, k) in r.kept) - math.exp(left[i] + s + right[j] - left[-1])
                    if abs(miss) > 1e-4:
                        for name in ["bias", *f]:
                            step[f"{k} {name}"] += miss
                for name, g in step.items():
                    seen[name] += g * g
                    self.weights[name] += RATE * g / math.sqrt(seen[name])

    def best(self, r: Region) -> list[Span]:
        """The best segments; fixed ones are always among them, and no added one overlaps a fixed one (``r`` has only such candidates)."""
        if self.table is None:
            self.table = self.by_feature()
        bias, none = self.table.get("bias", [0.0] * len(KINDS)), [0.0] * len(KINDS)
        score, back = [0.0] * len(r.at), [None] * len(r.at)
        for j in range(1, len(r.at)):
            score[j], back[j] = score[j - 1], None
            for i, f in r.ending.get(j, ()):
                for k, s in zip(KINDS, map(sum, zip(bias, *(self.table.get(x, none) for x in f), strict=True)), strict=True):
                    if score[i] + s > score[j]:
                        score[j], back[j] = score[i] + s, (i, k)
        out, j = [], len(r.at) - 1
        while j > 0:
            if back[j]:
                out.append((r.at[back[j][0]], r.at[j], back[j][1]))
                j = back[j][0]
            else:
                j -= 1
        return sorted([*out, *r.fixed])


def add_logs(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def spelled_out(text: str) -> Iterator[tuple[int, int]]:
    """Where a spelled-out address may stand: a name, an at cue and a host of two parts at least; dots may be cues too."""
    end = 0
    for m in AT.finditer(text):
        if m.start() < max(end, 1) or not (after := AFTER.match(text, m.end())):
            continue
        first = max(end, m.start() - MOST_BEFORE)
        if m[0] == "@":
            if text[m.start() - 1].isspace() or after[1][:1].isspace():
                continue
        elif text[m.start() - 1] not in " \t[({<":
            continue
        if not (before := BEFORE.search(text[first : m.start()])):
            continue
        begin = first + before.start()
        if m[0] == "@" or before[1].strip() and after[1].strip() or re.search(r"(?i)[ \t\[({<]dot[ \t\])}>]", text[begin : after.end()]):
            end = after.end()
            yield begin, end


def marked(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words with digits or at signs, with cue words between them; found from the marks, so long words cost no more than others."""
    end = 0
    while m := MARK.search(text, end):
        begin = m.start()
        while begin > end and not text[begin - 1].isspace():
            begin -= 1
        end = WORD.match(text, m.start()).end()
        while (gap := GAP.match(text, end)) and (word := WORD.match(text, gap.end())) and (MARK.search(text, word.start(), word.end()) or CUE_WORD.fullmatch(text, word.start(), word.end())):
            end = word.end()
        yield begin, end


def regions(text: str, base: list[Span]) -> Iterator[tuple[int, Region]]:
    """Stretches that can hold a candidate, with their starts; those that overlap, or share a base span, are one."""
    out: list[list[int]] = []
    for b, e in sorted([*marked(text), *spelled_out(text), *((b, e) for b, e, _ in base)]):
        if out and b < out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([b, e])
    ahead = 0
    for begin, end in out:
        inside = []
        while ahead < len(base) and base[ahead][0] < end:
            b, e, k = base[ahead]
            inside.append((b - begin, e - begin, k))
            ahead += 1
        yield begin, Region(text[begin:end], inside, all_candidates=False)


def all_spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by start, kind and end."""
    base = base_spans(text)
    found = set(base)
    for start, r in regions(text or "", base):
        found.update((start + b, start + e, k) for b, e, k in field.best(r))
    return base, sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def without_digits(email: str) -> str:
    """An email without its digits and the signs that they leave at the edges; as it is if nothing of the pattern is left."""
    local, host = re.sub("[0-9]+", "", email).split("@")
    made = re.sub(r"([._-])[._-]+", r"\1", f"{local.strip('._%+-')}@{host.strip('.-')}")
    return made if [*emails(made)] == [(0, len(made), "email")] else email


def variants(text: str, base: list[Span]) -> list[tuple[str, list[Span]]]:
    """A region as it is, and rewritten: labelled examples of forms that the base patterns don't have.

    A phone loses its country code, and then its brackets for hyphens or dots; an email's signs are spelled out, plain and in brackets,
    with and without digits; a card's digits are grouped by dots, and with its last digit changed it is no card; an address's dots are bracketed.
    """
    out = [(text, base)]
    for b, e, k in base[:1]:
        span, rest = text[b:e], base[1:]
        digits = re.sub("[^0-9]", "", span)
        signs = ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" [at] ", "."))
        local = re.sub(r"^\+[0-9]+[ .-]*", "", span)
        groups = re.findall("[0-9]+", local)
        forms = {"phone": [local, *(m.join(groups) for m in "-." if len(groups) > 2)], "email": [m.replace("@", x).replace(".", y) for m in dict.fromkeys((span, without_digits(span))) for x, y in signs] if k == "email" else [], "card": [digits[:4] + "." + ".".join(re.findall(".{1,4}", digits[4:])), digits[:-1] + str((int(digits[-1:] or 0) + 1) % 10)], "ip": [span.replace(".", "[.]")]}[k]
        for i, new in enumerate(forms):
            if not new:  # a phone that is all country code
                continue
            shift = len(new) - (e - b)
            own = [] if k == "card" and i else [(b, b + len(new), k)]
            out.append((text[:b] + new + text[e:], [*own, *((x + shift, y + shift, z) for x, y, z in rest if x >= e)]))
    return out


def fit(docs: DataFrame, id_col: str, text_col: str, most: int = SAMPLE_REGIONS) -> Field:
    """Train on at most ``most`` regions, chosen by a hash of id and region among all documents that have any.

    Regions that the base patterns label are the positive examples, with ``variants``; others are negative ones. Half of the
    sample is taken from each.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"\S{0,40}[0-9@]\S{0,60}(?: \S{0,40}[0-9@]\S{0,40}){0,6}"), F.lit(0))
    rows = docs.filter(F.col(text_col).rlike("[0-9@]")).select(F.col(id_col).alias("i"), F.explode(found).alias("r")).filter(F.length("r") <= 200)
    rows = rows.withColumn("o", F.xxhash64("i", "r")).withColumn("likely", F.col("r").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]|[0-9]{14}"))
    chosen = [rows.filter(c).orderBy("o", "r").limit(most // 2).select("r") for c in (F.col("likely"), ~F.col("likely"))]
    texts = [x.r for c in chosen for x in c.collect()]
    made = [Region(t, s) for text in texts for t, s in variants(text, base_spans(text)) if not any(a[1] > b[0] for a, b in zip(s, s[1:], strict=False))]
    field = Field()
    field.fit(made)
    return field


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{b}:{e}" for b, e, k in spans)


def span_column(text: Column, shared) -> Column:
    """struct<base, spans>: arrays of (kind, begin, end) in code points, ends exclusive."""
    one = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf("struct<base: array<struct<kind: string, begin: int, end: int>>, spans: array<struct<kind: string, begin: int, end: int>>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        field = Field(shared.value)
        for batch in tidy(batches):
            both = [all_spans(t.as_py(), field) for t in batch]
            listed = [pa.array([[{"kind": k, "begin": b, "end": e} for b, e, k in x[i]] for x in both], pa.list_(one)) for i in (0, 1)]
            yield pa.StructArray.from_arrays(listed, ["base", "spans"])

    return scan.asNondeterministic()(text)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` for every row: arrays of (kind, begin, end) over the whole text.

    A null text counts as empty and has no spans. Texts of any length are read whole. Repeated rows and null ids pass through; other
    columns, whatever their names, are ignored; an empty table gives an empty result. The field is trained on a bounded sample of
    the same table; where that has no base span, nothing is added. Of overlapping candidates with equal scores the one that ends first,
    then the one that starts first, then the kind listed first is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(fit(docs, id_col, text_col).weights))
    return docs.select(F.col(id_col).alias("doc_id"), span_column(F.col(text_col), shared).alias("s")).select("doc_id", "s.base", "s.spans")


def redacted(text: str | None, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced together."""
    out, at = [], 0
    for b, e, k in sorted(spans):
        if b >= at:
            out += [(text or "")[at:b], f"[{k}]"]
        at = max(at, e)
    return "".join([*out, (text or "")[at:]])
