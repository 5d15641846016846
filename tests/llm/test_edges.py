"""Cases that the production tables don't hold: clashing columns, nulls, repeats, very long texts, planted forms, brute force."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict
from math import log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import bpe, decontaminate, exact_dedup, language, licenses, near_dedup, pii, queries, shards, token_counts, urls

DATA = "/root/testdata/sf0.01"
LONG = "long" * 250_000
#: Names that operators use inside; a caller's table may have them too.
CLASHES = ("gone", "_gone", "row", "p", "_p", "own", "own_sha", "digest", "sha", "_digest", "node", "h", "grp", "spread", "piece", "keep_id", "twice", "place", "units", "case", "host", "best", "s", "f", "found")


@pytest.fixture(scope="module")
def tricky(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and clashing names."""
    words = [f"w{i}" for i in range(300)]
    draw = random.Random(4)
    base = " ".join(draw.choices(words, k=60))
    texts = ["the man and the dog of the house", "THE MAN AND THE DOG OF THE HOUSE", base, base + " more", "", None, "12 34", LONG, "x y " * 20_000, "a"]
    rows = [(i, t, "en", "s", 1, *["c"] * len(CLASHES)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (3, "shares an id with another", "en", None, None, *[None] * len(CLASHES)), (None, base, None, None, None, *[None] * len(CLASHES)), (None, None, None, None, None, *[None] * len(CLASHES))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(3).cache()


def test_stages_take_any_table(spark, tricky):
    import corpus_pipeline as p

    texts = Counter((r.doc_id, r.text) for r in tricky.collect())
    kept = {name: stage(spark, tricky, DATA) for name, stage in p.STAGES}
    for name in ("language", "exact_dedup", "near_dedup", "decontamination"):
        assert kept[name].columns == tricky.columns, name
    got = {name: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()) for name, df in kept.items() if name != "bpe"}
    assert got["language"] == Counter({k: n for k, n in texts.items() if k[1] and re.search("[a-z]", k[1], re.I)})
    lower = lambda t: (t or "").lower()
    best = {}
    for d, t in texts:
        best[lower(t)] = max(best.get(lower(t), -1), -1 if d is None else d)
    assert Counter({(-1 if d is None else d, lower(t)): n for (d, t), n in got["exact_dedup"].items()}) == Counter({(d, t): 1 for t, d in best.items()})
    assert got["near_dedup"] == Counter({k: n for k, n in texts.items() if k[0] != 1})  # ids 3 and null have rows that stay
    assert got["decontamination"] == texts
    out = kept["bpe"].collect()
    assert len(out) == sum(texts.values()) and {len(r.ids) == 4 * r.n_tokens for r in out} == {True}


def test_stages_take_empty_tables(spark, tricky):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        assert stage(spark, tricky.limit(0), DATA).count() == 0, name


def test_benchmark_documents_go_and_others_stay(spark):
    import corpus_pipeline as p

    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first()
    docs = spark.createDataFrame([(1, "before " + item.text + " after"), (2, "before and after"), (None, None)], "doc_id long, text string")
    assert [r.doc_id for r in p.drop_benchmark_passages(spark, docs, DATA).orderBy("doc_id").collect()] == [None, 2]


def test_results_on_any_table(spark, tricky):
    """Values, not only numbers of rows, on nulls, repeats and clashing names."""
    given = Counter((r.doc_id, r.text or "") for r in tricky.collect())
    back = bpe.round_trip(tricky, queries.TOKENIZER).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in back) == given
    told = language.identify(tricky).collect()
    wordless = sum(n for (_, t), n in given.items() if not re.search(r"[^\W\d_]", t))
    assert sum(r.lang_pred == "und" for r in told) == wordless and all(0 <= r.score <= 1 for r in told)
    size = Counter()
    for (_, t), n in given.items():
        size[t.lower()] += n
    same = exact_dedup.exact_duplicates(tricky, keep="largest").collect()
    assert Counter(r.group_size for r in same) == Counter({k: sum(v for v in size.values() if v == k) for k in set(size.values())})
    assert sum(r.kept for r in same if r.doc_id is not None) >= len(size) - 1
    sizes = Counter({len(t.encode()) + 1: 0 for _, t in given})
    for (_, t), n in given.items():
        sizes[len(t.encode()) + 1] += n
    assert Counter(r.size for r in shards.shard(tricky).collect()) == sizes
    judged = urls.judge_urls(tricky, urls.rule_table(spark), "doc_id", "text").collect()
    assert {(r.host, r.rule, r.verdict) for r in judged} == {("", None, "allow")}
    near = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(tricky, n=3, percent=85).collect()}
    assert near[1, 6] == (0, False) and near[0, 6] == (0, True) and near[4, 0] == (4, True) and near[9, 1] == (9, True)


def test_links_near_the_threshold_are_found(spark):
    """2,000 pairs of a similarity of 0.860 to 0.900 at a threshold of 0.85: recall is measured, not reckoned."""
    draw, rows = random.Random(12), []
    for i in range(2000):
        words = [f"{i}.{j}" for j in range(400)]
        other = list(words)
        for j in draw.sample(range(10, 390, 4), 7 + i % 4):
            other[j] = f"{i}.{j}x"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), n=3, percent=85).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(2000)) == 2000


def test_operators_take_any_table(spark, tricky):
    n = tricky.count()
    assert near_dedup.near_duplicates(tricky, n=3, percent=85).count() == n
    assert exact_dedup.exact_duplicates(tricky, keep="largest").count() == n
    assert shards.shard(tricky).count() == n
    assert pii.find_personal_data(tricky).count() == n
    assert language.identify(tricky).count() == n
    assert bpe.round_trip(tricky, queries.TOKENIZER).count() == n
    assert licenses.scan_licenses(tricky.withColumn("path", F.col("source"))).count() == n
    assert urls.judge_urls(tricky, urls.rule_table(spark), "doc_id", "text").count() == n
    items = tricky.select("*", F.col("doc_id").alias("item_id"))
    found = decontaminate.contaminated(tricky, items)
    assert {r.doc_id for r in found.filter("item_id = 7").collect()} == {7} and found.filter("containment > 1").count() == 0
    assert token_counts.length_histogram(tricky, queries.TOKENIZER).agg(F.sum("n_docs")).first()[0] == n


# shards


def law_of_bytes(rows, texts):
    """Asserts sizes, checksums, slots and whole groups by brute force; returns the shards' loads."""
    assert Counter(r.doc_id for r in rows) == Counter(range(len(texts))) and {r.law for r in rows} == {"bytes"}
    loads, groups, places = Counter(), defaultdict(set), defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.tokens) == (len(raw) + 1, zlib.crc32(raw), len(raw.split()))
        assert 0 <= r.shard < 16 and r.grown_shard is None
        loads[r.shard] += r.size
        groups[texts[r.doc_id]].add(r.shard)
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    share, total = Counter(texts), sum(loads.values())
    for t, shards_of in groups.items():
        if max(share[t] * (len((t or "").encode()) + 1) / total, share[t] / len(texts)) * 16 <= 1:
            assert len(shards_of) == 1
    return loads


@pytest.mark.parametrize("n", [200, 1000, 10_000])
def test_groups_are_placed_whole(spark, n):
    draw = random.Random(n)
    own = [f"text {i} \n\x0b " + "word\t" * draw.randint(0, 60) for i in range(n // 3)]
    texts = [draw.choice(own) if i % 3 else [None, "", " \n", "\n"][i % 4] if i % 50 == 0 else own[i // 3 % len(own)] for i in range(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shards.shard(df).collect()
    loads = law_of_bytes(rows, texts)
    if n == 10_000:
        assert max(loads.values()) / (sum(loads.values()) / 16) < 1.02
    again = shards.shard(df.repartition(7)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_a_group_with_a_third_of_all_rows_is_cut(spark):
    texts = ["hot"] * 2000 + [None] * 1000 + [f"t{i} " * (1 + i % 30) for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shards.shard(df).collect()
    law_of_bytes(rows, texts)
    assert len({r.shard for r in rows if r.doc_id < 2000}) > 4
    again = shards.shard(df.repartition(5)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


# decontamination


@pytest.mark.parametrize("way", [decontaminate.by_broadcast, decontaminate.by_shuffle])
def test_items_that_repeat_an_id_are_one_item(spark, way):
    a, b = "a1 a2 a3 a4 a5 a6 a7 a8", "b1 b2 b3 b4 b5 b6"
    items = spark.createDataFrame([(1, a), (1, b), (1, b), (2, "c1 c2")], "item_id long, text string")
    docs = spark.createDataFrame([(10, a), (11, f"{a} x {b}"), (12, b), (13, "C1 c2 d"), (None, f"{b} {a}")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.shared, r.n_item) for r in way(docs, items, 5, 80).collect()}
    assert got == {(11, 1, 6, 6), (None, 1, 6, 6), (13, 2, 1, 1)}


@pytest.mark.parametrize("way", [decontaminate.by_broadcast, decontaminate.by_shuffle])
def test_recall_on_long_items(spark, way):
    """Items far larger than their number of hash functions, held to just above the threshold inside longer texts."""
    draw = random.Random(9)
    word = lambda: f"w{draw.randrange(50_000)}"
    items, docs = [], []
    for i in range(300):
        item = [word() for _ in range(draw.randint(60, 400))]
        keep = int((len(item) - 4) * 0.81) + 5
        items.append((i, " ".join(item)))
        docs.append((i, " ".join([word() for _ in range(300)] + item[:keep] + [word() for _ in range(300)])))
    got = way(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5, 80).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(300)}  # exact sets have all 300
    assert all(len(decontaminate.samples(np.arange(n, dtype=np.uint64))) <= 36 for n in (40, 1000))


# personal data


@pytest.fixture(scope="module")
def field(spark):
    return pii.Field(dict(pii.fit(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text").weights))


def made_card(draw):
    while True:
        digits = draw.choice("45") + "".join(draw.choices("0123456789", k=15))
        if pii.luhn(digits):
            return ".".join(digits[i : i + 4] for i in range(0, 16, 4))


def test_recall_and_precision_of_added_spans(spark, field):
    draw = random.Random(5)
    digits = lambda n: "".join(draw.choices("0123456789", k=n))
    signs = [(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" AT ", " DOT "), (" {at} ", " {dot} ")]  # three of these are in no training example

    def email():
        at, dot = draw.choice(signs)
        return f"{draw.choice(['maria', 'tom', 'zoe.k', 'x99', 'info'])}@{draw.choice(['acme.io', 'mail.co.uk', 'uni-x.edu', 'web3.org'])}".replace("@", at).replace(".", dot)

    makers = {"email": email, "phone": lambda: draw.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]), "card": lambda: made_card(draw), "ip": lambda: "[.]".join(str(draw.randrange(256)) for _ in range(4))}
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(300).collect() if r.text]
    for kind, make in makers.items():
        hits = others = 0
        for _ in range(150):
            words, new = draw.choice(texts).split()[:30], make()
            k = draw.randrange(len(words) + 1)
            text = " ".join([*words[:k], new, *words[k:]])
            begin = text.index(new)
            base, spans = pii.all_spans(text, field)
            added = set(spans) - set(base)
            hits += (begin, begin + len(new), kind) in added
            others += sum(e <= begin or b >= begin + len(new) for b, e, _ in added)
        assert hits >= 0.9 * 150 and others <= 0.05 * 150, kind


def test_added_spans_do_not_overlap_base_ones(field):
    draw = random.Random(8)
    for _ in range(2000):
        text = "".join(draw.choice(["+1 ", "( ) ", "(314) ", "555-6532", " at ", "dot", "a.b", "@", "x9", "4111 1111 1111 1111", "10.0.0.1", " "]) for _ in range(draw.randint(1, 9)))
        base, spans = pii.all_spans(text, field)
        assert set(base) <= set(spans)
        added = sorted(set(spans) - set(base))
        for b, e, _ in added:
            assert not any(x < e and b < y for x, y, _ in base), text
        assert all(x[1] <= y[0] for x, y in zip(added, added[1:], strict=False)), text


@pytest.mark.parametrize("text", ["a" * 10**6, "a" * 10**6 + "1", "1" + " " * 10**6 + "at x", "@" * 10**5, "at " + " " * 10**6, "1" * 10**6, "at x " * 100_000, "1f" * 500_000, "+1(" * 50_000, " ".join(str(10_000 + i) for i in range(5000))], ids=lambda t: t[:6])
def test_very_long_words_take_linear_time(field, text):
    began = time.process_time()
    pii.all_spans(text, field)
    assert time.process_time() - began < 8  # a quadratic step would take minutes


# licences


def cosines(texts, headers):
    """Scores of texts to all templates, from the definition."""
    term = lambda t: re.findall("[a-z]+|[0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    known = [term(t) for _, t in licenses.TEMPLATES]
    vocabulary = {w for t in known for w in t}
    df = Counter(w for t in [*known, *map(term, headers)] for w in set(t) if w in vocabulary)
    total = len(known) + len(headers)

    def vector(words):
        v = {w: (1 + log(n)) * (log((total + 1) / (df[w] + 1)) + 1 if w in vocabulary else 1) for w, n in Counter(words).items()}
        norm = sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    right = [vector(t) for t in known]
    return [[round(sum(x * r.get(w, 0) for w, x in vector(term(t)).items()), 4) for r in right] for t in texts]


def test_scores_are_tf_idf_cosines(spark):
    notices = ["Copyright (c) 2021 The Foo Authors. All rights reserved.", "Licensed under the Apache License, Version 2.0.", "nothing near: copyright law is discussed in this long line of prose", "# SPDX-License-Identifier: MIT"]
    files = [(i, f"d{i}/f{i}.c", f"code\n\n{n}\n\nmore code and more text that has nothing to do with it, at some length") for i, n in enumerate(notices)]
    got = {r.doc_id: (r.own_license, r.own_score) for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    for i, scores in enumerate(cosines(notices, notices)):
        best = max((licenses.TEMPLATES[k][0] != licenses.RESERVED, s, -k) for k, s in enumerate(scores) if s >= licenses.LEAST) if max(scores) >= licenses.LEAST else None
        assert got[i] == ((licenses.TEMPLATES[-best[2]][0], best[1]) if best else (None, None))


def test_planted_licence_files(spark):
    """Whole licence files and headers with other text around them, and files that inherit from the nearest directory."""
    draw = random.Random(2)
    noise = lambda n: " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 8))) for _ in range(n))
    files, want = [], {}
    for i, (name, text) in enumerate(t for t in licenses.NOTICES if t[0] != licenses.RESERVED):
        holder = f"Copyright (c) {1990 + i} {noise(2)}"
        files += [(3 * i, f"top/p{i}/LICENSE", f"{name}\n\n{holder}\n\n{text}"), (3 * i + 1, f"top/p{i}/src/deep/a.c", noise(50)), (3 * i + 2, f"q{i}/x.py", f"# {holder}\n# {text}\n\n{noise(80)}")]
        want |= {3 * i: name, 3 * i + 1: name, 3 * i + 2: name}
    files += [(1000, "top/NOTICE.txt", "Released under the MIT License."), (1001, "top/p999/f", "x"), (1002, "other/f", "x"), (1003, "tie/LICENSE", "Licensed under CC BY 4.0"), (1004, "tie/COPYING", "Released under the MIT License"), (1005, "tie/f", None)]
    want |= {1000: "MIT", 1001: "MIT", 1002: None, 1003: "CC-BY-4.0", 1004: "MIT", 1005: "CC-BY-4.0"}
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    right = sum(got[i].license == name for i, name in want.items())
    assert right >= 0.9 * len(want)
    assert got[1].inherited_from == "top/p0" and got[1001].inherited_from == "top" and all(got[i].license == want[i] for i in want if i >= 1000)


def test_headers_do_not_speak_for_their_directory(spark):
    files = [(1, "a/x.c", "// Released under the MIT License.\n" + "int x;\n" * 30), (2, "a/y.c", "int y;"), (3, "a/b/COPYING", "Licensed under CC BY 4.0"), (4, "a/b/z.c", "int z;")]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {1: "MIT", 2: None, 3: "CC-BY-4.0", 4: "CC-BY-4.0"}


# language, urls, token counts


def test_code_switched_words(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    pick = {lang: [r.text for r in docs.filter(F.col("lang") == lang).orderBy("doc_id").limit(12).collect()] for lang in ("en", "fr", "es", "de")}
    mixed, truth, draw = [], [], random.Random(3)
    for i in range(20):
        parts, gold = [], []
        for lang in draw.sample(list(pick), 3):
            words = [w for w in draw.choice(pick[lang]).split() if any(map(str.isalpha, w))][:25]
            parts, gold = parts + words, gold + [lang] * len(words)
        mixed.append((-1 - i, " ".join(parts), None))
        truth.append(gold)
    table = docs.select("doc_id", "text", "lang").unionAll(spark.createDataFrame([*mixed, (-100, None, None)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r.words for r in language.word_labels(table).filter("doc_id < 0").collect()}
    pairs = [(w.lang, g) for i, gold in enumerate(truth) for w, g in zip(got[-1 - i], gold, strict=True)]
    assert got[-100] == [] and sum(a == b for a, b in pairs) / len(pairs) > 0.9


def test_without_labels_nothing_is_told(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify(docs).collect()} <= {("und", 0.0), ("und", 1.0)}


def test_rare_languages_are_learned(spark):
    rows = [(i, "the and of to " * 5, "en") for i in range(3000)] + [(5000 + i, "xq zq vq " * 5, "zz") for i in range(4)]
    labels = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), n_docs=20).labels
    assert labels == ["en", "zz"]


def test_long_urls(spark):
    host = ".".join(["a"] * 100_000)
    pages = spark.createDataFrame([(1, f"http://{host}.net/es/" + "x" * 100_000), (2, "http://net/es/"), (3, "http:///es/"), (4, "http://.net/fr/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, urls.rule_table(spark)).collect()}
    assert got == {1: ("net/es/", "block"), 2: ("net/es/", "block"), 3: (None, "allow"), 4: ("net/fr/", "block")}


def test_repeated_and_null_lengths(spark):
    lengths = spark.createDataFrame([(5, 2), (5, 1), (None, 9), (0, 4), (2000, 1), (1030, 2)], "length long, n_docs long")
    got = {r.context_limit: (r.n_docs, r.docs_over, r.tokens_over, r.tokens_kept) for r in token_counts.limits(lengths).collect()}
    assert got == {0: (4, 6, 15 + 2060 + 2000, 0), 5: (3, 3, 4060, 30), 1030: (2, 1, 2000, 15 + 3 * 1030), 2000: (1, 0, 0, 4075)}
