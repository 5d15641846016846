"""Training-data operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from stratalog.llm import bpe, decontaminate, exact_dedup, language, licenses, near_dedup, pii, queries, shards, token_counts, urls

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, node string, ids string, rule string, n_tokens string"
WORDS = [f"w{i}" for i in range(400)]
DRAW = random.Random(7)
BASE = [" ".join(DRAW.choices(WORDS, k=80)) for _ in range(6)]


def near(text: str, edits: int) -> str:
    words = text.split()
    for _ in range(edits):
        words[DRAW.randrange(len(words))] = DRAW.choice(WORDS)
    return " ".join(words)


TEXTS = [None, "", "  \n", "one", "ONE", "one two", "é É", *BASE, *(near(b, DRAW.randint(0, 6)) for b in BASE for _ in range(30)), BASE[0].upper(), BASE[0], "x" * 5000, " ".join(BASE * 20), "l'été 12² 日本 \U0001f600", "mail a.b@c.example.com +1 (555) 555-0100 4111 1111 1111 1111 10.0.0.255"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "s", "c", "c", "c", "c") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[8], rows[8], (None, BASE[1], None, None, "c", "c", "c", "c"), (None, None, None, None, "c", "c", "c", "c")], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def encoding():
    v = bpe.Vocabulary(open(queries.TOKENIZER, "rb").read())
    assert bpe.PATTERN == public_tokenizers.PATTERN
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.rank, special_tokens={})


def grams(text, n):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def classes(rows, n, percent):
    sets = [grams(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, n, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)  # so that large buckets, the prefix filter and salted classes are met
    monkeypatch.setattr(near_dedup, "HOT", 3)
    got = near_dedup.near_duplicates(docs, n=n, percent=percent).collect()
    want = classes([(r.doc_id, r.text) for r in docs.collect()], n, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_exact_duplicates(docs, empty):
    rows = [(r.doc_id, re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in docs.collect()]
    size, largest = Counter(t for _, t in rows), {}
    for d, t in rows:
        if d is not None:
            largest[t] = max(d, largest.get(t, d))
    got = exact_dedup.exact_duplicates(docs, keep="largest").collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((d, largest.get(t), size[t]) for d, t in rows)
    kept = exact_dedup.drop_exact_duplicates(docs, keep="largest")
    assert kept.columns == docs.columns and kept.count() == len(size)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_bpe(docs, empty, encoding):
    ids = bpe.encode_documents(docs, queries.TOKENIZER)
    got = bpe.decode_documents(ids, queries.TOKENIZER, ("doc_id", "ids", "n_tokens")).collect()
    want = Counter((r.doc_id, tuple(encoding.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    text = dict((r.doc_id, r.text) for r in docs.collect())
    assert all(bytes(r.decoded).decode() == (text[r.doc_id] or "") for r in got if r.doc_id is not None)
    assert bpe.encode_documents(empty, queries.TOKENIZER).count() == 0
    both = bpe.round_trip(docs, queries.TOKENIZER).collect()
    assert Counter((r.doc_id, bytes(r.ids), r.n_tokens, bytes(r.decoded)) for r in both) == Counter((r.doc_id, bytes(r.ids), r.n_tokens, bytes(r.decoded)) for r in got)
    assert bpe.round_trip(empty, queries.TOKENIZER).count() == 0


def test_bpe_appends_and_edits(encoding):
    v = bpe.Vocabulary(open(queries.TOKENIZER, "rb").read())
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice("ab'lsve 1\n,é") for _ in range(draw.randint(0, 20)))
        held, raw = bpe.TokenizedText(v, text), bpe.LastTokens(v, text.encode())
        for _ in range(3):
            i = draw.randint(0, len(text))
            j, new = draw.randint(i, len(text)), "".join(draw.choice("ab'lsv e1\n") for _ in range(draw.randint(0, 4)))
            text = text[:i] + new + text[j:]
            held.replace(i, j, new)
            assert held.ids().tolist() == encoding.encode_ordinary(text)
        raw.append(b"xyz")
        assert raw.tokens() == bpe.LastTokens(v, raw.data).tokens() == encoding._encode_single_piece(raw.data)
    long = bpe.TokenizedText(v, "many words " * 500)
    long.replace(50, 51, "X")
    assert long.recoded < 10


def test_token_counts(docs, empty, encoding):
    lengths = [len(encoding.encode_ordinary(r.text or "")) for r in docs.collect()]
    answers = token_counts.limits(token_counts.length_histogram(docs, queries.TOKENIZER)).cache()
    for r in answers.collect():
        limit = r.context_limit
        assert (r.n_docs, r.docs_over, r.tokens_over) == (lengths.count(limit), sum(x > limit for x in lengths), sum(x for x in lengths if x > limit))
        assert (r.tokens_kept, r.tokens_total) == (sum(min(x, limit) for x in lengths), sum(lengths))
    for r in token_counts.at_limits(answers, [0, 77, 10**6]).collect():
        assert r.tokens_kept == sum(min(x, r.context_limit) for x in lengths)
    for r in token_counts.quantiles(answers, [0.0, 0.5, 0.99, 1.0]).collect():
        assert r.length == sorted(lengths)[max(int(np.ceil(r.quantile * len(lengths))), 1) - 1]
    assert token_counts.limits(token_counts.length_histogram(empty, queries.TOKENIZER)).count() == 0


def test_personal_data(docs, empty):
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))

    def plain(text):
        out = []
        for kind, p in patterns:
            for m in re.finditer(p, text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                    out.append((m.start(), m.end(), kind))
        return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))

    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice("ab.@@-+1 2345().90\n_%") for _ in range(draw.randint(0, 60)))
        assert pii.base_spans(text) == plain(text)
    for r in pii.find_personal_data(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        base = [(s.begin, s.end, s.kind) for s in r.base]
        assert base == plain(r.text) and set(base) <= {(s.begin, s.end, s.kind) for s in r.spans}
    assert pii.find_personal_data(empty).count() == 0


def test_semi_markov_field_finds_other_forms():
    plain = ["call +1 (269) 555-3296 now", "mail bob.42@mail8.example.com ok", "at 55.63.178.142 x", "card 4111111111111111 x", "id AKIA99XX 1234567 x", "in 1999 or 2001", "hash 0641917ea4e9feb9 x"] * 12
    field = pii.Field()
    field.fit([pii.Region(t, s) for p in plain for t, s in pii.variants(p, pii.base_spans(p))])
    found = lambda text: [(text[b:e], k) for b, e, k in pii.all_spans(text, field)[1]]
    assert found("ring (314) 555-6532 soon") == [("(314) 555-6532", "phone")]
    assert found("the year 1848 and so on") == []


@pytest.mark.parametrize(
    ("text", "address"),
    [
        ("mail john at example dot com now", "john at example dot com"),
        ("write jane [at] example [dot] org, please", "jane [at] example [dot] org"),
        ("ask bob.42 at mail8 dot example dot com", "bob.42 at mail8 dot example dot com"),
        ("x john(at)example(dot)com y", "john(at)example(dot)com"),
        ("or JOHN AT EXAMPLE DOT COM.", "JOHN AT EXAMPLE DOT COM"),
        ("see john.smith [at] mail [dot] sub [dot] example [dot] org!", "john.smith [at] mail [dot] sub [dot] example [dot] org"),
        ("to john@example dot com then", "john@example dot com"),
        ("arrived at home. Then we met at noon, at example.com", None),
    ],
)
def test_spelled_out_addresses(text, address):
    plain = ["call +1 (269) 555-3296 now", "mail bob.42@mail8.example.com ok", "at 55.63.178.142 x", "card 4111111111111111 x", "id AKIA99XX 1234567 x", "in 1999 or 2001", "hash 0641917ea4e9feb9 x"] * 12
    field = pii.Field()
    field.fit([pii.Region(t, s) for p in plain for t, s in pii.variants(p, pii.base_spans(p))])
    assert [(text[b:e], k) for b, e, k in pii.all_spans(text, field)[1]] == ([(address, "email")] if address else [])


def test_languages(docs, empty):
    got = language.identify(docs).collect()
    held = Counter((d, d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d in (r.doc_id for r in docs.collect()))
    assert Counter((r.doc_id, r.held_out) for r in got) == held
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    assert language.identify(empty).count() == 0


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = language.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_chain_is_forward_backward():
    draw = np.random.default_rng(1)
    scores, moves, lengths = draw.normal(size=(350, 3)), draw.normal(size=(3, 3)), np.array([1, 5, 130, 14, 64, 128, 8])
    got, at = language.chain(scores, lengths, moves)[0], 0
    for n in lengths:
        s = np.exp(scores[at : at + n])
        left, right = [s[0] / s[0].sum()], [np.ones(3)]
        for t in range(1, n):
            x = (left[-1] @ np.exp(moves)) * s[t]
            left.append(x / x.sum())
        for t in range(n - 1, 0, -1):
            x = np.exp(moves) @ (s[t] * right[-1])
            right.append(x / x.sum())
        both = np.array(left) * np.array(right[::-1])
        assert np.allclose(both / both.sum(1, keepdims=True), got[at : at + n])
        at += n


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://www.Example.com/en/1?x"), (2, "https://example.com/en/"), (3, "http://a.b.net/es/#t"), (4, None), (5, "nothing"), (None, "ftp://x.com"), (7, "http://notexample.com/en/"), (7, "http://notexample.com/en/")], "page_id long, url string")
    got = Counter((r.page_id, r.rule, r.verdict) for r in urls.judge_urls(pages, urls.rule_table(spark)).collect())
    assert got == Counter([(1, "www.example.com/en/", "allow"), (2, "example.com/en/", "block"), (3, "net/es/", "block"), (4, None, "allow"), (5, None, "allow"), (None, None, "allow"), (7, "com/", "allow"), (7, "com/", "allow")])
    assert urls.judge_urls(pages.limit(0), urls.rule_table(spark)).count() == 0
    assert {r.rule for r in urls.judge_urls(pages, urls.rule_table(spark).limit(0)).collect()} == {None}


@pytest.mark.parametrize("way", [decontaminate.by_broadcast, decontaminate.by_shuffle])
def test_containment(spark, docs, empty, way):
    parts = [" ".join(BASE[i].split()[10 : 10 + n]) for i, n in enumerate((3, 5, 8, 30, 45, 70))]
    items = [(i, t) for i, t in enumerate([*parts, None, "", "nowhere at all to be found in it"])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for r in docs.collect():
        for i, t in items:
            words = len((t or "").split())
            need, own = grams(t, 5), grams(r.text, min(max(words, 1), 5)) if len((r.text or "").split()) >= min(words, 5) else set()
            if need and 100 * len(need & own) >= 80 * len(need):
                want[r.doc_id, i, len(need & own)] += 1
    got = way(docs.select("doc_id", "text"), bench.dropna(), 5, 80)
    assert Counter((r.doc_id, r.item_id, r.shared) for r in got.collect()) == want
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_licenses(spark):
    files = spark.createDataFrame([(1, "a/LICENSE", "x\nReleased under the MIT License.\ny"), (2, "a/b/f", "code"), (3, "c/f", None), (4, None, "Licensed under CC BY-NC 4.0."), (5, "a/b/g/h", ""), (5, "a/b/g/h", "")], "doc_id long, path string, text string")
    got = Counter((r.doc_id, r.own_license, r.license, r.inherited_from) for r in licenses.scan_licenses(files).collect())
    assert got == Counter([(1, "MIT", "MIT", None), (2, None, "MIT", "a"), (3, None, "CC-BY-NC-4.0", ""), (4, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), (5, None, "MIT", "a"), (5, None, "MIT", "a")])
    assert licenses.scan_licenses(files.limit(0)).count() == 0


def test_licenses_of_single_lines(spark):
    foo = "Copyright (c) 2021 The Foo Authors. All rights reserved."
    mit = """MIT License

Copyright (c) 2021 Foo

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
    texts = {1: f"{foo}\nReleased under the MIT License\nx", 2: mit, 3: foo, 4: "Copyright all rights reserved\nLicensed under CC BY 4.0", 5: "no notice"}
    files = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in texts.items()], "doc_id long, path string, text string")
    others = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text rlike '(?i)licen[cs]e|copyright'").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("o/f").alias("path"), "text")
    assert {r.doc_id: r.own_license for r in licenses.scan_licenses(files.unionAll(others)).filter("doc_id > 0").collect()} == {1: "MIT", 2: "MIT", 3: "Proprietary", 4: "CC-BY-4.0", 5: None}


def test_shards(docs, empty):
    rows = shards.shard(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert shards.shard(empty).count() == 0


def test_equal_texts_share_a_shard(spark):
    """Copies of a small table's text, above an average lot each, and one group that fills more than a shard's half."""
    texts = [f"text {i} " + "word " * 40 for i in range(150) for _ in range(1 + i % 5)] + ["giant " * 40] * 120
    rows = shards.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    sizes, bound = Counter(), 0.5 * sum(r.size for r in rows) / shards.SHARDS
    for r in rows:
        sizes[texts[r.doc_id]] += r.size
    found = {t: {r.shard for r in rows if texts[r.doc_id] == t} for t in sizes}
    assert sum(b <= bound for b in sizes.values()) == 150 and all(len(found[t]) == 1 for t in sizes if sizes[t] <= bound)
    assert len(found["giant " * 40]) > 1
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) < 1.1 * sum(loads.values()) / shards.SHARDS
    for s in loads:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_packing_balances_all_measures():
    loads = np.random.default_rng(5).gamma(2, 10, (4000, 3))
    totals = np.array([loads[shards.pack(loads, 16) == s].sum(0) for s in range(16)])
    assert (totals.max(0) / totals.mean(0)).max() < 1.02


def test_sql_twins(spark):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    for name, sql in queries.oracle_sql().items():
        df, want = queries.queries()[name](spark, DATA), con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*columns).collect()), name


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA).collect()
    kept = {r.doc_id for r in out}
    assert len(kept) == len(out) and kept < {r.doc_id for r in docs.collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    assert all(i == c for i, _, c in classes(rows, 5, 80))
    leaks = decontaminate.contaminated(docs, spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert not kept & {r.doc_id for r in leaks.collect()}
