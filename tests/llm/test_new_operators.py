"""Whitening, conversation trie and SentencePiece coding against brute force and the sentencepiece library."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.llm import piece_bpe, queries, turn_trie, whitening

DATA = "/root/testdata/sf0.01"

# whitening


def expected_fit(vectors):
    x = np.floor(np.array(vectors, np.float32).astype(float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    values, vecs = np.linalg.eigh(cov)
    return x, n, sums, centred, values[::-1], vecs.T[::-1], np.trace(cov)


@pytest.mark.parametrize("blocks", [1, 7, 60])
def test_rank_one_updates_give_the_spectrum(blocks):
    draw = np.random.default_rng(blocks)
    for x in (draw.integers(-300, 300, (120, 9)), np.repeat(draw.integers(0, 9, (3, 9)), 40, 0), np.eye(9, dtype=int)[draw.integers(0, 9, 120)] * 500, np.tile(draw.integers(0, 9, (1, 9)), (120, 1))):
        s = whitening.Spectrum(9)
        for part in np.array_split(x, blocks):
            s.add(part)
        c = x - x.mean(0)
        assert np.allclose(s.vectors @ np.diag(s.values) @ s.vectors.T, c.T @ c, atol=1e-9 * max(1, np.abs(c.T @ c).max()))
        assert np.allclose(s.vectors.T @ s.vectors, np.eye(9), atol=1e-10) and (s.n, s.sums.tolist()) == (120, x.sum(0).tolist())


def test_whitening_by_brute_force(spark):
    got = queries.op11_rank_one_whitening(spark, DATA).collect()
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x, n, sums, centred, values, vecs, trace = expected_fit([r.embedding for r in rows])
    at = {r.vec_id: i for i, r in enumerate(rows)}
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    ours = np.empty((n, 8))
    for r in got:
        i = at[r.vec_id]
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-12 and r.identity_error < 1e-10
        ours[i, r.component - 1] = r.whitened
    theirs = centred @ vecs[:8].T / np.sqrt(values[:8])
    for a, b in zip(ours.T, theirs.T, strict=True):
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_takes_any_table(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0, 3.0], [2.0, 1.0, 0.5], [0.0, 1.0, 0.25], [0.0, 1.0, 0.25], None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, "c", "d") for i, v in enumerate(vectors)] + [(None, [5.0, 5.0, 5.0], None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, _at string").repartition(3)
    got = whitening.whiten(df).collect()
    assert sorted({(r.vec_id is None, r.vec_id) for r in got}, key=str) == sorted({(False, 0), (False, 1), (False, 2), (False, 3), (True, None)}, key=str)
    assert len(got) == 15 and {r.component for r in got} == {1, 2, 3} and {r.n for r in got} == {5}
    w = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(abs(sum(w[i, c] ** 2 for i in (0, 1, 2, 3, None)) / 5 - 1) < 1e-9 for c in (1, 2, 3))
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id = 4")).count() == 0
    alike = whitening.whiten(df.filter("vec_id in (2, 3)")).collect()  # no variance at all
    assert len(alike) == 6 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in alike} == {(None, None, None, 0)}
    one = whitening.whiten(df.filter("vec_id in (0, 1)")).collect()  # one direction
    assert {(r.component, r.whitened is None) for r in one} == {(1, False), (2, True), (3, True)} and {r.identity_error < 1e-9 for r in one} == {True}


def test_deviations_are_exact_or_null():
    f = whitening.Fit(3 * 10**9, np.array([3 * 10**14, 3 * 10**14]), np.ones(2), np.eye(2), 2.0)
    assert whitening.deviations(f, np.array([[100_000, 100_000], [100_001, 100_000], [10**9, 1]])) == [0, 9 * 10**18, None]


# conversation trie


def expected_trie(rows, every=20, most=3):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        built[c] = tuple(own.get(c - c % every, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in m if built[c] == p)
        out[min(m), len(p)] = (
            min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in below),
            sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def same_trie(got, rows):
    got = got.collect()
    want = expected_trie(rows)
    assert len(got) == len(want)
    assert {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got} == want


CONVERSATION = "conv_id long, turn long, role string, text string, k string, id string, part string, h string, live string"


def test_trie_by_brute_force(spark):
    draw = random.Random(5)
    said = ["yes it is", "no\tno", "", None, "maybe \x0b so", "x" * 100_000]
    rows = [(c, t if t else None, draw.choice(["user", "assistant", None]), draw.choice(said[: 2 + t % 5])) for c in range(150) if c % 40 for t in range(draw.randint(1, 6))]
    rows += [(7, t + 10, "user", f"turn {t % 3}") for t in range(300)]  # one conversation with very many turns
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(60) for t in range(4)] + [(None, 1, "user", "no conversation"), (-3, 1, "user", "below zero")]
    df = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], CONVERSATION).repartition(5)
    same_trie(turn_trie.prefix_trie(df, hot_children=3, most_arcs=20), rows)
    same_trie(turn_trie.prefix_trie(df), rows)


def test_trie_of_the_production_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same_trie(queries.op12_tour_trie(spark, DATA), rows)


def test_trie_of_few_turns(spark):
    none = spark.createDataFrame([], CONVERSATION)
    assert turn_trie.prefix_trie(none).count() == 0
    rows = [(1, 5, "a", "w w"), (1, 5, "a", "w w"), (2, None, None, None)]  # repeated rows are turns of their own
    same_trie(turn_trie.prefix_trie(spark.createDataFrame([(*r, *[None] * 5) for r in rows], CONVERSATION)), rows)


@pytest.mark.parametrize("n", [1, 2, 57, 500])
def test_list_ranks(spark, n):
    draw = random.Random(n)
    order = list(range(n))
    draw.shuffle(order)
    w = [(draw.randint(0, 3), draw.randint(0, 9)) for _ in range(n)]
    arcs = [(a, order[i + 1] if i + 1 < n else turn_trie.END, *w[i]) for i, a in enumerate(order)]
    got = turn_trie.list_ranks(spark.createDataFrame(arcs, "a long, nxt long, leaves long, saved long"), most=4).collect()
    assert {(r.a, r.leaves, r.saved) for r in got} == {(a, sum(x for x, _ in w[i:]), sum(y for _, y in w[i:])) for i, a in enumerate(order)} and len(got) == n


# SentencePiece


@pytest.fixture(scope="module")
def pieces():
    data = open(queries.PIECES, "rb").read()
    return piece_bpe.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)


PARTS = ["the", "ing", " and", "</s>", "<0x41>", "  ", "    ", "\r\n", "한국", "русский", "العربية", "中文", "𝄞", "😀", "▁", "\0", "é", "ﬀ", "​", " ", ".", "''", "12", "A", "n't", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=5)), max_size=30))
def test_ids_are_the_librarys(pieces, parts):
    own, library = pieces
    text = "".join(parts)
    ids = own.encode([text])[0].tolist()
    assert ids == library.encode(text, add_eos=True) and own.decode(ids) == library.decode(ids)
    assert own.encode([text], end=False)[0].tolist() == ids[:-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 270), st.integers(0, 31_999)), max_size=12))
def test_any_ids_decode_as_the_librarys(pieces, ids):
    own, library = pieces
    assert own.decode(ids) == library.decode(ids)


def test_both_agendas_agree(pieces):
    own, library = pieces
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdeinorst", k=draw.randint(1, 300))) for _ in range(300)]
    for w in words:
        assert own.alone(w) == own.together([w])[0].tolist()
    sym, seg = own.together(words)
    assert [sym[seg == i].tolist() for i in range(len(words))] == [own.alone(w) for w in words]
    text = "long" * 50_000
    assert own.encode([text])[0].tolist() == library.encode(text, add_eos=True)


def test_documents_are_coded_as_by_the_library(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "a"), (1, "a"), (2, "\U0001d11e ▁ " * 50), (3, " " * 3000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd).withColumns({c: F.lit("clash") for c in ("ids", "own", "other", "row", "b")})
    assert piece_bpe.unlike_library(docs, queries.PIECES).count() == 0
    back = piece_bpe.round_trip(docs, queries.PIECES)
    assert back.count() == docs.count() and back.filter("doc_id is null").first().ids == [2]
    assert piece_bpe.round_trip(docs.limit(0), queries.PIECES).count() == 0


def test_piece_digests(spark, pieces):
    library = pieces[1]
    got = {r.doc_id: r for r in queries.op13_piece_agenda(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_eos=True)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        piece_bpe.Model(b"")
