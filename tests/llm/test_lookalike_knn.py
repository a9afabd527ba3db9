from __future__ import annotations

import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from searchloom.llm import knn, lookalike

SAME = [("ａｂｃ１！", "abc1!"), ("é", "é"), ("a​b­c﻿", "abc"), ("a b　c", "a b c"), ("раураl", "paypal"), ("Ελλάδα", "Ελλάδα".replace("ά", "ά")), ("K Ω ;", "K Ω ;"), ("x‑y‐z", "x-y-z"), ("ﬁn", "fin"), ("µ", "μ"), ("ї", "ї"), ("ｶﾞ", "ガ"), ("a‍́", "á"), ("q̣̇", "q̣̇")]
DIFFERENT = [("a", "A"), ("e", "é"), ("x²", "x2"), ("H₂O", "H2O"), ("a  b", "a b"), ("a\nb", "a b"), ("a.b", "a!b"), ("0", "O"), ("1", "l"), ("½", "1/2"), ("a–b", "a-b"), ("’", "'"), ("👩‍💻", "👩💻"), ("①", "1"), ("é", "ė")]


SAME += [("Пepeд", "Πepeд"), ("Γ Φ κ", "Г Ф к")]
DIFFERENT += [("Λ", "Л"), ("π", "п"), ("Δ", "Д")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert lookalike.canonical(a) == lookalike.canonical(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_look(a, b):
    assert lookalike.canonical(a) != lookalike.canonical(b)


@settings(max_examples=500, deadline=None)
@given(st.text())
def test_segments_equal_the_whole(s):
    """Only unstable segments are touched, and the result is that of folding and normalizing everything, and stable."""
    out = lookalike.canonical(s)
    assert lookalike.canonical(out) == out
    assert unicodedata.is_normalized("NFC", out)
    if lookalike.JOINER not in s:
        whole = unicodedata.normalize("NFC", unicodedata.normalize("NFD", s.replace("\r\n", "\n")).translate(lookalike.tables().fold))
        assert unicodedata.normalize("NFC", whole) == out


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_form_is_invariant_under_decomposition(s):
    assert lookalike.canonical(unicodedata.normalize("NFD", s)) == lookalike.canonical(s)


def test_pairs(spark):
    rows = [(1, "paypal"), (2, "раураl"), (3, "paypal"), (4, "PAYPAL"), (5, None), (6, ""), (7, " "), (8, "​"), (9, " "), (None, "pay​pal"), (10, "long " * 9000 + "é"), (11, "long " * 9000 + "é"), (11, "long " * 9000 + "é")]
    df = spark.createDataFrame([(*r, "v") for r in rows], "doc_id long, text string, variant string")
    got = sorted(tuple(r) for r in lookalike.lookalike_pairs(df).collect())
    assert got == [(1, 2), (2, 3), (10, 11)]
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0
    forms = {r["doc_id"]: r["canonical"] for r in lookalike.with_canonical(df.where("doc_id < 9")).collect()}
    assert forms[2] == "paypal" and forms[5] is None and forms[6] == "" and forms[8] == ""


def brute(ids, x, k):
    """The k most similar others of every id, ties to the smaller id."""
    ids, x = np.asarray(ids), np.asarray(x, dtype=float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2.0)
    out = {}
    for i, row in enumerate(s):
        few = np.flatnonzero(row >= np.partition(row, max(len(row) - k, 0))[max(len(row) - k, 0)])
        out[int(ids[i])] = [int(j) for j in ids[few[np.lexsort((ids[few], -row[few]))]][:k]]
    return out


def vectors(spark, ids, x, extra=()):
    rows = [(int(i), [float(y) for y in v], 0.5, 1) for i, v in zip(ids, x)] + [(*e, 0.5, 1) for e in extra]
    return spark.createDataFrame(rows, "id long, embedding array<float>, similarity double, rank int")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8))
    x = (centres[rng.integers(0, 40, 3000)] + 0.15 * rng.normal(size=(3000, 8))).astype(np.float32).astype(float)
    ids = rng.permutation(10_000)[:3000]
    got = {}
    for r in knn.nearest(vectors(spark, ids, x), bucket=150).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    want = brute(ids.tolist(), x, 10)
    hits = sum(len(set(want[i]) & set(got[i].values())) for i in want)
    assert hits / sum(map(len, want.values())) >= 0.97


def test_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8)).astype(np.float32).astype(float)
    x[20:50] = x[19]
    extra = [(100, None), (101, [0.0] * 8), (102, [float("nan")] + [1.0] * 7), (103, [1.0] * 7), (104, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (5, [float(v) for v in x[5]])]
    got = {}
    for r in knn.nearest(vectors(spark, range(60), x, extra)).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    want = brute(list(range(60)), x, 10)
    assert set(got) == set(range(60))
    for i in range(19, 50):
        assert [n for _, n in sorted(got[i])] == [j for j in range(19, 50) if j != i][:10] == want[i]


def test_a_bucket_that_hashes_cannot_split_is_searched_whole(spark):
    rng = np.random.default_rng(7)
    x = np.ones((300, 8)) + 1e-5 * rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, embedding array<double>")
    pairs = {tuple(r) for r in knn.similar_pairs(df, bucket=20).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = ((u[:, None] - u[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(min(i, int(j)), max(i, int(j))) for i in range(300) for j in np.argsort(d[i])[:10]}
    assert len(pairs & want) >= 0.9 * len(want)


def test_small_tables(spark):
    assert knn.nearest(vectors(spark, [], np.zeros((0, 8)), [(1, None)])).count() == 0
    assert knn.nearest(vectors(spark, [1], np.ones((1, 8)))).count() == 0
    two = knn.nearest(vectors(spark, [1, 2], np.ones((2, 8)))).collect()
    assert sorted((r["id"], r["neighbour"]) for r in two) == [(1, 2), (2, 1)]


def test_ties_at_the_last_place_go_to_smaller_ids(spark):
    x = np.concatenate([np.eye(8), -np.eye(8)])  # each is at a right angle to 14 others
    got = {}
    for r in knn.nearest(vectors(spark, range(1, 17), x), k=3).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for i in range(1, 17):
        want = [j for j in range(1, 17) if j % 8 != i % 8][:3]
        assert [n for _, n in sorted(got[i])] == want


def clustered(n: int, seed: int = 5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 8))
    x = (centres[rng.integers(0, 40, n)] + 0.15 * rng.normal(size=(n, 8))).astype(np.float32).astype(float)
    return rng.permutation(10 * n)[:n], x


@pytest.mark.parametrize("most", [200_000, 700])
def test_a_small_sample_keeps_recall_and_sends_no_more(spark, monkeypatch, most):
    """A sample in which a cell of 200 vectors is less than one vector wide; with ``most`` also the grids of blocks."""
    monkeypatch.setattr(knn, "SAMPLE", 60)
    monkeypatch.setattr(knn, "CELL_MOST", most)
    ids, x = clustered(6000)
    df = vectors(spark, ids, x)
    got = {}
    for r in knn.nearest(df, cell=200, bucket=100).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    assert all(sorted(v) == list(range(1, 11)) for v in got.values()) and len(got) == len(ids)
    want = brute(ids.tolist(), x, 10)
    assert sum(len(set(want[i]) & set(got[i].values())) for i in want) / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("n", [3000, 6000])
def test_messages_grow_with_the_table(n):
    """Whatever n over the sample is, a vector is sent to at most tables x (1 + probes) cells, and the nodes stay bounded."""
    x = knn.unit(clustered(n)[1])
    tree = knn.CellTree(x[:60], knn.Rotations(8, 7), n / 60, 200, knn.LEAST)
    assert len(tree.child) <= knn.CellTree.node_bound(60, knn.LEAST)
    row, cell, own = tree.probe(x, 1)
    assert len(row) <= 2 * n and own.sum() == n


def test_an_id_with_two_vectors_and_many_copies(spark):
    e = [[float(i == j) for j in range(8)] for i in range(8)]
    rows = [(1, e[0]), (1, e[1]), (2, e[1]), (3, e[1]), *[(100 + i, e[2]) for i in range(40)]]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {}
    for r in knn.nearest(df, k=3).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    # Of the two vectors of id 1 the one with the smaller bytes counts: that of ids 2 and 3.
    assert {i: [n for _, n in sorted(v)] for i, v in got.items() if i < 4} == {1: [2, 3, 100], 2: [1, 3, 100], 3: [1, 2, 100]}
    assert all(len(v) == 3 for v in got.values()) and len(got) == 43
    assert [n for _, n in sorted(got[139])] == [100, 101, 102]
    assert [n for _, n in sorted(got[100])] == [101, 102, 103]


def test_classes_agree_with_pairs(spark):
    texts = ["ab c", "ａb c", "ab c", "a\u200bb c", "other", "other", "é", "e\u0301", None, "", "\u200b", "\u200b\u200b"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, look int")
    rows = lookalike.lookalike_members(df).collect()
    pairs = {(a["doc_id"], b["doc_id"]) for a in rows for b in rows if a["look"] == b["look"] and a["variant"] != b["variant"] and a["doc_id"] < b["doc_id"]}
    assert pairs == {tuple(r) for r in lookalike.lookalike_pairs(df).collect()}
    assert {(r["doc_id"], r["documents"], r["strings"]) for r in rows} == {(0, 4, 3), (1, 4, 3), (2, 4, 3), (3, 4, 3), (6, 2, 2), (7, 2, 2)}
