"""Near duplicates, nearest neighbours, joins and components against brute force."""

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, neardup, njaccard
from graphloom.llm.components import components
from graphloom.llm.queries import QUERIES


def find_components(ids, links):
    low = {i: i for i in ids}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(5, 5), (5, 5)], [(i * 7 % 41, i * 11 % 41) for i in range(40)]])
def test_components(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = find_components({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}


def sets_of(texts, n):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(ids, texts, n, num, den):
    s = sets_of(texts, n)
    links = []
    for i, j in itertools.combinations(range(len(ids)), 2):
        if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
            links.append((ids[i], ids[j]))
    low = find_components(ids, links)
    return {(d, len(x), low[d]) for d, x in zip(ids, s)}


def near_texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        base = list(rng.choice(words, 40 + int(rng.integers(40))))
        for _ in range(8):
            t = list(base)
            for _ in range(int(rng.integers(4))):
                t[int(rng.integers(len(t)))] = rng.choice(words)
            texts.append(" ".join(t))
    base = list(rng.choice(words, 60))  # a large group that many share columns in
    for k in range(60):
        t = list(base)
        t[k % 60], t[(k * 7) % 60] = f"x{k}", f"y{k % 9}"
        texts.append(" ".join(t))
    return texts + ["", "   ", None, "one", "ONE", "one two", "one two three", "a\x0bb\tc d", "a b c d", "é É", "É É"] + texts[:3]


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_components_equal_all_pairs(spark, n, num):
    texts = near_texts()
    ids = [i * 3 % 1009 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in zip(ids, texts)], "doc_id long, text string, key string, size int")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in njaccard.ngram_jaccard(df, n, num, 100).collect()}
    assert got == brute(ids, texts, n, num, 100)


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (7, "x y z " * 4000)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in njaccard.ngram_jaccard(df, 3, 90, 100).collect())
    assert got == [(-1, 2, None), (4, 2, 4), (4, 2, 4), (7, 3, 7)]
    assert njaccard.ngram_jaccard(df.limit(0)).count() == 0


def test_jaccard_query(spark, data):
    docs = pd.read_parquet(f"{data}/documents.parquet")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op10_ngram_jaccard"](spark, data).collect()}
    assert got == brute(docs.doc_id.tolist(), docs.text.tolist(), 3, 90, 100)


def test_batches_of_texts_have_the_same_sets_as_single_texts(monkeypatch):
    """Sets of words by plain splitting stand one to one for sets of hashes, whatever the batch and the chunk."""
    texts = near_texts() + ["x" * 200 + " y", "x" * 200, "X" * 199, " lead and trail \n", "a\x00b c", "one two three four five six"]
    for chunk in (1 << 20, 64, 5):
        monkeypatch.setattr(njaccard, "_CHUNK", chunk)
        for n in (1, 3, 5):
            got = [frozenset(h.tolist()) for h in njaccard.Shingler(n).batch(pa.array(texts))]
            want = [frozenset(x) for x in sets_of(texts, n)]
            assert [len(g) for g in got] == [len(w) for w in want]
            assert len(set(zip(got, want))) == len(set(got)) == len(set(want))
            assert [frozenset(h.tolist()) for h in njaccard.Shingler(n).batch(pa.array(texts).slice(7, 9))] == got[7:16]
    assert njaccard.Shingler(3).batch(pa.array([], pa.string())) == [] and len(njaccard.Shingler(3).batch(pa.array([None], pa.string()))[0]) == 0


def test_sets_that_share_half_a_key_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(njaccard, "set_keys", lambda h: (len(h), int(h.sum() >> np.uint64(1)) if len(h) else 0))
    texts = ["a b c d", "e f g h", "a b c d", "i j k l m", "n o p q r", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in njaccard.ngram_jaccard(df, 3, 90, 100).collect()}
    assert got == brute(list(range(7)), texts, 3, 90, 100)


@pytest.mark.parametrize("part,broadcast", [(8, 0)])
def test_columns_in_parts_and_joins_by_shuffle(spark, monkeypatch, part, broadcast):
    monkeypatch.setattr(njaccard, "PART", part)
    monkeypatch.setattr(njaccard, "MOST_BROADCAST", broadcast)
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n, num in ((5, 80), (1, 50)):
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in njaccard.ngram_jaccard(df, n, num, 100).collect()}
        assert got == brute(list(range(len(texts))), texts, n, num, 100)


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 900)), dtype=np.uint64))
        keep = rng.random(len(a)) < rng.random()
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64)]))
        assert njaccard.differing(njaccard.parity(a), njaccard.parity(b)) <= len(np.setxor1d(a, b))


BAD = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [None]), (904, [float("nan")] * 16), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0]), (None, [1.0] * 16)]


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(30):
        base = rng.standard_normal(16)
        for _ in range(8):
            rows.append(base + rng.standard_normal(16) * 0.08 * rng.random())
    hot = rng.standard_normal(16)
    rows += [hot + rng.standard_normal(16) * 0.05 for _ in range(120)]
    rows += [rows[0], rows[0], rows[0] * 3]
    return [[float(x) for x in np.float32(r)] for r in rows]


@pytest.mark.parametrize("block,leaf,sample", [(1024, 400, 16_384), (40, 30, 16_384), (40, 30, 60)])
def test_near_duplicates_equal_all_pairs(spark, block, leaf, sample):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)] + [(i, v, 1) for i, v in BAD], "vec_id long, embedding array<float>, key int")
    got = {r.vec_id: r for r in neardup.near_duplicates(df, block=block, leaf=leaf, sample=sample).collect() if r.vec_id is not None}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    low = find_components(range(len(rows)), np.argwhere(near).tolist())
    assert np.mean([got[i].component_id == low[i] for i in range(len(rows))]) > 0.97
    for i, _ in BAD[:-1]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def planted(n, dim, seed):
    """Vectors of which a third have a partner at a cosine a little over 0.95, on the whole uniform."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    third = n // 3
    away = rng.standard_normal((third, dim))
    away -= (away * x[:third]).sum(axis=1)[:, None] * x[:third]
    away /= np.linalg.norm(away, axis=1)[:, None]
    cosine = rng.uniform(0.951, 0.97, third)[:, None]
    x[third : 2 * third] = cosine * x[:third] + np.sqrt(1 - cosine**2) * away
    return np.float32(x)


@pytest.mark.parametrize("sample", [16_384, 600])
def test_near_duplicates_recall_on_planted_pairs(spark, sample):
    """64 dimensions, with leaves from the broadcast trees alone, and mostly split further on the cluster."""
    x = planted(9000, 64, 5)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": [r.tolist() for r in x]}), "vec_id long, embedding array<float>")
    got = neardup.near_duplicates(df, leaf=200, sample=sample).toPandas().set_index("vec_id")
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    found = got.n_links.loc[np.arange(len(x))].to_numpy()
    assert want.sum() > 5000 and (found <= want).all() and found.sum() >= 0.95 * want.sum()
    assert (got.kept.to_numpy() == (got.index == got.component_id)).all()


def test_near_duplicates_of_many_lengths_and_repeated_ids(spark):
    rows = [(10 * d + k, [1.0] * d + [0.01 * k]) for d in range(1, 71) for k in range(3)] + [(5000, [1.0, 0.0, 0.0]), (5000, [1.0, 0.01, 0.0]), (5000, [0.0, 0.0, 1.0])]
    got = {r.vec_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for d in range(1, 71):
        assert all((got[10 * d + k].n_links, got[10 * d + k].component_id) == (2, 10 * d) for k in range(3))
    assert (got[5000].n_links, got[5000].component_id, got[5000].kept) == (1, 5000, True)


def exact(rows, ids, queries, k):
    x = np.array(rows)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        order = sorted((float(v), i) for v, i in zip(d, ids) if i != q)[:k]
        out[q] = [i for _, i in order]
    return out


def test_factor_one_is_exact_with_ties(spark, monkeypatch):
    rows = vectors()
    ids = list(range(len(rows)))
    df = spark.createDataFrame([(i, v, 0) for i, v in zip(ids, rows)] + [(i, v, 0) for i, v in BAD], "vec_id long, embedding array<float>, shard int")
    monkeypatch.setattr(ann, "LEAST", 8)
    monkeypatch.setattr(ann, "QUERIES", 5)
    want = exact(rows, ids, [i for i in ids if i % 10 == 0], 10)
    for factor, least in ((1.0, 1.0), (1.1, 0.95), (3.0, 0.5)):
        out = ann.nearest(df, lambda i: i % 10 == 0, 10, factor, shard=70).orderBy("query_id", "rank").collect()
        got = {}
        for r in out:
            assert r["rank"] == len(got.setdefault(r.query_id, [])) + 1
            got[r.query_id].append(r.vec_id)
        got = {q: v for q, v in got.items() if q < 900}
        hits = sum(len(set(v) & set(want[q])) for q, v in got.items())
        assert hits >= least * sum(map(len, want.values()))
        if factor == 1.0:
            assert got == want


def test_repeated_ids_and_huge_components(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [5.0, 5.0]), (1, [1.0, 0.5]), (1, [0.0, 1.0]), (2, [1e300, -1e300]), (3, [-1.7e308, 1.7e308]), (4, [1.0 + 1e-200, 0.0]), (5, [1.0, 1e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vector", F.lit("clash"))
    out = [(r["rank"], r.vec_id, r.score) for r in ann.nearest(df, lambda i: i == 0).orderBy("rank").collect()]
    own = [1.0, 0.0] if out[0][2] < 1 else [5.0, 5.0]
    with np.errstate(over="ignore"):
        want = sorted((float(np.hypot(a - own[0], b - own[1])), i) for i, (a, b) in rows[3:])
    assert [(i, d) for _, i, d in out] == [(i, d) for d, i in want] and [r for r, *_ in out] == list(range(1, len(want) + 1))
    far = spark.createDataFrame([(0, [1.7e308, 0.0]), (1, [-1.7e308, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.nearest(far, lambda i: i == 0).orderBy("rank").collect()] == [2, 1]


def test_distances_of_extreme_vectors():
    a = np.array([[1e200, 1e200], [1e-200, 0.0], [3.0, 4.0], [0.0, 0.0]])
    assert np.allclose(ann.distances(a, np.zeros(2)), [2**0.5 * 1e200, 1e-200, 5.0, 0.0], rtol=1e-12, atol=0)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    out = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(df, lambda i: i == 0).collect()]
    assert out == [(0, 1, 1, 1.414214)]
    assert ann.nearest(df.limit(0), lambda i: i == 0).count() == 0


def test_queries_have_recall(spark, data):
    e = pd.read_parquet(f"{data}/embeddings.parquet")
    rows, ids = e.embedding.tolist(), e.vec_id.tolist()
    want = exact([np.array(r, dtype=float) for r in rows], ids, [i for i in ids if i % 100 == 0], 10)
    out = QUERIES["op2_nearest"](spark, data).collect()
    hits = sum(r.vec_id in want[r.query_id] for r in out)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert QUERIES["op7_embedding_near_dedup"](spark, data).count() == len(e)
