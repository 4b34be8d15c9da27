import random

import numpy as np

from millrace.llm import knn, neardup


def brute(ids, x, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = {}
    for i, n in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (-round(float(s[i, j]), 6), ids[j]))
        out[n] = [ids[j] for j in order if j != i][:k]
    return out


def test_recall_and_edges(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((12, 64))
    x = centre[rng.integers(0, 12, 2500)] + 0.9 * rng.standard_normal((2500, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = [f"c{i:05d}" for i in range(len(x))]
    rows = [(i, v.tolist(), 1, "e") for i, v in zip(ids, x, strict=True)]
    bad = [("n", None), ("z", [0.0] * 64), ("w", [1.0] * 48), ("f", [float("nan")] + [1.0] * 63), ("i", [float("inf")] + [1.0] * 63), (None, [1.0] * 64)]
    extra = [(i, v, 1, "e") for i, v in bad] + rows[:100] + [(ids[5], [-y for y in rows[5][1]], 0, "old")]
    df = spark.createDataFrame(rows + extra, "chunk_id string, dense_vector array<float>, embedded_at int, rank string")
    want = brute(ids, x.astype(np.float64), 10)
    got = {}
    for r in knn.nearest(df, list_rows=300, probes=4, sample_rows=1500).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert set(got) == set(ids)
    assert sum(len(got[i] & set(want[i])) for i in ids) / (10 * len(ids)) >= 0.9
    # one list is an exhaustive search
    exact = {}
    for r in knn.nearest(df, list_rows=10_000).collect():
        exact.setdefault(r.id, {})[r.rank] = r.neighbour
    assert sum(len(set(exact[i].values()) & set(want[i])) for i in ids) / (10 * len(ids)) >= 0.98


def test_pairs_of_a_hot_vector(spark):
    v = [1.0] + [0.0] * 63
    rng = np.random.default_rng(1)
    rows = [(f"h{i:03d}", v, 0) for i in range(60)] + [(f"r{i:03d}", rng.standard_normal(64).tolist(), 0) for i in range(100)]
    df = spark.createDataFrame(rows, "chunk_id string, dense_vector array<float>, embedded_at int")
    pairs = {tuple(r) for r in knn.similar_pairs(df, list_rows=10).collect()}
    assert pairs and all(a < b and a[0] == b[0] == "h" for a, b in pairs)
    assert len({x for p in pairs for x in p}) == 60
    assert knn.similar_pairs(df.where("false")).count() == 0


def test_a_third_of_all_rows_alike(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal(64).tolist()
    rows = [(f"h{i:05d}", v, 0) for i in range(2000)] + [(f"r{i:05d}", rng.standard_normal(64).tolist(), 0) for i in range(4000)]
    df = spark.createDataFrame(rows, "chunk_id string, dense_vector array<float>, embedded_at int")
    got = {}
    for r in knn.nearest(df, list_rows=300).where("id like 'h%'").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    ids = [f"h{i:05d}" for i in range(11)]
    assert len(got) == 2000 and all(n == [x for x in ids if x != i][:10] for i, n in got.items())


def test_equal_vectors_stand_for_all_their_ids(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 64)).round(1)
    x = np.concatenate([x, x[:20], x[:20], x[:3]])
    ids = [f"c{i:03d}" for i in rng.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "chunk_id string, dense_vector array<float>, embedded_at int")
    want = brute(ids, (x / np.linalg.norm(x, axis=1, keepdims=True)), 10)
    got = {}
    for r in knn.nearest(df, list_rows=10_000).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert set(got) == set(ids) and sum(len(set(got[i]) & set(want[i])) for i in ids) >= 0.98 * 10 * len(ids)
    assert all(len(n) == 10 and i not in n for i, n in got.items())


def test_many_lists_are_fitted_in_two_steps(monkeypatch):
    monkeypatch.setattr(knn, "FLAT_LISTS", 20)
    x = np.random.default_rng(9).standard_normal((2000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = knn.Model(x, 100)
    assert 80 <= len(model.centroids) <= 120 and abs(model.share.sum() - 1) < 1e-6


def shingles(text, n=3):
    w = neardup.words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= 60 else set()


def test_pairs_against_brute_force(spark):
    rng = random.Random(9)
    common = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        base = [rng.choice(common) if rng.random() < 0.7 else f"u{rng.randrange(10**6)}" for _ in range(rng.randint(60, 140))]
        texts.append(" ".join(base))
        for rate in (0.02, 0.1, 0.2, 0.3):
            words = [w if rng.random() > rate else rng.choice(["", "x", w + " y"]) for w in base]
            texts.append(" ".join(words))
        half = len(base) // 2
        texts.append(" ".join(base[half:] + base[:half]))
    texts += ["a " * 70, "a " * 90, "a b " * 40, "a b c " * 30, "中" * 80, "中文" * 40, "short text", "", texts[0], texts[0].upper()]
    rows = [(f"i{i:04d}", t, 1) for i, t in enumerate(texts)] + [("nul", None, 1), (None, texts[1], 1), ("i0003", texts[3], 2)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, key int")
    sets = {f"i{i:04d}": shingles(t) for i, t in enumerate(texts)}
    names = sorted(sets)
    for similarity in (0.5, 0.8):
        want = {
            (a, b)
            for k, a in enumerate(names)
            for b in names[k + 1 :]
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
        }
        got = {tuple(r) for r in neardup.alike_pairs(df, similarity=similarity).collect()}
        assert got == want
    assert neardup.alike_pairs(df.where("false")).count() == 0


def test_dual_traversal_loses_no_pair():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 2**63, 100).astype(np.uint64)) for _ in range(30)]
    sets = base + [np.unique(np.concatenate([b[: int(len(b) * k)], rng.integers(0, 2**63, 20).astype(np.uint64)])) for b in base for k in (0.6, 0.9)]
    tree = neardup.SignatureTree(sets)
    found = set(neardup.dual_traversal(tree, tree, 0.5))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if both >= 0.5 * (len(a) + len(b) - both):
                assert (i, j) in found
    assert len(found) < len(sets) ** 2 / 4


def test_probes_grow_with_the_lists(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = [f"c{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "chunk_id string, dense_vector array<float>, embedded_at int")
    want = brute(ids, x.astype(np.float64), 10)
    got = {}
    for r in knn.nearest(df, list_rows=50).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert sum(len(got[i] & set(want[i])) for i in ids) / (10 * len(ids)) >= 0.9


def test_groups_of_connected_texts(spark):
    rng = random.Random(12)
    chain = [[f"w{rng.randrange(10**6)}" for _ in range(90)]]
    for i in range(5):  # each alike to the next one only
        words = list(chain[-1])
        words[i * 15 : i * 15 + 15] = [f"v{rng.randrange(10**6)}" for _ in range(15)]
        chain.append(words)
    texts = [" ".join(w) for w in chain] + [" ".join(chain[0])] * 2 + [" ".join(f"x{rng.randrange(10**6)}" for _ in range(80)), "short", "short", None]
    df = spark.createDataFrame([(f"c{i:02d}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    pairs = [tuple(r) for r in neardup.alike_pairs(df).collect()]
    links = {i: sum(i in p for p in pairs) for p in pairs for i in p}
    got = {r.chunk_id: (r.group_id, r.links) for r in neardup.alike_groups(df).collect()}
    assert got == {f"c{i:02d}": ("c00", links[f"c{i:02d}"]) for i in range(8)}
    assert neardup.alike_groups(df.where("false")).count() == 0


def test_a_limit_needs_fewer_lists_and_loses_no_pair(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1500, 64))
    x = np.concatenate([x, x + 0.3 * rng.standard_normal(x.shape)])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = [f"c{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "chunk_id string, dense_vector array<float>, embedded_at int")
    vectors = knn.usable_vectors(df, id_col="chunk_id", vector_col="dense_vector", time_col=None, width=64)
    model = knn.Model(x, 60)
    assert knn._probes(vectors, model, x[:400], 10, 0.9) < knn._probes(vectors, model, x[:400], 10) / 2
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(s >= 0.9, 1)), strict=True)}
    got = {tuple(r) for r in knn.similar_pairs(df, list_rows=50).collect()}
    assert len(want) > 1000 and got <= want and len(got) >= 0.99 * len(want)
