import numpy as np
from pyspark.sql import functions as F

from tidings.llm import neighbours as N


def brute(vectors, k=5, every=50):
    """{query: ids}: vectors maps id to a list of numbers."""
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for i in ids[ids % every == 0]:
        s = N.cosine(np.repeat(x[ids == i], len(x), axis=0), x)
        s[ids == i] = -np.inf
        order = np.lexsort((ids, -s))[:min(k, len(ids) - 1)]
        out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def test_small_tables_are_exact_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    good = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(90)}
    for i in range(60, 80):
        good[i] = good[50]  # copies of a query: exact ties
    rows = [(i, v, 0) for i, v in good.items()] + [(0, good[0], 0), (100, None, 0), (150, [0.0] * 8, 0), (200, [1.0] * 7 + [None], 0),
                                                   (250, [float("nan")] + [1.0] * 7, 0), (300, [float("inf")] * 8, 0), (350, [1.0, 2.0], 0), (None, good[1], 0)]
    got = {}
    for r in N.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(good)
    assert {q: [(v, s) for _, v, s in sorted(x)] for q, x in got.items()} == want
    assert want[50][0][0] == 60 and all([n for n, _, _ in sorted(x)] == [1, 2, 3, 4, 5] for x in got.values())


def test_few_and_no_candidates(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [0.0, 2.0], 0)]
    got = [tuple(r) for r in N.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2)] and abs(got[0][3] - 0.5 ** 0.5) < 1e-15 and got[1][3] == 0.0
    assert N.nearest(frame(spark, rows[:1]), F.col("vec_id") % 50 == 0).collect() == []
    assert N.nearest(frame(spark, rows).limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_recall_with_many_lists_and_a_hot_vector(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1000:2000] = x[77]  # a third of all rows
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    want = brute(vectors)
    found = {}
    for r in N.nearest(frame(spark, [(i, v, 0) for i, v in vectors.items()]), F.col("vec_id") % 50 == 0, list_size=60, block=256, query_block=8).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = np.mean([len(found[q] & {v for v, _ in w}) / 5 for q, w in want.items()])
    assert recall >= 0.9 and all(len(found[q]) == 5 for q in want)


def test_queries_whose_lists_hold_few_still_get_their_k(spark):
    rng = np.random.default_rng(5)
    vectors = {i: v.tolist() for i, v in enumerate(rng.normal(size=(1000, 16)).astype(np.float32))}
    found = {}
    # small lists, of which a query meets its nearest only
    near = N.nearest(frame(spark, [(i, v, 0) for i, v in vectors.items()]), F.col("vec_id") % 50 == 0, list_size=3, copies=1, recall=0.0, query_block=3, block=256)
    for r in near.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(vectors)
    assert all(sorted(n for n, _, _ in found.get(q, ())) == [1, 2, 3, 4, 5] for q in want)
    assert sum([(v, s) for _, v, s in sorted(found[q])] == want[q] for q in want) > len(want) / 2


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(4)
    x = N._unit(rng.normal(size=(4000, 16)).astype(np.float32))
    centre = N.balanced_centroids(x, 200, rng)
    size = np.bincount((x @ centre.T).argmax(axis=1), minlength=len(centre))
    assert size.max() < 6 * size.mean()
    ids, dist = N.Graph(centre).search(x[:300], 16)
    true = np.argsort(-(x[:300] @ centre.T), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids, true)]) > 0.95
    assert (np.diff(dist, axis=1) >= -1e-6).all()
