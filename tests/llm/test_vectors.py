"""Near vectors and nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from payloom.llm import additive_quantisation as A
from payloom.llm import near_vectors as V


def messy_vectors(spark, seed=0, n=150, d=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, d))
    rows = [(i, [float(x) for x in np.float32(base[rng.integers(12)] + rng.normal(size=d) * rng.choice([0, 0.05, 0.1, 0.3]))], int(rng.integers(2))) for i in range(n)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * d, 1), (203, [float("nan")] + [1.0] * (d - 1), 1), (204, [None] + [1.0] * (d - 1), 1), (205, [float("inf")] + [1.0] * (d - 1), 0), (206, rows[0][1], None), (207, [1.0, 2.0], 0), (208, [1.0, 2.0], 0), (3, rows[3][1], rows[3][2]), (209, [1e30] + [0.0] * (d - 1), 0), (210, [1e-30] + [0.0] * (d - 1), 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("id", "vector", "n", "tile", "weight", "links", "component")})


def test_near_components(spark):
    rows, df = messy_vectors(spark)
    good = [(i, np.array(e, float), l) for i, e, l in rows if e and l is not None and None not in e and np.isfinite(e).all() and any(e)]
    links, parent = {k: 0 for k in range(len(good))}, list(range(len(good)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(len(good)):
            u, v = good[a][1], good[b][1]
            if a != b and good[a][2] == good[b][2] and len(u) == len(v) and (u / np.linalg.norm(u)) @ (v / np.linalg.norm(v)) >= 0.98:
                links[a] += 1
                parent[find(a)] = find(b)
    lowest = {}
    for k in range(len(good)):
        lowest[find(k)] = min(lowest.get(find(k), 10**9), good[k][0])
    want = sorted((good[k][0], links[k], lowest[find(k)]) for k in range(len(good)))
    done = V.near_components(df).collect()
    ids = {g[0] for g in good}
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in done if r.vec_id in ids) == want
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in done if r.vec_id not in ids) and len(done) == len(rows)
    assert V.near_components(df.where("false")).count() == 0


def test_tiles_give_what_whole_groups_give(spark, monkeypatch):
    _, df = messy_vectors(spark, 5, 300, 20)
    want = sorted(map(tuple, V.near_components(df).collect()))
    monkeypatch.setattr(V, "TILE", 7)
    assert sorted(map(tuple, V.near_components(df).collect())) == want


def test_neighbours(spark):
    rows, df = messy_vectors(spark, 2)
    good = [(i, np.array(e, float)) for i, e, _ in rows if e and len(e) == 8 and None not in e and np.isfinite(e).all() and any(e)]
    got = {}
    for r in A.neighbours(df, F.col("vec_id") % 10 == 0, k=5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {i for i, _ in good if i % 10 == 0}
    for q, x in good:
        if q % 10 == 0:
            want = sorted((float(np.sqrt(((e - x) ** 2).sum())), i) for i, e in good if i != q)[:5]
            assert [v[0] for _, v in sorted(got[q].items())] == [i for _, i in want]
            assert np.allclose([v[1] for _, v in sorted(got[q].items())], [s for s, _ in want], rtol=1e-12)
    assert A.neighbours(df.where("false"), F.lit(True)).count() == 0
    assert A.neighbours(df.where("vec_id in (1, 2)"), F.lit(True)).count() == 2


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    hits = total = 0
    got = A.neighbours(df, F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect()
    for r in got:
        d = ((x - x[ids == r.query_id][0]) ** 2).sum(axis=1)
        d[ids == r.query_id] = np.inf
        hits += len(set(ids[np.argsort(d)[:10]].tolist()) & set(r.v))
        total += 10
    assert total == 10 * (ids % 20 == 0).sum() and hits / total >= 0.9


def test_sums_of_codewords_come_near():
    x = np.random.default_rng(1).normal(size=(2000, 16)).astype(np.float32)
    books = A.fit(x, many=4, words=32)
    error = lambda beam: float(((x - A.decode(A.encode(x, books, beam), books)) ** 2).mean())
    assert error(8) <= error(1) < float((x**2).mean()) * 0.6


def test_repeated_queries_are_answered_once(spark):
    rows, _ = messy_vectors(spark, 4)
    rows = [r for r in rows if r[0] < 150]
    twice = rows + [rows[0], (10, rows[20][1], 0)]
    df = spark.createDataFrame(twice, "vec_id long, embedding array<float>, label int")
    got = [r for r in A.neighbours(df, F.col("vec_id") % 10 == 0, k=4).collect()]
    of = {}
    for r in got:
        of.setdefault(r.query_id, []).append(r["rank"])
    assert sorted(of[0]) == [1, 2, 3, 4] and sorted(of[10]) == [1, 1, 2, 2, 3, 3, 4, 4] and sorted(of[20]) == [1, 2, 3, 4]
