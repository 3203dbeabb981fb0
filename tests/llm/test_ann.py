import numpy as np
from pyspark.sql import functions as F

from schedlens.llm import ann as A

SF = "/root/testdata/sf0.1"


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        order = sorted((float(v), i) for v, i in zip(d, ids) if i != q)[:k]
        out[q] = [(i, v) for v, i in order]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_on_the_table(spark):
    got = answers(A.op5_ann(spark, SF))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
    want = brute(ids, x, [i for i in ids if i % 100 == 0])
    assert got.keys() == want.keys()
    hit = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert hit >= 0.9, hit
    for q, found in got.items():
        assert found == sorted(found, key=lambda t: (t[1], t[0]))
        for i, v in found:
            assert abs(v - np.sqrt(((x[ids.index(i)] - x[ids.index(q)]) ** 2).sum())) < 1e-12


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, list string, score double")


def test_awkward_vectors_take_no_part(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(0, 300)]
    bad = [(1000, None), (1100, [0.0] * 4), (1200, [1.0, None, 0.0, 0.0]), (1300, [float("nan")] * 4),
           (1400, [float("inf"), 0.0, 0.0, 1.0]), (1500, [1.0, 2.0]), (None, [1.0] * 4), (1600, [])]
    got = answers(A.nearest(frame(spark, good + bad), F.col("vec_id") % 100 == 0, list_rows=30))
    ids, x = [i for i, _ in good], np.array([v for _, v in good], dtype=np.float64)
    want = brute(ids, x, [0, 100, 200])
    assert got.keys() == want.keys()
    hit = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert hit >= 0.9


def test_ties_copies_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_ROWS", 50)
    same = [(i, [1.0, 0.0]) for i in range(400)] + [(400, [0.0, 1.0]), (400, [0.0, 1.0])]
    got = answers(A.nearest(frame(spark, same), F.col("vec_id") % 100 == 0, list_rows=40))
    assert [i for i, _ in got[0]] == list(range(1, 11)) and [i for i, _ in got[300]] == list(range(10))
    assert [i for i, _ in got[400]] == list(range(10))
    few = [(0, [1.0]), (1, [2.0]), (2, [4.0])]
    assert answers(A.nearest(frame(spark, few), F.col("vec_id") == 0)) == {0: [(1, 1.0), (2, 3.0)]}
    assert answers(A.nearest(frame(spark, few[:1]), F.col("vec_id") == 0)) == {}
    assert answers(A.nearest(frame(spark, []), F.col("vec_id") == 0)) == {}


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(2)
    c, x = rng.normal(size=(600, 16)), rng.normal(size=(200, 16))
    g = A.CentroidGraph(c)
    d = g.search(x, 0.1)
    assert (d.argmin(1) == A._distances(x, c).argmin(1)).mean() > 0.97
    assert np.isfinite(d).mean() < 0.9


def test_lists_are_balanced():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(3000, 8)) * 0.1, rng.normal(size=(1000, 8))])
    size = np.bincount(A._distances(x, A.balanced_centroids(x, 40)).argmin(1), minlength=40)
    assert size.max() < 4 * size.mean()


def test_repeated_ids_do_not_displace_other_ids(spark):
    """Ten different neighbours are found although one id, or every id, has many near rows."""
    rng = np.random.default_rng(8)
    rows = [(0, [0.0, 1.0])] + [(1, [0.01 * i, 1.0]) for i in range(1, 16)] + [(101 + i, [1.0 + i, 1.0]) for i in range(1, 13)]
    many = [(i, rng.normal(size=4).tolist()) for i in range(500) for _ in range(13)]
    for table in (rows, many):
        df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
        got = {}
        for r in A.nearest(df, F.col("vec_id") % 100 == 0).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert got
        for q, found in got.items():
            found.sort()
            assert [x[0] for x in found] == list(range(1, 11)) and len({x[1] for x in found}) == 10 and q not in {x[1] for x in found}
    near = {}
    for i, v in rows[1:]:
        near[i] = min(near.get(i, np.inf), abs(v[0]))
    want = sorted((d, i) for i, d in near.items())[:10]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.score, r.vec_id) for r in A.nearest(df, F.col("vec_id") == 0).collect()]
    assert sorted(got) == want
