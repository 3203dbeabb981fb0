import zlib

import duckdb
import numpy as np

from schedlens.llm import quality as Q

from .helpers import awkward, clashing, docs, rows, sample

SF = "/root/testdata/sf0.1"


def labels(spark, triples):
    return spark.createDataFrame(triples, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    got = Q.classify(read("documents"), read("labels"))
    true = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    out = got.collect()
    assert len(out) == read("documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    test = [(r.predicted, true[r.doc_id]) for r in out if r.held_out and r.doc_id in true]
    assert len(test) > 300
    assert np.mean([p == y for p, y in test]) > 0.97
    assert np.mean([p for p, y in test if y == 1]) > 0.99  # clean documents stay


def test_labels_of_held_out_rows_do_not_matter(spark):
    pairs = sample()
    lab = [(i, i % 2, 0) for i, _ in pairs]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in lab]
    d = docs(spark, pairs)
    one, two = (rows(Q.classify(d, labels(spark, x))) for x in (lab, flipped))
    assert [r[:2] for r in one] == [r[:2] for r in two]
    assert np.allclose([r[2] for r in one], [r[2] for r in two], atol=1e-9)


def test_awkward_rows(spark):
    lab = labels(spark, [(4, 1, 0), (6, 0, None), (7, 1, 0), (8, None, 0), (None, 1, 0), (10, 0, 0), (10, 1, 0), (99, 1, 1)])
    out = Q.classify(clashing(docs(spark, awkward())), lab).collect()
    assert len(out) == len(awkward())
    assert all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[1] == by[2] == by[3] == by[13] and by[8] == by[9]


def test_no_labels_and_no_documents(spark):
    none = labels(spark, [])
    assert {r.score for r in Q.classify(docs(spark, awkward()), none).collect()} == {0.5}
    assert Q.classify(docs(spark, []), none).collect() == []


def test_features_match_a_plain_count():
    text = "Ab ab ab c1 !!!! x"
    known = Q.Hasher()
    f, doc, n = Q.features([text.encode(), b"", b"ab"], known, 18)
    k = len(text.split())
    assert list(n) == [k, 0, 1]
    # unigrams and bigrams of surfaces and shapes, trigrams of shapes
    assert np.bincount(doc).tolist() == [2 * k + 2 * (k - 1) + (k - 2), 1, 2]
    assert f[doc == 1].tolist() == [0]
    one = Q.features([text.encode()], known, 18)[0]
    assert sorted(f[doc == 0]) == sorted(one)
