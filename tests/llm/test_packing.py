import itertools
from collections import defaultdict

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from schedlens.llm import packing as P

from .helpers import awkward, clashing, docs, rows, sample


def padding(bounds, lengths, counts):
    return sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths, counts))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 4))
def test_bounds_are_optimal(histogram, k):
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[x] for x in lengths], dtype=np.int64)
    bounds = P.optimal_bounds(lengths, counts, k)
    assert len(bounds) == min(k, len(lengths)) and bounds == sorted(set(bounds))
    best = min(padding([*c, int(lengths[-1])], lengths, counts)
               for c in itertools.combinations([int(x) for x in lengths[:-1]], len(bounds) - 1))
    assert padding(bounds, lengths, counts) == best


def check(pairs, out, max_len, budget):
    want = defaultdict(list)
    for d, t in pairs:
        want[d].append(1 + len((t or "").encode().split()))
    got = defaultdict(int)
    batches = defaultdict(list)
    for r in out:
        got[r.doc_id] += r.length
        assert 1 <= r.length <= min(max_len, r.bucket)
        batches[r.bucket, r.batch].append(r.slot)
    assert got == {d: sum(x) for d, x in want.items()}
    last = {b: max(n for k, n in batches if k == b) for b, _ in batches}
    for (b, n), slots in batches.items():
        size = max(1, budget // b)
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= size
        assert n == last[b] or len(slots) == size


def test_batches_hold_every_piece_once(spark):
    pairs = awkward() + sample()
    for group_rows in (P.GROUP_ROWS, 7):
        out = P.pack(clashing(docs(spark, pairs)), max_len=500, buckets=4, token_budget=1500, group_rows=group_rows).collect()
        check(pairs, out, 500, 1500)


def test_rows_of_one_id_are_divided(spark, monkeypatch):
    seen = []
    inner = P._ranges
    monkeypatch.setattr(P, "_ranges", lambda rows, n: seen.append((inner(rows, n), n)) or seen[-1][0])
    pairs = [(None, "a b")] * 3000 + [(8 * i, "a") for i in range(2000)] + [(7, "a b c")] * 1000
    out = P.pack(docs(spark, pairs).repartition(3), max_len=500, buckets=2, token_budget=400, group_rows=500).collect()
    check(pairs, out, 500, 400)
    (ranged, n), = seen
    groups = [r["count"] for r in ranged.groupBy("bucket", "range").count().collect()]
    assert n == 12 and sum(groups) == 6000 and max(groups) < 1000


def test_empty_and_own_token_counts(spark):
    from pyspark.sql import functions as F

    assert P.pack(docs(spark, [])).collect() == []
    out = rows(P.pack(docs(spark, [(1, "a"), (2, "b"), (None, None)]), tokens=F.lit(3)))
    assert sorted((r[1], r[2]) for r in out) == [(0, 3)] * 3


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = rows(P.op8_packing(spark, sf).select("doc_id", "piece", "length", "bucket", "batch", "slot"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.execute(P.ORACLE).fetchall(), key=repr)
