import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from schedlens.llm import simhash as S
from schedlens.llm.xxh import xxh64_slices

from .helpers import awkward, clashing, docs, sample


def fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(pairs, radius=2):
    fps = [fingerprint(t) for _, t in pairs]
    comp = list(range(len(pairs)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted([(d, f"{f:016x}", low.get(top(i))) for i, ((d, _), f) in enumerate(zip(pairs, fps))], key=repr)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=80) | st.binary(min_size=1, max_size=9).map(lambda b: b * 200), max_size=12))
def test_xxh64_of_slices(parts):
    data, starts, lens = b"".join(parts), [], []
    for p in parts:
        starts.append(sum(lens))
        lens.append(len(p))
    got = xxh64_slices(data, np.array(starts, dtype=np.int64), np.array(lens, dtype=np.int64))
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_documents(spark):
    near = [(100 + i, " ".join(["some words that stay the same over and over"] * 20 + [f"w{i}"])) for i in range(6)]
    pairs = awkward() + sample() + near
    got = sorted([tuple(r) for r in S.near_duplicates(clashing(docs(spark, pairs)).repartition(3)).collect()], key=repr)
    assert got == brute(pairs)


def test_empty(spark):
    assert S.near_duplicates(docs(spark, [])).collect() == []


def test_bit_sliced_groups_match_brute_force():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {0, (1 << 64) - 1}
    for b in base:
        for _ in range(20):
            fps.add(b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & ((1 << 64) - 1))
    fps = np.array(sorted(fps), dtype=np.uint64)
    for radius in (0, 1, 2, 3):
        root = S.linked_groups(fps, radius)
        want = np.arange(len(fps))
        for i in range(len(fps)):
            for j in range(i):
                if int(fps[i] ^ fps[j]).bit_count() <= radius:
                    a, b = sorted((want[i], want[j]))
                    want[want == b] = a
        assert (root == want).all()


def test_hot_buckets_are_refiled_without_losing_links(spark):
    rng = random.Random(2)
    low = [rng.getrandbits(30) << 34 for _ in range(12)]  # every fingerprint shares its low bits
    fps = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in low for _ in range(30)} | set(low))
    signed = np.array(fps, dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    from schedlens.llm.components import components

    for hot in (4, 10**6):
        got = {r.node: r.root for r in components(S.near_links(df, 2, hot=hot)).collect()}
        order = np.sort(signed)
        root = S.linked_groups(order.view(np.uint64), 2)
        assert [got.get(int(x), int(x)) for x in order] == [int(order[r]) for r in root]
