"""The classifier against a plain loop: n-grams, FTRL per coordinate and dot products in
Python numbers, one text and one feature at a time."""

import math
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from schedlens.llm import quality as Q

from .helpers import awkward, docs, sample

BITS, EPOCHS = 12, 2
WRAP = 2**64


def plain_shape(word: bytes) -> bytes:
    def sign(b):
        c = bytes([b])
        return b"a" if c.islower() or b >= 0x80 else b"A" if c.isupper() else b"9" if c.isdigit() else c

    return b"".join(k if k in (b"a", b"A", b"9") else k * min(2, len(list(g))) for k, g in groupby(map(sign, word)))[:12]


def plain_features(text: bytes) -> tuple[Counter, int]:
    words = text.split()
    if not words:
        return Counter([0]), 0
    s = [xxhash.xxh64_intdigest(w, 1) // 2 for w in words]
    c = [xxhash.xxh64_intdigest(plain_shape(w), 2) // 2 for w in words]
    c = [xxhash.xxh64_intdigest(b"=", 7) // 2 if i and s[i] == s[i - 1] else c[i] for i in range(len(words))]
    m = [int(x) for x in Q._SALT]
    hashes = [x * m[0] for x in s] + [(a * m[1] + b) * m[0] for a, b in zip(s, s[1:])] + [x * m[2] for x in c]
    hashes += [(a * m[3] + b) * m[2] for a, b in zip(c, c[1:])]
    hashes += [((a * m[3] + b) * m[4] + d) * m[2] for a, b, d in zip(c, c[1:], c[2:])]
    return Counter(max(1, h % WRAP >> (64 - BITS)) for h in hashes), len(words)


def plain_weight(z: float, n: float, free: bool) -> float:
    l1, l2 = (0.0, 0.0) if free else (Q.L1, Q.L2)
    if abs(z) <= l1:
        return 0.0
    return -(z - math.copysign(l1, z)) / ((Q.BETA + math.sqrt(n)) / Q.ALPHA + l2)


def sigmoid(v: float) -> float:
    return 1 / (1 + math.exp(-min(35.0, max(-35.0, v))))


def plain_train(rows: list[tuple[bytes, int]]) -> list[float]:
    bias = 2**BITS
    z, n = [0.0] * (bias + 1), [0.0] * (bias + 1)
    made = []
    for text, y in rows:
        counts, words = plain_features(text)
        made.append(({**{f: float(np.float32(Q.SCALE * k / max(1, words))) for f, k in counts.items()}, bias: 1.0}, y))
    for _ in range(EPOCHS):
        for x, y in made:
            w = {f: plain_weight(z[f], n[f], f == bias) for f in x}
            p = sigmoid(sum(w[f] * v for f, v in x.items()))
            for f, v in x.items():
                g = (p - y) * v
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / Q.ALPHA * w[f]
                n[f] += g * g
    return [plain_weight(z[f], n[f], f == bias) for f in range(bias + 1)]


@pytest.mark.parametrize("word", [b"Hello", b"HELLO9", b"a1b22", b"!!!!?", b"..", "Ünï".encode(), b"x" * 40, b"-1-2-3-4-5-6-7-8-9", b"aAaA__9"])
def test_shapes(word):
    assert Q.shape(word) == plain_shape(word)


def test_weights_and_scores_are_those_of_the_plain_loop(spark):
    pairs = list(dict([*sample(), *((10**6 + i, t) for i, t in awkward() if i is not None)]).items())
    texts = {i: (t or "").encode() for i, t in pairs}
    label = {i: int(len(texts[i]) % 3 > 0) for i in texts}
    d = docs(spark, pairs)
    lab = spark.createDataFrame([(i, q, 0) for i, q in label.items()], "doc_id long, quality int, toxic int")
    w = Q.train(d, lab, shards=1, epochs=EPOCHS, bits=BITS)
    order = [r.doc_id for r in d.select("doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("long"))).collect()]
    want = plain_train([(texts[i], label[i]) for i in order])
    assert np.count_nonzero(w) > 100 and (np.count_nonzero(w) == np.count_nonzero(want))
    assert np.allclose(w, want, rtol=1e-9, atol=1e-12)
    for r in Q.score(d, w).collect():
        counts, words = plain_features(texts[r.doc_id])
        dot = sum(w[f] * k for f, k in counts.items()) * Q.SCALE / max(1, words) + w[-1]
        assert r.score == pytest.approx(sigmoid(dot), abs=1e-12)
