import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from schedlens.llm import lm_score as L

from .helpers import awkward, clashing, docs, sample


def conditional(model, ids, i):
    """P(every id | both sides of position i), straight from the definition."""
    emb, bias, out, prior = (p.astype(np.float64) for p in model.parts())
    h = bias.copy()
    for j, d in enumerate([-2, -1, 1, 2]):
        k = i + d
        h = h + emb[j][ids[k] if 0 <= k < len(ids) else model.size]
    z = np.tanh(h) @ out + prior
    p = np.exp(z - z.max())
    p /= p.sum()
    return p[model.klass] * np.exp(model.within)


def test_scores_are_the_sums_of_the_conditionals(spark):
    pairs = [(i, t) for i, t in sample()[:40]] + awkward()
    encoded, model = L.fit(clashing(docs(spark, pairs)), vocabulary=300, oov_ids=50)
    got = sorted(((r.doc_id, r.n_tokens, r.log_prob) for r in L.score_documents(docs(spark, pairs), vocabulary=300, oov_ids=50).collect()), key=repr)
    assert len(got) == len(pairs)
    rows = encoded.collect()
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u2").tolist()
        if not 0 < len(ids) < 300:
            continue
        want = sum(math.log(conditional(model, ids, i)[t]) for i, t in enumerate(ids))
        one = L.Model.log_probs(model, *model.padded([np.array(ids)]))
        assert abs(want - one.sum()) < 1e-3 * len(ids)
        assert any(d == r.doc_id and n == len(ids) and abs(lp - want) < 0.05 * len(ids) for d, n, lp in got)
    p = conditional(model, np.frombuffer(rows[0].ids, dtype="<u2").tolist(), 0)
    assert abs(p.sum() - 1) < 1e-6


def test_training_beats_counts_alone(spark):
    pattern = "the cat sat on the mat and the dog lay on the rug by a door".split()
    pairs = [(i, " ".join(pattern[(i + j) % len(pattern)] for j in range(200))) for i in range(120)]
    df = docs(spark, pairs)
    encoded, model = L.fit(df, vocabulary=50, oov_ids=4)
    ids = [np.frombuffer(r.ids, dtype="<u2") for r in encoded.limit(5).collect()]
    flat, at = model.padded(ids)
    counts = np.bincount(np.concatenate(ids), minlength=model.size) + 1e-9
    unigram = np.log(counts / counts.sum())[flat[at]].mean()
    assert model.log_probs(flat, at).mean() > unigram + 0.3
    words = {" ".join(pattern): 1000, " ".join(sorted(pattern)): 1001}
    out = {r.doc_id: r.mean_log_prob for r in L.score_documents(df.union(docs(spark, [(d, t) for t, d in words.items()])),
                                                                vocabulary=50, oov_ids=4).collect()}
    assert out[1000] > out[1001]


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(0)
    model = L.Model(rng.integers(1, 50, 40).astype(float), classes=8)
    flat, at = model.padded([rng.integers(0, 5, 300) for _ in range(5)])
    before = model.log_probs(flat, at).mean()
    for _ in range(30):
        model.step(flat, at)
    assert model.log_probs(flat, at).mean() > before + 0.1


def test_words_outside_the_vocabulary_have_their_own_counts(spark):
    common = "the cat sat on the mat and the dog lay on the rug"
    pairs = [(i, f"{common} " + ("often " if i % 4 else "") + f"once{i}") for i in range(200)]
    pairs += [(1000, f"{common} often"), (1001, f"{common} junk"), (None, f"{common} junk2 junk2"), (1002, None)]
    encoded, model, counted = L._fit(clashing(docs(spark, pairs)), "doc_id", "text", 9, 3, 2)
    n = {bytes(r.word): r.n for r in counted.collect()}
    ids = L.Ids([w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:9]], 3)
    totals = np.bincount([ids[w] for w in n], weights=list(n.values()), minlength=12)
    assert model.counts.tolist() == totals.tolist() and n[b"often"] == 151 and b"often" not in ids
    want = {}
    for r in encoded.filter("n > 0").collect():
        text = dict(pairs)[r.doc_id]
        x = np.frombuffer(r.ids, dtype="<u2")
        share = sum(math.log(n[w] / (totals[ids[w]] + 1)) for w in text.encode().split() if w not in ids)
        want[r.doc_id] = model.log_probs(*model.padded([x])).sum() + share
    got = {r.doc_id: r.log_prob for r in L.score_documents(docs(spark, pairs), vocabulary=9, oov_ids=3, per_word=True).collect()}
    assert got.pop(1002) == 0.0 and got.keys() == want.keys()
    assert all(abs(got[d] - want[d]) < 0.5 for d in want)
    assert got[1000] > got[1001] + 2


def test_words_are_numbered_as_they_are_split():
    texts = [" a  b\t\x0bA\x0cb\x1cd e\u00a0f\u2003g\r\n", "", " \n", "b", "x" * 50 + " a", "\x00 \x85 a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    words, at, sizes = L._words(batch.column("text"))
    found, ends = [words[i].as_py() for i in at.tolist()], np.cumsum(sizes).tolist()
    assert [found[e - n:e] for e, n in zip(ends, sizes.tolist())] == [t.encode().split() for t in texts]
    assert sum((p.column("text").to_pylist() for p in L._pieces(batch)), []) == texts
    assert list(L._pieces(batch.slice(0, 0))) == []


def test_only_words_whose_counts_are_not_sent_are_joined(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE", 1 << 12)  # many pieces a task
    pairs = [(i, f"the cat sat on a mat {'often ' * (i % 3)} some{i % 40} few{i % 90} once{i}") for i in range(300)] + [(None, None), (7, "few3 few3 new")]
    df, out, joined = clashing(docs(spark, pairs)), {}, {}
    for most in (0, 60, 1 << 18):
        monkeypatch.setattr(L, "KNOWN", most)
        encoded, _, counted = L._fit(df, "doc_id", "text", 5, 3, 1)
        joined[most] = encoded.select(F.sum(F.size("rare"))).first()[0]
        known, own, gains, ids = L.known_words(counted, [bytes(r.word) for r in counted.orderBy(F.desc("n"), "word").limit(5).collect()], 3)
        n = {bytes(r.word): r.n for r in counted.collect()}
        assert len(known) <= max(most, 5) and own[:-1].tolist() == [ids[w] for w in known.to_pylist()]
        assert np.allclose(gains, [0.0] * 5 + [math.log(n[w]) for w in known.to_pylist()[5:]] + [0.0])
        share = {r.row: r.gain for r in L.word_shares(encoded, counted).collect()}
        out[most] = sorted(((r.doc_id, r.n, bytes(r.ids), round(r.gain + share.get(r.row, 0.0), 9)) for r in encoded.collect()), key=repr)
    want = [(d, t, sum(math.log(n[w]) for w in (t or "").encode().split() if w not in ids)) for d, t in pairs]
    want = [(d, len((t or "").split()), np.array([ids[w] for w in (t or "").encode().split()], dtype="<u2").tobytes(), round(x, 9)) for d, t, x in want]
    assert out[0] == out[60] == out[1 << 18] == sorted(want, key=repr)
    assert joined[0] > joined[60] > joined[1 << 18] == 0


def whole_softmax(model, ids, i):
    """P(every id | both sides of position i) with both softmaxes, from the definition."""
    emb, bias, out, prior, own, level = (p.astype(np.float64) for p in model.parts())
    h = bias.copy()
    for j, d in enumerate([-2, -1, 1, 2]):
        h = h + emb[j][ids[i + d] if 0 <= i + d < len(ids) else model.size]
    h = np.tanh(h)
    z, g = h @ out + prior, own @ h + level
    g = np.exp(g[model.row])
    return np.exp(z)[model.klass] / np.exp(z).sum() * g / np.bincount(model.klass, weights=g)[model.klass]


def test_inner_softmax_is_a_distribution_and_its_gradient_is_right():
    rng = np.random.default_rng(1)
    model = L.Model(rng.integers(1, 50, 40).astype(float), classes=6, inner=True)
    ids = rng.integers(0, 40, 60)
    flat, at = model.padded([ids])
    model.weights = (model.weights + rng.normal(scale=0.3, size=len(model.weights))).astype(np.float32)
    ps = [whole_softmax(model, ids, i) for i in range(len(ids))]
    assert all(abs(p.sum() - 1) < 1e-9 for p in ps)
    assert np.abs(model.log_probs(flat, at) - [math.log(p[t]) for p, t in zip(ps, ids)]).max() < 1e-4
    before, start = model.weights.copy(), model.log_probs(flat, at).sum()
    model.step(flat, at, rate=1e-3)
    moved = model.weights - before
    sizes = np.cumsum([0] + [int(np.prod(s)) for s in model.shapes])
    for i in (0, 4, 5):  # embeddings and both parts of the second softmax: uphill by themselves
        model.weights = before.copy()
        model.weights[sizes[i]:sizes[i + 1]] += moved[sizes[i]:sizes[i + 1]]
        assert model.log_probs(flat, at).sum() > start


def test_a_wrong_word_of_like_frequency_costs_at_its_own_position(spark):
    pattern = "the cat sat on a mat and some dog lay by one door".split()
    pairs = [(i, " ".join(pattern[(i + j) % len(pattern)] for j in range(200))) for i in range(120)]
    spread = {}
    for inner in (False, True):
        encoded, model, _ = L._fit(docs(spark, pairs), "doc_id", "text", 13, 4, 2, inner)
        model = L.Model(model.counts, classes=2, inner=inner)  # words of one class
        L.train(encoded, model)
        ids = np.frombuffer(encoded.filter("doc_id = 0").first().ids, dtype="<u2").astype(np.int64)[:41]
        lps = []
        same = np.flatnonzero((model.klass == model.klass[ids[20]]) & (np.arange(model.size) < 13))
        for t in same:
            x = ids.copy()
            x[20] = t
            flat, at = model.padded([x])
            lps.append(model.log_probs(flat, at)[20])
        assert len(same) > 2
        spread[inner] = lps[list(same).index(ids[20])] - np.mean(lps)
    assert abs(spread[False]) < 1e-9 and spread[True] > 0.3


def step_from_definition(model, flat, at, rate):
    """The weights after a step, with both softmaxes written out in float64."""
    emb, bias, out, prior, own, level = (p.astype(np.float64) for p in model.parts())
    near = [flat[at + d] for d in (-2, -1, 1, 2)]
    h = np.tanh(bias + sum(emb[j][x] for j, x in enumerate(near)))
    of, row = model.klass[flat[at]], model.row[flat[at]]
    z = np.exp(h @ out + prior)
    z /= z.sum(1, keepdims=True)
    z[np.arange(len(at)), of] -= 1
    back = z @ out.T
    moved_own, moved_level = np.zeros_like(own), np.zeros_like(level)
    for c in range(model.classes):
        here, members = np.flatnonzero(of == c), np.arange(model.first[c], model.first[c + 1])
        if len(here):
            g = np.exp(h[here] @ own[members].T + level[members])
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(here)), row[here] - model.first[c]] -= 1
            back[here] += g @ own[members]
            moved_own[members] = rate / np.sqrt(len(here)) * (g.T @ h[here])
            moved_level[members] = rate / np.sqrt(len(here)) * g.sum(0)
    mean = L.OUT_RATE / len(at)
    back *= 1 - h * h
    for j, x in enumerate(near):
        total = np.zeros_like(emb[j])
        np.add.at(total, x, back)
        emb[j] -= rate * total / np.sqrt(np.maximum(np.bincount(x, minlength=len(total)), 1))[:, None]
    parts = [emb, bias - mean * back.sum(0), out - mean * (h.T @ z), prior - mean * z.sum(0), own - moved_own, level - moved_level]
    return np.concatenate([p.ravel() for p in parts])


def test_a_step_takes_the_exponentials_of_all_classes_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    model = L.Model(rng.integers(1, 50, 40).astype(float), classes=6, inner=True)
    model.weights = (model.weights + rng.normal(scale=0.3, size=len(model.weights))).astype(np.float32)
    flat, at = model.padded([rng.integers(0, 30, 60), rng.integers(0, 40, 5)])  # not all ids occur
    start, want = model.weights.copy(), step_from_definition(model, flat, at, 0.05)
    lps, calls, exp = model.log_probs(flat, at), [], np.exp
    for far in (40.0, -1.0):  # scores shifted by class, and row by row
        monkeypatch.setattr(L, "FAR", far, raising=False)
        assert np.abs(model.log_probs(flat, at) - lps).max() < 1e-5
        with monkeypatch.context() as m:
            m.setattr(np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
            model.step(flat, at)
        assert np.abs(model.weights - want).max() < 1e-5
        model.weights = start.copy()
    assert len(calls) == 4  # two softmaxes in each of two steps, however many classes


def test_scores_far_apart_stay_finite():
    rng = np.random.default_rng(3)
    model = L.Model(rng.integers(1, 50, 40).astype(float), classes=6, inner=True)
    model.weights = (model.weights + rng.normal(scale=60, size=len(model.weights))).astype(np.float32)
    ids = rng.integers(0, 40, 60)
    flat, at = model.padded([ids])
    model.step(flat, at, rate=1e-3)
    assert np.isfinite(model.weights).all()


def test_empty(spark):
    assert L.score_documents(docs(spark, [])).collect() == []
    out = L.score_documents(docs(spark, [(1, None), (2, " ")])).collect()
    assert {(r.n_tokens, r.log_prob, r.mean_log_prob) for r in out} == {(0, 0.0, None)}
