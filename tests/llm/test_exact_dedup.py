import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from schedlens.llm import exact_dedup as X

from .helpers import awkward, clashing, docs, sample


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(norm(t), []).append(i)
    low = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted([(i, low[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest())
                   for i, t in pairs], key=repr)


def found(df):
    got = df.collect()
    keep = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in keep}) == len(keep) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in keep)
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr)


def test_awkward_and_real_texts(spark):
    for pairs in (awkward(), awkward() * 2, sample()):
        assert found(X.exact_duplicates(clashing(docs(spark, pairs)).repartition(3))) == brute(pairs)


def test_spill_by_subtree_gives_the_same(spark):
    pairs = sample() + awkward()
    df = docs(spark, pairs).repartition(3)
    assert found(X.exact_duplicates(df, trie_bytes=60_000)) == brute(pairs)


def test_empty(spark):
    assert X.exact_duplicates(docs(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=6) | st.binary(max_size=3).map(lambda b: b * 40), max_size=40), st.integers(300, 4000))
def test_trie_holds_exactly_the_inserted_strings(strings, budget):
    trie, out = X.RadixTrie(), {}
    for s in strings:
        p = trie.insert(s)
        if p is None:
            out[s] = out.get(s, 0) + 1
            continue
        p.append(1)
        while trie.size > budget and trie.strings > 1:
            for t, reps in trie.spill():
                out[t] = out.get(t, 0) + len(reps)
    for t, reps in trie.terminals():
        assert t not in out
        out[t] = len(reps)
    assert out == {s: strings.count(s) for s in strings}


@given(st.binary(max_size=30))
def test_normalise(raw):
    assert X.normalise(raw) == re.sub(rb"[\x20\x09-\x0D]+", b" ", raw)
