import fnmatch
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from schedlens.llm import token_shards as T
from schedlens.session import scratch_path

from .helpers import awkward, clashing, docs, sample

ENC, _, END = T.tokenizer(T.model_path())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**64 - 1))
def test_feistel_is_a_permutation(n, key):
    f = T.Feistel(n, key)
    slots = f.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (f.index(slots) == np.arange(n)).all()


def test_another_key_gives_another_order():
    assert (T.Feistel(1000, 1).slot(np.arange(1000)) != T.Feistel(1000, 2).slot(np.arange(1000))).mean() > 0.9


@pytest.mark.parametrize("seq_len,shard_slots", [(64, 16), (2048, 4096)])
def test_round_trip(spark, seq_len, shard_slots):
    pairs = awkward() + sample()
    df = clashing(docs(spark, pairs)).coalesce(3)
    stored = scratch_path(spark, "docs")
    df.write.parquet(stored)
    df = spark.read.parquet(stored)
    layout = T.write_shards(df, scratch_path(spark, "shards"), seq_len=seq_len, shard_slots=shard_slots)
    got = T.read_shards(spark, layout).collect()
    n = layout["sequences"]
    assert sorted(r.slot for r in got) == list(range(n))
    for r in got:
        assert (r.shard, r.byte_offset) == (r.slot // shard_slots, r.slot % shard_slots * layout["stride"])
        assert hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 2 * r.n_tokens
    # in the order before the permutation the ids are those of the scanned documents
    index = T.Feistel(n, layout["key"]).index(np.array([r.slot for r in got]))
    stream = b"".join(r.ids for _, r in sorted(zip(index.tolist(), got), key=lambda x: x[0]))
    scanned = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = [[*ENC.encode_ordinary(t or ""), END] for _, t in scanned]
    assert np.frombuffer(stream, "<u2").tolist() == [i for w in want for i in w]
    assert sum(r.n_docs for r in got) >= len(pairs)
    some = T.read_shards(spark, layout, n // 3, n // 2).collect()
    assert sorted(r.slot for r in some) == list(range(n // 3, n // 2))


def test_first_document_of_each_sequence(spark):
    pairs = [(i, "word " * (i % 7 * 30)) for i in range(60)]
    df = docs(spark, pairs).coalesce(1)
    layout = T.write_shards(df, scratch_path(spark, "shards"), seq_len=50, shard_slots=8)
    got = T.read_shards(spark, layout).collect()
    index = T.Feistel(layout["sequences"], layout["key"]).index(np.array([r.slot for r in got]))
    owner = [d for d, t in pairs for _ in range(len(ENC.encode_ordinary(t)) + 1)]
    for i, r in zip(index.tolist(), got):
        mine = owner[i * 50:i * 50 + 50]
        assert (r.first_doc_id, r.n_docs) == (mine[0], len(set(mine)))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 5000), st.integers(0, 5000))
def test_patterns_name_the_range_and_nothing_else(a, b):
    a, b = 10**4 + min(a, b), 10**4 + max(a, b)
    patterns = T.number_patterns(a, b)
    named = [n for n in range(10**4, 10**4 + 5001) if any(fnmatch.fnmatchcase(str(n), p) for p in patterns)]
    assert named == list(range(a, b + 1)) and len(patterns) <= 90


def test_ranges_open_only_their_own_shards(spark):
    df = docs(spark, [(i, "word " * (i % 7 * 30)) for i in range(200)]).coalesce(2)
    layout = T.write_shards(df, scratch_path(spark, "shards"), seq_len=50, shard_slots=8, group_shards=4)
    n = layout["sequences"]
    shards = -(-n // 8)
    assert shards > 30
    whole = {r.slot: r.ids_sha256 for r in T.read_shards(spark, layout).collect()}
    assert sorted(whole) == list(range(n))
    for first, last in ((0, 1), (5, 9), (33, 64), (37, 8 * 17 + 3), (8 * 4, 8 * 12), (n - 9, n), (8 * 13, n), (7, 10**9)):
        want = range(first, min(last, n))
        files = spark.read.format("binaryFile").load(T.shard_patterns(layout, first // 8, (want[-1]) // 8)).select("path")
        assert sorted(T._shard(r.path) for r in files.collect()) == list(range(first // 8, want[-1] // 8 + 1))
        assert {r.slot: r.ids_sha256 for r in T.read_shards(spark, layout, first, last).collect()} == {s: whole[s] for s in want}


def test_one_file_a_shard_in_the_order_of_slots(spark):
    df = docs(spark, [(i, "word " * (i % 7 * 30)) for i in range(200)]).coalesce(2)
    layout = T.write_shards(df, scratch_path(spark, "shards"), seq_len=50, shard_slots=8, group_shards=4)
    for r in spark.read.format("binaryFile").load(layout["folder"]).select("path", "content").collect():
        shard, step = T._shard(r.path), layout["stride"]
        assert f"group={T.GROUP_BASE + shard // 4}/" in r.path
        slots = [int(np.frombuffer(r.content[i:i + step - 1], T.HEADER, 1)[0]["slot"]) for i in range(0, len(r.content), step)]
        assert slots == list(range(shard * 8, min(shard * 8 + 8, layout["sequences"])))


def test_empty(spark):
    layout = T.write_shards(docs(spark, []), scratch_path(spark, "shards"))
    assert layout["sequences"] == 0 and T.read_shards(spark, layout).collect() == []
