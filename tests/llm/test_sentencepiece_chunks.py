import hashlib

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from schedlens.llm import sentencepiece_chunks as C

from .helpers import awkward, clashing, docs, sample

MODEL = sentencepiece.SentencePieceProcessor(model_file=C.model_path())
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(pairs):
    out = []
    for d, t in pairs:
        ids = MODEL.encode(t or "")
        out.append((d, len(ids), SHA(",".join(map(str, ids))), SHA(MODEL.decode(ids))))
    return sorted(out, key=repr)


def test_documents_match_the_library(spark):
    pairs = awkward() + sample()
    cols = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    for table_bytes in (C.TABLE_BYTES, 2_000):
        df = C.encode_decode(clashing(docs(spark, pairs)), columns=cols, table_bytes=table_bytes)
        assert sorted([tuple(r) for r in df.collect()], key=repr) == brute(pairs)


def test_ids_and_text(spark):
    pairs = awkward()
    got = {(r.doc_id, r.decoded): r.ids for r in C.encode_decode(docs(spark, pairs)).collect()}
    for d, t in pairs:
        ids = MODEL.encode(t or "")
        assert got[(d, MODEL.decode(ids))] == ids
    assert C.encode_decode(docs(spark, [])).collect() == []


TABLE = C.ChunkTable(C.model_path(), lambda chunk, ids: (ids, TABLE.model.decode(ids)))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" ab▁\n\té<s>/0é　\U0001f600x"), max_size=20) | st.text(max_size=20))
def test_chunks_join_to_the_library_result(text):
    text = text.encode("utf-8", "ignore").decode()
    parts = TABLE.chunks(text) if text else []
    TABLE.learn(parts)
    ids = [i for c in parts for i in TABLE[c][0]]
    assert ids == MODEL.encode(text)
    assert " ".join(TABLE[c][1] for c in parts) == MODEL.decode(ids)
