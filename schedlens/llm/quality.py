"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal.

Features. Words are runs of non-blanks. Every word has a surface and a shape (runs
of lower-case letters, capitals and digits shrunk to one sign, other signs kept; a
word equal to the one before has a shape of its own). Unigrams and bigrams of
surfaces, and uni-, bi- and trigrams of shapes, are hashed into ``2**bits`` weights;
a feature's value is its count over the number of words, so length does not count.

Training. A bounded, documented sample of labelled rows (``max_train_rows`` with the
smallest hash of the id) is dealt to ``shards`` tasks. Each runs follow-the-
regularised-leader updates (per-coordinate rates, L1 and L2) over its rows for
``epochs`` passes; the shards' weights are averaged. The model has 2**bits floats
whatever the input. Scoring is a sparse dot product per document in one narrow pass.

Only the text is scored; id, language, source and labels are never features. A null
text is empty and has the "no words" feature alone. Rows without a label, or with a
null one, are not trained on; a repeated id counts once with its smallest label.
Without any training row every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlens.llm.common import table, text_rows, texts

BITS = 18
MAX_TRAIN_ROWS = 20_000
SHARDS = 8
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
THRESHOLD = 0.3
#: Values are counts over words times this, so that frequent features move quickly.
SCALE = 4.0
#: Distinct words whose hashes a task remembers before it starts afresh.
WORDS_KEPT = 200_000
CHUNK_BYTES = 1 << 20

_RUNS = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"9"),
         (re.compile(rb"([^aA9])\1+"), rb"\1\1")]
_SAME = xxhash.xxh64_intdigest(b"=", 7) >> 1
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shape(word: bytes) -> bytes:
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word[:12]


class Hasher(dict):
    """word -> row of ``hashes`` (surface hash, shape hash), remembered for a while."""

    def __init__(self):
        super().__init__()
        self.fresh: list[tuple[int, int]] = []
        self.hashes = np.empty((0, 2), dtype=np.uint64)

    def __missing__(self, word):
        v = self[word] = len(self)
        self.fresh.append((xxhash.xxh64_intdigest(word, 1) >> 1, xxhash.xxh64_intdigest(shape(word), 2) >> 1))
        return v

    def look_up(self, rows: list[np.ndarray]) -> np.ndarray:
        if self.fresh:
            self.hashes = np.concatenate((self.hashes, np.array(self.fresh, dtype=np.uint64)))
            self.fresh = []
        return self.hashes[np.concatenate(rows)]

    def forget(self):
        if len(self) > WORDS_KEPT:
            self.clear()
            self.hashes = self.hashes[:0]


def features(raw: list[bytes], known: Hasher, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, document) of every n-gram of the texts, and words per document."""
    found, counts = [], np.zeros(len(raw), dtype=np.int64)
    known.forget()
    for i, t in enumerate(raw):
        w = t.split()
        counts[i] = len(w)
        found.append(np.fromiter(map(known.__getitem__, w), dtype=np.int64, count=len(w)))
    shift = np.uint64(64 - bits)
    none = np.flatnonzero(counts == 0)
    feats, docs = [np.zeros(none.size, dtype=np.int64)], [none]
    if counts.any():
        both = known.look_up(found)
        s, c = both[:, 0], both[:, 1]
        doc = np.repeat(np.arange(len(raw)), counts)
        same1 = doc[1:] == doc[:-1]
        c = c.copy()
        c[1:][same1 & (s[1:] == s[:-1])] = _SAME
        same2 = same1[1:] & same1[:-1]
        with np.errstate(over="ignore"):
            grams = [(s * _SALT[0], doc), ((s[:-1] * _SALT[1] + s[1:]) * _SALT[0], doc[1:][same1]),
                     (c * _SALT[2], doc), ((c[:-1] * _SALT[3] + c[1:]) * _SALT[2], doc[1:][same1]),
                     (((c[:-2] * _SALT[3] + c[1:-1]) * _SALT[4] + c[2:]) * _SALT[2], doc[2:][same2])]
        for k, (h, d) in enumerate(grams):
            if k in (1, 3):
                h = h[same1]
            elif k == 4:
                h = h[same2]
            f = (h >> shift).astype(np.int64)
            f[f == 0] = 1  # feature 0 is kept for texts without words
            feats.append(f)
            docs.append(d)
    return np.concatenate(feats), np.concatenate(docs), counts


class Ftrl:
    """FTRL-proximal for logistic loss; the last coordinate is the free intercept."""

    def __init__(self, bits: int):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = at == len(self.z) - 1
        l1, l2 = np.where(free, 0.0, L1), np.where(free, 0.0, L2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _train(bits: int, epochs: int):
    schema = pa.schema([("at", pa.int32()), ("w", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known = [], Hasher()
        for batch in batches:
            for key, label, raw in zip(batch.column("key").to_pylist(), batch.column("label").to_pylist(), text_rows(batch)):
                f, _, n = features([raw], known, bits)
                at, count = np.unique(f, return_counts=True)
                rows.append((key, label, at.astype(np.int32), (SCALE * count / max(1, n[0])).astype(np.float32)))
        if not rows:
            return
        rows.sort(key=lambda r: r[0])
        model, bias = Ftrl(bits), 1 << bits
        for _ in range(epochs):
            for _, y, at, x in rows:
                model.update(np.append(at, bias).astype(np.int64), np.append(x, 1.0).astype(np.float64), y)
        w = model.weights(np.arange(bias + 1))
        at = np.flatnonzero((w != 0) | (np.arange(bias + 1) == bias))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], schema=schema)

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", keep: Column | None = None,
          max_train_rows: int = MAX_TRAIN_ROWS, shards: int = SHARDS, epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray:
    """Weights (2**bits of them and the intercept) fitted on a bounded sample of the
    labelled rows; ``keep`` restricts the labels that may be learnt from."""
    spark = docs.sparkSession
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    if keep is not None:
        lab = lab.filter(keep)
    lab = lab.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    rows = (texts(docs).join(F.broadcast(sample), "doc_id")  # at most max_train_rows rows
            .select(F.xxhash64("doc_id").alias("key"), "label", "text"))
    parts = (rows.repartition(shards, F.pmod("key", F.lit(shards)))
             .mapInArrow(_train(bits, epochs), "at int, w double"))
    got = parts.groupBy("at").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()  # at most 2**bits + 1 rows
    w = np.zeros((1 << bits) + 1)
    for r in got:
        w[r.at] = r.w
    return w / max([1, *(r.n for r in got if r.at == 1 << bits)])  # every shard sends its intercept


def _score(weights, bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = weights.value, Hasher()

        def score(raw):
            f, doc, n = features(raw, known, bits)
            dot = np.bincount(doc, weights=w[f], minlength=len(raw)) * SCALE / np.maximum(n, 1)
            return 1.0 / (1.0 + np.exp(-np.clip(dot + w[-1], -35, 35)))

        for batch in batches:
            out, part, size = [], [], 0
            for t in text_rows(batch):
                part.append(t)
                size += len(t)
                if size >= CHUNK_BYTES:
                    out.append(score(part))
                    part, size = [], 0
            if part:
                out.append(score(part))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out))], schema=schema)

    return run


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; 1 is good."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits floats
    return texts(docs, id_col, text_col).mapInArrow(_score(shared, bits), "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Every fifth row by CRC-32 of the id as text; never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 where score >= 0.3) of every document."""
    weights = train(docs, labels, keep=~held_out(F.col("doc_id")))
    return score(docs, weights).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
