"""Masked pseudo-likelihood with a bidirectional window network.

Corpus statistics. Words of all documents are counted (counted per task, then merged by
one shuffle); the ``vocabulary`` most frequent ones get ids of their own, all others
share ``oov_ids`` ids by hash. Ids are grouped into ``classes`` of about equal
root-frequency; within a class an id has its share of the corpus counts.

Words. With ``per_word`` (the query) an id that words share is only their embedding: each of
them has the id's probability times its own counted share of the id, one count of which is
kept for words never seen. The counts of the most frequent words, at most ``KNOWN`` whatever
the corpus, are sent to the tasks that encode; all other words of the documents are joined
to the whole count table. None of them can be hot: its count is below that of every word
that was sent.

Tasks split and number the words of many texts at a time in Arrow; only distinct words are
looked up.

Network. Every token is predicted from the ``window`` tokens on both sides, never from
itself: position-specific embeddings of the neighbours are added, squashed, and give a
softmax over classes; P(token | both sides) = P(class | both sides) * P(token | class).
With ``inner`` (the query) the last factor is a second softmax, from the same hidden layer
over the ids of the class, trained in the same steps; it starts at the corpus shares, which
it stays at without ``inner``.
A document's score is the sum of its tokens' conditional log-probabilities: of words with
``per_word``, of ids without it.

Training covers all documents once, in ``rounds`` parts. In a round every partition runs
minibatch gradient steps in numpy from the shared weights; the weights are averaged by
tokens seen, in two merging steps over blocks of the weight vector. So what is gathered
(counts and one weight vector a partition) grows with the corpus, while a task and the
driver hold one model. The encoded corpus is stored once and read by every round.

Defined results. Words are runs of non-blanks, compared as they are. Null and empty texts have
no tokens: log_prob 0, mean and perplexity null. Null ids and repeated rows pass through.
Without any word there is no model and only such rows; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlens.llm.common import BATCH_BYTES, stage, table, text_rows, texts

VOCABULARY, OOV_IDS, CLASSES = 7_168, 1_023, 64
WINDOW, WIDTH, ROUNDS = 2, 16, 2
RATE, OUT_RATE, BATCH = 0.05, 1.0, 4_096
#: Scores of a class that may lie this far below the best possible one are shifted row by row.
FAR = 40.0
#: Most words whose counts are sent to the tasks, bytes of text whose words are numbered at
#: a time, and weights in one block.
KNOWN, PIECE, WEIGHT_BLOCK = 1 << 18, 2 * BATCH_BYTES, 1 << 16


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``PIECE`` bytes of text."""
    size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // PIECE)) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the numbers of all their words one after the other,
    and how many words each text has. Blanks around a text leave an empty word, which none
    of the numbers stands for."""
    lists = pc.ascii_split_whitespace(text)
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        held = at != empty
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=held, minlength=len(sizes)).astype(np.int64)
        at = at[held]
    return words.cast(pa.binary()), at, sizes


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    for batch in batches:
        for piece in _pieces(batch):
            words, at, _ = _words(piece.column("text"))
            n = np.bincount(at, minlength=len(words))
            yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], schema=schema).filter(pa.array(n > 0))


class Ids(dict):
    """word -> id; words outside the vocabulary are hashed and not remembered."""

    def __init__(self, words: list[bytes], oov_ids: int):
        super().__init__((w, i) for i, w in enumerate(words))
        self.first, self.oov_ids = len(words), oov_ids

    def __missing__(self, word):
        return self.first + xxhash.xxh64_intdigest(word) % self.oov_ids


def _order(ids: np.ndarray) -> np.ndarray:
    """Stable order of ids, which fit into 16 bits: numpy sorts these by their digits."""
    return np.argsort(ids.astype(np.uint16), kind="stable")


def _in_range(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``w`` (rows, the last column their levels) with the levels of each class lowered by its
    best possible score, and the classes whose scores may all be far below that. The hidden
    values they are multiplied with lie between -1 and 1."""
    spread = np.abs(w) @ np.array([1] * (w.shape[1] - 1) + [0], dtype=w.dtype)
    top = np.maximum.reduceat(w[:, -1] + spread, first[:-1])
    far = top - np.maximum.reduceat(w[:, -1] - spread, first[:-1]) > FAR
    w[:, -1] -= np.repeat(top, np.diff(first))
    return w, far


def _scores(h: np.ndarray, w: np.ndarray, far: bool, out: np.ndarray | None = None) -> np.ndarray:
    """Scores of every row of ``h``, less a number that keeps their exponentials in range."""
    z = np.matmul(h, w.T, out=out)
    if far:
        z -= z.max(1, keepdims=True)
    return z


def _exp_sums(z: np.ndarray) -> np.ndarray:
    """Puts exponentials in place of the scores and adds them up."""
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], dtype=z.dtype)


class Model:
    """All weights of the network in one float32 vector, and the corpus shares."""

    def __init__(self, counts: np.ndarray, classes: int = CLASSES, window: int = WINDOW, width: int = WIDTH, seed: int = 0,
                 inner: bool = False):
        self.window, self.width, self.size, self.inner = window, width, len(counts), inner
        root = np.sqrt(np.maximum(counts, 1.0))
        order = np.argsort(-root, kind="stable")
        at = np.cumsum(root[order]) - root[order] / 2
        self.klass = np.empty(self.size, dtype=np.int64)
        self.klass[order] = np.minimum(classes - 1, (at / root.sum() * classes).astype(np.int64))
        self.klass = np.unique(self.klass, return_inverse=True)[1]
        self.classes = int(self.klass.max()) + 1
        held = np.maximum(counts, 1.0)
        share = np.bincount(self.klass, weights=held, minlength=self.classes)
        self.within = np.log(held / share[self.klass])
        self.counts = counts
        rng = np.random.default_rng(seed)
        # a row past the end stands for what lies outside the text
        self.shapes = [(2 * window, self.size + 1, width), (width,), (width, self.classes), (self.classes,)]
        parts = [rng.normal(scale=0.1, size=s) for s in self.shapes]
        parts[3] = np.log(share / share.sum())
        if inner:  # rows of the second softmax: the ids class by class
            members = np.argsort(self.klass, kind="stable")
            self.first = np.searchsorted(self.klass[members], np.arange(self.classes + 1))
            self.row = np.empty(self.size, dtype=np.int64)
            self.row[members] = np.arange(self.size)
            self.shapes += [(self.size, width), (self.size,)]
            parts += [np.zeros((self.size, width)), self.within[members]]
        self.weights = np.concatenate([p.ravel() for p in parts]).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes:
            n = int(np.prod(s))
            out.append(self.weights[at:at + n].reshape(s))
            at += n
        return out

    def padded(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Texts in one array, ``window`` outside signs around each; positions of the tokens."""
        pad = np.full(self.window, self.size)
        flat = np.concatenate([pad, *[x for d in docs for x in (d, pad)]]).astype(np.int64)
        return flat, np.flatnonzero(flat != self.size)

    def _neighbours(self) -> list[int]:
        return [*range(-self.window, 0), *range(1, self.window + 1)]

    def hidden(self, near: list[np.ndarray], parts) -> np.ndarray:
        """The hidden layer, and a last column of ones that takes the levels of the scores along."""
        x = np.broadcast_to(parts[1], (len(near[0]), self.width)).copy()
        for j, ids in enumerate(near):
            x += parts[0][j].take(ids, axis=0)
        h = np.ones((len(x), self.width + 1), dtype=np.float32)
        h[:, :-1] = np.tanh(x, out=x)
        return h

    def _softmaxes(self, parts):
        """Rows and levels of both softmaxes, in range."""
        classes = _in_range(np.column_stack((parts[2].T, parts[3])), np.array([0, self.classes]))
        return classes, _in_range(np.column_stack(parts[4:6]), self.first) if self.inner else None

    def _by_class(self, of: np.ndarray):
        """Class by class, for tokens ordered by class: the class, which tokens are its own (at most
        ``BATCH`` a time), its rows of the second softmax."""
        cut, first = np.searchsorted(of, np.arange(self.classes + 1)).tolist(), self.first.tolist()
        for c in range(self.classes):
            for lo in range(cut[c], cut[c + 1], BATCH):
                yield c, slice(lo, min(lo + BATCH, cut[c + 1])), slice(first[c], first[c + 1])

    def log_probs(self, flat: np.ndarray, at: np.ndarray, parts=None) -> np.ndarray:
        parts = parts or self.parts()
        order = _order(self.klass[flat[at]])
        at = at[order]
        token = flat[at]
        of, h = self.klass[token], self.hidden([flat[at + d] for d in self._neighbours()], parts)
        (w, far), inner = self._softmaxes(parts)
        lp, total = np.empty(len(at)), np.empty(len(at))
        for lo in range(0, len(at), BATCH):
            here = slice(lo, lo + BATCH)
            z = _scores(h[here], w, far[0])
            lp[here] = z[np.arange(len(z)), of[here]]
            total[here] = _exp_sums(z)
        if self.inner:
            (w, far), hit = inner, self.row[token] - self.first[of]
            for c, here, members in self._by_class(of):
                g = _scores(h[here], w[members], far[c])
                lp[here] += g[np.arange(len(g)), hit[here]]
                total[here] *= _exp_sums(g)
        else:
            lp += self.within[token]
        out = np.empty(len(at))
        out[order] = lp - np.log(total)
        return out

    def step(self, flat: np.ndarray, at: np.ndarray, rate: float = RATE) -> None:
        """Moves the weights against the gradient, for at most ``BATCH`` tokens. The gradient of a
        softmax's scores is the softmax less one at the token; here it stays multiplied with
        the sum of the exponentials, and what it is multiplied with is divided by that."""
        parts = self.parts()
        emb, bias, out, prior = parts[:4]
        at = at[_order(self.klass[flat[at]])]
        token, near = flat[at], [flat[at + d] for d in self._neighbours()]
        of, h = self.klass[token], self.hidden(near, parts)
        (w, far), inner = self._softmaxes(parts)
        scale, mean = np.float32(rate), np.float32(OUT_RATE / len(at))
        z = _scores(h, w, far[0])
        total = _exp_sums(z)
        z[np.arange(len(at)), of] -= total
        total = total[:, None]
        back = (z @ out.T) / total
        moved = mean * ((h / total).T @ z)
        if self.inner:
            w, far = inner
            (own, level), size = parts[4:6], np.diff(self.first)[of]
            begin = np.cumsum(size) - size
            g, at_class = np.empty(size.sum(), dtype=np.float32), []  # the scores of all tokens, one after the other
            for c, here, members in self._by_class(of):
                n, m = here.stop - here.start, members.stop - members.start
                view = g[begin[here.start]:begin[here.start] + n * m].reshape(n, m)
                at_class.append((here, members, view))
                _scores(h[here], w[members], far[c], view)
            total = np.add.reduceat(np.exp(g, out=g), begin)
            g[begin + self.row[token] - self.first[of]] -= total
            total = total[:, None]
            shares, more, grown = h / total, np.empty_like(back), np.zeros_like(w)
            for here, members, view in at_class:
                np.matmul(view, own[members], out=more[here])
                np.matmul(view.T, shares[here], out=grown[members])
            back += more / total
            held = np.bincount(of, minlength=self.classes)  # as for the embeddings
            grown *= np.repeat(scale / np.sqrt(np.maximum(held, 1)), np.diff(self.first)).astype(np.float32)[:, None]
            own -= grown[:, :-1]
            level -= grown[:, -1]
        out -= moved[:-1]
        prior -= moved[-1]
        back *= 1 - h[:, :-1] ** 2
        bias -= mean * back.sum(0)
        back, column = back.astype(np.float64).ravel(), np.arange(self.width)
        cell, nth = np.empty((len(at), self.width), dtype=np.int64), np.empty(self.size + 1, dtype=np.int64)
        for j, ids in enumerate(near):
            n = np.bincount(ids, minlength=self.size + 1)
            held = np.flatnonzero(n > 0)
            nth[held] = np.arange(len(held)) * self.width
            np.add(nth.take(ids)[:, None], column, out=cell)
            g = np.bincount(cell.ravel(), weights=back).reshape(-1, self.width)
            g *= (scale / np.sqrt(n[held]))[:, None]  # frequent words move by less a time
            emb[j][held] -= g.astype(np.float32)


ENCODED_DDL = "doc_id long, n long, part int, ids binary, row long, gain double, rare array<binary>"


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value a row, from the bytes of ``sizes`` values each."""
    ends = np.concatenate([[0], np.cumsum(sizes) * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])


def _encode(shared):
    """Ids of every text, a number for its row, the logarithms of the counts of its words that
    share ids but are among those sent, added up, and its words that were not sent."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("ids", pa.binary()),
                        ("row", pa.int64()), ("gain", pa.float64()), ("rare", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, known_ids, known_gains, ids = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in _pieces(batch):
                words, at, sizes = _words(piece.column("text"))
                found = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()
                other = found < 0
                own, gains = known_ids[found], known_gains[found]
                own[other] = [ids[w] for w in words.filter(pa.array(other)).to_pylist()]
                of = np.repeat(np.arange(len(sizes)), sizes)
                rare = np.flatnonzero(other[at])
                ends = np.concatenate([[0], np.cumsum(np.bincount(of[rare], minlength=len(sizes)))])
                part = [xxhash.xxh64_intdigest(raw) & 0xFFFF for raw in text_rows(piece)]
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(part, pa.int32()), _lists(own[at], sizes),
                    pa.array(np.arange(row, row + len(sizes)), pa.int64()), pa.array(np.bincount(of, weights=gains[at], minlength=len(sizes))),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(at[rare])))], schema=schema)
                row += len(sizes)

    return run


def _id_counts(words):
    """Counts of the ids from those of the words."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(*words.value)
        total = np.zeros(ids.first + ids.oov_ids, dtype=np.int64)
        for batch in batches:
            at = np.fromiter(map(ids.__getitem__, batch.column("word").to_pylist()), dtype=np.int64, count=batch.num_rows)
            np.add.at(total, at, batch.column("n").to_numpy())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], schema=schema)

    return run


def _chunks(docs: Iterator[np.ndarray], tokens: int) -> Iterator[list[np.ndarray]]:
    part, size = [], 0
    for d in docs:
        part.append(d)
        size += len(d)
        if size >= tokens:
            yield part
            part, size = [], 0
    if part:
        yield part


def _read(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for x in batch.column("ids"):
        yield np.frombuffer(x.as_buffer(), dtype="<u2")


PARTIAL = pa.schema([("block", pa.int32()), ("task", pa.int32()), ("n", pa.int64()), ("weights", pa.binary())])
PARTIAL_DDL = "block int, task int, n long, weights binary"


def _train(shared):
    """Gradient steps over a partition; its weights leave in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model: Model = copy(shared.value)  # a worker keeps the broadcast one for its next tasks
        model.weights = model.weights.copy()
        seen = 0
        for batch in batches:
            for docs in _chunks(_read(batch), 1 << 17):
                flat, at = model.padded(docs)
                at = np.random.default_rng(len(at)).permutation(at)
                for i in range(0, len(at), BATCH):
                    model.step(flat, at[i:i + BATCH])
                seen += len(at)
        if seen:
            for i in range(0, len(model.weights), WEIGHT_BLOCK):
                w = model.weights[i:i + WEIGHT_BLOCK].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([i // WEIGHT_BLOCK], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()),
                                                  pa.array([seen], pa.int64()), pa.array([w], pa.binary())], schema=PARTIAL)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token-weighted mean of each block's weights; one row per block."""
    total: dict[int, list] = {}
    for batch in batches:
        for block, n, w in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), batch.column("weights")):
            t = total.setdefault(block, [0, 0.0])
            t[0] += n
            t[1] = t[1] + n * np.frombuffer(w.as_buffer(), dtype=np.float32).astype(np.float64)
    for block, (n, w) in sorted(total.items()):
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([n], pa.int64()),
                                          pa.array([(w / n).astype(np.float32).tobytes()], pa.binary())], schema=PARTIAL)


def corpus_counts(docs: DataFrame, vocabulary: int = VOCABULARY, oov_ids: int = OOV_IDS) -> tuple[DataFrame, list[bytes], np.ndarray]:
    """The counts of all words, the most frequent of them, and the counts of all ids."""
    counted = stage(docs.select("text").mapInArrow(_count_words, "word binary, n long")
                    .groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    top = counted.orderBy(F.desc("n"), "word").limit(vocabulary).collect()  # at most ``vocabulary`` rows
    words = [bytes(r.word) for r in top]
    shared = docs.sparkSession.sparkContext.broadcast((words, oov_ids))
    held = counted.mapInArrow(_id_counts(shared), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the ids
    counts = np.zeros(len(words) + oov_ids)
    for r in held:
        counts[r.id] = r.n
    return counted, words, counts


def known_words(counted: DataFrame, words: list[bytes], oov_ids: int) -> tuple[pa.Array, np.ndarray, np.ndarray, Ids]:
    """What the tasks that encode are sent: the vocabulary and the next frequent words, at most
    ``KNOWN``, their ids, the logarithms of the counts of those that share ids, each with a last
    value for words not sent, and those words' ids. Words of like count are sent together or
    not at all."""
    level = F.floor(F.log2("n") * 8)
    total, lowest = 0, None
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 8 * 64 rows
        total += r["count"]
        if total > KNOWN:
            break
        lowest = r.level
    ids = Ids(words, oov_ids)
    more, n = [], []
    if lowest is not None:
        sent = counted.filter(level >= lowest).toArrow()  # at most ``KNOWN`` rows
        for w, x in zip(sent.column("word").to_pylist(), sent.column("n").to_pylist()):
            if w not in ids:
                more.append(w)
                n.append(x)
    own = np.array([*range(len(words)), *(ids[w] for w in more), 0], dtype="<u2")
    return pa.array([*words, *more], pa.binary()), own, np.log(np.concatenate([np.ones(len(words)), n, [1]])), ids


def train(encoded: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    spark = encoded.sparkSession
    for r in range(rounds):
        rows = encoded.filter((F.col("n") > 0) & (F.col("part") % rounds == r)).select("ids")
        fan = int(rows.rdd.getNumPartitions() ** 0.5) + 1
        parts = rows.mapInArrow(_train(spark.sparkContext.broadcast(model)), PARTIAL_DDL)
        merged = parts.repartition("block", F.col("task") % fan).mapInArrow(_merge, PARTIAL_DDL)
        blocks = merged.repartition("block").mapInArrow(_merge, PARTIAL_DDL).orderBy("block").collect()  # one model
        if blocks:
            model.weights = np.concatenate([np.frombuffer(b.weights, dtype=np.float32) for b in blocks])
    return model


SCORED_DDL = "doc_id long, n_tokens long, log_prob double, row long"


def _score(shared, offsets=None):
    """Sums of the conditionals; with ``offsets`` (by id) these are added to those of the tokens,
    and what the words whose counts were sent gain."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        parts = model.parts()
        for batch in batches:
            sums = []
            for docs in _chunks(_read(batch), 1 << 16):
                flat, at = model.padded(docs)
                lp = model.log_probs(flat, at, parts)
                if offsets is not None:
                    lp = lp + offsets[flat[at]]
                lens = np.array([len(d) for d in docs])
                sums.append(np.bincount(np.repeat(np.arange(len(docs)), lens), weights=lp, minlength=len(docs)))
            if sums:
                total = np.concatenate(sums)
                if offsets is not None:
                    total += batch.column("gain").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), pa.array(total),
                                                  batch.column("row")], schema=schema)

    return run


def _fit(docs: DataFrame, id_col: str, text_col: str, vocabulary: int, oov_ids: int, rounds: int,
         inner: bool = False) -> tuple[DataFrame, Model, DataFrame]:
    if vocabulary + oov_ids >= 1 << 16:
        raise ValueError("ids are stored in 16 bits")
    rows = texts(docs, id_col, text_col)
    counted, words, counts = corpus_counts(rows, vocabulary, oov_ids)
    shared = rows.sparkSession.sparkContext.broadcast(known_words(counted, words, oov_ids))
    encoded = stage(rows.mapInArrow(_encode(shared), ENCODED_DDL), "encoded")
    return encoded, train(encoded, Model(counts, inner=inner), rounds), counted


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY,
        oov_ids: int = OOV_IDS, rounds: int = ROUNDS) -> tuple[DataFrame, Model]:
    """The stored encoded documents and the network trained on all of them."""
    return _fit(docs, id_col, text_col, vocabulary, oov_ids, rounds)[:2]


def word_shares(encoded: DataFrame, counted: DataFrame) -> DataFrame:
    """row, gain: the logarithms of the counts of its words whose counts were not sent, added
    up. Words counted once add nothing and need no partner."""
    rare = encoded.select("row", F.explode("rare").alias("word"))
    return rare.join(counted.filter("n > 1"), "word").groupBy("row").agg(F.sum(F.log("n")).alias("gain"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY,
                    oov_ids: int = OOV_IDS, rounds: int = ROUNDS, per_word: bool = False,
                    inner: bool = False) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over tokens), mean_log_prob and perplexity; of the
    words with ``per_word``, else of the ids."""
    encoded, model, counted = _fit(docs, id_col, text_col, vocabulary, oov_ids, rounds, inner)
    offsets = None
    if per_word:
        offsets = -np.log(model.counts + 1)
        offsets[:model.size - oov_ids] = 0.0
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    scored = encoded.select("doc_id", "n", "ids", "row", "gain").mapInArrow(_score(shared, offsets), SCORED_DDL)
    if per_word:
        scored = scored.join(word_shares(encoded, counted), "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("gain", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), per_word=True, inner=True)
