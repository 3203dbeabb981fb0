"""Exact deduplication with Patricia-trie owners.

Method. Each scan task first inserts its own normalised texts into a compressed
radix trie, so that a text which occurs many times in one partition leaves it once
(hot groups are pre-aggregated before the shuffle). The distinct texts then go, by
(byte length, content hash), to *owner* tasks. An owner inserts the full byte
strings into its trie; a terminal node keeps the smallest identifier and the number
of documents. Equality is therefore decided on whole byte strings; hashes only route.

Bounded memory: when a trie outgrows its budget the largest subtree is *spilled*:
its strings (and every later string that falls below it) leave as rows of the
stage table, and the next round gives them to four times as many owners.

Defined results. A null text is the empty text. Texts are equal when identical
after every run of blanks (space, \\t, \\n, \\v, \\f, \\r) became one space; nothing is
trimmed. A null id loses against every other id; of repeated rows with the same
smallest id exactly one is kept. An empty table gives an empty result. Only the id
and text columns are read, so clashing extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlens.llm.common import batched, stage, table, text_rows, texts

#: Bytes of text and nodes that one trie may hold before it spills or flushes.
TRIE_BYTES = 96 << 20
NODE_BYTES = 240
NO_ID = (1 << 63) - 1
_BLANK = b" \t\n\x0b\x0c\r"
_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalise(raw: bytes) -> bytes:
    """Every run of blanks becomes one space."""
    s = raw.translate(_TO_SPACE)
    if b"  " not in s:
        return s
    body = b" ".join(s.split())
    if not body:
        return b" "
    return (b" " if s[0] == 32 else b"") + body + (b" " if s[-1] == 32 else b"")


class Node:
    """The edge label is text[start:end]; slices of the inserted strings are shared."""
    __slots__ = ("text", "start", "end", "children", "payload", "spilled")

    def __init__(self, text: bytes, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self.children: dict[int, Node] = {}
        self.payload: list | None = None
        self.spilled = False


def _common(a: bytes, i: int, b: bytes, j: int, n: int) -> int:
    """Length of the common prefix of a[i:i+n] and b[j:j+n]."""
    lo, step = 0, 32
    while lo < n:
        m = min(step, n - lo)
        if a[i + lo:i + lo + m] == b[j + lo:j + lo + m]:
            lo += m
            step *= 4
        elif m == 1:
            break
        else:
            step = max(1, m // 2)
            n = lo + m
    return lo


class RadixTrie:
    """Compressed radix trie over byte strings; ``size`` estimates its bytes and
    ``strings`` counts its terminals."""

    def __init__(self):
        self.root = Node(b"", 0, 0)
        self.size = self.strings = 0

    def insert(self, s: bytes) -> list | None:
        """The (mutable) payload of s, empty when s is new; None below a spilled node."""
        node, pos, n = self.root, 0, len(s)
        while True:
            if node.spilled:
                return None
            if pos == n:
                break
            child = node.children.get(s[pos])
            if child is None:
                child = node.children[s[pos]] = Node(s, pos, n)
                self.size += n - pos + NODE_BYTES
                node = child
                break
            m = child.end - child.start
            k = _common(s, pos, child.text, child.start, min(m, n - pos))
            if k < m:  # split the edge
                mid = Node(child.text, child.start, child.start + k)
                mid.children[child.text[child.start + k]] = child
                child.start += k
                node.children[s[pos]] = mid
                self.size += NODE_BYTES
                child = mid
            node, pos = child, pos + k
        if node.payload is None:
            node.payload = []
            self.strings += 1
        return node.payload

    def terminals(self, top: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """(string, payload) of every terminal at or below ``top``."""
        todo = [(top or self.root, prefix)]
        while todo:
            node, above = todo.pop()
            here = above + node.text[node.start:node.end]
            if node.payload:
                yield here, node.payload
            todo.extend((c, here) for c in node.children.values())

    def _weight(self, node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            x = todo.pop()
            total += x.end - x.start + NODE_BYTES
            todo.extend(x.children.values())
        return total

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Cut off the largest subtree at the first branching node and yield its terminals."""
        node, prefix = self.root, b""
        while len(node.children) == 1 and node.payload is None:
            node, prefix = next(iter(node.children.values())), prefix + node.text[node.start:node.end]
        if node.children:
            top = max(node.children.values(), key=self._weight)
            prefix += node.text[node.start:node.end]
        else:
            top = node
        found = list(self.terminals(top, prefix))
        self.size -= self._weight(top)
        self.strings -= len(found)
        top.children, top.payload, top.spilled = {}, None, True
        return iter(found)


LOCAL = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("rep_key", pa.int64()),
                   ("n", pa.int64()), ("min_id", pa.int64()), ("min_row", pa.int64()), ("text", pa.binary())])
LOCAL_DDL = "doc_id long, row_key long, rep_key long, n long, min_id long, min_row long, text binary"
OWNED = pa.schema([("rep_key", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()),
                   ("group_size", pa.int64()), ("text_sha256", pa.string()), ("n", pa.int64()),
                   ("min_id", pa.int64()), ("min_row", pa.int64()), ("text", pa.binary())])
OWNED_DDL = ("rep_key long, keep_id long, keep_row long, group_size long, text_sha256 string, "
             "n long, min_id long, min_row long, text binary")


def _local(budget: int):
    """Scan side: one row per document (its representative's key) and one row per
    distinct text of the partition (count, smallest id, the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def rows():
            key = TaskContext.get().partitionId() << 33
            trie = RadixTrie()

            def flush():
                for s, (n, low, low_row, rep) in trie.terminals():
                    yield (None, None, rep, n, low, low_row, s), len(s)

            for batch in batches:
                for doc, raw in zip(batch.column("doc_id").to_pylist(), text_rows(batch)):
                    payload = trie.insert(normalise(raw))
                    rank = NO_ID if doc is None else doc
                    if not payload:
                        payload[:] = [0, rank, key, key]
                    payload[0] += 1
                    if rank < payload[1]:
                        payload[1:3] = [rank, key]
                    yield (doc, key, payload[3], None, None, None, None), 0
                    key += 1
                    if trie.size > budget:
                        yield from flush()
                        trie = RadixTrie()
            yield from flush()

        yield from batched(rows(), LOCAL)

    return run


def _owner(budget: int):
    """Owner side: resolves every representative, or hands it to the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def later(s, reps):
            for rep, n, low, low_row in reps:
                yield (rep, None, None, None, None, n, low, low_row, s), len(s)

        def rows():
            trie = RadixTrie()
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("rep_key", "n", "min_id", "min_row")]
                for s, *rep in zip((x.as_py() for x in batch.column("text")), *cols):
                    payload = trie.insert(s)
                    if payload is None:
                        yield from later(s, [rep])
                        continue
                    payload.append(rep)
                    while trie.size > budget and trie.strings > 1:  # one string must fit
                        for t, reps in trie.spill():
                            yield from later(t, reps)
            for s, reps in trie.terminals():
                low, low_row = min((r[2], r[3]) for r in reps)
                total, sha = sum(r[1] for r in reps), hashlib.sha256(s).hexdigest()
                for r in reps:
                    yield (r[0], low, low_row, total, sha, None, None, None, None), 100

        yield from batched(rows(), OWNED)

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    local = stage(texts(docs, id_col, text_col).mapInArrow(_local(trie_bytes), LOCAL_DDL), "dedup-local")
    members = local.filter("n is null").select("doc_id", "row_key", "rep_key")
    pending = local.filter("n is not null").select("rep_key", "n", "min_id", "min_row", "text")
    owners, level, owned = int(spark.conf.get("spark.sql.shuffle.partitions")), 0, None
    while True:
        out = stage(pending.repartition(owners, F.octet_length("text"), F.xxhash64("text", F.lit(level)))
                    .mapInArrow(_owner(trie_bytes), OWNED_DDL), "dedup-owned")
        done = out.filter("n is null").select("rep_key", "keep_id", "keep_row", "group_size", "text_sha256")
        owned = done if owned is None else owned.unionByName(done)
        pending = out.filter("n is not null").select("rep_key", "n", "min_id", "min_row", "text")
        if pending.limit(1).count() == 0:
            break
        owners, level = owners * 4, level + 1
    return members.join(owned, "rep_key").select(
        "doc_id", F.when(F.col("keep_id") != F.lit(NO_ID), F.col("keep_id")).alias("keep_id"),
        "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
