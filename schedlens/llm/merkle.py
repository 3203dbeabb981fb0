"""Merkle manifest of a dataset as a persistent, path-copying tree.

Method. Every document is a leaf. The leaves of a source, in id order, are dealt into
*aligned blocks* of ``arity ** block_levels`` consecutive leaves, so a block is exactly
one subtree. A task builds the subtree of a block once. A changed leaf makes a new
version: it copies the ancestors of that leaf inside the block and shares every other
node. What the version needs from above is the block's path: block roots are the leaves
of the next tier, which is cut into aligned blocks and built in the same way, until one
node a source is left; the source roots are one more such tree. The paths of a tier are
joined to the tier below (one row a block), and every version continues upwards along
the path of its block, again copying only ancestors.

Work is spread by block, never by source: a source with a third of all rows is many
blocks. Positions come from a range partitioning and per-partition counts, so no task
sees a source whole. The driver holds the number of nodes of the largest tree and the root.

Defined results. A null field is ``-`` in a leaf's input, so it differs from the empty
string; an empty or very long text is hashed like any other. Documents without an id come
first in their source and are never tampered with. Rows with equal source and id are
ordered by leaf digest; rows equal in every field are interchangeable and take any of
their tied places. Documents without a source are a source of their own, the first. An
empty table gives an empty result. Only the named columns are read, so clashing extra
columns do not matter.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schedlens.llm.common import batched, ship_package, stage, table

ARITY = 3
BLOCK_LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class BlockTree:
    """All levels of one aligned block, never changed after building. ``height`` levels
    are built, or as many as it takes to reach one node when it is None."""

    def __init__(self, leaves: list[str], arity: int, height: int | None = None):
        self.arity, self.levels = arity, [leaves]
        while len(self.levels) <= height if height is not None else len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([digest(below[i:i + arity]) for i in range(0, len(below), arity)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, i: int) -> list[tuple[str, str]]:
        """For every level below the root, the digests left and right of the path of leaf i."""
        out = []
        for level in self.levels[:-1]:
            first = i - i % self.arity
            out.append(("".join(level[first:i]), "".join(level[i + 1:first + self.arity])))
            i //= self.arity
        return out

    def version(self, i: int, leaf: str) -> list[str]:
        """The nodes of the version whose leaf i is ``leaf``: that leaf and the copies of its
        ancestors, the root last. All other nodes are shared with this tree."""
        copied = [leaf]
        for level in self.levels[:-1]:
            first = i - i % self.arity
            copied.append(digest([*level[first:i], copied[-1], *level[i + 1:first + self.arity]]))
            i //= self.arity
        return copied


LEAVES = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("block", pa.int64()), ("pos", pa.int64()),
                    ("size", pa.int64()), ("leaf", pa.binary()), ("siblings", pa.binary()), ("copied", pa.binary()),
                    ("top", pa.binary()), ("new_top", pa.binary())])
LEAVES_DDL = ("doc_id long, key string, block long, pos long, size long, leaf binary, siblings binary, "
              "copied binary, top binary, new_top binary")
NODES = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("before", pa.list_(pa.string())),
                   ("after", pa.list_(pa.string())), ("top", pa.string())])
NODES_DDL = "key string, pos long, size long, before array<string>, after array<string>, top string"


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """(key, block), rows of every block of a stream sorted by key, block and pos."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns)))
    return itertools.groupby(rows, key=lambda r: r[:2])


def _height(size: int, arity: int, levels: int) -> int | None:
    return levels if size > arity ** levels else None


def _leaf_blocks(arity: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (key, block), group in _blocks(batches, ["key", "block", "pos", "size", "doc_id", "leaf", "changed"]):
                group = list(group)
                tree = BlockTree([r[5].hex() for r in group], arity, _height(group[0][3], arity, levels))
                top = bytes.fromhex(tree.root)
                for i, (_, _, pos, size, doc, leaf, changed) in enumerate(group):
                    beside = bytes.fromhex("".join(a + b for a, b in tree.siblings(i)))
                    copied = tree.version(i, (leaf if changed is None else changed).hex())
                    own = None if changed is None else bytes.fromhex("".join(copied))
                    yield (doc, key, block, pos, size, leaf, beside, own, top, bytes.fromhex(copied[-1])), 64 * len(copied) + 200

        yield from batched(rows(), LEAVES)

    return run


def _node_blocks(arity: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (key, _), group in _blocks(batches, ["key", "block", "pos", "size", "digest"]):
                group = list(group)
                tree = BlockTree([r[4] for r in group], arity, _height(group[0][3], arity, levels))
                for i, (_, _, pos, size, _) in enumerate(group):
                    before, after = zip(*path) if (path := tree.siblings(i)) else ((), ())
                    yield (key, pos, size, list(before), list(after), tree.root), 1000

        yield from batched(rows(), NODES)

    return run


def _by_block(nodes: DataFrame, span: int) -> DataFrame:
    return (nodes.withColumn("block", F.floor(F.col("pos") / F.lit(span)).cast("long"))
            .repartition("key", "block").sortWithinPartitions("key", "block", "pos"))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos (from 0, in the order given) and size, both within ``key``."""
    placed = stage(rows.withColumn("tie", F.monotonically_increasing_id())
                   .repartitionByRange("key", *order, "tie").sortWithinPartitions("key", *order, "tie")
                   .drop("tie").withColumn("at", F.monotonically_increasing_id()), "merkle-placed")
    runs = (placed.groupBy("key", F.shiftright("at", 33).alias("part"))
            .agg(F.min("at").alias("first"), F.count("*").alias("n")))
    whole = Window.partitionBy("key")
    so_far = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "part", (F.coalesce(F.sum("n").over(so_far), F.lit(0)) - F.col("first")).alias("shift"),
                       F.sum("n").over(whole).alias("size"))
    return (placed.withColumn("part", F.shiftright("at", 33)).join(runs, ["key", "part"])
            .withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift"))


def _climb(nodes: DataFrame, arity: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """(key, pos, size, digest) -> the paths of these nodes to the root of their key
    (key, pos, before, after) and the roots (key, digest)."""
    span, tiers = arity ** levels, []
    while (nodes.agg(F.max("size")).first()[0] or 0) > 1:
        tiers.append(stage(_by_block(nodes, span).mapInArrow(_node_blocks(arity, levels), NODES_DDL), "merkle-tier"))
        nodes = tiers[-1].filter(F.col("pos") % span == 0).select(
            "key", (F.col("pos") / span).cast("long").alias("pos"),
            F.ceil(F.col("size") / span).alias("size"), F.col("top").alias("digest"))
    none = F.array().cast("array<string>")
    paths = nodes.select("key", "pos", none.alias("before"), none.alias("after"))
    for tier in reversed(tiers):
        above = paths.select(F.col("key").alias("key2"), F.col("pos").alias("pos2"),
                             F.col("before").alias("before2"), F.col("after").alias("after2"))
        paths = tier.join(above, (F.col("key") == F.col("key2"))
                          & (F.floor(F.col("pos") / F.lit(span)).cast("long") == F.col("pos2"))).select(
            "key", "pos", F.concat("before", "before2").alias("before"), F.concat("after", "after2").alias("after"))
    return paths, nodes.select("key", "digest")


def field(c: Column) -> Column:
    """A value with its length, so that no two rows have the same input."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def merkle_manifest(docs: DataFrame, tampered_text: Column | None = None, arity: int = ARITY,
                    block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per document: doc_id, source, pos (place in its source), leaf, subroot, root,
    proof (all siblings, bottom up, left to right, as hex), folded_root (from the changed
    leaf where there is one), copied (the version's own nodes from the changed leaf to its
    root, null where nothing changed) and verified. ``tampered_text`` gives the text found
    later, null where the document was not touched."""
    spark = docs.sparkSession
    ship_package(spark)
    span = arity ** block_levels
    own = docs.select(*[F.col(f"`{c}`") for c in FIELDS],
                      (F.lit(None).cast("string") if tampered_text is None else tampered_text).alias("found"))
    head = [field(F.col(c)) for c in FIELDS[:-1]]
    changed = F.when(F.col("found").isNotNull() & ~F.col("found").eqNullSafe(F.col("text")),
                     F.unhex(F.sha2(F.concat(*head, field(F.col("found"))), 256)))
    leaves = stage(own.select(F.col("doc_id").cast("long").alias("doc_id"), "source", field(F.col("source")).alias("key"),
                              F.unhex(F.sha2(F.concat(*head, field(F.col("text"))), 256)).alias("leaf"),
                              changed.alias("changed")), "merkle-leaves")
    names = leaves.groupBy("key").agg(F.min("source").alias("source"))
    rows = stage(_by_block(_numbered(leaves.drop("source"), ["doc_id", "leaf"]), span)
                 .mapInArrow(_leaf_blocks(arity, block_levels), LEAVES_DDL), "merkle-blocks")
    blocks = rows.filter(F.col("pos") % span == 0).select(
        "key", F.col("block").alias("pos"), F.ceil(F.col("size") / span).alias("size"), F.lower(F.hex("top")).alias("digest"))
    paths, subroots = _climb(blocks, arity, block_levels)

    # the source roots are one more tree, under one key
    placed = _numbered(subroots.join(names, "key").select(
        F.lit("").alias("key"), F.col("key").alias("source_key"), "source", "digest"), ["source"])
    placed = stage(placed, "merkle-sources")
    over, root = _climb(placed.select("key", "pos", "size", "digest"), arity, block_levels)
    top = root.first()
    over = placed.join(over.drop("key"), "pos").select(
        F.col("source_key").alias("key"), "source", F.col("digest").alias("subroot"),
        F.col("before").alias("before2"), F.col("after").alias("after2"))
    upper = stage(paths.join(over, "key").select(
        "key", F.col("pos").alias("block"), "source", "subroot", F.lit(top.digest if top else None).alias("root"),
        F.zip_with(F.concat("before", "before2"), F.concat("after", "after2"),
                   lambda a, b: F.struct(a.alias("before"), b.alias("after"))).alias("path")), "merkle-paths")

    def step(node, at):
        return F.sha2(F.concat(at["before"], node, at["after"]), 256)

    found = rows.join(upper, ["key", "block"])
    hexes = F.lower(F.hex("copied"))
    inside = F.transform(F.sequence(F.lit(0), (F.length("copied") / 32).cast("int") - 1),
                         lambda i: F.substring(hexes, i * 64 + 1, F.lit(64)))
    grown = F.aggregate("path", inside, lambda acc, at: F.concat(acc, F.array(step(F.element_at(acc, -1), at))))
    folded = F.aggregate("path", F.lower(F.hex("new_top")), step)
    beside = F.array_join(F.transform("path", lambda at: F.concat(at["before"], at["after"])), "")
    return found.select("doc_id", "source", "pos", F.lower(F.hex("leaf")).alias("leaf"), "subroot", "root",
                        F.concat(F.lower(F.hex("siblings")), beside).alias("proof"), folded.alias("folded_root"),
                        F.when(F.col("copied").isNotNull(), grown).alias("copied")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document (by the checksum of its id) lost its line ends."""
    docs = table(spark, sf_dir, "documents")
    found = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", ""))
    return merkle_manifest(docs, found).select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
                                               "folded_root", "verified")


#: crc32 is a fold over the bytes of the id; every level of the two trees is a round of the recursion.
ORACLE = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, byte: list_reduce([xor(crc, byte)] || [k::BIGINT FOR k IN range(8)],
        lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS crc
  FROM documents),
d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || CASE WHEN xor(crc, 4294967295) % 2 = 0
      THEN coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')
      ELSE coalesce(strlen(text) || ':' || text, '-') END) AS seen
  FROM f),
t AS (
  SELECT 0 AS lev, source, pos, leaf AS node, count(*) OVER (PARTITION BY source) AS size FROM d
  UNION ALL
  SELECT lev + 1, source, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(size) + 2) // 3
  FROM t WHERE size > 1 GROUP BY lev, source, pos // 3),
s AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size
  FROM t WHERE size = 1),
u AS (
  SELECT 0 AS lev, pos, subroot AS node, size FROM s
  UNION ALL
  SELECT lev + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(size) + 2) // 3
  FROM u WHERE size > 1 GROUP BY lev, pos // 3),
inner_path AS (
  SELECT a.lev, a.source, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM t a JOIN t b ON a.lev = b.lev AND a.source IS NOT DISTINCT FROM b.source AND a.pos // 3 = b.pos // 3
  WHERE a.size > 1 GROUP BY a.lev, a.source, a.pos),
outer_path AS (
  SELECT a.lev, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM u a JOIN u b ON a.lev = b.lev AND a.pos // 3 = b.pos // 3 WHERE a.size > 1 GROUP BY a.lev, a.pos),
w AS (
  SELECT 0 AS lev, doc_id, source, pos, seen AS node, '' AS proof FROM d
  UNION ALL
  SELECT w.lev + 1, w.doc_id, w.source, w.pos // 3, sha256(p.before || w.node || p.after), w.proof || p.before || p.after
  FROM w JOIN inner_path p ON p.lev = w.lev AND p.source IS NOT DISTINCT FROM w.source AND p.pos = w.pos),
x AS (
  SELECT 0 AS lev, w.doc_id, w.source, s.pos, w.node, w.proof FROM w
  JOIN (SELECT doc_id, source, max(lev) AS lev FROM w GROUP BY doc_id, source) m
    ON m.lev = w.lev AND m.doc_id IS NOT DISTINCT FROM w.doc_id AND m.source IS NOT DISTINCT FROM w.source
  JOIN s ON s.source IS NOT DISTINCT FROM w.source
  UNION ALL
  SELECT x.lev + 1, x.doc_id, x.source, x.pos // 3, sha256(p.before || x.node || p.after), x.proof || p.before || p.after
  FROM x JOIN outer_path p ON p.lev = x.lev AND p.pos = x.pos),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source ORDER BY lev DESC) AS k FROM x)
SELECT e.doc_id, d.leaf, s.subroot, r.node AS root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = r.node AS verified
FROM e JOIN d ON d.doc_id IS NOT DISTINCT FROM e.doc_id AND d.source IS NOT DISTINCT FROM e.source
JOIN s ON s.source IS NOT DISTINCT FROM e.source CROSS JOIN (SELECT node FROM u WHERE size = 1) r
WHERE e.k = 1
"""
