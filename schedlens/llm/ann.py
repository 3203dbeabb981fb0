"""Nearest neighbours over balanced posting lists.

Fit. Centroids come from a bounded, documented sample (``sample_rows`` vectors with the
smallest hash of their id): about one per ``LIST_ROWS`` vectors of the whole table, at
most ``MAX_CENTROIDS``. Between Lloyd steps the centroids of short lists move into long
ones, which keeps lists balanced. A neighbour graph over the centroids is what tasks hold in memory; its size
is bounded by ``MAX_CENTROIDS``, not by the table.

Index. Every row is assigned by searching that graph. A vector near a boundary is
replicated: it joins up to ``REPLICAS`` lists whose centroids are within (1 + ``CLOSURE``)
of the nearest one's distance. Lists are cut into blocks of about ``BLOCK_ROWS`` by a hash
of the id, so a list of many equal vectors is spread over tasks.

Search. A query searches the graph and probes the lists whose centroids are within
(1 + ``PRUNE``) of the nearest one's distance (distance-ratio pruning, at least
``MIN_LISTS``, and as many as hold k vectors). Blocks and the queries sent to them meet in one shuffle; a task holds one
block and streams its queries. Distances are Euclidean in double precision on the
original vectors. Each block answers with its k nearest per query; the last step
merges these, drops the copies that replication made and ranks.

Defined results. Vectors that are null, all zero, hold null or non-finite components or
differ in length from the first one by id take no part, nor do rows with a null id. Rows
that repeat an id count once, with the smallest distance. Ties go to the smaller id.
With fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schedlens.llm.common import ship_package, stage, table

LIST_ROWS = 64
MAX_CENTROIDS = 16_384
SAMPLE_ROWS = 40_000
REPLICAS, CLOSURE = 4, 0.10
PRUNE, MIN_LISTS = 0.18, 8
BLOCK_ROWS = 4_096
#: Answers a task holds before it merges them per query.
MERGE_ROWS = 400_000
DEGREE, BEAM = 24, 16
LLOYD_STEPS, LONG = 16, 2.0


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]
    return np.sqrt(np.maximum(d, 0))


def balanced_centroids(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k-means that splits long lists: each step moves the centroids of the shortest
    lists into the lists that are over ``LONG`` times the mean."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for step in range(LLOYD_STEPS if k > 1 else 1):
        near = np.concatenate([_distances(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.bincount(near, weights=x[:, j], minlength=k) / np.maximum(size, 1)
        if step == LLOYD_STEPS - 1:
            return c[size > 0]
        mean = len(x) / k
        extra = np.maximum(0, np.floor(size / (LONG * mean))).astype(np.int64)  # more centroids for each long list
        short = np.argsort(size, kind="stable")
        short = short[(size[short] < mean) & (extra[short] == 0)]
        to = np.repeat(np.arange(k), extra)[:len(short)]
        moved = [rng.choice(np.flatnonzero(near == t)) for t in to]
        c[short[:len(to)]] = x[moved] if moved else 0
        gone = (size == 0) & ~np.isin(np.arange(k), short[:len(to)])
        c[gone] = x[rng.choice(len(x), int(gone.sum()))]
    return c


class CentroidGraph:
    """Centroids with links to their nearest ones, both ways, and a few entry points."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.c = np.ascontiguousarray(centroids, dtype=np.float64)
        k = len(self.c)
        degree = min(degree, k - 1)
        links: list[set[int]] = [set() for _ in range(k)]
        for i in range(0, k, 1024):
            d = _distances(self.c[i:i + 1024], self.c)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near = np.argpartition(d, max(0, degree - 1), axis=1)[:, :degree]
            for j, row in enumerate(near.tolist()):
                for t in row:
                    links[i + j].add(t)
                    links[t].add(i + j)
        width = max([1, *map(len, links)])
        self.links = np.array([[*s, *[i] * (width - len(s))] for i, s in enumerate(map(sorted, links))], dtype=np.int64)
        self.entries = np.unique(np.linspace(0, k - 1, max(1, int(k ** 0.5))).astype(np.int64))

    def search(self, x: np.ndarray, ratio: float, beam: int = BEAM) -> np.ndarray:
        """Distances to the centroids (inf where not visited), complete for those that the
        graph reaches over centroids within (1 + ratio) of the best or in the beam."""
        n, k = len(x), len(self.c)
        dist = np.full((n, k), np.inf)
        dist[:, self.entries] = _distances(x, self.c[self.entries])
        expanded = np.zeros((n, k), dtype=bool)
        beam = min(beam, k)
        while True:
            limit = np.maximum(dist.min(1) * (1 + ratio), np.partition(dist, beam - 1, axis=1)[:, beam - 1])
            row, at = np.nonzero((dist <= limit[:, None]) & ~expanded & np.isfinite(dist))
            if not row.size:
                return dist
            expanded[row, at] = True
            new = np.zeros((n, k), dtype=bool)
            new[np.repeat(row, self.links.shape[1]), self.links[at].ravel()] = True
            new &= ~np.isfinite(dist)
            for i in range(0, n, 64):  # rows share most of what they visit next
                cols = np.flatnonzero(new[i:i + 64].any(0))
                if cols.size:
                    d = _distances(x[i:i + 64], self.c[cols])
                    part = dist[i:i + 64, cols]
                    dist[i:i + 64, cols] = np.where(new[i:i + 64, cols], d, part)

    def rows_at_once(self) -> int:
        return max(64, (1 << 21) // len(self.c))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec array<double>) of the rows that take part."""
    ship_package(df.sparkSession)
    v = F.col("vec")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


class Index:
    """A fitted index: the graph (driver and broadcast) and the stored posting blocks."""

    def __init__(self, rows: DataFrame, sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS):
        self.spark = rows.sparkSession
        first = rows.orderBy("vec_id", "vec").limit(1).select(F.size("vec").alias("d")).collect()
        self.dim = first[0].d if first else 0
        rows = rows.filter(F.size("vec") == self.dim)
        self.rows, n = rows, rows.count()
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow() if n else None  # at most sample_rows
        self.graph = None
        if n:
            x = _matrix(sample.column("vec").combine_chunks())
            k = max(1, min(n // list_rows, MAX_CENTROIDS, len(x) // 4))
            self.graph = CentroidGraph(balanced_centroids(x, k))
            self.shared = self.spark.sparkContext.broadcast(self.graph)
            self.blocks = self._blocks()

    def _assigned(self, rows: DataFrame, ratio: float, at_most: int, at_least: int, held: np.ndarray | None = None,
                  need: int = 0) -> DataFrame:
        """(list, id, vec) for every list a vector belongs to or a query probes; with the
        lists' sizes ``held``, as many more lists as it takes to hold ``need`` vectors."""
        graph = self.shared
        schema = pa.schema([("list", pa.int32()), ("id", pa.int64()), ("vec", pa.list_(pa.float64()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = graph.value
            step = g.rows_at_once()
            for whole in batches:
                for i in range(0, whole.num_rows, step):
                    batch = whole.slice(i, step)
                    x = _matrix(batch.column("vec"))
                    d = g.search(x, ratio)
                    if held is not None and (few := np.where(np.isfinite(d), held[None], 0).sum(1) < need).any():
                        d[few] = _distances(x[few], g.c)
                    order = np.argsort(d, axis=1, kind="stable")[:, :at_most]
                    near = np.take_along_axis(d, order, 1)
                    take = (near <= near[:, :1] * (1 + ratio)) & np.isfinite(near)
                    take[:, :at_least] |= np.isfinite(near[:, :at_least])
                    if held is not None:
                        before = np.cumsum(held[order], axis=1) - held[order]
                        take |= (before < need) & np.isfinite(near)
                    row, at = np.nonzero(take)
                    yield pa.RecordBatch.from_arrays([pa.array(order[row, at].astype(np.int32)), batch.column("vec_id").take(pa.array(row)),
                                                      batch.column("vec").take(pa.array(row)).cast(pa.list_(pa.float64()))], schema=schema)

        return rows.select("vec_id", "vec").mapInArrow(run, "list int, id long, vec array<double>")

    def _blocks(self) -> DataFrame:
        posted = stage(self._assigned(self.rows, CLOSURE, REPLICAS, 1), "posting-lists")
        sizes = stage(posted.groupBy("list").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")), "list-sizes")
        self.held = np.zeros(len(self.graph.c), dtype=np.int64)
        for r in sizes.collect():  # at most MAX_CENTROIDS rows
            self.held[r.list] = r.ids
        # an id is in so many lists at most: REPLICAS, or more where rows share an id
        spread = posted.groupBy("id").agg(F.count_distinct("list").alias("n")).agg(F.max("n")).first()[0]
        self.spread = max(REPLICAS, spread or 0)
        self.sizes = sizes.select("list", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
        return posted.join(self.sizes, "list").select(
            "list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "id", "vec")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, vec_id, score); ``queries`` are (vec_id, vec) rows."""
        if self.graph is None:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        probes = self._assigned(queries.filter(F.size("vec") == self.dim), PRUNE, len(self.graph.c), MIN_LISTS,
                                self.held, self.spread * (k + 1))
        sent = probes.join(self.sizes, "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "id", "vec")
        near = (self.blocks.unionByName(sent).repartition("list", "block").sortWithinPartitions("list", "block", "side")
                .mapInArrow(_nearest(k), "query_id long, vec_id long, score double"))
        once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return (once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))


def _nearest(k: int):
    """Streams sorted (list, block, side) rows: a block's vectors first, then its queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def best(ids, x, q_ids, q):
        """The k nearest ids of a block for each query; rows of an id stand together."""
        out, heads = [], np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        for i in range(0, len(q), 256):
            a, own = q[i:i + 256], q_ids[i:i + 256]
            d = _distances(a, x)
            d[own[:, None] == ids[None]] = np.inf
            by_id = d if len(heads) == len(ids) else np.minimum.reduceat(d, heads, axis=1)
            nth = min(k, by_id.shape[1]) - 1
            kth = np.partition(by_id, nth, axis=1)[:, nth]
            # the expansion above is only a filter: all that may be among the k nearest
            slack = 1e-6 * (1 + np.sqrt((a * a).sum(1)) + np.sqrt((x * x).sum(1)).max())
            row, at = np.nonzero((d <= (kth + slack)[:, None]) & np.isfinite(d))
            diff = a[row] - x[at]
            exact = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            order = np.lexsort((exact, ids[at], row))
            row, at, exact = row[order], at[order], exact[order]
            first = np.ones(len(row), dtype=bool)  # of an id its nearest row
            first[1:] = (row[1:] != row[:-1]) | (ids[at[1:]] != ids[at[:-1]])
            row, at, exact = row[first], at[first], exact[first]
            order = np.lexsort((ids[at], exact, row))
            row, at, exact = row[order], at[order], exact[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < k
            out.append((own[row[keep]], ids[at[keep]], exact[keep]))
        return out

    def merged(found):
        """The k nearest of each query among what this task has found so far, once each."""
        q, v, score = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((v, score, q))
        q, v, score = q[order], v[order], score[order]
        first = np.ones(len(q), dtype=bool)  # copies of a vector are neighbours here
        first[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
        q, v, score = q[first], v[first], score[first]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], v[keep], score[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vecs, block = None, [], [], None
        found: list = []
        for batch in batches:
            lists, blocks, side, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "block", "side", "id"))
            x = _matrix(batch.column("vec"))
            change = (lists[1:] != lists[:-1]) | (blocks[1:] != blocks[:-1]) | (side[1:] != side[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(lists)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if (lists[a], blocks[a]) != key:
                    key, ids, vecs, block = (lists[a], blocks[a]), [], [], None
                if side[a] == 0:
                    ids.append(rows[a:b])
                    vecs.append(x[a:b])
                elif ids:
                    if block is None:
                        block_ids = np.concatenate(ids)
                        by = np.argsort(block_ids, kind="stable")
                        block = block_ids[by], np.concatenate(vecs)[by]
                    found += best(*block, rows[a:b], x[a:b])
            if sum(len(f[0]) for f in found) > MERGE_ROWS:
                found = [merged(found)]
                if len(found[0][0]) > MERGE_ROWS // 2:  # many queries: let the shuffle merge them
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[0]], schema=schema)
                    found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged(found)], schema=schema)

    return run


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS) -> DataFrame:
    """The k nearest rows of every row that satisfies ``is_query`` (over column vec_id)."""
    rows = valid_vectors(df, id_col, vec_col)
    index = Index(rows, sample_rows, list_rows)
    return index.search(rows.filter(is_query), k)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)
