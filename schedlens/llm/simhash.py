"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints. Words are maximal runs of non-blanks after lower-casing A-Z; every
run of ``shingle_words`` words (space-joined, repeats included) is hashed with XXH64
(UTF-8, seed 42); a fingerprint bit is set when it is set in over half of the hashes.
A shorter text is one shingle; a text without words (null and empty included) has
fingerprint zero, linked like any other.

Links. Equal fingerprints are merged first, so copies cost nothing. Two fingerprints
within ``radius`` bits agree on one of radius + 1 bit bands, so each distinct
fingerprint is filed under a prefix of each band, as wide as keeps buckets near
``LANES`` entries. Inside a bucket the fingerprints are stored as vertical bit planes:
one 64-bit word holds one bit of 64 fingerprints. Distances of a query to 64 lanes
are counted at once by carry-save counters that start so that the (radius + 1)-th
differing bit carries out; a block leaves the comparison once all its lanes did.
A bucket above ``HOT`` entries is filed anew under more bits (the whole band, then
band plus a part of the rest, twice); what is left then is at most 2^19 distinct
fingerprints, compared in tiles. Nothing is capped or dropped.

A bucket emits a star per linked group (not all pairs); components.py joins them.
Rows with a null id get their group's component, null when no member has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlens.llm.common import hex16, ship_package, stage, table, text_rows, texts
from schedlens.llm.components import components
from schedlens.llm.xxh import xxh64_slices

LANES = 256
HOT = 16_384
#: Query rows and 64-lane words of one tile of a comparison.
TILE = (256, 512)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of text and shingles worked on at once.
CHUNK_BYTES, CHUNK_SHINGLES = 1 << 20, 1 << 17


def _fingerprints(raw: list[bytes], k: int, seed: int) -> np.ndarray:
    """Fingerprints (uint64) of whole texts."""
    norm, spans, at = [], [], 0
    for t in raw:
        body = b" ".join(t.lower().split())
        norm.append(body)
        spans.append((at, at + len(body)))
        at += len(body) + 1
    data = b" ".join(norm)
    blank = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32) if data else np.empty(0, np.int64)
    starts, lens, owner, total = [], [], [], np.zeros(len(raw), dtype=np.int64)
    for i, (a, b) in enumerate(spans):
        if a == b:
            continue
        gaps = blank[np.searchsorted(blank, a):np.searchsorted(blank, b)]
        first = np.concatenate(([a], gaps + 1))
        last = np.concatenate((gaps, [b]))
        if len(first) > k:
            first, last = first[:len(first) - k + 1], last[k - 1:]
        else:
            first, last = first[:1], last[-1:]
        starts.append(first)
        lens.append(last - first)
        owner.append(np.full(len(first), i))
        total[i] = len(first)
    if not starts:
        return np.zeros(len(raw), dtype=np.uint64)
    starts, lens, owner = np.concatenate(starts), np.concatenate(lens), np.concatenate(owner)
    ones = np.zeros((len(raw), 64), dtype=np.int64)
    for c in range(0, len(starts), CHUNK_SHINGLES):
        s = slice(c, c + CHUNK_SHINGLES)
        h = xxh64_slices(data, starts[s], lens[s], seed)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[s]
        cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    set_bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def _fingerprint_rows(k: int, seed: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, part, size = [], [], 0
            for t in text_rows(batch):
                part.append(t)
                size += len(t)
                if size >= CHUNK_BYTES:
                    out.append(_fingerprints(part, k, seed))
                    part, size = [], 0
            if part:
                out.append(_fingerprints(part, k, seed))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.concatenate(out).view(np.int64))], schema=schema)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed long."""
    return texts(docs, id_col, text_col).mapInArrow(_fingerprint_rows(shingle_words, seed), "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 x words: bit i of 64 consecutive fingerprints per word of row i."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.zeros((lanes, 64), dtype=np.uint8)
    bits[:len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within_radius(planes: np.ndarray, n: int, queries: np.ndarray, radius: int):
    """(query row, lane) pairs of lanes at most ``radius`` bits away."""
    words = planes.shape[1]
    width = (radius + 1).bit_length()
    init = (1 << width) - 1 - radius
    mask = np.where(np.unpackbits(queries.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"),
                    ALL, np.uint64(0))
    over = np.zeros(words, dtype=np.uint64)  # lanes past the end are out from the start
    if n % 64:
        over[-1] = ALL << np.uint64(n % 64)
    dead = np.broadcast_to(over, (len(queries), words)).copy()
    count = [np.full(dead.shape, ALL if init >> b & 1 else np.uint64(0), dtype=np.uint64) for b in range(width)]
    q = w = None
    for p in range(64):
        if q is None:
            diff = planes[p][None, :] ^ mask[:, p][:, None]
        else:
            diff = planes[p][w] ^ mask[q, p]
        for c in count:
            carry = c & diff
            c ^= diff
            diff = carry
        dead |= diff
        if p % 8 == 7:  # abandon blocks in which every lane exceeded the radius
            live = dead != ALL
            if q is None:
                q, w = np.nonzero(live)
            elif not live.all():
                q, w = q[live], w[live]
            else:
                continue
            count, dead = [c[live] for c in count], dead[live]
            if not q.size:
                return q, w
    lanes = np.unpackbits((~dead).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(lanes)
    return q[at], w[at] * 64 + lane


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the groups of a[i] and b[i]; root[x] is then the smallest member."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def linked_groups(fps: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints: index of the first one linked to each, directly or not."""
    root = np.arange(len(fps))
    rows, words = TILE
    for lo in range(0, len(fps), words * 64):
        lanes = fps[lo:lo + words * 64]
        planes = bit_planes(lanes)
        for at in range(0, min(lo + len(lanes), len(fps)), rows):
            q, lane = within_radius(planes, len(lanes), fps[at:min(at + rows, lo + len(lanes))], radius)
            q, lane = q + at, lane + lo
            _join(root, q[q < lane], lane[q < lane])
    return root


def _links(radius: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bucket(parts):
            fps = np.unique(np.concatenate(parts))
            if len(fps) < 2:
                return None
            root = linked_groups(fps.view(np.uint64), radius)
            at = np.flatnonzero(root != np.arange(len(fps)))
            return (fps[at], fps[root[at]]) if at.size else None

        held, key = [], None
        us, vs = [], []
        for batch in batches:
            band, k, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask_id", "key", "fp"))
            cut = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (band[1:] != band[:-1]))))
            for a, b in zip(cut, [*cut[1:], len(k)]):
                if (band[a], k[a]) != key:
                    if held and (x := bucket(held)):
                        us.append(x[0])
                        vs.append(x[1])
                    held, key = [], (band[a], k[a])
                held.append(fp[a:b])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=schema)
                us, vs = [], []
        if held and (x := bucket(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], schema=schema)

    return run


def _split(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[i * len(bits) // parts:(i + 1) * len(bits) // parts] for i in range(parts)]


def _signed(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def mask_levels(n: int, radius: int) -> list[dict[int, list[list[int]]]]:
    """Bit masks to file fingerprints under. Level 0 maps -1 to the first masks; level
    i maps each mask of level i - 1 to those that replace it in a hot bucket."""
    wide = max(4, (max(n, 1) // LANES).bit_length())
    bands = _split(list(range(64)), radius + 1)
    levels = [{-1: [b[:wide] for b in bands]}, {i: [b] for i, b in enumerate(bands)}]
    for _ in range(2):
        masks = [m for ms in levels[-1].values() for m in ms]
        levels.append({i: [m + part for part in _split([b for b in range(64) if b not in m], radius + 1)]
                       for i, m in enumerate(masks)})
    return levels


def near_links(fps: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """(u, v) links, u > v, that connect exactly the distinct fingerprints (column fp)
    which a chain of distances of at most ``radius`` connects."""
    ship_package(fps.sparkSession)
    links, rows = None, fps.select("fp", F.lit(-1).alias("mask_id"))
    levels = mask_levels(fps.count(), radius)
    for depth, level in enumerate(levels):
        filed, number = [], 0
        for parent, masks in level.items():
            keys = []
            for m in masks:
                keys.append(F.struct(F.lit(number).alias("mask_id"),
                                     F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")))
                number += 1
            filed.append((parent, F.array(*keys)))
        found = F.coalesce(*[F.when(F.col("mask_id") == p, a) for p, a in filed])
        rows = rows.select("fp", F.explode(found).alias("x")).select("fp", "x.mask_id", "x.key")
        heavy = None
        if depth < len(levels) - 1:
            heavy = stage(rows.groupBy("mask_id", "key").count().filter(F.col("count") > hot).drop("count"), "hot-buckets")
            if heavy.limit(1).count() == 0:
                heavy = None
        cold = rows if heavy is None else rows.join(heavy, ["mask_id", "key"], "left_anti")
        here = (cold.select("mask_id", "key", "fp").repartition("mask_id", "key")
                .sortWithinPartitions("mask_id", "key").mapInArrow(_links(radius), "u long, v long"))
        links = here if links is None else links.unionByName(here)
        if heavy is None:
            break
        rows = rows.join(heavy, ["mask_id", "key"], "left_semi").select("fp", "mask_id")
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the
    smallest doc_id reachable over links of at most ``radius`` differing bits)."""
    marked = stage(fingerprints(docs, id_col, text_col, shingle_words, seed), "fingerprints")
    fps = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(near_links(fps, radius))
    rooted = (fps.join(roots, fps.fp == roots.node, "left")
              .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    comps = stage(rooted.join(lows, "root").select("fp", "component_id"), "fingerprint-components")
    return marked.join(comps, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
