"""Token ids in training order, as fixed-stride binary shards.

Texts are encoded (byte-level BPE ids and one end id per document), concatenated within
a scan partition and cut into sequences of ``seq_len`` ids; only the last one of a
partition is padded. A keyed Feistel network over the next even power of two, walked
along its cycle until it falls below the number of sequences, is a permutation of
0..N-1: it gives every sequence its global slot without sorting or a random column.

The sequences are stored once, in compressed blocks that carry their scan partition and
their position in it; one count per partition goes to the driver and makes the global
numbering. Then one shuffle, by range of slots: range r of ``shard_slots`` slots goes
to task r, is sorted by slot and written as one file, part r, in the folder of its group
of ``group_shards`` shards. A reader names the folders and files of a range of slots by
patterns made from the numbers alone: no list of shards is kept or made, and only the
files of the range are opened. A record is 32 bytes of header (slot, first document, ids used, documents that occur in it), the ids as
little-endian integers, and one newline, so slot s is at byte
``(s % shard_slots) * stride`` of shard ``s // shard_slots`` and a reader resumes anywhere.
Records travel compressed; the files hold them as they are.

Files are written by Spark's own committed writer to the shared folder; all positions
come from stored rows, so a recomputed task writes the same bytes.

Defined results: a null or empty text is one end id. A null id is written as the
smallest long. Repeated rows are written like any others. No documents, no shards. A long
text runs through as many sequences as it needs. Further columns, whatever their names, are
not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlens.llm.common import ship_package, stage, table, texts
from schedlens.session import scratch_path

SEQ_LEN = 4096
SHARD_SLOTS = 2048
#: Shards in a folder; folder numbers start here, so that all have the same number of digits.
GROUP_SHARDS, GROUP_BASE = 256, 10**8
KEY = 0x5DEECE66D
ROUNDS = 6
#: Ids that are cut into sequences at a time, and sequences in a stored block.
CUT_BYTES, BLOCK = 1 << 20, 64
#: Compression of stored blocks and of records on their way.
BLOCK_LEVEL, RECORD_LEVEL = 9, 6
NULL_ID = -(1 << 63)
HEADER = np.dtype([("slot", "<i8"), ("first_doc", "<i8"), ("used", "<i4"), ("docs", "<i4"), ("spare", "<i8")])


class Feistel:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        with np.errstate(over="ignore"):
            self.keys = [self._mix(np.uint64(key & (2**64 - 1)) + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) for r in range(rounds)]

    @staticmethod
    def _mix(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(x.astype(np.uint64))
        while (out := np.flatnonzero(x >= self.n)).size:
            x[out] = step(x[out])
        return x.astype(np.int64)

    def slot(self, x: np.ndarray) -> np.ndarray:
        def step(v):
            a, b = v >> self.half, v & self.mask
            with np.errstate(over="ignore"):
                for k in self.keys:
                    a, b = b, a ^ (self._mix(b + k) & self.mask)
            return a << self.half | b

        return self._walk(np.asarray(x), step)

    def index(self, slot: np.ndarray) -> np.ndarray:
        def step(v):
            a, b = v >> self.half, v & self.mask
            with np.errstate(over="ignore"):
                for k in reversed(self.keys):
                    a, b = b ^ (self._mix(a + k) & self.mask), a
            return a << self.half | b

        return self._walk(np.asarray(slot), step)


def model_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The encoding of a rank file, its integer type and its end id (the first free one)."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return enc, np.dtype("<u2" if len(ranks) < (1 << 16) - 1 else "<u4"), len(ranks)


def stride(seq_len: int, dtype: np.dtype) -> int:
    return HEADER.itemsize + seq_len * dtype.itemsize + 1


BLOCKS = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])


def _blocks(path: str, seq_len: int):
    """Sequences of a scan partition as compressed blocks of records without slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, dtype, end = tokenizer(path)
        part, size, done = TaskContext.get().partitionId(), seq_len * dtype.itemsize, 0
        pack = zstandard.ZstdCompressor(level=BLOCK_LEVEL).compress
        held, held_size, owners = [], 0, []  # ids not cut yet; (document, byte at which it starts)

        def cut(last: bool) -> list[bytes]:
            """Whole sequences of what is held (with ``last``, also a padded one)."""
            nonlocal held, held_size, owners
            data = b"".join(held)
            n = -(-len(data) // size) if last else len(data) // size
            at = np.array([o[1] for o in owners], dtype=np.int64)
            begin = np.arange(n, dtype=np.int64) * size
            stop = np.minimum(begin + size, len(data))
            first = np.searchsorted(at, begin, side="right") - 1
            head = np.zeros(n, dtype=HEADER)
            head["first_doc"] = np.array([o[0] for o in owners], dtype=np.int64)[first]
            head["used"] = (stop - begin) // dtype.itemsize
            head["docs"] = np.searchsorted(at, stop, side="left") - first
            out = [h.tobytes() + data[b:b + size].ljust(size, b"\0") for h, b in zip(head, begin.tolist())]
            rest = data[n * size:]
            keep = int(np.searchsorted(at, n * size, side="right")) - 1 if rest else len(owners)
            owners = [(o[0], max(0, o[1] - n * size)) for o in owners[keep:]]
            held, held_size = [rest], len(rest)
            return out

        def blocks(records):
            nonlocal done
            for i in range(0, len(records), BLOCK):
                some = records[i:i + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([done], pa.int64()), pa.array([len(some)], pa.int32()),
                                                  pa.array([pack(b"".join(some))], pa.binary())], schema=BLOCKS)
                done += len(some)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = enc.encode_ordinary(text.as_py())
                ids.append(end)
                owners.append((NULL_ID if doc is None else doc, held_size))
                held.append(np.array(ids, dtype=dtype).tobytes())
                held_size += len(held[-1])
                if held_size >= max(CUT_BYTES, BLOCK * size):
                    yield from blocks(cut(False))
        if held_size:
            yield from blocks(cut(True))

    return run


def _place(starts, order: Feistel, size: int, shard_slots: int):
    """Gives every stored sequence its slot; records leave one by one, compressed."""
    schema = pa.schema([("shard", pa.int32()), ("slot", pa.int64()), ("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=RECORD_LEVEL).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part, first, n, data in zip(*(batch.column(c) for c in ("part", "first", "n", "data"))):
                raw, n = unpack(data.as_py()), n.as_py()
                at = starts.value[part.as_py()] + first.as_py()
                slots = order.slot(np.arange(at, at + n))
                records = [pack(int(s).to_bytes(8, "little") + raw[i * size + 8:(i + 1) * size]) for i, s in enumerate(slots)]
                yield pa.RecordBatch.from_arrays([pa.array((slots // shard_slots).astype(np.int32)), pa.array(slots),
                                                  pa.array(records, pa.binary())], schema=schema)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            yield pa.RecordBatch.from_arrays([some.column("shard"), some.column("slot"),
                                              pa.array([unpack(x.as_py()) for x in some.column("record")], pa.binary())], ["shard", "slot", "record"])


def write_shards(docs: DataFrame, folder: str, path: str | None = None, seq_len: int = SEQ_LEN,
                 shard_slots: int = SHARD_SLOTS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text",
                 group_shards: int = GROUP_SHARDS) -> dict:
    """Writes the shards as ``folder``/group=<group>/part-<shard>-* and returns their layout."""
    spark, path = docs.sparkSession, path or model_path()
    _, dtype, end = tokenizer(path)
    blocks = stage(texts(docs, id_col, text_col).mapInArrow(_blocks(path, seq_len), "part int, first long, n int, data binary"), "sequences")
    starts, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row per scan task
        starts[r.part] = total
        total += r.n
    layout = {"sequences": total, "seq_len": seq_len, "shard_slots": shard_slots, "stride": stride(seq_len, dtype),
              "dtype": dtype.str, "end": end, "key": key, "folder": folder, "group_shards": group_shards}
    if total:
        place = _place(spark.sparkContext.broadcast(starts), Feistel(total, key), stride(seq_len, dtype) - 1, shard_slots)
        (blocks.mapInArrow(place, "shard int, slot long, record binary")
         .repartitionById(-(-total // shard_slots), "shard").mapInArrow(_unpacked, "shard int, slot long, record binary")
         .withColumn("group", (GROUP_BASE + F.floor(F.col("shard") / group_shards)).cast("int"))
         .sortWithinPartitions("group", "slot")  # one shard; the writer asks for the order by group and keeps this one
         .select("group", F.col("record").cast("string").alias("value"))  # bytes as they are; the writer ends each with a newline
         .write.partitionBy("group").option("lineSep", "\n").option("maxRecordsPerFile", 0).text(folder))
    return layout


READ = pa.schema([("slot", pa.int64()), ("shard", pa.int32()), ("byte_offset", pa.int64()), ("first_doc_id", pa.int64()),
                  ("n_docs", pa.int32()), ("n_tokens", pa.int32()), ("ids_sha256", pa.string()), ("ids", pa.binary())])
READ_DDL = "slot long, shard int, byte_offset long, first_doc_id long, n_docs int, n_tokens int, ids_sha256 string, ids binary"


def number_patterns(first: int, last: int) -> list[str]:
    """Glob patterns of the numbers first..last, all of the same number of digits: one for
    each decimal block in the range, so a few per digit."""
    out = []
    while first <= last:
        k = 0
        while first % 10 ** (k + 1) == 0 and first + 10 ** (k + 1) - 1 <= last:
            k += 1
        out.append(str(first)[:len(str(first)) - k] + "?" * k)
        first += 10**k
    return out


def shard_patterns(layout: dict, first: int, last: int) -> list[str]:
    """Patterns of the files of shards first..last: whole groups by the numbers of their
    folders, the shards of a group that is only partly wanted by name."""
    folder, size = layout["folder"].rstrip("/"), layout["group_shards"]
    end = -(-layout["sequences"] // layout["shard_slots"])

    def part(lo: int, hi: int) -> str:  # of one group
        return f"{folder}/group={GROUP_BASE + lo // size}/part-{{{','.join(f'{s:05d}' for s in range(lo, hi + 1))}}}-*"

    low, high = first // size, last // size
    whole_low, whole_high = first % size == 0, last % size == size - 1 or last == end - 1
    out = []
    if low == high and not (whole_low and whole_high):
        return [part(first, last)]
    if not whole_low:
        out.append(part(first, (low + 1) * size - 1))
        low += 1
    if not whole_high:
        out.append(part(high * size, last))
        high -= 1
    return out + [f"{folder}/group={p}" for p in number_patterns(GROUP_BASE + low, GROUP_BASE + high)]


def read_shards(spark: SparkSession, layout: dict, first_slot: int = 0, last_slot: int | None = None,
                with_ids: bool = True) -> DataFrame:
    """Sequences of a range of slots (the last excluded), read from the shards that
    hold them at fixed offsets; ``ids`` are the raw little-endian integers. Files outside the
    range are not opened; of its first and last shard only the records in the range are decoded."""
    ship_package(spark)
    last = layout["sequences"] if last_slot is None else min(last_slot, layout["sequences"])
    if first_slot >= last:
        return spark.createDataFrame([], READ_DDL if with_ids else READ_DDL.rsplit(",", 1)[0])
    size, per, step = layout["stride"], layout["shard_slots"], np.dtype(layout["dtype"]).itemsize
    schema = READ if with_ids else READ.remove(len(READ) - 1)
    files = shard_patterns(layout, first_slot // per, (last - 1) // per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                shard, data = _shard(path), content.as_buffer()
                lo = max(0, first_slot - shard * per)
                hi = min(data.size // size, last - shard * per)
                for a in range(lo, hi, 256):
                    out = []
                    for i in range(a, min(a + 256, hi)):
                        raw = data.slice(i * size, size - 1).to_pybytes()
                        h = np.frombuffer(raw, dtype=HEADER, count=1)[0]
                        ids = raw[HEADER.itemsize:HEADER.itemsize + int(h["used"]) * step]
                        doc = int(h["first_doc"])
                        out.append((int(h["slot"]), shard, i * size, None if doc == NULL_ID else doc, int(h["docs"]),
                                    int(h["used"]), hashlib.sha256(ids).hexdigest(), ids)[:len(schema)])
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return (spark.read.format("binaryFile").load(files).select("path", "content")
            .mapInArrow(run, READ_DDL if with_ids else READ_DDL.rsplit(",", 1)[0]))


def _shard(path: str) -> int:
    return int(path.rsplit("/", 1)[1].split("-")[1])


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = write_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "llm-token-shards"))
    return read_shards(spark, layout, with_ids=False)
