"""SentencePiece encoding and decoding over tables of distinct chunks.

When no piece of the model has a whitespace marker after another character, merges
never cross the start of a marker run, so a text's pieces are those of its *chunks*:
a run of markers with the word that follows. Each task keeps a table of the distinct
chunks of its texts; every distinct chunk is segmented (and decoded) once with the
library, and whole texts are put together by taking table entries position by
position. The table lives per task and in two generations of bounded size, so
nothing is shuffled and memory does not grow with the corpus.

The model's own rules are checked, not assumed: ``ChunkTable`` refuses a model with a
piece that crosses a marker or one that does not round-trip blanks. A null text is
empty and has no ids. Runs of blanks, leading and trailing ones, literal U+2581 and
characters outside the vocabulary (byte fallback) give exactly the library's ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from schedlens.llm.common import batched, table, texts

MARK = "▁"
#: Bytes that one generation of a chunk table may take.
TABLE_BYTES = 40 << 20
_CHUNK = re.compile(" [ ]*[^ ]*")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTable(dict):
    """Chunk (without its first marker) -> entry made of (chunk, ids) by ``make``."""

    def __init__(self, path: str, make: Callable[[str, list[int]], tuple], max_bytes: int = TABLE_BYTES):
        import sentencepiece

        super().__init__()
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.make, self.max_bytes, self.size, self.old = make, max_bytes, 0, {}
        crossing = [p for p in map(m.id_to_piece, range(m.get_piece_size())) if re.search(f"[^{MARK}]{MARK}", p)]
        if crossing or m.decode(m.encode("  a  b ")) != "  a  b ":
            raise ValueError(f"{path}: pieces cross whitespace markers: {crossing[:5]}")
        self.lone = m.encode("a ")[len(m.encode("a")):]

    def chunks(self, text: str) -> list[str]:
        """The chunks of a non-empty text, each without its first marker."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in _CHUNK.findall(" " + text)]

    def learn(self, chunks: list[str]) -> None:
        """Makes entries for all chunks; older ones may leave the table."""
        if self.size > self.max_bytes:
            self.old, self.size = dict(self), 0
            self.clear()
        new = []
        for c in set(chunks):
            if c in self:
                continue
            e = self.old.get(c)
            if e is None:
                new.append(c)
            else:
                self[c] = e
                self.size += 2 * len(c) + 300
        ids = self.model.encode(new, num_threads=1) if new else []
        for c, x in zip(new, ids):
            self[c] = self.make(c, x if c else self.lone)
            self.size += 2 * len(c) + 8 * len(x) + 300


CODEC = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())),
                   ("decoded", pa.string()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DDL = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>", "decoded": "string",
       "ids_sha256": "string", "decoded_sha256": "string"}


def _codec(path: str, columns: tuple[str, ...], max_bytes: int):
    schema = pa.schema([CODEC.field(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(chunk, ids):
            # decode() drops the first marker, so every chunk but a text's first gets it back as a space
            return len(ids), ",".join(map(str, ids)), chunk if (d := known.model.decode(ids)) == chunk else d

        known = ChunkTable(path, make, max_bytes)

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    text = text.as_py()
                    parts = known.chunks(text) if text else []
                    known.learn(parts)
                    found = [known[c] for c in parts]
                    made = {"doc_id": doc, "n_tokens": sum([e[0] for e in found])}
                    joined, decoded = ",".join([e[1] for e in found]), " ".join([e[2] for e in found])
                    if "ids" in columns:
                        made["ids"] = list(map(int, joined.split(","))) if joined else []
                    if "ids_sha256" in columns:
                        made["ids_sha256"] = hashlib.sha256(joined.encode()).hexdigest()
                    if "decoded" in columns:
                        made["decoded"] = decoded
                    if "decoded_sha256" in columns:
                        made["decoded_sha256"] = hashlib.sha256(decoded.encode()).hexdigest()
                    yield tuple(made[c] for c in columns), len(decoded)

        yield from batched(rows(), schema)

    return run


def encode_decode(docs: DataFrame, path: str | None = None, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids", "decoded"),
                  id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Ids of every whole text and the text decoded from them. ``columns`` picks the
    outputs; the digests are lowercase hex SHA-256 of the decimal ids joined by commas
    and of the decoded text."""
    return texts(docs, id_col, text_col).mapInArrow(
        _codec(path or model_path(), columns, table_bytes), ", ".join(f"{c} {DDL[c]}" for c in columns))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"),
                         columns=("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
