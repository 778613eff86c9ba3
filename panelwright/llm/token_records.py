"""Token ids as length-delimited binary records with a separate offset index.

A shard is a sequence of frames: length of the payload (unsigned 64-bit), masked checksum of those eight
bytes (unsigned 32-bit), payload, masked checksum of the payload; all little-endian. The checksum is the
CRC-32 of zlib, masked by a rotation and a constant so that a checksum stored inside checked data can't
pass for its own. A payload is the doc_id (signed 64-bit), the width of an id in bytes (one byte: 2 where
the vocabulary allows, else 4) and the ids. Shards hold ascending ranges of doc_id. The index is a Parquet
table (shard, doc_id, at, n_tokens), so a training job can read records in any shuffled order by seeking.

Tokenization is the tokenizers library's. Its pattern never joins text across certain single spaces (see
pieces), so each distinct piece goes through the library once per worker while remembered.

Edge cases: a null text counts as empty and gives the end id alone; a null doc_id is written as the least
64-bit integer, sorts first and reads back as null; repeated rows get a record each; an empty table gives
no shards and no rows; other columns of the input are ignored. A damaged frame raises an error.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.bpe import vocabulary_path
from panelwright.llm.pieces import Recent, chunks, cut
from panelwright.llm.storage import AtomicFile, a_file_a_task, open_store, scratch, stored

#: Fixed value: the constant of the usual masked-checksum formula.
MASK_DELTA = 0xA282EAD8
NO_ID = -(2**63)
#: Bytes of text that a task turns into Python objects at a time.
SLICE = 1 << 20
INDEX = "shard int, path string, doc_id long, at long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def frames(stream, where: str) -> Iterator[bytes]:
    """Payloads of a stream of frames, checked."""
    while head := stream.read(12):
        if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError(f"damaged length in {where}")
        size = struct.unpack("<Q", head[:8])[0]
        body = stream.read(size + 4)
        if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
            raise ValueError(f"damaged record in {where}")
        yield body[:size]


class PieceEncoder:
    """The tokenizers library behind a memory of pieces; ids of an entry come as little-endian bytes."""

    def __init__(self, path: str, remembered: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.memo = Recent(self.many, remembered)

    def many(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.width == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of all texts, one after another, and where each text's begin."""
        entries, n_parts, index, first = cut(texts)
        each = self.memo.many(entries[:n_parts]) + self.many(entries[n_parts:])
        ids = np.frombuffer(b"".join(each), f"<u{self.width}")
        n = np.fromiter(map(len, each), np.int64, len(each)) // self.width
        starts, counts = np.cumsum(n) - n, n[index]
        ends = np.cumsum(counts)
        place = np.repeat(starts[index] - (ends - counts), counts)
        place += np.arange(len(place))
        return ids[place], np.concatenate(([0], ends))[first]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Write the shards of ``docs`` under ``folder`` and return the index, itself written beside them.

    There are ``shards`` of them, or as many as adaptive execution makes of the texts' bytes, ``spark.sql.shuffle.partitions``
    at most. Texts are shuffled and not ids: with short tokens the ids are no smaller, and dealing them into ranges
    would need them stored or encoded twice.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    rows = rows.repartitionByRange(*([shards] if shards else []), *order[:2]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(vocabulary), TaskContext.get().partitionId()
        name = f"part-{shard:06d}.rec"
        end, width = end_id.to_bytes(enc.width, "little"), bytes([enc.width])
        with AtomicFile(f"{folder}/records", name) as out:
            for part in (p for batch in batches for p in chunks(batch, most=SLICE)):
                ids, first = enc.encode(part.column("text"))
                places, n = [], part.num_rows
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    places.append(out.tell())
                    out.write(frame(struct.pack("<q", NO_ID if doc_id is None else doc_id) + width + ids[first[i] : first[i + 1]].tobytes() + end))
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard] * n, pa.int32()), "path": pa.array([f"{folder}/records/{name}"] * n, pa.string()),
                    "doc_id": part.column("doc_id"), "at": pa.array(places, pa.int64()), "n_tokens": pa.array(np.diff(first) + 1),
                })

    return stored(rows.mapInArrow(run, INDEX), "index", f"{folder}/index")


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width = struct.unpack_from("<qB", payload)
    return (None if doc_id == NO_ID else doc_id), np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=9)


def read_records(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Per record of the files, in file order: doc_id, start (ids before it), n_tokens, ids_crc32."""
    sizes = sorted(index.groupBy("shard", "path").agg(F.sum("n_tokens").alias("n")).collect())  # a row a shard
    bases, total = [], 0
    for shard, path, n in sizes:
        bases.append((shard, path, total))
        total += n
    todo = a_file_a_task(spark.createDataFrame(bases, "shard int, path string, base long"), "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, name = open_store(path)
                rows: list[tuple] = []
                with store.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                    for payload in frames(stream, path):
                        doc_id, ids = parse(payload)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "start", "n_tokens", "ids_crc32"), columns, strict=True)})


def read_shuffled(index: DataFrame, seed: int, partitions: int) -> DataFrame:
    """doc_id and ids in an order shuffled by ``seed``: the index is dealt out and each record is sought in its shard."""
    dealt = index.withColumn("rank", F.xxhash64(F.lit(seed), "doc_id", "shard", "at")).repartition(partitions, "rank").sortWithinPartitions("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            ids, tokens = [], []
            for path, at in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if path != name:
                    store, inner = open_store(path)
                    name, source = path, store.open_input_file(inner)
                source.seek(at)
                doc_id, values = parse(next(frames(source, path)))
                ids.append(doc_id)
                tokens.append(values.astype(np.int32))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(tokens, pa.list_(pa.int32()))})

    return dealt.mapInArrow(run, "doc_id long, ids array<int>")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-records")
    index = write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, vocabulary_path(), end_id=2)
    return read_records(spark, index)
