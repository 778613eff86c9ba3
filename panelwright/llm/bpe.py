"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word's part boundaries stand in one array and the rank of the pair that begins at each boundary in
another. The encoder scans the ranks for the minimum, deletes the boundary between the two parts, and
refreshes the ranks beside it, until no adjacent pair has a rank. The vocabulary file is public and its
path is a parameter; nothing is trained here.

Edge cases: a null text counts as empty (no ids, decoded to the empty text); strings of added tokens in a
text become their ids; any length of text is encoded whole; rows that repeat are encoded each; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.pieces import Recent, chunks, cut

#: Fixed value: the published split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = 1 << 60
DEFAULT_VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by rule: visible Latin-1 stands for itself, the rest follow from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankArrayBpe:
    """``definition`` is the text of a tokenizers JSON file of a byte-level BPE."""

    def __init__(self, definition: str):
        import regex

        spec = json.loads(definition)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: as_bytes(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.byte_ids = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank_of = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.memo = Recent(lambda parts: list(map(self.of_part, parts)), 150_000)
        self.names = [b"%d" % i for i in range(max(self.bytes_of) + 1)]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: ``parts`` has the token that begins at each boundary, ``ranks`` the rank of it with the next."""
        rank, parts = self.rank_of.get, [self.byte_ids[b] for b in word]
        ranks = [rank(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != NO_RANK:
            i = ranks.index(least)
            parts[i] = part = self.merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(part << 32 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | part, NO_RANK)
        return parts

    def of_word(self, word: str) -> list[int]:
        raw = word.encode()
        return self.long_word(raw) if len(raw) > 400 else self.merge(raw)

    def long_word(self, word: bytes) -> list[int]:
        """The same merges where rescanning every rank would be quadratic: a heap of ranks over linked parts."""
        import heapq

        n, rank = len(word), self.rank_of.get
        parts, after, before = [self.byte_ids[b] for b in word], list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := rank(parts[i] << 32 | parts[j], NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.merged[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p >= 0]

    def of_plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        of_word = self.of_word
        return list(chain.from_iterable(of_word(w) for w in self.words.findall(text)))

    def of_part(self, part: str) -> list[int]:
        """As of_plain for a part of cut(); most are words and need no pattern."""
        return self.of_word(part) if part.isalpha() or part[:1] == " " and part[1:].isalpha() else self.of_plain(part)

    def encode(self, text: str) -> list[int]:
        ids, at = [], 0
        for hit in self.special.finditer(text) if self.special else ():
            ids += self.of_plain(text[at : hit.start()])
            ids.append(self.added[hit[0]])
            at = hit.end()
        return ids + self.of_plain(text[at:])

    def encode_many(self, texts: pa.Array) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """(each, index, first): the ids of text i are those of ``each`` numbered ``index[first[i] : first[i + 1]]``, one after another."""
        entries, n_parts, index, first = cut(texts)
        return self.memo.many(entries[:n_parts]) + list(map(self.encode, entries[n_parts:])), index, first

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Bytes of the tokens joined and read as UTF-8; broken sequences become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> RankArrayBpe:
    """Once per Python worker; the file is installed on every executor with the tokenizer package."""
    with open(path, encoding="utf-8") as f:
        return RankArrayBpe(f.read())


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of its text as array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in chunks(batch):
                each, index, first = bpe.encode_many(part.column("text"))
                ids = [list(chain.from_iterable(each[k] for k in index[a:b])) for a, b in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_column(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ids; null ids count as none, an id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([bpe.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())})

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode the ids again, and return doc_id, n_tokens, ids_sha256, decoded_sha256 for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in chunks(batch):
                each, index, first = bpe.encode_many(part.column("text"))
                n = np.fromiter(map(len, each), np.int64, len(each))[index]
                said = [b"".join([b"," + bpe.names[i] for i in ids]) for ids in each]
                raw = [bpe.decode_bytes(ids) for ids in each]
                ids_sha, text_sha = [], []
                for a, b in zip(first, first[1:], strict=False):
                    places = index[a:b].tolist()
                    ids_sha.append(hashlib.sha256(b"".join(map(said.__getitem__, places))[1:]).hexdigest())
                    text = b"".join(map(raw.__getitem__, places))
                    try:
                        text.decode()
                    except UnicodeDecodeError:
                        text = text.decode("utf-8", "replace").encode()
                    text_sha.append(hashlib.sha256(text).hexdigest())
                counts = np.diff(np.concatenate(([0], np.cumsum(n)))[first])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_tokens": pa.array(counts), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
