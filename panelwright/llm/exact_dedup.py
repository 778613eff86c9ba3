"""Exact deduplication with a cuckoo-filter index.

Texts are equal when identical after lower-casing A-Z only; the key of a text is the SHA-256 of its normalised
UTF-8 bytes. Map tasks merge the copies that they hold at once (so a group of any size sends one row per
``HELD_BYTES`` of distinct text), and contents are dealt into buckets by their key, as many as the total size
asks for, so that a bucket's contents are small. Each bucket has a cuckoo-filter index: a miss of the filter
is a new content for certain and enters filter and bucket; a hit is verified byte by byte against the contents
stored under that key, and either joins one of them or is new; overflow rebuilds a larger filter from the
stored keys. The groups are what the indexes hold at the end. ``update_index`` keeps the same index as a
table of live contents, from which deletions take copies back.

Edge cases: a null text counts as empty; an empty table gives an empty result; rows that repeat a doc_id
with the same text share one verdict and both count in group_size; in a group without any doc_id keep_id is
null and its rows are kept; other columns of the input are ignored (``keep_one`` keeps them).
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.pieces import chunks
from panelwright.llm.rows import drop_rows
from panelwright.llm.storage import stored

SLOTS = 4
MAX_KICKS = 200
#: Distinct text that a map task holds while it merges copies, and text of a bucket on average.
HELD_BYTES, BUCKET_BYTES = 8 << 20, 1 << 20


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key has two buckets, either found from the other."""

    def __init__(self, buckets: int = 64, cells: bytes | None = None):
        self.mask = buckets - 1
        self.cells = array("H", cells if cells is not None else bytes(2 * SLOTS * buckets))

    @staticmethod
    def fingerprint(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def places(self, key: bytes, mark: int) -> tuple[int, int]:
        first = int.from_bytes(key[:8], "little") & self.mask
        return first, self.other(first, mark)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x9E3779B1 & self.mask)

    def slot(self, bucket: int, mark: int) -> int:
        at = bucket * SLOTS
        for i in range(at, at + SLOTS):
            if self.cells[i] == mark:
                return i
        return -1

    def may_hold(self, key: bytes) -> bool:
        mark = self.fingerprint(key)
        a, b = self.places(key, mark)
        return self.slot(a, mark) >= 0 or self.slot(b, mark) >= 0

    def put(self, key: bytes) -> bool:
        """False when the filter is too full; the caller then rebuilds a larger one."""
        mark = self.fingerprint(key)
        a, b = self.places(key, mark)
        for bucket in (a, b):
            if (i := self.slot(bucket, 0)) >= 0:
                self.cells[i] = mark
                return True
        bucket = b
        for kick in range(MAX_KICKS):
            i = bucket * SLOTS + kick % SLOTS
            mark, self.cells[i] = self.cells[i], mark
            bucket = self.other(bucket, mark)
            if (i := self.slot(bucket, 0)) >= 0:
                self.cells[i] = mark
                return True
        return False

    def drop(self, key: bytes) -> None:
        mark = self.fingerprint(key)
        for bucket in self.places(key, mark):
            if (i := self.slot(bucket, mark)) >= 0:
                self.cells[i] = 0
                return


class CuckooIndex:
    """One bucket: the filter in front of the stored contents by key, each with its live count and largest doc_id."""

    def __init__(self, buckets: int = 64):
        self.filter, self.live, self.hits, self.false_hits = CuckooFilter(buckets), {}, 0, 0

    def find(self, key: bytes, content: bytes) -> list | None:
        """The entry of a content that the filter may hold; a hit is checked against the stored contents."""
        if not self.filter.may_hold(key):
            return None
        self.hits += 1
        for entry in self.live.get(key, ()):
            if entry[0] == content:
                return entry
        self.false_hits += 1
        return None

    def add(self, key: bytes, content: bytes, n: int = 1, keep_id: int | None = None) -> bool:
        """True if the content is new."""
        if entry := self.find(key, content):
            entry[1] += n
            entry[2] = _larger(entry[2], keep_id)
            return False
        self.live.setdefault(key, []).append([content, n, keep_id])
        if not self.filter.put(key):
            self.resize()
        return True

    def remove(self, key: bytes, content: bytes, n: int = 1) -> bool:
        """Take back live copies; with the last one the content leaves filter and store. False if it was unknown."""
        entry = self.find(key, content)
        if not entry:
            return False
        entry[1] -= n
        if entry[1] <= 0:
            self.live[key].remove(entry)
            self.filter.drop(key)
            if not self.live[key]:
                del self.live[key]
        return True

    def resize(self) -> None:
        """Rebuild from the stored keys at twice the size, again while they overflow."""
        buckets = (self.filter.mask + 1) * 2
        while True:
            larger = CuckooFilter(buckets)
            if all(larger.put(key) for key, entries in self.live.items() for _ in entries):
                self.filter = larger
                return
            buckets *= 2


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return pc.ascii_lower(pc.fill_null(batch.column("text"), "")).cast(pa.binary()).to_pylist()


CONTENTS = "key binary, content binary, n long, keep_id long"


def _contents(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("key", "content", "n", "keep_id"), columns, kinds, strict=True)})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents with the number of copies and the largest doc_id of a map task, given on whenever ``HELD_BYTES`` are held."""
    held: dict[bytes, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        return _contents([(hashlib.sha256(c).digest(), c, n, i) for c, (n, i) in held.items()])

    for batch in (part for whole in batches for part in chunks(whole)):
        for content, doc_id in zip(_texts(batch), batch.column("doc_id").to_pylist(), strict=True):
            if found := held.get(content):
                found[0] += 1
                found[1] = _larger(found[1], doc_id)
                continue
            held[content] = [1, doc_id]
            size += len(content) + 100
            if size > HELD_BYTES:
                yield flush()
                held.clear()
                size = 0
    yield flush()


def contents(docs: DataFrame) -> DataFrame:
    """(key, content, n, keep_id): the normalised texts, copies merged by map tasks."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_merged, CONTENTS)


def _buckets(*tables: DataFrame) -> int:
    """How many buckets the total size of the texts (or contents) asks for."""
    total = 0
    for t in tables:
        size = F.octet_length("content" if "content" in t.columns else F.col("text").cast("string"))
        total += t.agg(F.sum(size.cast("long"))).first()[0] or 0
    return max(1, total // BUCKET_BYTES)


def _indexed(rows: DataFrame, buckets: int) -> DataFrame:
    """The live contents after an index a bucket took in ``rows`` (CONTENTS) and then took back those of negative n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, CuckooIndex()

        def close() -> pa.RecordBatch:
            return _contents([(key, *entry) for key, entries in index.live.items() for entry in entries])

        for batch in (part for whole in batches for part in chunks(whole, "content")):
            for bucket, key, content, n, keep_id in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "content", "n", "keep_id")), strict=True):
                if bucket != at:
                    yield close()
                    at, index = bucket, CuckooIndex()
                if n > 0:
                    index.add(key, content, n, keep_id)
                else:
                    index.remove(key, content, -n)
        yield close()

    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    dealt = rows.select(bucket, "key", "content", "n", "keep_id").repartition("bucket").sortWithinPartitions("bucket", F.col("n") < 0)
    return dealt.mapInArrow(run, CONTENTS)


def content_groups(docs: DataFrame) -> DataFrame:
    """One row (key, n_bytes, n, keep_id) per distinct content, as the indexes hold them."""
    found = _indexed(contents(docs), _buckets(docs))
    return found.select("key", F.octet_length("content").cast("long").alias("n_bytes"), "n", "keep_id")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in chunks(whole)):
        raw = _texts(batch)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "key": pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), "n_bytes": pa.array(list(map(len, raw)), pa.int64()),
        })


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = rows.mapInArrow(_keyed, "doc_id long, key binary, n_bytes long").alias("d")
    groups = content_groups(docs).alias("g")
    return keyed.join(groups, (F.col("d.key") == F.col("g.key")) & (F.col("d.n_bytes") == F.col("g.n_bytes"))).select(
        F.col("d.doc_id"),
        F.col("g.keep_id"),
        F.col("g.n").alias("group_size"),
        F.col("d.doc_id").eqNullSafe(F.col("g.keep_id")).alias("kept"),
        F.lower(F.hex("d.key")).alias("text_sha256"),
    )


def normalised_sha256(text: Column) -> Column:
    upper = "".join(map(chr, range(0x41, 0x5B)))
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower()), 256)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, one row of each set of equal texts: one with the kept doc_id, or any where none has a doc_id.

    Rows are named by doc_id and text, so null and repeated doc_ids lose no text.
    """
    verdicts = stored(exact_dedup(docs), "exact-verdicts").withColumnRenamed("text_sha256", "row_key")
    repeated = verdicts.where("kept").groupBy("doc_id", "row_key").count().where("count > 1")
    return drop_rows(docs, verdicts.where("NOT kept"), repeated, normalised_sha256)


def update_index(state: DataFrame | None, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The live contents (key, content, n, keep_id) after inserting one set of documents and deleting another; ``state`` is a former result or None.

    The result may be written and used as ``state`` later; buckets are dealt anew by the size of all. keep_id
    is the largest doc_id ever inserted for a content that is still live. Taking back an unknown text does nothing.
    """
    rows, tables = contents(added), [added]
    if removed is not None:
        rows = rows.union(contents(removed).withColumn("n", -F.col("n")))
        tables.append(removed)
    if state is not None:
        rows = rows.union(state.select("key", "content", "n", "keep_id"))
        tables.append(state)
    return _indexed(rows, _buckets(*tables))


def seen_before(state: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id of each row and whether the index holds a live copy of its text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = rows.mapInArrow(_keyed, "doc_id long, key binary, n_bytes long")
    held = _indexed(state.select("key", "content", "n", "keep_id"), _buckets(state))
    live = held.select(F.col("key").alias("of"), F.octet_length("content").cast("long").alias("size"))
    return keyed.join(live, (keyed.key == live.of) & (keyed.n_bytes == live.size), "left").select("doc_id", F.col("of").isNotNull().alias("seen"))


def op9(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
