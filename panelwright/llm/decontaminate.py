"""Benchmark decontamination by normalised word n-grams.

A-Z are lower-cased; words are runs of digits, a-z and characters beyond ASCII. A window is ten consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. The set of windows is
broadcast while it is within ``BROADCAST_WINDOWS`` and ``BROADCAST_BYTES``; each text is scanned once for runs of words that all
occur in the benchmark, candidates are found by hash and verified word by word. A benchmark beyond these
bounds gives the same results by a shuffled join of 128-bit digests of the windows, salted so that a window of
many documents is dealt to ``SALTS`` tasks; items are attached to distinct windows afterwards. Its rows are named by
doc_id and SHA-256 of the text, so null and repeated doc_ids are judged as in a broadcast.

Edge cases: a null text has no words; items with null id or no words have no windows; items with equal
windows are all named; repeated rows are judged each; an empty benchmark hits nothing; other columns of
either table are ignored (and kept by the cleaning functions).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.pieces import chunks
from panelwright.llm.rows import drop_rows, parted, text_key
from panelwright.llm.storage import stored

WINDOW = 10
#: So many windows of so many bytes in all are broadcast; more are joined.
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 64 << 20
SALTS = 16

_SEPARATES = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(0x20 if b in set(_SEPARATES) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [b or b"" for b in batch.column("text").cast(pa.binary()).to_pylist()]


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (gram, item_id): gram has its words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, ids = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), _raw(batch), strict=True):
                w = words(text)
                found = {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w and item is not None else ()
                grams += found
                ids += [item] * len(found)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(grams, pa.binary()), "item_id": pa.array(ids, pa.string())})

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "gram binary, item_id string").distinct()


class Scanner:
    """Finds windows in many texts at once. ``grams``: (gram, item_id) pairs."""

    def __init__(self, grams: list[tuple[bytes, str]]):
        self.number: dict[bytes, int] = {}
        self.items: dict[bytes, list[str]] = {}
        by_size: dict[int, set[bytes]] = {}
        for gram, item in grams:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in gram.split(b" ")], np.int32)
            self.items.setdefault(ids.tobytes(), []).append(item)
            by_size.setdefault(len(ids), set()).add(ids.tobytes())
        rng = np.random.default_rng(7)
        self.mix = rng.integers(1, 2**63, 64 if not by_size else max(by_size) + 1, dtype=np.uint64) | np.uint64(1)
        self.hashes = {n: np.unique(self.hash(np.frombuffer(b"".join(keys), np.int32).reshape(-1, n))) for n, keys in by_size.items()}

    def hash(self, grid: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grid), np.uint64)
        for j in range(grid.shape[1]):
            out = (out ^ grid[:, j].astype(np.uint64)) * self.mix[j]
            out ^= out >> np.uint64(29)
        return out

    def scan(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, set[str]]]:
        """For each text: number of words, mask of hit words, items found."""
        cut = [words(t) for t in texts]
        sizes = np.array([len(w) for w in cut])
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # a stop after each text
        flat = np.fromiter(map(self.number.get, chain.from_iterable(w + [b""] for w in cut), repeat(0)), np.int32, starts[-1])
        hit, items = np.zeros(len(flat) + 1, np.int32), [set() for _ in texts]
        unknown = np.concatenate(([0], np.cumsum(flat == 0)))
        for n, known in self.hashes.items():
            at = np.flatnonzero(unknown[n:] == unknown[:-n]) if len(flat) >= n else np.zeros(0, np.int64)
            for lo in range(0, len(at), 1 << 18):
                some = at[lo : lo + (1 << 18)]
                grid = flat[some[:, None] + np.arange(n)]
                value = self.hash(grid)
                place = np.minimum(np.searchsorted(known, value), len(known) - 1)
                for i in np.flatnonzero(known[place] == value):
                    if found := self.items.get(grid[i].tobytes()):
                        hit[some[i]] += 1
                        hit[some[i] + n] -= 1
                        items[np.searchsorted(starts, some[i], "right") - 1].update(found)
        covered = np.cumsum(hit[:-1]) > 0
        return [(int(k), covered[s : s + k], f) for k, s, f in zip(sizes, starts, items, strict=False)]


def small_windows(benchmark: DataFrame, size: int = WINDOW) -> list[tuple[bytes, str]] | None:
    """The windows for a broadcast, or None where there are more than may be broadcast."""
    found = windows(benchmark, size)
    n, total = found.agg(F.count(F.lit(1)), F.sum(F.octet_length("gram") + F.octet_length("item_id"))).first()
    return [(bytes(g), i) for g, i in found.collect()] if n <= BROADCAST_WINDOWS and (total or 0) <= BROADCAST_BYTES else None


FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _verdict(ids: list, n_words: list[int], n_hit: list[int], items: list[set[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(i) for i in items], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items], pa.string()), "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_()),
    })


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    grams = small_windows(benchmark, size)
    if grams is None:
        return _joined(rows, benchmark, size)
    sent = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value)
        for batch in (part for whole in batches for part in chunks(whole)):
            found = scanner.scan(_raw(batch))
            yield _verdict(batch.column("doc_id").to_pylist(), [k for k, _, _ in found], [int(m.sum()) for _, m, _ in found], [f for _, _, f in found])

    return rows.mapInArrow(run, FOUND)


def _digest(gram: bytes) -> bytes:
    return hashlib.blake2b(gram, digest_size=16).digest()


def _keyed_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(window, item_id): digest of each window and the items that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"window": pa.array([_digest(g) for g in batch.column("gram").to_pylist()], pa.binary()), "item_id": batch.column("item_id")})

    return windows(benchmark, size).mapInArrow(run, "window binary, item_id string")


def _hits(rows: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """(h_doc, h_key, at, n, window): documents' windows of n words from word ``at`` that are the benchmark's, by a salted join of their digests."""
    sizes = sorted({r[0] for r in windows(benchmark, size).select(F.size(F.split(F.col("gram").cast("string"), " "))).distinct().collect()})  # at most ``size`` rows

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _raw(batch), strict=True):
                w, key = words(text), hashlib.sha256(text).digest()
                places = [(i, n) for n in sizes for i in range(len(w) - n + 1)]
                for lo in range(0, len(places), 20_000):
                    at, n = zip(*places[lo : lo + 20_000], strict=True)
                    found = [_digest(b" ".join(w[i : i + k])) for i, k in places[lo : lo + 20_000]]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id] * len(at), pa.int64()), "text_key": pa.array([key] * len(at), pa.binary()), "at": pa.array(at, pa.int64()), "n": pa.array(n, pa.int64()), "window": pa.array(found, pa.binary())})

    at = rows.dropDuplicates().mapInArrow(spread, "doc_id long, text_key binary, at long, n long, window binary")
    salted = at.withColumn("salt", F.pmod(F.xxhash64("text_key", "doc_id"), F.lit(SALTS)))
    known = _keyed_windows(benchmark, size).select("window").distinct()
    known = known.select("window", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return salted.join(known, ["window", "salt"]).select(F.col("doc_id").alias("h_doc"), F.col("text_key").alias("h_key"), "at", "n", "window")


def _salted(hot: DataFrame, few: DataFrame, on: str, spread: list[str]) -> DataFrame:
    """``hot`` joined with ``few`` by ``on``, each key of which is dealt over ``SALTS`` tasks by the columns ``spread``."""
    left = hot.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    right = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, [on, "salt"]).drop("salt")


def _items_of(found: DataFrame, keyed: DataFrame, key: list[str]) -> DataFrame:
    """(key, item_id) of the hits ``found`` (key, window), given ``keyed`` (window, item_id).

    Windows that have the same items are one: their first stands for the set. A document meets each set once, and
    a set's items as rows, so no window gathers its items and none is joined by all its documents in one task.
    """
    signs = ["count(*) AS n", "bit_xor(xxhash64(item_id)) AS a", "bit_xor(xxhash64(item_id, 'again')) AS b"]
    sets = stored(keyed.groupBy("window").agg(*map(F.expr, signs)), "item-sets")
    firsts = sets.groupBy("n", "a", "b").agg(F.min("window").alias("of"))
    set_of = sets.join(firsts, ["n", "a", "b"]).select("window", "of")
    met = _salted(found.select(*key, "window").distinct(), set_of, "window", key).select(*key, "of").distinct()
    members = keyed.join(firsts.select(F.col("of").alias("window")), "window").select(F.col("window").alias("of"), "item_id")
    return _salted(met, members, "of", key).select(*key, "item_id").distinct()


def _joined(rows: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """``contamination`` without a broadcast."""

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _raw(batch)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_key": pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary()), "n_words": pa.array([len(words(t)) for t in raw], pa.int64())})

    found, key = stored(_hits(rows, benchmark, size), "benchmark-hits"), ["h_doc", "h_key"]
    hit = found.select(*key, F.explode(F.expr("sequence(at, at + n - 1)")).alias("word")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("hits"))
    items = _items_of(found, stored(_keyed_windows(benchmark, size), "benchmark-windows"), key)
    items = items.groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    all_rows = rows.mapInArrow(base, "doc_id long, text_key binary, n_words long")
    items = items.withColumnsRenamed({"h_doc": "i_doc", "h_key": "i_key"})
    both = hit.join(items, F.expr("h_doc <=> i_doc AND h_key = i_key"))
    n_hit, names = F.coalesce("hits", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return all_rows.join(both, F.expr("doc_id <=> h_doc AND text_key = h_key"), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with all its columns, without rows that hold a benchmark window."""
    return _cleaned(docs, benchmark, size, spans=False)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with all its columns and rows; in texts that hold a benchmark window the hit words are cut out, other text stays as it was."""
    return _cleaned(docs, benchmark, size, spans=True)


def _cut(text: bytes, mask: np.ndarray) -> bytes:
    out, end, plain = [], 0, text.translate(_TABLE)
    at = 0
    for word, hit in zip(plain.split(), mask, strict=True):
        at = plain.index(word, at)
        if hit:
            out.append(text[end:at])
            end = at + len(word)
        at += len(word)
    return b"".join([*out, text[end:]])


def _cleaned(docs: DataFrame, benchmark: DataFrame, size: int, spans: bool) -> DataFrame:
    grams = small_windows(benchmark, size)
    if grams is None:
        return _cleaned_by_join(docs, benchmark, size, spans)
    sent = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value)
        for batch in (part for whole in batches for part in chunks(whole)):
            raw = _raw(batch)
            masks = [m for _, m, _ in scanner.scan(raw)]
            hit = [bool(m.any()) for m in masks]
            if not spans:
                yield batch.filter(pa.array([not h for h in hit], pa.bool_()))
                continue
            was = batch.column("text").to_pylist()
            text = [_cut(r, m).decode("utf-8", "replace") if h else t for t, r, m, h in zip(was, raw, masks, hit, strict=True)]
            yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(text, batch.schema.field("text").type))

    return docs.mapInArrow(run, docs.schema)


def _cleaned_by_join(docs: DataFrame, benchmark: DataFrame, size: int, spans: bool) -> DataFrame:
    hits = _hits(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark, size)
    if not spans:
        return drop_rows(docs, hits.select(F.col("h_doc").alias("doc_id"), F.lower(F.hex("h_key")).alias("row_key")))
    places, v_doc, v_key = (f"{name}_{uuid.uuid4().hex}" for name in ("spans", "doc", "key"))
    where = hits.groupBy(F.col("h_doc").alias(v_doc), F.col("h_key").alias(v_key)).agg(F.collect_set(F.struct("at", "n")).alias(places))
    where = stored(where, "benchmark-places")
    asked, others = parted(docs, where.select(F.col(v_doc).alias("doc_id")))
    same = asked["doc_id"].cast("long").eqNullSafe(F.col(v_doc)) & (F.unhex(text_key(asked["text"])) == F.col(v_key))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            text = batch.column(place).to_pylist()
            for i, (raw, found) in enumerate(zip(_raw(batch), batch.column(places).to_pylist(), strict=True)):
                if found:
                    mask = np.zeros(len(words(raw)), bool)
                    for hit in found:
                        mask[hit["at"] : hit["at"] + hit["n"]] = True
                    text[i] = _cut(raw, mask).decode("utf-8", "replace")
            cut = batch.set_column(place, batch.schema.field(place), pa.array(text, batch.schema.field(place).type))
            yield cut.select(names)

    cut = asked.join(where, same, "left").select(*[asked[c] for c in names], places).mapInArrow(run, docs.schema)
    return cut if others is None else cut.unionByName(others)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS gram
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0
), p AS (
  SELECT DISTINCT d.doc_id, g.item_id, i, n
  FROM (SELECT DISTINCT n FROM g) AS s(m), d, unnest(range(1, len(d.w) - m + 2)) AS r(i), g
  WHERE g.n = m AND g.gram = array_to_string(d.w[i : i + m - 1], ' ')
), h AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM p, unnest(range(0, n)) AS r(k) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256 FROM p GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  coalesce(t.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
