"""Hard negatives by a vector-approximation file.

All vectors are written once to files in the shared folder, in blocks. A block quantises each dimension into
cells between quantiles of its own values and holds the cell numbers (a byte each) beside the exact vectors. For
an anchor, a table by dimension and cell has the least and the greatest product that a value in the cell can give;
adding up table entries bounds the score of each vector without touching it. Only vectors whose bounds leave them
a place among the first few of a window are scored exactly. A task reads one file and streams the anchors past
it from their own files, so neither side is broadcast or gathered; it returns the first few rows of each
anchor that it has seen, and a window over these (some per anchor and task) gives the first few of all.

Two passes: the first finds an anchor's positives (the best rows of its label), the second the rows of other labels
with ``low * positive <= 100 * negative <= high * positive``. Both are exact; bounds only save work. With
non-uniform cells outliers cost nothing, and a block without any help from its bounds is scored in full.

Edge cases: rows with a null label, a null vector or a null or non-finite component take no part; vectors of
different lengths are compared over the common ones (missing components count as 0); a null vec_id is never an
anchor, comes last among ties, and is returned as null; rows that repeat a vec_id are candidates each, but never of
an anchor with that vec_id, and equal anchors count once; ties go by vec_id; an anchor without another row of its label, or
with none in its windows, gives no rows; scores that may pass 63 bits raise ValueError; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.storage import AtomicFile, a_file_a_task, open_store, scratch, stored

CELLS = 64
#: A block has so many rows, or bytes of vectors, at most; bounds are computed for so many of its rows and anchors at a time.
ROWS_A_BLOCK, BYTES_A_BLOCK, ROWS_AT_ONCE, ANCHORS_AT_ONCE = 8192, 8 << 20, 2048, 64
#: A file has about so many rows, but there are enough files for all cores while they have a thousand rows.
ROWS_A_FILE, FEWEST_ROWS = 1 << 17, 1024
#: Blocks held by a task while the anchors pass.
BYTES_HELD = 64 << 20
NO_ID, NONE = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)


def integers(column: pa.Array, scale: float = 1) -> np.ndarray:
    """Rows of floor(scale * x), or of whole numbers as they are, padded with zeros to the longest."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat if flat.dtype.kind == "i" else np.floor(flat * scale)
    if flat.size and max(-flat.min(), flat.max()) >= 2.0**62:
        raise ValueError("a component is beyond 62 bits")
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def block(ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> dict[str, np.ndarray]:
    """Rows in order of (label, id), cells by dimension, and the least and greatest value of each cell."""
    order = np.lexsort((ids, labels))
    ids, labels, q = ids[order], labels[order], q[order]
    n, dims = q.shape
    codes, low, high = np.zeros((dims, n), np.uint8), np.zeros((dims, CELLS), np.int64), np.zeros((dims, CELLS), np.int64)
    for d in range(dims):
        values = np.sort(q[:, d])
        points = values[np.arange(1, CELLS) * n // CELLS]
        codes[d] = np.searchsorted(points, q[:, d], side="right")
        first = np.concatenate([[0], np.searchsorted(values, points)])
        last = np.append(first[1:], n)
        full = first < last
        low[d, full], high[d, full] = values[first[full]], values[last[full] - 1]
    top = int(np.abs(q).max(initial=0))
    kind = next(k for k in (np.int16, np.int32, np.int64) if top <= np.iinfo(k).max)
    return {"ids": ids, "labels": labels, "q": q.astype(kind), "codes": codes, "low": low, "high": high}


def write_file(rows: DataFrame, scale: float, folder: str) -> DataFrame:
    """Write the approximations and vectors of ``rows`` (vec_id, label, embedding) in files of blocks; (path, rows) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = f"part-{TaskContext.get().partitionId():06d}.va", 0
        with AtomicFile(folder, name) as out:
            for ids, labels, q in blocks_of(batches, scale):
                data = io.BytesIO()
                np.savez(data, **block(ids, labels, q))
                out.write(len(data.getbuffer()).to_bytes(8, "little"))
                out.write(data.getvalue())
                total += len(ids)
        if total:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "rows": [total]})

    return stored(rows.mapInArrow(run, "path string, rows long"), "approximations")


def blocks_of(batches: Iterable[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held, n, size = [], 0, 0

    def joined():
        dims = max(q.shape[1] for _, _, q in held)
        return (*(np.concatenate([h[i] for h in held]) for i in (0, 1)), np.concatenate([np.pad(q, ((0, 0), (0, dims - q.shape[1]))) for _, _, q in held]))

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            q = integers(part.column("embedding"), scale)
            held.append((part.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False), part.column("label").to_numpy(zero_copy_only=False), q))
            n, size = n + len(q), size + q.nbytes
            if n >= ROWS_A_BLOCK or size >= BYTES_A_BLOCK:
                yield joined()
                held, n, size = [], 0, 0
    if held:
        yield joined()


def read_blocks(path: str) -> Iterator[list[dict[str, np.ndarray]]]:
    """The blocks of a file, as many at a time as ``BYTES_HELD``."""
    store, name = open_store(path)
    held, size = [], 0
    with store.open_input_stream(name, compression=None) as stream:
        while head := stream.read(8):
            with np.load(io.BytesIO(stream.read(int.from_bytes(head, "little")))) as data:
                held.append({k: data[k] for k in data.files})
            size += sum(x.nbytes for x in held[-1].values())
            if size >= BYTES_HELD:
                yield held
                held, size = [], 0
    if held:
        yield held


def bounds(b: dict[str, np.ndarray], rows: slice, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each row (first axis) with each anchor, by looking up the table of each dimension."""
    codes, dims = b["codes"][:, rows], min(len(b["codes"]), anchors.shape[1])
    low, high = (np.zeros((codes.shape[1], len(anchors)), np.int64) for _ in range(2))
    found = np.empty_like(low)
    for d in range(dims):
        x, y = np.multiply.outer(b["low"][d], anchors[:, d]), np.multiply.outer(b["high"][d], anchors[:, d])
        for total, table in ((low, np.minimum(x, y)), (high, np.maximum(x, y))):
            total += np.take(table, codes[d], axis=0, out=found, mode="clip")
    return low, high


def scores(b: dict[str, np.ndarray], rows: np.ndarray, anchors: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact scores of pairs (row, anchor), a slice of them at a time."""
    dims, out = min(b["q"].shape[1], anchors.shape[1]), np.zeros(len(rows), np.int64)
    step = max(1, (8 << 20) // max(1, 8 * dims))
    for at in range(0, len(rows), step):
        some = slice(at, at + step)
        out[some] = np.einsum("ij,ij->i", b["q"][rows[some], :dims].astype(np.int64), anchors[which[some], :dims])
    return out


class Best:
    """The first ``k`` rows of each of ``n`` rankings: higher score first, then smaller id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.which, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.last = np.full(n, NONE)  # the score that a ranking's last place asks for, once it is full

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        which, score, ids = (np.concatenate(x) for x in ((self.which, which), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, which))
        which, score, ids = which[order], score[order], ids[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        keep = place < self.k
        self.which, self.score, self.ids = which[keep], score[keep], ids[keep]
        full = place[keep] == self.k - 1
        self.last[self.which[full]] = self.score[full]


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each column, or ``NONE`` where there are fewer."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k] if len(values) >= k else np.full(values.shape[1], NONE)


def checked(b: dict[str, np.ndarray], anchors: np.ndarray) -> None:
    if int(np.abs(b["q"]).max(initial=0).astype(object)) * int(np.abs(anchors).max(initial=0)) * max(1, anchors.shape[1]) >= 1 << 63:
        raise ValueError("scores may pass 63 bits")


def search(b: dict[str, np.ndarray], ids: np.ndarray, anchors: np.ndarray, label: int, lows: np.ndarray | None, highs: np.ndarray | None, best: Best) -> None:
    """Put the rows of a block into the rankings of ``anchors``, all of one ``label``.

    Without windows: the rows of that label, a ranking an anchor. With windows (anchors x windows): the rows of other
    labels whose score is within a window, a ranking a window.
    """
    checked(b, anchors)
    begin, end = np.searchsorted(b["labels"], [label, label + 1])
    spans = [(begin, end)] if lows is None else [(0, begin), (end, len(b["labels"]))]
    for rows in (slice(at, min(at + ROWS_AT_ONCE, last)) for first, last in spans for at in range(first, last, ROWS_AT_ONCE)):
        low, high = bounds(b, rows, anchors)
        known = b["ids"][rows]
        own = known[:, None] == ids
        low[own] = high[own] = NONE
        for w in range(1 if lows is None else lows.shape[1]):
            if lows is None:
                ask, within, place = np.full(len(ids), NONE + 1), True, np.arange(len(ids))
                sure = low
            else:
                ask, place = lows[:, w], np.arange(len(ids)) * lows.shape[1] + w
                within = low <= highs[:, w]
                sure = np.where((low >= ask) & (high <= highs[:, w]), low, NONE)
            ask = np.maximum(ask, np.maximum(best.last[place], kth(sure, best.k)))
            row, which = np.nonzero((high >= ask) & within & ~own)
            exact = scores(b, row + rows.start, anchors, which)
            if lows is not None:
                keep = (exact >= lows[which, w]) & (exact <= highs[which, w])
                row, which, exact = row[keep], which[keep], exact[keep]
            best.add(place[which], exact, known[row])


def scan(files: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each ranking and task: (anchor_id, anchor_key, window, score, id).

    ``anchors``: (anchor_id, anchor_key, label, q array<long>, lows array<long>, highs array<long>), a stored table;
    ``lows`` null: rows of the same label, window 0; else a window a place of the arrays.
    """
    uri = anchors.inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            for held in read_blocks(path):
                for file in uri:
                    store, name = open_store(file)
                    with store.open_input_file(name) as source:
                        for batch in pq.ParquetFile(source).iter_batches(4096):
                            yield from ranked(held, batch, k)

    return a_file_a_task(files).mapInArrow(run, "anchor_id long, anchor_key long, window int, score long, id long")


def ranked(held: list[dict[str, np.ndarray]], batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """Rankings of a batch of anchors over some blocks; anchors of one label and number of windows go together."""
    ids, keys, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor_id", "anchor_key", "label"))
    windows = batch.column("lows").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    groups = np.unique(np.stack([labels, windows]), axis=1).T
    for label, n in groups:
        for some in np.array_split(at := np.nonzero((labels == label) & (windows == n))[0], -(-len(at) // ANCHORS_AT_ONCE)):
            part = batch.take(pa.array(some))
            a = integers(part.column("q"))
            lows, highs = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(some), n) if n else None for c in ("lows", "highs"))
            best = Best(len(some) * max(1, n), k)
            for b in held:
                search(b, ids[some], a, label, lows, highs, best)
            anchor, window = best.which // max(1, n), best.which % max(1, n)
            yield pa.RecordBatch.from_pydict({
                "anchor_id": ids[some][anchor], "anchor_key": keys[some][anchor], "window": pa.array(window, pa.int32()), "score": best.score, "id": best.ids,
            })


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each ranking over all tasks, with their ``rank``."""
    order = Window.partitionBy("anchor_id", "anchor_key", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("id", F.when(F.col("id") != int(NO_ID), F.col("id")))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256) -> DataFrame:
    """Hard negatives of each anchor and positive: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: vec_id, label, embedding; ``is_anchor``: a condition on vec_id. Scores are products of floor(scale * x).
    """
    spark, rows = rows.sparkSession, usable(rows)
    n = rows.count()
    files = min(-(-n // FEWEST_ROWS), max(spark.sparkContext.defaultParallelism, -(-n // ROWS_A_FILE))) or 1
    approximations = write_file(rows.repartition(files), scale, scratch(spark, "vectors"))
    q = F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    anchors = rows.where(F.col("vec_id").isNotNull() & is_anchor).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", q).alias("anchor_key"), "label", q.alias("q"))
    none = F.lit(None).cast("array<long>")
    anchors = stored(anchors.dropDuplicates(["anchor_id", "anchor_key"]).withColumns({"lows": none, "highs": none}), "anchors")
    near = stored(first_of(scan(approximations, anchors, positives), positives), "positives")

    # 80 p <= 100 n <= 100 p, in whole numbers; a window for each score among an anchor's positives
    asked = near.groupBy("anchor_id", "anchor_key").agg(F.array_sort(F.collect_set("score")).alias("tops"))
    windows = asked.withColumns({
        "lows": F.expr(f"transform(tops, p -> (p * {low}L) div 100 + IF((p * {low}L) % 100 > 0, 1, 0))"),
        "highs": F.expr(f"transform(tops, p -> (p * {high}L) div 100 - IF((p * {high}L) % 100 < 0, 1, 0))"),
    })
    aimed = stored(anchors.drop("lows", "highs").join(windows, ["anchor_id", "anchor_key"]), "windows")
    hard = first_of(scan(approximations, aimed.drop("tops"), negatives), negatives)
    scored = aimed.select("anchor_id", "anchor_key", F.posexplode("tops").alias("window", "positive_score"))
    pairs = near.select("anchor_id", "anchor_key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(scored, ["anchor_id", "anchor_key", "positive_score"])
    return pairs.join(hard.select("anchor_id", "anchor_key", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "anchor_key", "window"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", noisy.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id))::INT AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
