"""Language identification by words first, then by shorter and shorter character n-grams.

A word of the model scores by its log frequency in each language. A word the model doesn't know scores by
the mean log frequency of its character n-grams, of the longest order from five down of which the model
knows any. A text's score is the softmax of the mean over its words, sharpened with their number.

The model is fitted on a bounded sample of labelled rows: of each language at most ``rows_per_language``
different texts on average, chosen by a hash of doc_id. It holds every word of the sample and every n-gram of
these words, so its size is bounded by the sample. A prediction sees the text alone.

Edge cases: a null text or one without a letter is ``und`` with score 0; with no labelled text at all every
text is; a row with null doc_id is neither learned from nor held out; equal scores go to the language that
sorts first; repeated rows are predicted each; other columns of the input are ignored (and kept by the filter).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.pieces import chunks
from panelwright.llm.storage import stored

UNKNOWN = "und"
ORDERS = range(5, 0, -1)
#: Different texts of a language to learn from, on average.
ROWS_PER_LANGUAGE = 1000
#: Words remembered by a worker at once.
REMEMBERED = 200_000
#: N-grams of words that the model doesn't know, looked up together.
PIECE = 50_000

_TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased runs of a-z and of bytes beyond ASCII."""
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split()


def grams(word: bytes, n: int) -> list[str]:
    w = f"<{word.decode('utf-8', 'replace')}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def pieces_of(word: bytes, n: int) -> Iterator[list[str]]:
    """``grams`` of a word, ``PIECE`` at a time."""
    w = f"<{word.decode('utf-8', 'replace')}>"
    for lo in range(0, len(w) - n + 1, PIECE):
        yield [w[i : i + n] for i in range(lo, min(lo + PIECE, len(w) - n + 1))]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in chunks(whole)):
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(words(text))
        for lang, counts in found.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counts), pa.string()), "word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})


def _to_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            for order in ORDERS:
                for g in grams(word, order):
                    found[lang, g] += n
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in found], pa.string()), "gram": pa.array([k[1] for k in found], pa.string()), "n": pa.array(list(found.values()), pa.int64())})


class Keys:
    """Sorted byte strings as one array, with a dictionary for the few longer ones; nothing of Python's size a key."""

    WIDTH = 24

    def __init__(self, keys: list[bytes]):
        short = np.array([len(k) <= self.WIDTH for k in keys], bool)
        packed = np.array([k for k, s in zip(keys, short, strict=True) if s], f"S{self.WIDTH}")
        order = np.argsort(packed, kind="stable")
        self.short, self.rows = packed[order], np.flatnonzero(short)[order]
        self.long = {keys[i]: int(i) for i in np.flatnonzero(~short)}

    def find(self, asked: list[bytes]) -> np.ndarray:
        """The place of each key in the list that this was made of, or -1."""
        out = np.full(len(asked), -1, np.int64)
        if len(self.short) and asked:
            wanted = np.array(asked, f"S{self.WIDTH}")  # cuts longer keys, which are looked up below
            at = np.minimum(np.searchsorted(self.short, wanted), len(self.short) - 1)
            out = np.where(self.short[at] == wanted, self.rows[at], -1)
        for i, key in enumerate(asked):
            if len(key) > self.WIDTH:
                out[i] = self.long.get(key, -1)
        return out


def _table(counts: DataFrame, key: str, languages: list[str]) -> tuple[Keys, np.ndarray]:
    """The keys of the sample, and for each a row of log frequencies by language, less their mean."""
    by = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(languages)]
    found = counts.groupBy(F.col(key).cast("binary").alias(key)).agg(*by).orderBy(key).toArrow()
    n = np.column_stack([found.column(f"n{i}").to_numpy() for i in range(len(languages))]).astype(float)
    log = np.log((n + 0.1) / (n.sum(axis=0) + 0.1 * len(n) + 1))
    return Keys(found.column(key).to_pylist()), (log - log.mean(axis=1, keepdims=True)).astype(np.float32)


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> dict:
    """A model from rows (doc_id, text, lang); its size is bounded by ``rows_per_language`` and the number of languages."""
    rows = labelled.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {lang: n for lang, n in rows.groupBy("lang").count().collect()}  # a row a language
    model = {"languages": sorted(sizes)}
    if not sizes:
        return model | dict.fromkeys(("words", "grams"), (Keys([]), np.zeros((0, 1), np.float32)))
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, min(1.0, rows_per_language / n)).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
    different = sample.dropDuplicates(["lang", "text"]).select("lang", "text")
    counted = stored(different.mapInArrow(_counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    grams_of = counted.mapInArrow(_to_grams, "lang string, gram string, n long")
    return model | {"words": _table(counted, "word", model["languages"]), "grams": _table(grams_of, "gram", model["languages"])}


class Scorer(dict):
    """word -> row of ``table`` for words met; beyond ``REMEMBERED`` of them all are forgotten and met anew. The model's arrays stay as they were sent."""

    def __init__(self, model: dict):
        super().__init__()
        self.languages, (self.known, self.known_rows), (self.grams, self.gram_rows) = model["languages"], model["words"], model["grams"]
        self.table = np.zeros((REMEMBERED, self.known_rows.shape[1]), np.float32)

    def meet(self, words_: set[bytes]) -> None:
        """See to it that all of ``words_`` have a row."""
        new = [w for w in words_ if w not in self]
        if len(self) + len(new) > len(self.table):
            self.clear()
            new = list(words_)
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), self.table.shape[1]), np.float32)
        for lo in range(0, len(new), 10_000):
            some, first = new[lo : lo + 10_000], len(self)
            at = self.known.find(some)
            rows = np.zeros((len(some), self.table.shape[1]), np.float32)
            rows[at >= 0] = self.known_rows[at[at >= 0]]
            unseen = np.flatnonzero(at < 0)
            if len(unseen):
                rows[unseen] = self.unseen([some[i] for i in unseen])
            self.table[first : first + len(some)] = rows
            self.update((w, first + i) for i, w in enumerate(some))

    def unseen(self, words_: list[bytes]) -> np.ndarray:
        """A row a word: the mean of its n-grams of the longest order of which any is known, zeros without one."""
        out, left = np.zeros((len(words_), self.table.shape[1]), np.float32), np.arange(len(words_))
        for order in ORDERS:
            if not len(left) or not len(self.gram_rows):
                break
            sums, n = self.sums([words_[i] for i in left], order)
            out[left] = sums / np.maximum(n, 1)[:, None]
            left = left[n == 0]
        return out

    def sums(self, words_: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the known n-grams of each word added up, number of them), ``PIECE`` n-grams at a time, however long a word."""
        total, n = np.zeros((len(words_), self.table.shape[1])), np.zeros(len(words_))
        owner: list[int] = []
        asked: list[bytes] = []

        def look_up() -> None:
            at = self.grams.find(asked)
            mine, at = np.array(owner, np.int64)[at >= 0], at[at >= 0]
            for j in range(total.shape[1]):
                total[:, j] += np.bincount(mine, self.gram_rows[at, j], len(words_))
            n[:] += np.bincount(mine, minlength=len(words_))
            owner.clear()
            asked.clear()

        for i, word in enumerate(words_):
            for part in pieces_of(word, order):
                asked.extend(g.encode("utf-8", "replace") for g in part)
                owner.extend([i] * len(part))
                if len(asked) >= PIECE:
                    look_up()
        look_up()
        return total, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at, size, each = [], 0, []
        for i, text in enumerate(texts):
            if text and self.languages and any(map(str.isalpha, text)):
                at.append(i)
                each.append(words(text))
                size += len(each[-1])
            if size and (size > 100_000 or i == len(texts) - 1):
                self.meet(set().union(*each))
                count = np.array([len(w) for w in each])
                rows = np.fromiter((r for w in each for r in map(self.__getitem__, w)), np.int64, size)
                mean = np.add.reduceat(self.table[rows], np.concatenate(([0], np.cumsum(count)[:-1]))) / count[:, None]
                z = mean.astype(float) * np.minimum(count, 20)[:, None]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for j, k in enumerate(at):
                    best = int(p[j].argmax())
                    labels[k], scores[k] = self.languages[best], round(float(p[j, best]), 6)
                at, size, each = [], 0, []
        return labels, scores


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in (part for whole in batches for part in chunks(whole)):
            labels, scores = scorer.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(labels, pa.string()), "score": pa.array(scores, pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict, least_score: float = 0.3) -> DataFrame:
    """``docs`` with all its columns, without rows whose language can't be told or scores under ``least_score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in (part for whole in batches for part in chunks(whole)):
            labels, scores = scorer.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and s >= least_score for lang, s in zip(labels, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learned_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: labelled and not held out."""
    return docs.where(~held_out()).select("doc_id", "text", "lang")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(learned_rows(docs)))
