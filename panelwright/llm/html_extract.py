"""Main text of web pages by a tree-structured graphical model over the DOM.

Elements and text blocks are nodes with a binary label, content or not. A node's potential is linear in
features of its tag, attributes, length and links; each parent-child pair has potentials by its kind.
Sum-product messages go up from the leaves and down from the root of each page, for all pages of a batch
at once, a level of the trees at a time, and give each node's marginal probability. Text blocks above one
half are the page's text. The weights maximise the likelihood of labelled pages; those are generated
(labelled_pages), ``TRAINING_PAGES`` of them, and the fit takes seconds on the driver.

Edge cases: a null or empty html gives the empty text; a page without content blocks does too; broken
markup is read as browsers do in the common cases (open paragraphs and list items end at the next); pages
of any length are read whole; repeated rows are extracted each; a null page_id or url is passed through;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.dom import EDGES, N_FEATURES, Node, Tree, edge_kinds, features
from panelwright.llm.labelled_pages import MARK, page

TRAINING_PAGES, ROUNDS = 360, 160


class Forest:
    """The trees of several pages as arrays, with their nodes by level."""

    def __init__(self, pages: list[list[Node]]):
        sizes = [len(p) for p in pages]
        self.n = sum(sizes)
        base = np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) if pages else np.zeros(0, np.int64)
        local = np.array([n.parent for p in pages for n in p], np.int64)
        self.parent = np.where(local < 0, -1, local + base)
        depth = np.array([n.depth for p in pages for n in p], np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if self.n else []
        each = [ids for p in pages for ids in features(p)]
        self.ids = np.array([i for ids in each for i in ids], np.int64)
        self.counts = np.array([len(ids) for ids in each], np.int64)
        self.kind = np.array([k for p in pages for k in edge_kinds(p)], np.int64)

    def marginals(self, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each label of each node, and of each pair of labels (parent's first) of a node with its parent."""
        own = np.zeros((self.n, 2))
        own[:, 1] = np.add.reduceat(w[self.ids], np.concatenate(([0], np.cumsum(self.counts)[:-1])))
        psi = pair[self.kind]
        below, up = own.copy(), np.zeros((self.n, 2))
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp(*np.moveaxis(psi[level] + below[level][:, None, :], 2, 0))
            np.add.at(below, self.parent[level], up[level])
        whole, joint = below.copy(), np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            above = whole[self.parent[level]] - up[level]  # the parent without this child
            both = above[:, :, None] + psi[level] + below[level][:, None, :]
            both -= both.max(axis=(1, 2), keepdims=True)
            whole[level] = below[level] + np.logaddexp(above[:, None, 0] + psi[level][:, 0, :], above[:, None, 1] + psi[level][:, 1, :])
            p = np.exp(both)
            joint[level] = p / p.sum(axis=(1, 2), keepdims=True)
        p = np.exp(whole - whole.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), joint


def labels_of(nodes: list[Node]) -> list[int]:
    """Labels of a marked page: of a text block by its mark, of an element by most of its text. Marks are removed."""
    content = [0] * len(nodes)
    marked = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.tag == "text":
            marked[i] = n.chars if MARK in n.text else 0
            n.text = n.text.replace(MARK, "")
        content[i] = int(2 * marked[i] > n.chars)
        if n.parent >= 0:
            marked[n.parent] += marked[i]
    return content


def train(pages: int = TRAINING_PAGES, rounds: int = ROUNDS, first_seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and pair potentials, by gradient ascent with momentum-free adaptive steps."""
    trees = [Tree(page(first_seed + s)).nodes for s in range(pages)]
    y = np.array([c for t in trees for c in labels_of(t)])
    forest = Forest(trees)
    w, pair = np.zeros(N_FEATURES), np.zeros((len(EDGES), 2, 2))
    seen_w, seen_p = np.full(N_FEATURES, 1e-8), np.full(pair.shape, 1e-8)
    child = np.flatnonzero(forest.parent >= 0)
    truth = np.zeros((forest.n, 2, 2))
    truth[child, y[forest.parent[child]], y[child]] = 1
    for _ in range(rounds):
        p, joint = forest.marginals(w, pair)
        g = np.bincount(forest.ids, np.repeat(y - p[:, 1], forest.counts), N_FEATURES) / pages - 0.002 * w
        q = np.stack([(truth - joint)[child][forest.kind[child] == k].sum(axis=0) for k in range(len(EDGES))]) / pages - 0.002 * pair
        seen_w, seen_p = 0.9 * seen_w + 0.1 * g * g, 0.9 * seen_p + 0.1 * q * q
        w += 0.08 * g / np.sqrt(seen_w + 1e-6)
        pair += 0.08 * q / np.sqrt(seen_p + 1e-6)
    return w, pair


@lru_cache(maxsize=1)
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return train()


def extract_many(htmls: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    trees = [Tree(h or "").nodes for h in htmls]
    p, _ = Forest(trees).marginals(*model)
    out, at = [], 0
    for nodes in trees:
        out.append("\n\n".join(n.text for n, q in zip(nodes, p[at : at + len(nodes), 1], strict=True) if n.tag == "text" and q > 0.5))
        at += len(nodes)
    return out


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = extract_many(part.column("html").to_pylist(), sent.value)
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
