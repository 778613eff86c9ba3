"""Finding and removing rows that are named by doc_id and text, so that null and repeated doc_ids lose no other row."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.storage import stored

#: So many doc_ids are broadcast at most (some 30 MB).
BROADCAST_IDS = 2_000_000


def text_key(text: Column) -> Column:
    """SHA-256 of the whole text; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def own_name(what: str) -> str:
    """A column name that no table has."""
    return f"{what}_{uuid.uuid4().hex}"


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ``docs`` whose doc_id is one of ``ids`` (doc_id), the others), by a broadcast of counted ids.

    With more than ``BROADCAST_IDS`` ids all rows come first and None second: then a join has to shuffle them.
    """
    name = own_name("id")
    ids = ids.select(F.col("doc_id").alias(name)).distinct()
    if ids.count() > BROADCAST_IDS:
        return docs, None
    few, same = F.broadcast(ids), docs["doc_id"].cast("long").eqNullSafe(F.col(name))
    return docs.join(few, same, "left_semi"), docs.join(few, same, "left_anti")


def drop_rows(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None, key=text_key) -> DataFrame:
    """``docs`` with all its columns, without the rows named in ``gone``, and with one of each of those named in ``once``.

    Both tables have columns doc_id (may be null) and row_key, which is compared with ``key`` of the text. Only rows
    that share a doc_id with them are shuffled while these ids are few enough for a broadcast. Helper columns
    have names of their own, so any column of ``docs`` is safe.
    """
    here, v_doc, v_key, single = (own_name(n) for n in ("key", "doc", "text", "single"))
    named = gone.select("doc_id", "row_key", F.lit(False).alias(single))
    if once is not None:
        named = named.union(once.select("doc_id", "row_key", F.lit(True)))
    named = stored(named.distinct(), "named-rows")
    asked, others = parted(docs, named)
    keyed = asked.withColumn(here, key(asked["text"]))
    same = keyed["doc_id"].cast("long").eqNullSafe(F.col(v_doc)) & (keyed[here] == F.col(v_key))
    names = lambda which: named.where(F.col(single) == which).select(F.col("doc_id").alias(v_doc), F.col("row_key").alias(v_key))
    left = keyed.join(names(False), same, "left_anti")
    if not names(True).isEmpty():
        left = left.join(names(True), same, "left_anti").unionByName(left.join(names(True), same, "left_semi").dropDuplicates(["doc_id", here]))
    left = left.drop(here)
    return left if others is None else left.unionByName(others)
