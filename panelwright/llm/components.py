"""Connected components of a link table, as a loop of joins that hooks trees of nodes onto smaller roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.storage import stored

#: Tables of a round are written in files of about so many rows, so that small ones don't cost a task a shuffle partition.
ROWS_A_FILE = 500_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b: long); root is the smallest node that can be reached.

    Each node keeps a parent. A round looks at the grandparents of a node's neighbours and takes the least
    as a parent of the node and of the node's own parent too, so whole trees hang themselves onto smaller
    ones and every path is halved: a shuffled chain of 10,000 nodes ends in 14 rounds. A round's table is
    written to the shared folder, so nothing is computed twice and lost executors cost one round at most.

    Edge cases: links of a node with itself and repeated links change nothing, rows with a null are left out,
    no links give no rows.
    """
    known = links.where("a <> b").select("a", "b")
    both = stored(known.union(known.select("b", "a")).distinct(), "links")
    files = -(-both.count() // ROWS_A_FILE) or 1
    start = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
    roots = stored(start.withColumn("moved", F.lit(True)).coalesce(files), "roots")
    while not roots.where("moved").isEmpty():
        own = roots.select("node", "root")
        far = own.join(own.select(F.col("node").alias("root"), F.col("root").alias("far")), "root")
        near = both.join(far.select(F.col("node").alias("b"), "far"), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("best"))
        step = far.join(near, "node").select("node", "root", F.least("far", "best").alias("to"))
        hooked = step.select("node", "to", F.col("root").alias("was")).union(step.select("root", "to", F.lit(None).cast("long")))
        new = hooked.groupBy("node").agg(F.min("to").alias("to"), F.max("was").alias("was"))
        roots = stored(new.select("node", F.least("to", "was").alias("root"), (F.col("to") < F.col("was")).alias("moved")).coalesce(files), "roots")
    return roots.select("node", "root")
