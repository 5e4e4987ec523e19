"""Depth-first pre-order walk of a bookmark tree stored as an adjacency table.

The walk goes one level at a time: the next level is one distributed join of
the current level with the node table, so the depth, not the width, bounds
the number of steps.  Each level is `checkpoint()`ed to the shared checkpoint
folder: that cuts the lineage (a deep tree never recomputes the levels above),
and the emptiness test and the final union read the written level instead of
recomputing the join.  Pre-order is a sortable path of zero-padded sibling
keys, so the order is a plain sort (range-partitioned), never a walk on the
driver.  (A `WITH RECURSIVE` CTE gives the same rows; on Spark 4.1 it was
4-5x slower here, mostly in per-iteration planning.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_tree(nodes: DataFrame, ordered: bool = True) -> DataFrame:
    """Bookmarks (nodes with a url) in pre-order -> (id, title, url, date_added, path, depth).

    `nodes` has (id, parent_id, title, url, sort_key) and may have date_added; roots have a null parent.
    Every depth is walked; a cycle that a root leads to is an error.
    `path` is the pre-order key; `ordered=False` skips the global sort for
    callers that only need the key (e.g. "first per url" as a `min_by`).
    """
    from vellum.session import checkpoint_dir

    checkpoint_dir(nodes.sparkSession)
    added = F.col("date_added") if "date_added" in nodes.columns else F.lit(None).cast("timestamp")
    n = nodes.select("id", "parent_id", "title", "url", added.alias("date_added"), "sort_key")
    level = n.where(F.col("parent_id").isNull()).select(
        "id", "title", "url", "date_added", F.col("sort_key").alias("path"), F.lit(0).alias("depth")).checkpoint()
    levels = [level]
    n_nodes, depth = n.count(), 0
    while True:
        depth += 1
        if depth > n_nodes:  # only rows that repeat an id can lead back to a node above
            raise ValueError("the tree has a cycle")
        parents = level.select(F.col("id").alias("_pid"), F.col("path").alias("_ppath"))
        nxt = n.join(parents, n["parent_id"] == parents["_pid"]).select(
            "id", "title", "url", "date_added", F.concat("_ppath", F.lit("/"), "sort_key").alias("path"),
            F.lit(depth).alias("depth")).checkpoint()
        if nxt.isEmpty():
            break
        levels.append(nxt)
        level = nxt
    walked = levels[0]
    for lv in levels[1:]:
        walked = walked.unionByName(lv)
    marks = walked.where(F.col("url").isNotNull() & (F.col("url") != ""))
    return marks.orderBy("path") if ordered else marks
