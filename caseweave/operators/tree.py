"""The document tree: ancestors, descendants, and deletion with all that hangs below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.plans.durable import cut

DEPTH_MOST = 64


def ancestors(nodes: DataFrame, node: str) -> DataFrame:
    """(id, parent_id, depth) above ``node`` in ``nodes(id, parent_id)``, the root first."""
    sql = """
        WITH RECURSIVE up(id, parent_id, depth) AS (
          SELECT p.id, p.parent_id, 1 FROM {tree} c JOIN {tree} p ON p.id = c.parent_id WHERE c.id = {node}
          UNION ALL
          SELECT p.id, p.parent_id, u.depth + 1 FROM up u JOIN {tree} p ON p.id = u.parent_id WHERE u.depth < {most})
        SELECT id, parent_id, depth FROM up ORDER BY depth DESC"""
    return nodes.sparkSession.sql(sql, tree=nodes.select("id", "parent_id"), node=node, most=DEPTH_MOST)


def descendants(nodes: DataFrame, node: str) -> DataFrame:
    """(id, parent_id, depth) below ``node``, level by level: each level is a join with the one above, cut to the shared folder.

    A recursive query would do, but the engine bounds its rows, and a subtree
    may be most of the corpus.
    """
    level = nodes.filter(F.col("parent_id") == node).select("id", "parent_id", F.lit(1).alias("depth"))
    found: list[DataFrame] = []
    for depth in range(2, DEPTH_MOST + 2):
        level = cut(level)
        if found and level.isEmpty():
            break
        found.append(level)
        above = level.select(F.col("id").alias("parent_id"))
        level = nodes.select("id", "parent_id").join(above, "parent_id").select("id", "parent_id", F.lit(depth).alias("depth"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cascade_delete(nodes: DataFrame, node: str, *dependants: DataFrame) -> tuple[DataFrame, ...]:
    """``nodes`` and tables with a ``document_id``, without ``node`` and what is below it."""
    gone = descendants(nodes, node).select("id").union(nodes.filter(F.col("id") == node).select("id")).distinct()
    kept = nodes.join(gone, "id", "left_anti")
    return kept, *(d.join(gone, d["document_id"] == gone["id"], "left_anti") for d in dependants)
