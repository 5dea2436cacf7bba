"""Names in trees (S13, U3, A9, O3): a walk over an edge table, relational and apart from any parser.

Edges are rows (doc_id, parent, child); what nodes hold is rows of its own. Where every node has one parent,
as in a name tree, ``WITH RECURSIVE`` goes down from the roots: each node is one row, whatever the depth. Where
nodes have several, as links do, that would make a row for each way that leads to a node, which doubles with every diamond; there the walk
goes by rounds, and a node that has been met isn't met again. Both end ``DEPTH`` levels down, and at a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import work_folder
from .attachments import distinct_files

#: Fixed value: levels below a root that are read.
DEPTH = 50
_RECURSIVE = """
WITH RECURSIVE walked(doc_id, root, node, depth) AS (
  SELECT doc_id, node, node, 0 FROM {roots}
  UNION ALL
  SELECT w.doc_id, w.root, e.child, w.depth + 1 FROM walked w JOIN {edges} e ON e.doc_id = w.doc_id AND e.parent = w.node WHERE w.depth < {depth} AND e.child <> w.root
)
SELECT doc_id, node, min(depth) AS depth FROM walked GROUP BY doc_id, node
"""


def is_forest(edges: DataFrame) -> bool:
    """Whether no node has two parents."""
    return edges.select("doc_id", "parent", "child").distinct().groupBy("doc_id", "child").count().where("count > 1").isEmpty()


def reached(edges: DataFrame, roots: DataFrame, depth: int = DEPTH, forest: bool | None = None) -> DataFrame:
    """(doc_id, node, depth) of the nodes that are at most ``depth`` levels below a root of their document, with the fewest levels; edges: doc_id, parent, child; roots: doc_id, node.

    Repeated edges count once; rows with nulls lead nowhere. ``forest`` says that no node has two parents, if that is known.
    """
    own = edges.select("doc_id", "parent", "child").where("doc_id IS NOT NULL AND parent IS NOT NULL AND child IS NOT NULL").distinct()
    top = roots.select("doc_id", "node").where("doc_id IS NOT NULL AND node IS NOT NULL").distinct()
    if is_forest(own) if forest is None else forest:
        return _down(own, top, depth)
    return _rounds(own, top, depth)


def _down(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    spark = edges.sparkSession
    name = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(name, "-1")  # a row for each node: as many as the edges have; the walk ends by its depth
    level = "spark.sql.cteRecursionLevelLimit"
    spark.conf.set(level, str(max(int(spark.conf.get(level)), depth + 2)))
    return spark.sql(_RECURSIVE, edges=edges, roots=roots, depth=depth)


def _rounds(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    context = edges.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(work_folder(edges.sparkSession))
    edges = edges.checkpoint()
    found = front = roots.withColumn("depth", F.lit(0)).checkpoint()
    for level in range(1, depth + 1):
        down = front.join(edges.withColumnRenamed("parent", "node"), ["doc_id", "node"]).select("doc_id", F.col("child").alias("node")).distinct()
        front = down.join(found.select("doc_id", "node"), ["doc_id", "node"], "left_anti").withColumn("depth", F.lit(level)).checkpoint()
        if front.isEmpty():
            break
        found = found.union(front).checkpoint() if level % 8 == 0 else found.union(front)
    return found


def names_below(edges: DataFrame, roots: DataFrame, entries: DataFrame, depth: int = DEPTH, forest: bool | None = None) -> DataFrame:
    """(doc_id, name, size) of the files that the nodes of a tree hold, each name once with its first known size; entries: doc_id, node, source_ord, ord, name, size."""
    met = entries.join(reached(edges, roots, depth, forest).select("doc_id", "node"), ["doc_id", "node"], "left_semi")
    return distinct_files(met.select("doc_id", "source_ord", "ord", "name", "size"))
