"""Group identifiers of linked records: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut


def _jump(parent: DataFrame) -> DataFrame:
    """Point every vertex of ``parent`` (v, p; p < v or p = v) straight at its root.

    Pointer jumping p <- p(p) halves every path, so a chain of length n takes
    log2(n) rounds; each round is cut and rounds end when no pointer changes.
    A vertex without a row of its own is a root.
    """
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        nxt = cut(parent.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")), count="moved")
        drop_cut(parent)
        parent = nxt.drop("moved")
        parent._cut_path = nxt._cut_path
        if not nxt.counted:
            return parent


def connected_groups(pairs: DataFrame, a: str, b: str, id_name: str = "doc_id", group_name: str = "group_id") -> DataFrame:
    """One row per id that occurs on a pair whose two ids are present; its group is the smallest linked id.

    Rounds of: every vertex takes the smallest label among itself and its
    neighbours, pointer jumping turns those labels into roots, edges are rewritten
    to roots and loops and repeats dropped.  Every larger end of an edge is merged
    into its smallest neighbour, so a round takes away at least one vertex of every
    edge's component and merges all of a star around its smallest end; on random or
    path-shaped graphs about half of the vertices go, but a star whose hub has the
    largest id keeps all but that one as roots until the next round joins them.  Each
    round is written to the shared folder; edges between labels are counted as they
    are written and the loop ends when there are none.

    Skew: minima are found by an aggregate with map-side combine, repeats of an
    edge are dropped before any join, and the label side of every join has one row
    per vertex, so adaptive skew splitting may cut a hub's edges freely.

    Nulls: pairs with a null id are ignored.  Self pairs give a group of one.
    Repeated and reversed pairs count once.  An empty table gives no rows.  Other
    columns are ignored, whatever their names.
    """
    e = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    e = e.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    first = cut(e, count="x <> y")
    edges, labels = first, None
    while edges.counted:
        live = edges.filter("x <> y")
        parent = cut(live.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("p")))
        root = _jump(parent)
        # the larger end of an edge always has a label; the smaller may be a root without one
        rx, ry = root.select(F.col("v").alias("x"), F.col("p").alias("rx")), root.select(F.col("v").alias("y"), F.col("p").alias("ry"))
        rewritten = live.join(rx, "x").join(ry, "y", "left").select("rx", F.coalesce("ry", "y").alias("ry"))
        nxt = cut(rewritten.filter("rx <> ry").select(F.greatest("rx", "ry").alias("x"), F.least("rx", "ry").alias("y")).distinct(), count=F.lit(True))
        if labels is None:
            labels = root
        else:
            up = root.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            new = labels.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
            # roots that now hang under another root and had no label of their own
            new = cut(new.unionByName(root.join(labels.select("v"), "v", "left_anti")))
            drop_cut(labels, root)
            labels = new
        if edges is not first:
            drop_cut(edges)
        edges = nxt
    ids = first.select(F.col("x").alias("v")).union(first.select("y")).distinct()
    if labels is None:
        return ids.select(F.col("v").alias(id_name), F.col("v").alias(group_name))
    return ids.join(labels, "v", "left").select(F.col("v").alias(id_name), F.coalesce("p", "v").alias(group_name))
