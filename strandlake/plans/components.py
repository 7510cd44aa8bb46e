"""Connected components of a graph given as an edge DataFrame.

Each round hooks every vertex to its smallest neighbour, flattens the resulting
forest by pointer doubling and contracts the edges to the roots. A round at
least halves the vertices that still have edges, so the number of rounds is
logarithmic; a star, whatever its size, takes one. Neighbour minima are partial
aggregates, so a hub with a third of all edges is reduced before the shuffle.
Joins on an end that may be a hub go through :func:`~strandlake.plans.skew.lookup`,
which deals a hub's rows out. Nothing but a few counts per round reaches the
driver; a round's tables are deleted once the next ones are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.plans.lineage import cut, spent, total
from strandlake.plans.skew import lookup


def _roots(parents: DataFrame) -> DataFrame:
    """Pointer doubling of (v, p) until every p is a root; roots have v = p."""
    while True:
        up = parents.where("v <> p").select("v", F.col("p").alias("_up"))
        met = lookup(parents.select("v", "p"), up, "p", "v", size=total(parents))
        doubled = cut(met.select("v", F.coalesce("_up", "p").alias("p"), F.col("_up").isNotNull().alias("_moved")), moved=F.count_if("_moved"))
        spent(parents)
        parents = doubled
        if not total(doubled, "moved"):
            return doubled


def connected_components(
    edges: DataFrame,
    vertices: DataFrame | None = None,
    src: str = "src",
    dst: str = "dst",
    node: str = "node",
    component: str = "component",
) -> DataFrame:
    """Label every node with the smallest node it reaches.

    ``vertices`` (column ``node``) adds nodes without edges as their own
    components. Nulls in either end of an edge are ignored.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    whole = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), live=F.count_if(F.col("a") != F.col("b")))
    live, size = whole.where("a <> b"), total(whole, "live")
    labels = None
    while size:
        hooks = live.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p"))
        ends = live.select(F.col("b").alias("v")).distinct().join(hooks, "v", "left_anti").select("v", F.col("v").alias("p"))
        roots = _roots(cut(hooks.unionByName(ends)))
        step = roots.select("v", F.col("p").alias("_to"))
        if labels is None:
            labels = roots
        else:
            moved = cut(lookup(labels.select("v", "p"), step, "p", "v", size=total(labels)).select("v", F.coalesce("_to", "p").alias("p")))
            spent(labels)
            labels = moved
        near = live.join(roots.select(F.col("v").alias("a"), F.col("p").alias("ra")), "a")
        pulled = lookup(near, step, "b", "v", size=size).select("ra", F.col("_to").alias("rb")).where("ra <> rb")
        left = cut(pulled.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
        spent(live)
        if roots is not labels:
            spent(roots)
        live, size = left, total(left)
    spent(live)
    alone = whole.where("a = b").select(F.col("a").alias("v"))
    if vertices is not None:
        alone = alone.union(vertices.select(F.col(node).alias("v")).where("v is not null"))
    if labels is None:
        return alone.distinct().select(F.col("v").alias(node), F.col("v").alias(component))
    alone = alone.distinct().join(labels, "v", "left_anti").select("v", F.col("v").alias("p"))
    return labels.select("v", "p").unionByName(alone).select(F.col("v").alias(node), F.col("p").alias(component))
