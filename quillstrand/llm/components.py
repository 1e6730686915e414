"""Connected components by alternating large and small stars.

Each half step is one aggregation and one equi-join on the vertex, so no vertex's neighbours are ever
gathered in one row. Minima are taken in the map tasks first; the join is on the vertex and a salt, so the edges
of a hot vertex are dealt over SALTS tasks at least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrand.shared import stash


#: Parts of a vertex's edges in a join; the other side, a row per vertex, is repeated for each.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with u's row of least (u, m)."""
    salted = edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS)))
    copies = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return salted.join(copies, ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, name: str = "stars", most_rounds: int = 60) -> DataFrame:
    """edges: two long columns, any order, repeats and loops allowed; nulls link nothing.

    Returns (node, component): one row for each vertex with an edge to another vertex; component is the
    smallest vertex it reaches. No edges: an empty table. Raises if most_rounds do not suffice.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now = stash(now.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
    for _ in range(most_rounds):
        if not mark[0]:
            break
        later = stash(_small_star(_large_star(now)).where("u <> v").distinct(), name)
        after = later.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.count_distinct("u")).first()
        now, settled = later, tuple(after)[:2] == tuple(mark)[:2] and after[0] == after[2]
        mark = after
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
