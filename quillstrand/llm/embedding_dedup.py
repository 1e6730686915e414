"""Near-duplicate vectors by exact cosine, tile against tile.

Vectors are turned to their principal axes, so that the leading dimensions hold most of their length. A grid over
the first axes keeps vectors that can be near each other in the same or neighbouring cells; large cells are cut at
quantiles of the next axes into tiles of bounded size, and tiles whose bounding boxes are too far apart are never
compared. Two tiles are compared by accumulating leading dimensions first: what the rest can add is at most the product of the suffix norms, so a
pair is dropped as soon as its cosine can't reach the threshold. What survives is decided on the whole vectors.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrand.llm.components import connected_components
from quillstrand.shared import stash

#: Vectors in a tile, at most about, and rows of one that are compared at a time.
TILE, BLOCK = 4096, 512
#: Axes of the grid.
GRID = 2
#: Axes of the tiles' bounding boxes.
BOX = 8
#: The dimensions accumulated at each step end here (and at the last one).
STEPS = (8, 24)
SLACK = 1e-9
#: Quantiles of an axis at which a cell can be cut.
QUANTILES = 16
#: So many cells, at most, are broadcast with their quantiles.
MOST_CELLS = 10000


def _moments(v: DataFrame, dims: int) -> np.ndarray:
    """Sum of outer products of the unit vectors: dims * dims numbers, whatever the number of rows."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for b in batches:
            if len(b):
                x = _unit(np.stack(b["v"].to_numpy()))
                total += x.T @ x
        yield pd.DataFrame({"k": np.arange(dims * dims), "s": total.ravel()})

    rows = v.select("v").mapInPandas(add, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(dims * dims)
    for k, s in rows:
        out[k] = s
    return out.reshape(dims, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (of a, of b) of all pairs of unit vectors with cosine >= threshold."""
    ra, rb = a @ axes, b @ axes
    found = [_compare(a[k : k + BLOCK], b, ra[k : k + BLOCK], rb, threshold) for k in range(0, len(a), BLOCK)]
    return np.concatenate([i + k * BLOCK for k, (i, _) in enumerate(found)]), np.concatenate([j for _, j in found])


def _compare(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    dims = ra.shape[1]
    i = j = None
    done = 0
    for s in [s for s in STEPS if s < dims]:
        left_a, left_b = np.sqrt((ra[:, s:] ** 2).sum(1)), np.sqrt((rb[:, s:] ** 2).sum(1))
        if i is None:
            part = ra[:, :s] @ rb[:, :s].T
            i, j = np.nonzero(part + left_a[:, None] * left_b[None, :] >= threshold - SLACK)
            part = part[i, j]
        else:
            part = part + np.einsum("ij,ij->i", ra[i, done:s], rb[j, done:s])
            alive = part + left_a[i] * left_b[j] >= threshold - SLACK
            i, j, part = i[alive], j[alive], part[alive]
        done = s
    if i is None:
        i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    hits = [np.einsum("ij,ij->i", a[i[k : k + 65536]], b[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]
    hit = np.concatenate(hits) if hits else np.zeros(0, bool)
    return i[hit], j[hit]


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) for the nodes of a graph of pairs, roots left out."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


PAIR = "pair long, same boolean, side int, rep long, copies long, v array<float>"


#: Lengths whose links are united at once.
PART = 64


def _tile_pairs(axes: np.ndarray, threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One pair of tiles: links of each vector, and a spanning forest of them, so rows are in proportion to the tiles."""
        first = rows[rows["side"] == 0]
        same = bool(rows["same"].iloc[0])
        second = first if same else rows[rows["side"] == 1]
        if not len(first) or not len(second):
            return pd.DataFrame({"rep": [], "links": [], "root": []})
        a, b = (_unit(np.stack(x["v"].to_numpy())) for x in (first, second))
        i, j = compare(a, b, axes, threshold)
        ra, rb = first["rep"].to_numpy(), second["rep"].to_numpy()
        if same:
            off = i != j
            i, j = i[off], j[off]  # each pair comes twice, once for each end
        na, nb = first["copies"].to_numpy(), second["copies"].to_numpy()
        links = [(ra, np.bincount(i, weights=nb[j], minlength=len(ra)))]
        if not same:
            links.append((rb, np.bincount(j, weights=na[i], minlength=len(rb))))
        rep, n = np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links])
        node, root = _forest(ra[i], rb[j]) if len(i) else (rep[:0], rep[:0])
        linked = n > 0
        return pd.DataFrame({"rep": np.concatenate([rep[linked], node]), "links": np.concatenate([n[linked].astype(np.int64), np.zeros(len(node), np.int64)]), "root": np.concatenate([rep[linked], root])})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per input row: vec_id, n_links, component_id, kept.

    n_links: other rows with cosine >= threshold (double precision), equal vectors included. component_id: the
    smallest id reachable by links. Vectors that are null, empty or zero, or hold a null or a value that isn't
    finite, link with nothing, nor do vectors of different lengths or rows with a null id (their component is
    null and kept false). Repeated rows are rows of their own. Empty tables give no rows.

    Equal vectors become one row in the map tasks, so a group of copies of any size costs one vector. threshold
    must be over 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    good = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    kind = "array<double>" if dict(vectors.select(F.col(vector_col).alias("v")).dtypes)["v"] == "array<double>" else "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    able = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & good, F.lit(False))
    classes = stash(rows.where(able).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "v", F.size("v").alias("dims")), "vectors")
    # A length with one vector has no pairs. The rest are united in parts, which keeps plans of many lengths shallow.
    lengths = [d for (d,) in classes.groupBy("dims").count().where("count > 1").select("dims").orderBy("dims").collect()]
    graphs = [_links_of(classes.where(F.col("dims") == d), d, threshold) for d in lengths]
    if len(graphs) > PART:
        graphs = [stash(_union(graphs[k : k + PART]), "links-part") for k in range(0, len(graphs), PART)]
    none = vectors.sparkSession.createDataFrame([], "rep long, links long, root long")
    found = stash(none if not graphs else graphs[0] if len(graphs) == 1 else _union(graphs), "links")
    components = connected_components(found.where("rep <> root").select("rep", "root"))
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(totals, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where(able).join(known, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _tiled(placed: DataFrame, more: int, grid: int, few: bool) -> DataFrame:
    """placed with part and tile. A cell of p tiles is cut on the first log2(p) of `more` axes past the grid, at as many
    quantiles on each as make p parts; where that leaves too many rows in a part (values that tie, or axes that go
    together), a hash splits it. few: the cells are few enough to be broadcast, by the size of the grid."""
    cuts = [F.percentile_approx(F.col("lead")[grid + k], [x / QUANTILES for x in range(1, QUANTILES)], 1000).alias(f"q{k}") for k in range(more)]
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("parts"), *cuts)
    axes = F.greatest(F.lit(1), F.least(F.lit(more), F.ceil(F.log2(F.col("parts")))))
    steps = F.least(F.lit(QUANTILES), F.ceil(F.round(F.pow(F.col("parts"), 1 / axes), 6)))
    sizes = sizes.withColumn("axes", axes).withColumn("steps", steps)
    part = F.lit(0)
    for k in range(more):
        here = F.col("lead")[grid + k]
        place = F.size(F.filter(f"q{k}", lambda c: c < here))  # noqa: B023 - called at once
        part = part * QUANTILES + F.when(F.col("axes") > k, F.floor(place * F.col("steps") / QUANTILES)).otherwise(F.lit(0))
    cut = placed.join(F.broadcast(sizes) if few else sizes, "cell").select("rep", "copies", "v", "cell", "lead", part.cast("long").alias("area"))
    crowds = cut.groupBy("cell", "area").agg(F.ceil(F.count("*") / TILE).cast("int").alias("shares"))
    crowds = crowds.where("shares > 1")
    out = cut.join(crowds, ["cell", "area"], "left").withColumn("share", F.when(F.col("shares").isNotNull(), F.pmod(F.xxhash64("rep"), F.col("shares"))).otherwise(F.lit(0)))
    out = out.withColumn("part", F.xxhash64("area", "share"))
    return out.select("rep", "copies", "v", "cell", "lead", "part", F.xxhash64("cell", "part").alias("tile"))


def _links_of(classes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(rep, links, root) rows of the classes of one length; links add up by rep, rep and root are connected."""
    moments = _moments(classes, dims)
    axes = np.linalg.eigh(moments)[1][:, ::-1]
    reach = math.sqrt(max(2 - 2 * threshold, 0.0)) * (1 + 1e-9) + 1e-9  # unit vectors this near, at most
    box, grid = min(BOX, dims), min(GRID, dims)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _unit(np.stack(b["v"].to_numpy())) @ axes[:, :box]
                out = b[["rep", "copies", "v"]].copy()
                out["cell"] = list(np.floor(x[:, :grid] / reach).astype(np.int32))
                out["lead"] = list(x)
                yield out

    kind = dict(classes.dtypes)["v"]
    placed = stash(classes.mapInPandas(place, f"rep long, copies long, v {kind}, cell array<int>, lead array<double>"), "cells")
    tiled = stash(_tiled(placed, box - grid, grid, (2 / reach + 2) ** grid <= MOST_CELLS), "tiles")
    bounds = [f(F.col("lead")[k]).alias(f"{n}{k}") for k in range(box) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    boxes = stash(tiled.groupBy("tile", "cell", "part").agg(*bounds), "boxes")
    # Half of the neighbouring cells, so that each pair of cells meets once.
    steps = [s for s in itertools.product((-1, 0, 1), repeat=grid) if s >= (0,) * grid]
    near = F.explode(F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps]))
    left = boxes.withColumn("step", near).withColumn("other", F.zip_with("cell", "step", lambda a, b: a + b))
    right = boxes.select(*[F.col(c).alias(f"r_{c}") for c in boxes.columns])
    apart = sum((F.pow(F.greatest(F.col(f"lo{k}") - F.col(f"r_hi{k}"), F.col(f"r_lo{k}") - F.col(f"hi{k}"), F.lit(0.0)), 2) for k in range(box)), F.lit(0.0))
    own = (F.col("cell") != F.col("r_cell")) | (F.col("part") <= F.col("r_part"))
    pairs = left.join(right, F.col("other") == F.col("r_cell")).where(own & (apart <= reach * reach)).select(F.col("tile").alias("a"), F.col("r_tile").alias("b"))
    pairs = stash(pairs.select(F.xxhash64("a", "b").alias("pair"), "a", "b", (F.col("a") == F.col("b")).alias("same")), "tile-pairs")
    sides = pairs.select("pair", "same", F.lit(0).alias("side"), F.col("a").alias("tile")).union(pairs.where("not same").select("pair", "same", F.lit(1).alias("side"), F.col("b").alias("tile")))
    shipped = sides.join(tiled.select("tile", "rep", "copies", "v"), "tile").select("pair", "same", "side", "rep", "copies", "v")
    return shipped.groupBy("pair").applyInPandas(_tile_pairs(axes, threshold), "rep long, links long, root long")
