"""Embedding near-dedup: an exact metric range join under cosine similarity.

Unit vectors are points; two link when their distance is at most r = sqrt(2 - 2 * threshold). Pivots partition
the points: each lies at home in the cell of its nearest pivot, and is copied to every other cell that can hold a
point within r of it. By the triangle inequality that needs the pivot no further than the cell's radius + r and
no nearer than its inner radius - r, and the point within r of the border between the two cells. Each cell then
joins alone: a home point meets all that can link with it, so its links are counted there. A cell with many
points is laid out as a grid of blocks of at most about `BLOCK` points a side, so no task holds more.

Products are taken in single precision first; pairs near the threshold are decided in double precision. Equal
vectors are one point with a number of copies. Each block returns one row for each point with links and a forest
of its links, never all pairs; components are made of the forests.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
vectors of different lengths never link; repeated rows are vectors of their own that link with each other; an
empty table gives no rows; further columns are ignored. Ids are below 2^62. Rows with a null id link as others do; the
component's id is its smallest known one, null where none is known, and then all its rows are kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import components, map_arrow, written

BLOCK = 8192
#: Pivots at most, and points from which they are picked, in order of a hash.
PIVOTS, SAMPLE = 256, 4096
#: Room for rounding in bounds on distances, and for single precision in products.
SLACK, SINGLE = 1e-6, 1e-4
#: Points of which no id is known have numbers from here, made of their names.
UNNAMED = 1 << 62


def dtype_of(vectors: DataFrame, vector: str) -> str:
    return "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"


def points(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, point, unit): point names equal vectors; unit holds its components as they came, null where it links with nothing."""
    kind, dtype = dict(vectors.dtypes)[key], dtype_of(vectors, vector)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, units = [], []
        for v in batch.column(1).to_pylist():
            a = None if not v or None in v else np.asarray(v, np.float64)
            if a is None or not np.isfinite(a).all() or not a.any():
                names.append(None)
                units.append(None)
            else:
                raw = (a + 0.0).astype(dtype).tobytes()
                names.append(hashlib.blake2b(raw, digest_size=16).hexdigest())
                units.append(raw)
        return pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(units, pa.binary())], names=[key, "point", "unit"])

    return map_arrow(vectors.select(key, F.col(vector).cast("array<float>" if dtype == "<f4" else "array<double>")), over, f"{key} {kind}, point string, unit binary")


def matrix(units: list[bytes], dtype: str) -> np.ndarray:
    """Rows of unit length, in double precision. All have the same number of components."""
    a = np.frombuffer(b"".join(units), dtype).reshape(len(units), -1).astype(np.float64)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots."""
    chosen = [0]
    far = 2 - 2 * sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        k = int(far.argmax())
        if far[k] <= 1e-9:
            break
        chosen.append(k)
        far = np.minimum(far, 2 - 2 * sample @ sample[k])
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * x @ pivots.T))


def reaches(x: np.ndarray, pivots: np.ndarray, radii: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, whether a point stands in each cell). radii: the smallest and largest home distance of each cell."""
    d = distances(x, pivots)
    home = d.argmin(axis=1)
    near = d[np.arange(len(x)), home][:, None]
    between = distances(pivots, pivots)[home]
    border = (d**2 - near**2) <= 2 * r * between + SLACK
    inside = border & (d <= radii[1] + r + SLACK) & (d >= radii[0] - r - SLACK)
    inside[np.arange(len(x)), home] = True
    return home, inside


def forest(rows: np.ndarray, columns: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
    """Links that suffice to connect what rows[k] - columns[k] connect. labels: parent of each point, changed here."""

    def root(k: int) -> int:
        while labels[k] != k:
            labels[k] = labels[labels[k]]
            k = labels[k]
        return k

    out = []
    for a, to in zip(rows.tolist(), columns, strict=True):
        mine, parents = root(a), labels[to]
        for parent in np.unique(parents).tolist():
            other = root(parent)
            if other != mine:
                labels[other] = mine
                out.append((a, int(to[np.argmax(parents == parent)])))
    return out


def join_block(left: pd.DataFrame, right: pd.DataFrame, threshold: float, dtype: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of each left point, the copies of other points that link with it; and a forest of links as (left id, right id)."""
    x, y = matrix(left["unit"].tolist(), dtype), matrix(right["unit"].tolist(), dtype)
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    own, others, copies = left["id"].to_numpy(), right["id"].to_numpy(), right["copies"].to_numpy()
    links, edges = np.zeros(len(x), np.int64), []
    ids, place = np.unique(np.concatenate([own, others]), return_inverse=True)
    labels = np.arange(len(ids))
    for begin in range(0, len(x), 1024):
        rows = slice(begin, begin + 1024)
        near = x32[rows] @ y32.T
        a, b = np.nonzero(near >= threshold - SINGLE)
        keep = others[b] != own[begin + a]
        a, b = a[keep], b[keep]
        unsure = np.flatnonzero(near[a, b] < threshold + SINGLE)
        if len(unsure):
            exact = np.einsum("ij,ij->i", x[begin + a[unsure]], y[b[unsure]])
            drop = unsure[exact < threshold]
            a, b = np.delete(a, drop), np.delete(b, drop)
        if not len(a):
            continue
        np.add.at(links, begin + a, copies[b])
        first = np.flatnonzero(np.diff(a, prepend=-1))
        edges += forest(place[begin + a[first]], np.split(place[len(own) + b], first[1:]), labels)
    return links, [(int(ids[p]), int(ids[q])) for p, q in edges]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row for each vector: n_links, component_id (the smallest id reachable by links) and kept."""
    spark = vectors.sparkSession
    r = math.sqrt(2 - 2 * threshold)
    own = written(points(vectors, vector, key), "points")
    unnamed = F.lit(UNNAMED) + F.conv(F.substring("point", 1, 15), 16, 10).cast("long")
    classes = written(own.where("point is not null").groupBy("point").agg(F.coalesce(F.min(key).cast("long"), unnamed).alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit"), F.octet_length(F.first("unit")).alias("width")), "classes")
    found = None
    for width, n in sorted(map(tuple, classes.groupBy("width").count().collect())):
        part = range_join(classes.where(F.col("width") == width), n, r, threshold, dtype_of(vectors, vector))
        found = part if found is None else found.unionByName(part)
    alone = own.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return alone

    # rows: a point's links with other points, or (from a block's forest) one link between two points
    found = written(found, "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"), "forest")
    told = classes.select("point", "id", "copies").join(counts, F.col("id") == F.col("a"), "left").drop("a").join(roots, F.col("id") == F.col("node"), "left")
    told = told.select(F.col("point"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    told = told.withColumn("component_id", F.when(F.col("component_id") < UNNAMED, F.col("component_id")))
    joined = own.select(key, "point").join(told, "point", "left")
    return joined.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col(key)).alias("component_id"), F.coalesce("component_id", F.col(key)).eqNullSafe(F.col(key)).alias("kept"))


def range_join(classes: DataFrame, n: int, r: float, threshold: float, dtype: str) -> DataFrame:
    """(a, b, links) of the points of one width: links counted for a where b is null, else a link of a forest."""
    sc = classes.sparkSession.sparkContext
    sample = matrix([bytes(x.unit) for x in classes.orderBy(F.xxhash64("point")).limit(SAMPLE).select("unit").collect()], dtype)
    pivots = spread_out(sample, min(PIVOTS, max(1, math.ceil(n / BLOCK) * 2)))
    k = len(pivots)
    told = sc.broadcast(pivots)

    def radii(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = distances(matrix(batch.column(0).to_pylist(), dtype), told.value)
        home, near = d.argmin(axis=1), d.min(axis=1)
        cells = np.unique(home)
        return pa.record_batch([pa.array(cells), pa.array([near[home == c].min() for c in cells]), pa.array([near[home == c].max() for c in cells])], names=["cell", "least", "most"])

    bounds = np.array([np.full(k, np.inf), np.full(k, -np.inf)])
    for cell, least, most in map_arrow(classes.select("unit"), radii, "cell long, least double, most double").groupBy("cell").agg(F.min("least"), F.max("most")).collect():
        bounds[:, cell] = least, most
    bounds_told = sc.broadcast(bounds)

    def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
        home, inside = reaches(matrix(batch.column(0).to_pylist(), dtype), told.value, bounds_told.value, r)
        return pa.record_batch([pa.array(np.arange(k)), pa.array(np.bincount(home, minlength=k)), pa.array(inside.sum(axis=0))], names=["cell", "home", "all"])

    grid = np.ones((k, 2), np.int64)
    for cell, home, every in map_arrow(classes.select("unit"), sizes, "cell long, home long, all long").groupBy("cell").agg(F.sum("home"), F.sum("all")).collect():
        grid[cell] = max(1, math.ceil(home / BLOCK)), max(1, math.ceil(every / BLOCK))
    grid_told = sc.broadcast(grid)

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, ids, copies, units = (batch.column(c) for c in range(4))
        home, inside = reaches(matrix(units.to_pylist(), dtype), told.value, bounds_told.value, r)
        salt = np.array([int(x[:12], 16) for x in names.to_pylist()], np.int64)
        grid = grid_told.value
        for cell in range(k):
            high, wide = grid[cell].tolist()
            for side, at in ((True, np.flatnonzero(home == cell)), (False, np.flatnonzero(inside[:, cell]))):
                for other in range(wide if side else high):
                    if len(at):
                        mine = salt[at] % (high if side else wide)
                        block = mine * wide + other if side else other * wide + mine
                        yield pa.record_batch([pa.array(np.full(len(at), cell)), pa.array(block), pa.array(np.full(len(at), side)), ids.take(pa.array(at)), copies.take(pa.array(at)), units.take(pa.array(at))], names=["cell", "block", "home", "id", "copies", "unit"])

    dealt = map_arrow(classes.select("point", "id", "copies", "unit"), deal, "cell long, block long, home boolean, id long, copies long, unit binary")

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["home"]], group[~group["home"]]
        if left.empty or right.empty:
            return pd.DataFrame({"a": pd.array([], "Int64"), "b": pd.array([], "Int64"), "links": pd.array([], "Int64")})
        links, edges = join_block(left, right, threshold, dtype)
        at = np.flatnonzero(links)
        a = [*left["id"].to_numpy()[at].tolist(), *(p for p, _ in edges)]
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array([None] * len(at) + [q for _, q in edges], "Int64"), "links": pd.array([*links[at].tolist(), *[0] * len(edges)], "Int64")})

    return dealt.groupBy("cell", "block").applyInPandas(joined, "a long, b long, links long")
