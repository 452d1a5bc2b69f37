"""Exact nearest neighbours of a bounded set of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.functions.vectors import cosine, unit
from quillon.operators.ranking import ranked

#: Queries that are sent to all tasks at once, on average; more are taken block by block. Vectors that are multiplied at once,
#: and the error of a product's score that is allowed for.
MOST_QUERIES, ROWS, SLACK = 10_000, 4096, 1e-9


def nearest(vectors: DataFrame, queries: DataFrame, k: int, allow: DataFrame | None = None, exclude_self: bool = False) -> DataFrame:
    """(query, item, score, rank): of each query (query, q) the k allowed items of the largest cosine.

    The filter comes before the search, so the result is exact. The queries, a stated set, are dealt to blocks of about
    MOST_QUERIES, each of which stands against all vectors; each partition keeps k for a query before rows are shuffled.
    """
    own = vectors.join(allow.select("item"), "item", "left_semi") if allow is not None else vectors
    own, asked = own.select("item", unit(F.col("v")).alias("v")), queries.select("query", unit(F.col("q")).alias("q"))
    blocks = max(1, -(-queries.count() // MOST_QUERIES))
    kind = StructType([StructField("query", asked.schema["query"].dataType), StructField("item", own.schema["item"].dataType), StructField("score", DoubleType())])
    found = []
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        found.append(ranked(own.mapInArrow(searched(some.toArrow(), k, exclude_self), kind), k, groups=["query"]))
    return reduce(DataFrame.unionByName, found)


def matrix(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows): the vectors of so many finite numbers, and where they stand; the others are left out."""
    flat = column.flatten()
    if not column.null_count and not flat.null_count and (np.diff(column.offsets.to_numpy()) == width).all():
        at, x = np.arange(len(column)), flat.to_numpy(zero_copy_only=False).reshape(len(column), width)
    else:
        rows = column.to_pylist()
        at = np.array([i for i, r in enumerate(rows) if r is not None and len(r) == width and None not in r], np.int64)
        x = np.array([rows[i] for i in at], np.float64).reshape(len(at), width)
    fine = np.isfinite(x).all(axis=1)
    return at[fine], x[fine]


def product(a: list | None, b: list | None) -> float | None:
    """What dot() gives for two rows of any kind."""
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    return sum((x * y for x, y in zip(a, b, strict=True)), 0.0)


def searched(asked: pa.Table, k: int, exclude_self: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (query, item, score) that hold each query's k best of every batch of (item, v).

    A product of matrices finds what may be among the best, within an error far above that of its rounding; only that is added up
    number by number, as dot() does it, so scores and ties are those of dot(). Odd vectors (null, of another length, not finite)
    are compared one by one.
    """
    names, told = asked["query"].combine_chunks(), asked["q"].combine_chunks()
    widths = pc.list_value_length(told).fill_null(0).to_numpy(zero_copy_only=False)
    width = int(np.bincount(widths).argmax()) if len(widths) else 0
    where, q = matrix(told, width)
    odd_q = np.setdiff1d(np.arange(len(told)), where)
    own_name = {}
    for i, name in enumerate(names.to_pylist() if exclude_self else ()):
        own_name.setdefault(name, []).append(i)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                item, v = part.column("item"), part.column("v")
                place = np.empty(len(item), np.int64)
                place[pc.array_sort_indices(item, order="ascending", null_placement="at_start").to_numpy()] = np.arange(len(item))
                same = np.zeros((len(item), len(names)), bool) if exclude_self else None
                for i, name in enumerate(item.to_pylist() if exclude_self else ()):
                    same[i, own_name.get(name, [])] = True
                if exclude_self:  # a comparison with null is no difference
                    same |= item.is_null().to_numpy(zero_copy_only=False)[:, None] | names.is_null().to_numpy(zero_copy_only=False)[None]
                at, x = matrix(v, width)
                for first in range(0, len(where) if len(at) else 0, ROWS // 8):
                    own = slice(first, first + ROWS // 8)
                    near = x @ q[own].T
                    if exclude_self:
                        near[same[np.ix_(at, where[own])]] = -np.inf
                    least = np.partition(near, max(len(x) - k, 0), axis=0)[max(len(x) - k, 0)]
                    i, j = np.nonzero((near >= least - SLACK) & (near > -np.inf))
                    score = np.zeros(len(i))
                    for d in range(width):
                        score += x[i, d] * q[own][j, d]
                    order = np.lexsort((place[at[i]], -score, j))
                    i, j, score = i[order], j[order], score[order]
                    best = np.arange(len(j)) - np.searchsorted(j, j) < k
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(where[own][j[best]])), item.take(pa.array(at[i[best]])), pa.array(score[best])], ["query", "item", "score"])
                odd = np.setdiff1d(np.arange(len(item)), at)
                pairs = [(i, j) for i in odd for j in range(len(names))] + [(i, j) for j in odd_q for i in at]
                pairs = [(i, j) for i, j in pairs if not exclude_self or not same[i, j]]
                if pairs:
                    i, j = np.array(pairs).T
                    score = pa.array([product(v[int(a)].as_py(), told[int(b)].as_py()) for a, b in pairs], pa.float64())
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), item.take(pa.array(i)), score], ["query", "item", "score"])

    return over


def smooth_affinity(vectors: DataFrame, modes: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(item, affinity): smooth maximum of the cosines to modes (mode, q, confidence), confidence as a log prior."""
    pairs = vectors.crossJoin(F.broadcast(modes))
    term = cosine(F.col("v"), F.col("q")) / temperature + F.log(F.greatest(F.col("confidence"), F.lit(1e-9)))
    terms = pairs.select("item", term.alias("t")).groupBy("item").agg(F.max("t").alias("peak"), F.collect_list("t").alias("ts"))
    total = F.aggregate("ts", F.lit(0.0), lambda s, t: s + F.exp(t - F.col("peak")))
    return terms.select("item", (temperature * (F.col("peak") + F.log(total))).alias("affinity"))


def assigned(vectors: DataFrame, modes: DataFrame) -> DataFrame:
    """(item, mode, cosine): the mode of the largest cosine, the first of equals."""
    pairs = vectors.crossJoin(F.broadcast(modes)).select("item", "mode", cosine(F.col("v"), F.col("q")).alias("cosine"))
    best = F.max(F.struct("cosine", (-F.col("mode")).alias("o"))).alias("b")
    return pairs.groupBy("item").agg(best).select("item", (-F.col("b.o")).alias("mode"), F.col("b.cosine").alias("cosine"))


def centroid(vectors: DataFrame, weights: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, q): the weighted mean direction of each group's items (groups, item, w), of length one."""
    parts = weights.join(vectors, "item").select(*groups, "w", F.posexplode("v").alias("d", "x"))
    sums = parts.groupBy(*groups, "d").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    arrays = sums.groupBy(*groups).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda p: p["s"]).alias("q"))
    return arrays.withColumn("q", unit(F.col("q")))
