"""Exact top-k search by inner product: a Voronoi kNN join.

Components are turned into integers, floor(256 x). Pivots, chosen by the hash of their ids, divide both queries and data
into cells of the nearest pivot; there are about as many as the square root of the vectors, PIVOTS at most. A cell's summary holds its
K vectors nearest to the pivot; a query cell's also holds how far its queries lie from the pivot at most.

Each query's K-th best product with the summarised vectors of other ids is a score that its K-th best of all reaches
at least; the smallest of a cell is the cell's floor. For a query q in a cell with pivot p and radius u, and any vector s,

    q.s  <=  p.s + u |s|    and    2 q.s  <=  max|q|^2 + |s|^2 - max(0, |p - s| - u)^2,

so a vector whose bounds are both below the floors of all cells of a group takes no part there. Neighbouring query cells make a
group of about QUERIES queries, neighbouring data cells a group of about VECTORS vectors; cells with more are cut by
hash. A vector is replicated once to each query group that may need it, a query once to each data group that holds a vector for
its group, and each pair of a block and a slice is solved locally by a matrix product; the best K of all slices are
merged. Where vectors have no clusters, such as points all over a sphere of many dimensions, no bound on groups can prune, and each query
group meets all vectors; in clusters apart from one another few vectors leave their own group (a test holds that to a fifth). Summaries, PIVOTS times
K vectors at most, are all that the driver sees.

Products are exact: in floating point while they stay below 2^53, else in whole numbers, held within 64 bits.
Vectors that are null or hold a null or non-finite component, and rows without an id, take no part. Of different
lengths, the shorter is filled with zeros. Rows that repeat an id are candidates each; none of
them is a candidate of a query with that id, however many there are. Query rows that repeat an id share one ranking of
the pairs of all of them, as in the registered SQL: a candidate stands there once for each of them. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import _spark, _text

#: Best vectors asked for, most pivots, queries of a block and vectors of a slice.
K, PIVOTS, QUERIES, VECTORS = 5, 1024, 4096, 16_384
#: Components of quantised vectors.
SCALE = 256.0


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): valid vectors times 256, as doubles that matrix() rounds down."""
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    doubles = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return doubles.where(F.forall("v", fit)).select("id", F.transform("v", lambda x: F.greatest(F.least(x * SCALE, F.lit(1e308)), F.lit(-1e308))).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list array as rows of equal width in whole numbers, zeros behind short ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(column), width))
    if len(flat) == out.size and (size == width).all():
        out[:] = flat.reshape(out.shape)
    else:
        out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit whole numbers."""
    largest = max((np.abs(x).max(initial=0.0) for x in (queries, data)))
    if largest * largest * max(1, queries.shape[1]) < 2.0**53:
        return (queries @ data.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (queries, data)]
    exact = whole[0] @ whole[1].T if queries.shape[1] else np.zeros((len(queries), len(data)), object)
    return np.array([[max(1 - 2**63, min(2**63 - 1, int(x))) for x in row] for row in exact], np.int64).reshape(len(queries), len(data))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row the indices of its k highest scores, smaller ids first among equals. ids ascend."""
    # ~ turns the order round without overflow
    if scores.shape[1] <= k:
        return np.argsort(~scores, axis=1, kind="stable")
    limit = ~np.partition(~scores, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(scores), k), np.int64)
    for i, (row, least) in enumerate(zip(scores, limit, strict=True)):
        over = np.flatnonzero(row > least)
        ties = np.flatnonzero(row == least)[: k - len(over)]
        chosen = np.concatenate([over, ties])
        out[i] = chosen[np.lexsort((chosen, ~row[chosen]))]
    return out


def _cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, far): the nearest pivot and the distance from it."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            v = matrix(batch.column(1), p.shape[1])
            cell, far = np.zeros(len(v), np.int64), np.zeros(len(v))
            for low in range(0, len(v), 1024):
                some = v[low : low + 1024]
                square = (p * p).sum(axis=1) - 2 * (some @ p.T)
                cell[low : low + 1024] = square.argmin(axis=1)
                far[low : low + 1024] = np.sqrt(((some - p[cell[low : low + 1024]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["id", "v", "cell", "far"])

    return vectors.mapInArrow(run, "id long, v array<double>, cell long, far double")


def uppers(vectors: np.ndarray, pivots: np.ndarray, radius: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """For each vector and query cell (pivot, radius, longest query) what no product of the two exceeds."""
    square, size = (vectors * vectors).sum(axis=1)[:, None], (pivots * pivots).sum(axis=1)[None, :]
    dots = vectors @ pivots.T
    far = np.sqrt(np.maximum(square + size - 2 * dots, 0))
    by_length = dots + radius * np.sqrt(square)
    by_distance = (longest**2 + square - np.maximum(far - radius, 0) ** 2) / 2
    # the slack covers rounding of the bounds themselves
    return np.minimum(by_length, by_distance) + 1e-6 * (np.abs(dots) + square + size) + 1e-6


def chain(pivots: np.ndarray, cells: list[int]) -> list[int]:
    """Cells in an order in which neighbours are near each other."""
    left, out = list(cells), []
    while left:
        at = 0 if not out else int(((pivots[left] - pivots[out[-1]]) ** 2).sum(axis=1).argmin())
        out.append(left.pop(at))
    return out


def grouped(order: list[int], sizes: dict[int, int], most: int) -> tuple[dict[int, int], list[int]]:
    """(group of each cell, parts of each group): cells in order are put together up to most rows; a larger one is
    a group of several parts."""
    group, parts, held = {}, [], 0
    for cell in order:
        if not parts or held + sizes[cell] > most:
            parts.append(0)
            held = 0
        held += sizes[cell]
        group[cell] = len(parts) - 1
        parts[-1] = max(1, -(-held // most))
    return group, parts


def knn_join(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", is_query: F.Column | None = None, k: int = K, pivots: int = PIVOTS, queries: int = QUERIES, vectors: int = VECTORS) -> DataFrame:
    """(query_id, rank, id, score): each query's k highest inner products with the other rows, smaller ids first among
    equals. is_query: a condition on the column id."""
    spark = df.sparkSession
    _spark.whole_ids(df, id_col)
    whole = quantised(df, id_col, vector_col)
    total = whole.count()
    picked = [r["v"] for r in whole.orderBy(F.xxhash64("id"), "id").limit(max(1, min(pivots, math.isqrt(total)))).collect()]
    schema = "query_id long, rank int, id long, score long"
    if not picked:
        return spark.createDataFrame([], schema)
    width = whole.agg(F.max(F.size("v"))).first()[0]
    centres = np.zeros((len(picked), width))
    for row, v in zip(centres, picked, strict=True):
        row[: len(v)] = np.floor(v)
    centres = np.unique(centres, axis=0)
    data = _spark.stored(_cells(whole, centres), "cells")
    asked = data.where(is_query) if is_query is not None else data
    counts = {r["cell"]: r["n"] for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    # the k nearest vectors of each cell, cut down in each task before they meet
    near = data.select("cell", "far", "id", "v").mapInArrow(_least(k, width), "cell long, far double, id long, v array<double>")
    near = near.groupBy("cell").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "id", "v"))), 1, k).alias("near")).collect()
    near = [x for r in near for x in r["near"]]
    order = sorted(range(len(near)), key=lambda i: near[i]["id"])
    summary = spark.sparkContext.broadcast((np.array([near[i]["id"] for i in order], np.int64), np.array([near[i]["v"] for i in order]).reshape(len(order), width)))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = summary.value
        for batch in batches:
            own, q = batch.column(0).to_numpy(), matrix(batch.column(1), width)
            least = np.full(len(q), -np.inf)
            for low in range(0, len(q), 1024):
                scores = q[low : low + 1024] @ v.T
                some = own[low : low + 1024]
                for row, a, b in zip(scores, np.searchsorted(ids, some), np.searchsorted(ids, some, "right"), strict=True):
                    row[a:b] = -np.inf
                if len(ids) >= k:
                    least[low : low + 1024] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            long = np.sqrt((q * q).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(np.where(np.isnan(least), -np.inf, least)), pa.array(long)], names=["cell", "far", "least", "long"])

    found = asked.mapInArrow(reach, "cell long, far double, least double, long double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.min("least").alias("least"), F.max("long").alias("long")).collect()
    if not found:
        return spark.createDataFrame([], schema)
    found = {r["cell"]: r for r in found}
    q_order = chain(centres, sorted(found))
    q_group, q_parts = grouped(q_order, {c: found[c]["n"] for c in q_order}, queries)
    d_order = chain(centres, sorted(counts))
    d_group, d_parts = grouped(d_order, counts, vectors)
    cells = np.array(q_order)
    radius, floor, longest = (np.array([found[c][x] for c in q_order]) for x in ("far", "least", "long"))
    # where the query cells of each group begin, in their order
    begins = np.flatnonzero(np.diff([q_group[c] for c in q_order], prepend=-1))
    plan = spark.sparkContext.broadcast((centres, cells, radius, floor, longest, begins, np.array([d_group.get(c, -1) for c in range(len(centres))]), np.array(q_parts), np.array(d_parts)))

    def needed(v: np.ndarray) -> np.ndarray:
        """Whether each vector is needed by each query group."""
        c, own, radius, floor, longest, begins, *_ = plan.value
        out = np.empty((len(v), len(begins)), bool)
        for low in range(0, len(v), 1024):
            most = uppers(v[low : low + 1024], c[own], radius, longest)
            # what isn't a number rules nothing out
            out[low : low + 1024] = np.logical_or.reduceat(~(most < floor - 1e-6 * np.abs(floor)), begins, axis=1)
        return out

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, blocks, slices = plan.value[6], plan.value[7], plan.value[8]
        for batch in batches:
            ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            need = needed(matrix(batch.column(1), width))
            d = groups[cell]
            # by id and place, so that the rows of one id are dealt out too
            part = (_text.mix64(ids.view(np.uint64) + np.arange(len(ids), dtype=np.uint64)) % slices[d].astype(np.uint64)).astype(np.int64)
            for g in np.flatnonzero(need.any(axis=0)).tolist():
                near = np.flatnonzero(need[:, g])
                for b in range(int(blocks[g])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), g)), pa.array(np.full(len(near), b)), pa.array(d[near]), pa.array(part[near]), *(batch.column(i).take(pa.array(near)) for i in (0, 1))], names=["p", "b", "d", "s", "id", "v"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of a query group and a data group that share a vector."""
        seen = np.zeros((len(plan.value[7]), len(plan.value[8])), bool)
        for batch in batches:
            row, g = np.nonzero(needed(matrix(batch.column(1), width)))
            seen[g, plan.value[6][batch.column(2).to_numpy()[row]]] = True
        g, d = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(d)], names=["p", "d"])

    met = data.mapInArrow(pairs, "p long, d long").distinct().collect()  # at most a pair for each two groups
    meets: dict[int, list[tuple[int, int]]] = {g: [] for g in range(len(q_parts))}
    for r in met:
        meets[r["p"]] += [(r["d"], s) for s in range(d_parts[r["d"]])]
    routes = spark.sparkContext.broadcast((np.array([q_group.get(c, -1) for c in range(len(centres))]), meets))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, meets = routes.value
        for batch in batches:
            own = group[batch.column(2).to_numpy()]
            block = (_text.mix64(batch.column(0).to_numpy().view(np.uint64) + np.arange(1, len(own) + 1, dtype=np.uint64)) % plan.value[7][own].astype(np.uint64)).astype(np.int64)
            for g in np.unique(own).tolist():
                at = np.flatnonzero(own == g)
                for d, s in meets[g]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g)), pa.array(block[at]), pa.array(np.full(len(at), d)), pa.array(np.full(len(at), s)), *(batch.column(i).take(pa.array(at)) for i in (0, 1))], names=["p", "b", "d", "s", "id", "v"])

    side = "p long, b long, d long, s long, id long, v array<double>"
    data_side, query_side = data.mapInArrow(replicate, side), asked.mapInArrow(route, side)

    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own, other = left["id"].to_numpy(), right["id"].to_numpy()
        order = np.argsort(other, kind="stable")
        other, v = other[order], matrix(right["v"], width)[order]
        q = matrix(left["v"], width)
        out: list[tuple[np.ndarray, ...]] = []
        for low in range(0, len(own), 256):
            some = own[low : low + 256]
            scores = products(q[low : low + 256], v)
            # rows of the query's own id come last, below any product, before the best are taken
            for row, a, b in zip(scores, np.searchsorted(other, some), np.searchsorted(other, some, "right"), strict=True):
                row[a:b] = np.iinfo(np.int64).min
            take = best(scores, other, k)
            ids, score = other[take], np.take_along_axis(scores, take, axis=1)
            out.append((np.repeat(some, take.shape[1]), ids.ravel(), score.ravel()))
        cat = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        cat = [c[cat[0] != cat[1]] for c in cat]
        # query rows that share an id share their k best
        order = np.lexsort((cat[1], ~cat[2], cat[0]))
        cat = [c[order] for c in cat]
        cat = [c[np.arange(len(c)) - np.searchsorted(cat[0], cat[0]) < k] for c in cat]
        return pa.table({"query_id": cat[0], "id": cat[1], "score": cat[2]})

    local = query_side.groupBy("p", "b", "d", "s").cogroup(data_side.groupBy("p", "b", "d", "s")).applyInArrow(solve, "query_id long, id long, score long")
    order = F.struct((-F.col("score")).alias("score"), "id")
    ranked = local.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(order)), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.score")).alias("score"))


def _least(n: int, width: int):
    """A function that keeps the n vectors nearest to the pivot of each cell that a task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cell, far, ids = (batch.column(i).to_numpy() for i in range(3))
            v = matrix(batch.column(3), width)
            for c in np.unique(cell).tolist():
                at = np.flatnonzero(cell == c)
                new = far[at], ids[at], v[at]
                both = tuple(np.concatenate(x) for x in zip(held[c], new, strict=True)) if c in held else new
                order = np.lexsort((both[1], both[0]))[:n]
                held[c] = tuple(x[order] for x in both)
        if held:
            cells = np.concatenate([np.full(len(h[0]), c) for c, h in held.items()])
            far, ids, v = (np.concatenate([h[i] for h in held.values()]) for i in range(3))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * width, pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(far), pa.array(ids), lists], names=["cell", "far", "id", "v"])

    return run
