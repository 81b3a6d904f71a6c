"""Exact top-k by inner product: a Voronoi kNN join.

Vectors and queries belong to the cell of their nearest pivot. Summaries of the cells (size, radius, largest norm,
the smallest distances to the pivot) give every query a score that ``k`` vectors reach for certain and every
cell an upper bound for a query; a query is sent only to cells whose bound reaches its certain score. Cells are
joined into tiles of about equal size, and a crowded cell is cut into several, so that a vector with very many
copies is spread. Each tile is solved by itself and the best rows of all tiles are ranked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlake.llm.common import stored
from chartlake.llm.vectors import best_of, clean_vectors, matrix, ranked, spread

#: Cells at most; each query carries the cells it needs as the bits of a long.
PIVOTS = 63
TILE_ROWS, TILE_QUERIES = 32768, 4096


def _tiles(pivots: np.ndarray, size: np.ndarray, rows: int) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """For each cell its tiles, first tile and number of tiles; neighbours share a tile while there is room."""
    cells = np.flatnonzero(size > 0)
    first, parts = np.zeros(len(size), np.int64), np.ones(len(size), np.int64)
    tile, room, left = -1, 0, list(cells)
    at = left[0] if left else None
    while left:
        left.remove(at)
        if size[at] > rows:
            parts[at] = math.ceil(size[at] / rows)
            first[at] = tile + 1
            tile, room = tile + int(parts[at]), 0
        else:
            if size[at] > room:
                tile, room = tile + 1, rows
            first[at] = tile
            room -= size[at]
        if left:
            at = left[int(np.argmin(((pivots[left] - pivots[at]) ** 2).sum(1)))]
    return [list(range(f, f + p)) if s else [] for f, p, s in zip(first, parts, size, strict=True)], first, parts


def exact_top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id",
                embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query by the inner product of floor(scale * x).

    ``is_query`` is a condition on ``vec_id``. A query's own row is no candidate. Vectors that are null or hold
    nulls or non-finite numbers take no part, nor do rows without an id; rows of one id are one vector; shorter
    vectors count as filled with zeros; ties go to the smaller id; with fewer candidates all are returned; an
    empty table gives an empty result. Products beyond 2^62 raise an error.
    """
    v = clean_vectors(rows, vec_id, embedding).withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    v = stored(v)
    n, dim, top = v.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    dim, top = int(dim or 0), int(top or 0)
    if dim * top * top >= 2**62:
        raise ValueError("inner products of these vectors do not fit into a long")
    exact_float = dim * top * top < 2**53
    kind = np.float64 if exact_float else np.int64
    chosen = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).toArrow()
    pivots = matrix(chosen.column("v"), dim).astype(np.float64) if n else np.zeros((1, dim))

    def assign(batches):
        for b in batches:
            x = matrix(b.column("v"), dim)
            d2 = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
            cell = np.argmin(d2, axis=1)
            dist = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), pa.array(cell, pa.int32()), pa.array(dist), pa.array(np.sqrt((x * x).sum(1)))],
                names=["vec_id", "v", "cell", "dist", "norm"])

    placed = stored(v.mapInArrow(assign, "vec_id bigint, v array<bigint>, cell int, dist double, norm double"))
    size, radius, norm = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("d"), F.max("norm").alias("l")).collect():
        size[r.cell], radius[r.cell], norm[r.cell] = r.n, r.d, r.l
    near = Window.partitionBy("cell").orderBy("dist")
    inner = placed.select("cell", "dist", F.row_number().over(near).alias("r")).filter(F.col("r") <= k + 1).toArrow()
    in_cell, in_dist = inner.column("cell").to_numpy(), inner.column("dist").to_numpy()
    rows_of = min(TILE_ROWS, max(1024, math.ceil(n / 16))) if n else 1024
    tiles_of, first, parts = _tiles(pivots, size, rows_of)
    n_queries = placed.filter(is_query).count()
    blocks = max(1, math.ceil(n_queries / TILE_QUERIES))

    def route(batches):
        """Send each query to the tiles of the cells that can hold one of its k best."""
        for b in batches:
            q = matrix(b.column("v"), dim).astype(np.float64)
            length = np.sqrt((q * q).sum(1))[:, None]
            with_pivot = q @ pivots.T
            sure = with_pivot[:, in_cell] - length * in_dist
            if sure.shape[1] > k:  # k + 1 reach it, one of them may be the query itself
                least = np.partition(sure, sure.shape[1] - k - 1, axis=1)[:, sure.shape[1] - k - 1][:, None]
            else:
                least = np.full((len(q), 1), -np.inf)
            most = np.minimum(with_pivot + length * radius, length * norm)
            slack = 1e-9 * (1.0 + length * norm.max(initial=0.0))
            need = (most >= least - slack) & (size > 0)
            at, tile = [], []
            for i, row in enumerate(need):
                own = sorted({t for c in np.flatnonzero(row) for t in tiles_of[c]})
                at += [i] * len(own)
                tile += own
            bits = need @ (1 << np.arange(len(pivots), dtype=np.int64))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(take), b.column("v").take(take), pa.array(bits[at] if at else np.zeros(0, np.int64)),
                 pa.array(tile, pa.int64())], names=["vec_id", "v", "need", "tile"])

    queries = placed.filter(is_query).select("vec_id", "v").mapInArrow(route, "vec_id bigint, v array<bigint>, need bigint, tile bigint")
    queries = queries.withColumn("tile", F.col("tile") * blocks + spread(F.col("vec_id"), blocks))
    tile = F.element_at(F.lit(first.tolist()), F.col("cell") + 1) + F.pmod(
        F.xxhash64("vec_id"), F.element_at(F.lit(parts.tolist()), F.col("cell") + 1).cast("long"))
    data = placed.select("vec_id", "v", "cell", F.explode(F.sequence(tile * blocks, tile * blocks + blocks - 1)).alias("tile"))

    def solve(key, qs, xs):
        if qs.num_rows and xs.num_rows:
            ids = xs.column("vec_id").to_numpy()
            order = np.argsort(ids)
            x, ids = matrix(xs.column("v"), dim, kind)[order], ids[order]
            cell = xs.column("cell").to_numpy()[order]
            q, need, own = matrix(qs.column("v"), dim, kind), qs.column("need").to_numpy(), qs.column("vec_id").to_numpy()
            got = []
            for a in range(0, len(q), 256):
                s = np.rint(q[a:a + 256] @ x.T).astype(np.int64)
                out = (need[a:a + 256, None] >> cell[None, :] & 1) == 0
                s[out | (own[a:a + 256, None] == ids[None, :])] = np.iinfo(np.int64).min
                got.append(best_of(own[a:a + 256], ids, s, k))
            cols = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*got, strict=True)]
        else:
            cols = [pa.array([], pa.int64())] * 3
        return pa.Table.from_arrays(cols, names=["query_id", "vec_id", "score"])

    found = queries.groupBy("tile").cogroup(data.groupBy("tile")).applyInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    return ranked(found, k)
