"""Approximate nearest neighbours by inner product: multi-index hashing of learned rotated binary codes.

Vectors are put on a sphere (one more component makes up for shorter ones), so that the inner product orders like
the angle. Rotations learned by iterative quantisation on a bounded sample turn them into codes of ``BITS`` signs.
A code is split into substrings of eight bits; each tile of rows has a table for every substring with the rows of
each of its 256 values as a bitmap. For a Hamming radius, the pigeonhole principle says how far a probe must
reach in each substring so that no code within the radius is missed; the codes met are checked in full, and those
within the radius are ranked by the exact inner product of the original vectors.

The radius comes from the sample: it covers the Hamming distances of true neighbours there, which are farther
than those in the whole table. Queries that find fewer than ``k`` rows search once more with the full radius.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.llm.common import stored
from chartlake.llm.vectors import best_of, clean_vectors, matrix, ranked, spread

BITS = 256
#: Rows that rotations and radius are learnt from at most: those with the least hash of the id.
SAMPLE = 5000
#: Share of true neighbours in the sample that the radius covers.
COVER = 0.97
TILE_ROWS, TILE_QUERIES = 16384, 4096
_BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
_APART = (_BYTES[:, None, :] != _BYTES[None, :, :]).sum(2)


def _sphere(x: np.ndarray, largest: float) -> np.ndarray:
    x = x / max(largest, 1e-300)
    return np.c_[x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))]


def learn_rotations(x: np.ndarray, rounds: int = 15) -> np.ndarray:
    """(dimension x BITS) projections: blocks of rotations by iterative quantisation from different starts."""
    dim = x.shape[1]
    rng = np.random.RandomState(11)
    blocks = []
    for _ in range(math.ceil(BITS / dim)):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(rounds if len(x) else 0):
            u, _, vt = np.linalg.svd(x.T @ np.where(x @ r >= 0, 1.0, -1.0))
            r = u @ vt
        blocks.append(r)
    return np.concatenate(blocks, axis=1)[:, :BITS]


def codes_of(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    return np.packbits(x @ rotations >= 0, axis=1)


class SubstringTables:
    """Bitmaps of a tile's rows by substring and value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        n, m = codes.shape
        self.maps = np.zeros((m, 256, (n + 7) // 8), np.uint8)
        row = np.arange(n)
        for j in range(m):
            np.bitwise_or.at(self.maps[j], (codes[:, j], row >> 3), (128 >> (row & 7)).astype(np.uint8))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from ``code`` in at most ``radius`` bits."""
        n, m = self.codes.shape
        reach, rest = divmod(radius, m)
        met = np.zeros(self.maps.shape[2], np.uint8)
        for j in range(m):
            far = reach if j <= rest else reach - 1
            if far >= 8:
                met[:] = 255
                break
            if far >= 0:
                met |= np.bitwise_or.reduce(self.maps[j][_APART[code[j]] <= far], axis=0)
        rows = np.flatnonzero(np.unpackbits(met, count=n))
        apart = np.bitwise_count((self.codes[rows] ^ code).view(np.uint64)).sum(1)
        return rows[apart <= radius]


def nearest(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, by the largest inner product.

    ``is_query`` is a condition on ``vec_id``. A query's own row is no candidate. Vectors that are null or zero or
    hold nulls or non-finite numbers take no part, nor do rows without an id; rows of one id are one vector;
    shorter vectors count as filled with zeros; ties go to the smaller id; with fewer candidates all are returned;
    an empty table gives an empty result.
    """
    v = clean_vectors(rows, vec_id, embedding).filter(F.exists("v", lambda x: x != 0))
    v = stored(v)
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, dim, largest = v.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm2)).first()
    dim, largest = int(dim or 0), math.sqrt(largest or 0.0)
    sample = matrix(v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column("v"), dim)
    rotations = learn_rotations(_sphere(sample, largest)) if n else np.zeros((dim + 1, BITS))
    radius = _radius(sample, rotations, largest, k)
    n_queries = v.filter(is_query).count()
    blocks = max(1, math.ceil(n_queries / TILE_QUERIES))
    tiles = max(12, math.ceil(n / TILE_ROWS))
    data = v.withColumn("tile", spread(F.col("vec_id"), tiles)).select(
        "vec_id", "v", F.explode(F.sequence(F.col("tile") * blocks, F.col("tile") * blocks + blocks - 1)).alias("tile"))

    def search(queries: DataFrame, far: int) -> DataFrame:
        def solve(key, qs, xs):
            got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if qs.num_rows and xs.num_rows:
                ids = xs.column("vec_id").to_numpy()
                order = np.argsort(ids)
                x, ids = matrix(xs.column("v"), dim)[order], ids[order]
                tables = SubstringTables(codes_of(_sphere(x, largest), rotations))
                q, own = matrix(qs.column("v"), dim), qs.column("vec_id").to_numpy()
                length = np.sqrt((q * q).sum(1))[:, None]
                code = codes_of(np.c_[q / length, np.zeros(len(q))], rotations)
                for i in range(len(q)):
                    near = tables.within(code[i], far)
                    near = near[ids[near] != own[i]]
                    got.append(best_of(own[i:i + 1], ids[near], (x[near] * q[i]).sum(1)[None, :], k))
            return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got, strict=True)],
                                        names=["query_id", "vec_id", "score"])

        sent = queries.select("vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile"))
        sent = sent.withColumn("tile", F.col("tile") * blocks + spread(F.col("vec_id"), blocks))
        return sent.groupBy("tile").cogroup(data.groupBy("tile")).applyInArrow(solve, "query_id bigint, vec_id bigint, score double")

    queries = v.filter(is_query)
    found = stored(search(queries, radius))
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, max(0, n - 1)))
    short = stored(queries.join(enough.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"))
    if not short.isEmpty():
        again = search(short, BITS)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return ranked(found, k)


def _radius(sample: np.ndarray, rotations: np.ndarray, largest: float, k: int) -> int:
    """Hamming radius that covers the true neighbours of sample queries within the sample."""
    if len(sample) < 2:
        return BITS
    q = sample[:: max(1, len(sample) // 200)]
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(sample))[:: max(1, len(sample) // 200)]] = -np.inf
    k = min(k, len(sample) - 1)
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    codes = codes_of(_sphere(sample, largest), rotations)
    asked = codes_of(np.c_[q / np.sqrt((q * q).sum(1))[:, None], np.zeros(len(q))], rotations)
    apart = np.bitwise_count(codes[best] ^ asked[:, None, :]).sum(2)
    return int(np.quantile(apart, COVER))
