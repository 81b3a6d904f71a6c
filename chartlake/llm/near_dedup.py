"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is the weighted set of its runs of five words; a weight is term frequency times inverse document
frequency over all documents. Every sample of a signature is the shingle that wins a consistent weighted race
(gamma and uniform draws looked up by hash), so two documents agree in a sample with the probability of their
weighted Jaccard similarity. As a pair is also linked by its plain Jaccard similarity, and the weighted one of such a
pair can be any lower, as many samples are the least hashes of the unweighted shingles, which agree with the
probability of the plain similarity. ``ROWS`` samples of a kind make a band; documents that agree in a band are
candidates, whose similarity is then computed from their whole texts.

Documents with equal word sequences are one node from the start. In the buckets of the first bands each node is
compared with the one that is in the largest buckets overall, which joins large groups of copies of one text. Then
every two nodes of different classes that share a bucket are compared by their signatures, tile by tile (``across``).
A tile with few candidates gives them as pairs, whose texts are compared; a tile with more candidates than nodes gives
its nodes, whose texts meet in that tile once more (``crowded``): all similarities of the tile are two products of
node-by-shingle matrices, and what leaves is a spanning forest of the links. So rows grow with the nodes of a bucket,
not with its pairs, and no bucket is too large and no node left out.

Frequencies: a table of 2^20 hashed counts shows which shingles can reach the least counted frequency
``total / 2^17``; these are counted exactly. There are at most 2^17 of them, whatever the size of the corpus;
all rarer shingles have the highest weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.llm.common import compact, mix64, slices, stored, unused, utf8_parts, window_hashes, word_hashes, word_spans
from chartlake.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
#: Bands of each kind of samples: first the weighted ones, then the plain ones.
ROWS, BANDS = 4, 14
#: Bands whose buckets are compared with their least node first.
FIRST = 4
#: Share of equal samples, of the weighted or of the plain ones, below which a pair is not compared further; at a
#: similarity of 0.8 it is 3.7 deviations low.
LEAST_EQUAL = 0.6
#: Nodes of a bucket that are compared at a time with so many others; a text counts once more for every WEIGHT bytes.
TILE, WEIGHT = 2048, 4096
#: Columns of a tile's matrices that are multiplied at a time.
COLUMNS = 2048
_BUCKETS = 1 << 20
_HEAVY = 1 << 17
_DRAWS = 1 << 16


class _Shingles:
    """Distinct shingles of the texts of a slice, sorted by text."""

    def __init__(self, col):
        raw, off = utf8_parts(col)
        starts, ends, first = word_spans(raw, off)
        words = word_hashes(raw, starts, ends)
        n = len(off) - 1
        self.words = np.diff(first)
        # identity of the whole word sequence, 128 bits
        power = np.cumprod(np.full(len(words) + 1, 0xD1342543DE82EF95, np.uint64)) if len(words) else np.ones(1, np.uint64)
        inverse = np.cumprod(np.full(len(words) + 1, pow(0xD1342543DE82EF95, -1, 2**64), np.uint64)) if len(words) else power
        self.id = np.empty((n, 2), np.uint64)
        for k, h in enumerate((words, mix64(words ^ np.uint64(0x6A09E667F3BCC908)))):
            acc = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(h * power[:len(h)], out=acc[1:])
            self.id[:, k] = mix64((acc[first[1:]] - acc[first[:-1]]) * inverse[first[:-1]] + self.words.astype(np.uint64))
        at, g = window_hashes(words, first, SHINGLE)
        doc = np.searchsorted(first, at, "right") - 1
        short = np.flatnonzero((self.words > 0) & (self.words < SHINGLE))
        if len(short):
            doc, g = np.r_[doc, short], np.r_[g, self.id[short, 0]]
        v = np.sort(doc.astype(np.uint64) << np.uint64(48) | g >> np.uint64(16))
        self.start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
        self.tf = np.diff(np.r_[self.start, len(v)])
        v = v[self.start]
        self.key = v
        self.doc = (v >> np.uint64(48)).astype(np.int64)
        self.shingle = v & np.uint64((1 << 48) - 1)
        self.first = np.searchsorted(self.doc, np.arange(n + 1))

    def bucket(self) -> np.ndarray:
        return (self.shingle & np.uint64(_BUCKETS - 1)).astype(np.int64)


class Idf:
    """Weights of shingles: 1 + ln(n / df) / ln(n / least) for the counted ones, 2 for all rarer ones."""

    def __init__(self, n_docs: int, least: int, shingles: np.ndarray, df: np.ndarray, buckets: np.ndarray):
        order = np.argsort(shingles)
        self.shingles = shingles[order]
        span = math.log(n_docs / least) if n_docs > least else 1.0
        self.weight = np.clip(1.0 + np.log(n_docs / df[order]) / span, 1.0, 2.0) if len(df) else np.zeros(0)
        self.buckets = np.packbits(buckets)

    def of(self, s: _Shingles) -> np.ndarray:
        out = np.full(len(s.shingle), 2.0)
        if len(self.shingles):
            b = s.bucket()
            maybe = np.flatnonzero(self.buckets[b >> 3] >> (7 - (b & 7)).astype(np.uint8) & 1)
            at = np.minimum(np.searchsorted(self.shingles, s.shingle[maybe]), len(self.shingles) - 1)
            hit = self.shingles[at] == s.shingle[maybe]
            out[maybe[hit]] = self.weight[at[hit]]
        return out


def corpus_idf(docs: DataFrame, text: str) -> Idf:
    """Document frequencies over all documents; what reaches the driver is bounded by the two table sizes."""
    src = docs.select(F.col(text).alias("text"))
    part = _BUCKETS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, n = np.zeros(_BUCKETS, np.int64), 0
        for b in slices(batches, "text"):
            s = _Shingles(b.column("text"))
            acc += np.bincount(s.bucket(), minlength=_BUCKETS)
            n += int((s.words > 0).sum())
        yield pa.RecordBatch.from_pydict({"part": list(range(65)), "data": [
            acc[k * part:(k + 1) * part].tobytes() for k in range(64)] + [np.array([n], np.int64).tobytes()]},
            schema=pa.schema([("part", pa.int32()), ("data", pa.binary())]))

    def add(key, table):
        total = sum(np.frombuffer(d, np.int64) for d in table.column("data").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    kind = "part int, data binary"
    rows = {r.part: np.frombuffer(bytes(r.data), np.int64)
            for r in src.mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind).collect()}
    none = np.zeros(part, np.int64)
    counts = np.concatenate([rows.get(k, none) for k in range(64)])
    n_docs = int(rows.get(64, np.zeros(1, np.int64))[0])
    least = max(2, math.ceil(counts.sum() / _HEAVY))
    candidates = counts >= least
    bits = np.packbits(candidates)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["s", "n"])

        for b in slices(batches, "text"):
            s = _Shingles(b.column("text"))
            k = s.bucket()
            held.append(s.shingle[(bits[k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1) > 0])
            if sum(map(len, held)) > 1 << 20:
                yield flush()
        if held:
            yield flush()

    heavy = np.zeros((0, 2), np.int64)
    if candidates.any():
        found = src.mapInArrow(exact, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).filter(
            F.col("n") >= least).toArrow()
        heavy = np.stack([found.column("s").to_numpy(), found.column("n").to_numpy()], axis=1)
    return Idf(n_docs, least, heavy[:, 0].astype(np.uint64), heavy[:, 1].astype(float), candidates)


class _Race:
    """The draws of improved consistent weighted sampling, one row of r, c, beta for each hash value."""

    def __init__(self):
        rng = np.random.RandomState(7)
        self.r = rng.gamma(2.0, 1.0, _DRAWS)
        self.c = rng.gamma(2.0, 1.0, _DRAWS)
        self.beta = rng.random_sample(_DRAWS)
        self.multipliers = rng.randint(1, 2**63, ROWS * BANDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.plain = rng.randint(1, 2**63, ROWS * BANDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.usual = self.entry(np.arange(_DRAWS), np.full(_DRAWS, 2.0))

    def entry(self, i: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Race time of a shingle with draw i and a weight in the high 32 bits, its quantised weight in the low ones."""
        r, beta = self.r[i], self.beta[i]
        t = np.floor(np.log(weight) / r + beta)
        a = self.c[i] / np.exp(r * (t - beta) + r)
        low = mix64(t.astype(np.int64).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
        return a.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | low

    def samples(self, s: _Shingles, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts with shingles) x 2 BANDS band keys, and x all samples, shortened to 32 bits."""
        h = mix64(s.shingle + np.uint64(0x9E3779B97F4A7C15))
        full = np.flatnonzero(np.diff(s.first) > 0)
        start = s.first[full]
        odd = np.flatnonzero(weight != 2.0)
        out = np.zeros((len(full), 2 * BANDS), np.uint64)
        each = np.zeros((len(full), 2 * ROWS * BANDS), np.uint32)

        def put(k: int, least: np.ndarray) -> None:
            band = k // ROWS
            out[:, band] = mix64(out[:, band] * np.uint64(0x2545F4914F6CDD1D) + least + np.uint64(band + 1))
            each[:, k] = mix64(least).astype(np.uint32)

        for k, m in enumerate(self.multipliers):
            v = h * m
            i = v >> np.uint64(48)
            low = (v >> np.uint64(16)) & np.uint64(0xFFFFFFFF)
            key = self.usual[i] ^ low
            if len(odd):
                key[odd] = self.entry(i[odd].astype(np.int64), weight[odd]) ^ low[odd]
            put(k, np.minimum.reduceat(key, start))
        for k, m in enumerate(self.plain):
            put(ROWS * BANDS + k, np.minimum.reduceat(h * m, start))
        return out, each


def _node(s: _Shingles) -> list:
    raw = s.id.tobytes()
    return [raw[16 * k:16 * k + 16] if w else None for k, w in enumerate(s.words)]


def signatures(docs: DataFrame, idf: Idf, doc_id: str, text: str) -> DataFrame:
    """doc_id, node (identity of the word sequence, null without words), bands, samples, bytes of the text."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        race = _Race()
        for b in slices(batches, "text"):
            s = _Shingles(b.column("text"))
            length = np.diff(utf8_parts(b.column("text"))[1])
            if len(s.shingle):
                keys, each = race.samples(s, s.tf * idf.of(s))
            else:
                keys, each = np.zeros((0, 2 * BANDS), np.uint64), np.zeros((0, 2 * ROWS * BANDS), np.uint32)
            has = s.words > 0
            size = np.where(has, 2 * BANDS, 0)
            bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()),
                                             pa.array(keys.reshape(-1).view(np.int64)))
            wide, data = 8 * ROWS * BANDS, each.tobytes()
            at = np.cumsum(has) - 1
            samples = [data[wide * k:wide * k + wide] if h else None for k, h in zip(at.tolist(), has.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_node(s), pa.binary()), bands, pa.array(samples, pa.binary()), pa.array(length)],
                                             names=["doc_id", "node", "bands", "samples", "bytes"])

    return src.mapInArrow(run, "doc_id bigint, node binary, bands array<bigint>, samples binary, bytes bigint")


def node_bits(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over a table of nodes; it only spares moving texts that are not needed."""
    slot = F.conv(F.hex(F.substring("node", 1, 3)), 16, 10).cast("long")
    got = nodes.select(slot.alias("s")).select(
        F.shiftright("s", 6).alias("w"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("m")
    ).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bits = np.zeros(1 << 18, np.int64)
    bits[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return bits.view(np.uint64)


def texts_of(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """(node, text) of the given nodes, one text each; a task tells a node once."""
    bits = node_bits(nodes)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in slices(batches, "text"):
            s = _Shingles(b.column("text"))
            node, keep = _node(s), []
            for k in np.flatnonzero(_maybe(bits, s.id.view(np.uint8).reshape(-1, 16))):
                if node[k] is not None and node[k] not in seen:
                    seen.add(node[k])
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([node[k] for k in keep], pa.binary()),
                                              b.column("text").take(pa.array(keep, pa.int64()))], names=["node", "text"])

    got = docs.select(F.col(text).alias("text")).mapInArrow(tell, "node binary, text string")
    return got.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def _maybe(bits: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Whether the Bloom filter holds nodes given as rows of bytes."""
    top = raw[:, :3].astype(np.int64) @ np.array([1 << 16, 1 << 8, 1])
    return (bits[top >> 6] >> (top & 63).astype(np.uint64) & np.uint64(1)) > 0


def _enough(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether signatures agree in ``LEAST_EQUAL`` of the samples of a kind or more, row by row."""
    return (x == y).reshape(-1, 2, ROWS * BANDS).sum(2).max(1) >= math.ceil(LEAST_EQUAL * ROWS * BANDS)


def _similar(ta, tb, idf: Idf, threshold: float) -> np.ndarray:
    """Whether texts of two columns have a weighted or plain Jaccard similarity of the threshold or more, row by row."""
    x, y = _Shingles(ta), _Shingles(tb)
    wx, wy = x.tf * idf.of(x), y.tf * idf.of(y)
    _, i, j = np.intersect1d(x.key, y.key, assume_unique=True, return_indices=True)
    n = len(ta)
    doc = x.doc[i]
    both = np.bincount(doc, np.minimum(wx[i], wy[j]), n)
    sums = np.bincount(x.doc, wx, n) + np.bincount(y.doc, wy, n)
    weighted = both / np.maximum(sums - both, 1e-300)
    shared = np.bincount(doc, minlength=n)
    plain = shared / np.maximum(np.diff(x.first) + np.diff(y.first) - shared, 1)
    return np.maximum(weighted, plain) >= threshold - 1e-12


def _needed(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of the given nodes (and of a few others, as the filter is a Bloom filter)."""
    bits = node_bits(nodes)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.frombuffer(b"".join(b.column("node").to_pylist()), np.uint8).reshape(-1, 16)
            yield b.filter(pa.array(_maybe(bits, raw)))

    return texts.mapInArrow(needed, "node binary, text string")


def verify(texts: DataFrame, pairs: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have a weighted or plain Jaccard similarity of the threshold or more.

    The plain similarity counts too, so that a copy is not lost because the words it shares are frequent.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ta"):
            yield b.select(["a", "b"]).filter(pa.array(_similar(b.column("ta"), b.column("tb"), idf, threshold)))

    used = _needed(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    named = lambda k: used.select(F.col("node").alias(k), F.col("text").alias(f"t{k}"))
    return pairs.select("a", "b").join(named("a"), "a").join(named("b"), "b").mapInArrow(compare, "a binary, b binary")


def _whole_groups(run):
    """A function over record batches sorted by ``g`` that hands ``run`` tables of whole groups."""
    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            if held and (cut or held[0].column("g")[0].as_py() != int(g[0])):
                yield from run(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif cut:
                yield from run(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut))
        if held:
            yield from run(pa.Table.from_batches(held))

    return batched


def across(members: DataFrame, roots: DataFrame, samples: DataFrame) -> DataFrame:
    """Where nodes of different classes share a bucket and their signatures agree in enough samples: rows ``a, b`` of such
    pairs, or, from a tile with more of them than nodes, rows ``a, g, side, root`` of the nodes that occur in them.

    A bucket of more than ``TILE`` nodes is cut into tiles by hash, and each two tiles are a group of their own; a class
    of more than that has its own tiles, which do not meet each other."""
    here = members.join(roots, "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("root"), (1 + F.col("bytes") / WEIGHT).cast("long").alias("w"))
    sizes = here.groupBy("key", "root").agg(F.sum("w").alias("c"))
    large = F.col("c") > TILE
    mixed = compact(sizes.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("n"), F.sum(
        F.when(~large, F.col("c")).otherwise(0)).alias("rest")).filter("k > 1").drop("k"))
    whole = here.join(mixed.filter(F.col("n") <= TILE).select("key"), "key").select(
        F.col("key").alias("g"), F.lit(0).alias("side"), "root", "node")
    # the own tiles of a large class have its root, the others none
    cut = compact(sizes.join(mixed.filter(F.col("n") > TILE), "key").select(
        "key", "root", F.when(large, F.col("root")).alias("own"),
        F.ceil(F.when(large, F.col("c")).otherwise(F.col("rest")) / TILE).alias("tiles")))
    tile = lambda k: F.xxhash64(F.coalesce("own", F.lit(b"")), k)
    tiles = cut.select("key", "own", "tiles").distinct().select("key", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("i"))
    tiles = tiles.select("key", "own", tile(F.col("i")).alias("t"))
    meet = tiles.join(tiles.select("key", F.col("own").alias("own2"), F.col("t").alias("t2")), "key").filter(
        "t < t2 and not coalesce(own = own2, false) or t = t2 and own is null")
    sides = compact(meet.select("key", F.xxhash64("key", "t", "t2").alias("g"), F.explode(F.expr(
        "if(t = t2, array(struct(t, 0 as side)), array(struct(t, 1 as side), struct(t2 as t, 2 as side)))")).alias("x")).select(
        "key", "g", "x.t", "x.side"))
    placed = here.join(cut, ["key", "root"]).select("key", "root", "node", tile(F.expr("pmod(xxhash64(node, 7), tiles)")).alias("t"))
    rows = whole.unionByName(placed.join(sides, ["key", "t"]).select("g", "side", "root", "node"))
    rows = rows.join(samples, "node").select("g", "side", F.xxhash64("root").alias("root"), "node", "samples")

    def meet_all(t: pa.Table) -> Iterator[pa.RecordBatch]:
        g, side, root = (t.column(k).to_numpy() for k in ("g", "side", "root"))
        each = np.frombuffer(b"".join(t.column("samples").to_pylist()), np.uint32).reshape(-1, 2 * ROWS * BANDS).astype(np.uint8)
        group = np.cumsum(np.r_[0, g[1:] != g[:-1]])
        size = np.bincount(group)
        found, count, met = [], np.zeros(len(size), np.int64), np.zeros(len(g), bool)
        for d in range(1, t.num_rows):
            same = g[d:] == g[:-d]
            if not same.any():
                break
            i = np.flatnonzero(same & (root[d:] != root[:-d]) & ((side[d:] == 0) | (side[d:] != side[:-d])))
            i = i[_enough(each[i], each[i + d])]
            if len(i):
                met[i] = met[i + d] = True
                count += np.bincount(group[i], minlength=len(size))
                i = i[count[group[i]] <= size[group[i]]]
                found.append((i, i + d))
        few = count <= size
        node = t.column("node").to_pylist()
        pairs = sorted({(min(node[x], node[y]), max(node[x], node[y])) for i, j in found
                        for x, y in zip(i.tolist(), j.tolist(), strict=True) if few[group[x]]})
        none = [None] * len(pairs)
        yield pa.RecordBatch.from_arrays([*[pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], *[
            pa.array(none, k) for k in (pa.int64(), pa.int32(), pa.int64())]], names=["a", "b", "g", "side", "root"])
        at = np.flatnonzero(met & ~few[group])
        yield pa.RecordBatch.from_arrays([
            pa.array([node[k] for k in at], pa.binary()), pa.array([None] * len(at), pa.binary()), pa.array(g[at], pa.int64()),
            pa.array(side[at], pa.int32()), pa.array(root[at], pa.int64())], names=["a", "b", "g", "side", "root"])

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(
        _whole_groups(meet_all), "a binary, b binary, g bigint, side int, root bigint")


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix."""
    fresh, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not fresh[start]:
            continue
        fresh[start], todo = False, [start]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(linked[x] & fresh)
            fresh[new] = False
            out += [(x, y) for y in new.tolist()]
            todo += new.tolist()
    return out


def _tile_links(texts, side: np.ndarray, root: np.ndarray, idf: Idf, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between texts of a tile that differ in class (and side, where it has two).

    A weight is term frequency times inverse document frequency, so the least of two weights of a shingle is a sum over
    levels l of [both occur l times or more] times its inverse document frequency: both kinds of similarity are products
    of matrices with a column for each (shingle, level). Columns of one text only are left out."""
    s = _Shingles(texts)
    n, idf_of = len(side), idf.of(s)
    weight, distinct = np.bincount(s.doc, s.tf * idf_of, n), np.diff(s.first)
    doc, level = np.repeat(s.doc, s.tf), np.arange(s.tf.sum()) - np.repeat(np.cumsum(s.tf) - s.tf, s.tf)
    _, shingle = np.unique(np.repeat(s.shingle, s.tf), return_inverse=True)
    _, col, df = np.unique(shingle.astype(np.int64) << 32 | level, return_inverse=True, return_counts=True)
    keep = df[col] > 1
    col, at, of = np.cumsum(df > 1)[col[keep]] - 1, doc[keep], np.repeat(idf_of, s.tf)[keep]
    order, first = np.argsort(col, kind="stable"), (level == 0)[keep]
    col, at, of, first = col[order], at[order], of[order], first[order]
    shared, both = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for k in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        i, j = np.searchsorted(col, [k, k + COLUMNS])
        m = np.zeros((n, min(COLUMNS, int(col[j - 1]) - k + 1)), np.float32)
        m[at[i:j], col[i:j] - k] = 1
        w, one = np.zeros(m.shape[1], np.float32), np.zeros(m.shape[1], np.float32)
        w[col[i:j] - k], one[col[i:j] - k] = of[i:j], first[i:j]
        both += (m * w) @ m.T
        m = m[:, one > 0]
        shared += m @ m.T
    near = np.maximum(both / np.maximum(weight[:, None] + weight - both, 1e-30), shared / np.maximum(distinct[:, None] + distinct - shared, 1))
    may = (root[:, None] != root) & ((side[:, None] == 0) | (side[:, None] != side))
    linked = may & (near >= threshold + 1e-3)
    # too close to the threshold for sums of short floats: compared exactly
    i, j = np.nonzero(np.triu(may & (np.abs(near - threshold) < 1e-3), 1))
    for k in range(0, len(i), 256):
        x, y = i[k:k + 256], j[k:k + 256]
        same = _similar(texts.take(pa.array(x)), texts.take(pa.array(y)), idf, threshold)
        linked[x[same], y[same]] = linked[y[same], x[same]] = True
    return _forest(linked)


def crowded(tiles: DataFrame, texts: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """(a, b) of a spanning forest of the links in each tile ``a, g, side, root`` that ``across`` found too full for pairs."""
    def link(t: pa.Table) -> Iterator[pa.RecordBatch]:
        g, side, root = (t.column(k).to_numpy() for k in ("g", "side", "root"))
        node, text = t.column("node").to_pylist(), t.column("text").combine_chunks()
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        for i, j in zip(start, np.r_[start[1:], len(g)], strict=True):
            got = _tile_links(text.slice(i, j - i), side[i:j], root[i:j], idf, threshold)
            pairs = [(min(node[i + x], node[i + y]), max(node[i + x], node[i + y])) for x, y in got]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    rows = tiles.select(F.col("a").alias("node"), "g", "side", "root")
    rows = rows.join(_needed(texts, rows.select("node").distinct()), "node")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_whole_groups(link), "a binary, b binary").distinct()


def classes(docs: DataFrame, doc_id: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node of every document), (node, least doc_id, n documents, root of its class, n_links)."""
    idf = corpus_idf(docs, text)
    rows = stored(signatures(docs, idf, doc_id, text))
    nodes = rows.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.min(F.struct("bands", "samples")).alias("s"), F.max("bytes").alias("bytes"))
    nodes = stored(nodes.select("node", "doc_id", "n", "s.bands", "s.samples", "bytes"))
    keyed = nodes.select("node", "bytes", F.posexplode("bands").alias("band", "key"))
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(keyed.join(met, "key"))
    # a text that others were copied from shares the largest buckets; it comes first in all of them
    fame = compact(members.groupBy("node").agg(F.sum("n").alias("fame")).select("node", F.struct((-F.col("fame")).alias("f"), "node").alias("place")))
    members = stored(members.join(fame, "node").select("key", "node", "bytes", "band", "place"))
    texts = stored(texts_of(docs, fame.select("node"), text))
    first = members.filter(f"band < {FIRST}").groupBy("key").agg(F.min("place").alias("p")).select("key", F.col("p.node").alias("hub"))
    tested = members.filter(f"band < {FIRST}").join(first, "key").filter("node <> hub")
    tested = compact(tested.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    links = compact(verify(texts, tested, idf, threshold))
    roots = connected_components(links)
    found = stored(across(members, roots, nodes.select("node", "samples")))
    pairs = found.filter("b is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
    links = compact(links.union(verify(texts, compact(pairs), idf, threshold)).union(crowded(found.filter("b is null"), texts, idf, threshold)).distinct())
    roots = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    placed = nodes.select("node", "doc_id", "n").join(roots, "node", "left").join(degree, "node", "left").select(
        "node", "doc_id", "n", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.select("doc_id", "node"), compact(placed)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, class_id (least doc_id of its class), class_size, n_links.

    Texts with equal words are one node. Texts without words (null, empty, white space) are each a class of
    their own, with their own id. Texts of one to four words have one shingle, all their words. Null ids take
    part; a class id is null only if all its ids are. Repeated rows count as documents; an empty table gives an
    empty result; other columns are not read. ``n_links`` counts the verified links of the document's node.
    """
    rows, placed = classes(docs, doc_id, text, threshold)
    by_root = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = placed.join(by_root, "root").select("node", "class_id", "class_size", "n_links")
    return rows.join(of_node, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one of each class left, the one with the least id (null ids last), columns as they are.

    Texts without words (null, empty, white space) all stay. Of rows alike in id and words one stays. An empty table gives
    an empty result. Other columns pass through, whatever their names.
    """
    _, placed = classes(docs, doc_id, text, threshold)
    last = F.lit(2**63 - 1)
    names = docs.columns
    node, id_, first = unused(names, "_node", "_id", "_first")
    firsts = placed.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("id"), "node")).alias("k")).select(
        F.col("k.node").alias(node), F.col("k.id").alias(id_), F.lit(True).alias(first))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            yield b.append_column(node, pa.array(_node(_Shingles(b.column(text))), pa.binary()))

    every = docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(node, T.BinaryType())])).withColumn(
        id_, F.coalesce(F.col(f"`{doc_id}`").cast("long"), last))
    # documents without words find no partner in the join and all stay; of the others those with the class's least id stay,
    # of rows alike in words and id the first (combined before the shuffle)
    kept = every.join(firsts, [node, id_], "left").filter(F.col(node).isNull() | F.col(first))
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    one = kept.filter(F.col(node).isNotNull()).groupBy(node, id_).agg(F.first(row).alias("row")).select("row.*")
    return kept.filter(F.col(node).isNull()).select(*[F.col(f"`{c}`") for c in names]).unionByName(one)
