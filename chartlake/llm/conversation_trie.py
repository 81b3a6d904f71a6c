"""Prefix trie of conversations: double-array tries per prefix shard, shared upper nodes merged globally.

A conversation is its ordered list of turns, each a 128-bit hash of (role, text) and the text's bytes. Conversations of
equal turns are one path (counted before the shuffle). Paths are dealt to shards by a prefix: one turn, or twice as many
as long as the paths of a prefix are too many for a task. So all nodes at the depth of that cut and below lie in one
shard, which packs them into BASE and CHECK arrays over its dense turn ids, walks all its paths through the arrays, and
sums its subtrees. Nodes above the cut (always the root) are shared by shards: each shard gives its part of them, and
they are added up by key as a table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.llm.common import mix64, stored, text_or_empty

#: Turns of distinct paths that one shard takes; a prefix with more (and more than one path) is cut deeper.
SHARD_TURNS = 200_000
#: Conversation ids joined into one piece of a member list.
PIECE = 4096
#: Copies of a shared node in the join that gives its children their parent, so that a node with many children is no hot key.
SALTS = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_MUL = np.uint64(0x9E3779B97F4A7C15)


# lists of turns ------------------------------------------------------------------
def turn_lists(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``c, t``: each conversation with its turns in order (null first), as structs of two hashes and the text's bytes.

    A null role or text is empty. Turns of one number keep an order fixed by their hashes. Rows without a conversation
    id belong to no conversation. Other columns are not read. A conversation's turns (24 bytes each) fit a task."""
    r, x = text_or_empty(role), text_or_empty(text)
    hashed = rows.select(
        F.col(conv_id).cast("long").alias("c"), F.struct(
            F.col(turn).cast("long").alias("k"), F.xxhash64(r, x).alias("a"), F.xxhash64(F.lit("second"), x, r).alias("b"),
            F.octet_length(x).cast("long").alias("n")).alias("s")).filter("c is not null")
    lists = hashed.groupBy("c").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return lists.select("c", F.transform("s", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["n"].alias("n"))).alias("t"))


def with_shared_heads(lists: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """Each list with its first h turns taken from the first conversation of its group (id less id % group; none if absent),
    h = CRC-32 of the decimal id modulo ``most`` + 1. One equi-join on the group."""
    heads = lists.filter(F.col("c") % group == 0).select(F.col("c").alias("_g"), F.slice("t", 1, most).alias("_head"))
    h = (F.crc32(F.col("c").cast("string")) % (most + 1)).cast("int")
    got = lists.withColumn("_g", F.col("c") - F.col("c") % group).withColumn("_h", h).join(heads, "_g", "left")
    none = F.slice("t", 1, 0)
    return got.select("c", F.concat(F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h")),
                                    F.slice("t", F.col("_h") + 1, F.size("t"))).alias("t"))


# member lists --------------------------------------------------------------------
def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (p, q, c) to runs of joined ids, PIECE at most each."""
    for b in batches:
        p, q, c = (np.asarray(b.column(k)) for k in range(3))
        if not len(p):
            continue
        new = np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
        start = np.flatnonzero(new)
        inside = np.arange(len(p)) - np.repeat(start, np.diff(np.r_[start, len(p)]))
        start = np.flatnonzero(new | (inside % PIECE == 0))
        ids = [",".join(map(str, c[i:j].tolist())) for i, j in zip(start, np.r_[start[1:], len(p)])]
        yield pa.RecordBatch.from_arrays([pa.array(p[start]), pa.array(q[start]), pa.array(c[start]), pa.array(ids, pa.string())],
                                         ["p", "q", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (p, q, first) to one SHA-256 a path, fed piece by piece."""
    at, sha = None, None
    for b in batches:
        out = []
        for p, q, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
            if (p, q) != at:
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = (p, q), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield _digest_rows(out)
    if at is not None:
        yield _digest_rows([(*at, sha.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["p", "q", "ends"])


def member_digests(members: DataFrame) -> DataFrame:
    """``p, q, ends``: SHA-256 of each path's conversation ids, ascending, joined by commas. ``members``: p, q, c.

    Ids are sorted by range over all tasks and joined to pieces there, so a path with a third of all conversations reaches
    the one task that a running hash needs as few long pieces, one at a time."""
    pieces = members.select("p", "q", "c").repartitionByRange("p", "q", "c").sortWithinPartitions("p", "q", "c").mapInArrow(
        _pieces, "p long, q long, first long, ids string")
    return pieces.repartition("p", "q").sortWithinPartitions("p", "q", "first").mapInArrow(_digests, "p long, q long, ends string")


# double arrays -------------------------------------------------------------------
class DoubleArray:
    """A trie as two integer arrays: a node is a slot, and its child by ``code`` is the slot BASE[node] + code, if CHECK of that
    slot names the node. The root is slot 0; codes begin at 1; ``codes[off[i]:off[i + 1]]`` is path i."""

    def __init__(self, codes: np.ndarray, off: np.ndarray):
        self.base = np.zeros(1, np.int64)
        self.check = np.zeros(1, np.int64)  # -1: free
        self._low, self._top = 1, 0
        size = np.diff(off)
        state = np.zeros(len(size), np.int64)
        live = np.flatnonzero(size > 0)
        depth = 0
        while len(live):
            s, c = state[live], codes[off[live] + depth]
            order = np.lexsort((c, s))
            s, c = s[order], c[order]
            new = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])]
            self._pack(s[new], c[new])
            depth += 1
            state[live] = self.base[state[live]] + codes[off[live] + depth - 1]
            live = live[size[live] > depth]

    def _room(self, upto: int) -> None:
        if upto >= len(self.check):
            more = max(1024, len(self.check), upto + 1 - len(self.check))
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """The first ``n`` free slots."""
        width = 2 * n + 64
        while True:
            self._room(self._low + width)
            free = self._low + np.flatnonzero(self.check[self._low:self._low + width] < 0)
            if len(free) >= n:
                self._low = int(free[0])
                return free[:n]
            width *= 2

    def _pack(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Give each parent a base that puts all its children on free slots; pairs are sorted by parent, then code."""
        start = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        count = np.diff(np.r_[start, len(parents)])
        for i, n in zip(start[count > 1], count[count > 1]):
            c = codes[i:i + n]
            first = self._free(64)
            self._room(int(first[-1] + c[-1] - c[0]))
            fits = (self.check[first[:, None] + (c - c[0])] < 0).all(1)
            if fits.any():
                at = first[fits.argmax()]
            else:  # behind everything: always free
                at = self._top + 1
                self._room(int(at + c[-1] - c[0]))
            self.base[parents[i]] = at - c[0]
            self.check[at + (c - c[0])] = parents[i]
            self._top = max(self._top, int(at + c[-1] - c[0]))
        one = start[count == 1]
        if len(one):
            at = self._free(len(one))
            self.base[parents[one]] = at - codes[one]
            self.check[at] = parents[one]
            self._top = max(self._top, int(at[-1]))

    def walk(self, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The node of every prefix of every path, in the layout of ``codes``; -1 where the trie has none."""
        out = np.full(len(codes), -1, np.int64)
        size = np.diff(off)
        state = np.zeros(len(size), np.int64)
        live, depth = np.flatnonzero(size > 0), 0
        while len(live):
            nxt = self.base[state[live]] + codes[off[live] + depth]
            known = (nxt > 0) & (nxt < len(self.check))
            known[known] = self.check[nxt[known]] == state[live[known]]
            live, nxt = live[known], nxt[known]
            out[off[live] + depth] = state[live] = nxt
            depth += 1
            live = live[size[live] > depth]
        return out


def dense_ids(a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """1, 2, ... for the distinct (a, b) pairs, in the order in which a level-by-level walk meets them."""
    n = len(a)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((np.arange(n), depth, b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    group = np.cumsum(new) - 1
    firsts = order[new]
    rank = np.empty(len(firsts), np.int64)
    rank[np.lexsort((firsts, depth[firsts]))] = np.arange(1, len(firsts) + 1)
    out = np.empty(n, np.int64)
    out[order] = rank[group]
    return out


_NODE = ("shared boolean, k1 long, k2 long, p1 long, p2 long, up array<struct<k1:long,k2:long>>, conv_id long, depth long, parent_conv_id long, "
         "n_convs long, n_children long, n_leaves long, saved long, bytes long, ends string")


def _shard(tab: pa.Table) -> pa.Table:
    """Nodes of one shard. Own nodes (at and below a path's cut) are final but for the parent of those at the cut, which is named by
    key (p1, p2). Nodes above are shared: n_children counts own children, n_leaves and saved sum own nodes only."""
    tab = tab.combine_chunks()
    t = tab.column("t").chunk(0) if tab.num_rows else tab.column("t").combine_chunks()
    off = np.asarray(t.offsets).astype(np.int64)
    off = off - off[0]
    turns = t.flatten()
    a, b, size = (np.asarray(turns.field(k)) for k in ("a", "b", "n"))
    cut, count, least = (np.asarray(tab.column(k).combine_chunks()) for k in ("cut", "n", "least"))
    ends = np.array(tab.column("ends").to_pylist(), object)
    paths, long = len(cut), np.diff(off)
    path = np.repeat(np.arange(paths), long)
    depth = np.arange(len(a)) - off[:-1][path] + 1
    codes = dense_ids(a, b, depth)
    slots = DoubleArray(codes, off)
    at = slots.walk(codes, off)

    used, first, node = np.unique(at, return_index=True, return_inverse=True)
    n = len(used)  # node n is the root
    parent = np.where(slots.check[used] == 0, n, np.searchsorted(used, slots.check[used]))
    level, own = depth[first], depth[first] >= cut[path[first]]
    convs, low = np.zeros(n + 1, np.int64), np.full(n + 1, np.iinfo(np.int64).max)
    np.add.at(convs, node, count[path])
    np.minimum.at(low, node, least[path])
    convs[n], low[n] = count.sum(), least.min()
    own, level = np.r_[own, False], np.r_[level, 0]
    bytes_ = np.r_[size[first], 0]
    kids = np.zeros(n + 1, np.int64)
    np.add.at(kids, parent[own[:n]], 1)
    leaves, saved = (own & (kids == 0)).astype(np.int64), np.where(own, (convs - 1) * bytes_, 0)
    order = np.argsort(-level[:n], kind="stable")
    for i, j in _runs(level[order]):  # deepest level first
        some = order[i:j]
        np.add.at(leaves, parent[some], leaves[some])
        np.add.at(saved, parent[some], saved[some])
    end = np.full(n + 1, None, object)
    end[np.where(long > 0, node[np.maximum(off[1:] - 1, 0)] if len(node) else n, n)] = ends

    key1, key2 = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    for some in (order[i:j] for i, j in reversed(_runs(level[order]))):  # keys of shared nodes, from the root down
        some = some[~own[some]]
        if not len(some):
            break
        key1[some] = mix64(key1[parent[some]] * _MUL + a[first[some]].view(np.uint64) + np.uint64(1))
        key2[some] = mix64(key2[parent[some]] * _MUL + b[first[some]].view(np.uint64) + np.uint64(2))
    key1, key2 = key1.view(np.int64), key2.view(np.int64)
    above = np.r_[parent, -1]
    up = []
    for k in np.flatnonzero(~own):
        chain, x = [], k
        while x >= 0:
            chain.append({"k1": int(key1[x]), "k2": int(key2[x])})
            x = above[x]
        up.append((k, chain))
    ups: list = [None] * (n + 1)
    for k, chain in up:
        ups[k] = chain
    at_cut = own & ~own[np.maximum(above, 0)] | (own & (above == n))
    keyed = (at_cut | ~own) & (above >= 0)
    final = own & ~at_cut
    null = lambda x, ok: pa.array(np.asarray(x, np.int64), mask=~ok)
    return pa.table({
        "shared": pa.array(~own), "k1": null(key1, ~own), "k2": null(key2, ~own), "p1": null(key1[above], keyed), "p2": null(key2[above], keyed),
        "up": pa.array(ups, pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))), "conv_id": pa.array(low), "depth": pa.array(level.astype(np.int64)),
        "parent_conv_id": null(low[above], final), "n_convs": pa.array(convs), "n_children": pa.array(kids), "n_leaves": pa.array(leaves),
        "saved": pa.array(saved), "bytes": pa.array(bytes_.astype(np.int64)), "ends": pa.array(end.tolist(), pa.string()),
    })


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    start = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, int)
    return list(zip(start.tolist(), np.r_[start[1:], len(sorted_values)].tolist() if len(start) else []))


# the trie ------------------------------------------------------------------------
def _prefix_key(depth: int) -> tuple[Column, Column]:
    head = F.slice("t", 1, depth)
    return F.xxhash64(head), F.xxhash64(F.lit("second"), head)


def _cut_paths(paths: DataFrame, most: int) -> DataFrame:
    """Adds ``cut`` and the key (k1, k2) of the prefix at the cut. A prefix of more than one path and ``most`` turns is cut at twice the depth."""
    depth, done, rest = 1, [], paths
    while True:
        k1, k2 = _prefix_key(depth)
        keyed = rest.withColumn("k1", k1).withColumn("k2", k2)
        hot = stored(keyed.groupBy("k1", "k2").agg(F.sum(F.size("t") + 1).alias("w"), F.count(F.lit(1)).alias("n"))
                     .filter((F.col("w") > most) & (F.col("n") > 1)).select("k1", "k2"))
        if hot.isEmpty():
            done.append(keyed.withColumn("cut", F.lit(depth).cast("long")))
            break
        done.append(keyed.join(hot, ["k1", "k2"], "left_anti").withColumn("cut", F.lit(depth).cast("long")))
        rest = keyed.join(hot, ["k1", "k2"], "left_semi").drop("k1", "k2")
        depth *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def prefix_trie(lists: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each distinct prefix (node) of the lists ``c, t`` (see ``turn_lists``): ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    The root (depth 0) holds every list, empty ones too; no lists give no rows. Equal lists count as often as they occur.
    """
    lists = stored(lists.withColumn("p", F.xxhash64("t")).withColumn("q", F.xxhash64(F.lit("second"), "t")))
    paths = lists.groupBy("p", "q").agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("n"), F.min("c").alias("least"))
    paths = stored(paths.join(member_digests(lists), ["p", "q"]))
    turns = paths.agg(F.sum(F.size("t") + 1)).first()[0] or 0
    shards = max(1, -(-turns // shard_turns))
    dealt = _cut_paths(paths, shard_turns).withColumn("shard", F.pmod("k1", F.lit(shards)))
    nodes = stored(dealt.select("shard", "cut", "t", "n", "least", "ends").groupBy("shard").applyInArrow(_shard, _NODE))

    shared = stored(nodes.filter("shared").groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
        F.first("up").alias("up"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("own_children"),
        F.sum("n_leaves").alias("own_leaves"), F.sum("saved").alias("own_saved"), F.first("bytes").alias("bytes"), F.max("ends").alias("ends")))
    kids = shared.filter("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("more"))
    shared = shared.join(kids, ["k1", "k2"], "left").withColumn("n_children", F.col("own_children") + F.coalesce("more", F.lit(0)))
    # what a shared node itself adds counts for it and all nodes above it
    adds = shared.select(F.explode("up").alias("u"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("more_saved"))
    adds = adds.groupBy(F.col("u.k1").alias("k1"), F.col("u.k2").alias("k2")).agg(F.sum("leaf").alias("leaf"), F.sum("more_saved").alias("more_saved"))
    shared = shared.join(adds, ["k1", "k2"]).withColumn("n_leaves", F.col("own_leaves") + F.col("leaf")).withColumn("saved", F.col("own_saved") + F.col("more_saved"))
    shared = stored(shared.select("k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends"))

    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    parents = shared.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_parent"), F.explode(
        F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    below = shared.drop("k1", "k2").unionByName(nodes.filter("not shared and p1 is not null").select(*[c for c in shared.columns if c not in ("k1", "k2")]))
    below = below.withColumn("_salt", F.pmod(F.xxhash64("conv_id", "n_convs"), F.lit(SALTS)).cast("int")).join(
        parents, ["p1", "p2", "_salt"], "left").withColumn("parent_conv_id", F.col("_parent"))
    every = below.select(*cols).unionByName(nodes.filter("not shared and p1 is null").select(*cols))
    return every.select(*[F.col(c).cast("long").alias(c) for c in cols[:-2]], F.col("saved").cast("long").alias("saved_tokens"),
                        F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"))


def conversation_trie(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of all conversations of a table, as they are; see ``turn_lists`` for nulls, ties and odd rows."""
    return prefix_trie(turn_lists(rows), shard_turns)
