"""Exact substring dedup by fixed-block anchors.

A repeat of ``window`` words holds a whole aligned block of ``(window + 1) // 2`` words of the document it repeats.
So the non-overlapping blocks of every document are indexed, every rolling run of that many words probes the
index, and only windows that hold a hit are compared exactly; windows that touch add up to maximal repeats.

Texts are grouped once by a hash. Each group sends one packed message a key range with its distinct probe keys
(sorted, as differences), flagged if aligned; a range answers with the keys that two places share. Windows with a
hit go the same way with 64-bit hashes and the least document id of the group; a range answers with the least id
of all where that is smaller. A passage in very many documents is one entry a group, so it makes no hot key.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.llm.common import text_or_empty, utf8_parts, window_hashes, word_hashes, word_spans

#: Bytes of text expected in a group, and in the texts that a key range stands for.
GROUP_BYTES = 3 << 20
RANGE_BYTES = 12 << 20
_LAST = np.iinfo(np.int64).max


def _pack(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, which compress well where high bytes repeat."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    wide = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(data) // sum(wide), 0, []
    for k, w in zip(kinds, wide, strict=True):
        planes = np.frombuffer(data, np.uint8, n * w, at).reshape(w, n)
        out.append(np.ascontiguousarray(planes.T).view(k).reshape(n))
        at += n * w
    return out


def _steps(v: np.ndarray) -> np.ndarray:
    return np.diff(v, prepend=v.dtype.type(0))


class _Group:
    """The words of a group's documents in order of doc_id, null ids last."""

    def __init__(self, docs: pa.Table):
        ids = docs.column("doc_id").combine_chunks()
        order = np.argsort(np.where(np.asarray(ids.is_null()), _LAST, np.asarray(ids.fill_null(0), np.int64)), kind="stable")
        self.docs = docs.take(pa.array(order)).combine_chunks()
        self.ids = np.asarray(self.docs.column("doc_id").combine_chunks().fill_null(_LAST), np.int64)
        raw, off = utf8_parts(self.docs.column("text"))
        starts, ends, self.first = word_spans(raw, off)
        self.words = word_hashes(raw, starts, ends)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, hash, document) of all runs of n words."""
        at, h = window_hashes(self.words, self.first, n)
        return at, h, np.searchsorted(self.first, at, "right") - 1


def _messages(group: int, key: np.ndarray, shift: int, *columns: np.ndarray) -> list[dict]:
    """One message for each key range; ``key`` is sorted, its range is ``key >> shift``."""
    part = (key >> np.uint64(shift)).astype(np.int64)
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)] if len(part) else np.zeros(1, np.int64)
    return [{"part": int(part[a]), "grp": group, "data": _pack(*[c[a:b] if k else _steps(c[a:b]) for k, c in enumerate(columns)])}
            for a, b in itertools.pairwise(cuts)]


_MESSAGE = pa.schema([("part", pa.int64()), ("grp", pa.int64()), ("data", pa.binary())])
_MESSAGE_SQL = "part bigint, grp bigint, data binary"


def _as_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_MESSAGE)


def substring_dedup(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text",
                    with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and with ``with_text`` the kept words as ``kept``.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id.
    Null and empty texts have no words; null ids count as larger than all; documents with equal ids (repeated
    rows, nulls) never remove each other's words; an empty table gives an empty result; other columns are not read.
    Windows are told apart by a 64-bit hash of their words.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = max(12, math.ceil(total / GROUP_BYTES))
    bits = max(4, math.ceil(math.log2(max(1, total / RANGE_BYTES))))
    block = (window + 1) // 2
    low = np.uint64(32 - bits)
    grouped = src.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)))

    def keys(h: np.ndarray) -> np.ndarray:
        return h >> low  # range in the high bits, 32 more below

    def probe(key, table):
        g = _Group(table)
        at, h, doc = g.windows(block)
        aligned = ((at - g.first[doc]) % block == 0).astype(np.uint64)
        v = np.sort(keys(h) << np.uint64(1) | aligned)
        k = v >> np.uint64(1)
        end = np.flatnonzero(np.r_[k[1:] != k[:-1], True]) if len(k) else np.zeros(0, np.int64)
        many = np.diff(np.r_[-1, end]) > 1
        flags = (v[end] & np.uint64(1)).astype(np.uint8) + 2 * many.astype(np.uint8)
        k = k[end]
        return _as_table(_messages(key[0].as_py(), k, 32, k.astype(np.uint32), flags))

    def meet(table):
        part = table.column("part")[0].as_py()
        groups = table.column("grp").to_pylist()
        got = [_unpack(m, np.uint32, np.uint8) for m in table.column("data").to_pylist()]
        place = np.repeat(np.arange(len(got)), [len(x[0]) for x in got])
        k = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for x in got])
        flags = np.concatenate([x[1] for x in got])
        order = np.argsort(k, kind="stable")
        k, place, flags = k[order], place[order], flags[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[first, len(k)])
        seen = np.bitwise_or.reduceat(flags, first)
        hit = np.repeat(((seen & 1) > 0) & ((size > 1) | (seen > 1)), size)
        k, place = k[hit], place[hit]
        order = np.argsort(place, kind="stable")
        k, place = k[order], place[order]
        cuts = np.searchsorted(place, np.arange(len(groups) + 1))
        return _as_table([{"part": part, "grp": g, "data": _pack(_steps(k[a:b]))}
                          for g, (a, b) in zip(groups, itertools.pairwise(cuts), strict=True) if b > a])

    def extend(key, table, hits):
        if not table.num_rows or not hits.num_rows:
            return _as_table([])
        g = _Group(table)
        known = np.sort(np.concatenate([
            np.cumsum(_unpack(m, np.uint32)[0], dtype=np.uint32).astype(np.uint64) | np.uint64(p << 32)
            for p, m in zip(hits.column("part").to_pylist(), hits.column("data").to_pylist(), strict=True)]))
        at, h, _ = g.windows(block)
        k = keys(h)
        where = np.minimum(np.searchsorted(known, k), len(known) - 1)
        hit = np.zeros(len(g.words) + 1, np.int64)
        hit[at + 1] = known[where] == k
        hit = np.cumsum(hit)
        at, h, doc = g.windows(window)
        near = hit[at + window - block + 1] > hit[at]
        h, doc = h[near], doc[near]
        order = np.argsort(h, kind="stable")  # documents are in order, so the first of a run has the least id
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        return _as_table(_messages(key[0].as_py(), h[first], 64 - bits, h[first], g.ids[doc[first]]))

    def least(table):
        part = table.column("part")[0].as_py()
        groups = table.column("grp").to_pylist()
        got = [_unpack(m, np.uint64, np.int64) for m in table.column("data").to_pylist()]
        place = np.repeat(np.arange(len(got)), [len(x[0]) for x in got])
        h = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got])
        own = np.concatenate([x[1] for x in got])
        order = np.argsort(h, kind="stable")
        h, own, place = h[order], own[order], place[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        low_id = np.repeat(np.minimum.reduceat(own, first), np.diff(np.r_[first, len(h)]))
        told = low_id < own
        h, low_id, place = h[told], low_id[told], place[told]
        order = np.argsort(place, kind="stable")
        h, low_id, place = h[order], low_id[order], place[order]
        cuts = np.searchsorted(place, np.arange(len(groups) + 1))
        return _as_table([{"part": part, "grp": g, "data": _pack(_steps(h[a:b]), low_id[a:b])}
                          for g, (a, b) in zip(groups, itertools.pairwise(cuts), strict=True) if b > a])

    def remove(table, told):
        g = _Group(table) if table.num_rows else None
        if g is None:
            return out_schema.empty_table()
        at, h, doc = g.windows(window)
        gone = np.zeros(len(g.words) + 1, np.int64)
        if len(at):
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])
            best = g.ids[doc[order[first]]]
            if told.num_rows:
                got = [_unpack(m, np.uint64, np.int64) for m in told.column("data").to_pylist()]
                known = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got])
                where = np.searchsorted(h[order[first]], known)
                best[where] = np.minimum(best[where], np.concatenate([x[1] for x in got]))
            lowest = np.empty(len(h), np.int64)
            lowest[order] = np.repeat(best, np.diff(np.r_[first, len(h)]))
            cut = at[lowest < g.ids[doc]]
            gone[cut] = 1  # window starts differ
            gone[cut + window] -= 1
        keep = np.cumsum(gone[:-1]) == 0
        removed = np.diff(np.r_[0, np.cumsum(~keep)][g.first])
        n_words = np.diff(g.first)
        sha, kept = [], []
        for k, t in enumerate(g.docs.column("text").to_pylist()):
            words = t.encode("utf-8").split()  # bytes split at the same six characters
            if removed[k]:
                words = itertools.compress(words, keep[g.first[k]:g.first[k + 1]])
            joined = b" ".join(words)
            sha.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                kept.append(joined.decode("utf-8"))
        cols = [g.docs.column("doc_id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(sha, pa.string())] + ([pa.array(kept, pa.string())] if with_text else [])
        return pa.Table.from_arrays(cols, schema=out_schema)

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    out_schema = pa.schema(fields + ([("kept", pa.string())] if with_text else []))
    out_sql = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if with_text else "")
    hits = grouped.groupBy("grp").applyInArrow(probe, _MESSAGE_SQL).groupBy("part").applyInArrow(meet, _MESSAGE_SQL)
    near = grouped.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(extend, _MESSAGE_SQL)
    told = near.groupBy("part").applyInArrow(least, _MESSAGE_SQL)
    return grouped.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(remove, out_sql)
