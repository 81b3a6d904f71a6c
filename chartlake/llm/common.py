"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.session import ensure_checkpoint_dir

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_RNG = np.random.RandomState(20240607)
_BYTE = _RNG.randint(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise into the shared checkpoint folder; the copy survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """Checkpoint a table and read it back in as many partitions as its rows need, so that rounds over a small
    table do not start (and leave files of) a task for every shuffle partition."""
    kept = checkpoint(df)
    return kept.coalesce(max(1, -(-kept.count() // rows)))


def unused(columns: list[str], *names: str) -> list[str]:
    """The given names, each with as many underscores in front as it takes to differ from all columns and one another."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalising mixer: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def utf8_parts(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices with about ``most`` bytes of text (one document at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = utf8_parts(b.column(text))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield b.slice(at, end - at)
            at = end


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~_SPACE[raw]
    edge = off[(off > 0) & (off < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """64-bit hash of each word's bytes (ASCII capitals folded on request), by prefix sums of a polynomial."""
    n = len(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLD if fold_case else _BYTE)[raw] * up[:n], out=acc[1:])
    return mix64((acc[ends] - acc[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(h: np.ndarray, first: np.ndarray, n: int, seed: int = 0x2545F4914F6CDD1D) -> tuple[np.ndarray, np.ndarray]:
    """(start index, hash) of every run of ``n`` words inside one text. ``first``: index of each text's first word."""
    total = len(h)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    at = np.flatnonzero(left >= n)
    acc = np.zeros(total - n + 1, np.uint64)
    mul = np.uint64(seed | 1)
    for j in range(n):
        acc = acc * mul + h[j:total - n + 1 + j]
    return at, mix64(acc[at])


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared checkpoint folder (compressed, columnar) and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
