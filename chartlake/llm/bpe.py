"""BPE encoding and decoding with a word-end vocabulary, in batched numpy merge rounds.

Texts are normalised (NFC, lower case by character) and cut into pieces by the vocabulary's own pattern.
Pieces not met lately are encoded together: the symbols of all of them lie in one flat array; in each round
every piece finds its adjacent pair of lowest rank by binary search over the sorted pair keys and merges all
its occurrences, until no piece has a pair left. A merge only makes pairs that rank behind it, so merging all
occurrences at once equals merging one at a time. Encoded pieces are kept in a bounded table per worker.

No shuffle: each partition is encoded where it is read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.llm.common import slices, utf8_parts

#: Fixed value: the split pattern of the vocabulary; white space as its library reads it.
_WS = r"\t-\r\x20\x85\xa0  -     　"
#: The same cut for texts within Latin-1, where the classes are short lists: letters, numbers, white space.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r\x20\x85\xa0{_LETTERS}{_NUMBERS}]+")
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WS}\p{{L}}\p{{N}}]+")
#: Pieces in a worker's table of encoded ones; beyond, a new table is begun.
KEEP = 300_000
#: Bytes of text encoded at a time.
SLICE = 1 << 21


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _joined(names: pa.Array, upto: np.ndarray) -> pa.Array:
    """Strings upto[i]..upto[i + 1] of an array put together, without copies of their bytes."""
    raw, off = utf8_parts(names)
    return pa.LargeStringArray.from_buffers(len(upto) - 1, pa.py_buffer(np.ascontiguousarray(off[upto])), pa.py_buffer(np.ascontiguousarray(raw)))


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**vocab, **self.special}.items()}
        end = model["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + end] for c in chars], np.int64)
        self.width = max(self.tokens) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.none = len(pairs)
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        every = range(self.width)
        self.id_names = pa.array([f"{i} " for i in every], pa.large_string())
        self.token_names = pa.array([f"{self.tokens[i]} " if i in self.tokens else "" for i in every], pa.large_string())
        self._begin()

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces (strings without white space), one behind the other, and how many each has."""
        raw = [p.encode("utf-8") for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        last = np.cumsum(size) - 1
        sym[last] = self.final[data[last]]
        owner = np.repeat(np.arange(len(pieces)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = [(owner[:0], sym[:0])]
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), self.none, np.int64)
            hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank[:-1][hit] = self.rank[at[hit]]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, first)
            over = least == self.none
            count = np.diff(np.r_[first, len(sym)])
            if over.any():
                keep = np.repeat(~over, count)
                done.append((owner[~keep], sym[~keep]))
                sym, owner, rank = sym[keep], owner[keep], rank[keep]
                least, count = least[~over], count[~over]
                if not len(sym):
                    break
            target = np.repeat(least, count)
            take = rank == target
            # of touching occurrences (a a a) every second one from the left is merged
            where = np.flatnonzero(take)
            fresh = np.r_[True, (np.diff(where) > 1) | (owner[where[1:]] != owner[where[:-1]])]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            sym[where] = self.made[target[where]]
            stay = np.ones(len(sym), bool)
            stay[where + 1] = False
            sym, owner = sym[stay], owner[stay]
        owner, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        return sym[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pieces))

    def _add(self, pieces: list[str], sym: np.ndarray, count: np.ndarray) -> None:
        """Put encoded pieces into the table: their row, number of ids, and ids and tokens with a space behind each."""
        upto = np.cumsum(np.r_[0, count])
        self.known.update(zip(pieces, range(len(self.count), len(self.count) + len(pieces)), strict=True))
        self.count = np.r_[self.count, count]
        self.ids = pa.concat_arrays([self.ids, _joined(self.id_names.take(pa.array(sym)), upto)])
        self.words = pa.concat_arrays([self.words, _joined(self.token_names.take(pa.array(sym)), upto)])

    def _begin(self) -> None:
        """An empty table of encoded pieces, but for the special tokens."""
        self.known: dict[str, int] = {}
        self.count = np.zeros(0, np.int64)
        self.ids = self.words = pa.array([], pa.large_string())
        self._add(list(self.special), np.array(list(self.special.values()), np.int64), np.ones(len(self.special), np.int64))

    def _prepare(self, need: list[str]) -> None:
        """Have all of ``need`` in the table."""
        if len(self.known) + len(need) > KEEP:
            self._begin()
        new = [p for p in need if p not in self.known]
        if new:
            self._add(new, *self.merge(new))

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if text.isascii():
            return _LATIN.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _PIECES.findall(text)
        return _LATIN.findall(text)

    def _plan(self, text: str) -> list[str]:
        if self.cut is None or "<|" not in text:
            return self._pieces(text)
        pieces = []
        for k, part in enumerate(self.cut.split(text)):
            pieces += [part] if k % 2 else self._pieces(part)
        return pieces

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, list[memoryview], list[memoryview]]:
        """Of each text: number of tokens, ids and tokens joined by a space (as UTF-8).

        Pieces become numbers once; what each stands for is then gathered for the whole batch at a time."""
        plans = [self._plan(t) for t in texts]
        size = np.cumsum([0, *map(len, plans)])
        coded = pa.array(list(itertools.chain.from_iterable(plans)), pa.string()).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._prepare(pieces)
        row = np.array([self.known[p] for p in pieces], np.int64)[np.asarray(coded.indices)]
        upto = np.r_[0, np.cumsum(self.count[row])]
        joined = []
        for names in (self.ids, self.words):
            raw, off = utf8_parts(names.take(pa.array(row)))
            view, edge = memoryview(np.ascontiguousarray(raw)), off[size].tolist()
            joined.append([view[i:max(i, j - 1)] for i, j in itertools.pairwise(edge)])
        return np.diff(upto[size]), joined[0], joined[1]

    def encode_texts(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, decoded text) of each text."""
        n, ids, tokens = self.encode_batch(texts)
        return [(int(k), bytes(i).decode(), bytes(t).decode()) for k, i, t in zip(n, ids, tokens, strict=True)]

    def decode(self, ids) -> str:
        """Tokens of the ids joined by one space (the vocabulary has no decoder); unknown ids are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = None,
           ids: bool = True) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256, decoded_sha256, and with ``ids`` the token ids as an array.

    Null and empty texts give no tokens (0, hashes of the empty string, an empty array). Whole texts of any
    length are encoded; rows alike give rows alike; other columns are not read; an empty table stays empty.
    """
    path = path or default_path()
    src = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_bpe_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    schema += ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in slices(batches, "_bpe_text", SLICE):
            n, joined, decoded = bpe.encode_batch([t or "" for t in b.column("_bpe_text").to_pylist()])
            cols = [b.column(k) for k in range(len(keep))]
            cols += [pa.array(n, pa.int64()), *[pa.array([hashlib.sha256(x).hexdigest() for x in of], pa.string()) for of in (joined, decoded)]]
            if ids:
                flat = np.fromstring(b" ".join(x for x in joined if len(x)).decode("ascii"), np.int32, sep=" ")
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat, pa.int32())))
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the decoded text of an array of ids; a null array gives a null text."""
    path = path or default_path()

    @F.pandas_udf("string")
    def run(col):
        bpe = vocabulary(path)
        return col.map(lambda x: None if x is None else bpe.decode(x.tolist()))

    return rows.withColumn(out, run(F.col(ids)))
