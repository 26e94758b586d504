"""Byte-level BPE by vectorised pre-tokenisation and cached pair merging.

The split pattern of public byte-level vocabularies is a small automaton over
codepoint classes. Each symbol is a function on the automaton's states; all
functions that can arise from composing them form a small table, so the states
at every position come from an associative scan over table indices (inside
blocks for all blocks at once, then over block totals). No regular expression
is used. The resulting slices are merged once and cached.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

# Symbols: what a codepoint means given at most two that follow it.
LETTER, NUMBER, OTHER, APOS1, APOS2, SPACE, LAST_BLANK, LAST_SPACE = range(8)
# States after a codepoint: FRESH (the next begins a slice), in a run, after a
# blank that the next run takes in, one or two letters short of a contraction's end.
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, AFTER_BLANK, ONE_MORE, TWO_MORE = range(8)
#: The codepoints of Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The contractions that the split pattern names.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
BLOCK, CACHE, LONG_SLICE = 64, 150_000, 64


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice begins at this codepoint."""
    joined = state == AFTER_BLANK
    if symbol == LETTER:
        if state in (ONE_MORE, TWO_MORE):
            return (FRESH if state == ONE_MORE else ONE_MORE), False
        return IN_LETTER, not (joined or state == IN_LETTER)
    if symbol == NUMBER:
        return IN_NUMBER, not (joined or state == IN_NUMBER)
    if symbol in (OTHER, APOS1, APOS2):
        if joined or state == IN_OTHER:
            return IN_OTHER, False
        return (IN_OTHER, ONE_MORE, TWO_MORE)[symbol - OTHER], True
    if symbol == SPACE:
        return IN_SPACE, state != IN_SPACE
    return (AFTER_BLANK if symbol == LAST_BLANK else FRESH), True


class _Automaton:
    """The closure of the symbols' functions under composition. Symbol x + 8 is
    symbol x at the beginning of a text, whatever stood before."""

    def __init__(self) -> None:
        states = range(8)
        first = [tuple(_step(s, x)[0] for s in states) for x in range(8)] + [(_step(FRESH, x)[0],) * 8 for x in range(8)]
        known = {f: i for i, f in enumerate(dict.fromkeys([tuple(states), *first]))}
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in first:
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
        all_f = list(known)
        self.of_symbol = np.array([known[f] for f in first], np.uint8)
        self.apply = np.array(all_f, np.uint8)
        self.width = len(all_f)
        self.then = np.array([[known[tuple(g[x] for x in f)] for g in all_f] for f in all_f], np.uint8).ravel()
        self.begins = np.array([[_step(s, x)[1] for x in range(8)] + [True] * 8 for s in states]).ravel()

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Positions at which slices begin."""
        n = len(symbols)
        rows = -(-n // BLOCK)
        f = np.zeros(rows * BLOCK, np.uint8)  # 0: the identity
        f[:n] = self.of_symbol[symbols]
        f = np.ascontiguousarray(f.reshape(rows, BLOCK).T)
        for i in range(1, BLOCK):
            f[i] = self.then.take(f[i - 1] * np.uint16(self.width) + f[i])
        entry = np.empty(rows, np.uint8)
        state = FRESH
        apply = self.apply.tolist()
        for i, total in enumerate(f[-1].tolist()):
            entry[i] = state
            state = apply[total][state]
        after = self.apply.ravel().take(f * np.uint16(8) + entry[None, :]).T.reshape(-1)[:n]
        before = np.concatenate((np.array([FRESH], np.uint8), after[:-1]))
        return np.flatnonzero(self.begins.take(before * np.uint8(16) + symbols))


class Codec:
    """Encodes and decodes with a rank table (bytes: rank)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.classes = _classes()
        self.automaton = _Automaton()
        # The vocabulary as one run of bytes: token i is flat[first[i] : first[i] + size[i]].
        self.size = np.zeros(max(self.bytes_of, default=-1) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.size[i] = len(b)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), np.uint8)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def symbols(self, text: str, ends: np.ndarray) -> np.ndarray:
        """Of the joined ``text`` of some texts, which end at ``ends``."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.classes[points]
        space = out == SPACE
        last = space & np.append(~space[1:], False)
        last[ends - 1] = False
        out[last] = LAST_SPACE
        out[last & (points == 0x20)] = LAST_BLANK
        at = np.flatnonzero(points == ord("'"))
        if len(at):
            follow = np.concatenate((points, np.zeros(2, np.uint32)))
            room = ends[np.searchsorted(ends, at, side="right")] - at
            one, two = follow[at + 1], follow[at + 2]
            for c in CONTRACTIONS:
                hit = (one == ord(c[1])) & (room >= len(c))
                out[at[hit if len(c) == 2 else hit & (two == ord(c[2]))]] = APOS1 if len(c) == 2 else APOS2
        out[0] += 8
        out[ends[:-1]] += 8
        return out

    def slices(self, texts: list[str]) -> Iterator[list[str]]:
        """The slices of each text; one scan goes over all of them."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            yield from ([] for _ in texts)
            return
        ends = np.cumsum(sizes)
        text = "".join(texts)
        at = self.automaton.starts(self.symbols(text, ends[sizes > 0]))
        bounds = np.searchsorted(at, np.concatenate(([0], ends))).tolist()
        at = [*at.tolist(), len(text)]
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            yield [text[a:b] for a, b in zip(at[i:j], at[i + 1 : j + 1], strict=True)]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The pair of lowest rank is merged first, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > LONG_SLICE:
            return self._merge_long(parts)
        none = 1 << 60
        near = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while near and (best := min(near)) < none:
            i = near.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, parts: list[bytes]) -> tuple[int, ...]:
        """The same with a heap and links, for slices of any length."""
        ranks, n = self.ranks, len(parts)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or parts[i] is not a or parts[j] is not b:
                continue
            parts[i], alive[j], right[i] = a + b, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := ranks.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return tuple(ranks[p] for p, keep in zip(parts, alive, strict=True) if keep)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        for found in self.slices(texts):
            if len(self.cache) > CACHE:  # what is used again moves on from the older half
                self.older, self.cache = self.cache, {}
            cache, older = self.cache, self.older
            rare: dict[str, tuple[int, ...]] = {}  # long slices are merged anew: what is kept has a bounded size
            for s in {*found}.difference(cache):
                ids = older.get(s) or self.merge(s.encode("utf-8", "replace"))
                (cache if len(s) <= LONG_SLICE else rare)[s] = ids
            yield list(chain.from_iterable(rare[s] if s in rare else cache[s] for s in found) if rare else chain.from_iterable(map(cache.__getitem__, found)))

    def offsets(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the joined lists: the ids, the byte at which each token ends, and
        the number of tokens at which each list ends."""
        flat = np.fromiter(chain.from_iterable(ids), np.int64)
        return flat, np.cumsum(self.size[flat]), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))

    def decode(self, ids: list[list[int]]) -> Iterator[tuple[bytes, np.ndarray]]:
        """Of each list the bytes and the offsets at which its tokens end. The
        offsets say where every byte of the result stands in the vocabulary, so
        one gather decodes all lists, and they cut it into texts again."""
        flat, ends, until = self.offsets(ids)
        size = self.size[flat]
        data = self.flat[np.repeat(self.first[flat] - ends + size, size) + np.arange(int(size.sum()))].tobytes()
        ends = np.concatenate((np.zeros(1, np.int64), ends))
        for i, j in zip(until - np.diff(until, prepend=0), until, strict=True):
            yield data[ends[i] : ends[j]], ends[i + 1 : j + 1] - ends[i]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and vocabulary file."""
    if path not in _CODECS:
        at = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        _CODECS[path] = Codec(read_ranks(at))
    return _CODECS[path]


def encode(docs: DataFrame, vocabulary: str, offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int>, and with ``offsets`` also ends array<bigint> (byte
    offsets at which the tokens end), for each row of ``docs`` (doc_id, text;
    other columns are left out). Null and empty texts have no ids. ``vocabulary``
    is a rank file (base64 bytes, rank) that every executor finds at that path
    or under its name among the session's files; decoding needs nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in pieces(batches, "text", 1 << 20):
            ids = list(c.encode([t or "" for t in batch.column("text").to_pylist()]))
            out = {"doc_id": batch.column("doc_id").cast(pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))}
            if offsets:
                out["ends"] = pa.array([ends for _, ends in c.decode(ids)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>" + ", ends array<bigint>" * offsets)


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, bytes binary for each row of ``tokens`` (doc_id, ids). Null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "bytes": pa.array([x for x, _ in c.decode([x or [] for x in batch.column("ids").to_pylist()])], pa.binary())})

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes every
    text in one pass, as ``encode`` and ``decode`` do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        decimal = {i: b"%d" % i for i in c.bytes_of}
        for batch in pieces(batches, "text", 1 << 20):
            n, ids_sha, bytes_sha = [], [], []
            ids = list(c.encode([t or "" for t in batch.column("text").to_pylist()]))
            for x, (data, _) in zip(ids, c.decode(ids), strict=True):
                n.append(len(x))
                ids_sha.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, x))).hexdigest())
                bytes_sha.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
