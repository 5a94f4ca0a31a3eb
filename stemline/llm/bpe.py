"""Byte-level BPE by batched numpy merge rounds.

The words of many texts stand in one flat array of symbols. In each round, the pairs of neighbouring symbols are looked
up by binary search over the sorted keys of all merges, each word takes its lowest rank, and all places of that pair in
the word are merged from left to right, until no word has a pair left. A word is worked out once per task and then kept.
Words of very many symbols go through a heap of their pairs instead, with the same result, as their rounds would be many.

The vocabulary file (tokenizers' JSON) is read once by the driver and broadcast: three arrays of one entry for each merge
and one for each token, about 3 MB for 50,000 tokens.

Defined cases: a null and an empty text have no ids; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import heapq
import json
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text into words before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.path.join(os.environ.get("STEMLINE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
#: Words of more symbols go through a heap.
LONG = 160
#: Characters encoded at once, and words kept in a task.
AT_ONCE, KEPT = 2_000_000, 400_000
NONE = np.iinfo(np.int64).max


@dataclass
class Vocabulary:
    """keys: sorted left << 20 | right of each merge, with its rank and result; first: id of each byte; size, inner: bytes of each token, and whether it starts inside a character."""

    keys: np.ndarray
    rank: np.ndarray
    made: np.ndarray
    first: np.ndarray
    size: np.ndarray
    inner: np.ndarray


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files: itself if printable, else one from 256 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def load(path: str = VOCABULARY) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids, letters = model["vocab"], byte_letters()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left = np.array([ids[a] for a, _ in merges], np.int64)
    right = np.array([ids[b] for _, b in merges], np.int64)
    made = np.array([ids[a + b] for a, b in merges], np.int64)
    keys = left << 20 | right
    order = np.argsort(keys)
    value = {c: b for b, c in enumerate(letters)}
    size, inner = np.zeros(max(ids.values()) + 1, np.int64), np.zeros(max(ids.values()) + 1, bool)
    for token, k in ids.items():
        size[k], inner[k] = len(token), 0x80 <= value.get(token[0], 0) < 0xC0
    return Vocabulary(keys[order], order.astype(np.int64), made[order], np.array([ids[c] for c in letters], np.int64), size, inner)


class Encoder:
    """Encodes texts in one task, keeping the words that it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.used = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64), 0

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(the number of each word, words of each text)."""
        if len(self.index) > KEPT:
            self.forget()
        index, fresh, out, count = self.index, [], array("q"), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = self.split(text)
                count[i] = len(found)
                for w in found:
                    k = index.get(w)
                    if k is None:
                        k = index[w] = len(index)
                        fresh.append(w)
                    out.append(k)
        if fresh:
            self._add([w.encode("utf-8", "surrogatepass") for w in fresh])
        return np.array(out, np.int64), count

    def _add(self, words: list[bytes]) -> None:
        size = np.array([len(w) for w in words], np.int64)
        done: list[np.ndarray | None] = [None] * len(words)
        short = np.flatnonzero(size <= LONG)
        symbols = self.v.first[np.frombuffer(b"".join([words[i] for i in short]), np.uint8)]
        flat, lengths = self._rounds(symbols, size[short])
        ends = np.cumsum(lengths)
        for i in np.flatnonzero(size > LONG):
            done[i] = self._heap(words[i])
        if len(short) < len(words):
            for j, i in enumerate(short):
                done[i] = flat[ends[j] - lengths[j] : ends[j]]
            lengths = np.array([len(d) for d in done], np.int64)
            flat = np.concatenate(done)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start = np.concatenate([self.start, self.used + np.cumsum(lengths)])
        self.used += len(flat)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        return np.where(self.v.keys[at] == key, self.v.rank[at], NONE), at

    def _rounds(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words (symbols of all, length of each) to the end; the same form comes out."""
        n = len(size)
        word = np.repeat(np.arange(n), size)
        parts_s, parts_w = [], []
        while len(symbols) > 1:
            rank, at = self._lookup(symbols[:-1], symbols[1:])
            rank[word[1:] != word[:-1]] = NONE
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(np.r_[rank, NONE], heads)
            length = np.diff(np.r_[heads, len(symbols)])
            live = np.repeat(best < NONE, length)
            if not live.all():  # finished words leave
                parts_s.append(symbols[~live])
                parts_w.append(word[~live])
            merge = np.zeros(len(symbols), bool)
            merge[:-1] = (rank == np.repeat(best, length)[:-1]) & (rank < NONE)
            # of overlapping places (aaa) every other one, from the left
            run = np.flatnonzero(merge)
            if len(run):
                begin = np.r_[True, run[1:] != run[:-1] + 1]
                first = np.maximum.accumulate(np.where(begin, np.arange(len(run)), 0))
                run = run[(np.arange(len(run)) - first) % 2 == 0]
                symbols = symbols.copy()
                symbols[run] = self.v.made[at[run]]
                live[run + 1] = False
            symbols, word = symbols[live], word[live]
        parts_s.append(symbols)
        parts_w.append(word)
        flat, word = np.concatenate(parts_s), np.concatenate(parts_w)
        order = np.argsort(word, kind="stable")
        return flat[order], np.bincount(word, minlength=n)

    def _heap(self, word: bytes) -> np.ndarray:
        sym = self.v.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, at = self._lookup(np.array(sym[:-1]), np.array(sym[1:]))
        live = np.flatnonzero(rank < NONE)
        heap = list(zip(rank[live].tolist(), live.tolist(), self.v.made[at[live]].tolist()))
        heapq.heapify(heap)
        seen: dict[int, tuple[int, int] | None] = {}

        def pair(a: int, b: int):
            key = a << 20 | b
            if key not in seen:
                k = int(np.searchsorted(self.v.keys, key))
                seen[key] = (int(self.v.rank[k]), int(self.v.made[k])) if k < len(self.v.keys) and self.v.keys[k] == key else None
            return seen[key]

        while heap:
            r, i, made = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] < 0 or j >= n or (p := pair(sym[i], sym[j])) is None or p[0] != r:
                continue
            sym[i], sym[j] = made, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if p := pair(made, sym[k]):
                    heapq.heappush(heap, (p[0], i, p[1]))
            if (h := prv[i]) >= 0 and (p := pair(sym[h], made)):
                heapq.heappush(heap, (p[0], h, p[1]))
        return np.array([s for s in sym if s >= 0], np.int32)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        word, count = self.words(texts)
        total = np.r_[0, np.cumsum(np.diff(self.start)[word])]
        ends = np.cumsum(count)
        return total[ends] - total[ends - count]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text)."""
        word, count = self.words(texts)
        size = np.diff(self.start)[word]
        total = np.r_[0, np.cumsum(size)]
        flat = self.flat[np.repeat(self.start[word] - total[:-1], size) + np.arange(total[-1])]
        return flat, np.r_[0, total[np.cumsum(count)]]


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about AT_ONCE bytes of text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    done = np.cumsum(size)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + AT_ONCE, side="right")))
        yield at, upto
        at = upto


def shared(spark: SparkSession, path: str = VOCABULARY):
    """The broadcast vocabulary."""
    return spark.sparkContext.broadcast(load(path))


def spread(rows: DataFrame) -> DataFrame:
    """The rows, over enough partitions where the input has fewer than there are cores: one row group is one task however long its texts are."""
    spark = rows.sparkSession
    cores, parts = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(max(cores, parts), F.xxhash64(*rows.columns))


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids) of each row."""
    voc = shared(docs.sparkSession, path)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = Encoder(voc.value)
        for b in batches:
            for lo, hi in portions(b.column(1)):
                ids, offsets = enc.encode(b.column(1).slice(lo, hi - lo).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], [key, "ids"])

    return spread(docs.select(key, text)).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(docs: DataFrame, columns: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(columns..., n_tokens) of each row."""
    voc = shared(docs.sparkSession, path)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", n_tokens long"

    def run(batches):
        enc = Encoder(voc.value)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            n = [enc.counts(texts.slice(lo, hi - lo).to_pylist()) for lo, hi in portions(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], [*columns, "n_tokens"])

    return spread(docs.select(*columns, F.col(text).alias("_text"))).mapInArrow(run, schema)
