"""Encoding of a whole corpus with a byte-level BPE vocabulary file, by a pair occurrence index.

Each task lays the distinct words of its partition out as one array of symbols and maps every adjacent pair, by its merge
rank, to all positions where it occurs. Active ranks are applied in ascending order, each at all of its positions at once;
only the lists of the pairs next to a merged position change. A merge can only create pairs of higher rank, so one
ascending pass is exact.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"  #: where neither the caller nor the session names a file
SETTING = "spark.codequarry.vocabulary"  #: the session's setting: a path all executors have, or the name of a file added by addFile
#: The word pattern of the vocabulary. White space is the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NO_PAIR = np.int64(1) << 40
FLUSH_BYTES = 8_000_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairIndexEncoder:
    """Encodes many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.bytes = np.array([vocab[c] for c in _byte_letters()], np.int64)
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and where each word's begin (one more entry than words)."""
        sizes = np.array([len(w) for w in words], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        n = int(begins[-1])
        sym = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        filled = sizes > 0
        nxt[begins[1:][filled] - 1] = -1
        prv[begins[:-1][filled]] = -1
        pair = np.full(n, NO_PAIR)
        inner = np.flatnonzero(nxt >= 0)
        pair[inner] = self.rank(sym[inner], sym[inner + 1])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(at: np.ndarray) -> None:
            ranks = pair[at]
            at, ranks = at[ranks < NO_PAIR], ranks[ranks < NO_PAIR]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        post(inner)
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[pair[at] == r]
            if not len(at):
                continue
            if sym[at[0]] == sym[nxt[at[0]]]:  # aaa: of a run of touching pairs every other one merges, from its start
                touch = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
                i = np.arange(len(at))
                start = np.maximum.accumulate(np.where(touch, 0, i))
                at = at[(i - start) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.made[r]
            alive[gone] = False
            pair[gone] = NO_PAIR
            nxt[at] = after
            more = after >= 0
            prv[after[more]] = at[more]
            pair[at] = NO_PAIR
            left = at[more]
            pair[left] = self.rank(sym[left], sym[after[more]])
            before = prv[at]
            before = before[before >= 0]
            pair[before] = self.rank(sym[before], sym[nxt[before]])
            post(np.unique(np.concatenate([left, before])))
        ids = sym[alive]
        return ids, np.concatenate([[0], np.cumsum(alive)])[begins]


def vocabulary_of(spark: SparkSession, given: str | None = None) -> str:
    """The vocabulary file: the one given, else the session's setting, else the default."""
    return given or spark.conf.get(SETTING, VOCABULARY)


def _there(path: str) -> str:
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(_there(path))


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts in a row, and where each text's begin. Null and empty texts have none."""
    find = regex.compile(PATTERN).findall
    known: dict[str, int] = {}
    uses = [[known.setdefault(w, len(known)) for w in find(t)] if t else [] for t in texts]
    ids, begins = encoder(path).encode([w.encode() for w in known])
    lengths = np.diff(begins)
    flat = np.array([w for u in uses for w in u], np.int64)
    counts = lengths[flat] if len(flat) else np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    token_at = np.arange(int(ends[-1]) if len(ends) else 0)
    shift = np.repeat(begins[flat] - (ends - counts), counts) if len(flat) else token_at
    total = np.concatenate([[0], ends])
    words_before = np.concatenate([[0], np.cumsum([len(u) for u in uses])]).astype(np.int64)
    return ids[token_at + shift], total[words_before]


def _flushes(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        for s in range(0, b.num_rows, 2_000):
            part = b.slice(s, 2_000)
            held.append(part)
            size += part.column(text).get_total_buffer_size() if b.num_rows <= 2_000 else part.column(text).nbytes
            if size >= FLUSH_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", *, vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """``key, ids``: the token ids of each row's text, without special tokens; their strings in a text are ordinary text.

    Null and empty texts have an empty list. Every row of the input, repeated ones too, gives one row; other columns are
    left out. A text is never cut: a very long one is just held alone.
    """
    src = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    vocabulary = vocabulary_of(df.sparkSession, vocabulary)
    schema = T.StructType([T.StructField(key, src.schema["key"].dataType), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _flushes(batches, 1):
            out, begins = encode_texts(t.column("text").to_pylist(), vocabulary)
            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(out, pa.int32()))
            yield from pa.table([t.column("key").combine_chunks(), lists], names=[key, ids]).to_batches(2_000)

    return src.mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", *, vocabulary: str | None = None, out: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of each row's text; nulls count 0. Rows stay in their partitions."""
    src = df.select(*keep, F.col(text).alias("__text"))
    vocabulary = vocabulary_of(df.sparkSession, vocabulary)
    schema = T.StructType([*src.drop("__text").schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _flushes(batches, len(keep)):
            _, begins = encode_texts(t.column("__text").to_pylist(), vocabulary)
            yield from t.drop_columns("__text").append_column(out, pa.array(np.diff(begins), pa.int64())).to_batches(2_000)

    return src.mapInArrow(run, schema)
