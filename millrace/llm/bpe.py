"""Encoding of a corpus with a byte-level BPE vocabulary.

Merging uses a rank queue: a bucket for each merge rank holds positions of a linked list of tokens, and a two-level bitmap
tells which buckets are filled, so find-first-set gives the next rank in constant time. A position whose pair has changed in the meantime is
stale and skipped. A pre-token of n bytes takes n pushes and pops, however long it is.
"""

from __future__ import annotations

import base64
import posixpath
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import spread

#: Fixed value: the public pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_LEAF = 8  # log2 of the ranks of one leaf of the bitmap
_KEPT = 300_000  # pre-tokens and pairs kept in a worker
_KEPT_CHARS = 64  # longer pre-tokens are rarely met again


class BytePairEncoder:
    """Encoder over a rank file (base64 token and rank a line)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern).findall
        self.leaves = (size >> _LEAF) + 1
        self.pairs: dict[int, int] = {}
        self.known: dict[str, list[int]] = {}

    def rank_of(self, a: int, b: int) -> int:
        """Rank of the token that two tokens merge into, -1 if there is none."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > _KEPT:
                self.pairs.clear()
            found = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return found

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token: merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.byte[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self.rank_of
        buckets: dict[int, list[int]] = {}
        top, leaf = 0, [0] * self.leaves

        def push(rank: int, at: int) -> None:
            nonlocal top
            bucket = buckets.get(rank)
            if bucket:
                bucket.append(at)
                return
            buckets[rank] = [at]
            leaf[rank >> _LEAF] |= 1 << (rank & ((1 << _LEAF) - 1))
            top |= 1 << (rank >> _LEAF)

        for i in range(n - 1):
            r = rank_of(ids[i], ids[i + 1])
            if r >= 0:
                push(r, i)
        while top:
            word = (top & -top).bit_length() - 1
            bits = leaf[word]
            low = bits & -bits
            rank = word << _LEAF | low.bit_length() - 1
            leaf[word] = bits ^ low
            if bits == low:
                top ^= 1 << word
            waiting = sorted(buckets.pop(rank))
            for k, i in enumerate(waiting):
                j = after[i]
                if ids[i] < 0 or j >= n or rank_of(ids[i], ids[j]) != rank:
                    continue  # stale
                ids[i], ids[j] = rank, -1
                after[i] = far = after[j]
                least = rank + 1
                if far < n:
                    before[far] = i
                    r = rank_of(rank, ids[far])
                    if r >= 0:
                        push(r, i)
                        least = min(least, r)
                back = before[i]
                if back >= 0:
                    r = rank_of(ids[back], rank)
                    if r >= 0:
                        push(r, back)
                        least = min(least, r)
                if least <= rank and k + 1 < len(waiting):  # a lower rank has come up, or this one again: it goes first
                    for later in waiting[k + 1 :]:
                        push(rank, later)
                    break
        return [t for t in ids if t >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; an empty list for an empty or null one."""
        if not text:
            return []
        out: list[int] = []
        known, ranks = self.known, self.ranks
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                whole = ranks.get(raw)
                ids = [whole] if whole is not None else self.merge(raw)
                if len(piece) <= _KEPT_CHARS:
                    if len(known) > _KEPT:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN) -> BytePairEncoder:
    """One encoder a worker and vocabulary."""
    return BytePairEncoder(path, pattern)


def shipped(spark: SparkSession, path: str) -> Callable[[], str]:
    """Send a vocabulary file to the executors, so that only the driver needs it in its place; gives what tells its path there."""
    spark.sparkContext.addFile(path)
    name = posixpath.basename(path)
    return lambda: SparkFiles.get(name)


def decode_corpus(ids: DataFrame, id_col: str = "doc_id", vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(`id_col`, text): the text of each row's ids; an empty text for an empty list. Unknown ids fail."""
    path = shipped(ids.sparkSession, vocabulary)
    kind = ids.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path(), pattern).tokens
        for b in batches:
            texts = [b"".join([pieces[i] for i in row or ()]).decode("utf-8", "surrogatepass") for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return ids.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(`id_col`, ids): the token ids of each row's whole text, without special tokens.

    An empty and a null text give an empty list. Strings that look like special tokens are ordinary text. One row comes out
    for each row that goes in, repeated ids included; an empty table gives an empty result.
    """
    rows = spread(df.select(F.col(id_col), F.col(text).cast("string").alias("text")), id_col)
    kind = rows.schema[0].dataType.simpleString()
    path = shipped(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path(), pattern).encode
        for b in batches:
            ids = [encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(`id_col`, n_tokens) of each row; 0 for an empty or null text."""
    rows = spread(df.select(F.col(id_col), F.col(text).cast("string").alias("text")), id_col)
    kind = rows.schema[0].dataType.simpleString()
    path = shipped(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path(), pattern).encode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int64())], names=[id_col, "n_tokens"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")
