"""Near-duplicate records: an exact similarity self-join of n-gram sets by prefix trees.

Each distinct normalised text is a set of n-grams in one global order, rare ones first by a hashed frequency table. Two sets
above the threshold share a gram of their prefixes, so each set is hung into the tree of every gram of its prefix. Below that
gram the levels are: the size of the set, then its further grams in global order, one band of the order a level. An edge
is the parity word of the set's grams in that band, and sets whose words agree so far share the path. A traversal takes the tree against
itself: a pair of nodes carries one partial overlap (as grams that are known to differ) for all pairs of sets below. It starts
from the depth at which the shared gram stands, since all grams before it differ, and adds the bits in which the words
of later bands differ, at most as many as the grams do. A pair of subtrees is left as soon as what remains of the sets can't make up for it. So no pair
is lost, and what comes out is verified on the grams themselves.

Below a gram with many paths hardly any two share a node. There the paths are sorted by size and by the depth of the gram,
which bounds the partners of each, and compared tile by tile without lists of pairs; the bounds are the same.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.canonical import canonical_text, composed
from millrace.operators.components import bipartite_components
from millrace.operators.skew import CHUNK, salted_join
from millrace.session import cut, spread

GRAM = 5
THRESHOLD = 0.8
#: log2 of the size of the frequency table, which is sent to all tasks (5 bytes an entry). It only sets the order.
TABLE_BITS = 20
#: Sets that one cell of a hot gram takes; the tree of a hotter gram is split into pairs of cells.
CELL = 20_000
#: Hot grams that are sent to all tasks at once; if there are more, the grams are taken in as many passes as needed.
HOT_SENT = 500_000
#: Postings of one block, and pairs of nodes held at once.
BLOCK_POSTINGS, WALK = 1_000_000, 300_000
#: Paths under one gram from which on they are compared in tiles, paths in each class of size, pairs and rows of a tile.
DENSE, CLASS, TILE, ROWS = 100, 200, 1 << 17, 64
SLOTS = 64  # finest bands, and most of them
RARE, RAREST = 255, 0.2  # the rarest grams, which make most prefixes, are a band of their own
GRAM_BITS = 0.48  # least bits of the words for each gram
TEXTS = 2_000  # texts whose grams are made at once
_EPS = 1e-9


def normalised(text: Column) -> Column:
    """Lower case, each stretch of characters other than letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


@dataclass(frozen=True)
class Order:
    """A global order of grams: `rank` of each hash bucket, and `slot`, the band of each rank."""

    bits: int
    rank: np.ndarray
    slot: np.ndarray

    @staticmethod
    def of(freq: np.ndarray) -> Order:
        by = np.argsort(freq, kind="stable")
        rank = np.empty(len(freq), np.uint32)
        rank[by] = np.arange(len(freq), dtype=np.uint32)
        share = (np.cumsum(freq[by]) - freq[by] / 2) / max(1, freq.sum())
        slot = np.clip((share - RAREST) / (1 - RAREST) * SLOTS, 0, SLOTS - 1)
        return Order(len(freq).bit_length() - 1, rank, np.where(share < RAREST, RARE, slot).astype(np.uint8))

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Hashes re-coded one to one, so that they sort in the global order."""
        bucket = (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return (self.rank[bucket].astype(np.uint64) << np.uint64(64 - self.bits)) | (h >> np.uint64(self.bits))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return self.slot[(keys >> np.uint64(64 - self.bits)).astype(np.int64)]


def gram_sets(texts: list[str], n: int = GRAM, order: Order | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(grams, sizes): the distinct substrings of `n` characters of each text as 64-bit hashes (or keys of `order`), ascending, one text after another."""
    length = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    count = np.maximum(length - n + 1, 0)
    if not count.sum():
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    m = len(c) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += c[k : k + m]
        h += np.uint64(1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    end = np.cumsum(count)
    start = end - count
    h = h[np.repeat(np.cumsum(length) - length - start, count) + np.arange(end[-1])]
    if order:
        h = order.keys(h)
    for a, b in zip(start.tolist(), end.tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    new[start[count > 0]] = True
    whose = np.repeat(np.arange(len(texts)), count)
    return h[new], np.bincount(whose[new], minlength=len(texts))


def level_of(slots: np.ndarray, bands: np.ndarray | int) -> np.ndarray:
    """0 for the rarest grams, then one for each of `bands` bands of the order."""
    return np.where(slots == RARE, 0, 1 + slots.astype(np.int64) * bands // SLOTS)


def bands_of(size: np.ndarray) -> np.ndarray:
    """Bands of a set beside that of the rarest grams: a power of two with about half a bit a gram, so that unrelated sets of that size differ in more bits than allowed."""
    need = np.maximum(GRAM_BITS * np.asarray(size, float) / 64, 1.0)
    return np.clip(1 << np.ceil(np.log2(need) - _EPS).astype(np.int64), 2, SLOTS)


def parity_words(keys: np.ndarray, sizes: np.ndarray, bands: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The words, one a band, of all sets, one set after another. Bit i of a word is the parity of the grams of its band that hash to i, so the XOR of two is that of the grams in which they differ."""
    words = bands + 1
    first = np.cumsum(words) - words
    word = np.repeat(first, sizes) + level_of(slots, np.repeat(bands, sizes))
    bit = word * 64 + (keys & np.uint64(63)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=64 * int(words.sum())) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, to: int) -> np.ndarray:
    """Rows of words as rows of fewer, wider bands."""
    n, bands = len(words), words.shape[1] - 1
    return np.c_[words[:, :1], np.bitwise_xor.reduce(words[:, 1:].reshape(n, to, bands // to), axis=2)]


def prefix_sizes(sizes: np.ndarray, threshold: float) -> np.ndarray:
    return np.where(sizes > 0, sizes - np.ceil(threshold * sizes - _EPS).astype(np.int64) + 1, 0)


def _slices(texts: list) -> Iterator[tuple[int, list]]:
    """Runs of whole texts of bounded total length (a longer text by itself)."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if i + 1 - lo >= TEXTS or size > 1_000_000:
            yield lo, texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def _frequencies(units: DataFrame, bits: int, n: int) -> tuple[np.ndarray, int]:
    """(table, sets): how often grams of each hash bucket occur over all sets, in a table of fixed size, and the number of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sets = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            for _, texts in _slices(b.column(0).to_pylist()):
                h, _ = gram_sets(texts, n)
                total += np.bincount((h & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
            sets += b.num_rows
        there = np.flatnonzero(total)
        for k in range(0, len(there), 100_000):
            part = there[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["bucket", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([sets], pa.int64())], names=["bucket", "n"])

    counted = units.select("norm").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, k = counted["bucket"].to_numpy(), counted["n"].to_numpy()
    out = np.zeros(1 << bits, np.int64)
    out[bucket[bucket >= 0]] = k[bucket >= 0]
    return out, int(k[bucket < 0].sum())


def _hot_grams(units: DataFrame, sent, freq: np.ndarray, n: int, threshold: float, cell: int) -> DataFrame:
    """(gram, n): the grams with more than `cell` postings and how many, counted exactly. Only buckets that hold so many grams can have one."""
    hot = units.sparkSession.sparkContext.broadcast(np.packbits(freq > cell))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: Order = sent.value
        by_rank = np.zeros(1 << order.bits, bool)
        by_rank[order.rank] = np.unpackbits(hot.value, count=1 << order.bits).astype(bool)
        for b in batches:
            for _, texts in _slices(b.column(0).to_pylist()):
                keys, sizes = gram_sets(texts, n, order)
                keys = keys[_in_prefix(sizes, threshold)]
                keys = keys[by_rank[(keys >> np.uint64(64 - order.bits)).astype(np.int64)]]
                grams, k = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(k.astype(np.int64))], names=["gram", "n"])

    counted = units.select("norm").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return cut(counted.filter(F.col("n") > cell), "hot_grams")


def _in_prefix(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Mask of the grams that are in the prefix of their set."""
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return at < np.repeat(prefix_sizes(sizes, threshold), sizes)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(20)


_COLUMNS = (np.uint32, np.uint16, np.uint16)  # gram, position, set
_LONG = (np.uint32, np.uint32, np.uint16)  # the same for texts whose positions need more
_CELLS = (np.uint32, np.uint32, np.uint8)  # cells and side


def _postings(sent, hot, n: int, threshold: float, cell: int, blocks: int, passes: int, turn: int):
    """Hang each set under the grams of its prefix; give (block, packed postings), a row for each block of a run of texts.

    A hot gram is split into pairs of cells of bounded size. In a packed row each set is there once. With more than one
    pass only the grams of this turn are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: Order = sent.value
        hot_keys, hot_n = hot.value
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, texts in _slices(b.column(1).to_pylist()):
                keys, sizes = gram_sets(texts, n, order)
                slots = order.slots(keys)
                bands = bands_of(sizes)
                sketch = parity_words(keys, sizes, bands, slots)
                at = np.flatnonzero(_in_prefix(sizes, threshold))
                if passes > 1:
                    at = at[(_mixed(keys[at]) >> np.uint64(9)) % np.uint64(passes) == turn]
                if not len(at):
                    continue
                owner = np.repeat(np.arange(len(sizes)), sizes)[at]
                pos = at - (np.cumsum(sizes) - sizes)[owner]
                posts = _celled(keys[at], pos, owner, ids[lo : lo + len(texts)], hot_keys, hot_n, cell)
                yield _packed(posts, ids[lo : lo + len(texts)], sizes, bands + 1, sketch, blocks)

    return run


def _celled(keys, pos, owner, uid, hot_keys, hot_n, cell) -> list[np.ndarray]:
    """Postings as key, position, set, cells i <= j, side; a posting of a hot gram once for each cell its own one meets."""
    zero = np.zeros(len(keys), np.int64)
    cells = np.ones(len(keys), np.int64)
    if len(hot_keys):
        at = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
        cells = np.where(hot_keys[at] == keys, -(-hot_n[at] // cell), 1)
    if (cells == 1).all():
        return [keys, pos, owner, zero, zero, zero]
    every = np.repeat(np.arange(len(keys)), cells)
    other = np.arange(len(every)) - np.repeat(np.cumsum(cells) - cells, cells)
    own = (_mixed(uid.astype(np.uint64))[owner[every]] % cells[every].astype(np.uint64)).astype(np.int64)
    return [keys[every], pos[every], owner[every], np.minimum(own, other), np.maximum(own, other), (other < own).astype(np.int64)]


def _packed(posts: list[np.ndarray], uid: np.ndarray, sizes: np.ndarray, words: np.ndarray, sketch: np.ndarray, blocks: int) -> pa.RecordBatch:
    keys, ci, cj = posts[0], posts[3].astype(np.uint64), posts[4].astype(np.uint64)
    block = (_mixed(keys ^ (ci * np.uint64(0x9E3779B97F4A7C15)) ^ (cj * np.uint64(0xD1B54A32D192ED03))) % np.uint64(blocks)).astype(np.int64)
    by = np.argsort(block, kind="stable")
    posts, block = [c[by] for c in posts], block[by]
    # inside a block a gram goes by the upper half of its key: two grams in one tree only cost work
    posts[0] = posts[0] >> np.uint64(32)
    edges = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
    first = np.cumsum(words) - words
    local = np.zeros(len(uid), np.int64)
    payloads = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        part = [c[lo:hi] for c in posts]
        there = np.zeros(len(uid), bool)
        there[part[2]] = True
        own = np.flatnonzero(there)
        local[own] = np.arange(len(own))
        part[2] = local[part[2]]
        celled, long = bool(part[4].any()), bool(part[1].max() >= 1 << 16)
        w = words[own]
        own_words = sketch[np.repeat(first[own] - (np.cumsum(w) - w), w) + np.arange(w.sum())]
        head = np.array([hi - lo, len(own), len(own_words), celled, long], np.int64)
        arrays = [x.astype(t) for x, t in zip(part, _LONG if long else _COLUMNS)] + [uid[own], sizes[own].astype(np.int32), own_words]
        arrays += [x.astype(t) for x, t in zip(part[3:], _CELLS)] if celled else []
        payloads.append(head.tobytes() + b"".join(x.tobytes() for x in arrays))
    return pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]]), pa.array(payloads, pa.binary())], names=["block", "payload"])


def _by_rows(words: np.ndarray) -> np.ndarray:
    """The order of rows of words, as of lexsort: by the first word, and where that is the same by the others."""
    by = np.argsort(words[:, 0])
    first = words[by, 0]
    same = first[1:] == first[:-1]
    tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    by[tied] = by[tied][np.lexsort(words[by[tied]].T[::-1])]
    return by


@dataclass
class Postings:
    """The postings of a block, and the sets they name: uid, size, and words by number of words."""

    gram: np.ndarray
    pos: np.ndarray
    member: np.ndarray
    ci: np.ndarray
    cj: np.ndarray
    side: np.ndarray
    uid: np.ndarray
    size: np.ndarray
    words: dict[int, tuple[np.ndarray, np.ndarray]]  # number of bands: (row of each set or -1, rows of words)

    @staticmethod
    def unpack(payloads: Iterator[bytes]) -> Postings:
        parts: list[list[np.ndarray]] = [[] for _ in range(9)]
        before = 0
        for data in payloads:
            posts, sets, n_words, celled, long = np.frombuffer(data, np.int64, 5)
            kinds = [*(_LONG if long else _COLUMNS), np.int64, np.int32, np.uint64, *_CELLS]
            at = 40
            for k, (kind, count) in enumerate(zip(kinds, [posts] * 3 + [sets, sets, n_words] + [posts] * 3)):
                if k > 5 and not celled:
                    x = np.zeros(posts, kind)
                else:
                    x = np.frombuffer(data, kind, count, at)
                    at += x.nbytes
                parts[k].append(x.astype(np.int64) + before if k == 2 else x)
            before += int(sets)
        gram, pos, member, uid, size, words, ci, cj, side = (np.concatenate(x) for x in parts)
        size = size.astype(np.int64)
        # a set comes once for each packed row: the same set from two rows is no other set, but has the same uid
        wide = bands_of(size)
        first = np.cumsum(wide + 1) - wide - 1
        tables = {}
        for w in np.unique(wide):
            own = np.flatnonzero(wide == w)
            row = np.full(len(size), -1)
            row[own] = np.arange(len(own))
            tables[int(w)] = row, words[first[own][:, None] + np.arange(w + 1)]
        return Postings(gram, pos.astype(np.int64), member, ci, cj, side, uid, size, tables)


class Trees:
    """The prefix trees of a block's grams, for the sets of one number of bands and the larger ones that may be similar to them.

    Nodes are kept by level: under each gram the sizes, then a word a level. A node is a run of postings in sorted order
    and of its children on the next level.
    """

    def __init__(self, block: Postings, bands: int, threshold: float, order: Order, dense: int = DENSE):
        self.block, self.width, self.threshold = block, bands + 1, threshold
        wide = bands_of(block.size)
        # the largest size with so many bands
        self.most = int(bands * 64 / GRAM_BITS + _EPS) if bands < SLOTS else int(block.size.max(initial=1))
        joins = (wide == bands) | ((wide > bands) & (threshold * block.size <= self.most + _EPS))
        row = np.full(len(block.size), -1)
        tables, n = [], 0
        for w, (rows, words) in block.words.items():
            own = np.flatnonzero(joins & (rows >= 0))
            if len(own):
                row[own] = n + np.arange(len(own))
                tables.append(folded(words[rows[own]], bands))
                n += len(own)
        self.sets = np.concatenate(tables) if tables else np.zeros((0, bands + 1), np.uint64)
        # rank of the word path of each set, so that one sort of whole numbers orders the postings
        path = _by_rows(self.sets)
        of = np.empty(len(path), np.int64)
        of[path] = np.arange(len(path))
        of_member = row[block.member]
        at = np.flatnonzero(of_member >= 0)
        gram, size, rank = block.gram[at], block.size[block.member[at]], of[of_member[at]]
        celled = bool(block.cj.any())
        size_bits, rank_bits = int(size.max(initial=1)).bit_length(), max(1, len(of)).bit_length()
        if not celled and size_bits + rank_bits <= 32:
            by = np.argsort(gram.astype(np.uint64) << np.uint64(32) | (size << rank_bits | rank).astype(np.uint64), kind="stable")
        else:
            by = np.lexsort((rank, size, block.cj[at], block.ci[at], gram))
        at, size, gram = at[by], size[by], gram[by]
        fresh = np.ones(len(at), bool)
        fresh[1:] = gram[1:] != gram[:-1]
        if celled:
            fresh[1:] |= (block.ci[at[1:]] != block.ci[at[:-1]]) | (block.cj[at[1:]] != block.cj[at[:-1]])
        branch = np.cumsum(fresh) - 1
        self.at, self.row = at, of_member[at]
        new = np.ones(len(at), bool)
        new[1:] = (branch[1:] != branch[:-1]) | (size[1:] != size[:-1])
        self.start: list[np.ndarray] = []  # of each level's nodes in the postings
        self.label: list[np.ndarray] = []
        for level in range(self.width + 1):
            if level:
                words = self.sets[self.row, level - 1]
                new = new.copy()
                new[1:] |= words[1:] != words[:-1]
            self.start.append(np.flatnonzero(new))
            self.label.append(self.sets[self.row[self.start[-1]], level - 1] if level else np.zeros(0, np.uint64))
        self.end = [np.r_[s[1:], len(at)] for s in self.start]
        pos = block.pos[at]
        self.pos = pos
        self.depth = [np.minimum.reduceat(pos, s) if len(s) else pos for s in self.start]
        self.first = [np.searchsorted(below, s) for s, below in zip(self.start, self.start[1:])]
        self.children = [np.searchsorted(below, e) - f for e, below, f in zip(self.end, self.start[1:], self.first)]
        top = self.start[0]
        self.branch, self.size = branch[top], size[top]
        # the band of the shared gram: grams of the bands up to it may be among those before it
        self.band = level_of(order.slots(gram[top].astype(np.uint64) << np.uint64(32)), bands)
        # the paths, their grams' branches, and the branches with many of them
        paths = self.start[self.width]
        self.path_size = block.size[block.member[at[paths]]]
        self.path_words = np.ascontiguousarray(self.sets[self.row[paths]].T)
        self.edges = np.r_[np.searchsorted(branch[paths], np.arange(branch[-1] + 1)), len(paths)] if len(at) else np.zeros(1, np.int64)
        band = self.band[np.flatnonzero(np.diff(self.branch, prepend=-1))]
        self.dense = (np.diff(self.edges) >= dense) & (band < bands)
        self.path_band = np.repeat(band, np.diff(self.edges))
        # pairs of nodes that were listed, and pairs of paths compared in tiles
        self.visits = self.compared = 0

    def pairs(self, walk: int = WALK) -> Iterator[np.ndarray]:
        """Arrays of pairs of uids, ascending in a row, that may be similar."""
        if not len(self.at):
            return
        yield from self._tiled(walk)
        t, size, depth = self.threshold, self.size, self.depth[0]
        # sizes up to which a partner's overlap may still be reached from this depth on
        reach = np.floor(np.minimum((size - depth) * ((1 + t) / t) - size, size / t) + _EPS).astype(np.int64)
        reach = np.where((size > self.most) | self.dense[self.branch], -1, reach)  # two larger sets meet in their own tree
        span = int(max(size.max(), reach.max(initial=0))) + 2
        place = self.branch * span + size
        here = np.arange(len(size))
        many = np.maximum(np.searchsorted(place, self.branch * span + np.maximum(reach, -1), side="right") - here, 0)
        cum = np.cumsum(many)
        lo = 0
        while lo < len(size):
            base = cum[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(cum, base + walk, side="right")))
            u = np.repeat(np.arange(lo, hi), many[lo:hi])
            v = np.arange(len(u)) - np.repeat(cum[lo:hi] - many[lo:hi] - base, many[lo:hi]) + u
            back = (size[v] - depth[v]) * ((1 + t) / t) - size[v]
            ok = size[u] <= back + _EPS
            u, v = u[ok], v[ok]
            both = size[u] + size[v]
            budget = both - 2 * np.ceil(t / (1 + t) * both - _EPS).astype(np.int64)
            # what may differ beside the grams before the shared one, and what may differ in all
            yield from self._down(u, v, budget, budget, self.band[u], walk)
            lo = hi

    def _tiled(self, walk: int) -> Iterator[np.ndarray]:
        """The pairs of the branches with many paths."""
        held, many = [], 0
        for k in np.flatnonzero(self.dense):
            for u, v in self._tiles(int(self.edges[k]), int(self.edges[k + 1])):
                held.append((u, v))
                many += len(u)
                if many > walk:
                    yield from self._finish(held)
                    held, many = [], 0
        yield from self._finish(held)

    def _tiles(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the paths lo to hi of one gram whose first few words behind it leave them a chance."""
        t, n = self.threshold, hi - lo
        share = t / (1 + t)
        size, depth = self.path_size[lo:hi], self.depth[self.width][lo:hi]
        classes = -(-n // CLASS)
        of = np.empty(n, np.int64)
        of[np.argsort(size, kind="stable")] = np.arange(n) * classes // n
        by = np.lexsort((depth, of))
        edge = np.searchsorted(of[by], np.arange(classes + 1)).tolist()
        size, depth, by = size[by], depth[by], by + lo
        slack = 0.01 + size * 1e-6  # all bounds are rounded so that no pair is lost
        # half of what two sets of this size may differ in, less the grams before the shared one
        room = (size * (1 - 2 * share) - depth + slack).astype(np.float32)
        # a set's grams from the shared one on, less its part of the least overlap: must hold the partner's part
        rest = size * (1 - share) - depth + slack
        words = self.path_words[int(self.path_band[lo]) + 1 :, by]
        low, high = np.minimum.reduceat(size, edge[:-1]).tolist(), np.maximum.reduceat(size, edge[:-1]).tolist()
        # of each class, the most of these from a path on, negated so that it ascends
        least_room, least_rest = ([(-np.maximum.accumulate(x[a:b][::-1])[::-1]).tolist() for a, b in zip(edge, edge[1:])] for x in (room, rest))
        for i in range(classes):
            if low[i] > self.most:
                break  # two larger sets meet in their own tree
            for j in range(i, classes):
                if t * low[j] > high[i] + _EPS:
                    break
                r, end = edge[i], edge[i] + bisect_right(least_rest[i], -share * low[j])
                top = edge[j] + bisect_right(least_rest[j], -share * low[i])
                while r < end:
                    # the partners of a run of paths: those whose room makes up for the most of the run
                    most = -least_room[i][r - edge[i]]
                    first = r if i == j else edge[j]
                    last = min(top, edge[j] + bisect_right(least_room[j], most))
                    if last <= first:
                        break
                    s = min(end, r + max(1, min(ROWS, TILE // (last - first))))
                    k = min(len(words), 3, 1 + max(0, int(most - least_room[j][0]) // 34))
                    differ = np.bitwise_count(words[0, r:s, None] ^ words[0, None, first:last])
                    for w in words[1:k]:
                        differ += np.bitwise_count(w[r:s, None] ^ w[None, first:last])
                    self.compared += differ.size
                    x, y = np.divmod(np.flatnonzero(differ <= room[r:s, None] + room[None, first:last]), last - first)
                    x, y = x + r, y + first
                    if i == j:
                        x, y = x[x <= y], y[x <= y]
                    if len(x):
                        yield by[x], by[y]
                    r = s

    def _finish(self, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        """From pairs of paths to pairs of sets, by all words."""
        if not held:
            return
        u, v = (np.concatenate(x) for x in zip(*held))
        self.visits += len(u)
        t, size, depth = self.threshold, self.path_size, self.depth[self.width]
        both, shared = size[u] + size[v], np.minimum(size[u] - depth[u], size[v] - depth[v])
        least = np.ceil(t / (1 + t) * both - _EPS).astype(np.int64)
        alive = np.flatnonzero((shared >= least) & (np.minimum(size[u], size[v]) <= self.most))
        u, v, whole = u[alive], v[alive], (both - 2 * least)[alive]
        behind, band = whole, self.path_band[u]
        for level in reversed(range(self.width)):
            differ = np.bitwise_count(self.path_words[level][u] ^ self.path_words[level][v]).astype(np.int64)
            whole = whole - differ
            behind = behind - np.where(band < level, differ, 0)
            alive = np.flatnonzero((whole >= 0) & (behind >= depth[u] + depth[v]))
            u, v, whole, behind, band = u[alive], v[alive], whole[alive], behind[alive], band[alive]
        if len(u):
            yield self._leaves(u, v, behind)

    def _down(self, u: np.ndarray, v: np.ndarray, behind: np.ndarray, whole: np.ndarray, band: np.ndarray, walk: int, level: int = 0) -> Iterator[np.ndarray]:
        """Go down with pairs of nodes. All grams before the shared one differ, and are not to be counted twice: `behind` is how many grams may
        still differ, less what differs in the bands behind that of the shared gram, `whole` less what differs in all bands."""
        while len(u) and level < self.width:
            self.visits += len(u)
            nu, nv = self.children[level][u], self.children[level][v]
            n = nu * nv
            total = int(n.sum())
            if len(u) > 1 and total > 2 * walk:
                # in parts, so that what is held stays bounded
                half = min(max(1, int(np.searchsorted(np.cumsum(n), total // 2))), len(u) - 1)
                yield from self._down(u[:half], v[:half], behind[:half], whole[:half], band[:half], walk, level)
                u, v, behind, whole, band = u[half:], v[half:], behind[half:], whole[half:], band[half:]
                continue
            a, b = self.first[level][u], self.first[level][v]
            if total > len(u):
                k = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                pair = np.repeat(np.arange(len(u)), n)
                a, b = a[pair] + k // nv[pair], b[pair] + k % nv[pair]
                keep = np.flatnonzero((u != v)[pair] | (a <= b))
                a, b, pair = a[keep], b[keep], pair[keep]
                behind, whole, band = behind[pair], whole[pair], band[pair]
            label, depth = self.label[level + 1], self.depth[level + 1]
            differ = np.bitwise_count(label[a] ^ label[b]).astype(np.int64)
            whole = whole - differ
            behind = behind - np.where(band < level, differ, 0)
            alive = np.flatnonzero((whole >= 0) & (behind >= depth[a] + depth[b]))
            u, v, behind, whole, band = a[alive], b[alive], behind[alive], whole[alive], band[alive]
            level += 1
        if len(u):
            yield self._leaves(u, v, behind)

    def _leaves(self, u: np.ndarray, v: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """From pairs of leaves, each a group of sets with equal words, to pairs of sets."""
        self.visits += len(u)
        level = self.width
        nu, nv = (self.end[level] - self.start[level])[u], (self.end[level] - self.start[level])[v]
        n = nu * nv
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.repeat(np.arange(len(u)), n)
        a, b = self.start[level][u[pair]] + k // nv[pair], self.start[level][v[pair]] + k % nv[pair]
        own, block = self.at, self.block
        keep = ((u[pair] != v[pair]) | (a < b)) & (behind[pair] >= self.pos[a] + self.pos[b])
        pa_, pb = own[a], own[b]
        # in a pair of cells only sets of different ones meet
        keep &= (block.ci[pa_] == block.cj[pa_]) | (block.side[pa_] != block.side[pb])
        x, y = block.uid[block.member[pa_[keep]]], block.uid[block.member[pb[keep]]]
        found = np.stack([np.minimum(x, y), np.maximum(x, y)], 1)
        return found[found[:, 0] != found[:, 1]]


def block_pairs(payloads: Iterator[bytes], order: Order, threshold: float = THRESHOLD, walk: int = WALK) -> Iterator[np.ndarray]:
    """Pairs of uids of a block's packed postings that may be similar, each once a part."""
    block = Postings.unpack(payloads)
    held: list[np.ndarray] = []
    for width in block.words:
        for found in Trees(block, width, threshold, order).pairs(walk):
            held.append(found)
            if sum(map(len, held)) > walk:
                yield np.unique(np.concatenate(held), axis=0)
                held = []
    if held:
        yield np.unique(np.concatenate(held), axis=0)


def _walk(sent, threshold: float, walk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads = [p for b in batches for p in b.column(1).to_pylist()]
        if not payloads:
            return
        for pairs in block_pairs(iter(payloads), sent.value, threshold, walk):
            for k in range(0, len(pairs), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[k : k + 200_000, i])) for i in (0, 1)], names=["ua", "ub"])

    return run


def _verify(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grams(t: str) -> set[str]:
            return {t[i : i + n] for i in range(len(t) - n + 1)}

        last, own = None, set()
        for b in batches:
            keep, sims = [], []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if x != last:
                    last, own = x, grams(x)
                other = grams(y)
                both = len(own & other)
                either = len(own) + len(other) - both
                if both >= threshold * either - _EPS:
                    keep.append(i), sims.append(both / either)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(sims, pa.float64())], names=["ua", "ub", "similarity"])

    return run


def _rows(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("raw")).filter("id is not null and raw is not null")


def text_members(rows: DataFrame) -> DataFrame:
    """(id, norm, n1, n2): normalised text and its 128-bit hash, of each (id, raw) with a word."""
    out = rows.select("id", normalised(F.col("raw")).alias("norm")).filter("norm != ''")
    return out.select("id", "norm", F.xxhash64("norm").alias("n1"), F.xxhash64(F.lit("second"), "norm").alias("n2"))


def similar_units(units: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, table_bits: int = TABLE_BITS, cell: int = CELL, hot_sent: int = HOT_SENT) -> DataFrame:
    """(ua, ub, similarity), ua < ub: all pairs of (uid, norm) whose gram sets have a Jaccard similarity of at least `threshold`."""
    spark = units.sparkSession
    freq, sets = _frequencies(units, table_bits, n)
    order = spark.sparkContext.broadcast(Order.of(freq))
    keys, counts, passes, extra = np.empty(0, np.uint64), np.empty(0, np.int64), 1, 0
    if (freq > cell).any():
        hot = _hot_grams(units, order, freq, n, threshold, cell)
        many, extra = hot.agg(F.count("*"), F.coalesce(F.sum(F.col("n") * (F.ceil(F.col("n") / cell) - 1)), F.lit(0))).first()
        passes = max(1, -(-many // hot_sent))
    # replicas of hot postings count too
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((freq.sum() * (1 - threshold) + sets + extra) / passes / BLOCK_POSTINGS) + 1)
    pairs = None
    for turn in range(passes):
        if (freq > cell).any():
            of = (F.shiftrightunsigned("mixed", 9) % passes == turn) if passes > 1 else F.lit(True)
            got = hot.mapInArrow(_with_mix, "gram bigint, n bigint, mixed bigint").filter(of).toArrow()  # about hot_sent rows
            by = np.argsort(got["gram"].to_numpy().view(np.uint64))
            keys, counts = got["gram"].to_numpy().view(np.uint64)[by], got["n"].to_numpy()[by]
        sent = spark.sparkContext.broadcast((keys, counts))
        postings = units.select("uid", "norm").mapInArrow(_postings(order, sent, n, threshold, cell, blocks, passes, turn), "block bigint, payload binary")
        one = postings.repartitionById(blocks, F.col("block").cast("int")).mapInArrow(_walk(order, threshold, WALK), "ua bigint, ub bigint")
        pairs = one if pairs is None else pairs.unionByName(one)
    pairs = cut(pairs.distinct(), "pairs")
    text = lambda u, t: units.select(F.col("uid").alias(u), F.col("norm").alias(t))
    full = pairs.join(text("ub", "tb"), "ub").join(text("ua", "ta"), "ua").select("ua", "ub", "ta", "tb")
    return full.mapInArrow(_verify(n, threshold), "ua bigint, ub bigint, similarity double")


def _with_mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        mixed = _mixed(b.column(0).to_numpy().view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(mixed)], names=["gram", "n", "mixed"])


class NearDuplicates:
    """Exact near-duplicate search over the texts of a table.

    `df` needs an id and a text. Rows with a null id or a text without any word or number take no part, texts shorter than
    the gram have no grams and are similar to nothing. Rows that repeat id and text count once; an id with several texts
    has the links of all of them. Texts of any length are used
    whole. Copies are merged before the join and expanded after it. An empty table gives empty results.
    """

    def __init__(self, df: DataFrame, id_col: str = "id", text: str = "text", n: int = GRAM, threshold: float = THRESHOLD, table_bits: int = TABLE_BITS, cell: int = CELL, chunk: int = CHUNK, hot_sent: int = HOT_SENT):
        self.chunk = chunk
        self.rows = _rows(df, id_col, text)
        keyed = cut(text_members(spread(self.rows, "id", least=1.0)), "texts")
        context = df.sparkSession.sparkContext
        parts = max(3 * context.defaultParallelism, keyed.rdd.getNumPartitions())
        # one text an id, chosen by its hash
        ids = keyed.groupBy("id").agg(F.min(F.struct("n1", "n2")).alias("k")).select("id", "k.n1", "k.n2")
        counts = cut(ids.groupBy("n1", "n2").agg(F.min("id").alias("uid"), F.count("*").alias("n")), "units")
        first = counts.select(F.col("uid").alias("id"), F.col("n1").alias("u1"), F.col("n2").alias("u2"))
        texts = keyed.filter(F.length("norm") >= n).repartition(parts, "id").join(first, "id").filter("n1 = u1 and n2 = u2")
        self.units = cut(texts.select(F.col("id").alias("uid"), "norm").dropDuplicates(["uid"]), "unit_texts")
        self.members = cut(salted_join(ids, counts.drop("n"), ["n1", "n2"], counts.drop("uid"), F.col("id"), chunk=chunk).select("uid", "id", "n1"), "members")
        self.sizes = counts.select("uid", "n")
        self.pairs = cut(similar_units(spread(self.units, "uid", least=1.0), n, threshold, table_bits, cell, hot_sent), "similar")

    def _forms(self) -> DataFrame:
        """(uid, id, c1, c2): the records that may be in a pair, with the hash of the canonical form of their text.

        Only units that are similar to another or hold several records can give pairs, so only their texts are read again.
        """
        paired = self.pairs.select(F.explode(F.array("ua", "ub")).alias("uid"))
        needed = paired.unionByName(self.sizes.filter("n > 1").join(self.units.select("uid"), "uid").select("uid")).distinct()
        members = salted_join(self.members, needed, ["uid"], self.sizes, F.col("id"), chunk=self.chunk)
        # written as XOR so that it doesn't become a join key, for which all texts would have to be normalised
        own = self.rows.join(members, "id").filter(F.xxhash64(normalised(F.col("raw"))).bitwiseXOR(F.col("n1")) == 0)
        made = composed(own.select("uid", "id", F.col("raw").alias("nfc")), "nfc")
        made = made.select("uid", "id", canonical_text(F.col("nfc")).alias("c"))
        return made.select("uid", "id", F.xxhash64("c").alias("c1"), F.xxhash64(F.lit("second"), "c").alias("c2")).dropDuplicates(["id"])

    def record_pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: all pairs of records that are similar but not the same words and numbers."""
        members = cut(self._forms(), "forms")
        a = members.select(F.col("uid").alias("ua"), F.col("id").alias("i"), F.col("c1").alias("a1"), F.col("c2").alias("a2"))
        b = members.select(F.col("uid").alias("ub"), F.col("id").alias("j"), F.col("c1").alias("b1"), F.col("c2").alias("b2"))
        of = lambda u: self.sizes.select(F.col("uid").alias(u), "n")
        half = salted_join(a, self.pairs.select("ua", "ub"), ["ua"], of("ua"), F.col("i"), chunk=self.chunk)
        full = salted_join(b, half, ["ub"], of("ub"), F.col("j"), chunk=self.chunk).select("i", "j", "a1", "a2", "b1", "b2")
        # equal normalised texts may still be different words and numbers (signs, decimal points)
        key = ["uid", "c1", "c2"]
        forms = members.groupBy(*key).agg(F.count("*").alias("n"))
        mixed = forms.groupBy("uid").agg(F.count("*").alias("forms")).filter("forms > 1").select("uid")
        forms = cut(forms.join(mixed, "uid"), "mixed")
        other = forms.select("uid", F.col("c1").alias("d1"), F.col("c2").alias("d2"))
        both = forms.drop("n").join(other, "uid").filter("c1 < d1 or c1 = d1 and c2 < d2")
        i = salted_join(members.select(*key, F.col("id").alias("i")), both, key, forms, F.col("i"), chunk=self.chunk)
        i = i.select("uid", "i", F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("d1").alias("c1"), F.col("d2").alias("c2"))
        within = salted_join(members.select(*key, F.col("id").alias("j")), i, key, forms, F.col("j"), chunk=self.chunk)
        within = within.select("i", "j", "a1", "a2", F.col("c1").alias("b1"), F.col("c2").alias("b2"))
        return full.unionByName(within).filter("a1 != b1 or a2 != b2").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))

    def groups(self) -> DataFrame:
        """(id, group_id, n_links): one row a record; `group_id` is the smallest id of its group of similar or equal
        texts, `n_links` the number of different texts (normalised) it is similar to."""
        stars = self.pairs.select(F.col("ua").alias("rec"), F.col("ua").alias("ent")).unionByName(self.pairs.select(F.col("ub").alias("rec"), F.col("ua").alias("ent")))
        first = bipartite_components(stars, chunk=self.chunk).select(F.col("rec").alias("uid"), "first")
        links = self.pairs.select(F.explode(F.array("ua", "ub")).alias("uid")).groupBy("uid").agg(F.count("*").alias("n_links"))
        known = self.sizes.join(first, "uid", "left").join(links, "uid", "left").select("uid", F.coalesce("first", "uid").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        return salted_join(self.members.select("uid", "id"), known, ["uid"], self.sizes, F.col("id"), chunk=self.chunk).select("id", "group_id", "n_links")
