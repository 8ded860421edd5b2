import random
import re

import numpy as np
import pytest

from millrace.llm.neardup import NearDuplicates, Order, Postings, Trees, _postings, bands_of, folded, gram_sets, level_of, parity_words

SCHEMA = "id bigint, text string"


def brute(rows, t=0.8):
    norm = {i: re.sub(r"[\W_]+", " ", x.lower()).strip() for i, x in rows if x}
    sets = {i: {x[k : k + 5] for k in range(len(x) - 4)} for i, x in norm.items()}
    return {
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and norm[a] != norm[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9
    }


def edited(rng, words, text):
    out = text.split()
    for _ in range(rng.randrange(1, 4)):
        i = rng.randrange(len(out))
        kind = rng.randrange(4)
        if kind == 0:
            out[i] = rng.choice(words)
        elif kind == 1:
            del out[i]
        elif kind == 2:
            out.insert(i, rng.choice(words))
        else:
            j = rng.randrange(len(out))
            out[i], out[j] = out[j], out[i]
    return " ".join(out)


@pytest.mark.parametrize("cell,low,high", [(20_000, 8, 60), (5, 8, 60), (20_000, 150, 900)])
def test_against_brute_force(spark, cell, low, high):
    rng = random.Random(cell + high)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(60)]
    rows = []
    for _ in range(60):
        base = " ".join(rng.choice(words) for _ in range(rng.randrange(low, high)))
        rows += [base] + [edited(rng, words, base) for _ in range(rng.randrange(3))] + [base.upper() + "!"] * rng.randrange(2)
    rows = list(enumerate(rows)) + [(900, None), (901, ""), (902, "..."), (903, "abc"), (904, "abc")]
    near = NearDuplicates(spark.createDataFrame(rows, SCHEMA), cell=cell, chunk=3)
    got = [tuple(r) for r in near.record_pairs().collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_same_normalised_text_but_other_numbers(spark):
    rows = [(1, "value -5 at step 31.5 of the run"), (2, "value 5 at step 31.5 of the run"), (3, "value 5 at step 31.5, of the run"), (4, "value 5 at step 31 5 of the run")]
    got = sorted(map(tuple, NearDuplicates(spark.createDataFrame(rows, SCHEMA)).record_pairs().collect()))
    assert got == [(1, 2), (1, 3), (1, 4), (2, 4), (3, 4)]


def test_groups(spark):
    base = "the quick brown fox jumps over the lazy dog again and again until the evening comes to the valley of stones"
    rows = [(5, base), (2, base + " x"), (9, base.upper()), (7, "something else entirely, with other words in it"), (8, None)]
    got = {r.id: (r.group_id, r.n_links) for r in NearDuplicates(spark.createDataFrame(rows, SCHEMA)).groups().collect()}
    assert got == {5: (2, 1), 2: (2, 1), 9: (2, 1), 7: (7, 0)}
    assert NearDuplicates(spark.createDataFrame([], SCHEMA)).groups().count() == 0


def sets_of(texts, bits=8):
    h, _ = gram_sets(texts)
    order = Order.of(np.bincount((h & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits))
    return order, *gram_sets(texts, order=order)


def test_words_never_differ_by_more_than_the_sets():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc ") for _ in range(n)) for n in (40, 900, 900, 6000)]
    texts += [t[: len(t) // 2] + "zz" + t[len(t) // 2 :] for t in texts]
    order, keys, sizes = sets_of(texts)
    bands = bands_of(sizes)
    flat = parity_words(keys, sizes, bands, order.slots(keys))
    at, first = np.cumsum(sizes) - sizes, np.cumsum(bands + 1) - bands - 1
    for a in range(4):
        w = min(bands[a], bands[a + 4])
        x, y = (folded(flat[first[i] : first[i] + bands[i] + 1][None], w)[0] for i in (a, a + 4))
        differ = np.setxor1d(keys[at[a] : at[a] + sizes[a]], keys[at[a + 4] : at[a + 4] + sizes[a + 4]])
        level = level_of(order.slots(differ), w)
        for k in range(w + 1):
            assert np.bitwise_count(x[k] ^ y[k]) <= (level == k).sum()


def test_keys_are_one_to_one_and_sets_are_distinct():
    assert [len(gram_sets([t])[0]) for t in ("", "abcd", "abcde", "aaaaaaaa", "abcdeabcde")] == [0, 0, 1, 1, 5]
    texts = ["", "abcde", "x", "abcdefg", "zzzzzzzzz"]
    h, sizes = gram_sets(texts)
    assert sizes.tolist() == [0, 1, 0, 3, 1]
    order, keys, _ = sets_of(texts)
    assert len(np.unique(keys)) == len(np.unique(h))


class Sent:
    def __init__(self, value):
        self.value = value


def trees_of(texts):
    """The trees of all grams, in one block."""
    import pyarrow as pa

    order, _, _ = sets_of(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["uid", "norm"])
    none = Sent((np.empty(0, np.uint64), np.empty(0, np.int64)))
    out = _postings(Sent(order), none, 5, 0.8, 20_000, 1, 1, 0)(iter([batch]))
    block = Postings.unpack(iter([p for b in out for p in b.column(1).to_pylist()]))
    return block, [Trees(block, w, 0.8, order) for w in block.words]


def test_pairs_below_a_node_share_its_overlap():
    """Sets with one path are visited as one node, not pair by pair."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(260)) for _ in range(2)]
    # copies that differ in one rare gram at the end only, so their paths agree
    texts = [b + f" {i:05d}" for b in base for i in range(40)]
    block, trees = trees_of(texts)
    found = {tuple(p) for t in trees for part in t.pairs() for p in part.tolist()}
    want = {(a, b) for k in (0, 40) for a in range(k, k + 40) for b in range(a + 1, k + 40)}
    assert want <= found
    per_gram = np.unique(block.gram, return_counts=True)[1]
    every_pair = int((per_gram * (per_gram - 1) // 2).sum()) * trees[0].width
    assert 0 < sum(t.visits for t in trees) < every_pair / 2


def test_a_subtree_without_enough_left_is_not_entered():
    """One shared rare gram at the end of both prefixes leaves nothing to differ."""
    texts = ["".join(chr(0x4E00 + 400 * k + i) for i in range(200)) + "abcde" for k in range(20)]
    _, trees = trees_of(texts)
    assert sum(len(part) for t in trees for part in t.pairs()) == 0
    # the tree of the shared gram has 190 pairs; all are left above the words
    assert sum(t.visits for t in trees) <= 20 * 200 * 2 * trees[0].width


@pytest.mark.parametrize("hot_sent", [500_000, 3])
def test_hot_grams_are_counted_exactly_and_taken_in_passes(spark, hot_sent):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12)]
    base = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(50)]
    rows = list(enumerate(base + [edited(rng, words, t) for t in base]))
    near = NearDuplicates(spark.createDataFrame(rows, SCHEMA), cell=4, hot_sent=hot_sent, table_bits=6)
    got = [tuple(r) for r in near.record_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and got


def test_repeated_ids_long_texts_and_other_columns(spark):
    long = " ".join(str(i * 7919) for i in range(20_000))
    rows = [(1, long, 5), (2, long + " tail", 5), (2, long + " tail", 5), (None, long, 5), (3, None, 5)]
    df = spark.createDataFrame(rows, "id bigint, text string, uid int").selectExpr("*", "'x' as norm", "1 as n1", "'y' as raw")
    assert [tuple(r) for r in NearDuplicates(df).record_pairs().collect()] == [(1, 2)]


def similar(texts):
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for t in texts]
    return {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("dense,size", [(2, 3), (2, 50), (30, 7)])
def test_tiles_lose_no_pair(monkeypatch, dense, size):
    """Copies with edits, of sizes on both sides of the bands, compared in tiles with classes of a few paths."""
    from millrace.llm import neardup

    monkeypatch.setattr(neardup, "CLASS", size)
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 8, 20, 30, 44, 46, 60, 90, 95) for _ in range(6)]
    # some longer by a fifth, as far as sizes may be apart
    texts = list(dict.fromkeys(base + [edited(rng, words, t) for t in base * 2] + [t + " " + t[: len(t) // 5][::-1] for t in base]))
    block, _ = trees_of(texts)
    order, _, _ = sets_of(texts)
    found, tiled = set(), 0
    for w in block.words:
        tree = Trees(block, w, 0.8, order, dense=dense)
        found |= {tuple(p) for part in tree.pairs(50) for p in part.tolist()}
        tiled += tree.compared
    want = similar(texts)
    assert want <= found and len(want) > 50 and tiled


def test_unrelated_sets_below_a_frequent_gram_are_not_listed_in_pairs():
    """400 unrelated texts share their rarest grams; only what a first comparison leaves is listed."""
    rng = random.Random(5)
    texts = ["QZXVK " + "".join(rng.choice("abcdefghijklmnop ") for _ in range(250 + k % 40)) for k in range(400)]
    texts[7] = texts[3] + "x"
    at = np.ones(256, np.int64)
    shared, _ = gram_sets(["QZXVK "])
    at[(shared & np.uint64(255)).astype(np.int64)] = 0  # to the front of the order
    order = Order.of(at)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], names=["uid", "norm"])
    none = Sent((np.empty(0, np.uint64), np.empty(0, np.int64)))
    out = _postings(Sent(order), none, 5, 0.8, 20_000, 1, 1, 0)(iter([batch]))
    block = Postings.unpack(iter([p for b in out for p in b.column(1).to_pylist()]))
    trees = [Trees(block, w, 0.8, order) for w in block.words]
    found = {tuple(p) for t in trees for part in t.pairs() for p in part.tolist()}
    assert (3, 7) in found
    # the 79,800 pairs share two grams at least; all listed they took 278,993 visits
    assert sum(t.visits for t in trees) < 2 * 79_800
