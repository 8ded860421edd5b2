"""The registered deduplication queries keep all rows and lose no link."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from millrace.operators import dedup as D
from millrace.plans import catalog

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def unit(rows):
    x = np.array([r["embedding"] for r in rows], float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def test_both_steps_give_every_document(spark):
    got = {r.id: r for r in catalog.queries()["dedup_both"](spark, DATA).collect()}
    rows = catalog.queries()["dedup_both"](spark, DATA).count()
    ids = pq.read_table(f"{DATA}/documents.parquet")["doc_id"].to_pylist()
    assert rows == len(ids) and set(got) == set(ids)
    texts = {r.id: r for r in catalog.queries()["dedup_minhash"](spark, DATA).collect()}
    assert all((r.text_keep, r.text_class_id, r.text_n_links) == (texts[i].keep, texts[i].class_id, texts[i].n_links) for i, r in got.items())
    vectors = {r["vec_id"]: r for r in pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()}
    left = sorted(i for i, r in got.items() if r.text_keep)
    assert any(i not in vectors for i in ids)
    held = [i for i in left if i in vectors]
    x, label = unit([vectors[i] for i in held]), np.array([vectors[i]["label"] for i in held])
    near = (x @ x.T >= 0.35) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    links = dict(zip(held, near.sum(1), strict=True))
    earlier = dict(zip(held, np.tril(near, -1).any(1), strict=True))
    for i, r in got.items():
        if i in left:
            assert r.vector_n_links == links.get(i, 0) and r.vector_keep == (not earlier.get(i, False)) and r.keep == r.vector_keep
        else:
            assert (r.keep, r.vector_keep, r.vector_class_id, r.vector_n_links) == (False, None, None, None)


def test_kmeans_loses_no_link(spark):
    got = {r.id: r for r in catalog.queries()["dedup_semantic_kmeans"](spark, DATA).collect()}
    rows = sorted(pq.read_table(f"{DATA}/embeddings.parquet").to_pylist(), key=lambda r: r["vec_id"])
    x = unit(rows)
    near = x @ x.T >= 0.35
    np.fill_diagonal(near, False)
    assert len(got) == len(rows) and near.any()
    for i, r in enumerate(rows):
        g = got[r["vec_id"]]
        assert (g.n_links, g.keep) == (near[i].sum(), not near[i, :i].any())


@pytest.mark.parametrize("least", [-0.5, 0.35, 0.95])
def test_pairs_across_tight_clusters(spark, least):
    """Blocks that can be ruled out, blocks of one cluster, a zero vector."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 5
    v = np.vstack([c + rng.normal(size=(40, 8)) for c in centres] + [np.zeros((1, 8))])
    df = spark.createDataFrame([(i, x.tolist(), i // 40) for i, x in enumerate(v)], "id bigint, v array<double>, cluster int")
    got = [(r.a, r.b) for r in D.cosine_pairs(df, "id", "v", least, cell=15).collect()]
    x = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
    assert sorted(got) == sorted(zip(a.tolist(), b.tolist(), strict=True))
