"""Operators on embeddings against brute force."""

import numpy as np
import pytest

from domicilia.llm.embedding_dedup import EmbeddingDedup
from domicilia.llm.nearest import NearestNeighbours

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, n int, key string"


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(3)
    centre = random.normal(size=(40, 32))
    vectors = [(c + random.normal(size=32) * s).astype(np.float32).tolist() for c in centre for s in (0, 0.1, 0.3, 0.45, 0.9, 2)]
    out = [(i, v) for i, v in enumerate(vectors)]
    out += [(1000 + i, vectors[0]) for i in range(60)]
    out += [(2000, None), (2050, []), (2100, [0.0] * 32), (2150, [1.0] * 31 + [None]), (2200, [float("nan")] + [1.0] * 31)]
    out += [(2250, [float("inf")] * 32), (2300, [1.0, 2.0]), (2301, [2.0, 4.0]), (None, vectors[0]), (2350, [1e30] * 32)]
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", 1, None) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def cosines(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    return {
        a: {b: float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)) for b, y in good if b != a and len(x) == len(y)} for a, x in good
    }


def test_embedding_links(frame, rows, cosines):
    links = {a: {b for b, c in near.items() if c >= 0.9} for a, near in cosines.items()}
    label = {i: i for i, _ in rows}
    for _ in range(20):
        for a, near in links.items():
            label[a] = min([label[a], *[label[b] for b in near]])
    got = EmbeddingDedup(block=16).run(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_links == len(links.get(r.vec_id, ()))
        assert r.component_id == label[r.vec_id]
        assert r.kept == (r.vec_id is None or label[r.vec_id] == r.vec_id)


def test_nearest(frame, cosines):
    got = {}
    for r in NearestNeighbours(block=50, queries=2, share=1.0, confidence=6.0).run(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {q for q in cosines if q % 50 == 0 and cosines[q]}
    assert set(got) == want
    for q in want:
        best = sorted(cosines[q].values(), reverse=True)[:5]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, len(best) + 1))
        assert np.allclose([s for _, _, s in found], best, atol=1e-12)
        for (_, a, s), (_, b, t) in zip(found, found[1:], strict=False):
            assert s > t or a < b


def test_recall(spark):
    from domicilia.llm.tables import read

    rows = read(spark, "/root/testdata/sf0.1", "embeddings")
    local = rows.toPandas()
    matrix = np.stack(local.embedding).astype(float)
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    ids = local.vec_id.to_numpy()
    got = NearestNeighbours().run(rows).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for q in np.flatnonzero(ids % 50 == 0):
        score = matrix @ matrix[q]
        score[q] = -9
        hits.append(len(got[ids[q]] & set(ids[np.lexsort((ids, -score))[:5]])) / 5)
    assert np.mean(hits) >= 0.9


def test_empty(frame):
    assert EmbeddingDedup().run(frame.limit(0)).count() == 0
    assert NearestNeighbours().run(frame.limit(0)).count() == 0
