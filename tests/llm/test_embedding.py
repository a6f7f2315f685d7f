import numpy as np
import pytest

from sqltide.llm import embedding


@pytest.mark.parametrize("rows, least", [(5_000, 0.99), (100_000, 0.97), (1_000_000, 0.94),
                                         (10_000_000, 0.95), (100_000_000, 0.97)])
def test_pairs_at_the_threshold_share_a_filter(rows, least):
    codewords, lists = embedding.code_size(rows)
    rng = np.random.default_rng(8)
    x = embedding.unit(rng.standard_normal((1000, 64)))
    away = rng.standard_normal((1000, 64))
    away = embedding.unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93 ** 2) * away
    one, two = (embedding.decode(v, codewords, lists) for v in (x, y))
    assert one.shape == two.shape == (1000, lists)
    assert (one[:, :, None] == two[:, None, :]).any(axis=(1, 2)).mean() >= least


def test_filters_are_the_nearest_directions():
    rng = np.random.default_rng(2)
    x = embedding.unit(rng.standard_normal((50, 10)))
    parts = embedding.code(10, 5)
    grid = np.stack(np.meshgrid(*[np.arange(5)] * 4, indexing="ij"), -1).reshape(-1, 4)
    scores = x @ sum(parts[k][grid[:, k]] for k in range(4)).T
    found = embedding.decode(x, 5, 16)
    for k in range(50):
        assert np.allclose(np.sort(scores[k][found[k]]), np.sort(scores[k])[-16:])


def test_floats_and_doubles_of_one_length_meet(spark):
    rows = [(1, [1.0] * 8, 0), (2, [1.0] * 7 + [1.1], 0), (3, [0.5] * 8, 0), (4, [1.0] * 4, 0),
            (5, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.id: (r.n_links, r.component) for r in embedding.near_duplicates(table).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_hot_bucket_is_split(spark):
    rng = np.random.default_rng(6)
    x = np.ones(16) + 0.01 * rng.standard_normal((700, 16))
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = embedding.near_duplicates(table, block=100).collect()
    assert {(r.n_links, r.component) for r in found} == {(699, 0)} and len(found) == 700
