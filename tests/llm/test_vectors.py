import math
import random

import numpy as np
import pytest

from fluxpanel.llm import vectors


def brute(rows, asked, k):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine[i] = [math.floor(1024 * float(x)) for x in v]
    out = []
    for q in asked:
        if q in fine:
            hits = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(hits[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,leaf,block,boxes", [(16_384, 256, 512, 10**6), (60, 8, 16, 10**6), (30, 1, 4, 0), (40, 2, 1, 10**6)])
def test_equals_brute_force(spark, monkeypatch, shard_rows, leaf, block, boxes):
    monkeypatch.setattr(vectors, "BOXES", boxes)
    monkeypatch.setattr(vectors, "LEAF", leaf)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = random.Random(8)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.gauss(0, 0.1)) for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (401, [1.0, None] * 3), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, rows[0][1]), (500, [0.5] * 3), (501, [0.25] * 3), (502, []), (510, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    asked = {i for i, _ in rows if i is not None and i % 10 == 0}
    got = vectors.top_k(df, df.where("vec_id % 10 = 0"), k=7, shard_rows=shard_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, asked, 7)


def test_few_rows_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [0.5, -0.5]), (100, [-1.0, -1.0])], "vec_id long, embedding array<float>")
    got = vectors.top_k(df, df.where("vec_id % 100 = 0"))
    assert sorted(map(tuple, got.collect())) == brute([(0, [1.0, 2.0]), (1, [0.5, -0.5]), (100, [-1.0, -1.0])], [0, 100], 10)
    assert vectors.top_k(df.limit(0), df.limit(0)).count() == 0


def test_pruning_leaves_nodes_out():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-50, 50, (4000, 4)), rng.integers(900, 1000, (300, 4))])
    tree = vectors.Tree(np.arange(len(points)), points)
    seen = []
    own = tree.bound
    tree.bound = lambda q, n: (seen.append(n), own(q, n))[1]
    rows, ids, scores = vectors.search(tree, np.array([-1]), np.array([[900, 900, 900, 900]]), np.array([vectors.LEAST]), 10)
    assert len(set(seen)) < len(tree.range)
    assert sorted(scores, reverse=True) == sorted(points @ np.full(4, 900), reverse=True)[:10]


def test_products_stay_exact():
    big = np.array([[2**40, 1]])
    assert vectors.product(big, np.array([[2**20], [1]]))[0, 0] == 2**60 + 1
    with pytest.raises(OverflowError):
        vectors.product(big, np.array([[2**40], [1]]))


def test_splits_cover_all_and_lie_apart():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-50, 50, (400, 3)), np.full((300, 3), 7)])
    made = vectors.Splits(points, 16)
    cells = made.cell(points)
    assert 2 <= made.cells <= 16 and set(cells.tolist()) <= set(range(made.cells))
    assert len(set(cells[400:].tolist())) == 1  # copies share a cell
    for wide, middle, left, right in made.nodes:
        assert (wide < 0) == (left == right == 0)
    assert vectors.Splits(points[:0], 4).cells == vectors.Splits(points[400:], 4).cells == 1


def test_shards_that_cannot_matter_are_not_asked(spark):
    near = [(i, [100.0 + i % 7, 100.0]) for i in range(0, 200)]
    far = [(1000 + i, [-100.0 - i % 5, -100.0]) for i in range(200)]
    df = spark.createDataFrame(near + far, "id long, v array<double>")
    rows = vectors.whole_numbers(df, "id", "v", 1)
    splits = vectors._splits(rows, 100)
    shards, units = vectors._units(rows, splits, 100, "t")
    boxes = vectors._boxes(shards)[2]
    assert len(boxes[0]) == sum(parts for _, parts in units.values()) >= 4
    q = np.array([[100, 100]])
    reach = vectors.product(np.maximum(q, 0), boxes[2].T) + vectors.product(np.minimum(q, 0), boxes[1].T)
    assert (reach[0] < 0).any() and (reach[0] > 0).any()
