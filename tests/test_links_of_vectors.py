"""A vector's links and its nearest ones, against brute force, in blocks of any size."""

import math

import pytest

from reportmill.operators import nearest


@pytest.mark.parametrize("block", [7, 1000])
def test_links_and_neighbours_of_each_vector(spark, block):
    rows = [(i, [math.sin(i * 7 + j * j) + 0.1 for j in range(6)]) for i in range(60)] + [(60, [0.0] * 6), (61, None)]
    rows += [(62 + i, rows[i][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    some = {i: v for i, v in rows if v and any(v)}
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
    score = {i: {j: cos(some[i], some[j]) for j in some if j != i} for i in some}
    got = nearest.cosine_links(df, "vec_id", "embedding", 0.3, block).collect()
    assert len(got) == len(rows)
    for r in got:
        near = [s for s in score.get(r.id, {}).values() if s >= 0.3]
        assert r.links == len(near) and (r.best is None if not near else abs(r.best - max(near)) < 1e-9)
        assert r.class_id == min(i for i, v in rows if v == dict(rows)[r.id])
    found = {(r.id, r.place): r.other for r in nearest.top_k_of(df, df.where("vec_id % 5 = 0"), "vec_id", "embedding", 4, block, queries=block).collect()}
    assert found == {(i, k): j for i in some if i % 5 == 0 for k, j in enumerate(sorted(score[i], key=lambda j: (-round(score[i][j], 9), j))[:4], 1)}
