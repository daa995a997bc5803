"""Every vector is a query, and every pair of vectors in reach is a row."""

import duckdb
import numpy as np
import pytest

from reportmill.operators import nearest
from reportmill.plans import catalogue


def test_no_vector_is_left_out(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(7 * i + 1, [float(x) for x in rng.normal(size=5)], 0) for i in range(90)]
    rows += [(1_000 + i, rows[i][1], 1) for i in range(8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name, n in (("top_k_per_item", 98 * 5), ("cosine_pairs", None)):
        df = catalogue.queries()[name](spark, str(tmp_path))
        got, want = df.collect(), con.sql(catalogue.oracle_sql()[name])
        assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall())
        assert n in (None, len(got))


@pytest.mark.parametrize(("tile", "crowd"), [(7, 1), (50, 16), (1_000, 1)])
def test_single_precision_loses_no_neighbour(spark, monkeypatch, tile, crowd):
    """Many copies and near copies, which single precision cannot tell apart."""
    monkeypatch.setattr(nearest, "TILE", tile)
    monkeypatch.setattr(nearest, "CROWD", crowd)
    monkeypatch.setattr(nearest, "GATHERED", 10)
    rng = np.random.default_rng(3)
    base = rng.normal(size=6)
    x = np.concatenate([np.repeat(base[None], 30, 0), base + 1e-8 * rng.normal(size=(60, 6)), rng.normal(size=(30, 6))])
    x /= np.sqrt((x * x).sum(1))[:, None]
    ids = rng.permutation(len(x)) * 2
    order = np.argsort(ids)
    a, b, score = nearest._nearest(x, x[order], ids, ids[order], 4)
    s = np.round(np.einsum("ik,jk->ij", x, x), 9)
    want = {i: sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:4] for i in range(len(x))}
    assert {i: [int(order[j]) for j in b[a == i]] for i in range(len(x))} == want
    assert np.abs(score - s[a, order[b]]).max() < 1e-8
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    got = {(r.id1, r.id2) for r in nearest.cosine_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 0.999).collect()}
    assert got == {(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i in range(len(x)) for j in range(i) if s[i, j] >= 0.999}
