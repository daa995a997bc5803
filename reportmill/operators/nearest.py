"""Exact neighbours by angle, with blocks that cannot hold a partner left out.

Vectors are laid out by their nearest pivot and their angle to it, and cut into blocks; of each block the least and greatest
angle to every pivot is kept. By the triangle inequality two vectors are at least as far apart as their angles to any pivot
differ, so two blocks whose ranges lie too far apart for some pivot hold no pair, and never meet. Pivots are a bounded sample,
blocks and what a task holds are bounded, and only the ranges of blocks meet each other all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportmill.operators.shared import store

#: Pivots, vectors they are chosen from, blocks' ranges that a task compares with as many others, and what rounding may cost, in radians.
PIVOTS, SAMPLE, RANGES, SLACK = 24, 512, 1024, 1e-6
#: Vectors in a block, rows of a block whose cosines with all or, of top_k_of(), with TILE of the other are held at a time, and pairs that are counted in doubles at a time.
BLOCK, STRIP, TILE, GATHERED = 65_536, 64, 8_192, 1 << 16
#: A table of a few blocks is cut into as many parts as keep this many tasks busy, but into none smaller than this.
PARTS, SMALLEST = 12, 4_096
#: Candidates of a query, as a multiple of k, from which on top_k_of() counts them in doubles and keeps the k best.
CROWD = 16


def parts_of(n: int, block: int) -> int:
    return max(1, -(-n // block), min(PARTS, n // SMALLEST))


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, u): vectors of length one, in doubles; zero and null vectors are left out."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    # the norm stands beside the function, not in it, where it would be taken anew for each component
    return v.withColumn("n", norm).where("n > 0").select("id", F.zip_with("v", F.array_repeat("n", F.size("v")), lambda x, n: x / n).alias("u"))


def _pivots(u: DataFrame) -> np.ndarray:
    """Up to PIVOTS vectors far from each other, of a sample by hash: each the one farthest from those before it."""
    some = np.array([r.u for r in u.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    if not len(some):
        return some.reshape(0, 0)
    chosen, near = [0], some @ some[0]
    while len(chosen) < min(PIVOTS, len(some)):
        far = int(np.argmin(near))
        chosen.append(far)
        near = np.maximum(near, some @ some[far])
    order, rest = [0], set(range(1, len(chosen)))
    like = some[chosen] @ some[chosen].T
    while rest:  # each beside the one most like it, as blocks may hold vectors of neighbouring pivots
        order.append(max(rest, key=lambda k: (like[order[-1], k], -k)))
        rest.remove(order[-1])
    return some[chosen][order]


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


class Blocks:
    """Vectors in blocks: rows are (g, id, u), ranges (g, low, high) with an entry for each pivot."""

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str, block: int) -> None:
        u = unit_vectors(vectors.repartition(id_col), id_col, vector_col)
        pivots, n = _pivots(u), parts_of(vectors.count(), block)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    a = _angles(np.array(b.column(1).to_pylist()), pivots)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a.argmin(1).astype(np.int32)), pa.array(a.min(1)), pa.array(a.tolist(), pa.list_(pa.float64()))], ["id", "u", "p", "a", "angles"])
        kind = u.schema["id"].dataType.simpleString()
        placed = u.mapInArrow(place, f"id {kind}, u array<double>, p int, a double, angles array<double>")
        dealt = store(placed.repartitionByRange(n, "p", "a", "id").withColumn("g", F.spark_partition_id()))
        ends = [f(F.col("angles")[k]) for f in (F.min, F.max) for k in range(len(pivots))]
        grouped = dealt.groupBy("g").agg(F.array(*ends).alias("ends")) if len(pivots) else dealt.groupBy("g").agg(F.array().cast("array<double>").alias("ends"))
        self.rows, self.ranges, self.kind, self.n = dealt.select("g", "id", "u"), grouped, kind, n

    def near(self, reach: DataFrame) -> DataFrame:
        """(i, j) with i <= j: blocks of which one reaches the other, by (g, reach), the angle that each block looks for partners in."""
        n = max(1, -(-self.n // RANGES))
        rows = self.ranges.join(reach, "g").withColumn("s", F.pmod(F.xxhash64("g"), F.lit(n)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        rows = rows.select(F.least("s", "o").alias("x"), F.greatest("s", "o").alias("y"), "s", "g", "ends", "reach")

        def compare(t: pa.Table) -> pa.Table:
            s, g, reach_ = (t.column(c).to_numpy() for c in ("s", "g", "reach"))
            ends = np.array(t.column("ends").to_pylist(), np.float64).reshape(len(g), 2, -1)
            a, b = np.flatnonzero(s == s.min()), np.flatnonzero(s == s.max())
            gap = np.zeros((len(a), len(b)))
            for k in range(ends.shape[2]):
                low, high = ends[:, 0, k], ends[:, 1, k]
                gap = np.maximum(gap, np.maximum(low[a][:, None] - high[b][None, :], low[b][None, :] - high[a][:, None]))
            i, j = np.nonzero(gap <= np.maximum(reach_[a][:, None], reach_[b][None, :]) + SLACK)
            i, j = g[a[i]], g[b[j]]
            i, j = np.minimum(i, j), np.maximum(i, j)
            return pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32())})
        return rows.groupBy("x", "y").applyInArrow(compare, "i int, j int").distinct()

    def met(self, near: DataFrame) -> DataFrame:
        """(i, j, g, id, u): the vectors of both blocks of every pair."""
        sides = near.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("g"))
        return sides.join(self.rows, "g")


def blocks_met(vectors: DataFrame, id_col: str, vector_col: str, least: float, block: int = 512) -> DataFrame:
    """(blocks, pairs, met): how many blocks there are, how many pairs of them, and how many of these meet at a least cosine."""
    b = Blocks(vectors, id_col, vector_col, block)
    met = b.near(b.ranges.select("g", F.lit(float(np.arccos(least))).alias("reach")))
    n = b.ranges.count()
    return met.agg(F.lit(n).alias("blocks"), F.lit(n * (n + 1) // 2).alias("pairs"), F.count(F.lit(1)).alias("met"))


def cosine_pairs(vectors: DataFrame, id_col: str, vector_col: str, least: float = 0.3, block: int = BLOCK) -> DataFrame:
    """(id1, id2, score): all pairs at least, exactly; each pair of blocks that can hold one is a matrix product in a task of its own.

    A task has two blocks and some rows' products in single precision in hand; what these leave in reach is counted in doubles."""
    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pairs_of(pa.Table.from_batches(list(batches)).sort_by("g"), least)

    dealt = Blocks(vectors, id_col, vector_col, block)
    near = dealt.near(dealt.ranges.select("g", F.lit(float(np.arccos(np.clip(least, -1, 1)))).alias("reach")))
    return dealt.met(near).groupBy("i", "j").applyInArrow(product, f"id1 {dealt.kind}, id2 {dealt.kind}, score double")


def pairs_of(t: pa.Table, least: float, some: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """(id1, id2, score) of the pairs at least so close of two blocks, or of one with itself, in order of g; of some(a, b) rows only."""
    g, ids, x = t.column("g").to_numpy(), t.column("id").to_numpy(), _matrix(t)
    left, right = np.flatnonzero(g == g.min()), np.flatnonzero(g == g.max())
    same, single, y = g.min() == g.max(), x.astype(np.float32), x[right]
    other, low = single[right], np.float32(least - _margin(x))
    for at in range(0, len(left), STRIP):
        a, b = np.nonzero(single[left[at : at + STRIP]] @ other.T >= low)
        a = left[at + a]
        if same:
            a, b = a[ids[a] < ids[right[b]]], b[ids[a] < ids[right[b]]]
        if some is not None:
            keep = some(a, right[b])
            a, b = a[keep], b[keep]
        score = _cosines(x, y, a, b)
        keep = score >= least
        a, b = ids[a[keep]], ids[right[b[keep]]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(score[keep])], ["id1", "id2", "score"])


def _matrix(t: pa.Table) -> np.ndarray:
    return t.column("u").combine_chunks().flatten().to_numpy().reshape(len(t), -1)


def _margin(x: np.ndarray) -> float:
    """More than a product of two vectors of length one, made in single precision, may be off."""
    return (x.shape[1] + 8) * 2.0**-23


def _cosines(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of the rows a of x with the rows b of y, some at a time."""
    cut = [slice(k, k + GATHERED) for k in range(0, len(a), GATHERED)]
    return np.concatenate([np.einsum("ij,ij->i", x[a[k]], y[b[k]]) for k in cut]) if cut else np.zeros(0)


def cosine_links(vectors: DataFrame, id_col: str, vector_col: str, least: float = 0.3, block: int = BLOCK) -> DataFrame:
    """(id, class_id, links, best): one row a vector with the smallest id of those equal to it, the number of others at least so
    close, exactly, and the highest cosine among them. Zero and null vectors have no links.

    Blocks are large, since every two that meet travel together; a task hands on a row a vector, not a row a pair."""
    def count(t: pa.Table) -> pa.Table:
        t = t.sort_by("g")
        g, ids, x = t.column("g").to_numpy(), t.column("id").to_numpy(), _matrix(t)
        left, right = np.flatnonzero(g == g.min()), np.flatnonzero(g == g.max())
        n, best, same = np.zeros(len(g), np.int64), np.full(len(g), -np.inf), g.min() == g.max()
        for at in range(0, len(left), STRIP):
            rows = left[at : at + STRIP]
            s = x[rows] @ x[right].T
            if same:
                s[np.arange(len(rows)), rows] = -np.inf
            near = s >= least
            n[rows] += near.sum(1)
            best[rows] = np.maximum(best[rows], s.max(1))
            if not same:
                n[right] += near.sum(0)
                best[right] = np.maximum(best[right], s.max(0))
        some = np.flatnonzero(n)
        return pa.table({"id": ids[some], "links": n[some], "best": best[some]})

    dealt = Blocks(vectors, id_col, vector_col, block)
    near = dealt.near(dealt.ranges.select("g", F.lit(float(np.arccos(np.clip(least, -1, 1)))).alias("reach")))
    links = dealt.met(near).groupBy("i", "j").applyInArrow(count, f"id {dealt.kind}, links long, best double").groupBy("id").agg(F.sum("links").alias("links"), F.max("best").alias("best"))
    every = vectors.select(F.col(id_col).alias("id"), F.sha2(F.to_json(F.struct(F.col(vector_col).alias("v"))), 256).alias("h"))
    of = every.join(every.groupBy("h").agg(F.min("id").alias("class_id")), "h").drop("h")
    return of.join(links, "id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "best")


def top_k_of(vectors: DataFrame, asked: DataFrame, id_col: str, vector_col: str, k: int = 10, block: int = BLOCK, queries: int = BLOCK) -> DataFrame:
    """(id, other, score, place): the k nearest others, by cosine, then by id, of the vectors asked, among all vectors.

    Queries and vectors are dealt into parts; two parts meet in a task, which hands on the k best a query. Parts are large,
    since a vector travels as often as there are parts of queries."""
    nv, nq = parts_of(vectors.count(), block), parts_of(asked.count(), queries)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    u, q = (unit_vectors(x.repartition(id_col), id_col, vector_col) for x in (vectors, asked))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = u.select(every(nq).alias("i"), deal(nv).alias("j"), F.lit(False).alias("asks"), "id", "u").union(q.select(deal(nq).alias("i"), every(nv).alias("j"), F.lit(True).alias("asks"), "id", "u"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("id")
        asks, ids, x = t.column("asks").to_numpy(), t.column("id").to_numpy(), _matrix(t)
        rows, others = np.flatnonzero(asks), np.flatnonzero(~asks)
        x, y, rows, others = x[rows], x[others], ids[rows], ids[others]
        for at in range(0, len(rows) if len(others) else 0, STRIP):
            a, b, score = _nearest(x[at : at + STRIP], y, rows[at : at + STRIP], others, k)
            yield pa.RecordBatch.from_arrays([pa.array(rows[at + a]), pa.array(others[b]), pa.array(score)], ["id", "other", "score"])
    kind = u.schema["id"].dataType.simpleString()
    met = both.groupBy("i", "j").applyInArrow(best, f"id {kind}, other {kind}, score double")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "other"))
    return met.withColumn("place", place).where(F.col("place") <= k)


def _nearest(x: np.ndarray, y: np.ndarray, rows: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine) of the k best rows b of y for each row a of x, those of an equal id left out; others, the ids of y, rise.

    Products are made in single precision, tile by tile; a row that may be among the k best by them is counted in doubles."""
    slack, single = np.float32(2 * _margin(x)), x.astype(np.float32)
    first, last = (np.searchsorted(others, rows, side) for side in ("left", "right"))
    own = np.repeat(np.arange(len(rows)), last - first), np.concatenate([np.arange(p, q) for p, q in zip(first, last)])
    a, b, s = np.zeros(0, np.intp), np.zeros(0, np.intp), np.zeros(0, np.float32)
    low = np.full(len(rows), -np.inf, np.float32)
    for at in range(0, len(y), TILE):
        p = single @ y[at : at + TILE].astype(np.float32).T
        here = (own[1] >= at) & (own[1] < at + TILE)
        p[own[0][here], own[1][here] - at] = -np.inf
        if not at and p.shape[1] > k:
            low = np.partition(p, -k, 1)[:, -k] - slack
        u, v = np.nonzero((p >= low[:, None]) & (p > -np.inf))
        a, b, s = np.concatenate([a, u]), np.concatenate([b, v + at]), np.concatenate([s, p[u, v]])
        crowded = np.bincount(a, minlength=len(rows)) > CROWD * k
        if crowded.any():
            some = crowded[a]
            u, v, _ = _first(a[some], b[some], _cosines(x, y, a[some], b[some]), k)
            a, b, s = (np.concatenate([w[~some], z]) for w, z in ((a, u), (b, v), (s, np.einsum("ij,ij->i", x[u], y[v]).astype(np.float32))))
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        kth = np.searchsorted(a, np.arange(len(rows))) + k - 1
        full = np.flatnonzero(np.bincount(a, minlength=len(rows)) >= k)
        low[full] = np.maximum(low[full], s[kth[full]] - slack)
        keep = s >= low[a]
        a, b, s = a[keep], b[keep], s[keep]
    return _first(a, b, _cosines(x, y, a, b), k)


def _first(a: np.ndarray, b: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every a the k best by the score, rounded to nine digits, then by b."""
    order = np.lexsort((b, -np.round(score, 9), a))
    a, b, score = a[order], b[order], score[order]
    some = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[some], b[some], score[some]


def top_k_each(vectors: DataFrame, id_col: str, vector_col: str, k: int = 10, block: int = 512) -> DataFrame:
    """The k nearest others of every vector, by cosine, then by id, in two passes.

    In the first each block meets itself alone: the angle to a vector's k-th best there bounds how far away its k best can be.
    In the second a block meets the blocks inside the widest of its bounds. A pair of blocks hands on the k best a vector only.
    """
    def ranked(t: pa.Table) -> tuple[np.ndarray, list[tuple]]:
        t = t.sort_by("id")
        g, ids, x = t.column("g").to_numpy(), t.column("id").to_numpy(), np.array(t.column("u").to_pylist())
        left, right = np.flatnonzero(g == g.min()), np.flatnonzero(g == g.max())
        out, last = [], np.full(len(ids), -1.0)
        for rows, others in ((left, right),) if g.min() == g.max() else ((left, right), (right, left)):
            s = x[rows] @ x[others].T
            s[ids[rows][:, None] == ids[others]] = -np.inf
            order = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]
            if order.shape[1] == k:
                last[rows] = np.take_along_axis(s, order[:, -1:], 1)[:, 0]
            out += [(int(ids[rows[a]]), int(ids[others[b]]), float(s[a, b])) for a in range(len(rows)) for b in order[a] if s[a, b] > -np.inf]
        return last, out

    def bound(t: pa.Table) -> pa.Table:
        last, _ = ranked(t)
        return pa.table({"g": pa.array([t.column("g")[0].as_py()], pa.int32()), "reach": pa.array([float(np.arccos(np.clip(last.min() - 1e-8, -1, 1)))])})

    def best(t: pa.Table) -> pa.Table:
        out = ranked(t)[1]
        return pa.table({"id": pa.array([o[0] for o in out], pa.int64()), "other": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    dealt = Blocks(vectors, id_col, vector_col, block)
    reach = store(dealt.rows.groupBy("g").applyInArrow(bound, "g int, reach double"))
    both = dealt.met(dealt.near(reach)).groupBy("i", "j").applyInArrow(best, "id long, other long, score double")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "other"))
    return both.withColumn("place", place).where(F.col("place") <= k)
