"""Embedding near-duplicates by a forest of random-projection trees.

A tree splits space again and again by a random direction, at the median of a sample; a vector near the cut goes down both
sides (spill), so that a linked pair is rarely parted, and over TREES trees practically never. The first trees are grown from
a bounded sample and broadcast. A leaf that more than FULL vectors reach is split again by a tree grown from a bounded sample
of its own, in a task, and so on, until no leaf is larger or a tree finds no cut in it, as in a large group of near-copies; so
the work grows with the table, not with its square. All vectors of a leaf are compared in double precision, and links are
verified, counted and joined up.

Equal vectors are one entry with a weight. A pair that meets in several leaves counts in the first of them only, which its
two lists of leaves tell, so counts are exact without gathering pairs. A leaf that holds more than BLOCK vectors is cut into
blocks by hash, and its pairs of blocks are tasks of their own. Out of a leaf come one count a vector and links that span
its groups, never all pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportmill.operators.graph import connected_components
from reportmill.operators.shared import cut

COSINE = 0.95
TREES = 8
#: Vectors that a tree is grown from, about.
SAMPLE = 20_000
LEAF = 200
FULL = 4096
BLOCK = 1024
#: Vectors of a full leaf that one task sends down its tree.
GROUP = 50_000
ROUNDS = 12
#: Half-width of the spill, as a share of the largest distance of a linked pair. In 64 dimensions even a pair at exactly
#: the limit parts at about one cut in forty: in one tree of ten levels it may, in all eight trees about once in 10^5.
SPILL = 0.06
#: A cut is made only if the vectors that go down both sides are at most this share more.
OVERLAP = 1.35


class Tree:
    """Nodes in arrays; children of node i are left[i] and right[i], -1 at a leaf."""

    def __init__(self, sample: np.ndarray, spill: float, leaf: int, draw: np.random.Generator) -> None:
        self.direction, self.at, self.left, self.right, self.spill = [], [], [], [], spill
        self.depth = 0
        self._grow(sample, leaf, draw, 0)
        self.direction = np.array(self.direction, np.float32).reshape(len(self.at), -1)

    def _grow(self, x: np.ndarray, leaf: int, draw: np.random.Generator, depth: int) -> int:
        me, self.depth = len(self.at), max(self.depth, depth)
        self.direction.append(np.zeros(x.shape[1]))
        self.at.append(0.0)
        self.left.append(-1)
        self.right.append(-1)
        if len(x) <= leaf or depth > 24:
            return me
        best = None
        for _ in range(4):  # of a few random directions, the one that spreads the sample most
            a, b = x[draw.integers(len(x))], x[draw.integers(len(x))]
            d = draw.normal(size=x.shape[1]) / np.sqrt(x.shape[1]) + (a - b)
            d /= np.linalg.norm(d) or 1.0
            p = x @ d
            if best is None or p.std() > best[1].std():
                best = d, p
        d, p = best
        cut_at = float(np.median(p))
        low, high = x[p < cut_at + self.spill], x[p >= cut_at - self.spill]
        if len(low) + len(high) > OVERLAP * len(x):  # near-copies that no cut parts would only be doubled
            return me
        self.direction[me], self.at[me] = d, cut_at
        self.left[me] = self._grow(low, leaf, draw, depth + 1)
        self.right[me] = self._grow(high, leaf, draw, depth + 1)
        return me

    def leaves(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows of x that reach it)."""
        out, open_ = [], [(0, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            if not len(rows):
                continue
            if self.left[node] < 0:
                out.append((node, rows))
                continue
            p = x[rows] @ self.direction[node] - self.at[node]
            open_ += [(self.left[node], rows[p < self.spill]), (self.right[node], rows[p >= -self.spill])]
        return out


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, str]:
    """(vec_id, raw) rows, (key, raw, weight, low) distinct vectors and numpy's name of their components' type.

    raw is the vector's bytes as the table has it, in single precision where it does; null where nothing links.
    """
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for v in b.column(1).to_pylist():
                x = np.array(v, kind) if v and None not in v else np.zeros(1, kind)
                raw.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    found = cut(rows.mapInArrow(run, "vec_id long, raw binary"))
    distinct = found.where("raw is not null").groupBy("raw").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low"))
    return found, cut(distinct.withColumn("key", F.monotonically_increasing_id())), kind


def _share(share: F.Column | float, *salt: str) -> F.Column:
    """Rows by a hash, about so many of all."""
    return F.pmod(F.xxhash64("key", *map(F.lit, salt)), F.lit(1 << 30)) < share * float(1 << 30)


def _spill(cosine: float) -> float:
    return SPILL * float(np.sqrt(2 - 2 * cosine))


def grow(distinct: DataFrame, kind: str, cosine: float = COSINE) -> list[dict[int, Tree]]:
    """The first trees, for each length of vectors that occurs in a sample of about SAMPLE distinct vectors."""
    some = distinct.where(_share(F.lit(min(1.0, SAMPLE / max(1, distinct.count()))))).select("raw").toPandas().raw
    by_length: dict[int, list] = {}
    for u in some:
        by_length.setdefault(len(u), []).append(u)
    return [{size: Tree(units(x, kind), _spill(cosine), LEAF, np.random.default_rng([t, size])) for size, x in by_length.items()} for t in range(TREES)]


def _drop(distinct: DataFrame, forest: list[dict[int, Tree]], kind: str) -> DataFrame:
    """(key, leaf): a row for each leaf of the first trees that a vector reaches. A leaf's name: length, tree, node."""
    held = distinct.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = []
            for size in {len(u) for u in raw}:
                mine = np.array([k for k, u in enumerate(raw) if len(u) == size])
                x = units([raw[k] for k in mine], kind)
                for t, trees in enumerate(held.value):
                    for leaf, rows in trees[size].leaves(x) if size in trees else [(0, np.arange(len(x)))]:
                        out += [(keys[k], f"{size}/{t}/{leaf}") for k in mine[rows]]
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 20_000]), (pa.int64(), pa.string()))], ["key", "leaf"])

    return distinct.select("key", "raw").mapInArrow(run, "key long, leaf string")


def _resplit(placed: DataFrame, distinct: DataFrame, full: DataFrame, kind: str, spill: float, leaf_size: int, turn: int) -> DataFrame:
    """(key, leaf): members of the full leaves (leaf, n), each sent down a tree grown from a sample of its leaf."""
    def sub_tree(table: pa.Table) -> pa.Table:
        name = table.column("leaf")[0].as_py()
        tree = Tree(units(table.column("raw").to_pylist(), kind), spill, leaf_size, np.random.default_rng([turn, *name.encode()]))
        return pa.table({"leaf": pa.array([name]), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "leaf": pa.array([], pa.string())})
        name, keys, tree = left.column("leaf")[0].as_py(), left.column("key").to_numpy(), pickle.loads(right.column("tree")[0].as_py())
        found = [(keys[rows], f"{name}/{leaf}") for leaf, rows in tree.leaves(units(left.column("raw").to_pylist(), kind))]
        return pa.table({"key": pa.array(np.concatenate([k for k, _ in found])), "leaf": pa.array([n for k, n in found for _ in k])})

    members = cut(placed.join(full, "leaf").join(distinct.select("key", "raw"), "key").select("key", "leaf", "raw", "n"))
    sampled = members.where(_share(F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n")), "leaf", str(turn)))
    trees = sampled.select("leaf", "raw").groupBy("leaf").applyInArrow(sub_tree, "leaf string, tree binary")
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    salted = members.select("key", "leaf", "raw", F.pmod(F.xxhash64("key"), parts).cast("int").alias("salt"))
    copies = cut(trees.join(full, "leaf").select("leaf", "tree", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")))
    return salted.groupBy("leaf", "salt").cogroup(copies.groupBy("leaf", "salt")).applyInArrow(send, "key long, leaf string")


def leaves(distinct: DataFrame, kind: str, cosine: float = COSINE) -> DataFrame:
    """(key, leaf): the leaves that every vector reaches in the end."""
    placed, done = cut(_drop(distinct, grow(distinct, kind, cosine), kind)), None
    for turn in range(ROUNDS):
        sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        full = cut(sizes.where(F.col("n") > FULL))
        if full.isEmpty():
            break
        small = placed.join(full, "leaf", "left_anti").select("key", "leaf")
        parts = cut(_resplit(placed, distinct, full, kind, _spill(cosine), LEAF, turn))
        whole = F.col("leaf").endswith("/0")  # the root itself: the tree has found no cut, and its members stay together
        stay = small.union(parts.where(whole).select("key", "leaf"))
        done = stay if done is None else done.union(stay)
        placed = parts.where(~whole)
    return placed if done is None else cut(done.union(placed))


def _first_shared(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    b = set(b)
    return next(x for x in a if x in b)


def _compare(table: pa.Table, cosine: float, kind: str) -> pa.Table:
    """Links among the vectors of one block, or between the two blocks of a pair, that meet in this leaf first."""
    leaf = table.column("leaf")[0].as_py()
    side = np.array(table.column("side").to_pylist())
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    x = units(table.column("raw").to_pylist(), kind)
    keys, weights = table.column("key").to_numpy(), table.column("weight").to_numpy()
    at = table.column("at").to_pylist()
    a, b = np.nonzero(x[left] @ x[right].T >= cosine)
    a, b = left[a], right[b]
    once = a < b if side.min() == side.max() else np.ones(len(a), bool)
    a, b = a[once], b[once]
    number: dict[tuple, int] = {}
    of = np.array([number.setdefault(tuple(v), len(number)) for v in at])
    lists = list(number)
    pair, back = np.unique(of[a] * len(lists) + of[b], return_inverse=True)
    first = np.array([_first_shared(lists[p // len(lists)], lists[p % len(lists)]) == leaf for p in pair.tolist()], bool)[back]
    counts = np.bincount(a[first], weights[b[first]], len(keys)) + np.bincount(b[first], weights[a[first]], len(keys))
    root = np.arange(len(keys))
    while len(a):  # minima along the links, until they stand
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    keep = (counts > 0) | (root != np.arange(len(keys)))
    return pa.table({"key": pa.array(keys[keep]), "n": pa.array(counts[keep].astype(np.int64)), "to": pa.array(keys[root[keep]])})


def compare(distinct: DataFrame, placed: DataFrame, kind: str, cosine: float = COSINE, block: int | None = None) -> DataFrame:
    """(key, n, to): links counted, and a spanning link, for every leaf a vector has any in."""
    block, placed = block or BLOCK, placed.select("key", F.xxhash64("leaf").alias("leaf"))
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("leaf", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = placed.join(sizes, "leaf")
    at = met.groupBy("key").agg(F.sort_array(F.collect_list("leaf")).alias("at"))  # as many as trees and spill make
    members = met.join(distinct.select("key", "raw", "weight").join(at, "key"), "key").withColumn("side", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = pairs.select("leaf", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "key", "raw", "weight", "at")
    return tasks.groupBy("leaf", "i", "j").applyInArrow(lambda t: _compare(t, cosine, kind), "key long, n long, to long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of vectors.

    Rows of at least that cosine are linked, equal vectors among them. A vector that is null, empty, zero, or has a null or
    non-finite component links with nothing and is its own component. Vectors of different lengths never link. Repeated ids
    link like others; a null id names a component only if it has no other. Other columns are left out.
    """
    rows, distinct, kind = distinct_vectors(vectors, id_col, vector_col)
    found = cut(compare(distinct, leaves(distinct, kind, cosine), kind, cosine))
    parts = connected_components(found, "key", "to")
    counts = found.groupBy("key").agg(F.sum("n").alias("n")).withColumnRenamed("key", "c_key")
    low = parts.join(distinct, parts.node == distinct.key).groupBy("component").agg(F.min("low").alias("reached"))
    named = parts.join(low, "component").select(F.col("node").alias("p_key"), "reached")
    info = distinct.join(counts, F.col("key") == F.col("c_key"), "left").join(named, F.col("key") == F.col("p_key"), "left")
    info = info.select(F.col("raw").alias("u"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("reached", "low").alias("reached"))
    out = rows.join(info, F.col("raw") == F.col("u"), "left")
    component = F.when(F.col("u").isNull(), F.col("vec_id")).otherwise(F.col("reached"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS vec_id, CAST((SELECT count(*) FROM l WHERE l.a = r.a) AS BIGINT) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM r GROUP BY r.a
"""
