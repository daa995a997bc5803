"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints at a Hamming distance of at most two differ in at most two of
them, so the tally of positional bytes they share is at least MATCHES = 6: the guaranteed minimum. A posting list of a single
positional byte would hold 1/256 of the corpus, so a list's key is four positional bytes: the positions are four pairs, of
which two at most can differ, and each of the six choices of two pairs is a list that a fingerprint stands in. In a list the
shared bytes of every pair of its members are tallied, pairs that reach the minimum are retained, and their Hamming distance
is verified.

A list of more than LONG members, as a large group of near-copies makes, is replaced by lists whose key takes in two more
positional bytes, all six choices of them: there the key alone is the minimum tally, and a list has 65,536 members at most,
whatever the corpus, so that its links are found from the 16 open bits without pairing members.

Equal fingerprints are one class from the start, so a large group of copies is one entry of the index. Links are joined up
inside a list at once and leave it as a star, at most one row for each entry, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.llm.common import map_batches, raw
from reportmill.operators.graph import connected_components
from reportmill.operators.shared import cut

SHINGLE = 3
SEED = 42
CHUNK = 65_536
BITS, MATCHES = 2, 6
LONG = 2048
#: A class of at least 1/HOT of all documents is labelled by broadcast; there are HOT such classes at most.
HOT = 1000
#: The four positions that a list's key leaves open, for each of the six lists of a fingerprint.
OPEN = [tuple(2 * p + k for p in pairs for k in (0, 1)) for pairs in combinations(range(4), 2)]
#: The two positions that the key of a longer one leaves open.
LEFT_OUT = list(combinations(range(8), 2))
#: Changes of at most two of the 16 bits that such a list leaves open.
FLIPS = np.array([1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)], np.int64)


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 without a word."""
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + size - 1] if n > 1 else words
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)))) if n > 1 else [b" ".join(part)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of docs; a null or empty text has fingerprint 0."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t.lower().split() if t else []) for t in raw(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "id long, fp long")


def tallies(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many positional bytes each of one shares with each of the other."""
    a, b = (x.astype(np.uint64).view(np.uint8).reshape(-1, 8) for x in (one, other))
    return sum((a[:, p, None] == b[None, :, p]).astype(np.uint8) for p in range(8))


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n members the lowest that links a - b lead to."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _short_list(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links inside a list of distinct fingerprints, as (fingerprint, first of its group in this list)."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(fps), 256):
        a, b = np.nonzero(np.triu(tallies(fps[at : at + 256], fps[at:]) >= MATCHES, 1))
        near = np.bitwise_count((fps[at + a] ^ fps[at + b]).astype(np.uint64)) <= BITS
        found.append((at + a[near], at + b[near]))
    root = _joined(*(np.concatenate(x) for x in zip(*found)), len(fps))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return list(zip(fps[moved].tolist(), fps[root[moved]].tolist()))


def _full_list(fps: np.ndarray, left: tuple[int, int]) -> list[tuple[int, int]]:
    """The same for a list whose members share all but the two positions of left."""
    if len(fps) == 2:
        pair = [(int(fps[1]), int(fps[0]))]
        return pair if int(np.bitwise_count(np.uint64(fps[0]) ^ np.uint64(fps[1]))) <= BITS else []
    open_bytes = fps.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, list(left)].astype(np.int64)
    at = open_bytes[:, 0] << 8 | open_bytes[:, 1]  # what is not shared: 16 bits
    label = np.full(65_536, 65_536, np.int64)
    label[at] = at
    while True:
        low = label[at]
        for flips in FLIPS:  # an absent neighbour has the label 65,536 and never wins
            np.minimum(low, label[at ^ flips], out=low)
        low = np.minimum(low, label[low])
        if (low == label[at]).all():
            break
        label[at] = low
    of = np.zeros(65_536, np.int64)
    of[at] = fps.astype(np.int64)
    moved = label[at] != at
    return list(zip(fps[moved].tolist(), of[label[at][moved]].tolist()))


def _scan_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, key, fp), sorted; a list at the end of a batch is carried into the next one."""
    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def links(which: np.ndarray, key: np.ndarray, fp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        out = [e for s, t in zip(starts, ends) if t - s > 1 for e in (_short_list(fp[s:t]) if which[s] < 0 else _full_list(fp[s:t], LEFT_OUT[which[s]]))]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"]) if out else None

    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        if not len(cols[0]):
            continue
        new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
        starts = np.concatenate([[0], new])
        held = tuple(c[starts[-1] :] for c in cols)
        if len(new) and (out := links(*cols, starts[:-1], starts[1:])) is not None:
            yield out
    if held is not None and (out := links(*held, np.array([0]), np.array([len(held[0])]))) is not None:
        yield out


def _postings(fps: DataFrame, open_positions: list[tuple[int, ...]], names: list[int]) -> DataFrame:
    """(list, key, fp): for each choice of open positions, its name and the fingerprint's other bytes."""
    masks = [~sum(0xFF << 8 * p for p in at) & 0xFFFFFFFFFFFFFFFF for at in open_positions]
    keys = [F.struct(F.lit(n).alias("list"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for n, m in zip(names, masks)]
    return fps.select("fp", F.inline(F.array(*keys))).select("list", "key", "fp")


def fingerprint_links(fps: DataFrame, fp_col: str = "fp", long: int = LONG) -> DataFrame:
    """(a, b) links that join up all distinct fingerprints within two bits: of a linked group, a spanning set."""
    distinct = cut(fps.select(F.col(fp_col).cast("long").alias("fp")).where("fp is not null").distinct())
    lists = _postings(distinct, OPEN, [-1 - i for i in range(len(OPEN))])
    sizes = lists.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(lists.join(sizes, ["list", "key"]))
    members = met.where(F.col("n") > long).select("fp").distinct()
    every = met.where(F.col("n") <= long).select("list", "key", "fp").union(_postings(members, LEFT_OUT, list(range(len(LEFT_OUT)))))
    return every.repartition("list", "key").sortWithinPartitions("list", "key", "fp").mapInArrow(_scan_lists, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs.

    Texts whose fingerprints differ in at most two bits are linked; component_id is the smallest id that links reach.
    A null text counts as empty; documents without a word have fingerprint zero and are linked like any other. Repeated
    rows are kept. A null id stays null and gives no component its name, unless the component has no other.
    Other columns are left out. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    classes = fps.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    parts = connected_components(fingerprint_links(fps))
    linked = parts.join(classes, parts.node == classes.fp).select("fp", "component", "low")
    low = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    named = linked.join(low, "component").select("fp", "component_id")
    labels = cut(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"), "n"))
    hot = F.col("n") * HOT >= fps.count()
    large, small = (labels.where(c).select("fp", "component_id") for c in (hot, ~hot))
    rows = fps.join(F.broadcast(large), "fp").unionByName(fps.join(F.broadcast(large.select("fp")), "fp", "left_anti").join(small, "fp"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-copies: of each component the document with the smallest id stays.

    A document without an id stays. Rows that repeat the kept id stay as well, unless their text is a near-copy's.
    """
    drop = near_duplicates(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, docs[id_col] == drop["_drop"], "left_anti")
