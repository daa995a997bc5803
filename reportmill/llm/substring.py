"""Exact substring dedup by fixed-block anchors.

A window of W words that two documents share contains, in the document with the smaller id, at least one whole block of
W/2 words at a multiple of W/2. So the non-overlapping blocks of every document are the index, and every rolling window
of W/2 words of every document probes it:

1. *Anchors.* Hashes of rolling windows, marked where they are reference blocks, meet by hash range. A hash that is a
   reference block somewhere and occurs in two documents is an anchor for all its occurrences.
2. *Extension.* Around each anchor, the W-word windows that contain it are hashed again (128 bits) and each learns the
   smallest document that has it. Runs of windows with a smaller owner are the maximal exact repeats.
3. *Removal.* The words that repeats cover go.

Hot passages: a task first settles what its own documents show. In step 1 it marks their anchors itself and passes on two
representatives a hash; in step 2 it passes on one owner a window. What meets in one place is thus the number of tasks'
blocks, not the number of copies. Pairs of documents are never formed. Hash ranges are as many as the text needs for a
range to hold about RANGE_BYTES of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.llm.common import raw
from reportmill.operators.shared import store

WINDOW = 50
BLOCK_WORDS = 1_000_000
RANGE_BYTES = 24_000_000
#: Bytes of an anchor's hash that travel, besides the bits of its range; a chance match only costs a look in step 2.
ANCHOR_BYTES = 5
NO_ID = (1 << 63) - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


class WordHashes(dict):
    """word -> 64-bit hash, with a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of all windows of an array of word hashes, in one pass."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse, self.up = base, np.uint64(pow(int(base), -1, 1 << 64)), np.ones(1, np.uint64)
        self.down = self.up

    def __call__(self, h: np.ndarray, width: int) -> np.ndarray:
        n = len(h)
        if len(self.up) < n:
            power = lambda b: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, b, np.uint64))])
            self.up, self.down = power(self.base), power(self.inverse)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[:n], dtype=np.uint64)])
        return _mix((sums[width:] - sums[:-width]) * self.down[: n - width + 1])


def _runs(sorted_equal: np.ndarray) -> np.ndarray:
    """Class numbers of a sorted array, from a mask of where a row equals the one before."""
    return np.cumsum(~sorted_equal) - 1


def _by_doc(doc: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order].astype(np.int32)
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for s, t in zip([0, *cuts], [*cuts, len(doc)]):
        if t > s:
            yield int(doc[s]), pos[s:t].tobytes()


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


#: A row is either the windows of one block in one hash range, or (range below 0) settled starts as in BUNDLE.
PACKED = pa.schema([("range", pa.int64()), ("bucket", pa.int64()), ("docs", pa.binary()), ("first", pa.binary()), ("hash", pa.binary()), ("gaps", pa.binary())])
PACKED_SQL = "range long, bucket long, docs binary, first binary, hash binary, gaps binary"


def _pack(rng: np.ndarray, at: np.ndarray, hashes: np.ndarray, first: np.ndarray, docs: np.ndarray) -> Iterator[tuple]:
    """Windows of a block by range, in the block's order: places as byte planes of their gaps, which compress to about a
    byte; hashes as they are (windows x bytes); docs: a row of numbers for each document."""
    order = np.lexsort((at, rng))
    rng, at, hashes = rng[order], at[order], hashes[order]
    doc = np.searchsorted(first, at, "right") - 1
    cuts = np.flatnonzero(np.diff(rng)) + 1
    for s, t in zip([0, *cuts], [*cuts, len(rng)]):
        if t > s:
            used = np.unique(doc[s:t])
            gaps = np.diff(at[s:t], prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
            yield int(rng[s]), None, docs[used].tobytes(), first[used].astype(np.uint32).tobytes(), hashes[s:t].tobytes(), gaps.tobytes()


def _unpack(table: pa.Table, width: int, numbers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash bytes (windows x width), documents' numbers, places in the document; of all blocks of a range."""
    out: tuple[list, list, list] = [], [], []
    for docs, first, hashes, gaps in zip(*(table.column(c).to_pylist() for c in ("docs", "first", "hash", "gaps"))):
        start = np.frombuffer(first, np.uint32).astype(np.int64)
        at = np.cumsum(np.ascontiguousarray(np.frombuffer(gaps, np.uint8).reshape(4, -1).T).view("<u4")[:, 0], dtype=np.int64)
        of = np.searchsorted(start, at, "right") - 1
        for o, x in zip(out, (np.frombuffer(hashes, np.uint8).reshape(-1, width), np.frombuffer(docs, np.int64).reshape(-1, numbers)[of], at - start[of])):
            o.append(x)
    return tuple(np.concatenate(o) for o in out)


BUNDLE = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("lengths", pa.binary()), ("starts", pa.binary())])
BUNDLE_SQL = "bucket long, docs binary, lengths binary, starts binary"


def _bundles(docs: np.ndarray, of: np.ndarray, pos: np.ndarray, bits: int) -> Iterator[tuple]:
    """Starts by document, documents by bucket of their key: a row a bucket, however many documents there are.

    docs: their numbers, the key last; of: the document of each start.
    """
    bucket = (docs[:, -1] & ((1 << bits) - 1))[of]
    order = np.lexsort((pos, of, bucket))
    of, pos, bucket = of[order], pos[order].astype(np.int32), bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for s, t in zip([0, *cuts], [*cuts, len(of)]):
        if t > s:
            ends = np.append(np.flatnonzero(np.diff(of[s:t])) + 1, t - s)
            yield int(bucket[s]), docs[of[s:t][ends - 1]].tobytes(), np.diff(ends, prepend=0).astype(np.int32).tobytes(), pos[s:t].tobytes()


def _gather(table: pa.Table, numbers: int) -> pa.Table:
    """All bundles of a bucket: a row for each document, with its starts in order."""
    parts = [[np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("docs", np.int64), ("lengths", np.int32), ("starts", np.int32))]
    docs, of = np.unique(np.concatenate(parts[0]).reshape(-1, numbers), axis=0, return_inverse=True)
    of = np.repeat(of, np.concatenate(parts[1]))
    rows = [(*map(int, docs[d]), at) for d, at in _by_doc(of, np.concatenate(parts[2]))]
    return pa.Table.from_batches([_arrow(rows, pa.schema([("id", pa.int64())] * (numbers - 1) + [("key", pa.int64()), ("at", pa.binary())]))])


def _range_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _anchor_block(hs: list[np.ndarray], keys: list[int], half: int, bits: int) -> Iterator[tuple]:
    """Rows of one block of documents."""
    lengths = np.array([len(h) for h in hs])
    first = np.cumsum(lengths) - lengths
    roll = Rolling(BASES[0])(np.concatenate(hs), half)
    doc = np.repeat(np.arange(len(hs)), lengths)[: len(roll)]
    at = np.arange(len(roll))
    inside = at - first[doc] + half <= lengths[doc]
    order = np.flatnonzero(inside)
    order = order[np.argsort(roll[inside], kind="stable")]
    roll, doc, at = roll[order], doc[order], at[order]
    pos = at - first[doc]
    ref = pos % half == 0
    same = np.concatenate([[False], roll[1:] == roll[:-1]])
    run = _runs(same)
    several, has_ref = np.zeros(run[-1] + 1, bool), np.zeros(run[-1] + 1, bool)
    several[run[1:][same[1:] & (doc[1:] != doc[:-1])]] = True
    has_ref[run[ref]] = True
    settled = (several & has_ref)[run]
    for bucket, *bundle in _bundles(np.array(keys, np.int64)[:, None], doc[settled], pos[settled], bits):
        yield -1 - bucket, bucket, *bundle, None
    first_ref = np.zeros(len(run), bool)
    where = np.flatnonzero(ref)
    first_ref[where[np.unique(run[where], return_index=True)[1]]] = True
    send = ~settled | first_ref | ~same
    low = roll[send].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ANCHOR_BYTES]
    yield from _pack(_range_of(roll[send], bits), at[send], low, first, np.array(keys, np.int64))


def _settled(table: pa.Table) -> pa.Table | None:
    names = ["bucket", "docs", "first", "hash"]
    return table.select(names).rename_columns(BUNDLE.names) if table.column("range")[0].as_py() < 0 else None


def _probe(table: pa.Table, half: int, bits: int) -> pa.Table:
    """All windows of one hash range: the hits by document."""
    if (out := _settled(table)) is not None:
        return out
    low, doc, pos = _unpack(table, ANCHOR_BYTES, 1)
    h = np.zeros((len(low), 8), np.uint8)
    h[:, :ANCHOR_BYTES] = low
    h, doc = h.view("<u8")[:, 0], doc[:, 0]
    order = np.argsort(h, kind="stable")
    h, doc, pos = h[order], doc[order], pos[order]
    same = np.concatenate([[False], h[1:] == h[:-1]])
    run = _runs(same)
    several, has_ref = np.zeros(run[-1] + 1, bool), np.zeros(run[-1] + 1, bool)
    several[run[1:][same[1:] & (doc[1:] != doc[:-1])]] = True
    has_ref[run[pos % half == 0]] = True
    hit = (several & has_ref)[run]
    docs, of = np.unique(doc[hit], return_inverse=True)
    return pa.Table.from_batches([_arrow(list(_bundles(docs[:, None], of, pos[hit], bits)), BUNDLE)])


def _owners(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (window, id), and in it a mask of the windows that a smaller id has."""
    order = np.lexsort((doc, ids, h2, h1))
    h1, h2, ids = h1[order], h2[order], ids[order]
    same = np.concatenate([[False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])])
    run = _runs(same)
    return order, ids > ids[~same][run]


def _window_block(docs: list[tuple[int, int, np.ndarray, np.ndarray]], width: int, bits: int) -> Iterator[tuple]:
    """docs: (id, key, word hashes, candidate starts). Rows of one block."""
    lengths = np.array([len(d[2]) for d in docs])
    first = np.cumsum(lengths) - lengths
    h = np.concatenate([d[2] for d in docs])
    doc = np.repeat(np.arange(len(docs)), [len(d[3]) for d in docs])
    at = np.concatenate([d[3] for d in docs]) + first[doc]
    h1, h2 = Rolling(BASES[0])(h, width)[at], Rolling(BASES[1])(_mix(h + BASES[0]), width)[at]
    who = np.array([d[:2] for d in docs], np.int64).reshape(-1, 2)
    order, covered = _owners(h1, h2, who[doc, 0], doc)
    h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
    for bucket, *bundle in _bundles(who, doc[covered], (at - first[doc])[covered], bits):
        yield -1 - bucket, bucket, *bundle, None
    both = np.stack([h1[~covered], h2[~covered]], 1)
    yield from _pack(_range_of(h1[~covered], bits), at[~covered], both, first, who)


def _own(table: pa.Table, bits: int) -> pa.Table:
    """All windows of one hash range: by document, the starts that a smaller document has."""
    if (out := _settled(table)) is not None:
        return out
    h, docs, pos = _unpack(table, 16, 2)
    h = np.ascontiguousarray(h).view(np.uint64).reshape(-1, 2)
    who, local = np.unique(docs, axis=0, return_inverse=True)
    order, covered = _owners(h[:, 0], h[:, 1], docs[:, 0], local)
    return pa.Table.from_batches([_arrow(list(_bundles(who, local[order][covered], pos[order][covered], bits)), BUNDLE)])


def _beside(made: pa.RecordBatch, b: pa.RecordBatch, at: int) -> pa.RecordBatch:
    """made, and beside it the columns of b from at on."""
    return pa.RecordBatch.from_arrays([*made.columns, *b.columns[at:]], [*made.schema.names, *b.schema.names[at:]])


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _kept_text(text: bytes, kept: np.ndarray) -> str:
    """text without the words that are not kept; runs of kept words keep their white space and are joined as it was before them."""
    out, end = [], 0
    for k, m in zip(kept, WORD.finditer(text)):
        if k:
            out.append(text[end if out else m.start() : m.end()] if end else text[m.start() : m.end()])
        end = m.end() if k else 0
        if not k and out and not out[-1].endswith((b" ", b"\n")):
            out.append(b"\n")
    return b"".join(out).rstrip().decode()


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): one row per row of docs. With texts, also kept_text, what is left of the
    text, and the columns of carry, named carry_0 and so on.

    Every word covered by a window of that many words whose sequence also starts in a document with a smaller id goes;
    windows are judged on the input. A null text has no words, and a null kept_text. A document without
    an id counts as larger than all others but 2^63 - 1, which counts as missing, and no two of them as smaller than each other. Rows that repeat an id never
    remove each other's words. Other columns are left out.
    """
    half, carry = window // 2, (id_col, *carry)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"), *(F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)))
    more = [f"carry_{i}" for i in range(len(carry))]
    typed = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, size / RANGE_BYTES)))))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hs, keys, n = WordHashes(), [], [], 0
        for b in batches:
            for key, text in zip(b.column(1).to_pylist(), raw(b.column(2))):
                if text and len(h := words.of(text.split())) >= window:
                    hs.append(h)
                    keys.append(key)
                    n += len(h)
                    if n >= BLOCK_WORDS:
                        yield _arrow(list(_anchor_block(hs, keys, half, bits)), PACKED)
                        hs, keys, n = [], [], 0
        if n:
            yield _arrow(list(_anchor_block(hs, keys, half, bits)), PACKED)

    ranges = 1 << bits
    met = rows.select("id", "key", "text").mapInArrow(anchors, PACKED_SQL).repartition(ranges, "range").groupBy("range").applyInArrow(lambda t: _probe(t, half, bits), BUNDLE_SQL)
    hits = store(met.repartition(ranges, "bucket").groupBy("bucket").applyInArrow(lambda t: _gather(t, 1), "key long, at binary").withColumnRenamed("at", "hits"))
    joined = rows.join(hits.withColumnRenamed("key", "hit_key"), F.col("key") == F.col("hit_key"), "left").select("id", "key", "text", "hits", *more)
    staged = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("text", pa.binary()), ("starts", pa.binary())])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, key, text, hits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), b.column(3).to_pylist()):
                w = text.split() if text else []
                if hits:
                    open_ = np.zeros(len(w) + 1, np.int64)  # starts of the windows that contain a hit
                    at = np.frombuffer(hits, np.int32)
                    at = at[at <= len(w) - half]  # of a text whose key is the same by chance, places may lie beyond
                    np.add.at(open_, np.maximum(at - (window - half), 0), 1)
                    np.add.at(open_, at + 1, -1)
                    starts = np.flatnonzero(np.cumsum(open_)[: len(w) - window + 1] > 0).astype(np.int32)
                    out.append((i, key, len(w), None, text, starts.tobytes()))
                else:
                    out.append((i, key, len(w), _sha(w), text if texts else None, None))
            yield _beside(_arrow(out, staged), b, 4)

    held = store(joined.mapInArrow(stage, f"id long, key long, n_words long, sha string, text binary, starts binary{typed}"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, docs, n = WordHashes(), [], 0
        for b in batches:
            for i, key, text, starts in zip(*(b.column(c).to_pylist() for c in range(4))):
                h = words.of(text.split())
                docs.append((i, key, h, np.frombuffer(starts, np.int32)))
                n += len(h)
                if n >= BLOCK_WORDS:
                    yield _arrow(list(_window_block(docs, window, bits)), PACKED)
                    docs, n = [], 0
        if n:
            yield _arrow(list(_window_block(docs, window, bits)), PACKED)

    touched = held.where("sha is null")
    owned = touched.select("id", "key", "text", "starts").mapInArrow(windows, PACKED_SQL).repartition(ranges, "range").groupBy("range").applyInArrow(lambda t: _own(t, bits), BUNDLE_SQL)
    cover = owned.repartition(ranges, "bucket").groupBy("bucket").applyInArrow(lambda t: _gather(t, 2), "id long, key long, at binary")
    last = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.string()), ("kept_text", pa.string())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, key, text, cover in zip(*(b.column(c).to_pylist() for c in range(4))):
                w = text.split()
                kept = np.ones(len(w), bool)
                if cover:
                    at = np.unique(np.frombuffer(cover, np.int32))
                    at = at[at + window <= len(w)]
                    edge = np.zeros(len(w) + 1, np.int64)
                    edge[at] += 1
                    edge[at + window] -= 1
                    kept = np.cumsum(edge)[:-1] == 0
                left = text.decode() if kept.all() else _kept_text(text, kept)
                out.append((i, len(w), int((~kept).sum()), _sha([x for x, k in zip(w, kept) if k]), left if texts else None))
            yield _beside(_arrow(out, last), b, 4)

    done = touched.select("id", "key", "text", *more).join(cover.toDF("c_id", "c_key", "cover"), (F.col("id") == F.col("c_id")) & (F.col("key") == F.col("c_key")), "left").select("id", "key", "text", "cover", *more)
    done = done.mapInArrow(remove, f"id long, n_words long, n_removed long, sha string, kept_text string{typed}")
    whole = held.where("sha is not null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha", F.col("text").cast("string").alias("kept_text"), *more)
    named = [F.col("carry_0").cast("long").alias("doc_id"), "n_words", "n_removed", F.col("sha").alias("kept_sha256")]
    return whole.union(done).select(*named, *(["kept_text", *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(more[1:]))] if texts else []))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs, each text without its repeated words; a text that loses nothing stays as it was, one that loses all is empty."""
    carry = tuple(c for c in docs.columns if c != text_col)
    kept = removals(docs, id_col, text_col, window, carry, texts=True)
    return kept.select(*(F.col("kept_text" if c == text_col else f"carry_{carry.index(c)}").alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM s),
o AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
g AS MATERIALIZED (SELECT DISTINCT h.doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN o ON o.h = h.h AND o.first < h.doc_id),
k AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM g)),
a AS (SELECT k.doc_id, count(*) AS n, count(*) FILTER (g.p IS NOT NULL) AS gone, coalesce(string_agg(x, ' ' ORDER BY k.p) FILTER (g.p IS NULL), '') AS kept FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.p = k.p GROUP BY k.doc_id)
SELECT doc_id, n AS n_words, gone AS n_removed, sha256(kept) AS kept_sha256 FROM a
UNION ALL SELECT doc_id, len(w), 0, sha256(coalesce(array_to_string(w, ' '), '')) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM g)
"""
