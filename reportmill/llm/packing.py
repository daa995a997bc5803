"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised, cut where longer than a sequence, and the pieces that do not fill a sequence are dealt at random
into shards of about SHARD pieces. Each shard is searched by ISLANDS populations, each its own Spark row and task: a
crossover injects whole well-filled sequences of one parent into the other, sequences that hold one of their pieces a second
time are opened, and the displaced pieces go back best fit, longest first. After each epoch every island sends its elite
to its neighbour. The sequences that stay poorly filled meet those of other shards in a further round, which starts from
the packing they have and so never needs more sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.llm.common import map_batches, raw
from reportmill.operators.shared import cut

ROOM = 2048
SHARD = 1500
ISLANDS = 3
POPULATION = 10
EPOCHS = 2
CROSSOVERS = 60
#: Sequences filled less than this meet those of other shards in the next round.
POOR = 0.985
ROUNDS = 2
END_ID = 0
#: Islands that one task searches, so that the tasks are as many as the work needs.
ISLANDS_A_TASK = 8


class Tokens:
    """The ids of whole texts, by the vocabulary's rank file; the same ids as its `tokenizers` file gives, at a quarter of the time."""

    def __init__(self, ranks: str, pattern: str, special: dict[str, int]) -> None:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = set(special)
        self.encoding, self.whole = (tiktoken.Encoding(name, pat_str=p, mergeable_ranks=table, special_tokens=special) for name, p in (("own", pattern), ("whole", "(?s:.+)")))
        self.parts = regex.compile(f"({'|'.join(map(regex.escape, special))})" if special else "(?!)")

    def of(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())
        except ValueError:  # the pattern has no room for so long a run of white space
            return self.by_runs(text)

    def by_runs(self, text: str, least: int = 1000) -> np.ndarray:
        """The same ids, with long runs of white space taken out first: one piece each, but for a last character that something follows."""
        out = []
        for part in self.parts.split(text):
            at = 0
            for m in regex.finditer(rf"\p{{White_Space}}{{{least},}}", "" if part in self.special else part):
                end = m.end() - (m.end() < len(part))
                out += [self.of(part[at : m.start()]), self.whole.encode_to_numpy(part[m.start() : end], disallowed_special=())]
                at = end
            out.append(self.of(part[at:]))
        return np.concatenate(out)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, vocabulary: str = "byte_bpe_50k", special: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): one row per piece of at most room ids; END_ID ends each document.

    Only longer documents are cut; the first piece takes what does not fill a sequence. A null text counts as empty.
    """
    import public_tokenizers

    special = {"<|endoftext|>": 50256} if special is None else special
    path, pattern, made = public_tokenizers.path(f"{vocabulary}.tiktoken"), public_tokenizers.PATTERN, {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        tokens = made.get(0) or made.setdefault(0, Tokens(path, pattern, special))
        rows = []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = np.append(tokens.of(text) if text else [], END_ID).astype("<u4")
            n = len(ids)
            ends = [0, *range(n % room or room, n + 1, room)]
            rows += [(i, k, s, t - s, zlib.crc32(ids[s:t])) for k, (s, t) in enumerate(pairwise(ends))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], order: list[int], bins: list[list[int]], room: int) -> list[list[int]]:
    """Puts the items of order, one after the other, into the sequence where least is left; opens one where none fits."""
    left = sorted((room - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(left, (lengths[i], -1))
        if at == len(left):
            bins.append([i])
            insort(left, (room - lengths[i], len(bins) - 1))
        else:
            free, k = left.pop(at)
            bins[k].append(i)
            if free > lengths[i]:
                insort(left, (free - lengths[i], k))
    return bins


def fitness(lengths: list[int], bins: list[list[int]], room: int) -> float:
    """Few sequences first; among equals, the more uneven the fill the better. As a mean of squared fills."""
    return sum((sum(lengths[i] for i in b) / room) ** 2 for b in bins) / max(1, len(bins))


def crossover(lengths: list[int], mine: list[list[int]], other: list[list[int]], room: int, draw: np.random.Generator) -> list[list[int]]:
    """A child of mine, with well-filled sequences of other put in."""
    full = [b for b in other if sum(lengths[i] for i in b) >= room * 0.995] or sorted(other, key=lambda b: -sum(lengths[i] for i in b))[: max(1, len(other) // 4)]
    share = draw.random() * 0.5
    gift = [list(b) for b, x in zip(full, draw.random(len(full))) if x < share] or [list(full[0])]
    given = {i for b in gift for i in b}
    kept = [list(b) for b in mine if given.isdisjoint(b)]
    loose = [i for b in mine if not given.isdisjoint(b) for i in b if i not in given]
    worst = sorted(range(len(kept)), key=lambda k: sum(lengths[i] for i in kept[k]))[: max(1, len(kept) // 20)]
    loose += [i for k in worst for i in kept[k]]
    opened = set(worst)
    kept = [b for k, b in enumerate(kept) if k not in opened] + gift
    return best_fit(lengths, sorted(loose, key=lambda i: -lengths[i]), kept, room)


def _coded(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _decoded(code: bytes) -> list[list[int]]:
    of = np.frombuffer(code, np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


def evolve(lengths: list[int], population: list[list[list[int]]], room: int, draw: np.random.Generator, size: int = POPULATION, crossovers: int = CROSSOVERS) -> list[list[list[int]]]:
    """One epoch of one island, best solution first. It ends early where the bound of the total length is reached."""
    n, bound = len(lengths), -(-sum(lengths) // room)
    if not population or len(population) < size:
        by_length = sorted(range(n), key=lambda i: -lengths[i])
        population = population + [best_fit(lengths, by_length, [], room)]
        while len(population) < size:
            noise = draw.random(n) * room * 0.1
            population.append(best_fit(lengths, sorted(range(n), key=lambda i: -lengths[i] - noise[i]), [], room))
    ranked = sorted(((len(p), -fitness(lengths, p, room), k, p) for k, p in enumerate(population)), key=lambda x: x[:3])
    for step in range(crossovers):
        if ranked[0][0] <= bound:
            break
        a, b = draw.choice(len(ranked), 2, replace=False)
        child = crossover(lengths, ranked[a][3], ranked[b][3], room, draw)
        rank = len(child), -fitness(lengths, child, room)
        if all(rank != r[:2] for r in ranked):  # one that is there already would only narrow the choice
            ranked = sorted([*ranked, (*rank, len(population) + step, child)], key=lambda x: x[:3])[:size]
    return [p for *_, p in ranked[:size]]


ISLAND_SQL = "shard long, island int, lengths binary, codes array<binary>, score double"


def _island(room: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for shard, island, lengths, codes in zip(*(b.column(c).to_pylist() for c in ("shard", "island", "lengths", "codes"))):
                own = np.frombuffer(lengths, np.int32).tolist()
                draw = np.random.default_rng([abs(shard), island, epoch])
                found = evolve(own, [_decoded(c) for c in codes], room, draw)
                rows.append((shard, island, lengths, [_coded(p, len(own)) for p in found], len(found[0]) - fitness(own, found[0], room)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.float64()))], ["shard", "island", "lengths", "codes", "score"])
    return run


def _shards(table: pa.Table) -> pa.Table:
    """One row for a shard: lengths in the order of rid, and the packing that its pieces come with, if any."""
    t = table.sort_by("rid")
    had = t.column("sequence").to_numpy()
    code = [] if (had < 0).any() else [np.unique(had, return_inverse=True)[1].astype(np.int32).tobytes()]
    return pa.table({"shard": t.column("shard").slice(0, 1), "lengths": pa.array([t.column("length").to_numpy().astype(np.int32).tobytes()], pa.binary()), "codes": pa.array([code], pa.list_(pa.binary()))})


def _place(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pieces of a shard with their sequence and their place in it."""
    t = left.sort_by("rid")
    if not t.num_rows:
        return pa.table({"rid": pa.array([], pa.int64()), "sequence": pa.array([], pa.int64()), "offset": pa.array([], pa.int64()), "fill": pa.array([], pa.int64())})
    of = np.frombuffer(right.column("code")[0].as_py(), np.int32)
    length = t.column("length").to_numpy()
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(length[order])
    starts = ends - length[order]
    fill = np.bincount(of, weights=length).astype(np.int64)
    offset = np.zeros(len(of), np.int64)
    first = np.concatenate([[True], np.diff(of[order]) != 0])
    offset[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
    shard = t.column("shard")[0].as_py()
    return pa.table({"rid": t.column("rid"), "sequence": pa.array(shard * (1 << 20) + of.astype(np.int64)), "offset": pa.array(offset), "fill": pa.array(fill[of])})


def _round(rows: DataFrame, room: int, turn: int, shards: int) -> DataFrame:
    """rows (rid, length, shard, sequence) -> (rid, sequence, offset, fill), the search over."""
    state = rows.groupBy("shard").applyInArrow(_shards, "shard long, lengths binary, codes array<binary>")
    tasks = max(1, shards * ISLANDS // ISLANDS_A_TASK)
    state = state.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    for epoch in range(EPOCHS):
        spread = state.select("shard", "island", "lengths", "codes").repartition(tasks, "shard", "island")
        state = cut(spread.mapInArrow(_island(room, turn * EPOCHS + epoch), ISLAND_SQL))
        if epoch < EPOCHS - 1:
            elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.get("codes", F.lit(0)).alias("elite"))
            state = state.join(elite, ["shard", "island"]).select("shard", "island", "lengths", F.concat(F.slice("codes", 1, POPULATION - 1), F.array("elite")).alias("codes"))
    best = state.groupBy("shard").agg(F.min_by(F.get("codes", F.lit(0)), F.struct("score", "island")).alias("code"))
    return rows.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(_place, "rid long, sequence long, offset long, fill long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece of every row of docs.

    A null or empty text is one piece of the end id alone. Null and repeated ids are packed like any other. Other columns
    are left out. An empty table gives no rows.
    """
    every = cut(pieces(docs, id_col, text_col, room).withColumn("rid", F.monotonically_increasing_id()))
    whole = every.where(F.col("length") == room).select("rid", (-1 - F.col("rid")).alias("sequence"), F.lit(0).cast("long").alias("offset"))
    shards = max(1, -(-every.where(F.col("length") < room).count() // SHARD))
    rows = every.where(F.col("length") < room).select("rid", "length", F.pmod(F.xxhash64("rid"), F.lit(shards)).alias("shard"), F.lit(-1).cast("long").alias("sequence"))
    placed = cut(_round(rows, room, 0, shards))
    for turn in range(1, ROUNDS):
        poor = placed.where(F.col("fill") < int(room * POOR))
        shards = -(-poor.count() // SHARD)
        if not shards:
            break
        shard = F.lit(turn << 30) + F.pmod(F.xxhash64("sequence", F.lit(turn)), F.lit(shards))
        again = poor.join(every.select("rid", "length"), "rid").select("rid", "length", shard.alias("shard"), "sequence")
        placed = cut(placed.where(F.col("fill") >= int(room * POOR)).union(_round(again, room, turn, shards)))
    put = whole.union(placed.select("rid", "sequence", "offset"))
    return every.join(put, "rid").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, tokens, pieces): what each sequence holds."""
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
