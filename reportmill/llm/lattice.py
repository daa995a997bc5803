"""Subword lattice likelihood: the probability of a text, summed over all its segmentations.

The vocabulary is an existing one: the pieces of a public tokenizer. A word is a path through the lattice of pieces that
spell it: a piece that starts a word, then pieces that go on, then a stop. Every single byte is a piece as well, so every
word has a path. A word that training has seen has one more arc, from end to end: its share of the training words. The forward
recursion runs in log space over all paths, for a whole batch of words at once; a very long word runs by itself, in
stretches that hand on the recursion's state, so that pieces cross them.

The vocabulary's file holds merge ranks, no likelihoods: they are the first scores, and rounds of forward-backward over
every distinct training word re-estimate them. Each word counts once there, because the pieces have to spell what the
whole-word arcs lack: weighted by their counts, pieces spell unseen words worse (10^-8.9 against 10^-8.7 each at sf0.01).

Documents fall into classes (a column such as the language; the CLASSES - 1 largest, and the rest), each with its own piece
scores and word counts. A class is known of training documents alone; of a text, it is one more thing that is summed over:

    P(text) = sum over classes k of P(k) * e_k * (1 - e_k)^words * product over words w, the i-th of the text, of
              (earlier occurrences of w in the text + MEMORY * P_k(w)) / (i - 1 + MEMORY)
    P_k(w)  = b_k * c_k(w) / n_k + (1 - b_k) * sum over segmentations of w

with e the share of ends among tokens, 1 - b the share of words seen once (Good-Turing), and MEMORY words' worth of trust in
P_k. The product depends on a text's word counts alone. What is gathered from the corpus, the counts of words, is
distributed by word. The lattice runs once a distinct word, and a document looks its words up: those that make up at least
1/HOT of all tokens are no more than HOT by that bound and are broadcast, the rest meet by a join on the word, where no key is
hot any more.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.llm.common import log_factorial, raw
from reportmill.operators.shared import store

#: Words that hold at least 1/HOT of all tokens are broadcast: HOT at most.
HOT = 200_000
CLASSES = 8
MEMORY = 3000.0
EM_ROUNDS = 3
SMOOTH = 0.001
FLUSH = 200_000
CELLS = 1 << 18
#: A longer word runs by itself, in stretches of STRETCH positions.
LONG, STRETCH = 512, 1 << 16
START, END = b" ", b""


def public_pieces(model: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a word's start as a blank, with first log scores by their order; all single bytes are added."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    found: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or "▁" in piece[1:]:
            continue
        found[piece.replace("▁", " ").encode()] = -math.log(i + 10)
    for b in (bytes([i]) for i in range(256)):
        found.setdefault(b, -math.log(sp.get_piece_size() * 10))
    return list(found), np.array(list(found.values()))


def normalised(pieces: list[bytes], weights: np.ndarray, stop: float) -> tuple[np.ndarray, float]:
    """Log probabilities: pieces that start a word among themselves, the others together with the stop."""
    starts = np.array([p[:1] == START for p in pieces])
    out = np.log(weights)
    out[starts] -= math.log(weights[starts].sum())
    rest = math.log(weights[~starts].sum() + stop)
    out[~starts] -= rest
    return out, math.log(stop) - rest


@functools.lru_cache(1)
def _trie(pieces: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """All pieces in a trie of bytes: the next node by node and byte, and the piece that ends at a node. A worker builds it once."""
    index: dict[bytes, int] = {b"": 0}
    for p in pieces:
        for i in range(1, len(p) + 1):
            index.setdefault(p[:i], len(index))
    after, piece = np.zeros((len(index), 256), np.int32), np.full(len(index), -1, np.int32)
    for prefix, node in index.items():
        if prefix:
            after[index[prefix[:-1]], prefix[-1]] = node
    piece[[index[p] for p in pieces]] = np.arange(len(pieces))
    return after, piece


class Lattice:
    """The pieces with scores (classes x pieces) and stops (classes)."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray, stop: np.ndarray | float) -> None:
        self.next, self.piece = _trie(tuple(pieces))
        self.reach = max(map(len, pieces))
        self.scores, self.stop = np.atleast_2d(scores), np.atleast_1d(stop)

    def _batch(self, words: list[bytes], expected: np.ndarray | None) -> np.ndarray:
        """Totals (classes x words). alpha, beta: classes x positions x words; arcs hold for all classes."""
        lengths = np.array([len(w) for w in words])
        width = lengths.max()
        m = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        alpha = np.full((len(self.stop), width + 1, len(words)), -np.inf)
        alpha[:, 0] = 0
        arcs: list[list[tuple]] = []
        for i in range(width):
            rows = np.flatnonzero(lengths > i)
            node, j, here = np.zeros(len(rows), np.int32), i, []
            while len(rows):
                node = self.next[node, m[rows, j]]
                j += 1
                alive = node > 0
                rows, node = rows[alive], node[alive]
                piece = self.piece[node]
                has = piece >= 0
                if has.any():
                    r, p = rows[has], piece[has]
                    alpha[:, j, r] = np.logaddexp(alpha[:, j, r], alpha[:, i, r] + self.scores[:, p])
                    here.append((r, j, p))
                more = lengths[rows] > j
                rows, node = rows[more], node[more]
            arcs.append(here)
        total = alpha[:, lengths, np.arange(len(words))] + self.stop[:, None]
        if expected is not None:
            beta = np.full(alpha.shape, -np.inf)
            beta[:, lengths, np.arange(len(words))] = self.stop[:, None]
            for i in range(width - 1, -1, -1):
                for r, j, p in arcs[i]:
                    through = self.scores[:, p] + beta[:, j, r]
                    beta[:, i, r] = np.logaddexp(beta[:, i, r], through)
                    np.add.at(expected, p, np.exp(alpha[:, i, r] + through - total[:, r]).sum(0))
        return total

    def _arcs(self, m: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All arcs that start from a to before b, in order: cuts by start, ends, pieces."""
        at = np.arange(a, b)
        node, j, found = np.zeros(b - a, np.int32), 0, []
        while len(at):
            node = self.next[node, m[at + j]]
            j += 1
            alive = node > 0
            at, node = at[alive], node[alive]
            has = self.piece[node] >= 0
            found.append((at[has], at[has] + j, self.piece[node[has]]))
            more = at + j < len(m)
            at, node = at[more], node[more]
        start, end, piece = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(start, kind="stable")
        return np.searchsorted(start[order], np.arange(a, b + 1)), end[order], piece[order]

    def _long(self, word: bytes, expected: np.ndarray | None) -> np.ndarray:
        """Totals (classes) of one word. States travel from stretch to stretch; the way back recomputes each stretch from them."""
        m, n, k = np.frombuffer(word, np.uint8), len(word), len(self.stop)

        def forward(a: int, state: np.ndarray) -> tuple[np.ndarray, tuple]:
            b = min(n, a + STRETCH)
            alpha = np.full((k, b - a + self.reach + 1), -np.inf)
            alpha[:, : state.shape[1]] = state
            cuts, end, piece = self._arcs(m, a, b)
            for i in range(b - a):
                e, p = end[cuts[i] : cuts[i + 1]] - a, piece[cuts[i] : cuts[i + 1]]
                alpha[:, e] = np.logaddexp(alpha[:, e], alpha[:, i : i + 1] + self.scores[:, p])
            return alpha, (b, cuts, end, piece)

        states, starts = [np.zeros((k, 1))], list(range(0, n, STRETCH))
        for a in starts:
            alpha, (b, *_) = forward(a, states[-1])
            states.append(alpha[:, b - a :])
        total = states[-1][:, 0] + self.stop
        if expected is not None:
            after = np.full((k, self.reach + 1), -np.inf)
            after[:, 0] = self.stop
            for a, state in zip(reversed(starts), reversed(states[:-1])):
                alpha, (b, cuts, end, piece) = forward(a, state)
                beta = np.concatenate([np.full((k, b - a), -np.inf), after], 1)
                for i in range(b - a - 1, -1, -1):
                    e, p = end[cuts[i] : cuts[i + 1]] - a, piece[cuts[i] : cuts[i + 1]]
                    through = self.scores[:, p] + beta[:, e]
                    beta[:, i] = np.logaddexp.reduce(through, 1)
                    np.add.at(expected, p, np.exp(alpha[:, i : i + 1] + through - total[:, None]).sum(0))
                after = beta[:, : self.reach + 1]
        return total

    def log_probabilities(self, words: list[bytes], expected: np.ndarray | None = None, whole: np.ndarray | None = None) -> np.ndarray:
        """Natural logs of the words' probabilities over all segmentations (classes x words); adds the expected use of each piece.

        whole: the arc that spans each word, in each class; where it is given, pieces share what it leaves.
        """
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        out, i = np.zeros((len(self.stop), len(words))), 0
        while i < len(order):
            t, size = i + 1, len(words[order[i]]) + 1
            if size > LONG:
                out[:, order[i]] = self._long(START + words[order[i]], expected)
            else:
                while t < len(order) and len(words[order[t]]) < LONG and (t + 1 - i) * (len(words[order[t]]) + 1) * len(self.stop) <= CELLS:
                    t += 1
                out[:, order[i:t]] = self._batch([START + words[k] for k in order[i:t]], expected)
            i = t
        return out if whole is None else np.logaddexp(whole, out)


def _tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _binary(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary())


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows or bytes, for the lattice is quick on many words only."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def classes(docs: DataFrame, held_out: Column, class_col: str | None, most: int) -> tuple[Column, list[int]]:
    """A column with the number of a row's class, and the training documents of each class: the largest ones, then all the rest."""
    if class_col is None or class_col not in docs.columns:
        return F.lit(0), [docs.where(~held_out).count()]
    counts = docs.where(~held_out).groupBy(F.col(class_col).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.where("name is not null").orderBy(F.desc("n"), "name").limit(most - 1).collect()
    of = F.lit(len(top))
    for k, r in enumerate(top):
        of = F.when(F.col(class_col).cast("string") == r["name"], k).otherwise(of)
    rest = (counts.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in top)
    return of, [r["n"] for r in top] + [rest] * (rest > 0 or not top)


def word_counts(rows: DataFrame, many: int) -> DataFrame:
    """rows (text, held_out, class) -> (word, every, c_0, ...): counts in all documents, and in the training documents of each class."""
    names = ["word", "every", *(f"c_{k}" for k in range(many))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in range(many + 1)]

        def flush() -> pa.RecordBatch:
            words = list(set().union(*counts))
            cols = [[c[w] for w in words] for c in counts]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays([_binary(words), pa.array(map(sum, zip(*cols)), pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:many])], names)

        for b in batches:
            for text, out, k in zip(raw(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words, own = _tokens(text), counts[many if out else k]
                for i in range(0, len(words), FLUSH):
                    own.update(words[i : i + FLUSH])
                    if sum(map(len, counts)) > FLUSH:
                        yield flush()
                own[END] += 1
        yield flush()

    found = rows.select("text", "held_out", "class").mapInArrow(run, "word binary, " + ", ".join(f"{c} long" for c in names[1:]))
    return found.groupBy("word").agg(*(F.sum(c).alias(c) for c in names[1:]))


def _expectations(words: DataFrame, pieces: list[bytes], models: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, float]]:
    """For each class the expected use of each piece over all distinct training words, and their number. A row a class and piece comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = None
        expected, n = np.zeros((len(models), len(pieces))), np.zeros(len(models))
        for b in _gathered(batches):
            lattices = lattices or [Lattice(pieces, *m) for m in models]
            for k, lattice in enumerate(lattices):
                some = b.column(0).filter(pc.greater(b.column(k + 1), 0)).to_pylist()
                if some:
                    lattice.log_probabilities(some, expected[k])
                    n[k] += len(some)
        k, used = np.nonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array([*k, *range(len(models))], pa.int32()), pa.array([*used, *[-1] * len(models)], pa.int64()), pa.array([*expected[k, used], *n], pa.float64())], ["class", "piece", "n"])

    c = [f"c_{k}" for k in range(len(models))]
    seen = words.where((F.greatest(F.lit(0), *c) > 0) & (F.col("word") != F.lit(bytearray(END)))).select("word", *c)
    out = [[np.zeros(len(pieces)), 0.0] for _ in models]
    for r in seen.mapInArrow(run, "class int, piece long, n double").groupBy("class", "piece").agg(F.sum("n").alias("n")).collect():
        if r.piece < 0:
            out[r["class"]][1] = r.n
        else:
            out[r["class"]][0][r.piece] = r.n
    return [tuple(x) for x in out]


def fit(words: DataFrame, pieces: list[bytes], scores: np.ndarray, many: int, rounds: int = EM_ROUNDS) -> list[tuple[np.ndarray, float]]:
    """For each class the scores of the pieces and of the stop, after so many rounds of forward-backward."""
    models = [normalised(pieces, np.exp(scores), 1 / 20)] * many
    for _ in range(rounds):
        models = [normalised(pieces, used + SMOOTH, max(n, 1.0)) if n else m for m, (used, n) in zip(models, _expectations(words, pieces, models))]
    return models


def word_scores(words: DataFrame, pieces: list[bytes], models: list[tuple[np.ndarray, float]]) -> tuple[DataFrame, int, np.ndarray]:
    """(word, every, known, base, s_0, ...) for every word of the corpus: the base to base 10, s as natural logs in each class.

    Also the number of training tokens, and the shares of ends among each class's tokens. The base of the end is kept; its s is 0.
    """
    many, end = len(models), F.col("word") == F.lit(bytearray(END))
    c = [F.col(f"c_{k}") for k in range(many)]
    every = sum(c[1:], c[0])
    stats = words.agg(F.count_if(every > 0).alias("v"), *(f for k in range(many) for f in (F.sum(c[k]).alias(f"n_{k}"), F.sum(F.when(end, c[k])).alias(f"e_{k}"), F.count_if((c[k] == 1) & ~end).alias(f"o_{k}")))).first()
    n, ends, once = (np.array([stats[f"{x}_{k}"] or 0 for k in range(many)], np.float64) for x in "neo")
    total, v = int(n.sum()), stats["v"] or 0
    in_words = np.maximum(1, n - ends)
    seen = np.where(n > 0, np.clip(1 - (once + 1) / (in_words + 1), 0.01, 0.9999), 0.0)[:, None]
    scores, stop = np.stack([m[0] for m in models]), np.array([m[1] for m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for b in _gathered(batches):
            lattice = lattice or Lattice(pieces, scores, stop + np.log(1 - seen[:, 0]))
            w, c = b.column(0).to_pylist(), np.stack([b.column(k + 2).to_numpy() for k in range(many)])
            with np.errstate(divide="ignore"):
                whole = np.log(seen * c / in_words[:, None])
            p = lattice.log_probabilities([x or b"\0" for x in w], whole=whole)
            p[:, [k for k, x in enumerate(w) if x == END]] = 0
            base = np.log10((c.sum(0) + 1) / (total + v + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((c.sum(0) > 0).astype(np.int64)), pa.array(base), *map(pa.array, p)], ["word", "every", "known", "base", *(f"s_{k}" for k in range(many))])

    scored = words.select("word", "every", *(f"c_{k}" for k in range(many))).mapInArrow(run, "word binary, every long, known long, base double, " + ", ".join(f"s_{k} double" for k in range(many)))
    return scored, total, (ends + 1) / (n + 2)


def _again(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sum of ln(j + x) for j from 1 to n - 1, by Stirling's series; within 1e-9."""
    f = lambda y: (y + 8.5) * np.log(y + 9) - (y + 9) + 1 / (12 * (y + 9)) - 1 / (360 * (y + 9) ** 3) + 1 / (1260 * (y + 9) ** 5) - sum(np.log(y + k) for k in range(1, 9))
    return f(n - 1 + x) - f(x)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of docs, logs to base 10.

    A null text counts as empty: its one token is the end. Rows that share an id, or have none, are scored each. A null
    class, or a class column that is not there, is the rest. Where nothing is left to train on, all counts are zero and the
    pieces keep their first scores. Other columns are left out.
    """
    import public_tokenizers

    of, sizes = classes(docs, held_out, class_col, CLASSES)
    many = len(sizes)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"), F.least(of, F.lit(many - 1)).alias("class"))
    words = store(word_counts(rows, many))
    pieces, first = public_pieces(public_tokenizers.path(vocabulary))
    scored, n, share = word_scores(words, pieces, fit(words, pieces, first, many))
    scored = store(scored)
    total = scored.agg(F.sum("every")).first()[0] or 0
    s = [f"s_{k}" for k in range(many)]
    hot = scored.where((F.col("every") * HOT >= total) & (F.length("word") <= LONG)).select("word", "known", "base", *s).toPandas()
    index = {bytes(w): i for i, w in enumerate(hot.word)}
    known = docs.sparkSession.sparkContext.broadcast((index, hot[["known", "base"]].to_numpy(np.float64), hot[s].to_numpy(np.float64)))
    names = ["rid", "word", "n", "doc_id", "held_out", "known", "base", "model"]
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.list_(pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, plain, by_class = known.value
        for b in batches:
            out, cold, of, times = [], [], [], []
            for rid, i, text, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), b.column(3).to_pylist()):
                counts = Counter(_tokens(text))
                n, at = sum(counts.values()), []
                counts[END] = 1
                before = len(cold)
                for w, c in counts.items():
                    if (k := index.get(w)) is not None:
                        at.append((k, c))
                    else:
                        cold.append(w)
                        times.append(c)
                of += [rid] * (len(cold) - before)
                k, c = (np.array(x) for x in zip(*at)) if at else (np.zeros(0, int), np.zeros(0))
                model = by_class[k].sum(0) + np.log(MEMORY) * (len(k) - (END in index))
                more = c > 1
                if more.any():
                    model = model + _again(c[more, None], MEMORY * np.exp(by_class[k[more]])).sum(0)
                model = model + (n * np.log(1 - share) + np.log(share) - (_again(np.array(n), np.array(MEMORY)) + math.log(MEMORY) if n else 0))
                out.append((rid, b" %d" % rid, int(c.sum()), i, held, int(c @ plain[k, 0]), float(c @ plain[k, 1]), model.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            for at in range(0, len(cold), 20_000):
                some = [pa.array(x[at : at + 20_000], t) for x, t in zip((of, cold, times), types)]
                n = len(some[0])
                rest = [pa.nulls(n, types[3]), pa.nulls(n, types[4]), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n)), pa.nulls(n, types[7])]
                yield pa.RecordBatch.from_arrays(some + rest, names)

    parts = rows.select("rid", "doc_id", "text", "held_out").mapInArrow(run, "rid long, word binary, n long, doc_id long, held_out boolean, known long, base double, model array<double>")
    look = scored.select(F.col("word").alias("w"), F.col("known").alias("k"), F.col("base").alias("b"), *s)
    joined = parts.join(look, F.col("word") == F.col("w"), "left")
    plus = lambda a, x: F.sum(F.col(a) + F.coalesce(F.col("n") * F.col(x), F.lit(0)))
    repeats = lambda x: F.when(F.col("n") > 1, log_factorial(F.col("n") - 1 + MEMORY * F.exp(x)) - log_factorial(MEMORY * F.exp(x))).otherwise(0.0)
    own = lambda x: F.when(F.col("word") == F.lit(bytearray(END)), 0.0).otherwise(F.coalesce(F.col(x) + math.log(MEMORY) + repeats(F.col(x)), F.lit(0.0)))
    in_class = [F.sum(F.coalesce(F.get("model", F.lit(k)), F.lit(0.0)) + own(x)).alias(f"in_{k}") for k, x in enumerate(s)]
    summed = joined.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n").alias("n_tokens"), plus("known", "k").alias("n_known"), plus("base", "b").alias("base_score"), *in_class)
    each = [F.col(f"in_{k}") + math.log((x + 1) / (sum(sizes) + many)) for k, x in enumerate(sizes)]
    best = F.greatest(F.lit(-math.inf), *each)
    together = sum((F.exp(x - best) for x in each[1:]), F.exp(each[0] - best))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", ((best + F.log(together)) / math.log(10)).alias("score"))
