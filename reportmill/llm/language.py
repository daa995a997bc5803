"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of a text's bytes forwards and backwards and labels every position; it is trained here in numpy, by
backpropagation through time. Windows follow each other without a gap through the whole text, across words and lines; they
start where a character starts, WINDOW bytes or up to three more after the one before. Every position of every whole text
counts: a document's probabilities are the means of its positions' probabilities.

Training takes a bounded sample: about DOCS documents for each language, PARTS windows spread over each. All languages are
learned; where there are more than SHARING, they share what that many have, down to FEWEST documents of FEW_PARTS windows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from reportmill.llm.common import raw
from reportmill.operators.shared import store

HIDDEN = 16
WINDOW = 96
DOCS = 250
PARTS = 16
#: So many languages have the whole of DOCS and PARTS, and a place in every batch.
SHARING = 64
FEWEST = 25
FEW_PARTS = 3
STEPS = 240
BATCH = 96
RATE = 0.01
#: Windows that are run together.
TOGETHER = 1024
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"

Weights = dict[str, np.ndarray]


def _start(classes: int, hidden: int, draw: np.random.Generator) -> Weights:
    w: Weights = {}
    for d in "fb":
        w[f"x{d}"] = draw.normal(0, 0.3, (256, 3 * hidden))
        w[f"h{d}"] = draw.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        w[f"c{d}"] = np.zeros(3 * hidden)
    w |= {"out": draw.normal(0, 1 / np.sqrt(hidden), (2 * hidden, classes)), "bias": np.zeros(classes)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: between -1 and 1 like tanh, at a sixth of the time. A gate is half of it and a half."""
    x /= np.abs(x) + 1
    return x


def _direction(w: Weights, d: str, x: np.ndarray, mask: np.ndarray, kept: list | None = None) -> np.ndarray:
    """States (rows, time, hidden) of one direction; a masked position keeps the state."""
    n, length = x.shape
    hidden = w[f"h{d}"].shape[0]
    h, out = np.zeros((n, hidden), np.float32), np.zeros((n, length, hidden), np.float32)
    for t in range(length) if d == "f" else range(length - 1, -1, -1):
        a, b = w[f"x{d}"][x[:, t]] + w[f"c{d}"], h @ w[f"h{d}"]
        gates = 0.5 * _squash(a[:, : 2 * hidden] + b[:, : 2 * hidden]) + 0.5
        r, z = gates[:, :hidden], gates[:, hidden:]
        new = _squash(a[:, 2 * hidden :] + r * b[:, 2 * hidden :])
        m = mask[:, t : t + 1]
        after = h + m * (1 - z) * (new - h)
        if kept is not None:
            kept.append((t, h, r, z, new, b[:, 2 * hidden :]))
        h = out[:, t] = after
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gradients(w: Weights, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Mean cross-entropy over the positions, and its gradients, through time."""
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([_direction(w, d, x, mask, kept[d]) for d in "fb"], -1)
    p = _softmax(states @ w["out"] + w["bias"])
    total = mask.sum()
    loss = float(-(np.log(p[np.arange(len(y)), :, y] + 1e-9) * mask).sum() / total)
    dz = p * mask[..., None] / total
    dz[np.arange(len(y)), :, y] -= mask / total
    flat = dz.reshape(-1, dz.shape[-1])
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"], g["bias"] = states.reshape(len(flat), -1).T @ flat, flat.sum(0)
    back = dz @ w["out"].T
    hidden = w["hf"].shape[0]
    for d, part in (("f", back[..., :hidden]), ("b", back[..., hidden:])):
        dh = np.zeros((len(y), hidden), np.float32)
        for t, h, r, z, new, bn in reversed(kept[d]):
            dh = dh + part[:, t]
            m = mask[:, t : t + 1]
            slope = lambda gate: 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
            dnew = dh * m * (1 - z) * (1 - np.abs(new)) ** 2
            dzg = dh * m * (h - new) * slope(z)
            drg = dnew * bn * slope(r)
            da = np.concatenate([drg, dzg, dnew], 1)
            db = np.concatenate([drg, dzg, dnew * r], 1)
            np.add.at(g[f"x{d}"], x[:, t], da)
            g[f"c{d}"] += da.sum(0)
            g[f"h{d}"] += h.T @ db
            dh = dh * (1 - m * (1 - z)) + db @ w[f"h{d}"].T
    return loss, g


def _cuts(text: np.ndarray) -> np.ndarray:
    """Where the windows of a text's bytes start, and its end."""
    at = np.arange(0, len(text), WINDOW)
    inside = np.append((text & 0xC0) == 0x80, False)
    for _ in range(3):  # a character has three bytes at most after its first
        at = at + inside[np.minimum(at, len(text))]
    return np.append(at[at < len(text)], len(text))


def windows(text: bytes) -> list[bytes]:
    """The text's bytes in windows."""
    cuts = _cuts(np.frombuffer(text, np.uint8))
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def _padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, parts))
    x = np.frombuffer(b"".join(v.ljust(length, b"\0") for v in parts), np.uint8).reshape(len(parts), length).astype(np.int64)
    return x, (np.arange(length) < np.array([len(v) for v in parts])[:, None]).astype(np.float32)


def train(parts: list[bytes], labels: np.ndarray, classes: int, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 0) -> Weights:
    """Adam over batches that hold the classes in equal parts, or SHARING of more classes; then steps grow with the classes."""
    draw = np.random.default_rng(seed)
    w = _start(classes, hidden, draw)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    members = [np.flatnonzero(labels == c) for c in range(classes)]
    steps = steps * max(classes, SHARING) // SHARING
    for step in range(1, steps + 1):
        some = members if classes <= SHARING else [members[c] for c in draw.choice(classes, SHARING, replace=False)]
        pick = np.concatenate([draw.choice(m, max(1, BATCH // len(some))) for m in some])
        x, mask = _padded([parts[i] for i in pick])
        _, g = gradients(w, x, mask, labels[pick])
        scale = min(1.0, 5 / (np.sqrt(sum(float((v**2).sum()) for v in g.values())) + 1e-9))
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k in w:
            mean[k] += 0.1 * (g[k] * scale - mean[k])
            square[k] += 0.01 * ((g[k] * scale) ** 2 - square[k])
            w[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


class Reader:
    """The trained network: mean probabilities of whole texts."""

    def __init__(self, w: Weights) -> None:
        n = w["hf"].shape[0]
        self.sides = [[np.ascontiguousarray(v, np.float32) for m in (w[f"x{d}"] + w[f"c{d}"], w[f"h{d}"]) for v in (m[:, : 2 * n], m[:, 2 * n :])] for d in "fb"]
        self.hidden, self.out, self.bias = n, w["out"].astype(np.float32), w["bias"].astype(np.float32)

    def _states(self, side: int, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """States (time, rows, hidden) of one direction; x is (time, rows), and rows are sorted by length, the longest first."""
        n, (xg, xn, hg, hn) = self.hidden, self.sides[side]
        out, h = np.zeros((*x.shape, n), np.float32), np.zeros((x.shape[1], n), np.float32)
        live = np.searchsorted(-lengths, -np.arange(len(x)), "left")  # rows longer than t
        for t in range(len(x)) if not side else range(len(x) - 1, -1, -1):
            k = live[t]
            g = h[:k] @ hg
            g += xg.take(x[t, :k], 0, mode="clip")
            _squash(g)
            g += 1
            g *= 0.5
            new = h[:k] @ hn
            new *= g[:, :n]
            new += xn.take(x[t, :k], 0, mode="clip")
            _squash(new)
            step = h[:k] - new
            step *= g[:, n:]
            step += new
            h[:k] = out[t, :k] = step
        return out

    def sums(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each row the sums of its positions' probabilities."""
        n, w = self.hidden, self.out
        p = self._states(0, x, lengths) @ w[:n] + self._states(1, x, lengths) @ w[n:] + self.bias
        p -= p.max(-1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(-1, keepdims=True)
        p *= (np.arange(len(x))[:, None] < lengths)[..., None]
        return p.sum(0)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For each text, not empty, its mean probabilities over all positions. Windows of many texts are run together."""
        out, held, size = np.zeros((len(texts), len(self.bias))), [], 0

        def run() -> None:
            data = np.concatenate([d for _, d, _ in held] + [np.zeros(WINDOW + 4, np.uint8)])
            first = np.cumsum([0] + [len(d) for _, d, _ in held])
            start = np.concatenate([f + c[:-1] for f, (_, _, c) in zip(first, held)])
            length = np.concatenate([np.diff(c) for _, _, c in held])
            of = np.repeat([k for k, _, _ in held], [len(c) - 1 for _, _, c in held])
            order = np.argsort(-length, kind="stable")
            for i in range(0, len(order), TOGETHER):
                rows = order[i : i + TOGETHER]
                at = np.arange(length[rows[0]])[:, None] + start[rows]
                np.add.at(out, of[rows], self.sums(data[at].astype(np.intp), length[rows]))

        for k, t in enumerate(texts):
            data = np.frombuffer(t, np.uint8)
            cuts = _cuts(data)
            for i in range(0, len(cuts) - 1, 8 * TOGETHER):  # a very long text is run in turns
                part = cuts[i : i + 8 * TOGETHER + 1]
                held.append((k, data[part[0] : part[-1]], part - part[0]))
                size += len(part)
                if size > 8 * TOGETHER:
                    run()
                    held, size = [], 0
        if held:
            run()
        return out / np.array([len(t) for t in texts])[:, None]


def _spread(w: list[bytes], most: int) -> list[bytes]:
    return w if len(w) <= most else [w[i * len(w) // most] for i in range(most)]


def _sample(docs: DataFrame, held_out: Column, id_col: str, text_col: str, lang_col: str, docs_each: int) -> list[Row]:
    """(lang, parts): documents of every language that are not held out.

    A document is taken by a hash of its id, at a rate that gives about docs_each documents a language, or an even share of
    SHARING * DOCS where that is less, but FEWEST at least; each hands at most PARTS windows, or its share, to the driver.
    """
    known = docs.where(~held_out & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return []
    each = min(docs_each, max(FEWEST, SHARING * DOCS // len(counts)))
    most = min(PARTS, max(FEW_PARTS, SHARING * DOCS * PARTS // (len(counts) * each)))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in counts], "_lang string, _rate double")
    unit = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_spread(windows(t), most) for t in raw(b.column(1))], pa.list_(pa.binary()))], ["lang", "parts"])

    rows = known.join(F.broadcast(rates), F.col("lang") == F.col("_lang")).where(unit < F.col("_rate")).select("lang", "text")
    return rows.mapInArrow(sampled, "lang string, parts array<binary>").collect()


def _model(rows: list[Row], steps: int) -> tuple[list[str], Weights] | None:
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    at = {v: k for k, v in enumerate(languages)}
    pairs = sorted((bytes(v), at[r.lang]) for r in rows for v in r.parts)
    return languages, train([v for v, _ in pairs], np.array([c for _, c in pairs]), len(languages), steps=steps)


def fit(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_each: int = DOCS, steps: int = STEPS) -> tuple[list[str], Weights] | None:
    """Languages and weights, from the text and language of documents that are not held out; None without any."""
    return _model(_sample(docs, held_out, id_col, text_col, lang_col, docs_each), steps)


def _lettered(texts: pa.Array) -> list[int]:
    """Rows whose text has a letter."""
    return [k for k, t in enumerate(texts.to_pylist()) if t and LETTER.search(t)]


def predict(docs: DataFrame, model: tuple[list[str], Weights] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as (doc_id, lang_pred, score). Without a letter, or without a model, a text is `und` with score 0."""
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed)
        reader = Reader(model[1]) if model else None
        for b in batches:
            names, scores = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            if reader and (at := _lettered(b.column(1))):
                p = reader.pooled(raw(b.column(1).take(pa.array(at))))
                scores[at] = np.minimum(1.0, p.max(1))
                for k, best in zip(at, p.argmax(1)):
                    names[k] = model[0][best]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score): one row per row of docs, from a model of those that are not held out.

    Null, empty and letterless texts are `und`. Null languages teach nothing. Other columns are left out. An empty table,
    or one without labels, gives `und` throughout.
    """
    return predict(docs, fit(docs, held_out, id_col, text_col, lang_col), id_col, text_col)


def keep_known(docs: DataFrame, held_out: Column, share: float = 0.2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs whose text has a language: not `und`, and with a mean position probability of chance and a share of the rest, or no
    lower than every labelled document that is not held out has. All of these count, so the texts are read once and stored with their score."""
    model = _model(_sample(docs, held_out, id_col, text_col, lang_col, DOCS), STEPS)
    packed = pickle.dumps(model)
    at, name = docs.columns.index(text_col), "_certain"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed)
        reader = Reader(model[1]) if model else None
        for b in batches:
            rows = _lettered(b.column(at)) if reader else []
            if rows:
                kept = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(reader.pooled(raw(kept.column(at))).max(1))], [*kept.schema.names, name])

    read = store(docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())])))
    if model is None:
        return read.drop(name)
    chance = 1 / len(model[0])
    labelled = read.where(~held_out & F.col(lang_col).isNotNull()).agg(F.min(name)).first()[0]
    least = min(chance + share * (1 - chance), 1.0 if labelled is None else labelled)
    return read.where(F.col(name) >= least - 1e-6).drop(name)
