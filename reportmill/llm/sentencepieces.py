"""SentencePiece encoding and decoding that keeps every piece's place in the original bytes.

A text is normalised by the longest prefixes that the model's compiled character map holds; beside each normalised byte
stands the offset of the source bytes it came from. The normalised text is cut into pieces by the model's pair merges, with
byte pieces for what the vocabulary lacks, and every piece is projected back to its span of source bytes. Decoding joins
pieces again. Models of type BPE without pieces of the user's own are read; others are refused.

Each text is a row of its own and no row meets another: nothing is shuffled, and a lost task is done again by itself.
Merges never cross a blank where no piece holds one behind another character, so a text is encoded by its stretches of
blanks and a word, and stretches seen before come from a cache of at most CACHED entries a task. A null text counts as
empty; an empty one has no pieces. Bytes that are no UTF-8 become U+FFFD each, as in the library.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from reportmill.llm.common import raw

MODEL = "piece_bpe_32k.model"
BLANK = "▁".encode()
#: Stretches that a task remembers, and the longest that it remembers, in bytes.
CACHED, LONGEST = 400_000, 64
#: The score of neighbours that are no piece.
NEVER = float("-inf")
REPLACEMENT = "�".encode()
# Kinds of pieces in the model's file.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2


def valid(text: bytes) -> tuple[bytes, np.ndarray | None]:
    """The text with every byte that is no UTF-8 replaced, and the source offset of each byte (None where nothing changed)."""
    try:
        text.decode()
    except UnicodeDecodeError:
        out, src, at = bytearray(), [], 0
        while at < len(text):
            size = next((n for n in (1, 2, 3, 4) if _is_character(text[at : at + n])), 0)
            new = text[at : at + size] or REPLACEMENT
            out += new
            src += [at] * len(new) if not size else range(at, at + size)
            at += size or 1
        return bytes(out), np.array(src, np.int64)
    return text, None


def _is_character(piece: bytes) -> bool:
    try:
        return len(piece.decode()) == 1
    except UnicodeDecodeError:
        return False


class CharacterMap:
    """A compiled character map: a double-array trie of source prefixes and the texts they turn into."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        self.first = np.zeros(256, bool)
        self.first[[c for c in range(1, 256) if self.units and self._step(self._root(), c) is not None]] = True

    def _root(self) -> int:
        return self._offset(self.units[0])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, node: int, c: int) -> int | None:
        """The unit reached from a node by a byte."""
        at = node ^ c
        if at < len(self.units) and self.units[at] & 0x800000FF == c:
            return at
        return None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Length and replacement of the longest prefix at a place; length 0 where there is none."""
        node, found, place = self._root(), 0, 0
        for i in range(at, len(text)):
            reached = self._step(node, text[i]) if text[i] else None
            if reached is None:
                break
            unit = self.units[reached]
            node = reached ^ self._offset(unit)
            if unit & 256:
                found, place = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return found, self.texts[place : self.texts.index(b"\0", place)] if found else b""

    def apply(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The text with longest prefixes replaced, and for each byte the source offset of its prefix or character."""
        codes = np.frombuffer(text, np.uint8)
        starts = (codes & 0xC0) != 0x80
        own = np.maximum.accumulate(np.where(starts, np.arange(len(codes)), 0)) if len(codes) else np.zeros(0, np.int64)
        out, src, copied = [], [], 0
        for at in np.flatnonzero(self.first[codes] & starts).tolist():
            if at < copied:
                continue
            size, new = self.longest(text, at)
            if size:
                out += [text[copied:at], new]
                src += [own[copied:at], np.full(len(new), at, np.int64)]
                copied = at + size
        if not out:
            return text, own
        return b"".join([*out, text[copied:]]), np.concatenate([*src, own[copied:]])


class Normalizer:
    """Normalised bytes and their alignment: src[i] is the source offset of byte i, and src[-1] is where the source ends."""

    def __init__(self, spec) -> None:
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        fixed, back = valid(text)
        end = len(text)
        if not fixed:
            return b"", np.array([0], np.int64)
        norm, src = self.map.apply(fixed)
        if back is not None:
            src = np.append(back, end)[src]
        begin = 0
        if self.squeeze:
            codes = np.frombuffer(norm, np.uint8)
            blank = codes == 32
            if blank.all():
                return b"", np.array([end], np.int64)
            words = np.flatnonzero(~blank)
            begin = int(src[words[0]])
            keep = ~blank
            keep[1:] |= ~blank[:-1]
            keep[: words[0]] = False
            keep[words[-1] + 1 :] = False
            end = int(src[words[-1] + 1]) if words[-1] + 1 < len(src) else end
            norm, src = codes[keep].tobytes(), src[keep]
        space = BLANK if self.escape else b" "
        if self.escape:
            src = np.repeat(src, np.where(np.frombuffer(norm, np.uint8) == 32, len(BLANK), 1))
            norm = norm.replace(b" ", BLANK)
        if self.prefix:
            norm, src = space + norm, np.concatenate([np.full(len(space), begin, np.int64), src])
        while self.squeeze and norm.endswith(space):  # the sign of a blank may stand in the text itself
            norm, end, src = norm[: -len(space)], int(src[-len(space)]), src[: -len(space)]
        return norm, np.append(src, end)


class Encoder:
    """The pieces of a model, and a growing pool of stretches that have been encoded."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        kinds = {p.type for p in m.pieces}
        if m.trainer_spec.model_type != BPE or m.trainer_spec.treat_whitespace_as_suffix or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or BYTE not in kinds:
            raise ValueError("a BPE model with byte pieces, blanks in front and no pieces of the user's own is needed")
        self.normalizer = Normalizer(m.normalizer_spec)
        self.ids = {p.piece: (i, len(p.piece.encode())) for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.byte_ids = [0] * 256
        for i, p in enumerate(m.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        blank = BLANK.decode()
        self.apart = not any(blank in p.lstrip(blank) for p in self.ids)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.begins, self.ends = array("i"), array("i"), array("i")
        self.start, self.count, self.length = array("q"), array("q"), array("q")

    def merged(self, text: str) -> list[str]:
        """The pieces of a stretch: of all neighbours whose union is a piece, the best, and of these the leftmost, is joined first."""
        if len(text) > LONGEST:
            return self.merged_long(text)
        part, score = list(text), self.score.get
        offers = [score(a + b, NEVER) for a, b in pairwise(part)]
        while offers and (best := max(offers)) > NEVER:
            i = offers.index(best)
            part[i] += part.pop(i + 1)
            del offers[i]
            if i:
                offers[i - 1] = score(part[i - 1] + part[i], NEVER)
            if i < len(offers):
                offers[i] = score(part[i] + part[i + 1], NEVER)
        return part

    def merged_long(self, text: str) -> list[str]:
        """The same with a heap, for stretches so long that looking through all neighbours would take the square of their length."""
        part = list(text)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (s := self.score.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-s, a, b, part[a] + part[b]))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not part[a] or not part[b] or part[a] + part[b] != both or right[a] != b:
                continue
            part[a], part[b] = both, ""
            right[a] = right[b]
            if right[b] < len(part):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in part if p]

    def stretch(self, key: bytes, text: bytes) -> int:
        """The pool's number of a stretch."""
        n, first, at = len(self.count), len(self.pool), 0
        for piece in self.merged(text.decode()):
            i, size = self.ids.get(piece, (None, 0))
            if i is not None:
                self.pool.append(i)
                self.begins.append(at)
                at += size
                self.ends.append(at)
            else:  # byte pieces: the last of them stands for the whole character
                letters = piece.encode()
                self.pool.extend(self.byte_ids[c] for c in letters)
                self.begins.extend([at] * len(letters))
                self.ends.extend([at] * (len(letters) - 1) + [at + len(letters)])
                at += len(letters)
        self.start.append(first)
        self.count.append(len(self.pool) - first)
        self.length.append(at)
        if len(key) <= LONGEST:
            self.known[key] = n
        return n

    def stretches(self, norm: bytes) -> list[int]:
        """Numbers of the stretches of a normalised text, in order. A key is the stretch without its first blank; b'\\xff' marks one without."""
        if not norm:
            return []
        if not self.apart:
            return [self._number(b"\xff" + norm)]
        head, *words = norm.split(BLANK)
        if b"" in words:
            keys, blanks = [], b""
            for w in words[:-1]:
                if w:
                    keys.append(blanks + w)
                    blanks = b""
                else:
                    blanks += BLANK
            words = [*keys, blanks + words[-1]]
        known = self.known
        out = [known[w] if w in known else self._number(w) for w in words]
        return [self._number(b"\xff" + head), *out] if head else out

    def _number(self, key: bytes) -> int:
        return self.known[key] if key in self.known else self.stretch(key, key[1:] if key[:1] == b"\xff" else BLANK + key)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, ids, begins, ends): text k has the entries offsets[k] to offsets[k + 1]; begins and ends are source bytes."""
        if len(self.count) > CACHED:
            self.forget()
        numbers, per, aligned = [], [], []
        for t in texts:
            norm, src = self.normalizer(t or b"")
            found = self.stretches(norm)
            numbers += found
            per.append(len(found))
            aligned.append(src)
        s, src = np.array(numbers, np.int64), np.concatenate(aligned) if aligned else np.zeros(0, np.int64)
        start, count, length = (np.array(a, np.int64) for a in (self.start, self.count, self.length))
        counts, lengths = count[s], length[s]
        ends = np.cumsum(counts)
        at = np.repeat(start[s] - (ends - counts), counts) + np.arange(counts.sum())
        text_no = np.repeat(np.arange(len(texts)), per)
        base = np.repeat(np.cumsum(lengths) - lengths + text_no, counts)  # each text has one entry more than it has bytes
        ids, begins, stops = (np.frombuffer(a, np.int32)[at] if len(a) else np.zeros(0, np.int32) for a in (self.pool, self.begins, self.ends))
        offsets = np.concatenate([[0], np.append(0, ends)[np.cumsum(per)]]) if per else np.zeros(1, np.int64)
        return offsets.astype(np.int32), ids, src[base + begins].astype(np.int32), src[base + stops].astype(np.int32)


class Decoder:
    """Texts of lists of ids, all ids of a batch at once."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        spell = {NORMAL: lambda p: p.replace("▁", " ").encode(), UNKNOWN: lambda p: m.trainer_spec.unk_surface.encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[1:-1], 16)])}
        spelled = [spell.get(p.type, spell[NORMAL])(p.piece) for p in m.pieces]
        self.size = np.array([len(p) for p in spelled], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.is_byte = np.array([p.type == BYTE for p in m.pieces])
        self.squeeze = m.normalizer_spec.remove_extra_whitespaces
        bare = m.normalizer_spec.add_dummy_prefix or self.squeeze
        #: Pieces that lose their blank at the start of a text.
        self.trimmed = np.array([bool(bare) and p.type == NORMAL and p.piece.startswith("▁") for p in m.pieces])

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        letters = self.letters[np.repeat(self.start[ids] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        bounds = np.append(0, ends)
        out = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            text = letters[bounds[a] : bounds[b]].tobytes()
            skip = self._blanks(ids[a:b]) if text[:1] == b" " else 0
            try:
                out.append(text[skip:].decode())
            except UnicodeDecodeError:  # only byte pieces can be broken, and a broken byte becomes one sign
                out.append(valid(text[skip:])[0].decode())
        return out


    def _blanks(self, ids: np.ndarray) -> int:
        """Blanks that a text loses at its start: the first piece's, or of every piece until a sign stands where extra blanks are dropped."""
        lost = 0
        for i in ids.tolist():
            lost += int(self.trimmed[i])
            if self.size[i] and not (self.squeeze and self.trimmed[i] and self.size[i] == 1):
                break
        return lost


def _model(path: str | None) -> bytes:
    import public_tokenizers

    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return f.read()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, ids, begins, ends) of every text: the ids of its pieces and, for each, the span of bytes of the original text.

    A byte piece but the last of its character has an empty span at the character's begin. model is the path of a model
    that every task can read; without it, the public one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_model(model))
        for b in batches:
            offsets, *lists = encoder.encode(raw(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in lists)], ["id", "ids", "begins", "ends"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    schema = StructType([rows.schema["id"]])
    for name in ("ids", "begins", "ends"):
        schema = schema.add(name, ArrayType(IntegerType()))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """encoded, with the lists of ids replaced by the texts that they spell; a null list spells an empty text."""
    place = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(_model(model))
        for b in batches:
            column = b.column(place)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = decoder.decode(np.append(0, np.cumsum(sizes)), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            columns = b.columns
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)
    schema = StructType([f if i != place else type(f)(f.name, StringType()) for i, f in enumerate(encoded.schema.fields)])
    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the digests of encode() and of decode() after it."""
    e = encode(docs, id_col, text_col)
    e = e.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "ids")
    return decode(e).select(id_col, "n_tokens", "ids_sha256", F.sha2("ids", 256).alias("decoded_sha256"))
