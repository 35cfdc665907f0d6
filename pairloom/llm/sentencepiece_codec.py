"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here (wire format, no generated code) and rebuilt as normaliser,
space marker, BPE or unigram model and byte fallback. Where no piece of the vocabulary holds a
space marker after another character, a text's segmentation is the concatenation of those of its
space-led segments; each batch then encodes its distinct segments only, which is exact and several
times faster. Decoding and parity with the SentencePiece library are verified on the same segments.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkit as tk

MARK = "▁"
MARK_BYTES = MARK.encode()
# piece types and model types of the SentencePiece protobuf (fixed values)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
JOINED = 1 << 15


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def protobuf_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message; fixed-width and length-delimited values as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield key >> 3, value
            continue
        if kind == 2:
            size, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind} is not part of a SentencePiece model")
        if at + size > len(data):
            raise ValueError("the model is cut off")
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class SentencePieceSpec:
    """What the protobuf says of pieces, model and normaliser."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    suffix_marker: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, model: bytes) -> SentencePieceSpec:
        spec = cls()
        for number, value in protobuf_fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in protobuf_fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                spec.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in protobuf_fields(value):
                    if n == 3:
                        spec.model_type = v
                    elif n == 24:
                        spec.suffix_marker = bool(v)
                    elif n == 35:
                        spec.byte_fallback = bool(v)
                    elif n == 40:
                        spec.unk_id = v
            elif number == 3:
                for n, v in protobuf_fields(value):
                    if n == 2:
                        spec.charsmap = v
                    elif n == 3:
                        spec.dummy_prefix = bool(v)
                    elif n == 4:
                        spec.squeeze_spaces = bool(v)
                    elif n == 5:
                        spec.escape_spaces = bool(v)
        if spec.model_type not in (UNIGRAM, BPE) or spec.suffix_marker or not spec.escape_spaces:
            raise ValueError("only unigram and BPE models with a leading space marker are supported")
        return spec

    @cached_property
    def splittable(self) -> bool:
        """Whether encoding each space-led segment alone is exact."""
        crossing = re.compile(f"[^{MARK}]{MARK}")
        return not self.charsmap and not self.squeeze_spaces and self.dummy_prefix and not any(crossing.search(p) for p, _, _ in self.pieces)


class Codec:
    """Encoder and decoder of one model. ``threads`` is for the batch calls of the backend."""

    def __init__(self, model: bytes, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece

        self.spec = SentencePieceSpec.parse(model)
        self.whole = self._build(self.spec.dummy_prefix)
        self.segment = self._build(False)
        self.cache = SegmentCache()
        decoded = [self._piece_bytes(p, kind) for p, _, kind in self.spec.pieces]
        self.piece_size = np.array([len(x) for x in decoded], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(decoded), np.uint8)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=model)

    @staticmethod
    def _piece_bytes(piece: str, kind: int) -> bytes:
        """The text that a piece stands for; none for control and unknown pieces."""
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind in (UNKNOWN, CONTROL) else piece.replace(MARK, " ").encode()

    def _build(self, dummy_prefix: bool):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        spec = self.spec
        steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
        if spec.squeeze_spaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(MARK)] if dummy_prefix else []
        steps += [normalizers.Replace(" ", MARK)]
        if spec.model_type == UNIGRAM:
            vocab = [(p, s) for p, s, _ in spec.pieces]
            model = models.Unigram(vocab, unk_id=spec.unk_id, byte_fallback=spec.byte_fallback)
        else:
            vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
            merges = []
            for piece, score, kind in spec.pieces:
                if kind == NORMAL:  # user-defined pieces are cut out of the text before anything is merged
                    for cut in range(1, len(piece)):
                        left, right = vocab.get(piece[:cut]), vocab.get(piece[cut:])
                        if left is not None and right is not None:
                            # of equal scores the leftmost pair goes first: what has grown there is the longer
                            merges.append((-score, -cut, left, right))
            merges.sort()
            text = [p for p, _, _ in spec.pieces]
            model = models.BPE(vocab, [(text[a], text[b]) for _, _, a, b in merges], unk_token=text[spec.unk_id], fuse_unk=True, byte_fallback=spec.byte_fallback)
        out = Tokenizer(model)
        out.normalizer = normalizers.Sequence(steps)
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        user = [AddedToken(p, normalized=True, special=False) for p, _, kind in spec.pieces if kind == USER_DEFINED]
        if user:
            out.add_tokens(user)
        out.encode_special_tokens = True
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts; an empty text has none."""
        spec = self.spec
        if spec.charsmap or spec.squeeze_spaces:
            found = [x.ids for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            lead = " " if spec.dummy_prefix else ""
            found = [x.ids for x in self.segment.encode_batch_fast([lead + t for t in texts], add_special_tokens=False)]
        return [ids if text else [] for ids, text in zip(found, texts, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids; the space of the dummy prefix is taken off."""
        out = self.whole.decode_batch(ids, skip_special_tokens=False)
        return [x[1:] if self.spec.dummy_prefix and x.startswith(" ") else x for x in out]

    def encode_segments(self, raw: bytes, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the space-led segments raw[first[i]:first[i+1]], end to end, their count in each, and whether
        the SentencePiece library gives the same.

        Segments are joined to texts of about JOINED bytes, which both libraries encode in one call; ids are
        dealt back to segments by the byte lengths of their pieces."""
        cuts = np.unique(np.concatenate([np.searchsorted(first, np.arange(0, len(raw), JOINED)), [len(first) - 1]]))
        texts = [raw[first[a] : first[b]].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        ids = np.array([x for e in self.segment.encode_batch_fast(texts, add_special_tokens=False) for x in e.ids], np.int32)
        same = np.array([x for one in self.reference.encode([t[1:] for t in texts], num_threads=1) for x in one], np.int32)
        ends = np.cumsum(self.piece_size[ids])
        upto = np.searchsorted(ends, first, side="right")
        whole = (self.piece_size[ids] > 0).all() and len(ends) > 0 and ends[-1] == len(raw) and (ends[upto[1:] - 1] == first[1:]).all()
        if whole and len(same) == len(ids):
            odd = np.concatenate([[0], np.cumsum(same != ids)])
            return ids, np.diff(upto), odd[upto[1:]] == odd[upto[:-1]]
        # unknown pieces have no length, and ids that differ can't be dealt out: one segment at a time
        segments = [raw[a:b].decode("utf-8", "replace") for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        each = [x.ids for x in self.segment.encode_batch_fast(segments, add_special_tokens=False)]
        # a lone space is an empty text to the library, which has no ids
        same = [a if s == " " else b for a, b, s in zip(each, self.reference.encode([s[1:] for s in segments], num_threads=1), segments, strict=True)]
        return np.array([x for one in each for x in one], np.int32), np.fromiter(map(len, each), np.int64, len(each)), np.array([a == b for a, b in zip(each, same, strict=True)], bool)


_codecs: dict[tuple[str, int], Codec] = {}


def codec(model: bytes, threads: int = 2) -> Codec:
    """One codec for each model and Python worker."""
    key = (hashlib.sha256(model).hexdigest(), threads)
    if key not in _codecs:
        _codecs[key] = Codec(model, threads)
    return _codecs[key]


class SegmentCache:
    """Ids of segments already met by this worker, by hash, and whether both libraries agree on them; emptied when
    it is full. About 50 bytes a segment."""

    def __init__(self, limit: int = 1_000_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.hash, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted by hash
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.parity = np.empty(0, np.int32), np.empty(0, bool)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 for new ones."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, self.row[at], -1)

    def add(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray, parity: np.ndarray) -> None:
        """New segments; ``hashes`` are sorted."""
        where = np.searchsorted(self.hash, hashes)
        self.row = np.insert(self.row, where, len(self.size) + np.arange(len(size)))
        self.hash = np.insert(self.hash, where, hashes)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids])
        self.parity = np.concatenate([self.parity, parity])


def _encode_split(piece: tk.Slice, c: Codec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts of a slice, their count, and whether both libraries agree on all of a text's segments;
    each distinct segment is encoded once."""
    empty = np.diff(piece.offsets) == 0
    data = np.insert(piece.data, piece.offsets[:-1][~empty], 0x20)  # the dummy prefix
    offsets = piece.offsets + np.concatenate([[0], np.cumsum(~empty)])
    space = data == 0x20
    lead = space.copy()
    lead[1:] &= ~space[:-1]
    lead[offsets[:-1][~empty]] = True
    start = np.flatnonzero(lead)
    end = np.append(start[1:], len(data))
    hashes, head, back = np.unique(tk.mix(tk.PrefixHash(data).raw(start, end) + (end - start).astype(np.uint64)), return_index=True, return_inverse=True)
    if len(c.cache.hash) + len(hashes) > c.cache.limit:
        c.cache.clear()
    new = np.flatnonzero(c.cache.find(hashes) < 0)
    if len(new):
        at, size = start[head[new]], (end - start)[head[new]]
        border = np.concatenate([[0], np.cumsum(size)])
        raw = data[np.repeat(at - border[:-1], size) + np.arange(border[-1])].tobytes()
        c.cache.add(hashes[new], *c.encode_segments(raw, border))
    where = c.cache.find(hashes)[back]
    count = c.cache.size[where]
    out = c.cache.flat[np.repeat(c.cache.at[where] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    first = np.searchsorted(start, offsets)
    return out, tk.sums_by(count, first), tk.sums_by((~c.cache.parity[where]).astype(np.int64), first) == 0


def encode_column(texts: pa.Array, c: Codec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts end to end, their count in each text, round trip and parity. The backend decodes every
    whole text's ids."""
    parts: list[tuple] = [(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool))]
    pairs = lambda xs, ys: np.array([x == y for x, y in zip(xs, ys, strict=True)], bool)
    for piece in tk.slices(texts, 2 << 20):
        raw = piece.data.tobytes()
        edges = piece.offsets.tolist()
        plain = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if c.spec.splittable and raw.find(MARK_BYTES) < 0:
            ids, count, parity = _encode_split(piece, c)
            flat, ends = ids.tolist(), np.cumsum(count).tolist()
            lists, want = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], plain
        else:
            lists, same = c.encode(plain), c.reference.encode(plain, num_threads=1)
            ids, count, parity = np.array([x for one in lists for x in one], np.int32), np.fromiter(map(len, lists), np.int64, len(lists)), pairs(lists, same)
            want = [c.reference.decode(x) for x in same]  # a normalised text, and a marker is a space
        parts.append((ids, count, pairs(c.decode(lists), want), parity))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file, through Spark where the path is a URI."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, model_path: str, keep: list[str], threads: int = 2) -> DataFrame:
    """``keep`` columns, ``ids`` (array<int>), ``n_tokens``, ``round_trip`` and ``parity`` of every text.

    The driver reads the model and broadcasts its bytes (a vocabulary file of fixed size); each
    Python worker builds the backend once. A null or empty text has no ids. ``round_trip``: the backend
    decodes the ids to the text (where the model normalises texts, to what the SentencePiece library
    decodes). ``parity``: the SentencePiece library gives the same ids: for each of the text's segments, where no
    piece of the model crosses a space, else for the whole text. Rows are encoded one by one, repeats too,
    texts of any length whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_model(spark, model_path))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, threads)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, count, trip, parity = encode_column(part.column("text"), c)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), lists, pa.array(count), pa.array(trip), pa.array(parity)],
                    [*keep, "ids", "n_tokens", "round_trip", "parity"],
                )

    text = [] if "text" in keep else ["text"]
    return docs.select(*keep, *text).mapInArrow(run, f"{fields}, ids array<int>, n_tokens bigint, round_trip boolean, parity boolean")


def decode_ids(encoded: DataFrame, model_path: str, keep: list[str], threads: int = 2) -> DataFrame:
    """``keep`` columns and ``text`` of every ``ids`` array; null or empty ids give an empty text."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(read_model(spark, model_path))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, threads)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [x or [] for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(c.decode(ids), pa.string())], [*keep, "text"])

    return encoded.select(*keep, "ids").mapInArrow(run, f"{fields}, text string")
