"""Toxicity: averaged subword embeddings under a linear softmax, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

U64 = np.uint64
BEGIN, END, WHOLE = U64(0x51ED270B0A2F3C41), U64(0x2545F4914F6CDD1D), U64(0x1B873593CC9E2D51)


@dataclass(frozen=True)
class ToxicityParams:
    """max_rows: the training sample holds at most so many labelled texts, whole, those with the smallest hash
    of their id, whatever the corpus size.
    buckets, dim: embedding table. grams: lengths of the byte n-grams. window: words averaged at once;
    a text scores as its worst window, so that length doesn't dilute it. warm: full-batch steps on about
    warm_windows windows with their text's label; then ``rounds`` times ``steps`` on each text's worst window as it
    stands. rate: of AdaGrad."""

    max_rows: int = 10000
    buckets: int = 1 << 18
    dim: int = 16
    grams: tuple[int, ...] = (3, 4, 5)
    window: int = 16
    warm: int = 10
    warm_windows: int = 8000
    rounds: int = 30
    steps: int = 10
    rate: float = 0.5
    seed: int = 7


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray, params: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the subwords of each word data[start:end], and where each word's ids begin
    (n+1 entries). Subwords: the whole word, its byte n-grams, and those of n-1 bytes at its begin
    and end, marked as such."""
    prefix, n = tk.PrefixHash(data), len(start)
    length = end - start
    owner, ids = [np.arange(n)], [tk.mix(prefix.raw(start, end) + WHOLE)]
    for k in params.grams:
        count = np.maximum(length - k + 1, 0)
        word = np.repeat(np.arange(n), count)
        at = start[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        owner.append(word)
        ids.append(tk.mix(prefix.raw(at, at + k) + U64(k)))
        edge = np.flatnonzero(length >= k - 1)
        owner += [edge, edge]
        ids.append(tk.mix(prefix.raw(start[edge], start[edge] + k - 1) + BEGIN))
        ids.append(tk.mix(prefix.raw(end[edge] - k + 1, end[edge]) + END))
    who = np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    first = np.searchsorted(who[order], np.arange(n + 1))
    return (np.concatenate(ids)[order] % U64(params.buckets)).astype(np.int32), first


def _mean_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return tk.sums_by(values.astype(np.float64), first) / np.maximum(np.diff(first), 1)


@dataclass
class _Bags:
    """Windows of a slice: unique words, each token's unique word, and window borders."""

    ids: np.ndarray
    first: np.ndarray
    word: np.ndarray
    window_first: np.ndarray  # tokens
    doc_window: np.ndarray  # for each document, its first window; n+1 entries


def _bags(piece: tk.Slice, params: ToxicityParams) -> _Bags:
    data = tk.LOWER[piece.data]
    piece = tk.Slice(piece.first, data, piece.offsets)
    found = tk.words(piece)
    hashes = tk.word_hashes(piece, found, lower=False)
    _, head, word = np.unique(hashes, return_index=True, return_inverse=True)
    ids, first = subwords(data, found.start[head], found.end[head], params)
    count = -(-found.per_doc // params.window)
    doc_window = np.concatenate([[0], np.cumsum(count)])
    within = np.arange(doc_window[-1]) - np.repeat(doc_window[:-1], count)
    window_first = np.append(np.repeat(found.first[:-1], count) + within * params.window, len(word))
    return _Bags(ids, first.astype(np.int32), word.astype(np.int32), window_first, doc_window)


def _window_logits(bags: _Bags, bucket_score: np.ndarray) -> np.ndarray:
    return _mean_by(_mean_by(bucket_score[bags.ids], bags.first)[bags.word], bags.window_first)


def _gather(bags: list[_Bags], chosen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chosen windows of all slices as one: bucket ids and their borders by word, each token's
    word, and window borders. Only words that occur in a chosen window are carried."""
    ids, subs, word, size, shift = [], [], [], [], 0
    for b, pick in zip(bags, chosen, strict=True):
        count = (b.window_first[1:] - b.window_first[:-1])[pick]
        token = np.repeat(b.window_first[pick] - np.cumsum(count) + count, count) + np.arange(count.sum())
        used, place = np.unique(b.word[token], return_inverse=True)
        n = (b.first[1:] - b.first[:-1])[used]
        ids.append(b.ids[np.repeat(b.first[used] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        subs.append(n)
        word.append(place + shift)
        size.append(count)
        shift += len(used)
    border = lambda xs: np.concatenate([[0], np.cumsum(np.concatenate(xs))])
    return np.concatenate(ids), border(subs), np.concatenate(word), border(size)


def _worst(values: np.ndarray, first: np.ndarray, empty: float) -> np.ndarray:
    out = np.full(len(first) - 1, empty)
    solid = np.flatnonzero(np.diff(first))
    if len(solid):
        out[solid] = np.maximum.reduceat(values, first[solid])
    return out


@dataclass
class ToxicityModel:
    """Embeddings and softmax. A window's logit margin is linear in its buckets' embeddings, so
    scoring needs one number for each bucket."""

    embedding: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    params: ToxicityParams

    @property
    def bucket_score(self) -> np.ndarray:
        return (self.embedding @ (self.softmax[1] - self.softmax[0])).astype(np.float32)

    @property
    def margin(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(texts: pa.Array, toxic: np.ndarray, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit embeddings and softmax jointly by full-batch AdaGrad. Without texts, or with one class
    only, the model is the smoothed rate of toxic texts."""
    rng = np.random.default_rng(params.seed)
    embedding = rng.standard_normal((params.buckets, params.dim), np.float32) / np.float32(params.dim)
    softmax = rng.standard_normal((2, params.dim), np.float32) / np.float32(params.dim)
    rate = (toxic.sum() + 0.5) / (len(toxic) + 1.0)
    bias = np.array([0.0, np.log(rate / (1 - rate))])
    model = ToxicityModel(embedding, softmax, bias, params)
    if len(np.unique(toxic)) < 2:
        model.embedding[:] = 0
        return model
    bags = [_bags(piece, params) for piece in tk.slices(texts, 1 << 18)]
    at = np.cumsum([0, *(len(b.doc_window) - 1 for b in bags)])
    label = [np.repeat(toxic[i : i + len(b.doc_window) - 1], np.diff(b.doc_window)) for b, i in zip(bags, at, strict=False)]
    windows = max(1, sum(len(b.window_first) - 1 for b in bags))
    seen_e, seen_s, seen_b = np.full(params.buckets, 1e-6), np.full(params.dim, 1e-6), 1e-6
    for turn in range(params.rounds + 1):
        score, margin, chosen = model.bucket_score, model.margin, []
        for b in bags:
            pick = np.arange(len(b.window_first) - 1)
            if not turn:
                pick = pick[rng.random(len(pick)) < params.warm_windows / windows]
            else:
                z = _window_logits(b, score) + margin
                pick = pick[z >= np.repeat(_worst(z, b.doc_window, -np.inf), np.diff(b.doc_window))]
            chosen.append(pick)
        ids, first, word, window_first = _gather(bags, chosen)
        y = np.concatenate([v[c] for v, c in zip(label, chosen, strict=True)])
        size, subs = np.diff(window_first), np.diff(first)
        for _ in range(params.steps if turn else params.warm):
            diff = model.softmax[1] - model.softmax[0]
            z = _mean_by(_mean_by(model.bucket_score[ids], first)[word], window_first) + model.margin
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
            per_word = np.bincount(word, np.repeat(error / np.maximum(size, 1), size), len(subs)) / np.maximum(subs, 1)
            pull = np.bincount(ids, np.repeat(per_word, subs), params.buckets)
            slope = pull @ model.embedding  # of the loss by softmax[1]; softmax[0] has its negative
            length = np.linalg.norm(diff) + 1e-9
            seen_e += (pull * length) ** 2
            seen_s += slope**2
            seen_b += error.sum() ** 2
            hit = np.flatnonzero(pull)
            move = (pull[hit] * params.rate / np.sqrt(seen_e[hit]))[:, None] * diff
            model.embedding[hit] -= move.astype(np.float32)
            step = (params.rate / 10 * slope / np.sqrt(seen_s)).astype(np.float32)
            model.softmax[1] -= step
            model.softmax[0] += step
            model.bias[1] -= params.rate * error.sum() / np.sqrt(seen_b)
    return model


def held_out(doc_id: Column, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder`` modulo 5; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == remainder


def training_sample(docs: DataFrame, labels: DataFrame, params: ToxicityParams) -> DataFrame:
    """At most ``max_rows`` labelled texts of ``docs``, in one partition. Of a repeated label row the worst
    counts; null ids and labels are left out; a repeated doc_id gives each of its texts."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_rows)
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(marks), "doc_id")  # at most max_rows rows of two numbers
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(params.max_rows)
        .select("text", (F.col("toxic") > 0).cast("double").alias("toxic"))
    )


def fit(sample: DataFrame, params: ToxicityParams) -> ToxicityModel:
    """Train in one executor task, which is retried elsewhere if its executor is lost; the model
    (fixed size) comes back to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        texts = pa.concat_arrays([b.column("text").cast(pa.large_string()) for b in got] or [pa.array([], pa.large_string())])
        toxic = np.concatenate([b.column("toxic").to_numpy(zero_copy_only=False) for b in got] or [np.empty(0)])
        model = train(texts, toxic, params)
        blobs = [x.astype(np.float32).tobytes() for x in (model.embedding, model.softmax, model.bias)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], ["embedding", "softmax", "bias"])

    got = sample.coalesce(1).mapInArrow(run, "embedding binary, softmax binary, bias binary").first()
    if got is None:
        return train(pa.array([], pa.string()), np.empty(0), params)
    parts = [np.frombuffer(x, np.float32) for x in got]
    return ToxicityModel(parts[0].reshape(-1, params.dim), parts[1].reshape(2, -1), parts[2], params)


def score_texts(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of every text. A text without words (null, empty,
    blanks) scores as the bias alone. Rows are scored one by one; repeats stay."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.bucket_score, model.margin, model.params))  # 4 bytes a bucket
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_score, margin, params = shared.value
        for batch in batches:
            scores = [np.empty(0)]
            for piece in tk.slices(batch.column("text")):
                bags = _bags(piece, params)
                z = _worst(_window_logits(bags, bucket_score), bags.doc_window, 0.0) + margin
                scores.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(np.concatenate(scores))], [*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, score double")


def judge_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Learn from labelled rows outside the held-out fold, then score every document: doc_id,
    held_out, score, predicted. Only the text is an input of a score; other columns are ignored.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic. Null, empty and blank texts score as the bias alone,
    null ids are outside the held-out fold and not learned from; long texts are taken whole; repeated rows
    get a result row each, and repeated labels count as the worst. A score of exactly 0.5 is predicted toxic.
    Empty documents give no rows; without labels, or with one class, every score is the smoothed rate."""
    ids = docs.select("doc_id", "text")
    model = fit(training_sample(ids.where(~held_out(F.col("doc_id"), 0)), labels, params), params)
    out = score_texts(ids, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
