"""Log-bilinear language model of two levels, trained in numpy with noise-contrastive estimation.

log10 P(text) = sum over tokens of log10 P(class | two previous classes) + log10 P(word | class, previous
class). Both levels are log-bilinear: a context vector times the vectors of what may follow, a softmax
over all classes, and in a class a softmax over its frequent words and one slot for its other words. All
contexts' scores are batched matrix products, so token probabilities are normalised exactly. Words of
a class's last slot share it by corpus counts with half a count added, and half a count there is for
unseen words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .storage import Scratch

U64 = np.uint64
END_HASH = -(2**63)  # the end token; no word hashes to it but by chance
TRAILING = np.zeros(256, bool)
TRAILING[list(b".,;:!?\"')")] = True
ENDINGS = 1 << 16


@dataclass(frozen=True)
class LMParams:
    """top: the most frequent words have a class each. groups: classes of the other words, found by
    clustering word endings by the frequent word before them. vocabulary: the most frequent words, which
    have vectors of their own. known: words whose counts every task holds in memory (16 bytes each), about
    and at most; rarer words are looked up by a join. dim, noise, batch, steps, rate: of the log-bilinear
    models and their NCE training, which draws n-grams from the counts of all class trigrams, and of all
    words after a class, of the training texts."""

    top: int = 31
    groups: int = 32
    vocabulary: int = 8000
    known: int = 500_000
    dim: int = 24
    noise: int = 16
    batch: int = 4096
    steps: int = 1500
    rate: float = 0.2
    seed: int = 11

    @property
    def classes(self) -> int:
        return self.top + self.groups + 1

    @property
    def end_class(self) -> int:
        return self.classes - 1


@dataclass
class Tokens:
    """Tokens of a slice with the end token after each text; ``first`` has n+1 entries."""

    hash: np.ndarray
    ending: np.ndarray
    is_end: np.ndarray
    first: np.ndarray


def tokens(piece: tk.Slice) -> Tokens:
    data = tk.LOWER[piece.data]
    found = tk.words(piece)
    hashes = tk.signed(tk.mix(tk.PrefixHash(data).raw(found.start, found.end) + (found.end - found.start).astype(U64)))
    last = found.end.copy()
    for _ in range(3):  # up to three closing marks are not part of an ending
        last -= ((last - found.start) > 1) & TRAILING[data[last - 1]] if len(last) else 0
    low = data[last - 1].astype(np.int64) if len(last) else np.empty(0, np.int64)
    high = np.where(last - found.start > 1, data[np.maximum(last - 2, 0)], 0).astype(np.int64) if len(last) else low
    first = found.first + np.arange(piece.n + 1)
    n = len(found.start) + piece.n
    is_end = np.zeros(n, bool)
    is_end[first[1:] - 1] = True
    out = Tokens(np.full(n, END_HASH), np.full(n, -1), is_end, first)
    out.hash[~is_end] = hashes
    out.ending[~is_end] = high * 256 + low
    return out


def training(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5 is not 1; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 != 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, ending, n) over all texts; the end token counts too. Each task sums its words
    in numpy first, so a frequent word is a row for each slice before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tk.slices(batch.column("text"), 4 << 20):
                t = tokens(piece)
                h, head, n = np.unique(t.hash, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(t.ending[head].astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "ending", "n"])

    return docs.select("text").mapInArrow(run, "word bigint, ending int, n bigint").groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Classes:
    """Class and slot of every word. ``words``: sorted hashes of the frequent words, with their class (-1: by
    the ending) and slot; ``ending_class``: a class for each ending; ``slot_class``: the class of each slot,
    those of a class side by side; ``rest``: the slot of a class's other words, -1 for classes of one word."""

    words: np.ndarray
    word_class: np.ndarray
    word_slot: np.ndarray
    ending_class: np.ndarray
    end_class: int
    slot_class: np.ndarray
    rest: np.ndarray

    def of(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Class and slot of each token; slot -1 in classes of one word."""
        out = np.where(t.is_end, self.end_class, self.ending_class[t.ending])
        slot = np.full(len(out), -1)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, t.hash), len(self.words) - 1)
            hit = (self.words[at] == t.hash) & ~t.is_end
            out = np.where(hit & (self.word_class[at] >= 0), self.word_class[at], out)
            slot = np.where(hit, self.word_slot[at], -1)
        return out, np.where(slot < 0, self.rest[out], slot)


def assign(top: np.ndarray, vocabulary: np.ndarray, endings: np.ndarray, ending_class: np.ndarray, params: LMParams) -> Classes:
    """``top`` words have classes of their own; those of ``vocabulary``, whose endings are given, slots in the
    classes of their endings."""
    groups = np.arange(params.top, params.top + params.groups)
    owner = np.concatenate([ending_class[endings], groups])  # the rest slots come last
    order = np.argsort(owner, kind="stable")
    slot = np.empty(len(owner), np.int64)
    slot[order] = np.arange(len(owner))
    rest = np.full(params.classes, -1)
    rest[groups] = slot[len(vocabulary) :]
    words = np.concatenate([top, vocabulary])
    word_class = np.concatenate([np.arange(len(top)), np.full(len(vocabulary), -1)])
    word_slot = np.concatenate([np.full(len(top), -1), slot[: len(vocabulary)]])
    by_hash = np.argsort(words)
    return Classes(words[by_hash], word_class[by_hash], word_slot[by_hash], ending_class, params.end_class, owner[order], rest)


def _cells(docs: DataFrame, cells: int, count) -> DataFrame:
    """(cell, n): sum of ``count(slice)`` over all texts; each task adds up ``cells`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for piece in tk.slices(batch.column("text"), 4 << 20):
                count(piece, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return docs.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def _dense(found: pa.Table | pa.RecordBatch, cells: int) -> np.ndarray:
    out = np.zeros(cells)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def cluster_endings(counts: np.ndarray, groups: int) -> np.ndarray:
    """Group of each ending by weighted k-means over square roots of the shares of the word before
    (endings x contexts counts); endings that were never seen get group 0."""
    weight = counts.sum(axis=1)
    seen = np.flatnonzero(weight)
    out = np.zeros(len(counts), np.int64)
    if len(seen) == 0:
        return out
    points = np.sqrt((counts[seen] + 0.1 * counts.sum(axis=0) / counts.sum()) / (weight[seen] + 0.1)[:, None])
    order = np.argsort(-weight[seen], kind="stable")
    centre = points[order[:groups]].copy()
    for _ in range(25):
        group = np.argmax(points @ centre.T - 0.5 * (centre**2).sum(axis=1), axis=1)
        for g in range(len(centre)):
            mine = group == g
            if mine.any():
                centre[g] = np.average(points[mine], axis=0, weights=weight[seen][mine])
    out[seen] = group
    return out


@dataclass
class LogBilinear:
    """score(c | a, b) = q_c . (r_a * A + r_b * B) + bias_c, with word vectors r, q and a matrix for
    each context position."""

    r: np.ndarray
    q: np.ndarray
    far: np.ndarray
    near: np.ndarray
    bias: np.ndarray

    def log_probs(self) -> np.ndarray:
        """log10 P(c | a, b), normalised, as (classes, classes, classes) float32."""
        n = len(self.r)
        context = (self.r @ self.far)[:, None, :] + (self.r @ self.near)[None, :, :]
        logits = (context.reshape(n * n, -1) @ self.q.T + self.bias).astype(np.float64)
        peak = logits.max(axis=1, keepdims=True)
        norm = peak + np.log(np.exp(logits - peak).sum(axis=1, keepdims=True))
        return ((logits - norm) / np.log(10)).astype(np.float32).reshape(n, n, n)


def train_nce(trigrams: np.ndarray, params: LMParams) -> LogBilinear:
    """Noise-contrastive estimation with class frequencies as noise, by AdaGrad on batches drawn
    in proportion to the trigram counts (flat, classes**3)."""
    n, d, k = params.classes, params.dim, params.noise
    rng = np.random.default_rng(params.seed)
    freq = trigrams.reshape(n * n, n).sum(axis=0) + 0.5
    noise = freq / freq.sum()
    model = LogBilinear(rng.normal(0, 0.1, (n, d)), rng.normal(0, 0.1, (n, d)), np.eye(d), np.eye(d), np.log(noise))
    cells = np.flatnonzero(trigrams)
    if len(cells) == 0:
        return model
    upto = np.cumsum(trigrams[cells])
    noise_upto = np.cumsum(noise)
    log_kq = np.log(k * noise)
    grads = {name: np.full(getattr(model, name).shape, 1e-3) for name in ("r", "q", "far", "near", "bias")}
    for step in range(params.steps):
        drawn = cells[np.searchsorted(upto, rng.random(params.batch) * upto[-1], side="right")]
        a, b, c = drawn // (n * n), drawn // n % n, drawn % n
        words = np.concatenate([c[:, None], np.minimum(np.searchsorted(noise_upto, rng.random((params.batch, k))), n - 1)], axis=1)
        ra, rb = model.r[a], model.r[b]
        context = ra @ model.far + rb @ model.near
        q = model.q[words]
        margin = np.einsum("bd,bkd->bk", context, q) + model.bias[words] - log_kq[words]
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        error[:, 0] -= 1
        error /= params.batch
        d_context = np.einsum("bk,bkd->bd", error, q)
        flat = words.ravel()
        place = flat * params.batch + np.repeat(np.arange(params.batch), k + 1)
        by_word = np.bincount(place, error.ravel(), n * params.batch).reshape(n, params.batch)
        pick_a, pick_b = (np.equal.outer(np.arange(n), x).astype(float) for x in (a, b))
        d_r = pick_a @ d_context @ model.far.T + pick_b @ d_context @ model.near.T
        moves = {"r": d_r, "q": by_word @ context, "far": ra.T @ d_context, "near": rb.T @ d_context, "bias": by_word.sum(axis=1)}
        rate = params.rate * min(1.0, 2 * (1 - step / params.steps))
        for name, g in moves.items():
            grads[name] += g * g
            setattr(model, name, getattr(model, name) - rate * g / np.sqrt(grads[name]))
    return model


def train_words(pairs: np.ndarray, slot_class: np.ndarray, params: LMParams) -> np.ndarray:
    """log10 P(slot | its class, previous class), (classes, slots) float32, from the counts (classes, slots): a
    log-bilinear model by NCE with the class's own word frequencies as noise."""
    n, slots, d, k = params.classes, len(slot_class), params.dim, params.noise
    rng = np.random.default_rng(params.seed + 1)
    freq = pairs.sum(axis=0) + 0.5
    edge = np.flatnonzero(np.concatenate([[True], slot_class[1:] != slot_class[:-1]]))
    size = np.diff(np.append(edge, slots))
    group = np.repeat(np.arange(len(edge)), size)
    noise = freq / np.add.reduceat(freq, edge)[group]
    log_kq = np.log(k * noise)
    r, q, bias = rng.normal(0, 0.1, (n, d)), rng.normal(0, 0.1, (slots, d)), np.log(noise)
    cells = np.flatnonzero(pairs)
    upto = np.cumsum(pairs.ravel()[cells])
    noise_upto = np.cumsum(noise)
    begin = noise_upto[edge] - noise[edge]
    seen = [np.full(x.shape, 1e-3) for x in (r, q, bias)]
    add = lambda at, rows, count: np.stack([np.bincount(at, rows[:, x], count) for x in range(d)], axis=1)
    for step in range(params.steps if len(cells) else 0):
        drawn = cells[np.minimum(np.searchsorted(upto, rng.random(params.batch) * upto[-1], side="right"), len(cells) - 1)]
        b, w = drawn // slots, drawn % slots
        g = group[w]
        other = np.searchsorted(noise_upto, begin[g][:, None] + rng.random((params.batch, k)))
        words = np.concatenate([w[:, None], np.clip(other, edge[g][:, None], (edge + size - 1)[g][:, None])], axis=1)
        context, follow = r[b], q[words]
        margin = np.einsum("bd,bkd->bk", context, follow) + bias[words] - log_kq[words]
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        error[:, 0] -= 1
        error /= params.batch
        flat = words.ravel()
        moves = (add(b, np.einsum("bk,bkd->bd", error, follow), n), add(flat, (error[:, :, None] * context[:, None, :]).reshape(-1, d), slots), np.bincount(flat, error.ravel(), slots))
        rate = params.rate * min(1.0, 2 * (1 - step / params.steps))
        for x, s, grad in zip((r, q, bias), seen, moves, strict=True):
            s += grad * grad
            x -= rate * grad / np.sqrt(s)
    logits = r @ q.T + bias
    peak = np.maximum.reduceat(logits, edge, axis=1)[:, group]
    norm = np.log(np.add.reduceat(np.exp(logits - peak), edge, axis=1))[:, group] + peak
    return ((logits - norm) / np.log(10)).astype(np.float32)


@dataclass
class LanguageModel:
    """Everything that scoring needs but the counts of rare words."""

    classes: Classes
    log_probs: np.ndarray  # of a class after two classes
    slot_probs: np.ndarray  # of a slot in its class, after a class
    in_rest: np.ndarray  # log10 of the counts in a class's last slot, half a count for unseen words among them
    known: np.ndarray  # sorted hashes of the most frequent words, with their counts
    known_n: np.ndarray
    train_tokens: int
    train_types: int


def frequent_words(counts: DataFrame, params: LMParams) -> pa.Table:
    """The words with counts from a threshold on, the most frequent first: at most ``known`` of them. The
    threshold comes from a histogram of the counts in steps of a sixteenth of a power of two."""
    step = F.floor(F.log2(F.col("n")) * 16)
    bars = sorted(((r.step, r.words) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    total, least = 0, 1 << 20
    for at, words in bars:
        total += words
        if total > params.known:
            break
        least = at
    found = counts.where(step >= least).toArrow()
    order = np.lexsort((found.column("word").to_numpy(), -found.column("n").to_numpy()))
    return found.take(pa.array(order))


def train_levels(cells: DataFrame, slot_class: np.ndarray, params: LMParams) -> tuple[np.ndarray, np.ndarray]:
    """Both levels' tables, trained in one executor task, which is retried elsewhere if its executor is
    lost. ``cells``: counts of trigrams of classes, then of slots after classes; their number is bounded."""
    n, slots = params.classes, len(slot_class)

    def fit_both(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return train_nce(table[: n**3], params).log_probs(), train_words(table[n**3 :].reshape(n, slots), slot_class, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n**3 + n * slots)
        for batch in batches:
            total += _dense(batch, len(total))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in fit_both(total)], ["classes", "slots"])

    # counts are added up before they meet in one task, which reads a row for each cell
    got = cells.repartition(1).mapInArrow(run, "classes binary, slots binary").first()
    if got is None:
        return fit_both(np.zeros(n**3 + n * slots))
    return np.frombuffer(got.classes, np.float32).reshape(n, n, n), np.frombuffer(got.slots, np.float32).reshape(n, slots)


def fit(docs: DataFrame, params: LMParams, scratch: Scratch) -> tuple[LanguageModel, DataFrame]:
    """The model and the table of all word counts, from the texts of ``docs``."""
    counts = scratch.keep(word_counts(docs), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    known = frequent_words(counts, params)
    word, n, ending = (known.column(k).to_numpy() for k in ("word", "n", "ending"))
    is_word = np.flatnonzero(ending >= 0)
    top, more = is_word[: params.top], is_word[params.top : params.top + params.vocabulary]
    nothing = np.empty(0, np.int64)
    first = assign(word[top], nothing, nothing, np.full(ENDINGS, params.top), params)

    def endings(piece: tk.Slice, out: np.ndarray) -> None:
        t = tokens(piece)
        c, _ = first.of(t)
        before = np.concatenate([[params.end_class], c[:-1]])
        before = np.where(before == params.end_class, params.top + 1, before)
        use = c == params.top
        out += np.bincount(t.ending[use] * (params.top + 2) + before[use], minlength=len(out))

    seen = _dense(_cells(docs, ENDINGS * (params.top + 2), endings).toArrow(), ENDINGS * (params.top + 2))
    grouped = cluster_endings(seen.reshape(ENDINGS, -1)[:, : params.top], params.groups) + params.top
    classes = assign(word[top], word[more], ending[more], grouped, params)
    slots = len(classes.slot_class)

    def both(piece: tk.Slice, out: np.ndarray) -> None:
        c, slot = classes.of(tokens(piece))
        cell = _context(c, params)
        out[: params.classes**3] += np.bincount(cell, minlength=params.classes**3)
        use = slot >= 0
        near = cell[use] // params.classes % params.classes
        out[params.classes**3 :] += np.bincount(near * slots + slot[use], minlength=params.classes * slots)

    log_probs, slot_probs = train_levels(_cells(docs, params.classes**3 + params.classes * slots, both), classes.slot_class, params)
    sums = counts.where(F.col("ending") >= 0).groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()  # at most 65536 rows
    mass = np.full(params.classes, 0.5)
    np.add.at(mass, grouped[sums.column("ending").to_numpy()], sums.column("n").to_numpy() + 0.5 * sums.column("v").to_numpy())
    own = np.concatenate([top, more])
    np.subtract.at(mass, grouped[ending[own]], n[own] + 0.5)
    order = np.argsort(word)
    return LanguageModel(classes, log_probs, slot_probs, np.log10(mass), word[order], n[order], int(total.n), int(total.v)), counts


def _context(c: np.ndarray, params: LMParams) -> np.ndarray:
    """Flat trigram cell of every token. A text's first token follows two end tokens; what stands
    before the end of the previous text is not seen."""
    n, end = params.classes, params.end_class
    near = np.concatenate([[end], c[:-1]])
    far = np.concatenate([[end], near[:-1]])
    far = np.where(near == end, end, far)
    return (far * n + near) * n + c


PARTIAL = "n_tokens bigint, n_known bigint, base double, model double, rare array<struct<word:bigint,n:int>>"


def _score_slice(piece: tk.Slice, m: LanguageModel, params: LMParams) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    t = tokens(piece)
    c, slot = m.classes.of(t)
    cell = _context(c, params)
    model = m.log_probs.reshape(-1)[cell].astype(np.float64)
    model += np.where(slot >= 0, m.slot_probs[cell // params.classes % params.classes, slot], 0.0)
    count = np.zeros(len(t.hash), np.int64)
    rare = np.ones(len(t.hash), bool)
    if len(m.known):
        uniq, back = np.unique(t.hash, return_inverse=True)
        at = np.minimum(np.searchsorted(m.known, uniq), len(m.known) - 1)
        hit = m.known[at] == uniq
        count, rare = np.where(hit, m.known_n[at], 0)[back], ~hit[back]
    share = np.where(rare, 0.0, np.log10(count + 0.5))
    in_rest = (slot >= 0) & (slot == m.classes.rest[c])
    model += np.where(in_rest, share - m.in_rest[c], 0.0)
    # a rare word is no frequent one, so it is in its class's last slot; the end token, rare only without
    # training texts, has no share
    model -= np.where(rare & t.is_end, np.log10(0.5), 0.0)
    doc = np.repeat(np.arange(piece.n), np.diff(t.first))
    at = np.flatnonzero(rare)
    key = np.stack([doc[at], t.hash[at]], axis=1)
    pair, n = np.unique(key, axis=0, return_counts=True) if len(at) else (key, np.empty(0, np.int64))
    sums = [np.diff(t.first), tk.sums_by((~rare).astype(np.int64), t.first), tk.sums_by(share, t.first), tk.sums_by(model, t.first)]
    return sums, pair[:, 1], n.astype(np.int32), np.bincount(pair[:, 0], minlength=piece.n)


def score_texts(docs: DataFrame, params: LMParams = LMParams()) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text; other columns are ignored).

    Learns from the rows that ``training`` marks. A null text is empty: its one token is the end.
    Rows are scored one by one, repeats included; a null id counts as ''. Without training rows all counts
    are zero, and the model is near uniform noise, normalised too. Words are told apart by a 64-bit
    hash; of words with equal counts those with the smaller hash count as more frequent. Long texts are
    taken whole; an empty table gives no rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    texts = docs.select("doc_id", "text")
    model, counts = fit(texts.where(training(F.col("doc_id"))), params, scratch)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by params.known, params.vocabulary and params.classes
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sums, words, ns, sizes = [[] for _ in range(4)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
                for piece in tk.slices(part.column("text")):
                    s, w, n, size = _score_slice(piece, m, params)
                    for all_, one in zip(sums, s, strict=True):
                        all_.append(one)
                    words.append(w)
                    ns.append(n)
                    sizes.append(size)
                if not sums[0]:
                    continue
                items = pa.StructArray.from_arrays([pa.array(np.concatenate(words)), pa.array(np.concatenate(ns))], ["word", "n"])
                rare = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), *(pa.array(np.concatenate(x)) for x in sums), rare],
                    ["row", "doc_id", "n_tokens", "n_known", "base", "model", "rare"],
                )

    partial = scratch.keep(
        texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, f"row bigint, doc_id {kind}, {PARTIAL}"), "partial"
    )
    rest = (
        partial.select("row", F.explode("rare").alias("x"))
        .select("row", F.col("x.word").alias("word"), F.col("x.n").alias("k"))
        .join(counts.select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more_known"),
            F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"),
        )
    )
    norm = float(np.log10(model.train_tokens + 0.5 * (model.train_types + 1)))
    return (
        partial.drop("rare")
        .join(rest, "row", "left")
        .na.fill(0, ["more_known"])
        .na.fill(0.0, ["more"])
        .select(
            "doc_id",
            (~training(F.col("doc_id"))).alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.col("more_known")).alias("n_known"),
            F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
            (F.col("base") + F.col("more") - F.col("n_tokens") * norm).alias("base_score"),
            (F.col("model") + F.col("more")).alias("score"),
        )
    )
