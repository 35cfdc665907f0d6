"""Quality rules: text statistics and cross-document line frequency."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .storage import Scratch

U64 = np.uint64
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
NEWLINE = 10


@dataclass(frozen=True)
class QualityRules:
    """min_words, max_repeat_percent: a text fails with fewer words, or when more than this share of
    its words lies in windows of ``window`` words that the text holds at least twice.
    line_docs, line_share: a normalised line is boilerplate of its host when it is in more than
    line_docs distinct documents and in more than line_share of the host's distinct documents with words.
    keep_words, keep_share: a document is depleted when fewer words, or a smaller share of its
    words, are left without boilerplate lines."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    line_docs: int = 100
    line_share: float = 0.02
    keep_words: int = 20
    keep_share: float = 0.3


STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
LINES = "array<struct<line:bigint,words:int>>"


def _repeat_words(hashes: np.ndarray, found: tk.Words, window: int) -> np.ndarray:
    """For each document, its words that lie in windows found at least twice in it."""
    n = len(hashes)
    grams = tk.gram_hashes(hashes, window)
    whole = found.doc[: len(grams)] == found.doc[window - 1 :] if len(grams) else np.empty(0, bool)
    at = np.flatnonzero(whole)
    keys = tk.mix(grams[at] + found.doc[at].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return tk.sums_by((np.cumsum(edge[:-1]) > 0).astype(np.int64), found.first)


def text_stats(column: pa.Array, window: int) -> tuple[dict[str, np.ndarray], list]:
    """The statistics of every text, and its distinct normalised lines as (hash, words) lists.

    A normalised line is its lower-cased words in order; lines without a word are left out."""
    parts: dict[str, list[np.ndarray]] = {k.split()[0]: [] for k in STATS.split(", ")}
    all_lines: list[np.ndarray] = []
    all_words: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for piece in tk.slices(column):
        found = tk.words(piece)
        data, first = piece.data, found.first
        hashes = tk.word_hashes(piece, found, lower=False)
        starts_char = (data & 0xC0) != 0x80
        chars = np.concatenate([[0], np.cumsum(starts_char & ~tk.IS_SPACE[data])])
        symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
        bounds = piece.offsets
        # lines: a boundary after each newline and at each document's start
        breaks = np.unique(np.concatenate([bounds, np.flatnonzero(data == NEWLINE) + 1]))
        line_start, line_end = breaks[:-1], breaks[1:]
        if len(line_end):
            line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == NEWLINE))
        w0, w1 = np.searchsorted(found.start, line_start), np.searchsorted(found.start, line_end)
        solid = w1 > w0
        line_start, line_end, w0, w1 = line_start[solid], line_end[solid], w0[solid], w1[solid]
        doc = found.doc[w0] if len(w0) else np.empty(0, np.int64)
        raw = tk.mix(tk.PrefixHash(data).raw(line_start, line_end) + (line_end - line_start).astype(U64))
        exact = tk.mix(raw + doc.astype(U64) * U64(0x9E3779B97F4A7C15))
        _, head = np.unique(exact, return_index=True)
        dup = np.ones(len(exact), np.int64)
        dup[head] = 0
        by_doc = np.searchsorted(doc, np.arange(piece.n + 1))
        parts["n_words"].append(found.per_doc)
        parts["word_chars"].append(chars[bounds[1:]] - chars[bounds[:-1]])
        parts["n_symbols"].append(symbols[bounds[1:]] - symbols[bounds[:-1]])
        parts["n_dup_lines"].append(tk.sums_by(dup, by_doc))
        parts["n_repeat_words"].append(_repeat_words(hashes, found, window))
        lowered = tk.word_hashes(piece, found, lower=True)
        norm = tk.run_hashes(lowered, w0, w1)
        all_lines.append(tk.signed(norm))
        all_words.append((w1 - w0).astype(np.int32))
        counts.append(np.diff(by_doc))
    cat = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.empty(0, kind)
    stats = {k: cat(v, np.int64) for k, v in parts.items()}
    offsets = np.concatenate([[0], np.cumsum(cat(counts, np.int64))]).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(cat(all_lines, np.int64)), pa.array(cat(all_words, np.int32))], ["line", "words"])
    return stats, pa.ListArray.from_arrays(pa.array(offsets), items)


def with_stats(docs: DataFrame, keep: list[str], window: int) -> DataFrame:
    """``keep`` columns, the statistics and ``lines`` of each text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                stats, lines = text_stats(part.column("text"), window)
                columns = [part.column(k) for k in keep] + [pa.array(v) for v in stats.values()] + [lines]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *stats, "lines"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, {STATS}, lines {LINES}")


def _judged(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """The result of ``judge_documents`` with ``host`` and ``content``, a hash of the whole text."""
    content = F.coalesce(F.xxhash64("text"), F.lit(0)).alias("content")
    base = with_stats(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("host"), content),
        ["row", "doc_id", "host", "content"], rules.window,
    )
    base = Scratch(docs.sparkSession, "quality").keep(base, "stats")  # read four times below
    base = base.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))
    each = base.select("row", "host", "content", F.explode("lines").alias("x")).select("row", "host", "content", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    sizes = base.where(F.size("lines") > 0).select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    frequent = (
        each.select("host", "line", "content").distinct()
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("line_docs")).where(F.col("line_docs") > rules.line_docs)
        .join(sizes, "host")
        .where(F.col("line_docs") > rules.line_share * F.col("host_docs"))
        .select("host", "line")
    )
    removed = each.join(frequent, ["host", "line"], "left_semi").groupBy("row").agg(F.sum("words").alias("removed_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < rules.keep_words) | (left < rules.keep_share * F.col("n_words")))
    return (
        base.drop("lines")
        .join(removed, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .drop("row")
    )


def judge_documents(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Statistics and verdict of every document.

    ``docs``: doc_id, text, source (the host; null is a host of its own); other columns are ignored.
    Rows are judged one by one, so a repeated doc_id gives one result row for each.

    A text without words (null, empty, blanks) has zeros and fails. ``base_failed``: fewer than
    ``min_words`` words, or too many words in repeated windows. For the line rule, each normalised
    line is counted once for each distinct document of its host; documents are distinct by a hash of
    their whole text, so exact copies count once and near copies each. All documents with words are
    counted, failed ones too. A line that is just at a limit stays. Boilerplate lines are removed from every document of the
    host, all their repeats; ``removed_words`` are their words.
    Counts are summed on the map side at both levels, so a line that a third of a host's documents
    hold is a few rows for each task; its join back is a plain equi-join that AQE can split. Long
    texts are taken whole, one at a time where they exceed a slice. An empty table gives no rows.

    Returns doc_id, the statistics, base_failed, removed_words, kept.
    """
    return _judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def keep_documents(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that ``judge_documents`` keeps, unchanged and with all columns, in any number
    of repeats and with null ids too: rows of one doc_id, text and source have one verdict."""
    kept = _judged(docs, rules).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("host").alias("kept_host"), F.col("content").alias("kept_content")).distinct()
    of = docs.withColumn("kept_of", F.struct(F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("host"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("content")))
    same = of["doc_id"].eqNullSafe(kept["kept_id"]) & (of["kept_of"]["host"] == kept["kept_host"]) & (of["kept_of"]["content"] == kept["kept_content"])
    return of.join(kept.hint("merge"), same, "left_semi").select(*docs.columns)
