"""Substring dedup by a logarithmic family of sampled suffix arrays.

Of each text, suffixes are sampled at minimisers: in every window of ``length`` bytes the k-byte string
with the smallest hash (the leftmost of equals). Equal windows have the same minimiser at the same
place, so two equal strings of ``length`` bytes always share a sampled suffix. A batch's suffix array is
its sampled suffixes in the byte order of their leading k bytes, those with one context (``span``, the bytes
of all windows that a sample stands for) counted together. Batches enter the family one by one: a
batch's array is merged with those of all levels in byte order, and neighbours whose common prefix has
k bytes are matches; levels of equal size are merged, so a suffix is rewritten a logarithmic number of
times. Contexts that the levels count twice are removed whole; of different contexts of a
matching suffix, windows are compared to find the exact matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .storage import Scratch

U64 = np.uint64
PLACE_BITS = U64(31)
LAST_ID = 2**63 - 1


@dataclass(frozen=True)
class SuffixParams:
    """length: bytes of a match. lead: bytes that order sampled suffixes. batches, batch_bytes: the least
    number of insertions into the index, and the bytes of text of one. share: contexts of one suffix that are
    compared in one task; of a suffix with more, each task passes on what it holds once. bucket: windows
    compared in one task, about."""

    length: int = 200
    lead: int = 24
    batches: int = 3
    batch_bytes: int = 1 << 38
    share: int = 20_000
    bucket: int = 1_000_000


# ---------------------------------------------------------------- sampling


def _window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by block prefix and suffix minima."""
    n = len(values)
    size = -(-n // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, U64)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def sample(piece: tk.Slice, p: SuffixParams) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of a slice: document, first and last window that the sample stands for (bytes
    from the document's begin), the suffix's place, and a hash of all bytes of those windows."""
    n, length = len(piece.data), p.length
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none, none
    prefix = tk.PrefixHash(piece.data)
    at = np.arange(n - p.lead + 1)
    lead = tk.mix(prefix.raw(at, at + p.lead))
    ranked = (lead >> PLACE_BITS << PLACE_BITS) | at.astype(U64)
    place = (_window_min(ranked, length - p.lead + 1) & U64((1 << 31) - 1)).astype(np.int64)
    sizes = np.diff(piece.offsets)
    edge = np.zeros(n + 1, np.int64)
    whole = sizes >= length
    np.add.at(edge, piece.offsets[:-1][whole], 1)
    np.add.at(edge, piece.offsets[1:][whole] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    anchor = place[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(window)) - 1
    first, last, anchor = window[head], window[tail], anchor[head]
    doc = np.searchsorted(piece.offsets, first, side="right") - 1
    # empty documents share their offset with the next; searchsorted gives the last of them, which owns the bytes
    begin = piece.offsets[doc]
    span = tk.mix(prefix.raw(first, last + length) + (anchor - first).astype(U64) * U64(0x9E3779B97F4A7C15) + (last - first).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    return doc, first - begin, last - begin, anchor - begin, tk.signed(span)


OCCURRENCE = "id bigint, content bigint, first int, last int, at int, lead binary, span bigint"


def occurrences(texts: DataFrame, p: SuffixParams) -> DataFrame:
    """Sampled suffixes of ``texts`` (id, content, text); ``at`` is the suffix's place after ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, content = batch.column("id").to_numpy(), batch.column("content").to_numpy()
            for piece in tk.slices(batch.column("text")):
                doc, first, last, place, span = sample(piece, p)
                begin = piece.offsets[doc] + place
                lead = np.lib.stride_tricks.sliding_window_view(piece.data, p.lead)[begin] if len(begin) else np.empty((0, p.lead), np.uint8)
                doc = doc + piece.first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc]), pa.array(content[doc]), *(pa.array(x.astype(np.int32)) for x in (first, last, place - first)), _binaries(lead), pa.array(span)],
                    ["id", "content", "first", "last", "at", "lead", "span"],
                )

    return texts.mapInArrow(run, OCCURRENCE)


def _binaries(rows: np.ndarray) -> pa.Array:
    """Each row of a byte matrix as a binary value."""
    n, size = rows.shape
    offsets = pa.py_buffer((np.arange(n + 1) * size).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


# ---------------------------------------------------------------- index family


LEVEL = "lead binary, span bigint, n bigint"


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows of two byte matrices."""
    return np.minimum.accumulate(a == b, axis=1).sum(axis=1)


class SuffixFamily:
    """Levels of suffix arrays in the shared folder: (lead, span, n) in byte order within the slices that the
    first bytes of the leads are dealt to. A level of rank r holds 2**r batches; there is at most one of
    each rank."""

    def __init__(self, scratch: Scratch, p: SuffixParams):
        self.scratch, self.p = scratch, p
        self.levels: dict[int, str] = {}

    def _read(self, path: str) -> DataFrame:
        return self.scratch.spark.read.schema(LEVEL).parquet(path)

    def _ordered(self, rows: DataFrame) -> DataFrame:
        """Suffixes with a long common prefix begin alike, so they meet in one slice."""
        return rows.repartition(F.substring("lead", 1, min(8, self.p.lead))).sortWithinPartitions("lead", "span")

    def _merge(self, paths: list[str]) -> str:
        """One array from several, written; the old ones go."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest: pa.Table | None = None  # the last (lead, span), which may go on
            for batch in batches:
                table = pa.Table.from_batches([batch])
                table = table if rest is None else pa.concat_tables([rest, table])
                if not table.num_rows:
                    continue
                table = table.combine_chunks()
                lead, span, n = (table.column(k) for k in ("lead", "span", "n"))
                data, _ = tk.utf8_buffers(lead)
                rows, spans = data.reshape(table.num_rows, -1), span.to_numpy()
                head = np.flatnonzero(np.concatenate([[True], (common_prefix(rows[1:], rows[:-1]) < rows.shape[1]) | (spans[1:] != spans[:-1])]))
                out = table.take(pa.array(head)).set_column(2, "n", pa.array(np.add.reduceat(n.to_numpy(), head)))
                rest = out.slice(len(head) - 1)
                yield from out.slice(0, len(head) - 1).to_batches()
            if rest is not None:
                yield from rest.to_batches()

        rows = self._read(paths[0])
        for other in paths[1:]:
            rows = rows.unionByName(self._read(other))
        out = self.scratch.write(self._ordered(rows).mapInArrow(run, LEVEL), "level")
        self.scratch.drop(*paths)
        return out

    def _scan(self, rows: DataFrame) -> DataFrame:
        """(lead) of the suffixes in ``rows`` (lead, span, n, new) that begin like a neighbour, one of them new."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, total, any_new = np.empty((0, 0), np.uint8), 0, 0  # the group that may go on
            for batch in batches:
                if not batch.num_rows:
                    continue
                data, _ = tk.utf8_buffers(batch.column("lead"))
                lead = data.reshape(batch.num_rows, -1)
                n, new = batch.column("n").to_numpy(), batch.column("new").to_numpy()
                if len(last):
                    lead, n, new = np.concatenate([last, lead]), np.concatenate([[total], n]), np.concatenate([[any_new], new])
                head = np.flatnonzero(np.concatenate([[True], common_prefix(lead[1:], lead[:-1]) < lead.shape[1]]))
                totals, news = np.add.reduceat(n, head), np.maximum.reduceat(new, head)
                hit = np.flatnonzero((totals > 1) & (news > 0))
                hit = hit[hit < len(head) - 1]
                yield pa.RecordBatch.from_arrays([_binaries(lead[head[hit]])], ["lead"])
                last, total, any_new = lead[head[-1] :][:1].copy(), int(totals[-1]), int(news[-1])
            if len(last) and total > 1 and any_new:
                yield pa.RecordBatch.from_arrays([_binaries(last)], ["lead"])

        return self._ordered(rows).mapInArrow(run, "lead binary")

    def insert(self, suffixes: DataFrame) -> DataFrame:
        """Add a batch's suffixes (lead, span); returns the leads of the batch that the family or the batch
        itself holds twice or more."""
        path = self.scratch.write(suffixes.groupBy("lead", "span").agg(F.count(F.lit(1)).alias("n")), "batch")
        rows = self._read(path).withColumn("new", F.lit(1))
        for level in self.levels.values():
            rows = rows.unionByName(self._read(level).withColumn("new", F.lit(0)))
        found = self.scratch.keep(self._scan(rows), "repeated")
        rank, paths = 0, [path]
        while rank in self.levels:
            paths.append(self.levels.pop(rank))
            rank += 1
        self.levels[rank] = self._merge(paths)
        self.scratch.settle()
        return found

    def contexts(self, repeated: DataFrame) -> DataFrame:
        """(key, span, n, width) of all levels for the leads in ``repeated``: how often a context occurs, and
        how many different contexts its suffix has. ``key`` is a hash of the lead."""
        levels = [self._read(path) for path in self.levels.values()]
        rows = levels[0]
        for other in levels[1:]:
            rows = rows.unionByName(other)
        rows = rows.join(repeated.hint("merge"), "lead", "left_semi").groupBy("lead", "span").agg(F.sum("n").alias("n"))
        width = rows.groupBy("lead").agg(F.count(F.lit(1)).alias("width"))
        return rows.join(width.hint("merge"), "lead").select(F.xxhash64("lead").alias("key"), "span", "n", "width")


# ---------------------------------------------------------------- different contexts


RUN = "id bigint, content bigint, first int, last int"
SENT = RUN + ", bucket int, known binary, ids binary, contents binary, firsts binary, counts binary, places binary, hashes binary"
_BLOBS = ("ids", "contents", "firsts", "counts", "places", "hashes")


def _runs(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of the runs of consecutive places of an owner; input in that order."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(owner)) - 1
    return owner[head], place[head], place[tail] if len(head) else place[:0]


def _windows(size: np.ndarray, data: np.ndarray, key: np.ndarray, p: SuffixParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of contexts that lie end to end in ``data``: its context, its place there, and a hash of
    its bytes and its suffix's key."""
    count = size - p.length + 1
    owner = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(size) - size, count) + place
    return owner, place, tk.mix(tk.PrefixHash(data).raw(at, at + p.length) ^ tk.mix(key.astype(np.int64).view(U64))[owner])


def _compare(table: pa.Table, p: SuffixParams, buckets: int) -> pa.Table:
    """Compare the contexts (id, content, first, at, key, n, width, bytes) of one bucket: runs of windows that
    different contexts of a suffix share, for contexts that occur once (the others are removed whole). Where
    a suffix's contexts are dealt to several buckets, one of equal windows is sent on: as ``known`` if it is
    held twice, or else with its place."""
    id_, content, first, at, key, n, width = (table.column(k).to_numpy().astype(np.int64) for k in ("id", "content", "first", "at", "key", "n", "width"))
    data, offsets = tk.utf8_buffers(table.column("bytes"))
    owner, place, hashes = _windows(np.diff(offsets), data, key, p)
    wanted = (n == 1)[owner]
    order = np.argsort(hashes)
    s = hashes[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    alone = new & np.append(new[1:], True)
    again = np.zeros(len(hashes), bool)
    again[order[~alone]] = True
    hit = np.flatnonzero(again & wanted)
    who, a, b = _runs(owner[hit], place[hit])
    out = [_sent(id=id_[who], content=content[who], first=first[who] + a, last=first[who] + b, bucket=np.arange(len(who)) % buckets)]
    several = (width > p.share)[owner]
    known = order[new & ~(alone & wanted[order])]
    known = known[several[known]]
    open_ = np.flatnonzero(~again & wanted & several)
    # equal windows have the same distance to the suffix: a context's windows are dealt in a few stretches
    def bucket(x: np.ndarray) -> np.ndarray:
        of = owner[x]
        stretch = ((at[of] - place[x] + p.length) // 32).astype(U64)
        split = hashes[x] % (width[of] // p.share + 1).astype(U64)
        return (tk.mix(key[of].view(U64) + stretch * U64(0x9E3779B97F4A7C15) + split * U64(0xC2B2AE3D27D4EB4F)) % U64(buckets)).astype(np.int64)

    known_bucket, open_bucket = bucket(known), bucket(open_)
    known_order, open_order = np.argsort(known_bucket, kind="stable"), np.argsort(open_bucket, kind="stable")
    known, open_ = known[known_order], open_[open_order]
    names = np.union1d(known_bucket, open_bucket)
    known_at, open_at = (np.searchsorted(np.sort(x), np.append(names, buckets)) for x in (known_bucket, open_bucket))
    rows: dict[str, list] = {k: [] for k in ("bucket", "known", *_BLOBS)}
    for i, name in enumerate(names.tolist()):
        mine = open_[open_at[i] : open_at[i + 1]]
        who, number = np.unique(owner[mine], return_counts=True)
        blobs = (hashes[known[known_at[i] : known_at[i + 1]]], id_[who], content[who], first[who].astype(np.int32), number.astype(np.int32), place[mine].astype(np.uint16), hashes[mine])
        rows["bucket"].append(name)
        for k, v in zip(("known", *_BLOBS), blobs, strict=True):
            rows[k].append(v.tobytes())
    out.append(_sent(**rows))
    return pa.Table.from_batches(out)


def _sent(**columns) -> pa.RecordBatch:
    count = len(columns["bucket"])
    out = []
    for name, kind in (x.split() for x in SENT.split(", ")):
        type_ = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind]
        out.append((name, pa.array(columns[name], type_) if name in columns else pa.nulls(count, type_)))
    return pa.RecordBatch.from_arrays([x for _, x in out], [k for k, _ in out])


def _match(table: pa.Table) -> pa.Table:
    """Runs of windows that different buckets hold, and the runs that were found in one."""
    columns = [x.split()[0] for x in RUN.split(", ")]
    is_run = pa.compute.is_valid(table.column("id"))
    found = table.filter(is_run).select(columns)
    table = table.filter(pa.compute.invert(is_run))
    if not table.num_rows:
        return found
    get = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
    known, hashes = get("known", U64), get("hashes", U64)
    id_, content, first, count, place = get("ids", np.int64), get("contents", np.int64), get("firsts", np.int32), get("counts", np.int32), get("places", np.uint16).astype(np.int32)
    every = np.concatenate([hashes, known])
    order = np.argsort(every)
    s = every[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    twice = np.zeros(len(every), bool)
    twice[order[~(new & np.append(new[1:], True))]] = True
    at = np.flatnonzero(twice[: len(hashes)])
    who, a, b = _runs(np.repeat(np.arange(len(id_)), count)[at], place[at])
    more = pa.table({"id": id_[who], "content": content[who], "first": first[who] + a, "last": first[who] + b}, schema=pa.schema([(k, found.schema.field(k).type) for k in columns]))
    return pa.concat_tables([found, more])


def matches(texts: DataFrame, cand: DataFrame, p: SuffixParams, scratch: Scratch) -> DataFrame:
    """(id, content, first, last): runs of windows of ``texts`` whose bytes also begin elsewhere. ``cand``:
    their sampled suffixes that match others, with what the levels say of their contexts."""
    whole = cand.where("n > 1").select("id", "content", "first", "last")
    fields = ("first", "last", "at", "key", "n", "width")
    mixed = cand.where("width > 1")
    # of a context that occurs more often, one occurrence shows the others what is known
    shown = mixed.where("n > 1").groupBy("key", "span").agg(F.min(F.struct("id", "content", *(k for k in fields if k != "key"))).alias("x")).select("x.id", "x.content", "x.first", "x.last", "x.at", "key", "x.n", "x.width")
    mixed = mixed.where("n = 1").select("id", "content", *fields).unionByName(shown.select("id", "content", *fields))
    wanted = scratch.keep(mixed.groupBy("id", "content").agg(F.collect_list(F.struct(*fields)).alias("rows"), F.sum(F.col("last") - F.col("first") + 1).alias("windows")), "contexts")
    scratch.settle()
    total = wanted.agg(F.sum("windows")).first()[0] or 0
    buckets = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), total // p.bucket + 1)
    dealt = F.pmod(F.xxhash64("id", "content", "first"), F.floor(F.col("width") / p.share) + 1)
    contexts = (
        texts.join(wanted.drop("windows").hint("merge"), ["id", "content"])
        .select("id", "content", F.col("text").cast("binary").alias("raw"), F.explode("rows").alias("x"))
        .select("id", "content", "x.*", F.expr(f"substring(raw, x.first + 1, x.last - x.first + {p.length})").alias("bytes"))
        .withColumn("bucket", F.pmod(F.xxhash64("key", dealt), F.lit(buckets)))
    )
    sent = contexts.groupBy("bucket").applyInArrow(lambda table: _compare(table, p, buckets), SENT)
    return whole.unionByName(sent.groupBy("bucket").applyInArrow(_match, RUN))


def _removed(size: int, first: list[int], last: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte ranges of a text."""
    if not first:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(first)
    a, b = np.array(first, np.int64)[order], np.maximum.accumulate((np.array(last, np.int64) + length)[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    head = np.flatnonzero(new)
    return a[head], b[np.append(head[1:], len(a)) - 1]


def dedup_bytes(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (binary) of every document.

    ``docs``: doc_id, text; other columns are ignored. Every byte that lies in a string of
    ``params.length`` bytes that begins anywhere else too, in the same document or another, is
    removed; all its occurrences go. A null text is empty; shorter texts lose nothing; rows that repeat
    an id and text are documents of their own and lose everything that is long enough. An empty
    table gives no rows.

    What is shuffled are sampled suffixes, about one for 90 bytes. Counts are combined on the map side, so a
    suffix that a third of the texts hold in one context is a few rows; in many contexts, they are
    dealt out by ``share`` to tasks, each of which passes on of equal windows one, in stretches and by their
    hashes. Contexts and windows are compared by 64-bit hashes. Long texts are taken whole; a doc_id must be
    of an integer type.
    """
    p = params
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    key = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("content")]
    texts = docs.where("text IS NOT NULL").select(*key, "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(p.batches, -(-size // p.batch_bytes))
    batch = F.pmod(F.xxhash64("content", "id"), F.lit(batches)).cast("int")
    path = f"{scratch.base}/occurrences"
    occurrences(texts, p).withColumn("batch", batch).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    found = spark.read.schema(OCCURRENCE + ", batch int").parquet(path)
    family = SuffixFamily(scratch, p)
    repeated = None
    for i in range(batches):
        hits = family.insert(found.where(F.col("batch") == i).select("lead", "span"))
        repeated = hits if repeated is None else repeated.unionByName(hits)
    spans = scratch.keep(family.contexts(repeated.distinct()), "spans")
    scratch.drop(*family.levels.values())
    scratch.settle()
    found = found.withColumn("key", F.xxhash64("lead")).drop("batch", "lead")
    cand = scratch.keep(found.join(spans.where("n > 1 OR width > 1").hint("merge"), ["key", "span"]), "matched")
    scratch.drop(path)
    scratch.forget(spans)
    scratch.settle()
    runs = matches(texts, cand, p, scratch)
    marks = scratch.keep(runs.groupBy("id", "content").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last")), "marks")
    scratch.forget(*(x for x, _ in scratch.kept if x is not marks))
    scratch.settle()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data, offsets = tk.utf8_buffers(part.column("text"))
                out: list[list] = [[], [], [], [], []]
                for i, (first, last) in enumerate(zip(part.column("first").to_pylist(), part.column("last").to_pylist(), strict=True)):
                    text = data[offsets[i] : offsets[i + 1]]
                    a, b = _removed(len(text), first or [], last or [], p.length)
                    edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
                    kept = b"".join(text[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True))
                    for all_, one in zip(out, (len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        all_.append(one)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = docs.select("doc_id", "text", *key).join(marks.hint("merge"), ["id", "content"], "left").select("doc_id", "text", "first", "last")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
