"""N-gram Jaccard join by PartEnum signatures.

Documents are sets of word shingles. Linked sets of a size band differ in at most k elements. The
shingle domain is dealt into first-level parts, and each part into ``SUBPARTS`` second-level ones. With
more than k/2 parts, linked sets differ in at most one element of some part, so they agree on all but
one of its second-level parts. For each part every subset of all second-level parts but one is
enumerated; a signature is a hash of the set's elements in such a subset, and linked sets share one.
Elements that all fall into a few parts leave too few subsets with elements; such small sets have
their smallest shingles as signatures too, of which linked sets share one in any case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .storage import Scratch

U64 = np.uint64
PART_SEED, BAND_SEED, FALLBACK = U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25), U64(0x3C79AC492BA7B653)
SUBPARTS = 3


@dataclass(frozen=True)
class JoinParams:
    """shingle: words in a shingle. percent: two sets link when 100 * intersection >= percent * union.
    growth: ratio of a size band's borders. spare: first-level parts as a multiple of those needed.
    block: signatures that a task gathers before it sends them. together: first-level parts of a band whose
    signatures are matched together, so that a set has few rows. bucket: signatures that are matched at
    once, about; where a band has more, they are dealt out by their hashes."""

    shingle: int = 5
    percent: int = 75
    growth: float = 1.35
    spare: float = 1.1
    block: int = 400_000
    together: int = 16
    bucket: int = 2_000_000


# ---------------------------------------------------------------- shingle sets


def by_group(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Order by (group, value) for groups below 2**32: a fast sort by value, then radix passes by group."""
    order = np.argsort(value)
    order = order[np.argsort((group[order] & 0xFFFF).astype(np.uint16), kind="stable")]
    if len(group) and group.max() > 0xFFFF:
        order = order[np.argsort((group[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def shingle_sets(piece: tk.Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and their borders (n+1 entries)."""
    data = tk.LOWER[piece.data]
    found = tk.words(piece)
    hashes = tk.mix(tk.PrefixHash(data).raw(found.start, found.end) + (found.end - found.start).astype(U64))
    grams = tk.gram_hashes(hashes, size)
    doc = found.doc[: len(grams)]
    whole = doc == found.doc[size - 1 :] if len(grams) else np.empty(0, bool)
    grams, doc = grams[whole], doc[whole]
    short = np.flatnonzero((found.per_doc > 0) & (found.per_doc < size))
    if len(short):
        one = tk.run_hashes(hashes, found.first[short], found.first[short + 1])
        grams, doc = np.concatenate([grams, one]), np.concatenate([doc, short])
    order = by_group(doc, grams)
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(piece.n + 1))


# ---------------------------------------------------------------- signatures


def most_different(total: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of linked sets whose sizes sum to ``total``."""
    need = -(-percent * total // (100 + percent))  # smallest intersection
    return total - 2 * need


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Of linked sets, the first so many elements in any common order have one in common."""
    return n - -(-percent * n // 100) + 1


class Bands:
    """Size bands and their parts. A set belongs to its own band and to each higher one that holds
    sizes it can link to. Identical sets are known beforehand: bands of sets that link only to identical
    ones have no signatures."""

    def __init__(self, largest: int, p: JoinParams):
        low = [1]
        while low[-1] <= largest * 100 // p.percent + 1:
            low.append(max(low[-1] + 1, int(low[-1] * p.growth)))
        self.p = p
        self.low = np.array(low, np.int64)
        self.high = np.append(self.low[1:] - 1, self.low[-1])
        k = np.max([most_different(np.maximum(2 * self.high - d, 2), p.percent) for d in range(8)], axis=0)
        self.parts = np.ceil(p.spare * (k // 2 + 1)).astype(np.int64) + (k > 2)

    def needed(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Largest difference between a set of size n and a linked one in the band, n the smaller, or
        n in the band and the larger."""
        partner = np.minimum(self.high[band], n * 100 // self.p.percent)
        return np.max([most_different(np.maximum(n + partner - d, 2), self.p.percent) for d in range(8)], axis=0)

    def entries(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, band, largest difference) of all sets of size n > 0 that can link to another set there."""
        own = np.searchsorted(self.low, n, side="right") - 1
        last = np.searchsorted(self.low, n * 100 // self.p.percent, side="right") - 1
        count = np.where(n > 0, last - own + 1, 0)
        doc = np.repeat(np.arange(len(n)), count)
        band = own[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        k = self.needed(n[doc], band)
        return doc[k > 0], band[k > 0], k[k > 0]


def signatures(grams: np.ndarray, first: np.ndarray, bands: Bands) -> tuple[np.ndarray, ...]:
    """Signatures of sets: for each (set, band) entry its set, band, least number ``t`` of signatures
    that it shares with a linked set, and first signature (n+1 entries); and all signatures, with the
    first-level part of each (-1: none).

    A part with elements in two or three second-level parts has three subsets with elements. Linked sets
    share all three where they agree, one where they differ by one element; with S such parts and at
    most k differences that is 3S-2k, or 2S-k if k is no less than S. Entries for which this is below one have
    their smallest shingles as signatures too."""
    n = np.diff(first)
    doc, band, k = bands.entries(n)
    size = n[doc]
    at = np.repeat(first[doc] - np.cumsum(size) + size, size) + np.arange(size.sum())
    entry = np.repeat(np.arange(len(doc)), size)
    h = tk.mix(grams[at] ^ PART_SEED)
    cells = (SUBPARTS * bands.parts[band]).astype(U64)
    cell = ((h >> U64(32)) * cells[entry]) >> U64(32)  # part * SUBPARTS + second-level part
    key = (entry.astype(U64) << U64(32)) | cell
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    total = np.add.reduceat(tk.mix(h[order] + BAND_SEED), head) if len(head) else np.empty(0, U64)
    key = key[head]
    owner, cell = (key >> U64(32)).astype(np.int64), (key & U64(0xFFFFFFFF)).astype(np.int64)
    part = owner * (1 << 32) + cell // SUBPARTS
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(part))))
    sums = np.zeros((len(begin), SUBPARTS), U64)  # of each second-level part's elements; 0 without any
    sums[row, cell % SUBPARTS] = total
    filled = sums != 0
    seed = tk.mix((cell[begin] // SUBPARTS).astype(U64) * PART_SEED + band[owner[begin]].astype(U64) * BAND_SEED)
    sig = np.stack([tk.mix(sums.sum(axis=1) - sums[:, x] + seed + U64(x)) for x in range(SUBPARTS)], axis=1)
    has = filled.sum(axis=1)[:, None] > filled  # the subset without second-level part x holds elements
    count = has.sum(axis=1)
    sig_owner, sig_part = np.repeat(owner[begin], count), np.repeat(cell[begin] // SUBPARTS, count)
    sig = sig[has]
    sure = np.bincount(owner[begin], has.all(axis=1), len(doc)).astype(np.int64)
    t = np.where(k < sure, 3 * sure - 2 * k, 2 * sure - k)
    low = np.flatnonzero(t < 1)
    if len(low):
        m = prefix_length(n[doc[low]], bands.p.percent)
        at = np.repeat(first[doc[low]] - np.cumsum(m) + m, m) + np.arange(m.sum())
        owner = np.repeat(low, m)
        sig = np.concatenate([sig, tk.mix(grams[at] ^ FALLBACK ^ tk.mix(band[owner].astype(U64)))])
        sig_owner, sig_part = np.concatenate([sig_owner, owner]), np.concatenate([sig_part, np.full(len(owner), -1)])
        order = np.argsort(sig_owner, kind="stable")
        sig, sig_owner, sig_part = sig[order], sig_owner[order], sig_part[order]
    return doc, band, t, np.searchsorted(sig_owner, np.arange(len(doc) + 1)), sig, sig_part


# ---------------------------------------------------------------- candidate pairs


LOCAL, STAR, ENTRY, BLOB = 1, 2, 3, 4
ROW = "kind int, a bigint, b bigint, band int, t int, n int, bucket bigint, ids binary, bands binary, ts binary, counts binary, sigs binary, marks binary"
_ROW_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 6
_ROW_NAMES = [x.split()[0] for x in ROW.split(", ")]
FOUND = "kind int, a bigint, b bigint, band int, t int, n int"


def _rows(kind: int, count: int, /, **columns) -> pa.RecordBatch:
    out = []
    for name, type_ in zip(_ROW_NAMES, _ROW_TYPES, strict=True):
        if name == "kind":
            out.append(pa.array(np.full(count, kind, np.int32)))
        elif name in columns:
            out.append(pa.array(columns[name], type_))
        else:
            out.append(pa.nulls(count, type_))
    return pa.RecordBatch.from_arrays(out, _ROW_NAMES)


def _found(kind: int, count: int, /, **columns) -> pa.Table:
    return pa.Table.from_batches([_rows(kind, count, **columns).select(["kind", "a", "b", "band", "t", "n"])])


def _unique_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = a != b
    keep[1:] &= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


class _Groups:
    """Rows in the order of their signatures, and the groups of rows with one signature: those of two rows or
    more, and those with a row in ``hot``, which stands for rows elsewhere. ``member``: the rows of groups;
    ``star``: for each the row of its group with the smallest id; ``leader``: these rows."""

    def __init__(self, sig: np.ndarray, id_: np.ndarray, hot: np.ndarray | None = None):
        self.order = np.argsort(sig)
        s = sig[self.order]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
        size = np.diff(np.append(head, len(s)))
        several = size > 1
        if hot is not None and len(s):
            several |= np.maximum.reduceat(hot[self.order], head)
        self.member = self.order[np.repeat(several, size)]
        size = size[several]
        ids, begin = id_[self.member], np.cumsum(size) - size
        least = np.minimum.reduceat(ids, begin) if len(begin) else ids
        group = np.repeat(np.arange(len(size)), size)
        at = np.flatnonzero(ids == least[group])
        at = at[np.unique(group[at], return_index=True)[1]]
        self.leader = self.member[at]
        self.star = self.leader[group]


class _Block:
    """Signatures of the sets that a task has read since it last wrote."""

    def __init__(self, p: JoinParams, splits: dict[int, int]):
        self.p, self.splits = p, splits
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0
        self.seen: set[int] = set()

    def add(self, ids: np.ndarray, grams: np.ndarray, first: np.ndarray) -> None:
        # of identical sets one is signed; they are linked beforehand
        content = tk.mix(tk.sums_by(tk.signed(grams), first).view(U64)) + tk.sums_by(tk.signed(tk.mix(grams)), first).view(U64)
        new = np.zeros(len(ids), bool)
        new[np.unique(content, return_index=True)[1]] = True
        new &= np.fromiter((x not in self.seen for x in content.tolist()), bool, len(content))
        self.seen.update(content.tolist())
        if not new.all():
            grams = grams[np.repeat(new, np.diff(first))]
            ids, first = ids[new], np.concatenate([[0], np.cumsum(np.diff(first)[new])])
        n = np.diff(first)
        bands = Bands(int(n.max(initial=1)), self.p)
        doc, band, t, begin, sig, part = signatures(grams, first, bands)
        count = np.diff(begin)
        split = np.array([self.splits.get(x, 1) for x in range(int(band.max(initial=0)) + 1)], np.uint64)
        of = np.repeat(band, count)
        bucket = tk.mix(of.astype(U64) * BAND_SEED + (part // self.p.together + 1).astype(U64) * PART_SEED + (sig >> U64(40)) % split[of])
        self.parts.append((ids[doc], band.astype(np.int32), t.astype(np.int32), count, sig, bucket))
        self.size += len(sig)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        ids, band, t, count, sig, bucket = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size, self.seen = [], 0, set()
        entry = np.repeat(np.arange(len(ids), dtype=np.int32), count)
        # a group within the block: its row of the smallest id stands for it from here on
        groups = _Groups(sig, ids[entry])
        a, b = _unique_pairs(ids[entry[groups.star]], ids[entry[groups.member]])
        spread = lambda k: np.arange(k) % 1000
        if len(a):
            yield _rows(LOCAL, len(a), a=a, b=b, bucket=spread(len(a)))
        hot_count = np.bincount(entry[groups.member], minlength=len(ids))
        has = np.flatnonzero(hot_count)
        if len(has):
            yield _rows(ENTRY, len(has), a=ids[has], band=band[has], t=t[has], n=hot_count[has].astype(np.int32), bucket=spread(len(has)))
        mark = np.zeros(len(sig), bool)
        mark[groups.leader] = True
        keep = np.ones(len(sig), bool)
        keep[groups.member] = False
        keep |= mark
        entry, sig, mark, bucket = entry[keep], sig[keep], mark[keep], bucket[keep]
        names, place = np.unique(bucket, return_inverse=True)
        order = np.argsort(place * len(ids) + entry)
        entry, sig, mark, place = entry[order], sig[order], mark[order], place[order]
        border = np.searchsorted(place, np.arange(len(names) + 1))
        rows: dict[str, list] = {k: [] for k in ("bucket", "ids", "bands", "ts", "counts", "sigs", "marks")}
        for i, name in enumerate(tk.signed(names).tolist()):
            x, y = border[i], border[i + 1]
            own, number = np.unique(entry[x:y], return_counts=True)
            blobs = {
                "ids": ids[own], "bands": band[own].astype(np.int16), "ts": t[own], "counts": number.astype(np.int32),
                "sigs": (sig[x:y] & U64(0xFFFFFFFF)).astype(np.uint32), "marks": np.flatnonzero(mark[x:y]).astype(np.int32),
            }
            rows["bucket"].append(name)
            for k, v in blobs.items():
                rows[k].append(v.tobytes())
            if len(rows["bucket"]) == 16:
                yield _rows(BLOB, 16, **rows)
                rows = {k: [] for k in rows}
        if rows["bucket"]:
            yield _rows(BLOB, len(rows["bucket"]), **rows)


def _match_bucket(table: pa.Table) -> pa.Table:
    """Candidates among all blocks' signatures of one bucket, and the candidates that blocks have found."""
    is_blob = pc.equal(table.column("kind"), BLOB)
    out = [table.filter(pc.invert(is_blob)).select(["kind", "a", "b", "band", "t", "n"])]
    table = table.filter(is_blob)
    if not table.num_rows:
        return out[0]
    get = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
    ids, band, t, counts = (np.concatenate(get(k, d)) for k, d in (("ids", np.int64), ("bands", np.int16), ("ts", np.int32), ("counts", np.int32)))
    sigs = get("sigs", np.uint32)
    shift = np.cumsum([0, *map(len, sigs)])
    sig = np.concatenate(sigs)
    hot = np.zeros(len(sig), bool)
    for at, marks in zip(shift, get("marks", np.int32), strict=False):
        hot[at + marks] = True
    entry = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    groups = _Groups(sig, ids[entry], hot)
    a, b = _unique_pairs(ids[entry[groups.star]], ids[entry[groups.member]])
    out.append(_found(STAR, len(a), a=a, b=b))
    cold = groups.member[~hot[groups.member]]  # marked rows were counted in their block
    count = np.bincount(entry[cold], minlength=len(ids))
    has = np.flatnonzero(count)
    # an entry's rows of several blocks or buckets are added up later
    out.append(_found(ENTRY, len(has), a=ids[has], band=band[has].astype(np.int32), t=t[has], n=count[has].astype(np.int32)))
    return pa.concat_tables(out)


def band_splits(sizes: list[tuple[int, int]], p: JoinParams) -> dict[int, int]:
    """Into how many a band's buckets are dealt, from the number of sets by size (smallest size of a class of
    sizes, sets)."""
    if not sizes:
        return {}
    bands = Bands(max(n for n, _ in sizes) * 2, p)
    out = {}
    for i, (low, high) in enumerate(zip(bands.low.tolist(), bands.high.tolist(), strict=True)):
        sets = sum(k for n, k in sizes if n * 1.25 >= low * p.percent / 100 and n <= high)
        out[i] = sets * min(int(bands.parts[i]), p.together) * SUBPARTS // p.bucket + 1
    return out


def candidates(texts: DataFrame, sizes: list[tuple[int, int]], p: JoinParams, scratch: Scratch) -> DataFrame:
    """Rows of kind LOCAL and STAR (candidate pairs a, b: members of a signature's group with its smallest
    id, in a block and between blocks) and ENTRY (a's number n of signatures that others share in a band, with
    its t) for ``texts`` (id, text), whose sets have about these ``sizes``."""
    splits = band_splits(sizes, p)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(p, splits)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for piece in tk.slices(batch.column("text")):
                block.add(ids[piece.first : piece.first + piece.n], *shingle_sets(piece, p.shingle))
                if block.size >= p.block:
                    yield from block.flush()
        yield from block.flush()

    found = texts.mapInArrow(sign, ROW).groupBy("bucket").applyInArrow(_match_bucket, FOUND)
    return scratch.keep(found, "candidates")


# ---------------------------------------------------------------- verification


def sets_of(texts: DataFrame, p: JoinParams) -> DataFrame:
    """(id, grams) of ``texts`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tk.slices(batch.column("text")):
                grams, first = shingle_sets(piece, p.shingle)
                ids = batch.column("id").slice(piece.first, piece.n)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tk.signed(grams)))], ["id", "grams"])

    return texts.mapInArrow(run, "id bigint, grams array<bigint>")


def bitmaps(grams: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each set a bitmap of 2 to 4 bits an element: the lowest bits of the hashes that it holds."""
    n = np.diff(first)
    bits = np.maximum(64, 2 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(bits)])
    doc = np.repeat(np.arange(len(n)), n)
    flags = np.zeros(begin[-1], np.uint8)
    flags[begin[doc] + (grams & (bits[doc] - 1).astype(U64)).astype(np.int64)] = 1
    packed = np.packbits(flags).tobytes()
    return [packed[x // 8 : y // 8] if k else None for x, y, k in zip(begin[:-1].tolist(), begin[1:].tolist(), n.tolist(), strict=True)]


def _bits(column: pa.Array, rows: np.ndarray, size: int, to: int) -> np.ndarray:
    """The bitmaps of ``rows``, all of ``size`` bytes, folded to ``to`` bytes (both are powers of two)."""
    data, offsets = tk.utf8_buffers(column)
    return np.bitwise_or.reduce(data[offsets[rows][:, None] + np.arange(size)].reshape(len(rows), -1, to), axis=1)


def may_link(na: np.ndarray, nb: np.ndarray, xa: pa.Array, xb: pa.Array, percent: int) -> np.ndarray:
    """False only where sets can't link: a bit that one has alone is an element that it has alone."""
    la, lb = (np.diff(tk.utf8_buffers(x)[1]) for x in (xa, xb))
    out = np.zeros(len(na), bool)
    for size_a, size_b in np.unique(np.stack([la, lb], axis=1), axis=0).tolist():
        size = min(size_a, size_b)
        every = np.flatnonzero((la == size_a) & (lb == size_b))
        for rows in np.array_split(every, len(every) * (size_a + size_b) // (4 << 20) + 1):
            x, y = _bits(xa, rows, size_a, size), _bits(xb, rows, size_b, size)
            only_a, only_b = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (x & ~y, y & ~x))
            both = np.minimum(na[rows] - only_a, nb[rows] - only_b)
            out[rows] = 100 * both >= percent * (na[rows] + nb[rows] - both)
    return out


def possible(pairs: DataFrame, maps: DataFrame, p: JoinParams) -> DataFrame:
    """``pairs`` (a, b) without those whose bitmaps (id, n, bits) show that they can't link."""
    left = maps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = maps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = may_link(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), batch.column("xa"), batch.column("xb"), p.percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a bigint, b bigint")


def verify(pairs: DataFrame, sets: DataFrame, p: JoinParams) -> DataFrame:
    """``pairs`` (a, b) whose sets link exactly."""
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ga, gb = batch.column("ga"), batch.column("gb")
            va, vb = ga.flatten().to_numpy(), gb.flatten().to_numpy()
            na, nb = (np.asarray(pc.list_value_length(x)) for x in (ga, gb))
            row = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
            value = np.concatenate([va, vb])
            order = by_group(row, value)
            value, row = value[order], row[order]
            same = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
            both = np.bincount(row[1:][same], minlength=len(na))
            linked = 100 * both >= p.percent * (na + nb - both)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(batch.slice(at, 500) for at in range(0, batch.num_rows, 500))

    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "ga", "gb").mapInArrow(sliced, "a bigint, b bigint").distinct()


def unresolved(stars: DataFrame, full: DataFrame, failed: DataFrame) -> DataFrame:
    """Ids whose links the stars may miss. ``failed``: pairs (a < b) of ``stars`` whose ends are in different
    components; ``full``: ids with as many shared signatures as a link needs.

    Linked sets share at least t signatures (both), so both are in ``full``; and they are in one
    component already if each links to its group's first set, directly or by its block's first. Left
    over are sets with a failed link on that way."""
    bad = stars.join(failed.select(F.col("a").alias("low"), F.col("b").alias("high")), (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high")), "left_semi")
    direct = bad.select(F.col("b").alias("id"))
    heads = bad.where(F.col("kind") == STAR).select(F.col("b").alias("a")).distinct()
    under = stars.where(F.col("kind") == LOCAL).join(heads, "a", "left_semi").select(F.col("b").alias("id"))
    return direct.unionByName(under).distinct().join(full, "id", "left_semi")


def search(rest: DataFrame, full: DataFrame, label: DataFrame, texts: DataFrame, p: JoinParams, scratch: Scratch) -> DataFrame:
    """Links (a, b) of the sets in ``rest`` to sets of other components in ``full``, which holds them.

    Shingles are ordered by rarity. Linked sets have one in common among so many of the first of each that
    the rest can't make the overlap that a link needs; at their first common one, what follows in both still
    can. Sets are joined on such shingles, with that condition on the places, and the pairs verified."""
    sets = sets_of(texts.join(full.hint("merge"), "id", "left_semi"), p).join(label, "id", "left")
    sets = scratch.keep(sets.select("id", "grams", F.coalesce("component_id", "id").alias("component")), "full")
    scratch.settle()
    n, percent = F.size("grams"), F.lit(p.percent)
    each = sets.select("id", "component", n.alias("n"), F.explode("grams").alias("gram"))
    count = each.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # a shingle of one set alone comes before all others and is nobody's common one: it is left out, and its place counted
    prefix = (
        each.join(count, "gram").groupBy("id", "component", "n")
        .agg(F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("grams"))
        .withColumn("alone", F.col("n") - F.size("grams"))
        .withColumn("grams", F.slice("grams", F.lit(1), F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - F.col("alone"))))
        .select("id", "component", "n", "alone", F.posexplode(F.transform("grams", lambda x, i: F.struct(x["gram"].alias("gram"), F.get("grams", i - 1)["gram"].alias("before")))).alias("at", "x"))
        .select("id", "component", "n", (F.col("alone") + F.col("at")).alias("place"), "x.gram", "x.before")
    )
    prefix = scratch.keep(prefix, "prefix")
    scratch.settle()
    side = lambda x: (F.col("id").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"), F.col("before").alias(f"b{x}"))
    left = prefix.join(rest, "id", "left_semi").select("gram", *side("x"))
    right = prefix.select(F.col("gram").alias("same"), *side("y"))
    follow = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    may = (100 + percent) * follow >= percent * (F.col("nx") + F.col("ny"))
    may &= F.coalesce(F.col("bx") != F.col("by"), F.lit(True))  # else the one before is common, too
    pairs = left.join(right, (F.col("gram") == F.col("same")) & (F.col("cx") != F.col("cy")) & may)
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    found = scratch.keep(verify(pairs, sets.select("id", "grams"), p), "searched")
    scratch.forget(prefix, sets)
    return found


def join_documents(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    ``docs``: doc_id (of an integer type), text; other columns are ignored. A text's set: distinct
    shingles of its words, A-Z lower-cased; with fewer words the whole sequence as one shingle; null,
    empty and blank texts have an empty set and link with nothing. Long texts are taken whole, a slice
    of memory each. component_id is the smallest doc_id reachable by links, itself included, so ties
    don't arise; null for a null doc_id. Rows that repeat an id are one document that has the links of
    each; every row gets a result row. An empty table gives no rows.

    Identical sets are linked to their smallest id; of those in a block one is signed, and its pairs go over to
    the smallest id. Signatures are gathered in numpy; one that several sets of a block share leaves it as
    one entry with star pairs, so a group with a third of all documents is one entry for each block at a
    bucket. Candidates are verified on whole sets; sets that stars can't settle are joined on their
    rarest shingles with all that can have such links. No link between components is missed; links within a
    component aren't counted.
    """
    p = params
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"), "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tk.slices(batch.column("text")):
                grams, first = shingle_sets(piece, p.shingle)
                n = np.diff(first)
                one = tk.sums_by(tk.signed(grams), first)
                two = tk.sums_by(tk.signed(tk.mix(grams)), first)
                ids = batch.column("doc_id").slice(piece.first, piece.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(one), pa.array(two), pa.array(bitmaps(grams, first), pa.binary())], ["doc_id", "n", "one", "two", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sizes = scratch.keep(docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, n bigint, one bigint, two bigint, bits binary"), "sizes")
    sets = sizes.where("n > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"), "n", "one", "two")
    classes = scratch.keep(sets.groupBy("n", "one", "two").agg(F.min("id").alias("rep"), F.max("id").alias("last")), "classes")
    several = classes.where("rep < last").drop("last")
    copies = scratch.keep(sets.join(several, ["n", "one", "two"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "copies")
    by_size = classes.groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()  # some hundred rows at most
    scratch.forget(classes)
    scratch.settle()
    found = candidates(texts, [(r.n, r.k) for r in by_size], p, scratch)
    scratch.settle()
    stars = scratch.keep(_to_representatives(found.where(F.col("kind") != ENTRY).select("kind", "a", "b").distinct(), copies), "stars")
    full = found.where(F.col("kind") == ENTRY).groupBy("a", "band").agg(F.sum("n").alias("n"), F.min("t").alias("t")).where("n >= t").select("a").distinct()
    full = scratch.keep(_representative(full, copies, "a").select(F.col("a").alias("id")).distinct(), "full")
    scratch.forget(found)
    pairs = scratch.keep(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    maps = sizes.where("n > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"), "n", "bits")
    scratch.settle()
    likely = scratch.keep(possible(pairs, maps, p).distinct(), "likely")
    scratch.settle()
    wanted = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    grams = scratch.keep(sets_of(texts.join(wanted.hint("merge"), "id", "left_semi"), p), "sets")
    scratch.settle()
    # first one pair for each set; then only pairs whose ends aren't in one component by then
    nearest = likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    one = scratch.keep(verify(nearest, grams, p), "nearest")
    scratch.settle()
    label = components(copies.unionByName(one), scratch)
    apart = scratch.keep(_apart(likely, label), "apart")
    scratch.settle()
    rest_links = scratch.keep(verify(apart, grams, p), "links")
    scratch.forget(grams, likely, apart)
    scratch.settle()
    # what is linked by now stays so as links to its smallest id, which take few rounds
    label = components(_star(label).unionByName(rest_links), scratch)
    # a pair is settled when its ends are in one component
    rest = scratch.keep(unresolved(stars, full, _apart(pairs, label)), "unresolved")
    scratch.forget(stars, pairs, rest_links)
    scratch.settle()
    if not rest.isEmpty():
        searched = search(rest, full, label, texts, p, scratch)
        scratch.settle()
        label = components(_star(label).unionByName(searched), scratch)
        scratch.forget(searched)
    scratch.forget(copies, one, rest, full)
    return (
        sizes.withColumn("id", F.col("doc_id").cast("bigint"))
        .join(label, "id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    )


def _star(label: DataFrame) -> DataFrame:
    """Links (a, b) of each id to its component's smallest one."""
    return label.where("id <> component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b"))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends have different components; an id without a label is its own."""
    for end in ("a", "b"):
        of = label.select(F.col("id").alias(end), F.col("component_id").alias(f"c{end}"))
        pairs = pairs.join(of, end, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _representative(rows: DataFrame, copies: DataFrame, column: str) -> DataFrame:
    """``rows`` with ids in ``column`` that are copies replaced by their representatives."""
    of = copies.groupBy("b").agg(F.min("a").alias("rep")).withColumnRenamed("b", "copy")
    return rows.join(of, rows[column] == of["copy"], "left").withColumn(column, F.coalesce("rep", column)).drop("rep", "copy")


def _to_representatives(stars: DataFrame, copies: DataFrame) -> DataFrame:
    return _representative(_representative(stars, copies, "a"), copies, "b").where("a <> b").distinct()
