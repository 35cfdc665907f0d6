import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from pairloom.llm import components, partenum, sentence_spans, storage, suffix_index
from pairloom.llm import textkit as tk
from pairloom.llm.storage import Scratch

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def near_copies(seed, groups, copies, words=40, change=2):
    """Groups of texts that differ from a base in a few words, and texts that share a stock line."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.integers(10**6)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for at in rng.integers(0, words, rng.integers(0, change + 1)):
                text[at] = f"e{rng.integers(10**6)}"
            out.append(" ".join(text))
    stock = " ".join(f"stock{i}" for i in range(12))
    out += [stock + " " + " ".join(f"o{rng.integers(10**6)}" for _ in range(14)) for _ in range(copies)]
    return out


# ---------------------------------------------------------------- Jaccard join


def brute_components(texts):
    sets = {}
    for i, text in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def joined(docs, params=partenum.JoinParams()):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.join_documents(docs, params).collect()}


# block=1 makes a block of every slice
@pytest.mark.parametrize("params", [partenum.JoinParams(), partenum.JoinParams(spare=1.0), partenum.JoinParams(spare=2.0, block=1, bucket=50, together=2)])
def test_components_against_brute_force(make_docs, params):
    texts = near_copies(1, 6, 9) + near_copies(2, 3, 6, words=9, change=1) + ["a b c d", "A B c D", "a b c d e", "", None, "x", "x", "a  b\tc d"]
    docs = make_docs(texts).repartition(5)
    assert joined(docs, params) == brute_components(list(enumerate(texts)))


def test_components_on_sample(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert joined(sample) == brute_components(rows)


def test_chains_link_through(make_docs):
    base = [f"t{i}" for i in range(60)]
    texts = [" ".join([*(f"n{j}" for j in range(2 * i)), *base[2 * i :]]) for i in range(10)]
    got = joined(make_docs(texts))
    assert got == brute_components(list(enumerate(texts))) and {c for _, c in got.values()} == {0}


def test_linked_sets_share_enough_signatures():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 7, 12, 30, 100, 400):
        for _ in range(20):
            a = rng.choice(2**40, n, replace=False)
            drop = rng.integers(0, n // 7 + 1)
            b = np.concatenate([a[drop:], rng.choice(2**40, rng.integers(0, n // 7 + 1))])
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both) or both == len(a) == len(b):
                continue  # identical sets are linked beforehand
            grams = np.concatenate([np.sort(a), np.sort(b)]).astype(np.uint64)
            first = np.array([0, len(a), len(a) + len(b)])
            doc, band, t, begin, sig, _ = partenum.signatures(grams, first, partenum.Bands(500, partenum.JoinParams()))
            best = max(
                len(set(sig[begin[i] : begin[i + 1]].tolist()) & set(sig[begin[j] : begin[j + 1]].tolist())) - max(1, t[i], t[j])
                for i in range(len(doc)) for j in range(len(doc)) if doc[i] == 0 and doc[j] == 1 and band[i] == band[j]
            )
            assert best >= 0


def test_join_odd_rows(odd_docs, no_docs):
    rows = partenum.join_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.component_id == r.doc_id for r in rows if r.doc_id is not None)
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert partenum.join_documents(no_docs).collect() == []


def test_join_leaves_only_tables_that_are_read(spark, make_docs):
    texts = near_copies(1, 4, 6)
    rows = partenum.join_documents(make_docs(texts))
    base = Path([base for _, base in storage._folders if "/jaccard-" in base][-1].removeprefix("file:"))
    left = {x.name.split("-", 1)[1] for x in base.iterdir()}
    assert left <= {"sizes", "edges"} and {r.doc_id: (r.n_shingles, r.component_id) for r in rows.collect()} == brute_components(list(enumerate(texts)))


def test_matching_imports_what_it_calls():
    assert partenum.pc.__name__ == "pyarrow.compute"  # not a submodule of pyarrow that somebody else has imported


def test_component_labels(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{200 + i: 200 for i in range(30)}}


# ---------------------------------------------------------------- suffix family


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mark[i : i + length] = b"\x01" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((len(b), sum(mark), len(re.findall(rb"\x01+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return out


def cut(docs, params):
    rows = suffix_index.dedup_bytes(docs, params).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


@pytest.mark.parametrize("params", [suffix_index.SuffixParams(length=20, lead=6, batches=3), suffix_index.SuffixParams(length=24, lead=24, batches=1, share=1), suffix_index.SuffixParams(length=20, lead=5, batches=5, share=2, bucket=100), suffix_index.SuffixParams(length=20, lead=5, batches=2, batch_bytes=400)])
def test_bytes_against_brute_force(make_docs, params):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abé日 "), n))
    shared = [word(k) for k in (19, 20, 21, 60)]
    texts = [word(rng.integers(0, 80)) + shared[rng.integers(4)] + word(rng.integers(0, 40)) for _ in range(40)]
    texts += ["a" * 19, "a" * 20, "a" * 45, "ab" * 30, "", None, word(30) * 3, texts[0], texts[0]]
    got = cut(make_docs(texts).repartition(4), params)
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, params.length)


def test_levels_merge_geometrically(spark):
    family = suffix_index.SuffixFamily(Scratch(spark, "t"), suffix_index.SuffixParams(lead=4))
    shapes, hits = [], []
    for i in range(5):
        rows = [(b"%04d" % n, i) for n in (i, 100, 200 + i // 2)]
        found = family.insert(spark.createDataFrame(rows, "lead binary, span bigint"))
        hits.append(sorted(int(r.lead) for r in found.collect()))
        shapes.append(sorted(family.levels))
    assert shapes == [[0], [1], [0, 1], [2], [0, 2]]
    assert hits == [[], [100, 200], [100], [100, 201], [100]]
    top = spark.read.parquet(family.levels[2])
    for part in top.rdd.glom().collect():  # byte order within each slice
        assert [bytes(r.lead) for r in part] == sorted(bytes(r.lead) for r in part)
    assert top.count() == 12 and top.agg({"n": "sum"}).first()[0] == 12
    wide = {r.span: r.width for r in family.contexts(spark.createDataFrame([(b"0100",)], "lead binary")).collect()}
    assert wide == dict.fromkeys(range(5), 5)


def test_merge_of_many_rows(spark):
    """Equal suffixes that fall into different Arrow batches are counted together."""
    family = suffix_index.SuffixFamily(Scratch(spark, "t"), suffix_index.SuffixParams(lead=4))
    rows = spark.range(60_000).selectExpr("cast(lpad(cast(id % 7000 as string), 4, '0') as binary) AS lead", "id % 3 AS span")
    for _ in range(2):
        family.insert(rows)
    got = spark.read.parquet(family.levels[1])
    assert got.count() == rows.distinct().count() and got.agg({"n": "sum"}).first()[0] == 120_000


def test_bytes_odd_rows(odd_docs, no_docs):
    p = suffix_index.SuffixParams(batches=2)
    rows = suffix_index.dedup_bytes(odd_docs, p).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_bytes == 0 and by[6].n_removed == 5000 and by[7].n_removed == by[7].n_bytes and by[5].n_removed == 0
    assert suffix_index.dedup_bytes(no_docs, p).collect() == []


# ---------------------------------------------------------------- sentence spans


def split_sentences(text):
    """(begin, end, words) by the documented rule, one character at a time."""
    out, words, begin = [], [], None
    found = list(WORD.finditer(text))
    for n, m in enumerate(found):
        begin = m.start() if begin is None else begin
        words.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m.group()))
        closing = re.search(r"[!-/:-@\[-`{-~]*$", m.group()).group()
        after = text[m.end() : found[n + 1].start()] if n + 1 < len(found) else "\n"
        if any(c in ".!?" for c in closing) or "\n" in after:
            out.append((begin, tuple(words)))
            words, begin = [], None
    return out


def brute_spans(texts, p):
    first, docs = {}, {i: split_sentences(t or "") for i, t in texts}
    runs = []
    for i in sorted(docs):
        s = docs[i]
        for k in range(len(s)):
            ends = [m for m in range(k + p.sentences, len(s) + 1) if sum(len(ws) for _, ws in s[k:m]) >= p.min_words][:1]
            ends += [k + 1] if len(s[k][1]) >= p.alone else []
            runs += [(tuple(w for _, ws in s[k:m] for w in ws), i, (k, m)) for m in ends]
    for run, i, k in runs:
        first.setdefault(run, (i, k))
    gone = {}
    for run, i, k in runs:
        if first[run] != (i, k):
            gone.setdefault(i, set()).update(range(*k))
    out = {}
    for i, t in texts:
        if i in gone:
            s = docs[i]
            edges = [b for b, _ in s] + [len(t)]
            out[i] = (len(s), len(gone[i]), t[: edges[0]] + "".join(t[edges[k] : edges[k + 1]] for k in range(len(s)) if k not in gone[i]))
    return out


@pytest.mark.parametrize("p", [sentence_spans.SpanParams(), sentence_spans.SpanParams(3, 6, 9)])
def test_spans_against_brute_force(make_docs, sample, p):
    rng = np.random.default_rng(4)
    stock = [" ".join(f"s{i}w{j}" for j in range(8)) + e for i, e in enumerate([".", "!", "?###", ".", "\n", "..."])]
    texts = {}
    for i in range(30):
        parts = [f"own {i} {k} sentence with some words here." for k in range(3)]
        at, n = rng.integers(0, 4), rng.integers(0, 6)
        texts[i] = " ".join([*parts[:at], *stock[n : n + 4], *parts[at:]])
    texts[30] = " ".join(stock[:3] * 3)
    lines = "\n".join(f"line {i} of a list" for i in range(12))  # short lines make runs together
    long = " ".join(f"long{i}" for i in range(45)) + "!" + ")" * 30
    texts |= {50: f"{lines}\nown end", 51: f"own begin\n{lines}", 52: f"{long} one. two.", 53: f"Well. {long} three.", 54: "?" * 4000 + " a b. c d.", 55: "few words. in all."}
    texts |= {56: texts[55]}
    texts |= {31: None, 32: "", 33: "x", 34: texts[0]}
    texts |= {1000 + r.doc_id: r.text for r in sample.limit(80).collect()}
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in sentence_spans.dedup_sentences(make_docs(texts).repartition(3), p).collect()}
    assert got == brute_spans(list(texts.items()), p)


def test_spans_odd_rows(odd_docs, no_docs):
    rows = sentence_spans.dedup_sentences(odd_docs).collect()
    assert all(r.n_removed > 0 for r in rows)
    assert sentence_spans.dedup_sentences(no_docs).collect() == []


# ---------------------------------------------------------------- shared primitives


def test_words_follow_the_contract():
    import pyarrow as pa

    texts = [None, "", " a\u00a0b\x0bc ", "x" * 10, "é \x85 z\x1f", "tail"]
    got = []
    for piece in tk.slices(pa.array(texts), 6):
        w = tk.words(piece)
        for i in range(piece.n):
            got.append([piece.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.first[i], w.first[i + 1])])
    assert got == [WORD.findall(t or "") for t in texts]
