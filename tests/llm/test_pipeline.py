"""The pipeline against a plain version of its stages, and on odd rows."""

from collections import Counter

import corpus_pipeline
import regex
import sentencepiece
from pyspark.sql import functions as F
from test_dedup import brute_components
from test_quality_and_urls import WORD

from pairloom.llm import surrogates
from pairloom.llm.queries import TOKENIZER

ENTITY = regex.compile(surrogates.ENTITY)
NAMES = regex.compile(f"(?:{'|'.join(surrogates.FEMALE + surrogates.MALE + surrogates.NEUTRAL)})\\.? \\p{{Lu}}")


def passes_rules(text):
    """The base rules; none of the sample's lines is over the limits of the line rule."""
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(8)}
    return len(words) >= 20 and 100 * len(covered) <= 30 * len(words)


def expected(docs, items):
    """{doc_id: text} that four stages leave, texts as they are before private data is replaced."""
    kept = {i: t for i, t in docs.items() if passes_rules(t)}
    component = brute_components(list(kept.items()))
    kept = {i: t for i, t in kept.items() if component[i][1] == i}
    return {i: t for i, t in kept.items() if not any(x in t for x in items)}


def test_pipeline_against_plain_stages(spark):
    base = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]
    want = expected(docs, items)
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, base).collect()}
    assert set(rows) == set(want) and 0 < len(want) < len(docs)
    model = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    changed = 0
    for i, text in want.items():
        r = rows[i]
        assert list(r.ids) == model.encode(r.text) and r.n_tokens == len(r.ids) and model.decode(list(r.ids)) == r.text
        assert r.round_trip and r.parity and r.n_chars == len(r.text)
        if not ENTITY.search(text):
            assert r.text == text
            continue
        changed += 1
        assert r.text != text
        if not NAMES.search(text):  # names are replaced between mentions too
            between = [regex.escape(text[a:b]) for a, b in zip([0, *(m.end() for m in ENTITY.finditer(text))], [*(m.start() for m in ENTITY.finditer(text)), len(text)], strict=True)]
            assert regex.fullmatch("(?s:.+?)".join(between), r.text)
    assert changed


def test_surrogates_of_the_sample_map_one_to_one(spark):
    """Mentions found by the same patterns in plain Python: equal ones get equal surrogates, others others."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = {r.doc_id: r for r in surrogates.replace_private(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), surrogates.SurrogateParams(key="k")).collect()}
    to, back = {}, {}
    for i, text in docs.items():
        mentions = [m.group() for m in ENTITY.finditer(text or "")]
        assert out[i].n_entities == len(mentions)
        if any(NAMES.match(m) for m in mentions):
            continue
        spans = list(ENTITY.finditer(text or ""))
        between = [text[a:b] for a, b in zip([0, *(m.end() for m in spans)], [*(m.start() for m in spans), len(text)], strict=True)] if spans else [text]
        if not spans:
            assert out[i].text == text
            continue
        found = regex.fullmatch("((?s:.+?))".join(map(regex.escape, between)), out[i].text)
        for mention, new in zip(mentions, found.groups(), strict=True):
            one = (regex.sub(r"[ .()-]", "", mention) if regex.fullmatch(r"[\d +().-]+", mention) and mention.count(".") != 3 else mention).lower()
            two = (regex.sub(r"[ .()-]", "", new) if regex.fullmatch(r"[\d +().-]+", new) and new.count(".") != 3 else new).lower()
            assert to.setdefault(one, two) == two and back.setdefault(two, one) == one and one != two
    assert len(to) > 20 and not set(to) & set(back)


def test_stages_take_odd_rows(spark, odd_docs, no_docs, tmp_path):
    words = " ".join(f"w{i}" for i in range(30))
    more = odd_docs.unionByName(spark.createDataFrame([("en", None, words, "s", 1, "i", 2, "r", "h", "k", "p"), ("en", 50, words, "s", 1, "i", 2, "r", "h", "k", "p")] * 2, odd_docs.schema))
    spark.createDataFrame([(1, "an item of the benchmark that nobody holds at all"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, str(tmp_path))
        assert out.columns == more.columns and out.dtypes == more.dtypes
        left = out.where(F.col("text") == words).groupBy("doc_id").count().collect()
        assert sorted((r.doc_id is None, r["count"]) for r in left) == [(False, 2), (True, 2)]
        assert stage(spark, no_docs, str(tmp_path)).collect() == []
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, more, str(tmp_path)).count() == more.count() and last(spark, no_docs, str(tmp_path)).collect() == []
    more.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or -1 for r in rows) == [-1, -1, 50, 50] and all(r.parity and r.round_trip for r in rows)


def test_empty_documents(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
