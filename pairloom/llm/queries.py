"""The registered query of each operator, with production parameters and over whole tables."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lm, partenum, quality, sentence_spans, sentencepiece_codec, suffix_index, surrogates, toxicity, url_filter
from .storage import table

URL_RULES = (
    url_filter.Rule("block", "net/"),
    url_filter.Rule("allow", "example.net/en/"),
    url_filter.Rule("block", "example.com/de/"),
    url_filter.Rule("allow", "org/fr/"),
)


TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


KEY_SETTING = "spark.pairloom.surrogateKey"


def surrogate_params(spark: SparkSession) -> surrogates.SurrogateParams:
    """The key of the session's setting; without one a fresh key, so that no two runs share surrogates."""
    return surrogates.SurrogateParams(key=spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32))


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_private(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_params(spark))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the ids of every document (``ids_hash`` of the whole array), with both checks."""
    encoded = sentencepiece_codec.encode_texts(table(spark, sf_dir, "documents"), TOKENIZER, ["doc_id"])
    return encoded.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_hash"), "round_trip", "parity")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup_sentences(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.dedup_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes of pages: ``labels`` by the page's id; bad is low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_surrogates": op1_surrogates,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_url_reputation": op8_url_reputation,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_join": op10_jaccard_join,
}

_WORD = r"[^\x20\x09-\x0D]+"
# strength of a beta prior by moments, between 1 and 1000
_FIT = (
    "CASE WHEN sum((n - 1) * n * p * (1 - p)) > 0 THEN 1 / greatest(least((sum((bad - n * p) ** 2) - sum(n * p * (1 - p))) / sum((n - 1) * n * p * (1 - p)), "
    "1 / 2.0::DOUBLE), 1 / 1001.0::DOUBLE) - 1 ELSE 10.0::DOUBLE END AS m"
)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    # every window as hexadecimal text; repeated ones joined to islands; the rest hashed
    "op6_suffix_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS p,
             unnest(list_transform(range(0, greatest(len(h) // 2 - 199, 0)), lambda i: md5(substr(h, (2 * i + 1)::BIGINT, 400)))) AS k FROM b),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
d AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM twice)),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM d),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS z FROM i GROUP BY doc_id, run),
edges AS (SELECT doc_id, run, a, z FROM r UNION ALL SELECT doc_id, 9e15::BIGINT, len(h) // 2, len(h) // 2 FROM b),
kept AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY run), 0) AS begin FROM edges),
parts AS (SELECT kept.doc_id, string_agg(substr(h, 2 * begin + 1, 2 * (a - begin)), '' ORDER BY begin) AS rest FROM kept JOIN b USING (doc_id) GROUP BY kept.doc_id)
SELECT b.doc_id, len(h) // 2 AS n_bytes, coalesce(s.n, 0)::BIGINT AS n_removed, coalesce(s.c, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM b JOIN parts USING (doc_id) LEFT JOIN (SELECT doc_id, sum(z - a) AS n, count(*) AS c FROM r GROUP BY doc_id) s USING (doc_id)""",
    "op8_url_reputation": f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
l AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
o AS (SELECT host, bad FROM u JOIN l USING (page_id)),
l3 AS (SELECT host, string_split(regexp_replace(host, ':.*', ''), '.') AS part, count(*) AS n, sum(bad)::DOUBLE AS bad FROM o GROUP BY 1, 2),
l4 AS (SELECT *, CASE WHEN len(part) > 1 AND length(part[-1]) = 2 AND part[-2] IN ({", ".join(f"'{x}'" for x in url_filter.SECOND_LEVEL)}) THEN 2 ELSE 1 END AS deep FROM l3),
h AS (SELECT host, n, bad, array_to_string(part[-deep - 1:], '.') AS domain, array_to_string(part[-deep:], '.') AS suffix FROM l4),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1),
sp AS (SELECT s.*, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM s) AS p FROM s),
sm AS (SELECT suffix, (bad + m * p) / (n + m) AS mean FROM sp, (SELECT {_FIT} FROM sp)),
dp AS (SELECT d.*, sm.mean AS p FROM d JOIN sm USING (suffix)),
dm AS (SELECT domain, (bad + m * p) / (n + m) AS mean FROM dp, (SELECT {_FIT} FROM dp)),
hp AS (SELECT h.*, dm.mean AS p FROM h JOIN dm USING (domain)),
hm AS (SELECT host, n + m AS size, (bad + m * p) / (n + m) AS m FROM hp, (SELECT {_FIT} FROM hp)),
k AS (SELECT host, round(m - 1.645::DOUBLE * sqrt(m * (1 - m) / (size + 1)), 9) AS lower FROM hm),
j AS (SELECT page_id, u.host, path, lower, CASE
    WHEN (u.host = 'example.com' OR ends_with(u.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (u.host = 'example.net' OR ends_with(u.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (u.host = 'org' OR ends_with(u.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (u.host = 'net' OR ends_with(u.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u LEFT JOIN k USING (host))
SELECT page_id, host, path, rule, lower, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM j""",
    "op9_quality_rules": f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '{_WORD}') AS words FROM t),
a AS (SELECT doc_id, host, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols FROM w),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM t),
s AS (SELECT doc_id, host, line, regexp_extract_all({_LOWER.format("line")}, '{_WORD}') AS lw FROM l WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM s GROUP BY 1),
win AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS g FROM w WHERE len(words) >= 8),
two AS (SELECT doc_id, g FROM win GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT win.doc_id, unnest(range(i, i + 8)) AS pos FROM win JOIN two USING (doc_id, g)) GROUP BY 1),
base AS (SELECT a.*, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM a LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
ln AS (SELECT s.doc_id, s.host, t.text, array_to_string(lw, ' ') AS line, len(lw) AS k FROM s JOIN t USING (doc_id)),
hs AS (SELECT host, count(DISTINCT text) AS n FROM ln GROUP BY 1),
fr AS (SELECT host, line, count(DISTINCT text) AS n FROM ln GROUP BY 1, 2),
gone AS (SELECT ln.doc_id, sum(k)::BIGINT AS removed FROM ln JOIN fr USING (host, line) JOIN hs USING (host) WHERE fr.n > 100 AND fr.n > 0.02 * hs.n GROUP BY 1)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(removed, 0) AS removed_words,
       NOT base_failed AND NOT (coalesce(removed, 0) > 0 AND (n_words - removed < 20 OR n_words - removed < 0.3 * n_words)) AS kept
FROM f LEFT JOIN gone USING (doc_id)""",
    "op10_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS words FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
                                WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS id, b AS r FROM sym UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.r),
low AS (SELECT id, min(r) AS m FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(low.m, w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.id = w.doc_id""",
}
