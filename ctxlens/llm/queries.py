"""Queries of the corpus operators, with the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .record_output import read_records, write_records

    return read_records(spark, write_records(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts twice with one cache: the first run encodes what is distinct, the second finds every count stored."""
    from .common import fresh_dir
    from .token_counts import count_tokens

    cache = fresh_dir(spark, "token-counts")
    for _ in range(2):
        counted = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), cache, keep=["doc_id"])
    return counted


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mix import mix

    return mix(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .span_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), output="digest")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    written = write_archives(table(spark, sf_dir, "pages"), segment_bytes=4096)
    return read_archives(spark, [path for path, _ in written]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents"), columns=["doc_id", "lang", "source"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_codec import codec_digests

    return codec_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cross_tokens import align

    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


QUERIES = {
    f.__name__: f
    for f in (op1_token_records, op2_vector_search, op3_token_counts, op4_source_mix, op5_secret_scan, op6_span_dedup, op7_warc, op8_near_dedup, op9_quality, op10_bpe_codec, op11_hard_negatives, op12_cross_tokens, op13_html_extract)
}

_CUTS = ", ".join(f"max(CASE WHEN metric = '{m}' THEN (hi + 6 * greatest(hi - lo, {step}))::BIGINT END) AS cut_{m}" for m, step in (("symbol_rate", 5), ("upper_rate", 2), ("word_len", 5), ("dup_line_rate", 40)))

ORACLE = {
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 3""",
    "op13_html_extract": r"""
WITH a AS (SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' ') AS t FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '</?b>', '', 'g'), '</?(?:p|h1)>'),
  lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a),
c AS (SELECT page_id, url, coalesce(array_to_string(blocks, chr(10) || chr(10)), '') AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c""",
    "op8_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) c ON d.doc_id = c.doc_id""",
    "op6_span_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i+34], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c >= 2),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM dup, (SELECT unnest(range(35)) AS k)),
w AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (SELECT w.doc_id, string_agg(w, ' ' ORDER BY w.i) AS s, count(*) AS n FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT h, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN first > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first > page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h""",
    "op9_quality": rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, lang, source, words, len(words) AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
win AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM m WHERE len(words) >= 5)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM dup, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
r AS (SELECT m.doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_symbols * 1000 // (word_chars + 100) AS symbol_rate, n_upper * 1000 // (word_chars + 100) AS upper_rate,
  (word_chars + 50) * 100 // (n_words + 10) AS word_len, n_dup_lines * 1000 // (n_lines + 4) AS dup_line_rate
  FROM m LEFT JOIN rep ON m.doc_id = rep.doc_id),
l AS (SELECT lang, source, metric, v, greatest(length(bin(v)) - 5, 0) AS sh FROM (
  SELECT lang, source, unnest(['symbol_rate', 'upper_rate', 'word_len', 'dup_line_rate']) AS metric,
    unnest([symbol_rate, upper_rate, word_len, dup_line_rate])::BIGINT AS v FROM r)),
fine AS (SELECT lang, source, metric, (((v >> sh) + 1) << sh) - 1 AS bucket, count(*) AS n FROM l GROUP BY ALL),
coarse AS (SELECT *, sum(n) OVER (PARTITION BY lang, metric) AS total FROM (SELECT lang, metric, bucket, sum(n) AS n FROM fine GROUP BY ALL)),
lean AS (SELECT g.lang, g.source, c.metric, c.bucket, coalesce(f.n, 0) * c.total + 50 * c.n AS n FROM (SELECT DISTINCT lang, source FROM fine) g JOIN coarse c ON g.lang IS NOT DISTINCT FROM c.lang
  LEFT JOIN fine f ON f.lang IS NOT DISTINCT FROM g.lang AND f.source IS NOT DISTINCT FROM g.source AND f.metric = c.metric AND f.bucket = c.bucket),
q AS (SELECT lang, source, metric, min(CASE WHEN upto * 100 >= total * 25 THEN bucket END) AS lo, min(CASE WHEN upto * 100 >= total * 75 THEN bucket END) AS hi FROM (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, metric) AS total, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto FROM lean) GROUP BY ALL),
cuts AS (SELECT lang, source, {_CUTS} FROM q GROUP BY ALL),
v AS (SELECT r.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  symbol_rate <= cut_symbol_rate AND upper_rate <= cut_upper_rate AND word_len <= cut_word_len AND dup_line_rate <= cut_dup_line_rate AS fine
  FROM r JOIN cuts ON r.lang IS NOT DISTINCT FROM cuts.lang AND r.source IS NOT DISTINCT FROM cuts.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM v""",
}
