"""The operators' queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, hostrules, langid, mixing, neardup, packing, sstable, substring, toxicity, urlrules

RULES = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 or more words that an earlier document holds."""
    return substring.passages(_documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = langid.predict(docs, langid.fit_documents(docs))
    held_out = F.coalesce(langid.bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(_documents(spark, sf_dir))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(_documents(spark, sf_dir)).drop("host_rate")


def op5_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), _table(spark, sf_dir, "labels")
    fold = langid.bucket(F.col("doc_id"), 3)
    machine = toxicity.fit(docs, labels.where(fold != 1))
    held_out = F.coalesce(fold == 1, F.lit(False))
    return toxicity.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages"), urlrules.parse(RULES))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.write_and_read(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_language_id, op3_minhash_neardup, op4_host_rules, op5_bin_packing,
        op6_cross_polytope, op7_factorization_machine, op8_url_rules, op9_source_mix, op10_sstable, pipeline,
    )
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP3 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d
), x AS (SELECT doc_id, md5(unnest(g)) AS g FROM s),
n AS (SELECT doc_id, len(g) AS n FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * k >= 85 * (m.n + o.n - k)
), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id, doc_id AS r FROM n
  UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
)
SELECT doc_id, any_value(n)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id, doc_id = min(r) AS kept
FROM n JOIN reach USING (doc_id) GROUP BY doc_id
"""

_OP4 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
i AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(w[i:i + 4], ' '))) AS c FROM i),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM g WHERE c > 1) GROUP BY doc_id),
b AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
), f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT sum(k) / sum(n) AS m, sum(n) AS n, count(*) AS hosts, sum(k * k / n) AS kk, sum(n * n) AS nn FROM h),
v AS (SELECT m, hosts, ((kk - n * m * m) - (hosts - 1) * m * (1 - m)) / greatest(n - nn / n, 1e-9) AS v FROM t),
z AS (SELECT m, CASE WHEN hosts > 1 AND m > 0 AND m < 1 THEN
  CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END ELSE 1.0 END AS s FROM v),
q AS (SELECT source, (k + m * s) / (n + s) <= 0.5 AS ok FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(ok, true) AS kept FROM f LEFT JOIN q USING (source)
"""

_OP8 = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' ELSE 'allow' END AS verdict
FROM p
"""

_OP9 = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM s),
o AS (
  SELECT *, cap / w::DOUBLE AS ratio, sum(source_size) OVER () - coalesce(sum(cap) OVER k, 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER k, 0) AS w_rest
  FROM w WINDOW k AS (ORDER BY cap / w::DOUBLE, cap, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), a AS (SELECT rest, w_rest FROM o WHERE rest * w <= cap * w_rest ORDER BY ratio, cap, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN a.rest IS NULL THEN cap::DOUBLE
    ELSE least(cap::DOUBLE, (w * a.rest)::DOUBLE / a.w_rest::DOUBLE) END AS target FROM o LEFT JOIN a ON true
), g AS (
  SELECT d.*, source_size, target, round(target)::BIGINT AS want,
    sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS tie
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS copies,
  CASE WHEN source_size > 0 THEN want % source_size ELSE 0 END AS remainder FROM g)
SELECT doc_id, size, source_size, target, (copies * size + CASE WHEN upto <= remainder THEN size
  WHEN upto - tie < remainder THEN floor(size * (remainder - (upto - tie)) / tie) ELSE 0 END)::BIGINT AS taken FROM e
"""

ORACLES: dict[str, str] = {
    "op3_minhash_neardup": _OP3,
    "op4_host_rules": _OP4,
    "op8_url_rules": _OP8,
    "op9_source_mix": _OP9,
}
