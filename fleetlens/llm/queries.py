"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket5
from .decontam import find_contamination
from .exact_dedup import exact_duplicates
from .hmm_lm import score_documents
from .licenses import CUE, SEPARATOR, SPANS, scan_licenses, vectors
from .line_dedup import dedup_lines
from .mixing import mix
from .quality import rate_quality
from .simhash import near_duplicates
from .toxicity import score_toxicity
from .url_filter import host_rule, judge_urls

URL_RULES = (host_rule("allow", "org"), host_rule("block", "example.org", "/es/"), host_rule("block", "example.org", "/en/1"), host_rule("allow", "com", "/fr/"), host_rule("block", "com", "/de/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=bucket5("doc_id") != 0)
    return scored.select("doc_id", (bucket5("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=None, radius=3)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), held_out=bucket5("doc_id") == 1)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_spans=False)
    items = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_exact_dedup, op3_toxicity, op4_mixing, op5_quality, op6_simhash, op7_line_dedup, op8_licenses, op9_lm_scoring, op10_decontamination)}

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _licenses_sql(least: float = 0.75) -> str:
    idf, other, weights = vectors()
    idfs = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in idf.items())
    dots = ", ".join(f"({i}, '{name}', '{w}', {x!r}::DOUBLE)" for i, (name, bag) in enumerate(weights) for w, x in bag)
    spans = ", ".join(map(str, SPANS))
    return f"""
WITH idf(w, x) AS (VALUES {idfs}), t(i, license, w, x) AS (VALUES {dots}), spans(a, b) AS (VALUES {spans}),
ls AS (SELECT doc_id, string_split({FOLD}, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n FROM ls),
c AS (SELECT doc_id, n, a, b, array_to_string(ls[greatest(n - a, 0) + 1:n + b + 1], ' ') AS part FROM l, spans WHERE regexp_matches(line, '{CUE}')),
w AS (SELECT doc_id, n, a, b, unnest(list_filter(string_split_regex(part, '{SEPARATOR}'), lambda x: x <> '')) AS w FROM c),
tf AS (SELECT doc_id, n, a, b, w, count(*) AS f FROM w GROUP BY ALL),
len AS (SELECT doc_id, n, a, b, sqrt(sum(pow(f * coalesce(x, {other!r}), 2))) AS len FROM tf LEFT JOIN idf USING (w) GROUP BY ALL),
dot AS (SELECT doc_id, n, a, b, i, license, sum(f * x) AS dot FROM tf JOIN t USING (w) GROUP BY ALL),
cos AS (SELECT doc_id, n, license, round(dot / len, 6) AS similarity FROM dot JOIN len USING (doc_id, n, a, b)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, license DESC, n) AS r FROM cos)
SELECT d.doc_id, concat_ws('/', source, lang, d.doc_id::VARCHAR || '.txt') AS path, license, similarity,
  CASE WHEN license IS NOT NULL THEN 'header' END AS origin, n::INTEGER AS line
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND r = 1 AND similarity >= {least}"""


ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM u
), rules(action, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), patterns(pattern, turn) AS (
  VALUES ('/ads/', 1), ('/adserver/', 2), ('/banner/', 3), ('/track/', 4), ('/tracking/', 5), ('/casino/', 6), ('/porn/', 7), ('/xxx/', 8),
    ('-casino-', 9), ('-porn-', 10), ('/spam-farm.', 11), ('.spam-farm.', 12), ('/login/', 13), ('/logout/', 14), ('/cart/', 15)
), j AS (
  SELECT s.*,
    (SELECT max_by(struct_pack(rule := rhost || rpath, action := action), length(rhost || rpath)) FROM rules
      WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS r,
    (SELECT max_by(pattern, length(pattern) * 100 - turn) FROM patterns
      WHERE contains(translate('/' || host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), pattern)) AS p
  FROM s
)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.action, CASE WHEN p IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN r.rule IS NULL THEN p END AS pattern
FROM j""",
    "op2_exact_dedup": f"""
WITH t AS (SELECT doc_id, {FOLD} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)""",
    "op7_line_dedup": r"""
WITH x AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM x
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op8_licenses": _licenses_sql(),
    "op10_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)
), hits AS (SELECT doc_id, dw.size, i, item FROM dw JOIN win ON win.win = dw.win AND win.size = dw.size),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
