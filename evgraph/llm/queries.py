"""Queries over the given tables, one per operator, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.llm import (
    collision_search,
    id_files,
    jaccard,
    language,
    lengths,
    packing,
    piece_bpe,
    secrets,
    spelling,
    surrogates,
    syncmers,
    turns,
    url_rules,
)
from evgraph.llm.common import new_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@_register("op1_secret_scans")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, folder, "documents")))


@_register("op2_collision_search")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return collision_search.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@_register("op3_closed_syncmers")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.compare_with_edits(table(spark, folder, "documents"))


#: Key of the registered runs; a real run passes its own secret.
PII_KEY = "registered query"


@_register("op4_surrogates")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replace_personal_data(docs, PII_KEY)


@_register("op5_best_fit_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@_register("op6_sentencepiece")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return piece_bpe.round_trip_digests(table(spark, folder, "documents"))


@_register("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language.learned_on(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@_register("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return lengths.suffix_sums(lengths.length_histogram(table(spark, folder, "documents")))


@_register("op9_jaccard_join")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_components(table(spark, folder, "documents"))


_URL_SQL = r"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) t, 1 k FROM pages
  UNION ALL
  SELECT url, unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')), 2 FROM pages
), raw AS (
  SELECT url a, trim(replace(CASE k WHEN 1 THEN regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''>\s]*)', 1)
    ELSE regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''>\s]+)', 1) END, '&amp;', '&')) b FROM tags
), ends AS (
  SELECT a, CASE WHEN b LIKE '//%' THEN regexp_extract(a, '(?s)^(.*?:)//', 1) || b
    WHEN b LIKE '/%' THEN regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1) || b ELSE b END b FROM raw
), bare AS (
  SELECT regexp_replace(a, '(?s)#.*$', '') a, regexp_replace(b, '(?s)#.*$', '') b FROM ends
), edges AS (
  SELECT DISTINCT lower(regexp_extract(a, '(?s)^(.*?://[^/?]*)', 1)) || substr(a, length(regexp_extract(a, '(?s)^(.*?://[^/?]*)', 1)) + 1) a,
    lower(regexp_extract(b, '(?s)^(.*?://[^/?]*)', 1)) || substr(b, length(regexp_extract(b, '(?s)^(.*?://[^/?]*)', 1)) + 1) b
  FROM bare WHERE contains(a, '://') AND contains(b, '://')
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
rules(verdict, h, p) AS (VALUES ('block','net','/'), ('allow','example.net','/en/'), ('block','example.com','/de/'), ('allow','org','/fr/')),
urls AS (SELECT DISTINCT url FROM pages UNION SELECT a FROM both_ways),
parts AS (
  SELECT url, CASE WHEN contains(coalesce(url, ''), '://') THEN lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) ELSE '' END host,
    CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END path FROM urls
), judged AS (
  SELECT url, host, path, max_by(r.h || r.p, length(r.h || r.p)) FILTER (r.h IS NOT NULL) AS rule_name,
    max_by(r.verdict, length(r.h || r.p)) FILTER (r.h IS NOT NULL) AS rule_verdict
  FROM parts LEFT JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)
  GROUP BY url, host, path
), reached(n) AS (
  SELECT a FROM both_ways JOIN judged ON judged.url = a WHERE rule_verdict = 'block'
  UNION SELECT b FROM reached JOIN both_ways ON a = n
)
SELECT page_id, j.host, j.path, j.rule_name AS rule,
  coalesce(j.rule_verdict, CASE WHEN lower(regexp_extract(regexp_replace(p.url, '(?s)#.*$', ''), '(?s)^(.*?://[^/?]*)', 1))
    || substr(regexp_replace(p.url, '(?s)#.*$', ''), length(regexp_extract(regexp_replace(p.url, '(?s)#.*$', ''), '(?s)^(.*?://[^/?]*)', 1)) + 1)
    IN (SELECT n FROM reached) THEN 'block' END, 'allow') AS verdict
FROM pages p JOIN judged j ON j.url IS NOT DISTINCT FROM p.url"""


@_register("op10_url_filters", _URL_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"))


def _crc_table() -> list[int]:
    """Checksum of each single byte, as ``zlib.crc32`` steps through it."""
    table_ = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table_.append(c)
    return table_


# Words hold letters below U+0100 only: one byte, or 195 and the letter less 64.
_SPELLING_SQL = f"""
WITH crc AS (SELECT {_crc_table()}::UBIGINT[] AS t),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents)
), once AS (SELECT id, w, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT w, n, length(w) AS size, xor(4294967295::UBIGINT, list_reduce(
    list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(id || w, ''), lambda c:
      CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [195::UBIGINT, (unicode(c) - 64)::UBIGINT] END))),
    lambda h, b: xor(h >> 8, t[(xor(h, b) & 255)::BIGINT + 1]))) AS h
  FROM once, crc
), words AS (
  SELECT CASE WHEN h % {spelling.NOISE} = 0 THEN left(w, (h % size)::BIGINT) || substr(w, (h % size)::BIGINT + 2) ELSE w END AS word,
    sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), cut AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS less FROM words, unnest(range(length(word))) AS u(i)
), pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN words w ON cut.less = w.word
  UNION SELECT w.word, cut.word, cut.n FROM cut JOIN words w ON cut.less = w.word
), best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS near, max(n) AS near_n FROM pairs GROUP BY a
), found AS (
  SELECT word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, form AS onward FROM found
  UNION ALL SELECT walk.word, found.word, found.form FROM walk JOIN found ON found.word = walk.onward
)
SELECT found.word, form, walk.root, n, n_near, form_n FROM found JOIN walk ON walk.word = found.word AND walk.onward IS NULL"""


@_register("op11_pivotal_spelling", _SPELLING_SQL.replace("WITH crc", "WITH RECURSIVE crc", 1))
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variant_groups(spelling.word_counts(table(spark, folder, "documents"), noise=spelling.NOISE))


@_register("op12_id_files")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    place = new_folder(spark)
    id_files.write_ids(table(spark, folder, "documents"), place)
    return id_files.read_ids(spark, place, digest=True)


@_register("op13_turn_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return turns.repair(turns.damaged(table(spark, folder, "conversations")))
