"""The corpus operators as queries over the test tables, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.llm import decontaminate, language, licenses, mixing, quality, sharding, simhash, topk, toxicity, urls
from tabula.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@_query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mixing.mix(table(spark, sf_dir, "documents"))
    return mixture.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op2_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15))::BIGINT AS place
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, 2.0 * source_size AS most,
         row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS k,
         coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM sources),
level AS (
  SELECT CAST((1.5 * (SELECT sum(source_size) FROM sources) - used) / open AS DOUBLE) AS level
  FROM filled WHERE most >= weight * ((1.5 * (SELECT sum(source_size) FROM sources) - used) / open)
  ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, CAST(least(most, weight * coalesce(level, 'Infinity'::DOUBLE)) AS DOUBLE) AS target
  FROM filled LEFT JOIN level ON true),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times,
         target - source_size * CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rest
  FROM targets),
placed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.times, b.rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place
             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.place) AS own
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (times + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest
            AND rest - (upto - own) > upto - rest)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@_query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sharding.shard(table(spark, sf_dir, "documents"))
    return stored.select("doc_id", "shard", "version", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@_query
def op8_sharding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards hold, whatever lies in which."""
    stored = sharding.shard(table(spark, sf_dir, "documents"))
    return stored.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE_SQL["op8_sharding_rows"] = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"


@_query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in rows)


def _license_signs() -> str:
    """The telling signs of the templates and their places, from the templates' words."""
    ratio, known = licenses.DICE / (2 - licenses.DICE), []
    for n, (_, body) in enumerate(licenses.TEMPLATES):
        words = "".join(c if c.isalnum() else " " for c in body.lower()).split()
        known.append((n, words, list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))))
    return ", ".join(f"('{s}', {t}, {place}, {many})" for s, t, place, many in licenses.sign_places(known, ratio))


ORACLE_SQL["op4_licenses"] = (
    r"""
WITH bodies(t, license, body) AS (VALUES """
    + _sql_rows((n, *row) for n, row in enumerate(licenses.TEMPLATES))
    + r"""),
signs(sign, t, place, many) AS (VALUES """
    + _license_signs()
    + r"""),
template_words AS (
  SELECT CAST(t AS INTEGER) AS t, license, string_split(trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM bodies),
templates AS (
  SELECT t, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams
  FROM template_words),
docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
cut AS (
  SELECT row, doc_id, unnest(list_concat(string_split(text, chr(10)),
      list_filter(regexp_split_to_array(text, '\n[ \t\r]*\n[ \t\r\n]*'), lambda p: contains(p, chr(10))))) AS unit
  FROM docs),
unit_words AS (
  SELECT row, doc_id, row_number() OVER () AS spot, string_split(trim(regexp_replace(lower(unit), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w
  FROM cut),
text_words AS (
  SELECT row, doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM docs),
hits AS (
  SELECT row, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM text_words WHERE len(w) >= 2),
laid AS (
  SELECT h.row, h.doc_id, greatest(i - place, 1) AS spot, t, w[greatest(i - place, 1) : least(i - place + many - 1, len(w))] AS w
  FROM (SELECT *, w[i] AS sign FROM hits UNION ALL SELECT *, w[i] || ' ' || w[i + 1] FROM hits) h JOIN signs USING (sign)),
unit_grams AS (
  SELECT row, doc_id, spot, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM unit_words WHERE len(w) >= 2),
window_grams AS (
  SELECT row, doc_id, spot, t, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT DISTINCT row, doc_id, spot, t, w FROM laid) WHERE len(w) >= 2),
paired AS (
  SELECT row, doc_id, 'unit' AS kind, spot, license, g, grams FROM unit_grams
    JOIN templates ON 3 * len(g) >= 2 * len(grams) AND 2 * len(g) <= 3 * len(grams)
  UNION ALL SELECT row, doc_id, 'window', spot, license, g, grams FROM window_grams JOIN templates USING (t)),
compared AS (SELECT *, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM paired)
SELECT doc_id, license, CAST(round(max(dice), 6) AS DOUBLE) AS dice, count(DISTINCT spot) FILTER (kind = 'unit') AS units,
  count(DISTINCT (row, spot)) FILTER (kind = 'window') AS windows
FROM compared WHERE dice >= 0.8 GROUP BY doc_id, license
"""
)


@_query
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op1_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row AND len(q.e) = len(c.e)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@_query
def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is the quality of the document that the last number of its path names: the numbers in the urls
    of these tables run over the range of doc_id, and no other column ties pages to labels."""
    pages = table(spark, sf_dir, "pages")
    number = F.regexp_extract(urls.url_path(F.col("url")), r"(\d{1,18})\D*$", 1).try_cast("bigint")
    quality_of = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("number"), F.col("quality").alias("good"))
    labels = pages.select("page_id", number.alias("number")).join(quality_of, "number").select("page_id", "good")
    return urls.judge(pages, labels)


#: Levels that the SQL, which has no loop over them, follows; deeper paths are compared with brute force in the tests.
SQL_LEVELS = 12


def _template_sql() -> str:
    levels = []
    for n in range(SQL_LEVELS):
        levels.append(f"""
b{n} AS (SELECT host, template, coalesce(segments[{n + 1}], '') AS segment, count(*) AS pages, count(good) AS labelled,
    coalesce(sum(good), 0) AS good FROM p{n} GROUP BY ALL),
t{n} AS (SELECT host, template, count(*) FILTER (segment <> '') AS kinds, sum(pages) AS all_pages,
    sum(labelled) AS all_labelled, sum(good) AS all_good FROM b{n} GROUP BY ALL),
j{n} AS (SELECT host, template, segment, CASE WHEN segment = '' THEN ''
    WHEN (kinds >= {urls.VARIABLE_AT} AND kinds >= {urls.VARIABLE_SHARE} * all_pages)
      OR (kinds > 1 AND coalesce(abs(good / nullif(labelled, 0) - all_good / nullif(all_labelled, 0))
          <= {urls.SIMILAR_Z} * sqrt((all_good / nullif(all_labelled, 0)) * (1 - all_good / nullif(all_labelled, 0))
             / greatest(labelled, 1)) + 1e-12, true)) THEN '*' ELSE segment END AS token
    FROM b{n} JOIN t{n} USING (host, template)),
p{n + 1} AS (SELECT page_id, host, path, segments, good,
    CASE WHEN token = '' THEN template ELSE template || '/' || token END AS template
    FROM p{n} JOIN j{n} USING (host, template) WHERE j{n}.segment = coalesce(segments[{n + 1}], '')),""")
    rule = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'"
        for h, p, v in sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    ) + " END"
    return rf"""
WITH address AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
known AS (
  SELECT page_id, min(quality) AS good FROM address
  JOIN labels ON doc_id = TRY_CAST(regexp_extract(path, '(\d{{1,18}})\D*$', 1) AS BIGINT) GROUP BY page_id),
p0 AS (
  SELECT a.page_id, host, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments, good, '' AS template
  FROM address a LEFT JOIN known USING (page_id)),
{"".join(levels)}
overall AS (SELECT coalesce(avg(good), 1.0) AS overall FROM p0),
purity AS (
  SELECT host, template, (coalesce(sum(good), 0) + {urls.PRIOR_PAGES} * any_value(overall)) / (count(good) + {urls.PRIOR_PAGES})
    AS purity FROM p{SQL_LEVELS}, overall GROUP BY host, template),
ruled AS (SELECT page_id, host, path, template, {rule} AS rule FROM p{SQL_LEVELS})
SELECT page_id, host, path, split_part(rule, '|', 1) AS rule,
  coalesce(split_part(rule, '|', 2), CASE WHEN purity < {urls.LEAST_PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
  template, CAST(round(purity, 6) AS DOUBLE) AS purity
FROM ruled JOIN purity USING (host, template)
"""


ORACLE_SQL["op5_urls"] = _template_sql()
