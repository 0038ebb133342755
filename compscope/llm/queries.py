"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Registry, finite, load
from .html_text import extract_text
from .language_id import identify_languages
from .line_dedup import line_dedup
from .nearest import nearest_neighbours
from .ngram_join import ngram_groups
from .packing import pack_documents
from .phrases import mine_phrases
from .secret_scan import scan_secrets
from .sentencepiece_codec import encode_texts
from .token_counts import token_counts
from .token_output import training_order
from .topk_search import exact_topk
from .whitening import whiten

REGISTRY = Registry()
QUERIES, ORACLES = REGISTRY.queries, REGISTRY.oracles
query = REGISTRY.query

GOOD_VECTOR = """embedding IS NOT NULL AND len(list_filter(embedding,
      lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""


@query()
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(load(spark, sf_dir, "pages"))


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), limit=512)


@query()
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(load(spark, sf_dir, "documents"))


@query()
def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(load(spark, sf_dir, "documents"), end_id=2, capacity=1024)


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(load(spark, sf_dir, "documents"))


@query(
    f"""
  WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND {GOOD_VECTOR}),
  s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
  r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM s)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
)
def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")))
    return exact_topk(
        load(spark, sf_dir, "embeddings"), "vec_id",
        F.when(finite(F.col("embedding")), whole), F.col("vec_id") % 100 == 0, k=10,
    )


@query(
    r"""
  WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w
    FROM documents),
  s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []
      WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1),
             lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END AS g
    FROM d),
  u AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
  p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
    FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (
    SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)
    UNION ALL SELECT b, a FROM p WHERE 100 * c >= 90 * (na + nb - c)),
  r AS (
    SELECT doc_id AS id, doc_id AS root FROM documents
    UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
  SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, low AS component_id
  FROM s JOIN (SELECT id, min(root) AS low FROM r GROUP BY id) ON id = doc_id"""
)
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(load(spark, sf_dir, "documents"), k=3, num=90, den=100)


@query()
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(load(spark, sf_dir, "documents"))


@query()
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), end_id=2, capacity=1024)


@query(
    f"""
  WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND {GOOD_VECTOR}
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]),
                       lambda a, b: a + b) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
  r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM s)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
)
def op10_block_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(
        load(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20
    )


@query(
    r"""
  WITH l AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  k AS (
    SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM l),
  s AS (
    SELECT *, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM k),
  g AS (SELECT key FROM s WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
  SELECT doc_id, count(*) AS n_lines, count(g.key) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
  FROM s LEFT JOIN g ON s.key = g.key GROUP BY doc_id"""
)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(load(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"), components=32)


@query(
    r"""
  WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
  g AS (
    SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) FROM w
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1),
      lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) FROM w),
  f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL),
  t AS (SELECT *, string_split(phrase, ' ') AS x FROM f WHERE k > 1 AND a >= 10),
  o AS (
    SELECT lang, phrase, max(a) AS most FROM (
      SELECT lang, concat(x[1], ' ', x[2]) AS phrase, a FROM t WHERE k = 3
      UNION ALL SELECT lang, concat(x[2], ' ', x[3]), a FROM t WHERE k = 3) GROUP BY ALL),
  c AS (
    SELECT t.lang, t.phrase, t.a, unnest(range(1, t.k)) AS cut, t.x
    FROM t LEFT JOIN o ON o.lang = t.lang AND o.phrase = t.phrase AND t.k = 2
    WHERE most IS NULL OR 100 * most < 50 * t.a),
  s AS (
    SELECT c.lang, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, (1000000 * c.a * c.a) // (l.a * r.a) AS score
    FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.x[:c.cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.x[c.cut + 1:], ' ')),
  b AS (
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang)
  SELECT b.lang, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank,
    phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
  FROM b JOIN n ON n.lang = b.lang QUALIFY rank <= 2000"""
)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(load(spark, sf_dir, "documents"), min_count=10, top=2_000, contained_pct=50)
