"""Fingerprints, similarity joins, leader clusters and cluster assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fingerprints
from ..operators import bit_blocks, leaders, libraries, similarity
from ..session import materialise, spread
from .registry import load, query, r6

# Bits of the wide document fingerprint (word 3-grams of the whole text).
WIDE = 2147483647

WORDS = r"""
  words AS (SELECT doc_id, lang, text,
      list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
  tok AS (SELECT doc_id, lang, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS i
          FROM words),
  grams AS (SELECT doc_id, lang, n, i, md5(t || coalesce(' ' || lead(t, 1) OVER o, '')
                                             || coalesce(' ' || lead(t, 2) OVER o, '')) AS h
            FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  hashed AS MATERIALIZED (SELECT doc_id, lang, ('0x' || substr(h, 1, 8))::BIGINT AS x
                          FROM grams WHERE i <= greatest(n - 2, 1))"""

SHINGLES = f"""{WORDS},
  sh AS MATERIALIZED (SELECT DISTINCT doc_id, lang, (x % {WIDE})::INTEGER AS b FROM hashed),
  sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id)"""

# Greedy leaders in doc_id order over the distinct texts of each language.
LEADERS = f"""{SHINGLES},
  firsts AS (SELECT min(doc_id) AS doc_id, lang, any_value(text) AS text
             FROM documents GROUP BY lang, md5(text)),
  nodes AS MATERIALIZED (SELECT f.*, row_number() OVER (ORDER BY f.doc_id) AS i FROM firsts f),
  kept AS MATERIALIZED (SELECT nodes.i, sh.lang, sh.b FROM sh JOIN nodes USING (doc_id)),
  near AS MATERIALIZED (
    SELECT v, list(u) AS us FROM (
      SELECT x.i AS u, y.i AS v, count(*) AS c FROM kept x JOIN kept y
        ON x.b = y.b AND x.lang = y.lang AND x.i < y.i GROUP BY x.i, y.i) p
      JOIN nodes nu ON nu.i = u JOIN nodes nv ON nv.i = v
      JOIN sizes su ON su.doc_id = nu.doc_id JOIN sizes sv ON sv.doc_id = nv.doc_id
    WHERE 100 * c >= 65 * (su.n + sv.n - c) GROUP BY v),
  pick(i, chosen) AS (
    SELECT 0::BIGINT, []::BIGINT[]
    UNION ALL
    SELECT p.i + 1, CASE WHEN n.us IS NOT NULL AND list_has_any(p.chosen, n.us) THEN p.chosen
                         ELSE list_append(p.chosen, p.i + 1) END
    FROM pick p LEFT JOIN near n ON n.v = p.i + 1
    WHERE p.i < (SELECT max(i) FROM nodes)),
  lead AS MATERIALIZED (
    SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS cid
    FROM nodes JOIN (SELECT unnest(chosen) AS i FROM pick
                     WHERE i = (SELECT max(i) FROM nodes)) USING (i))"""


def document_bits(spark, sf):
    """The bits of the documents, a digest in place of their text, and a number for each row."""
    docs = spread(load(spark, sf, "documents").select("doc_id", "lang", "text"))
    bits = fingerprints.word_gram_bits(F.col("text"), 3, WIDE)
    numbered = docs.select(
        "doc_id", "lang", F.md5("text").alias("text"), bits.alias("bits"), F.monotonically_increasing_id().alias("row")
    )
    return materialise(numbered, "documents")


def document_leaders(docs):
    """The leaders of the distinct texts (``lang, doc_id, row``), and the order of tokens."""
    firsts = libraries.dedup_keep_first(docs.select("lang", "text", "doc_id", "row"), ["lang", "text"], "doc_id")
    firsts = materialise(firsts.select("lang", "doc_id", "row"), "firsts")
    order = similarity.token_order([docs], "bits")
    rows = docs.join(firsts.select("row"), "row", "left_semi")
    lead = leaders.leader_cluster(rows, "lang", "doc_id", "bits", 0.65, order=order)
    return lead, firsts, order


def _leading_rows(lead, firsts):
    return materialise(firsts.join(lead, ["lang", "doc_id"], "left_semi"), "leaders")


@query(f"""
  WITH {WORDS}, d AS (SELECT DISTINCT doc_id, (x % 1024)::INTEGER AS b FROM hashed)
  SELECT doc_id, count(*)::INTEGER AS n_set, string_agg(b::VARCHAR, ',' ORDER BY b) AS bits
  FROM d GROUP BY doc_id""")
def fingerprint_qgram(spark, sf):
    bits = fingerprints.qgram_fingerprint(F.col("text"), q=3, n_bits=1024, unit="word")
    docs = spread(load(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", bits.alias("bits")).select(
        "doc_id", F.size("bits").alias("n_set"), F.array_join("bits", ",").alias("bits")
    )


# Vowels, consonants and blanks as three classes.
CLASSES = ("abcdefghijklmnopqrstuvwxyz ", "vcccvcccvcccccvcccccvcccccs")


def _char_grams(text: str, q: int) -> str:
    return (
        f"(SELECT p_partkey, md5(substr(s, unnest(range(1, greatest(length(s) - {q - 1}, 1) + 1))"
        f", {q})) AS h FROM (SELECT p_partkey, {text} AS s FROM part))"
    )


@query(f"""
  SELECT p_partkey, count(*)::INTEGER AS n_set, string_agg(b::VARCHAR, ',' ORDER BY b) AS bits
  FROM (SELECT DISTINCT p_partkey, ('0x' || substr(h, 1, 8))::BIGINT % 1024 AS b
        FROM {_char_grams(f"translate(p_name, '{CLASSES[0]}', '{CLASSES[1]}')", 4)})
  GROUP BY p_partkey""")
def fingerprint_classmap(spark, sf):
    bits = fingerprints.qgram_fingerprint(F.col("p_name"), q=4, class_map=CLASSES)
    return load(spark, sf, "part").select("p_partkey", bits.alias("bits")).select(
        "p_partkey", F.size("bits").alias("n_set"), F.array_join("bits", ",").alias("bits")
    )


@query(f"""
  WITH g AS {_char_grams("p_name", 5)}
  SELECT p_partkey, count(*)::INTEGER AS n_set, string_agg(b::VARCHAR, ',' ORDER BY b) AS bits
  FROM (SELECT p_partkey, ('0x' || substr(h, 1, 8))::BIGINT % 1024 AS b FROM g
        UNION SELECT p_partkey, ('0x' || substr(h, 9, 8))::BIGINT % 1024 FROM g)
  GROUP BY p_partkey""")
def fingerprint_2hash(spark, sf):
    bits = fingerprints.qgram_fingerprint(F.col("p_name"), q=5, hashes_per_feature=2)
    return load(spark, sf, "part").select("p_partkey", bits.alias("bits")).select(
        "p_partkey", F.size("bits").alias("n_set"), F.array_join("bits", ",").alias("bits")
    )


SIGNS = """
  signs AS MATERIALIZED (SELECT vec_id, label,
      list_filter(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN i - 1 END),
                  lambda i: i IS NOT NULL) AS bits FROM embeddings)"""


@query(f"""
  WITH {SIGNS} SELECT vec_id, len(bits)::INTEGER AS n_set, array_to_string(bits, ',') AS bits
  FROM signs""")
def bits_from_array(spark, sf):
    row = F.transform("embedding", lambda x: (x > 0).cast("int"))
    return load(spark, sf, "embeddings").select(
        "vec_id", fingerprints.bits_from_array(row).alias("bits")
    ).select("vec_id", F.size("bits").alias("n_set"), F.array_join("bits", ",").alias("bits"))


# Greedy leaders of the sign bits at similarity 0.45, in vec_id order, all in one data set.
SIGN_LEADERS = f"""{SIGNS},
  firsts AS (SELECT min(vec_id) AS vec_id, any_value(bits) AS bits FROM signs
             GROUP BY array_to_string(bits, ',')),
  nodes AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id) AS i FROM firsts),
  near AS MATERIALIZED (
    SELECT v, list(u) AS us FROM (
      SELECT x.i AS u, y.i AS v, len(list_intersect(x.bits, y.bits)) AS c,
             len(x.bits) + len(y.bits) AS t FROM nodes x JOIN nodes y ON x.i < y.i)
    WHERE 100 * c >= 45 * (t - c) GROUP BY v),
  pick(i, chosen) AS (
    SELECT 0::BIGINT, []::BIGINT[]
    UNION ALL
    SELECT p.i + 1, CASE WHEN n.us IS NOT NULL AND list_has_any(p.chosen, n.us) THEN p.chosen
                         ELSE list_append(p.chosen, p.i + 1) END
    FROM pick p LEFT JOIN near n ON n.v = p.i + 1
    WHERE p.i < (SELECT max(i) FROM nodes)),
  lead AS MATERIALIZED (
    SELECT vec_id, bits, row_number() OVER (ORDER BY vec_id) - 1 AS cid
    FROM nodes JOIN (SELECT unnest(chosen) AS i FROM pick
                     WHERE i = (SELECT max(i) FROM nodes)) USING (i)),
  scored AS MATERIALIZED (
    SELECT s.vec_id, l.vec_id AS leader, l.cid, len(list_intersect(s.bits, l.bits)) AS c,
           len(s.bits) AS na, len(l.bits) AS nb, s.bits = l.bits AS same
    FROM signs s, lead l)"""


def _sign_leaders(spark, sf):
    rows = materialise(
        load(spark, sf, "embeddings").select(
            F.lit("all").alias("Dataset"),
            "vec_id",
            fingerprints.sign_bits(F.col("embedding")).alias("bits"),
        ).withColumn("key", F.array_join("bits", ",")),
        "signs",
    )
    firsts = libraries.dedup_keep_first(rows, ["Dataset", "key"], "vec_id")
    width = 1 + (rows.agg(F.max(F.array_max("bits"))).first()[0] or 0)
    lead = leaders.leader_cluster(firsts, "Dataset", "vec_id", "bits", 0.45, n_bits=width)
    return rows, materialise(firsts.join(lead, ["Dataset", "vec_id"], "left_semi"), "leaders"), width


@query(f"""
  WITH RECURSIVE {SIGN_LEADERS}
  SELECT vec_id, leader, c::BIGINT AS n_shared, round(c::DOUBLE / (na + nb - c), 6) AS similarity
  FROM scored WHERE 100 * c >= 35 * (na + nb - c) AND c > 0""")
def tanimoto_pairs(spark, sf):
    """Bulk similarity of every row with every leader, from 0.35 up."""
    rows, lead, width = _sign_leaders(spark, sf)
    return similarity.similarity_join(rows, lead, ["Dataset"], "vec_id", "bits", 0.35, n_bits=width).select(
        F.col("id_a").alias("vec_id"), F.col("id_b").alias("leader"), "n_shared",
        r6(similarity.tanimoto()).alias("similarity"),
    )


@query(f"""
  WITH RECURSIVE {SIGN_LEADERS},
  best AS (SELECT vec_id, cid, row_number() OVER (PARTITION BY vec_id ORDER BY same DESC,
             c::DOUBLE / greatest(na + nb - c, 1) DESC, cid) AS rn FROM scored)
  SELECT vec_id, cid AS cluster_ID FROM best WHERE rn = 1""")
def assign_nearest_bits(spark, sf):
    """Nearest centroid where many rows are far from all."""
    rows, lead, width = _sign_leaders(spark, sf)
    nodes = similarity.number_centroids(lead, "Dataset", "vec_id")
    return similarity.assign_clusters(
        rows, nodes, "Dataset", "key", "bits", tiers=(0.65, 0.5, 0.0), n_bits=width
    ).select("vec_id", "cluster_ID")


@query(f"WITH RECURSIVE {LEADERS} SELECT lang AS Dataset, doc_id AS row_id FROM lead")
def leader_cluster(spark, sf):
    lead, _, _ = document_leaders(document_bits(spark, sf))
    return lead.select(F.col("lang").alias("Dataset"), F.col("doc_id").alias("row_id"))


@query(f"""
  WITH RECURSIVE {LEADERS} SELECT lang, count(*) AS n_clusters FROM lead GROUP BY lang""")
def cluster_counts(spark, sf):
    lead, _, _ = document_leaders(document_bits(spark, sf))
    return leaders.cluster_counts(lead, "lang")


_ROW_LEADER = f"""{LEADERS},
  common AS (SELECT s.doc_id, s.lang, l.doc_id AS leader, l.cid, count(*) AS c
             FROM sh s JOIN (SELECT lead.doc_id, lead.cid, sh.lang, sh.b
                             FROM lead JOIN sh USING (doc_id)) l
               ON l.b = s.b AND l.lang = s.lang GROUP BY ALL),
  rated AS MATERIALIZED (
    SELECT common.*, a.n AS na, b.n AS nb FROM common JOIN sizes a ON a.doc_id = common.doc_id
    JOIN sizes b ON b.doc_id = common.leader)"""


@query(f"""
  WITH RECURSIVE {_ROW_LEADER}
  SELECT lang AS Dataset, doc_id AS row_id, leader, c AS n_shared,
         round(c::DOUBLE / (na + nb - c), 6) AS similarity
  FROM rated WHERE 100 * c >= 65 * (na + nb - c)""")
def similarity_join_exact(spark, sf):
    """Every document with all leaders of its language at similarity 0.65 or more."""
    docs = document_bits(spark, sf)
    lead, firsts, order = document_leaders(docs)
    nodes = docs.join(_leading_rows(lead, firsts).select("row"), "row", "left_semi")
    return similarity.similarity_join(docs, nodes, ["lang"], "doc_id", "bits", 0.65, order=order).select(
        F.col("lang").alias("Dataset"), F.col("id_a").alias("row_id"),
        F.col("id_b").alias("leader"), "n_shared", r6(similarity.tanimoto()).alias("similarity"),
    )


def _document_centroids(spark, sf):
    docs = document_bits(spark, sf)
    lead, firsts, order = document_leaders(docs)
    numbers = similarity.number_centroids(_leading_rows(lead, firsts), "lang", "doc_id")
    return docs, docs.join(numbers.select("row", "cluster_ID"), "row"), order


@query(f"""
  WITH RECURSIVE {LEADERS}
  SELECT d.doc_id, d.lang, l.cid AS cluster_ID FROM documents d
  JOIN lead l ON l.lang = d.lang AND l.text = d.text""")
def assign_exact(spark, sf):
    docs, nodes, _ = _document_centroids(spark, sf)
    return similarity.assign_exact(docs, nodes, "lang", "text").select(
        "doc_id", "lang", "cluster_ID"
    )


@query(f"""
  WITH RECURSIVE {_ROW_LEADER},
  exact AS (SELECT d.doc_id, l.cid FROM documents d
            JOIN lead l ON l.lang = d.lang AND l.text = d.text),
  best AS (SELECT doc_id, cid, row_number() OVER (PARTITION BY doc_id
             ORDER BY c::DOUBLE / (na + nb - c) DESC, cid) AS rn FROM rated)
  SELECT d.doc_id, d.lang, coalesce(e.cid, b.cid, 0) AS cluster_ID FROM documents d
  LEFT JOIN exact e USING (doc_id) LEFT JOIN (FROM best WHERE rn = 1) b USING (doc_id)""")
def assign_nearest(spark, sf):
    docs, nodes, order = _document_centroids(spark, sf)
    nodes = materialise(nodes, "centroids")
    return similarity.assign_clusters(docs, nodes, "lang", "text", "bits", order=order).select(
        "doc_id", "lang", "cluster_ID"
    )


# Fixed-width fingerprints: the documents' word 3-grams in 1024 bits.
_DENSE = _ROW_LEADER.replace(f"% {WIDE}", "% 1024")


def dense_documents(spark, sf):
    docs = spread(load(spark, sf, "documents").select("doc_id", "lang", "text"))
    bits = fingerprints.word_gram_bits(F.col("text"), 3, 1024)
    return materialise(docs.select("doc_id", "lang", F.md5("text").alias("text"), bits.alias("bits")), "dense")


def _dense(spark, sf):
    rows = dense_documents(spark, sf)
    firsts = libraries.dedup_keep_first(rows, ["lang", "text"], "doc_id")
    lead = materialise(leaders.leader_cluster(firsts, "lang", "doc_id", "bits", 0.65, n_bits=1024), "leaders")
    nodes = similarity.number_centroids(firsts.join(lead, ["lang", "doc_id"], "left_semi"), "lang", "doc_id")
    return rows, materialise(nodes, "centroids")


@query(f"""
  WITH RECURSIVE {_DENSE}
  SELECT lang AS Dataset, doc_id AS row_id, leader, c AS n_shared,
         round(c::DOUBLE / (na + nb - c), 6) AS similarity
  FROM rated WHERE 100 * c >= 65 * (na + nb - c)""")
def similarity_join_1024(spark, sf):
    """Every document with the leaders of its language, on 1024-bit fingerprints."""
    rows, lead = _dense(spark, sf)
    return bit_blocks.block_join(rows, lead, ["lang"], "doc_id", "bits", 1024, 0.65).select(
        F.col("lang").alias("Dataset"), F.col("id_a").alias("row_id"),
        F.col("id_b").alias("leader"), "n_shared", r6(similarity.tanimoto()).alias("similarity"),
    )


@query(f"""
  WITH RECURSIVE {_DENSE},
  exact AS (SELECT d.doc_id, min(l.cid) AS cid FROM documents d
            JOIN lead l ON l.lang = d.lang AND l.text = d.text GROUP BY d.doc_id),
  best AS (SELECT doc_id, cid, row_number() OVER (PARTITION BY doc_id
             ORDER BY c::DOUBLE / (na + nb - c) DESC, cid) AS rn FROM rated)
  SELECT d.doc_id, d.lang, coalesce(e.cid, b.cid, 0) AS cluster_ID FROM documents d
  LEFT JOIN exact e USING (doc_id) LEFT JOIN (FROM best WHERE rn = 1) b USING (doc_id)""")
def assign_nearest_1024(spark, sf):
    rows, lead = _dense(spark, sf)
    return similarity.assign_clusters(
        rows, lead, "lang", "text", "bits", n_bits=1024
    ).select("doc_id", "lang", "cluster_ID")


@query(f"""
  WITH RECURSIVE {LEADERS.replace(f"% {WIDE}", "% 1024")}
  SELECT lang AS Dataset, doc_id AS row_id FROM lead""")
def leader_cluster_1024(spark, sf):
    """Leaders on 1024-bit fingerprints."""
    firsts = libraries.dedup_keep_first(dense_documents(spark, sf), ["lang", "text"], "doc_id")
    lead = leaders.leader_cluster(firsts, "lang", "doc_id", "bits", 0.65, n_bits=1024)
    return lead.select(F.col("lang").alias("Dataset"), F.col("doc_id").alias("row_id"))


# The documents as two libraries, one after the other: leaders of the first one come first.
_IN_ORDER = (
    LEADERS.replace(f"% {WIDE}", "% 1024")
    .replace("SELECT min(doc_id) AS doc_id, lang, any_value(text) AS text",
             "SELECT min_by(doc_id, (second, doc_id)) AS doc_id, lang, any_value(text) AS text")
    .replace("FROM documents GROUP BY lang, md5(text)", "FROM ordered GROUP BY lang, md5(text)")
    .replace("row_number() OVER (ORDER BY f.doc_id) AS i FROM firsts f",
             "row_number() OVER (ORDER BY o.second, f.doc_id) AS i FROM firsts f JOIN ordered o USING (doc_id)")
    .replace("SELECT f.*,", "SELECT f.*, o.second,")
    .replace("SELECT doc_id, lang, text, row_number()", "SELECT doc_id, lang, text, second, row_number()")
)


@query(f"""
  WITH RECURSIVE ordered AS (SELECT *, coalesce((source >= 'src2')::INTEGER, 1) AS second FROM documents), {_IN_ORDER}
  SELECT lang AS Dataset, doc_id AS row_id, second AS library FROM lead""")
def leader_incremental(spark, sf):
    """Leaders of a first library of documents, and those that a second one adds to them."""
    second = F.coalesce((F.col("source") >= "src2").cast("int"), F.lit(1))
    part = load(spark, sf, "documents").select("doc_id", second.alias("library"))
    docs = dense_documents(spark, sf).join(part, "doc_id").withColumn("place", F.struct("library", "doc_id"))
    firsts = materialise(libraries.dedup_keep_first(docs, ["lang", "text"], "place"), "firsts")
    stored = None
    for n in (0, 1):
        rows = firsts.where(F.col("library") == n)
        stored = materialise(leaders.add_library(stored, rows, "lang", "doc_id", "bits", 0.65, n_bits=1024), "leaders")
    return stored.join(part, "doc_id").select(F.col("lang").alias("Dataset"), F.col("doc_id").alias("row_id"), "library")
