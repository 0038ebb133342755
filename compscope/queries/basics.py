"""Ingest, projection, validation, distinct keys, overlap, profile tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fingerprints, scalars
from ..operators import libraries, ordered, profile, ranking, sketches
from .registry import LINE_ID, ORACLES, PREDICTED, SCORE_VIEW, load, query, r6, score_view

PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(
    " UNION ALL ".join(
        f"SELECT p_partkey, p_name AS Structure, 'LIB-{i}' AS Dataset FROM part WHERE p_type = '{t}'"
        for i, t in enumerate(PART_TYPES, 1)
    )
)
def ingest_tag_union(spark, sf):
    part = load(spark, sf, "part")
    libs = [
        part.where(F.col("p_type") == t).select("p_partkey", F.col("p_name").alias("Structure"))
        for t in PART_TYPES
    ]
    return libraries.tag_libraries(libs)


@query("""
  SELECT doc_id AS row_id, md5(text) AS structure_md5, lang AS Dataset FROM documents
  UNION ALL SELECT item_id, md5(text), 'reference' FROM benchmark""")
def attach_reference(spark, sf):
    docs = load(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.md5("text").alias("structure_md5"),
        F.col("lang").alias("Dataset"),
    )
    ref = load(spark, sf, "benchmark").select(
        F.col("item_id").alias("row_id"), F.md5("text").alias("structure_md5")
    )
    return libraries.attach_reference(docs, ref)


@query(f"""
  SELECT row_id, l_quantity FROM (SELECT {LINE_ID} AS row_id, l_quantity FROM lineitem)
  ORDER BY md5('42|' || row_id), row_id LIMIT 10000""")
def sample_cap_n(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.expr(LINE_ID).alias("row_id"), "l_quantity")
    return libraries.sample_rows(rows, "row_id", 10_000)


@query("""
  (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 2)
  UNION ALL
  (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 2)""")
def head_tail_preview(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return libraries.head_tail(orders, "o_orderkey", 2)


@query(f"""
  SELECT descriptor, algo, round(avg(score), 6) AS score FROM ({SCORE_VIEW})
  WHERE descriptor = 'N' AND algo = 'O' GROUP BY descriptor, algo""")
def best_model_pick(spark, sf):
    from ..operators.models import pick_model

    bench = score_view(spark, sf).groupBy(F.col("descriptor").alias("desc"), "algo").agg(
        r6(F.avg("score")).alias("score")
    )
    return pick_model(bench, "O", "N").select(F.col("desc").alias("descriptor"), "algo", "score")


_CANON = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def _validated(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang")
    return libraries.validate_key(
        docs, "text", libraries.collapse_whitespace, lambda c: F.length(c) >= 100
    )


@query(f"""
  SELECT doc_id, lang, md5({_CANON}) AS canon_md5, length({_CANON}) AS canon_chars
  FROM documents WHERE length({_CANON}) >= 100""")
def normalise_valid(spark, sf):
    clean, _ = _validated(spark, sf)
    return clean.select(
        "doc_id", "lang", F.md5("text").alias("canon_md5"),
        F.length("text").cast("bigint").alias("canon_chars"),
    )


@query(f"""
  SELECT doc_id, lang, md5(text) AS text_md5 FROM documents
  WHERE text IS NULL OR length({_CANON}) < 100""")
def normalise_rejects(spark, sf):
    _, rejects = _validated(spark, sf)
    return rejects.select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("""
  SELECT count(*) AS n_rows, count(v) AS n_numeric, count(*) - count(v) AS n_rejected
  FROM (SELECT try_cast(regexp_extract(props, '"k": *([^,}]*)', 1) AS DOUBLE) AS v FROM events)""")
def numeric_target_check(spark, sf):
    props = load(spark, sf, "events").select(F.get_json_object("props", "$.k").alias("target"))
    _, report = libraries.cast_numeric_target(props, "target")
    return report


@query(f"""
  SELECT {LINE_ID} AS row_id, l_extendedprice > m AS cat,
         CASE WHEN l_extendedprice > m THEN 'high' ELSE 'low' END AS classification
  FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem)""")
def binarise_target(spark, sf):
    line = load(spark, sf, "lineitem").select(
        F.expr(LINE_ID).alias("row_id"), "l_extendedprice"
    )
    cut = ordered.scalar_quantiles(line, "l_extendedprice", [0.5])[0]
    cat = scalars.binarise(F.col("l_extendedprice"), cut)
    return line.select("row_id", cat.alias("cat"), scalars.class_name(cat).alias("classification"))


@query("""
  SELECT count(*) AS n_rows,
         round(avg(CASE WHEN l_extendedprice > m THEN 1 ELSE 0 END) * 100, 6) AS positive_pct
  FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem)""")
def positive_fraction(spark, sf):
    line = load(spark, sf, "lineitem").select("l_extendedprice")
    cut = ordered.scalar_quantiles(line, "l_extendedprice", [0.5])[0]
    out = profile.positive_fraction(line, scalars.binarise(F.col("l_extendedprice"), cut))
    return out.withColumn("positive_pct", r6("positive_pct"))


@query("""
  SELECT event_id,
         format('exp: {:.2f} | pred: {:.2f}', value, floor(value) + 0.25e0) AS label,
         format('pred: {:.2f}', floor(value) + 0.25e0) AS label_blind
  FROM events""")
def format_label(spark, sf):
    pred = F.floor("value") + F.lit(0.25)
    return load(spark, sf, "events").select(
        "event_id",
        scalars.prediction_label(pred, F.col("value")).alias("label"),
        scalars.prediction_label(pred).alias("label_blind"),
    )


@query(f"""
  SELECT {LINE_ID} AS row_id, round(abs(l_extendedprice - ({PREDICTED})), 6) AS abs_error,
         l_extendedprice > 35000 AS exp_class FROM lineitem""")
def abs_error(spark, sf):
    return load(spark, sf, "lineitem").select(
        F.expr(LINE_ID).alias("row_id"),
        r6(F.abs(F.col("l_extendedprice") - F.expr(PREDICTED))).alias("abs_error"),
        (F.col("l_extendedprice") > 35000).alias("exp_class"),
    )


@query(f"""
  SELECT {LINE_ID} AS row_id,
         round_even(l_extendedprice * l_discount / 1000e0 * 10000e0, 0) / 10000e0 AS rounded4,
         round_even(l_quantity / 2e0, 0) AS rounded0 FROM lineitem""")
def round_half_even(spark, sf):
    return load(spark, sf, "lineitem").select(
        F.expr(LINE_ID).alias("row_id"),
        scalars.round_half_even(
            F.col("l_extendedprice") * F.col("l_discount") / F.lit(1000.0), 4
        ).alias("rounded4"),
        scalars.round_half_even(F.col("l_quantity") / F.lit(2.0), 0).alias("rounded0"),
    )


@query("""
  SELECT vec_id, i - 1 AS pos, greatest(-1e5, least(1e5, embedding[i]::DOUBLE * 1e6)) AS value
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def clip_nan_vector(spark, sf):
    emb = load(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * 1e6)
    return emb.select("vec_id", F.posexplode(scalars.clip_vector(scaled)).alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), "value"
    )


@query("""
  SELECT c_custkey, c_mktsegment,
         (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS label FROM customer""")
def label_encode(spark, sf):
    cust = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return libraries.label_encode(cust, "c_mktsegment")


@query("""
  SELECT p_type, p_name, p_partkey, p_brand FROM
    (SELECT *, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS rn FROM part)
  WHERE rn = 1""")
def dedup_keep_first(spark, sf):
    part = load(spark, sf, "part").select("p_type", "p_name", "p_partkey", "p_brand")
    return libraries.dedup_keep_first(part, ["p_type", "p_name"], "p_partkey")


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

# A key that the event types share in part: the user and a tenth of the value.
EVENT_KEY = "concat_ws('-', user_id, CAST(floor(value / 10) AS BIGINT))"
HITS = f"(SELECT event_type, {EVENT_KEY} AS hit FROM events)"


def _hits(spark, sf):
    return load(spark, sf, "events").select("event_type", F.expr(EVENT_KEY).alias("hit"))


@query(f"""
  WITH bits AS (SELECT hit, bit_or(CASE event_type
      {' '.join(f"WHEN '{t}' THEN {1 << i}" for i, t in enumerate(EVENT_TYPES))} END) AS m
      FROM {HITS} GROUP BY hit),
    n AS (SELECT m, count(*) AS n FROM bits GROUP BY m)
  SELECT r.m::BIGINT AS region_mask,
    concat_ws('&', {', '.join(f"CASE WHEN r.m & {1 << i} <> 0 THEN '{t}' END"
                              for i, t in enumerate(EVENT_TYPES))}) AS region,
    coalesce(n.n, 0)::BIGINT AS n_keys
  FROM (SELECT unnest(range(1, 32)) AS m) r LEFT JOIN n ON n.m = r.m""")
def overlap_regions(spark, sf):
    return libraries.overlap_regions(_hits(spark, sf), "hit", "event_type", include_empty=True)


@query(f"""
  SELECT event_type AS Dataset, count(DISTINCT hit) AS n_keys, true AS within
  FROM {HITS} GROUP BY event_type""")
def sketch_unique(spark, sf):
    """Exact counts, and whether the bounds from sketches hold them."""
    hits = _hits(spark, sf)
    exact = hits.groupBy(F.col("event_type").alias("Dataset")).agg(F.count_distinct("hit").alias("n_keys"))
    found = sketches.unique_from_sketches(sketches.sketch_keys(hits, "event_type", "hit"))
    return exact.join(found, "Dataset").select(
        "Dataset", "n_keys", F.col("n_keys").between(F.col("low"), F.col("high")).alias("within")
    )


@query(ORACLES["overlap_regions"].replace("AS n_keys", "AS n_keys, true AS within"))
def sketch_overlap(spark, sf):
    """Exact regions, and whether the bounds from sketches hold their sizes."""
    hits = _hits(spark, sf)
    exact = libraries.overlap_regions(hits, "hit", "event_type", EVENT_TYPES, include_empty=True)
    found = sketches.overlap_from_sketches(sketches.sketch_keys(hits, "event_type", "hit"), EVENT_TYPES)
    return exact.join(found.drop("region"), "region_mask").select(
        "region_mask", "region", "n_keys", F.col("n_keys").between(F.col("low"), F.col("high")).alias("within")
    )


@query(f"""
  SELECT DISTINCT hit FROM {HITS} WHERE event_type = 'click'
  EXCEPT SELECT hit FROM {HITS} WHERE event_type = 'error'""")
def novel_keys(spark, sf):
    hits = _hits(spark, sf)
    return libraries.novel_keys(
        hits.where("event_type = 'click'"), hits.where("event_type = 'error'"), "hit"
    )


@query(f"""
  SELECT DISTINCT hit FROM {HITS} WHERE event_type = 'click'
  INTERSECT SELECT hit FROM {HITS} WHERE event_type = 'error'""")
def shared_keys(spark, sf):
    hits = _hits(spark, sf)
    return libraries.shared_keys(
        hits.where("event_type = 'click'"), hits.where("event_type = 'error'"), "hit"
    )


@query("SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS BM FROM part")
def derive_group_key(spark, sf):
    part = load(spark, sf, "part").select("p_partkey", "p_name")
    return libraries.derive_group_key(
        part, "p_name", lambda c: F.split_part(c, F.lit(" "), F.lit(1)), "BM"
    )


@query("SELECT p_type, count(DISTINCT p_name) AS n_unique FROM part GROUP BY p_type")
def unique_keys_per_dataset(spark, sf):
    return profile.unique_keys_per_dataset(load(spark, sf, "part"), "p_type", "p_name")


@query("""
  WITH f AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id
                                          ORDER BY value DESC, event_id) = 1 AS first FROM events),
    w AS (SELECT event_type, event_id,
        count(*) OVER o AS rank, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER o AS scaff,
        sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER o AS pos,
        count(*) OVER (PARTITION BY event_type) AS n
      FROM f WINDOW o AS (PARTITION BY event_type ORDER BY value DESC, event_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT event_type AS Dataset, rank::BIGINT AS rank, event_id AS row_id,
         scaff::BIGINT AS scaff_addr, round(pos::DOUBLE / n, 6) AS cmpd_addr FROM w""")
def addressability_curve(spark, sf):
    events = load(spark, sf, "events").select("event_id", "event_type", "user_id", "value")
    curve = ranking.addressability_curve(
        events, "event_type", "user_id", "value", "event_id", threshold=50
    )
    return curve.withColumn("cmpd_addr", r6("cmpd_addr"))


@query("""
  SELECT event_type, event_id, count(*) OVER o AS n_so_far,
         (sum(round_even(value * 100e0, 0)::BIGINT) OVER o)::BIGINT AS cents_so_far
  FROM events WINDOW o AS (PARTITION BY event_type ORDER BY value DESC, event_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def prefix_sum(spark, sf):
    events = load(spark, sf, "events").select("event_type", "event_id", "value")
    return ordered.running_totals(
        events,
        ["event_type"],
        [F.col("value").desc(), F.col("event_id").asc()],
        {
            "n_so_far": F.lit(1).cast("bigint"),
            "cents_so_far": F.rint(F.col("value") * 100).cast("bigint"),
        },
    ).drop("value")


@query("""
  SELECT event_type, min(value) AS lo, max(value) AS hi,
         round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type""")
def score_threshold_stats(spark, sf):
    events = load(spark, sf, "events").select("event_type", "value")
    return ranking.score_threshold_stats(events, "event_type", "value").withColumn(
        "median", r6("median")
    )


@query("""
  SELECT user_id, event_type, event_id, value FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
                                  ORDER BY value DESC, event_id) AS rn FROM events)
  WHERE rn = 1""")
def best_per_cluster(spark, sf):
    events = load(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return ranking.best_per_cluster(events, "event_type", "user_id", "value", "event_id")


_TWO_LIBRARIES = """
  SELECT 'A' AS lib, event_id, user_id, value FROM events
  UNION ALL SELECT 'B', event_id, user_id % 7, round(value * 7e0 % 10e0, 2) FROM events"""


@query(f"""
  WITH e AS ({_TWO_LIBRARIES}),
    f AS (SELECT *, row_number() OVER (PARTITION BY lib, user_id
                                       ORDER BY value DESC, event_id) = 1 AS first FROM e)
  SELECT lib AS "Dataset", (count(*) OVER o)::BIGINT AS rank, event_id AS row_id,
    (sum(CASE WHEN first THEN 1 ELSE 0 END) OVER o)::BIGINT AS scaff_addr,
    round((sum(CASE WHEN value > 5 THEN 1 ELSE 0 END) OVER o)::DOUBLE
          / count(*) OVER (PARTITION BY lib), 6) AS cmpd_addr
  FROM f WINDOW o AS (PARTITION BY lib ORDER BY value DESC, event_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def curve_per_library_ids(spark, sf):
    """Two libraries whose ids repeat: every id is in both."""
    events = load(spark, sf, "events").select("event_id", "user_id", "value")
    second = events.select(
        "event_id", (F.col("user_id") % 7).alias("user_id"),
        F.round(F.col("value") * F.lit(7.0) % F.lit(10.0), 2).alias("value"),
    )
    both = events.withColumn("lib", F.lit("A")).unionByName(second.withColumn("lib", F.lit("B")))
    curve = ranking.addressability_curve(both, "lib", "user_id", "value", "event_id", threshold=5)
    return curve.withColumn("cmpd_addr", r6("cmpd_addr"))


@query("""
  SELECT user_id, event_type, id, value FROM
    (SELECT *, concat('e', event_id) AS id, row_number() OVER (
       PARTITION BY user_id, event_type ORDER BY value DESC, concat('e', event_id)) AS rn FROM events)
  WHERE rn = 1""")
def best_text_ids(spark, sf):
    """Ids are texts and are compared as texts."""
    events = load(spark, sf, "events").select(
        "user_id", "event_type", F.concat(F.lit("e"), F.col("event_id")).alias("id"), "value"
    )
    return ranking.best_per_cluster(events, "event_type", "user_id", "value", "id")


@query("""
  SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 100""")
def top_k_scored(spark, sf):
    events = load(spark, sf, "events").select("event_id", "event_type", "value")
    return ranking.order_by_score(events, "value", "event_id", k=100)


_PROBS = (0.05, 0.25, 0.5, 0.9)


@query(f"""
  WITH q AS (SELECT event_type, quantile_cont(value, {list(_PROBS)}) AS q FROM events GROUP BY event_type)
  SELECT path, event_type, {', '.join(f'round(q[{i}], 6) AS q{i}' for i in range(1, 5))}
  FROM q, (SELECT unnest(['one task', 'two levels']) AS path)""")
def quantiles_bracketed(spark, sf):
    """Both ways of ranking the values inside the brackets."""
    events = load(spark, sf, "events").select("event_type", "value")
    paths = [
        ordered.exact_quantiles(events, ["event_type"], "value", _PROBS, window_group=size).withColumn(
            "path", F.lit(path))
        for path, size in (("one task", 10**9), ("two levels", 0))
    ]
    return paths[0].unionByName(paths[1]).select(
        "path", "event_type", *[r6(F.col("quantiles")[i - 1]).alias(f"q{i}") for i in range(1, 5)]
    )


_EDGES = ", ".join(f"{i / 10}" for i in range(11))


@query(f"""
  WITH e AS (SELECT list_distinct(quantile_cont(l_extendedprice, [{_EDGES}])) AS edges
             FROM lineitem)
  SELECT {LINE_ID} AS row_id,
         greatest(len(list_filter(edges, lambda x: x < l_extendedprice)) - 1, 0)::INTEGER AS bin
  FROM lineitem, e""")
def quantile_bins(spark, sf):
    line = load(spark, sf, "lineitem").select(F.expr(LINE_ID).alias("row_id"), "l_extendedprice")
    return profile.quantile_bins(line, "l_extendedprice").drop("l_extendedprice")


@query("""
  WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20
             AS w, quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem),
    x AS (SELECT least(floor((l_extendedprice - lo) / w), 19)::INTEGER AS bin,
          CASE WHEN l_extendedprice > m THEN 'high' ELSE 'low' END AS classification, lo, w
          FROM lineitem, b)
  SELECT bin, classification, count(*) AS n, round(any_value(lo + bin * w), 6) AS bin_lo
  FROM x GROUP BY bin, classification""")
def histogram_by_class(spark, sf):
    line = load(spark, sf, "lineitem").select("l_extendedprice")
    cut = ordered.scalar_quantiles(line, "l_extendedprice", [0.5])[0]
    classed = line.withColumn(
        "classification", scalars.class_name(scalars.binarise(F.col("l_extendedprice"), cut))
    )
    return profile.histogram(classed, "l_extendedprice", ["classification"]).withColumn(
        "bin_lo", r6("bin_lo")
    )


@query("""
  WITH q AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.25) AS q1,
      quantile_cont(l_extendedprice, 0.5) AS med, quantile_cont(l_extendedprice, 0.75) AS q3
      FROM lineitem GROUP BY ALL)
  SELECT l_returnflag, l_linestatus, round(any_value(q1), 6) AS q1,
    round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3,
    min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
    min(l_extendedprice) FILTER (l_extendedprice >= q1 - 1.5e0 * (q3 - q1)) AS whisker_lo,
    max(l_extendedprice) FILTER (l_extendedprice <= q3 + 1.5e0 * (q3 - q1)) AS whisker_hi,
    round(max(l_extendedprice) * 1.1e0, 6) AS annotation_height
  FROM lineitem JOIN q USING (l_returnflag, l_linestatus) GROUP BY l_returnflag, l_linestatus""")
def box_stats(spark, sf):
    line = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    out = profile.box_stats(line, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.withColumns({c: r6(c) for c in ("q1", "median", "q3", "annotation_height")})


@query(f"""
  SELECT descriptor, algo, round_even(avg(score) * 100e0, 0) / 100e0 AS Val_score,
         round(stddev_samp(score), 6) AS Val_score_std,
         round_even(avg(tax) * 100e0, 0) / 100e0 AS Val_tax,
         round(stddev_samp(tax), 6) AS Val_tax_std
  FROM ({SCORE_VIEW}) GROUP BY descriptor, algo""")
def cv_summary(spark, sf):
    out = profile.cv_summary(score_view(spark, sf), ["descriptor", "algo"], ["score", "tax"])
    return out.withColumns({c: r6(c) for c in ("Val_score_std", "Val_tax_std")})


@query(f"""
  WITH s AS (SELECT descriptor, algo, avg(score) AS v, avg(tax) AS t, stddev_samp(score) AS sd
             FROM ({SCORE_VIEW}) GROUP BY descriptor, algo),
    p AS (SELECT l_extendedprice AS x, {PREDICTED} AS y FROM lineitem),
    b AS (SELECT min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM p)
  SELECT round(0.6e0 * least(min(v) - max(sd), min(t) - max(sd)), 6) AS y_min,
         round(1.03e0 * greatest(max(v) + max(sd), max(t) + max(sd)), 6) AS y_max,
         round(any_value(xl - abs(0.1e0 * xl)), 6) AS observed_lo,
         round(any_value(xh + abs(0.15e0 * xh)), 6) AS observed_hi,
         round(any_value(yl - abs(0.1e0 * yl)), 6) AS predicted_lo,
         round(any_value(yh + abs(0.15e0 * yh)), 6) AS predicted_hi
  FROM s, b""")
def axis_bounds(spark, sf):
    summary = score_view(spark, sf).groupBy("descriptor", "algo").agg(
        F.avg("score").alias("v"), F.avg("tax").alias("t"), F.stddev_samp("score").alias("sd")
    )
    bars = profile.bar_bounds(summary, "v", "t", "sd").withColumn("one", F.lit(1))
    pairs = load(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("observed"), F.expr(PREDICTED).alias("predicted")
    )
    parity = profile.parity_bounds(pairs, ["observed", "predicted"]).withColumn("one", F.lit(1))
    both = bars.join(parity, "one").drop("one")
    return both.select(*[r6(c).alias(c) for c in both.columns])


@query("""
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)
         AS cv_cycle FROM orders""")
def row_number_in_group(spark, sf):
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return profile.row_number_in_group(orders, ["o_custkey"], "o_orderkey", "cv_cycle")


@query(f"""
  SELECT algo, descriptor, round(avg(score), 6) AS Val_score, round(avg(tax), 6) AS Val_tax
  FROM ({SCORE_VIEW}) GROUP BY descriptor, algo""")
def metrics_pivot(spark, sf):
    long = score_view(spark, sf).unpivot(
        ["descriptor", "algo", "cycle"], ["score", "tax"], "metric", "value"
    ).groupBy("descriptor", "algo", F.concat(F.lit("test_"), "metric").alias("metric")).agg(
        r6(F.avg("value")).alias("value")
    )
    wide = profile.metrics_pivot(
        long, ["descriptor", "algo"], "metric", "value", ["test_score", "test_tax"]
    )
    return profile.arrange_columns(wide, ["algo", "descriptor"], {"test_": "Val_"})


@query(r"""
  SELECT doc_id, length(text)::DOUBLE AS n_chars,
    (length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')))::DOUBLE AS n_letters,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::DOUBLE AS n_upper,
    (length(text) - length(regexp_replace(text, '[0-9]', '', 'g')))::DOUBLE AS n_digits,
    (length(text) - length(regexp_replace(text, '\s', '', 'g')))::DOUBLE AS n_space,
    (length(text) - length(regexp_replace(text, '[^A-Za-z0-9\s]', '', 'g')))::DOUBLE AS n_other,
    len(w)::DOUBLE AS n_words,
    round(coalesce(length(regexp_replace(text, '\s', '', 'g'))::DOUBLE / nullif(len(w), 0), 0), 6)
      AS mean_word
  FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w
        FROM documents)""")
def string_descriptors(spark, sf):
    names = ["n_chars", "n_letters", "n_upper", "n_digits", "n_space", "n_other", "n_words",
             "mean_word"]
    docs = load(spark, sf, "documents").select(
        "doc_id", fingerprints.string_descriptors(F.col("text")).alias("d")
    )
    return docs.select("doc_id", *[r6(F.col("d")[i]).alias(n) for i, n in enumerate(names)])
