"""Splits, metrics, votes and significance tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import metrics, models, significance, splits
from .registry import LINE_ID, PREDICTED, SCORE, SCORE_VIEW, TRUTH, load, query, r6, score_view

_EDGES = ", ".join(f"{i / 10}" for i in range(11))


def _stratified_sql(seeds) -> str:
    cycles = ", ".join(f"({i}, {s})" for i, s in enumerate(seeds, 1))
    return f"""
  WITH e AS (SELECT list_distinct(quantile_cont(l_extendedprice, [{_EDGES}])) AS edges
             FROM lineitem),
    b AS (SELECT {LINE_ID} AS row_id,
        greatest(len(list_filter(edges, lambda x: x < l_extendedprice)) - 1, 0)::INTEGER AS stratum
        FROM lineitem, e),
    r AS (SELECT cycle::INTEGER AS cycle, row_id, stratum,
        row_number() OVER (PARTITION BY cycle, stratum
                           ORDER BY md5(seed || '|' || row_id), row_id) AS r,
        count(*) OVER (PARTITION BY cycle, stratum) AS n
        FROM b, (VALUES {cycles}) c(cycle, seed))
  SELECT cycle, row_id, stratum,
         CASE WHEN r <= floor(0.2e0 * n + 0.5e0) THEN 'test' ELSE 'train' END AS split FROM r"""


def _line_targets(spark, sf):
    return load(spark, sf, "lineitem").select(F.expr(LINE_ID).alias("row_id"), "l_extendedprice")


@query(f"SELECT row_id, stratum, split FROM ({_stratified_sql([42])})")
def split_stratified(spark, sf):
    out = splits.stratified_split(_line_targets(spark, sf), "row_id", "l_extendedprice", 0.2, 42)
    return out.drop("l_extendedprice")


@query(f"SELECT cycle, row_id, split FROM ({_stratified_sql([43, 44, 45])})")
def cv_repeated_stratified(spark, sf):
    return splits.repeated_stratified(
        _line_targets(spark, sf), "row_id", "l_extendedprice", splits.cycle_seeds(43, 3), 0.2
    ).select("cycle", "row_id", "split")


def _grouped_sql(seeds) -> str:
    cycles = ", ".join(f"({i}, {s})" for i, s in enumerate(seeds, 1))
    return f"""
  folded AS MATERIALIZED (
    SELECT cycle::INTEGER AS cycle, o_orderkey, o_custkey, (o_totalprice >= m)::INTEGER AS pos,
      (('0x' || substr(md5(seed || '|' || o_custkey), 1, 8))::BIGINT % 5)::INTEGER AS fold
    FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders),
         (VALUES {cycles}) c(cycle, seed)),
  f AS (SELECT cycle, fold, count(*) AS n, sum(pos) AS p FROM folded GROUP BY cycle, fold),
  bal AS MATERIALIZED (
    SELECT cycle, fold, n, p::DOUBLE / n AS test_ratio,
      (sum(p) OVER (PARTITION BY cycle) - p)::DOUBLE / (sum(n) OVER (PARTITION BY cycle) - n)
        AS train_ratio FROM f),
  best AS (SELECT cycle, fold FROM (SELECT *, row_number() OVER (PARTITION BY cycle
      ORDER BY round(abs(train_ratio - test_ratio), 12), fold) AS rn FROM bal) WHERE rn = 1),
  out AS (SELECT folded.cycle, o_orderkey, o_custkey,
      CASE WHEN folded.fold = best.fold THEN 'test' ELSE 'train' END AS split
      FROM folded JOIN best ON best.cycle = folded.cycle)"""


def _orders(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"WITH {_grouped_sql([42])} SELECT o_orderkey, o_custkey, split FROM out")
def split_grouped(spark, sf):
    out = splits.grouped_split(_orders(spark, sf), "o_custkey", "o_totalprice", 42)
    return out.drop("o_totalprice")


@query("""
  WITH g AS (SELECT o_custkey, count(*) AS n,
      sum((o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.5) FROM orders))::INTEGER)::BIGINT AS n_pos
    FROM orders GROUP BY o_custkey),
    r AS (SELECT *, (row_number() OVER (
      ORDER BY n_pos DESC, n DESC, md5('42|' || o_custkey), o_custkey) - 1) % 10 AS place FROM g)
  SELECT o_custkey, n, n_pos, (CASE WHEN place < 5 THEN place ELSE 9 - place END)::INTEGER AS fold FROM r""")
def split_grouped_balanced(spark, sf):
    return splits.balanced_folds(_orders(spark, sf), "o_custkey", "o_totalprice", 42)


@query(f"""
  WITH {_grouped_sql([42])}
  SELECT count(*) FILTER (a <> b) AS n_straddling, count(*) AS n_groups
  FROM (SELECT min(split) AS a, max(split) AS b FROM out GROUP BY o_custkey)""")
def split_grouped_leakcheck(spark, sf):
    out = splits.grouped_split(_orders(spark, sf), "o_custkey", "o_totalprice", 42)
    return splits.straddling_groups(out, "o_custkey")


@query(f"WITH {_grouped_sql([43, 44, 45])} SELECT cycle, o_orderkey, split FROM out")
def cv_repeated_grouped(spark, sf):
    return splits.repeated_grouped(
        _orders(spark, sf), "o_custkey", "o_totalprice", splits.cycle_seeds(43, 3)
    ).select("cycle", "o_orderkey", "split")


@query(f"""
  WITH {_grouped_sql([42, 43, 44])}
  SELECT cycle, fold, n, round(test_ratio, 6) AS test_ratio, round(train_ratio, 6) AS train_ratio,
         round(abs(train_ratio - test_ratio), 6) AS ratio_diff FROM bal""")
def split_balance(spark, sf):
    out = splits.fold_balance(
        _orders(spark, sf), "o_custkey", "o_totalprice", splits.cycle_seeds(42, 3)
    )
    return out.withColumns({c: r6(c) for c in ("test_ratio", "train_ratio", "ratio_diff")})


_SCORED = f"""
  s AS (SELECT l_returnflag AS model, l_linestatus AS part, {TRUTH} AS truth, {SCORE} AS score,
               l_extendedprice AS observed, {PREDICTED} AS predicted FROM lineitem),
  c AS (SELECT model, part, count(*) FILTER (NOT truth AND score < 0.5) AS tn,
      count(*) FILTER (NOT truth AND score >= 0.5) AS fp,
      count(*) FILTER (truth AND score < 0.5) AS fn,
      count(*) FILTER (truth AND score >= 0.5) AS tp FROM s GROUP BY model, part),
  d AS (SELECT model, part, tn::DOUBLE AS tn, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tp::DOUBLE AS tp
        FROM c),
  byscore AS (SELECT model, part, score, count(*) FILTER (truth) AS p,
      count(*) FILTER (NOT truth) AS n FROM s GROUP BY model, part, score),
  cum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM byscore
          WINDOW w AS (PARTITION BY model, part ORDER BY score DESC)),
  ranked AS (SELECT model, part,
      round(sum(n * (tp - p / 2e0)) / (max(tp)::DOUBLE * max(fp)), 6) AS roc_auc,
      round(sum(p * tp::DOUBLE / (tp + fp)) / max(tp), 6) AS avg_precision
      FROM cum GROUP BY model, part)"""

_KEYS = ["model", "part"]


def _scored(spark, sf):
    return load(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("part"),
        F.expr(TRUTH).alias("truth"), F.expr(SCORE).alias("score"),
        F.col("l_extendedprice").alias("observed"), F.expr(PREDICTED).alias("predicted"),
    )


def _confusion(spark, sf):
    return metrics.confusion(
        _scored(spark, sf), _KEYS, F.col("truth"), F.col("score") >= 0.5
    )


@query(f"WITH {_SCORED} SELECT * FROM c")
def metric_confusion(spark, sf):
    return _confusion(spark, sf)


def _class_metric(spark, sf, name):
    return metrics.with_class_metrics(_confusion(spark, sf)).select(*_KEYS, r6(name).alias(name))


@query(f"""
  WITH {_SCORED} SELECT model, part, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM d""")
def metric_accuracy(spark, sf):
    return _class_metric(spark, sf, "accuracy")


@query(f"""
  WITH {_SCORED} SELECT model, part, round((tp * tn - fp * fn)
    / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM d""")
def metric_mcc(spark, sf):
    return _class_metric(spark, sf, "mcc")


@query(f"""
  WITH {_SCORED} SELECT model, part,
    round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM d""")
def metric_balanced_accuracy(spark, sf):
    return _class_metric(spark, sf, "balanced_accuracy")


def _rank_metric(spark, sf, name):
    out = metrics.ranking_metrics(_scored(spark, sf), _KEYS, F.col("truth"), "score")
    return out.select(*_KEYS, r6(name).alias(name))


@query(f"WITH {_SCORED} SELECT model, part, roc_auc FROM ranked")
def metric_roc_auc(spark, sf):
    return _rank_metric(spark, sf, "roc_auc")


@query(f"WITH {_SCORED} SELECT model, part, avg_precision FROM ranked")
def metric_avg_precision(spark, sf):
    return _rank_metric(spark, sf, "avg_precision")


@query(f"""
  WITH {_SCORED} SELECT model, part, round(corr(observed, predicted), 6) AS pearson_r
  FROM s GROUP BY model, part""")
def metric_pearson(spark, sf):
    out = metrics.regression_metrics(_scored(spark, sf), _KEYS, "observed", "predicted")
    return out.select(*_KEYS, r6("pearson_r").alias("pearson_r"))


@query(f"""
  WITH {_SCORED} SELECT model, part, round(sqrt(avg((observed - predicted) ** 2)), 6) AS rmse,
    round(avg(abs(observed - predicted)), 6) AS mae FROM s GROUP BY model, part""")
def metric_rmse_mae(spark, sf):
    out = metrics.regression_metrics(_scored(spark, sf), _KEYS, "observed", "predicted")
    return out.select(*_KEYS, r6("rmse").alias("rmse"), r6("mae").alias("mae"))


@query(f"""
  WITH m AS (SELECT quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem),
  s AS (SELECT l_extendedprice >= m AS truth, {SCORE} AS score FROM lineitem, m),
  c AS (SELECT count(*) FILTER (NOT truth AND score < 0.5) AS tn,
      count(*) FILTER (NOT truth AND score >= 0.5) AS fp,
      count(*) FILTER (truth AND score < 0.5) AS fn,
      count(*) FILTER (truth AND score >= 0.5) AS tp FROM s),
  byscore AS (SELECT score, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n
              FROM s GROUP BY score),
  cum AS (SELECT *, sum(p) OVER w AS ctp, sum(n) OVER w AS cfp FROM byscore
          WINDOW w AS (ORDER BY score DESC)),
  r AS (SELECT sum(n * (ctp - p / 2e0)) / (max(ctp)::DOUBLE * max(cfp)) AS auc,
               sum(p * ctp::DOUBLE / (ctp + cfp)) / max(ctp) AS ap FROM cum)
  SELECT round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(auc, 6) AS roc_auc,
    round(ap, 6) AS avg_precision,
    round((tp::DOUBLE * tn - fp::DOUBLE * fn) / (sqrt((tp + fp)::DOUBLE) * sqrt((tp + fn)::DOUBLE)
      * sqrt((tn + fp)::DOUBLE) * sqrt((tn + fn)::DOUBLE)), 6) AS mcc, tn, fp, fn, tp
  FROM c, r""")
def eval_classifier(spark, sf):
    scored = _scored(spark, sf).select("observed", "score")
    out = metrics.evaluate_classifier(scored, "observed", "score")
    return out.withColumns({c: r6(c) for c in ("accuracy", "roc_auc", "avg_precision", "mcc")})


@query(f"""
  SELECT round(corr(l_extendedprice, {PREDICTED}), 6) AS pearson_r,
    round(sqrt(avg((l_extendedprice - ({PREDICTED})) ** 2)), 6) AS rmse,
    round(avg(abs(l_extendedprice - ({PREDICTED}))), 6) AS mae FROM lineitem""")
def eval_regressor(spark, sf):
    scored = _scored(spark, sf).select("observed", "predicted")
    out = metrics.evaluate_regressor(scored, "observed", "predicted")
    return out.select(*[r6(c).alias(c) for c in ("pearson_r", "rmse", "mae")])


_VOTERS = [
    f"({SCORE})",
    "(l_discount * 10e0)",
    "(l_quantity / 50e0)",
    "(1e0 - l_tax * 10e0)",
]


@query(f"""
  SELECT {LINE_ID} AS row_id, round(({' + '.join(_VOTERS)}) / 4e0, 6) AS score,
         ({' + '.join(_VOTERS)}) / 4e0 > 0.5e0 AS positive FROM lineitem""")
def vote_soft(spark, sf):
    vote = models.vote([F.expr(v) for v in _VOTERS])
    return load(spark, sf, "lineitem").select(
        F.expr(LINE_ID).alias("row_id"), r6(vote).alias("score"),
        scalars.binarise(vote, F.lit(0.5)).alias("positive"),
    )


@query(f"""
  SELECT {LINE_ID} AS row_id,
    round((({PREDICTED}) + l_extendedprice + l_quantity * 1400e0) / 3e0, 6) AS predicted
  FROM lineitem""")
def vote_mean(spark, sf):
    vote = models.vote(
        [F.expr(PREDICTED), F.col("l_extendedprice"), F.col("l_quantity") * F.lit(1400.0)]
    )
    return load(spark, sf, "lineitem").select(
        F.expr(LINE_ID).alias("row_id"), r6(vote).alias("predicted")
    )


@query(f"""
  SELECT descriptor, count(DISTINCT algo) AS n_groups,
    CASE WHEN count(DISTINCT algo) = 2 THEN 'wilcoxon'
         WHEN count(DISTINCT algo) >= 3 THEN 'friedman' ELSE 'none' END AS test
  FROM ({SCORE_VIEW}) GROUP BY descriptor
  UNION ALL
  SELECT algo, count(DISTINCT descriptor),
    CASE WHEN count(DISTINCT descriptor) = 2 THEN 'wilcoxon'
         WHEN count(DISTINCT descriptor) >= 3 THEN 'friedman' ELSE 'none' END
  FROM ({SCORE_VIEW}) GROUP BY algo""")
def sig_test_choice(spark, sf):
    view = score_view(spark, sf)
    by_algo = significance.choose_test(view, "algo", "descriptor")
    return significance.choose_test(view, "descriptor", "algo").unionAll(by_algo)


@query(f"""
  WITH p AS (SELECT descriptor, cycle, max_by(score, algo) - min_by(score, algo) AS d
             FROM ({SCORE_VIEW}) GROUP BY descriptor, cycle HAVING count(DISTINCT algo) = 2),
    r AS (SELECT descriptor, d, round(abs(d), 12) AS a FROM p WHERE round(d, 12) <> 0),
    k AS (SELECT *, rank() OVER (PARTITION BY descriptor ORDER BY a)
                    + (count(*) OVER (PARTITION BY descriptor, a) - 1) / 2e0 AS rk FROM r)
  SELECT descriptor, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS w_plus,
    coalesce(sum(rk) FILTER (d < 0), 0) AS w_minus,
    least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS statistic
  FROM k GROUP BY descriptor""")
def wilcoxon_stat(spark, sf):
    out = significance.wilcoxon(score_view(spark, sf), "descriptor", "algo", "cycle", "score")
    return out.select("descriptor", "n", "w_plus", "w_minus", "statistic")


# Without ties or zeros, the exact p-value counts the sign patterns of n ranks whose sum is small.
@query(f"""
  WITH p AS (SELECT descriptor, cycle,
               max_by(score, algo) - min_by(score, algo) + cycle * 1e-3 AS d
             FROM ({SCORE_VIEW}) GROUP BY descriptor, cycle HAVING count(DISTINCT algo) = 2),
    k AS (SELECT descriptor, d, row_number() OVER (PARTITION BY descriptor ORDER BY abs(d)) AS rk,
                 count(*) OVER (PARTITION BY descriptor) AS n FROM p),
    s AS (SELECT descriptor, n, least(coalesce(sum(rk) FILTER (d > 0), 0),
                 coalesce(sum(rk) FILTER (d < 0), 0)) AS statistic FROM k GROUP BY descriptor, n),
    signs AS (SELECT n, m, (SELECT coalesce(sum(i), 0) FROM unnest(range(1, n + 1)) AS u(i)
                            WHERE (m >> (i - 1)) & 1 = 1) AS w
              FROM (SELECT DISTINCT n FROM s), (SELECT unnest(range(0, 128)) AS m) WHERE m < (1 << n))
  SELECT descriptor, s.n, statistic::DOUBLE AS statistic,
    round(least(1e0, 2e0 * count(*) FILTER (w <= statistic) / count(*)), 9) AS p_value
  FROM s JOIN signs ON signs.n = s.n GROUP BY descriptor, s.n, statistic""")
def wilcoxon_p(spark, sf):
    shifted = score_view(spark, sf).withColumn(
        "score", F.col("score") + F.when(F.col("algo") == "O", F.col("cycle") * F.lit(1e-3)).otherwise(F.lit(0.0))
    )
    out = significance.wilcoxon(shifted, "descriptor", "algo", "cycle", "score")
    return out.select("descriptor", "n", "statistic", F.round("p_value", 9).alias("p_value"))


_RANKS = f"""
  k AS (SELECT algo, descriptor, cycle,
      rank() OVER (PARTITION BY algo, cycle ORDER BY score)
        + (count(*) OVER (PARTITION BY algo, cycle, score) - 1) / 2e0 AS rk,
      count(*) OVER (PARTITION BY algo, cycle, score) AS ties FROM ({SCORE_VIEW})),
  sums AS (SELECT algo, descriptor, sum(rk) AS rs FROM k GROUP BY algo, descriptor),
  tot AS (SELECT algo, count(DISTINCT cycle) AS n, count(DISTINCT descriptor) AS g,
      sum(rk * rk) AS a1, sum(ties * ties - 1)::DOUBLE AS tie FROM k GROUP BY algo),
  sq AS (SELECT algo, sum(rs * rs) AS s2 FROM sums GROUP BY algo)"""


@query(f"""
  WITH {_RANKS}
  SELECT algo, n AS n_blocks, g AS n_groups,
    round((12e0 / (n * g * (g + 1)) * s2 - 3e0 * n * (g + 1)) / (1 - tie / (n * g * (g * g - 1))), 6)
      AS statistic FROM tot JOIN sq USING (algo)""")
def friedman_stat(spark, sf):
    out = significance.friedman(score_view(spark, sf), "algo", "descriptor", "cycle", "score")
    return out.select("algo", "n_blocks", "n_groups", r6("statistic").alias("statistic"))


# One missing and one null score: both blocks go. With three groups, the tail of chi-square with two
# degrees of freedom is exp(-x / 2).
_INCOMPLETE = f"""
  SELECT algo, descriptor, cycle,
    CASE WHEN algo = 'O' AND descriptor = 'N' AND cycle = 2 THEN NULL ELSE score END AS score
  FROM ({SCORE_VIEW}) WHERE NOT (algo = 'F' AND descriptor = 'A' AND cycle = 1)"""


@query(f"""
  WITH v AS ({_INCOMPLETE}),
    b AS (SELECT algo, cycle FROM v GROUP BY algo, cycle HAVING count(score) = 3),
    k AS (SELECT algo, descriptor, cycle,
        rank() OVER (PARTITION BY algo, cycle ORDER BY score)
          + (count(*) OVER (PARTITION BY algo, cycle, score) - 1) / 2e0 AS rk,
        count(*) OVER (PARTITION BY algo, cycle, score) AS ties FROM v JOIN b USING (algo, cycle)),
    sums AS (SELECT algo, descriptor, sum(rk) AS rs FROM k GROUP BY algo, descriptor),
    tot AS (SELECT algo, count(DISTINCT cycle) AS n, 3 AS g, sum(ties * ties - 1)::DOUBLE AS tie
            FROM k GROUP BY algo),
    sq AS (SELECT algo, sum(rs * rs) AS s2 FROM sums GROUP BY algo),
    st AS (SELECT algo, n AS n_blocks,
        (SELECT count(DISTINCT cycle) FROM v WHERE v.algo = tot.algo) - n AS n_dropped_blocks,
        (12e0 / (n * g * (g + 1)) * s2 - 3e0 * n * (g + 1)) / (1 - tie / (n * g * (g * g - 1))) AS x
      FROM tot JOIN sq USING (algo))
  SELECT algo, n_blocks, n_dropped_blocks, round(x, 6) AS statistic, round(exp(-x / 2), 6) AS p_value
  FROM st""")
def friedman_incomplete(spark, sf):
    view = score_view(spark, sf).where("NOT (algo = 'F' AND descriptor = 'A' AND cycle = 1)")
    gap = (F.col("algo") == "O") & (F.col("descriptor") == "N") & (F.col("cycle") == 2)
    view = view.withColumn("score", F.when(~gap, F.col("score")))
    out = significance.friedman(view, "algo", "descriptor", "cycle", "score")
    return out.select("algo", "n_blocks", "n_dropped_blocks", r6("statistic").alias("statistic"),
                      r6("p_value").alias("p_value"))


@query(f"""
  WITH {_RANKS},
    st AS (SELECT algo, n, (12e0 / (n * g * (g + 1)) * s2 - 3e0 * n * (g + 1))
             / (1 - tie / (n * g * (g * g - 1))) AS x FROM tot JOIN sq USING (algo))
  SELECT algo, 3::BIGINT AS n_groups, 'friedman' AS test, n AS n_blocks, round(x, 6) AS statistic,
    round(exp(-x / 2), 6) AS p_value FROM st""")
def sig_test_p(spark, sf):
    out = significance.test_by_category(score_view(spark, sf), "algo", "descriptor", "cycle", "score")
    return out.select("algo", "n_groups", "test", "n_blocks", r6("statistic").alias("statistic"),
                      r6("p_value").alias("p_value"))


@query(f"""
  WITH {_RANKS}
  SELECT x.algo, x.descriptor AS group_a, y.descriptor AS group_b,
    round(abs(x.rs - y.rs) / sqrt(2 * (n * a1 - s2) / ((n - 1) * (g - 1))::DOUBLE), 6)
      AS t_statistic, ((n - 1) * (g - 1))::INTEGER AS df
  FROM sums x JOIN sums y ON x.algo = y.algo AND x.descriptor < y.descriptor
  JOIN tot ON tot.algo = x.algo JOIN sq ON sq.algo = x.algo""")
def conover_pairs(spark, sf):
    out = significance.conover_pairs(
        score_view(spark, sf), "algo", "descriptor", "cycle", "score"
    )
    return out.select("algo", "group_a", "group_b", r6("t_statistic").alias("t_statistic"), "df")


# Family: the p-like numbers score / 10 of every algorithm and cycle.
@query(f"""
  WITH s AS (SELECT algo, cycle, descriptor, score / 10e0 AS p,
      count(*) OVER (PARTITION BY algo, cycle) AS m,
      row_number() OVER (PARTITION BY algo, cycle ORDER BY score / 10e0, descriptor) AS i
      FROM ({SCORE_VIEW}))
  SELECT algo, cycle, descriptor, round(max(least(p * (m - i + 1), 1e0)) OVER (
      PARTITION BY algo, cycle ORDER BY i ROWS UNBOUNDED PRECEDING), 9) AS p_adjusted FROM s""")
def holm_adjust(spark, sf):
    view = score_view(spark, sf).withColumn("p", F.col("score") / F.lit(10.0))
    out = significance.holm_adjust(view, ["algo", "cycle"], "p", ["descriptor"])
    return out.select("algo", "cycle", "descriptor", F.round("p_adjusted", 9).alias("p_adjusted"))
