"""Query registry and the expressions that Spark and the checking SQL share word for word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its checking SQL if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


# A lineitem row as a compound: its id, a pseudo class, a tied pseudo score, a pseudo prediction.
LINE_ID = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
TRUTH = "l_extendedprice >= 35000"
SCORE = "floor(70e0 * l_quantity / 50e0 + 30e0 * ((l_partkey * 7919) % 101) / 101e0) / 100e0"
PREDICTED = "l_quantity * 1500e0 + (l_partkey % 97) * 10e0"

# The cross-validation score view: 3 descriptors x 2 algorithms x 7 cycles.
SCORE_VIEW = """
  SELECT l_returnflag AS descriptor, l_linestatus AS algo, l_linenumber AS cycle,
         round(avg(l_discount), 6) AS score, round(avg(l_tax), 6) AS tax
  FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber"""


def score_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("descriptor"),
        F.col("l_linestatus").alias("algo"),
        F.col("l_linenumber").alias("cycle"),
    ).agg(r6(F.avg("l_discount")).alias("score"), r6(F.avg("l_tax")).alias("tax"))
