"""What the operators of this subpackage share: reading tables, batches of bounded size, links."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise

# Most bytes of rows that go to a Python worker at once; one longer row goes alone.
BATCH_BYTES = 2 << 20
BATCH_ROWS = 2_000
# Rows that the Parquet reader decodes at once: texts are long, and their bytes lie in one array.
READ_ROWS = 512


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, nbytes: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches of this session by rows and by bytes, so that very long texts
    cannot fill a worker's memory. The last call before a job counts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(nbytes))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers live on, and several
    of them share an executor's memory with its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim is not None:
        trim(0)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """Two columns ``_key, _text`` whatever else the table holds; a null text is empty."""
    return df.select(
        df[key].alias("_key"), F.coalesce(df[text].cast("string"), F.lit("")).alias("_text")
    )


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def finite(vector: Column) -> Column:
    """True for a vector that is not null and has only finite components."""
    inf = float("inf")
    good = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf),
    )
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def slices(n_rows: int, per_slice: int) -> int:
    return max(1, -(-n_rows // per_slice))


def deal(rows: DataFrame, content: list[str], uid: str, n_slices: int, per_slice: int, name: str) -> DataFrame:
    """Add the column ``name``: a slice below ``n_slices`` by a hash of ``content``. Rows that are equal in
    all of it would share a slice; a group of more than ``per_slice`` of them is dealt over several by
    ``uid`` (such rows may take each other's places)."""
    if n_slices == 1:
        return rows.withColumn(name, F.lit(0).cast("bigint"))
    own = F.xxhash64(*content)
    many = rows.groupBy(own.alias("_own")).count().where(F.col("count") > per_slice)
    many = many.select("_own", F.ceil(F.col("count") / per_slice).alias("_salts"))  # n / per_slice rows at most
    salted = rows.withColumn("_own", own).join(many, "_own", "left")
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(uid), F.col("_salts"))).otherwise(0)
    return salted.withColumn(name, F.pmod(F.xxhash64("_own", salt), F.lit(n_slices))).drop("_own", "_salts")


def components(edges: DataFrame, a: str, b: str) -> DataFrame | None:
    """Connected components of an undirected edge list: ``node, root``, root the smallest node.

    Every round points each node at its smallest neighbour (or itself) with a map-side combined
    minimum and contracts the edges along these pointers, so the graph shrinks until no edge is
    left; the pointers of all rounds, followed in turn, lead to the smallest node. Nothing is
    collected. Null ends and loops are ignored. None when there is no edge.
    """
    live = materialise(
        edges.where(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .distinct(),
        "links",
    )
    steps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = materialise(
            both.groupBy("u").agg(F.min("v").alias("low")).select(
                F.col("u").alias("node"), F.least("u", "low").alias("root")
            ),
            "pointers",
        )
        steps.append(lowest)
        moved = live.join(lowest.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u")
        moved = moved.join(lowest.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
        live = materialise(
            moved.where("ru != rv")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct(),
            "links",
        )
    if not steps:
        return None
    labels = steps[0]
    for step in steps[1:]:
        up = step.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        labels = labels.join(up, "root", "left").select(
            "node", F.coalesce("_up", "root").alias("root")
        )
    return labels


class Registry:
    """Queries of this subpackage with the SQL that checks them, where SQL can state them."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def register(fn):
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.oracles[fn.__name__] = sql
            return fn

        return register
