"""Pipeline stages: an operator's decisions applied to a table of documents, all columns kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialise
from .common import bounded_batches, fresh
from .language_id import UNKNOWN, held_out, predictions, train
from .ngram_join import BROADCAST_ROWS, ngram_groups, text_id
from .secret_scan import redact

# Documents whose language is less certain go. The winner of two close duels has 0.25 at least.
MIN_SCORE = 0.26


# Bytes of a row group of the tables of texts that the stages write: several tasks of an executor hold
# one each while they write.
ROW_GROUP = 32 << 20


def small_row_groups(spark: SparkSession) -> None:
    spark.conf.set("parquet.block.size", str(ROW_GROUP))


def keep_known_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Drop documents without letters (or text) and those between languages; a null ``lang`` is
    filled with the prediction. Repeated rows and null keys are judged like any others."""
    small_row_groups(docs.sparkSession)
    model = train(docs, "doc_id", "text", "lang", ~held_out(docs["doc_id"]))
    found = fresh(docs, "_language")
    judged = docs.withColumn(found, predictions(model, docs["text"].cast("string")))
    kept = judged.where((F.col(found)["lang_pred"] != UNKNOWN) & (F.col(found)["score"] >= min_score))
    filled = F.coalesce(kept["lang"], F.col(found)["lang_pred"])
    return kept.withColumn("lang", filled).select(docs.columns)


def keep_one_of_each_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Keep one document of every group that links of Jaccard similarity >= num / den form: the
    one with the smallest id, and of several texts under that id the one with the smallest digest.
    It is decided per id and text, so a repeated id may keep one text and lose another. Of rows
    with the same id and text one stays. Documents with an empty text or a null id are in no group
    and stay."""
    small_row_groups(docs.sparkSession)
    groups = materialise(ngram_groups(docs, "doc_id", "text", k, num, den, by_text=True), "groups")
    key, digest = fresh(docs, "_id"), fresh(docs, "_text_id")
    first = (F.col("component_id") == F.col("doc_id")) & (F.col("first_text_id") == F.col("text_id"))
    rows = groups.where("doc_id IS NOT NULL").select(
        F.col("doc_id").alias(key), F.col("text_id").alias(digest),
        (F.col("first_text_id").isNotNull() & ~first).alias("gone"),
    )
    ids = rows.groupBy(key).agg(F.count("*").alias("n"), F.every("gone").alias("gone"))
    gone, twice = ids.where("gone").select(key), ids.where("n > 1 AND NOT gone").select(key)
    kept = docs.join(_sized(gone), docs["doc_id"] == F.col(key), "left_anti")
    if twice.isEmpty():
        return kept
    again, twice = kept["doc_id"] == F.col(key), _sized(twice)
    once = kept.join(twice, again, "left_anti")
    repeated = kept.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"])
    # Ids of which some texts go and others stay.
    parts = rows.where("gone").join(twice, key, "left_semi").select(key, digest).distinct()
    same = (repeated["doc_id"] == F.col(key)) & (text_id(repeated["text"]) == F.col(digest))
    return once.unionByName(repeated.join(_sized(parts), same, "left_anti"))


def _sized(ids: DataFrame) -> DataFrame:
    """A list of ids to join with: broadcast up to a size, left to Spark beyond it."""
    ids = materialise(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def mask_secrets(docs: DataFrame) -> DataFrame:
    """Mask the secrets of every text; ``n_chars`` follows where a text changed. No row goes."""
    small_row_groups(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    new = fresh(docs, "_masked")
    masked = docs.withColumn(new, redact(docs.sparkSession, docs["text"]))
    changed = ~F.col(new).eqNullSafe(F.col("text"))
    length = F.when(changed, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return masked.withColumns({"n_chars": length, "text": F.col(new)}).select(docs.columns)
