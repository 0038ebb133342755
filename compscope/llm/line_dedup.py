"""Line deduplication with sharded cuckoo filters over exact reference counts.

The state of a corpus is two tables. ``counts`` says of every line key (a 128-bit digest of the
stripped, lower-cased line) in how many documents it stands; ``shards`` holds, for each shard of the
keys, a cuckoo filter of the keys in force, that is those which stand in ``min_docs`` documents or
more. Adding documents raises counts and inserts the keys that reach ``min_docs``; removing
documents lowers counts and takes keys that fall below it out of the filters again. Since the
counts are exact, a filter is only ever asked to forget what it holds, and removing what was added
gives the earlier state back.

Lines go to the shard of their key, where the filter passes on the few that may be in force and the
shard's exact keys decide. Documents only receive the list of their own lines in force.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialise
from .common import bounded_batches, fresh, give_back
from .cuckoo import CuckooFilter, filled

MIN_DOCS = 10
# Bytes that are stripped from both ends of a line: fixed values.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
# Keys in force that a shard holds on average at most; lines that a task holds against a shard.
SHARD_KEYS = 1 << 16
PROBE_ROWS = 1 << 18
# Distinct lines that a task counts before it hands them on.
WINDOW_KEYS = 1 << 18

KEYS = "h1 bigint, h2 bigint"


def line_keys(text: bytes) -> list[bytes]:
    """The key of every line: A-Z lower-cased, blanks stripped at both ends."""
    return [line.strip(BLANKS) for line in text.lower().split(b"\n")]  # of bytes: ASCII only


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _words(digests: list[bytes]) -> np.ndarray:
    """Digests as rows of two 64-bit words."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _shard(h1, n_shards: int):
    return h1.bitwiseAND(F.lit(n_shards - 1))


@dataclass
class LineIndex:
    """``counts``: h1, h2, n_docs; ``shards``: shard, filter; both written tables. ``n_shards`` is a
    power of two. An index is not changed: ``add`` and ``remove`` return another one."""

    counts: DataFrame
    shards: DataFrame
    n_shards: int
    min_docs: int
    min_chars: int

    @classmethod
    def empty(cls, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = 1) -> LineIndex:
        counts = spark.createDataFrame([], f"{KEYS}, n_docs bigint")
        return cls(counts, spark.createDataFrame([], "shard bigint, filter binary"), 1, min_docs, min_chars)

    def add(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """The index with the documents of ``docs`` counted as well; every row is a document."""
        return self._changed(document_counts(docs, text, self.min_chars))

    def remove(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """The index without the documents of ``docs``, which must have been added; a count that
        would fall below zero is an error."""
        gone = document_counts(docs, text, self.min_chars)
        return self._changed(gone.select("h1", "h2", (-F.col("n_docs")).alias("n_docs")))

    def in_force(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    def _changed(self, delta: DataFrame) -> LineIndex:
        wrong = F.raise_error(F.lit("a document to remove was not added"))
        both = self.counts.select("h1", "h2", "n_docs", F.lit(0).cast("bigint").alias("d")).unionAll(
            delta.select("h1", "h2", F.lit(0).cast("bigint"), F.col("n_docs"))
        )
        summed = both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("_was"), F.sum("d").alias("_d"))
        now = F.col("_was") + F.col("_d")
        changed = materialise(
            summed.select(
                "h1", "h2", F.when(now < 0, wrong).otherwise(now).cast("bigint").alias("n_docs"),
                (F.col("_was") >= self.min_docs).alias("was"),
            ),
            "line_counts",
        )
        counts = changed.where("n_docs > 0").drop("was")
        n_force = changed.where(F.col("n_docs") >= self.min_docs).count()
        n_shards = self.n_shards
        while n_shards * SHARD_KEYS < n_force:
            n_shards *= 2
        # With more shards than before, keys move: all filters are built again.
        old = self.shards if n_shards == self.n_shards else self.shards.limit(0)
        was = F.col("was") if n_shards == self.n_shards else F.lit(False)
        moves = changed.select(
            "h1", "h2", _shard(F.col("h1"), n_shards).alias("shard"),
            (F.col("n_docs") >= self.min_docs).alias("now"), was.alias("was"),
        ).where("now OR was")

        def turn(key: tuple, before: pa.Table, keys: pa.Table) -> pa.Table:
            data = before.column("filter").to_pylist()
            h1, h2 = (keys.column(c).to_numpy() for c in ("h1", "h2"))
            now, was = (keys.column(c).to_numpy() for c in ("now", "was"))
            new = CuckooFilter.from_bytes(data[0]) if data else None
            if new is not None:
                new.remove(h1[was & ~now], h2[was & ~now])
                if not new.insert(h1[now & ~was], h2[now & ~was]):
                    new = None
            if new is None:
                new = filled(h1[now], h2[now])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([new.to_bytes()], pa.binary())})

        shards = old.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(turn, "shard bigint, filter binary")
        return LineIndex(counts, materialise(shards, "line_filters"), n_shards, self.min_docs, self.min_chars)

    def lines_in_force(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Per distinct text with lines in force: ``t1, t2`` (its digest) and ``keys array<binary>``.

        A line goes to the task of its shard; shards with many lines are dealt over several tasks,
        each with the shard's filter and keys.
        """
        lines = materialise(_lines(docs, text, self.min_chars), "lines")
        own = lines.withColumn("shard", _shard(F.col("h1"), self.n_shards))
        parts = own.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).alias("parts"))
        part = F.pmod(F.xxhash64("t1", "h1"), F.col("parts"))
        dealt = own.join(parts, "shard").select("shard", part.alias("part"), "t1", "t2", "h1", "h2")
        keys = self.in_force().select(_shard(F.col("h1"), self.n_shards).alias("shard"), "h1", "h2")
        packed = keys.groupBy("shard").applyInArrow(_pack, "shard bigint, keys binary")
        tables = self.shards.join(packed, "shard").join(parts, "shard").select(
            "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "filter", "keys"
        )
        found = dealt.groupBy("shard", "part").cogroup(tables.groupBy("shard", "part")).applyInArrow(
            _probe, "t1 bigint, t2 bigint, key binary"
        )
        return found.groupBy("t1", "t2").agg(F.collect_set("key").alias("keys"))

    def apply(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` added: the text without its lines in
        force. Rows are kept one to one. Names that ``docs`` has get an underscore."""
        found = self.lines_in_force(docs, text)
        names = {c: fresh(docs, c) for c in ("n_lines", "n_dropped", "kept")}
        t1, t2, keys, cut = (fresh(docs, c) for c in ("_t1", "_t2", "_keys", "_cut"))
        marked = docs.withColumns(dict(zip((t1, t2), text_digest(docs, text))))
        found = found.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("keys").alias(keys))
        joined = marked.join(found, [t1, t2], "left")
        bounded_batches(docs.sparkSession)

        @F.arrow_udf("n_lines bigint, n_dropped bigint, kept string")
        def drop(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, lists in batches:
                rows = []
                for raw, gone in zip(texts.cast(pa.binary()).to_pylist(), lists.to_pylist()):
                    n = raw.count(b"\n") + 1
                    if not gone:
                        rows.append((n, 0, raw))
                        continue
                    gone = set(gone)
                    kept = [l for l, k in zip(raw.split(b"\n"), line_keys(raw)) if not k or digest(k) not in gone]
                    rows.append((n, n - len(kept), b"\n".join(kept)))
                yield pa.StructArray.from_arrays(
                    [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]
                    + [pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())],
                    names=["n_lines", "n_dropped", "kept"],
                )
            give_back()

        out = joined.withColumn(cut, drop(F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(keys)))
        return out.select(*[F.col(c) for c in docs.columns], *[F.col(cut)[c].alias(names[c]) for c in names])


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """The keys of one shard, sorted, as bytes."""
    found = np.stack([rows.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "keys": pa.array([found.astype("<i8").tobytes()], pa.binary())})


def _probe(lines: pa.Table, tables: pa.Table) -> pa.Table:
    """The lines whose key the filter passes and the exact keys confirm."""
    names = ("t1", "t2", "h1", "h2")
    t1, t2, h1, h2 = (lines.column(c).to_numpy() for c in names)
    hit = np.zeros(len(h1), bool)
    if tables.num_rows and len(h1):
        maybe = np.flatnonzero(CuckooFilter.from_bytes(tables.column("filter")[0].as_py()).contains(h1, h2))
        keys = np.frombuffer(tables.column("keys")[0].as_py(), "<i8").reshape(-1, 2)
        both = np.dtype([("a", "<i8"), ("b", "<i8")])
        asked = np.ascontiguousarray(np.stack([h1[maybe], h2[maybe]], axis=1)).view(both)[:, 0]
        known = np.ascontiguousarray(keys).view(both)[:, 0]
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        hit[maybe] = known[at] == asked
    key = np.stack([h1[hit], h2[hit]], axis=1).astype("<i8")
    return pa.table(
        {"t1": t1[hit], "t2": t2[hit], "key": pa.array([k.tobytes() for k in key], pa.binary())}
    )


def text_digest(docs: DataFrame, text: str):
    """Two 64-bit hashes of the text (null: empty)."""
    whole = F.coalesce(docs[text].cast("string"), F.lit(""))
    return F.xxhash64(whole), F.xxhash64(F.lit(1), whole)


def _documents(docs: DataFrame, text: str) -> DataFrame:
    t1, t2 = text_digest(docs, text)
    whole = F.coalesce(docs[text].cast("string"), F.lit(""))
    bounded_batches(docs.sparkSession)
    return docs.select(whole.alias("_text"), t1.alias("t1"), t2.alias("t2"))


def _digests(text: bytes, min_chars: int) -> set[bytes]:
    if min_chars <= 1:
        return {digest(k) for k in set(line_keys(text)) if k}
    return {digest(k) for k in set(line_keys(text)) if len(k.decode("utf-8", "replace")) >= min_chars}


def document_counts(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """In how many rows of ``docs`` each line key stands: ``h1, h2, n_docs``. Tasks add up a bounded
    window of keys before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = _words(list(total))
            numbers = pa.array(list(total.values()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy()), numbers], ["h1", "h2", "n_docs"])

        for batch in batches:
            for raw in batch.column("_text").cast(pa.binary()).to_pylist():
                for d in _digests(raw, min_chars):
                    total[d] = total.get(d, 0) + 1
            if len(total) >= WINDOW_KEYS:
                yield out()
                total = {}
        if total:
            yield out()
        give_back()

    rows = _documents(docs, text).select("_text").mapInArrow(count, f"{KEYS}, n_docs bigint")
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))


def _lines(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """``t1, t2, h1, h2``: the distinct line keys of texts, once for copies in the same batch."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            t1, t2 = (batch.column(c).to_numpy() for c in ("t1", "t2"))
            sizes, found, rows, seen = [], [], [], set()
            for i, raw in enumerate(texts):
                if (t1[i], t2[i]) in seen:
                    continue
                seen.add((t1[i], t2[i]))
                own = _digests(raw, min_chars)
                rows.append(i)
                sizes.append(len(own))
                found.extend(own)
            words = _words(found)
            rows = np.repeat(np.array(rows, np.int64), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (t1[rows], t2[rows], words[:, 0].copy(), words[:, 1].copy())], ["t1", "t2", "h1", "h2"]
            )
        give_back()

    return _documents(docs, text).mapInArrow(split, f"t1 bigint, t2 bigint, {KEYS}")


def drop_common_lines(
    df: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = 1, index: LineIndex | None = None
) -> DataFrame:
    """``df`` with ``n_lines``, ``n_dropped`` and ``kept``: all lines go whose key has ``min_chars``
    code points or more and stands in ``min_docs`` rows or more, of ``df`` and of what ``index``
    (which is not changed) counts already.

    A text is split at line feeds; a null or empty text is one empty line, whose key is empty and
    stays. Every row is a document, whatever its key, so repeated rows count as often as they
    stand there. An empty table gives no rows; other columns are kept and may have any name.
    """
    before = index or LineIndex.empty(df.sparkSession, min_docs, min_chars)
    return before.add(df, text).apply(df, text)


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    """``<key>, n_lines, n_dropped, kept_sha256``: ``drop_common_lines`` with a digest of what stays."""
    out = drop_common_lines(df.select(df[key].alias("_key"), df[text].alias("_text")), "_text", min_docs, min_chars)
    return out.select(F.col("_key").alias(key), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
