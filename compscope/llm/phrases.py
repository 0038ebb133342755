"""Collocations from a weighted de Bruijn graph of word trigrams.

Nodes are word pairs; an edge leads from the first to the last pair of a trigram and weighs as much
as the trigram occurs. Every word position gives one gram, the longest one that starts there: a
trigram, or near the end of a piece a pair or a single word. So only longest grams are counted; a
pair occurs as often as its node's edges weigh together, plus the pieces that end with it, and a word
as often as the nodes that start with it, plus the pieces that end with it.

Grams travel as compressed batches to the partition of their node, are sorted there by Spark and
summed in one pass with bounded memory. Nodes and edges of ``min_count`` and more form the solid
graph. Its unary paths (from each node the only edge out, into each the only edge in) are compacted
to rows of at most ``SEGMENT`` nodes, where neighbours know each other's counts without a join; only
edges between such rows are joined with their nodes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .common import bounded_batches, give_back
from .shingles import U64, mix, text_buffers

NO_LANG = "und"
# Grams that a task gathers before it adds up equal ones and hands them on.
WINDOW_GRAMS = 400_000
# Bytes of text per partition of the counting pass, and the most partitions. Partitions are sorted
# outside memory if need be, so a larger one is slower but not wrong.
PARTITION_BYTES = 8 << 20
MAX_PARTITIONS = 50_000
# Nodes that stand out in a sample of about SAMPLE_ROWS texts, at most HEAVY of them, are dealt over
# SALTS partitions. This only balances tasks.
SAMPLE_ROWS, HEAVY, SALTS = 2_000, 1_000, 64
# Nodes in a row of a compacted path.
SEGMENT = 1_024
# Characters of a longer text that are cut into words at once, and bytes of shorter ones (their arrays
# fit a core's cache); rows of a batch of counted grams.
SECTION = 1 << 20
SLICE = 1 << 17
BATCH_ROWS = 50_000

PIECE_END = re.compile(r"[.,;:!?\x0A-\x0D]")
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# A gram travels as one string, pair, language and third word between line ends: neither words nor the
# languages (see ``_texts``) hold these, so in the order of such strings equal pairs stay together.
GRAMS = pa.schema([("gram", pa.string()), ("n", pa.int64())])


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch of texts in order, the text and the piece of each (pieces are numbered over
    the batch), and a hash of each."""
    data, ends = text_buffers(column)
    data = _LOWER[data]
    first = ends[:-1][ends[:-1] < ends[1:]]
    word = ~_GAP[data]
    begins, finish = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    begins[first] |= word[first]
    finish[:-1] &= ~word[1:] | begins[1:]
    b, e = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    body = data[word]
    at = np.zeros(len(b) + 1, np.int64)
    np.cumsum(e - b, out=at[1:])
    kind = pa.large_string() if at[-1] >= 1 << 31 else pa.string()
    offsets = at.astype(np.int64 if kind == pa.large_string() else np.int32)
    words = pa.Array.from_buffers(kind, len(b), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])
    text = np.searchsorted(ends, b, "right") - 1
    piece = np.cumsum(_BREAK[data])[b] + text if len(b) else text
    return words.cast(pa.string()), text, piece, _hashes(body, at)


def _hashes(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    if len(at) == 1:
        return np.zeros(0, np.uint64)
    size = np.diff(at)
    power = np.full(int(size.max()), 0x9E3779B97F4A7C15 | 1, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    place = np.arange(len(body)) - np.repeat(at[:-1], size)
    return mix(np.add.reduceat((body.astype(np.uint64) + U64(1)) * power[place], at[:-1]))


def longest_grams(texts: pa.Array, langs: pa.Array) -> pa.Table:
    """``lang, p, w, h, n``: the longest grams of a batch, a row for each word: ``p`` is the pair (or last
    word and a blank) and ``w`` the third word (or nothing); ``h`` is a hash of lang and pair."""
    words, text, piece, hashes = split_words(texts)
    n = len(words)
    names = langs.to_pylist()
    seed = mix(np.array([zlib.crc32(x.encode()) for x in names], np.uint64))[text] if n else np.zeros(0, np.uint64)
    same = np.zeros(n + 2, bool)
    same[: max(n - 1, 0)] = piece[1:] == piece[:-1]
    second, third = same[:n], same[:n] & same[1 : n + 1]
    at = np.arange(n)
    two = pc.if_else(pa.array(second), words.take(pa.array(np.minimum(at + 1, max(n - 1, 0)))), pa.scalar("")) if n else words
    three = pc.if_else(pa.array(third), words.take(pa.array(np.minimum(at + 2, max(n - 1, 0)))), pa.scalar("")) if n else words
    after = np.where(second, np.append(hashes[1:], U64(0))[:n], U64(0))
    h = mix(mix(hashes ^ seed) * U64(0x9E3779B97F4A7C15) + after)
    return pa.table({
        "lang": langs.take(pa.array(text)), "p": pc.binary_join_element_wise(words, two, " "), "w": three,
        "h": pa.array(h.view(np.int64)), "n": pa.array(np.ones(n, np.int64)),
    })


def _combined(tables: list[pa.Table]) -> pa.Table:
    """Equal grams added up."""
    whole = pa.concat_tables(tables).combine_chunks()
    rest = [c for c in ("h",) if c in whole.column_names]
    sums = whole.group_by("gram", use_threads=False).aggregate([("n", "sum"), *[(c, "min") for c in rest]])
    return sums.rename_columns(["gram", "n", *rest])


def _named(lang: pa.Array, p: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(p, lang, "\n")


def _joined(table: pa.Table, heavy: pa.Array, heavy_hashes: np.ndarray) -> pa.Table:
    """``gram, n, h`` of longest grams; the hash of a heavy node's grams is salted by the third word."""
    h = table.column("h").to_numpy().view(np.uint64)
    node = _named(table.column("lang"), table.column("p"))
    like = np.flatnonzero(np.isin(h, heavy_hashes)) if len(heavy) else np.zeros(0, np.int64)
    if len(like):
        like = like[pc.is_in(node.take(pa.array(like)), value_set=heavy).to_numpy()]
        third = table.column("w").take(pa.array(like))
        salt = np.array([zlib.crc32(w.encode()) % SALTS for w in third.to_pylist()], np.uint64)
        h = h.copy()
        h[like] = mix(h[like] + salt + U64(1))
    gram = pc.binary_join_element_wise(node, table.column("w"), "\n")
    return pa.table({"gram": gram, "n": table.column("n"), "h": pa.array(h.view(np.int64))})


def _split(table: pa.Table) -> pa.Table:
    """``p, lang, w, n`` of ``gram, n``."""
    parts = pc.list_flatten(pc.split_pattern(table.column("gram").combine_chunks(), "\n"))
    at = np.arange(0, 3 * table.num_rows, 3)
    names = {c: parts.take(pa.array(at + i)) for i, c in enumerate(("p", "lang", "w"))}
    return pa.table({**names, "n": table.column("n")})


def _packed(table: pa.Table, n_parts: int) -> Iterator[pa.RecordBatch]:
    """Grams by the partition of their node, each as one compressed Arrow batch."""
    h = table.column("h").to_numpy().view(np.uint64)
    part = (h % U64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    table, part = table.select(GRAMS.names).take(pa.array(order)), part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    blobs = []
    for a, b in zip(cuts, [*cuts[1:], len(part)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, GRAMS, options=options) as out:
            out.write_table(table.slice(a, b - a).cast(GRAMS))
        blobs.append(sink.getvalue().to_pybytes())
    yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "grams"])


def _texts(df: DataFrame, text: str, lang: str) -> DataFrame:
    return df.select(
        F.coalesce(df[text].cast("string"), F.lit("")).alias("_text"),
        _without_line_ends(F.coalesce(df[lang].cast("string"), F.lit(NO_LANG))).alias("_lang"),
    )


def _without_line_ends(name):
    return F.replace(F.replace(name, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _with_line_ends(name):
    return F.replace(F.replace(name, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def sections(texts: pa.Array, langs: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The batch in slices of about ``SLICE`` bytes; if it is larger than ``SECTION``, text by text, longer
    ones in parts that end where a piece ends."""
    if texts.nbytes <= SECTION:
        step = max(1, len(texts) * SLICE // max(1, texts.nbytes))
        for at in range(0, len(texts), step):
            yield texts.slice(at, step), langs.slice(at, step)
        return
    for t, lang in zip(texts.to_pylist(), langs.to_pylist()):
        at = 0
        while at < len(t):
            found = PIECE_END.search(t, at + SECTION)
            end = found.end() if found else len(t)
            yield pa.array([t[at:end]], pa.string()), pa.array([lang], pa.string())
            at = end


def heavy_nodes(texts: DataFrame, n_rows: int) -> tuple[pa.Array, np.ndarray]:
    """Names and hashes of the nodes that hold over a thousandth of the grams of a sample; ``HEAVY`` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, langs in sections(batch.column("_text"), batch.column("_lang")):
                grams = longest_grams(texts, langs)
                if grams.num_rows:
                    found = grams.group_by(["lang", "p"], use_threads=False).aggregate([("n", "sum"), ("h", "min")])
                    yield from found.rename_columns(["lang", "p", "n", "h"]).combine_chunks().to_batches()
        give_back()

    sample = texts.sample(min(1.0, SAMPLE_ROWS / max(1, n_rows)), seed=7)
    counts = sample.mapInArrow(count, "lang string, p string, n bigint, h bigint").groupBy("lang", "p")
    counts = materialise(counts.agg(F.sum("n").alias("n"), F.min("h").alias("h")), "sample")
    top = counts.orderBy(F.col("n").desc(), "lang", "p").limit(HEAVY)
    whole = counts.agg(F.sum("n")).first()[0] or 0
    found = top.where(F.col("n") * 1000 > whole).collect()
    names = pa.array([f"{r['p']}\n{r['lang']}" for r in found], pa.string())
    return names, np.array([r["h"] for r in found], np.int64).view(np.uint64)


def gram_graph(texts: DataFrame, min_count: int) -> DataFrame:
    """The counted graph as rows ``kind, lang, p, w, n``: ``edge`` (a trigram of ``min_count`` or more),
    ``node`` (a pair and its flow; parts of it for heavy nodes) and ``word`` (parts of the flow of the
    nodes that start with the word ``p``)."""
    bounded_batches(texts.sparkSession, rows=BATCH_ROWS, nbytes=SECTION)
    size = texts.agg(F.count("*").alias("rows"), F.sum(F.octet_length("_text")).alias("bytes")).first()
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_parts = min(MAX_PARTITIONS, max(least, -(-(size["bytes"] or 0) // PARTITION_BYTES)))
    hot, hot_hashes = heavy_nodes(texts, size["rows"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        held = 0
        for batch in batches:
            for texts, langs in sections(batch.column("_text"), batch.column("_lang")):
                grams = longest_grams(texts, langs)
                if grams.num_rows:
                    waiting.append(_joined(grams, hot, hot_hashes))
                    held += grams.num_rows
                if held >= WINDOW_GRAMS:
                    yield from _packed(_combined(waiting), n_parts)
                    waiting, held = [], 0
        if waiting:
            yield from _packed(_combined(waiting), n_parts)
        give_back()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        held = 0
        for batch in batches:
            for blob in batch.column("grams"):
                waiting.append(pa.ipc.open_stream(blob.as_buffer()).read_all())
                held += waiting[-1].num_rows
                if held < WINDOW_GRAMS:
                    continue
                waiting = [_combined(waiting)]
                held = waiting[0].num_rows
                if 2 * held > WINDOW_GRAMS:  # few are equal: the sort has room for them
                    yield from waiting[0].to_batches(max_chunksize=BATCH_ROWS)
                    waiting, held = [], 0
        if waiting:
            yield from _combined(waiting).to_batches(max_chunksize=BATCH_ROWS)
        give_back()

    sent = texts.mapInArrow(gather, "part int, grams binary").repartitionById(n_parts, "part")
    ordered = sent.mapInArrow(unpack, "gram string, n bigint").sortWithinPartitions("gram")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last gram, which may go on
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = _combined_sorted(table if last is None else pa.concat_tables([last, table]))
            last = table.slice(max(0, table.num_rows - 1))
            if table.num_rows > 1:
                yield from _graph_rows(_split(table.slice(0, table.num_rows - 1)), min_count, hot)
        if last is not None and last.num_rows:
            yield from _graph_rows(_split(last), min_count, hot)
        give_back()

    return ordered.mapInArrow(total, "kind string, lang string, p string, w string, n bigint")


def _runs(table: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Where runs of rows equal in ``columns`` start."""
    n = table.num_rows
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = False
        for c in columns:
            col = table.column(c).combine_chunks()
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _combined_sorted(table: pa.Table) -> pa.Table:
    """Equal neighbours added up."""
    table = table.combine_chunks()
    at = _runs(table, ("gram",))
    if len(at) == table.num_rows:
        return table
    sums = np.add.reduceat(table.column("n").to_numpy(), at)
    return pa.table({"gram": table.column("gram").take(pa.array(at)), "n": pa.array(sums)})


def _graph_rows(table: pa.Table, min_count: int, hot: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of the graph from whole grams in order of ``p, lang``. The first and the last node may
    go on in other rows, like the ``hot`` ones in other partitions: they are given whatever they weigh."""
    n = table.column("n").to_numpy()
    at = _runs(table, ("p", "lang"))
    nodes = table.select(["lang", "p"]).take(pa.array(at))
    flow = np.add.reduceat(n, at)
    lang, p = (nodes.column(c).combine_chunks() for c in ("lang", "p"))
    pair = ~pc.ends_with(p, " ").to_numpy(zero_copy_only=False)
    word = pc.list_element(pc.split_pattern(p, " ", max_splits=1), 0)
    given = flow >= min_count
    given[[0, -1]] = True
    if len(hot):
        given |= pc.is_in(_named(lang, p), value_set=hot).to_numpy(zero_copy_only=False)
    solid = (n >= min_count) & pc.not_equal(table.column("w"), "").to_numpy()
    out = [
        _part("edge", table.filter(pa.array(solid))),
        _part("node", pa.table({"lang": lang, "p": p, "n": pa.array(flow)}).filter(pa.array(pair & given))),
        _part("word", pa.table({"lang": lang, "p": word, "n": pa.array(flow)}).group_by(["lang", "p"], use_threads=False)
              .aggregate([("n", "sum")]).rename_columns(["lang", "p", "n"])),
    ]
    yield from pa.concat_tables(out).combine_chunks().to_batches()


def _part(kind: str, table: pa.Table) -> pa.Table:
    none = pa.nulls(table.num_rows, pa.string())
    w = table.column("w") if "w" in table.column_names else none
    return pa.table({
        "kind": pa.array([kind] * table.num_rows, pa.string()), "lang": table.column("lang").cast(pa.string()),
        "p": table.column("p").cast(pa.string()), "w": w, "n": table.column("n").cast(pa.int64()),
    })


def first_word(p):
    return F.substring_index(p, " ", 1)


def last_word(p):
    return F.substring_index(p, " ", -1)


def compact_paths(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unary paths of ``nodes (lang, p, flow)`` and ``edges (lang, p, w, n, to)``: rows ``lang, head, seg,
    path array<struct<at, p, flow, n>>`` in order, ``n`` being the weight of the edge to the next node of
    the row (null for the last one), and the edges that are inside no row.

    Nodes learn their distance from the head of their path by pointer doubling over written tables,
    so the rounds grow with the logarithm of the longest path. A ring without a head is left as single
    nodes. A path is cut into rows of ``SEGMENT`` nodes.
    """
    single_out = edges.groupBy("lang", "p").agg(F.count("*").alias("c"), F.min("to").alias("to")).where("c = 1")
    single_in = edges.groupBy("lang", "to").agg(F.count("*").alias("c")).where("c = 1")
    links = single_out.select("lang", "p", "to").join(single_in.select("lang", "to"), ["lang", "to"]).where("p <> to")
    back = nodes.join(links.select("lang", F.col("p").alias("up"), F.col("to").alias("p")), ["lang", "p"], "left")
    place = materialise(
        back.select("lang", "p", F.coalesce("up", "p").alias("up"), F.col("up").isNotNull().cast("bigint").alias("d"),
                    F.col("up").isNull().alias("done")),
        "places",
    )
    left = place.where("NOT done").count()
    while left:
        up = place.select("lang", F.col("p").alias("up"), F.col("up").alias("_up"), F.col("d").alias("_d"), F.col("done").alias("_done"))
        place = materialise(
            place.join(up, ["lang", "up"]).select(
                "lang", "p", F.when(F.col("done"), F.col("up")).otherwise(F.col("_up")).alias("up"),
                F.when(F.col("done"), F.col("d")).otherwise(F.col("d") + F.col("_d")).alias("d"),
                (F.col("done") | F.col("_done")).alias("done"),
            ),
            "places",
        )
        now = place.where("NOT done").count()
        if now == left:  # only rings are left
            break
        left = now
    head, seg = F.when(F.col("done"), F.col("up")).otherwise(F.col("p")), F.floor(F.when(F.col("done"), F.col("d")).otherwise(0) / SEGMENT)
    at = F.when(F.col("done"), F.col("d")).otherwise(F.lit(0).cast("bigint"))
    placed = materialise(place.select("lang", "p", head.alias("head"), seg.alias("seg"), at.alias("at")), "placed")
    goal = placed.select("lang", F.col("p").alias("to"), F.col("head").alias("_head"), F.col("seg").alias("_seg"), F.col("at").alias("_at"))
    inside = (F.col("head") == F.col("_head")) & (F.col("seg") == F.col("_seg")) & (F.col("_at") == F.col("at") + 1)
    ends = materialise(
        edges.join(placed, ["lang", "p"]).join(goal, ["lang", "to"]).select("lang", "p", "w", "n", "to", inside.alias("inside")), "edges"
    )
    inner = ends.where("inside").select("lang", "p", F.col("n").alias("edge"))
    rows = nodes.join(placed, ["lang", "p"]).join(inner, ["lang", "p"], "left")
    item = F.struct("at", "p", "flow", F.col("edge").alias("n"))
    paths = rows.groupBy("lang", "head", "seg").agg(F.sort_array(F.collect_list(item)).alias("path"))
    return materialise(paths, "paths"), ends.where("NOT inside").drop("inside")


def candidates(paths: DataFrame, outer: DataFrame) -> DataFrame:
    """``lang, phrase, a, first, head_flow, tail_flow, last, over``: pairs and trigrams of the solid graph.
    ``head_flow`` and ``tail_flow`` are the counts of a trigram's pairs, ``over`` the heaviest trigram
    that holds a pair."""
    path = F.col("path")
    flat = paths.select("lang", F.posexplode(F.transform(
        path,
        lambda x, i: F.struct(
            x["p"].alias("p"), x["flow"].alias("flow"), x["n"].alias("n"),
            F.get(path, i + 1)["p"].alias("to"), F.get(path, i + 1)["flow"].alias("to_flow"),
            F.greatest(x["n"], F.get(path, i - 1)["n"]).alias("over"),
        ),
    )).alias("i", "x")).select("lang", "x.*")
    flows = flat.select("lang", "p", "flow")
    joined = outer.join(flows.withColumnRenamed("flow", "head_flow"), ["lang", "p"]).join(
        flows.select("lang", F.col("p").alias("to"), F.col("flow").alias("tail_flow")), ["lang", "to"]
    )
    inner = flat.where("n IS NOT NULL").select(
        "lang", "p", last_word(F.col("to")).alias("w"), "n", F.col("flow").alias("head_flow"), F.col("to_flow").alias("tail_flow")
    )
    trigrams = inner.unionByName(joined.select(*inner.columns)).select(
        "lang", F.concat_ws(" ", "p", "w").alias("phrase"), F.col("n").alias("a"), first_word(F.col("p")).alias("first"),
        F.col("w").alias("last"), "head_flow", "tail_flow", F.lit(None).cast("bigint").alias("over"),
    )
    touched = outer.select("lang", "p", "n").unionByName(outer.select("lang", F.col("to").alias("p"), "n"))
    touched = touched.groupBy("lang", "p").agg(F.max("n").alias("most"))
    none = F.lit(None).cast("bigint")
    pairs = flat.join(touched, ["lang", "p"], "left").select(
        "lang", F.col("p").alias("phrase"), F.col("flow").alias("a"), first_word(F.col("p")).alias("first"),
        last_word(F.col("p")).alias("last"), none.alias("head_flow"), none.alias("tail_flow"), F.greatest("over", "most").alias("over"),
    )
    return trigrams.unionByName(pairs)


def cut_score(l: str, r: str):
    """floor(1000000 a a / (l r)) of the columns ``a``, ``l`` and ``r``, in decimals of 38 digits."""
    a, l, r = (f"CAST({c} AS DECIMAL(19,0))" for c in ("a", l, r))
    return F.expr(f"(({a} * {a}) * 1000000BD) DIV ({l} * {r})")


def mine_phrases(
    df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 10, top: int = 2_000, contained_pct: int = 50
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two and three words of each
    language that occur ``min_count`` times or more.

    Texts (null: empty) are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and line ends, and
    these into words at blanks and tabs; ``n`` counts the words of the language (null: ``und``). A cut of
    a phrase that occurs ``a`` times into parts of counts l and r has the score
    floor(1000000 a a / (l r)); the lowest counts, of equal ones that after the fewest words. A pair
    is dropped if a trigram that holds it occurs at least ``contained_pct`` percent as often. Order: score,
    ``a`` (both falling), phrase in byte order. Every row counts, repeated ones too; an empty table gives
    no rows; other columns are not read. Products are decimals of 38 digits.
    """
    graph = materialise(gram_graph(_texts(df, text, lang), min_count), "grams")
    words = materialise(graph.where("kind = 'word'").groupBy("lang", "p").agg(F.sum("n").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    nodes = graph.where("kind = 'node'").groupBy("lang", "p").agg(F.sum("n").alias("flow")).where(F.col("flow") >= min_count)
    edges = graph.where("kind = 'edge'").select(
        "lang", "p", "w", "n", F.concat_ws(" ", last_word(F.col("p")), F.col("w")).alias("to")
    )
    found = candidates(*compact_paths(materialise(nodes, "nodes"), materialise(edges, "solid")))
    known = words.where(F.col("f") >= min_count)
    first = known.select("lang", F.col("p").alias("first"), F.col("f").alias("f_first"))
    last = known.select("lang", F.col("p").alias("last"), F.col("f").alias("f_last"))
    kept = found.where(F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * contained_pct))
    counted = kept.join(first, ["lang", "first"]).join(last, ["lang", "last"])
    one, two = cut_score("f_first", "l_rest"), cut_score("l_start", "f_last")
    rest = F.coalesce("tail_flow", "f_last")
    cut = counted.withColumns({"l_rest": rest, "l_start": F.coalesce("head_flow", "f_first")})
    cut = cut.withColumns({"s1": one, "s2": F.when(F.col("head_flow").isNotNull(), two)})
    later = F.col("s2") < F.col("s1")  # null for pairs
    best = cut.select(
        "lang", "phrase", "a", F.when(later, F.col("l_start")).otherwise(F.col("f_first")).alias("l"),
        F.when(later, F.col("f_last")).otherwise(F.col("l_rest")).alias("r"), F.when(later, F.col("s2")).otherwise(F.col("s1")).alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(_with_line_ends(F.col("lang")).alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
