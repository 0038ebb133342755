"""Searches, joins, packing and shards against brute force on small tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from compscope.llm import ngram_join, tiles  # noqa: E402
from compscope.llm.common import components  # noqa: E402
from compscope.llm.nearest import bounds, nearest_neighbours  # noqa: E402
from compscope.llm.ngram_join import ngram_groups  # noqa: E402
from compscope.llm.packing import cut_lengths, pack_documents, plan_packing  # noqa: E402
from compscope.llm.stages import keep_known_language, keep_one_of_each_group, mask_secrets  # noqa: E402
from compscope.llm.token_output import permute, read_slots, training_order, write_shards  # noqa: E402
from compscope.llm.topk_search import exact_topk  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_topk(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in rows if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], start=1)]
    return sorted(out)


def test_topk_with_ties_in_small_tiles(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 7), ("TILE_CANDIDATES", 20), ("TILE_QUERIES", 3)):
        monkeypatch.setattr(tiles, name, value)
    monkeypatch.setattr("compscope.llm.topk_search.TILE_CANDIDATES", 20)
    rng = random.Random(3)
    rows = [(i, [rng.randint(-2, 2) for _ in range(3)]) for i in range(1, 400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, v array<bigint>, rank string")
    got = exact_topk(df, "vec_id", F.col("v"), F.col("vec_id") % 10 == 0, k=6)
    want = brute_topk(rows, [r for r in rows if r[0] % 10 == 0], 6)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want


def test_blocks_stay_when_tiles_run_again(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 7), ("TILE_CANDIDATES", 20), ("TILE_QUERIES", 14)):
        monkeypatch.setattr(tiles, name, value)

    def mixed(batches):  # delivers its rows in another order each time, as a shuffle may
        for batch in batches:
            yield batch.sample(frac=1)

    schema = "_id bigint, _v array<bigint>"
    df = spark.createDataFrame([(i, [i, 1]) for i in range(90)], schema).coalesce(1).mapInPandas(mixed, schema)
    met = tiles.tiles(df, 90, df, 90, "<i8")
    runs = [sorted((bytes(r.q_ids), bytes(r.c_ids)) for r in met.collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    pairs = [(q, c) for a, b in runs[0] for q in np.frombuffer(a, "<i8") for c in np.frombuffer(b, "<i8")]
    assert Counter(pairs) == Counter((q, c) for q in range(90) for c in range(90))


def test_topk_edges(spark):
    schema = "vec_id bigint, v array<bigint>"
    rows = [(0, [1, 2]), (1, None), (None, [5, 5]), (2, [1, 2]), (2, [1, 2]), (10, [3]), (20, [2**40, 1])]
    df = spark.createDataFrame(rows, schema)
    got = exact_topk(df, "vec_id", F.col("v"), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == [
        (0, 1, 20, 2**40 + 2), (0, 2, 2, 5), (0, 3, 2, 5), (20, 1, 0, 2**40 + 2), (20, 2, 2, 2**40 + 2), (20, 3, 2, 2**40 + 2)
    ]
    assert exact_topk(df.limit(0), "vec_id", F.col("v"), F.lit(True)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        big = spark.createDataFrame([(0, [2**40]), (1, [2**40])], schema)
        exact_topk(big, "vec_id", F.col("v"), F.lit(True)).collect()


def test_nearest_is_exact(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("TILE_CANDIDATES", 40), ("TILE_QUERIES", 8)):
        monkeypatch.setattr(tiles, name, value)
    monkeypatch.setattr("compscope.llm.nearest.TILE_CANDIDATES", 40)
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(150, 8)) * rng.lognormal(0, 1, (150, 1)), 2)
    v[40:60] = v[20:40]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(500, None), (520, [0.0] * 8), (540, [float("nan")] + [1.0] * 7), (560, [None] + [1.0] * 7), (580, [float("inf")] * 8), (None, [1.0] * 8), (600, [])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, e array<double>").withColumn("score", F.lit("x"))
    got = nearest_neighbours(df, "vec_id", "e", F.col("vec_id") % 20 == 0, k=7).collect()
    want = []
    for q in range(0, 150, 20):
        # One addition after the other: sum() would compensate for rounding.
        scored = sorted(
            (-reduce(lambda s, x: s + x, [a * b for a, b in zip(rows[q][1], w)]), i) for i, w in rows if i != q
        )
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:7], start=1)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert nearest_neighbours(df.limit(0), "vec_id", "e", F.lit(True)).count() == 0


def test_int8_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(60, 64)) * 10.0 ** rng.integers(-3, 4, (60, 1)), rng.normal(size=(50, 64))
    a[0] = 0
    low, high = bounds(a, b)
    exact = a @ b.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < 0.5 * np.abs(exact).mean()


def brute_groups(rows, k, num, den):
    """Every pair of sets compared, links followed."""
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and len(a & b) * den >= len(a | b) * num:
                up[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return sorted(((d, len(sets[i]), None if d is None else min(low[find(i)])) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed, n, words):
    """A base text with small edits, edits of edits, unrelated texts and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = rng.choices(vocabulary, k=words // 2)
    base = rng.choices(vocabulary, k=words)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.55:
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                base = t
        elif kind < 0.75:
            t = rng.choices(vocabulary, k=words // 2) + passage
        elif kind < 0.85 and rows:
            t = rng.choice(rows).split()
        else:
            t = rng.choices(vocabulary, k=rng.randint(1, words))
        rows.append(" ".join(t))
    return rows


@pytest.mark.parametrize("k, num, den, small", [(3, 90, 100, False), (5, 80, 100, True), (1, 1, 2, True)])
def test_ngram_groups_equal_brute_force(spark, monkeypatch, k, num, den, small):
    if small:  # long lists, several list blocks and several verification blocks
        monkeypatch.setattr(ngram_join, "SHORT_LIST", 4)
        monkeypatch.setattr(ngram_join, "LIST_BLOCK", 16)
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 900)
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = list(enumerate(near_copies(k, 140, 90)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "a b"), (906, "A  b"), (907, "é É x"), (908, "É é x")]
    rows += [(910, "one"), (910, "one"), (911, rows[0][1]), (911, rows[1][1]), (None, "one"), (912, "z " * 30_000)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, digest string, n int")
    got = ngram_groups(df, k=k, num=num, den=den).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_groups(rows, k, num, den)


def test_ngram_groups_of_empty_tables(spark):
    schema = "doc_id bigint, text string"
    assert ngram_groups(spark.createDataFrame([], schema)).count() == 0
    blank = ngram_groups(spark.createDataFrame([(1, None), (2, "")], schema)).collect()
    assert sorted(tuple(r) for r in blank) == [(1, 0, 1), (2, 0, 2)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        up[hi] = lo
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = components(df, "a", "b")
    assert ({r.node: r.root for r in got.collect()} if got else {}) == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), max_size=30))
def test_packing_plan(counts):
    plan = plan_packing(counts, 60)
    used = Counter()
    for _, times, lengths in plan.runs:
        assert sum(lengths) <= 60 and times > 0
        for n in lengths:
            used[n] += times
    assert used == Counter(counts)
    total = sum(n * c for n, c in counts.items())
    # No two sequences could be joined by best fit: fewer than twice the least number.
    assert plan.sequences <= max(1, 2 * -(-total // 60)) and (counts or plan.sequences == 0)


def test_packing_fills_exactly():
    assert plan_packing({700: 5, 324: 5}, 1024).sequences == 5
    assert plan_packing({500: 3, 300: 3, 224: 3}, 1024).sequences == 3
    assert plan_packing({400: 2, 300: 2, 200: 2, 124: 2}, 1024).sequences == 2
    rng = np.random.default_rng(1)
    lengths = np.minimum(1024, rng.lognormal(6, 1, 200_000).astype(int) + 1)
    plan = plan_packing(Counter(lengths.tolist()), 1024)
    assert plan.sequences <= 1.002 * -(-lengths.sum() // 1024)


def test_cut_lengths():
    assert cut_lengths(10, 4) == [(0, 2), (2, 4), (6, 4)] and cut_lengths(8, 4) == [(0, 4), (4, 4)] and cut_lengths(3, 4) == [(0, 3)]


def library_ids(text):
    from tokenizers import Tokenizer

    global _library
    try:
        _library
    except NameError:
        _library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*_library.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_packing_of_documents(spark, monkeypatch):
    monkeypatch.setattr("compscope.llm.packing.RANK_ROWS", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(-1, None), (-2, ""), (-3, "x"), (-3, "x"), (None, "y"), (-4, "word " * 5000)]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("piece", F.lit("clash"))
    rows = pack_documents(df, capacity=256).collect()
    pieces = Counter()
    for d, t in [tuple(r) for r in df.select("doc_id", "text").collect()]:
        ids = library_ids(t)
        for i, (s, n) in enumerate(cut_lengths(len(ids), 256)):
            pieces[(d, i, s, n, crc(ids[s : s + n]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= 1.02 * -(-sum(r.length for r in rows) // 256) + 1
    assert pack_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    a, b = permute(np.arange(n), n, 7), permute(np.arange(n), n, 8)
    assert sorted(a) == list(range(n)) == sorted(b)
    assert n < 64 or ((a != b).mean() > 0.9 and (a != np.arange(n)).mean() > 0.9)


def test_shards_hold_every_sequence_in_order(spark, tmp_path):
    rows = [(i, i % 3, bytes([i % 250, 1]) * (i % 5 + 1)) for i in range(57)] + [(None, 0, b"\x07\x00")]
    df = spark.createDataFrame([(k, p, len(b) // 2, b) for k, p, b in rows], "_key bigint, piece int, length bigint, ids binary")
    shards = write_shards(df, str(tmp_path / "a"), capacity=5, key=1, per_shard=8)
    sizes = {r.shard: (r.first_slot, r.n_slots, len(r.payload)) for r in shards.collect()}
    assert sizes == {s: (8 * s, min(8, 58 - 8 * s), min(8, 58 - 8 * s) * 26) for s in range(8)}
    whole = read_slots(shards, 5, per_shard=8).orderBy("slot").collect()
    assert [r.slot for r in whole] == list(range(58))
    wide = [(k, p, np.frombuffer(b, "<u2").astype("<u4").tobytes()) for k, p, b in rows]
    assert Counter((r._key, r.piece, bytes(r.ids)) for r in whole) == Counter(wide)
    late = read_slots(shards, 5, first=21, per_shard=8).collect()
    assert sorted(r.slot for r in late) == list(range(21, 58))
    again = write_shards(df.repartition(5), str(tmp_path / "b"), capacity=5, key=1, per_shard=8)
    assert [bytes(r.payload) for r in again.orderBy("shard").collect()] == [bytes(r.payload) for r in shards.orderBy("shard").collect()]
    other = write_shards(df, str(tmp_path / "c"), capacity=5, key=2, per_shard=8)
    assert [bytes(r.payload) for r in other.orderBy("shard").collect()] != [bytes(r.payload) for r in shards.orderBy("shard").collect()]


def test_training_order_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    df = docs.unionByName(spark.createDataFrame([(-1, None), (None, "x")], docs.schema)).withColumn("slot", F.lit(0))
    rows = training_order(df, capacity=128).collect()
    want = Counter()
    for d, t in [tuple(r) for r in df.select("doc_id", "text").collect()]:
        ids = library_ids(t)
        for i, (s, n) in enumerate(cut_lengths(len(ids), 128)):
            want[(d, i, n, crc(ids[s : s + n]))] += 1
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows) == want
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.byte_offset == (r.slot % 1024) * (16 + 256) for r in rows)
    assert training_order(df.limit(0)).count() == 0


def test_stages_decide_and_keep_columns(spark):
    prose = {"de": "der die das und nicht ist ein haus mit garten", "fr": "le chat est dans la maison avec des amis"}
    rows = [(i, f"{prose[lang]} w{i} x{i} y{i}", lang, "s", 7) for i, lang in enumerate(["de", "fr"] * 20)]
    rows += [(100, None, "de", "s", 0), (101, "123 456", "fr", "s", 7), (102, "das haus und der garten", None, "s", 7)]
    df = spark.createDataFrame(rows, DOCS).withColumn("_language", F.lit("mine"))
    kept = keep_known_language(df)
    assert kept.columns == df.columns
    got = {r.doc_id: r for r in kept.collect()}
    assert set(got) == {*range(40), 102} and got[102].lang == "de" and got[102]._language == "mine"

    long = " ".join(f"w{i}" for i in range(100))
    rows = [(5, long, "de", "s", 1), (3, long + " end", "de", "s", 1), (9, long, "de", "s", 1), (4, "other text", "de", "s", 1),
            (None, long, "de", "s", 1), (6, None, "de", "s", 1), (4, "other text", "de", "s", 1), (6, "", "de", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("_id", F.lit(1))
    one = keep_one_of_each_group(df)
    assert one.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in one.select("doc_id", "text").na.fill("").collect()) == sorted(
        [("3", long + " end"), ("4", "other text"), ("None", long), ("6", ""), ("6", "")]
    )
    # One id for several texts: each is judged on its own.
    other = " ".join(f"u{i}" for i in range(100))
    rows = [(3, long), (7, long + " end"), (7, other), (9, other), (9, "word " * 3), (7, ""), (7, other),
            (2, "a b c d e f"), (2, "A  b c d e f"), (8, "a b c d e f"), (3, "lone text")]
    df = spark.createDataFrame([(i, t, "de", "s", 1) for i, t in rows], DOCS)
    one = sorted((r.doc_id, r.text) for r in keep_one_of_each_group(df).collect())
    assert len([t for d, t in one if d == 2]) == 1
    assert [r for r in one if r[0] != 2] == sorted([(3, long), (3, "lone text"), (7, ""), (7, other), (9, "word " * 3)])
    df = spark.createDataFrame([(1, "token = abcdefgh1 x", "en", "s", 19), (2, "clean", "en", "s", 5), (3, None, None, None, None)], DOCS)
    got = {r.doc_id: (r.text, r.n_chars) for r in mask_secrets(df).collect()}
    assert got == {1: ("token = [REDACTED] x", 20), 2: ("clean", 5), 3: (None, None)}


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = brute_groups(rows, 5, 80, 100)
    first = {c for _, _, c in groups}
    from compscope.llm.secret_scan import mask

    want = Counter()
    for d, t in rows:
        if d in first:
            ids = library_ids(mask(t))
            for i, (s, n) in enumerate(cut_lengths(len(ids), 1024)):
                want[(d, i, n, crc(ids[s : s + n]))] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == want


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
