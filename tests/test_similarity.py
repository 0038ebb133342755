import random

import numpy as np
import pytest

from compscope.operators import bit_blocks, graph, leaders, similarity
from compscope.session import materialise


def tanimoto(a, b):
    union = len(a | b)
    return len(a & b) / union if union else 0.0


def make_sets(seed=1, n=120, groups=3):
    """Random bit sets; a third of them are near copies that stand next to each other."""
    rnd = random.Random(seed)
    rows = []
    core = set(rnd.sample(range(500), 30))
    for i in range(n):
        if n // 2 <= i < n // 2 + n // 3:
            bits = set(core)
            bits -= set(rnd.sample(sorted(core), rnd.randint(0, 4)))
            bits |= set(rnd.sample(range(500), rnd.randint(0, 3)))
        else:
            bits = set(rnd.sample(range(80), rnd.randint(0, 25)))
        rows.append((f"d{rnd.randrange(groups)}", i, bits))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(d, i, sorted(b)) for d, i, b in rows], "ds string, id long, bits array<int>"
    )


@pytest.mark.parametrize("t,bucket", [(0.0, 50_000), (0.2, 5), (0.65, 50_000), (0.65, 5), (1.0, 5)])
def test_join_equals_brute_force(spark, monkeypatch, t, bucket):
    monkeypatch.setattr(similarity, "BUCKET_ROWS", bucket)
    left, right = make_sets(1), make_sets(2, 60)
    got = {
        (r["ds"], r["id_a"], r["id_b"], r["n_shared"])
        for r in similarity.similarity_join(
            frame(spark, left), frame(spark, right), ["ds"], "id", "bits", t
        ).collect()
    }
    want = {
        (d, i, j, len(a & b)) for d, i, a in left for e, j, b in right
        if d == e and a & b and tanimoto(a, b) >= t
    }
    assert got == want


def greedy(rows, t):
    kept = []
    for d, i, bits in sorted(rows, key=lambda r: r[1]):
        if not any(d == e and bits & b and tanimoto(bits, b) >= t for e, _, b in kept):
            kept.append((d, i, bits))
    return {(d, i) for d, i, _ in kept}


@pytest.mark.parametrize("t,n,first_block,budget", [
    (0.2, 150, 10_000, 10**9), (0.65, 150, 10_000, 10**9), (0.65, 120, 16, 10**9),
    (0.65, 60, 16, 60), (0.2, 40, 10_000, 60),
])
def test_leaders_equal_greedy(spark, t, n, first_block, budget):
    rows = make_sets(7, n, 2)
    got = leaders.leader_cluster(frame(spark, rows), "ds", "id", "bits", t, first_block, budget)
    assert {(r["ds"], r["id"]) for r in got.collect()} == greedy(rows, t)


def test_leaders_of_path_clique_and_isolated(spark):
    path = [("p", 0, {1, 2, 3}), ("p", 1, {2, 3, 4}), ("p", 2, {3, 4, 5})]
    clique = [("c", i, {1, 2, 3}) for i in (5, 6, 7)]
    alone = [("x", 8, {9}), ("x", 9, set()), ("x", 10, set())]
    got = leaders.leader_cluster(frame(spark, path + clique + alone), "ds", "id", "bits", 0.5)
    assert {r["id"] for r in got.collect()} == {0, 2, 5, 8, 9, 10}


def test_assignment_equals_brute_force(spark):
    rows = [(d, i, b) for d, i, b in make_sets(11, 90, 2)]
    cents = [r for r in rows if r[1] % 4 == 0]
    rows += [("d0", 900, {9001}), ("d1", 901, set())]
    key = {i: ",".join(map(str, sorted(b))) for _, i, b in rows}
    schema = "ds string, id long, bits array<int>, key string"
    df = spark.createDataFrame([(d, i, sorted(b), key[i]) for d, i, b in rows], schema)
    nodes = similarity.number_centroids(
        spark.createDataFrame([(d, i, sorted(b), key[i]) for d, i, b in cents], schema), "ds", "id"
    )
    got = {r["id"]: r["cluster_ID"]
           for r in similarity.assign_clusters(df, nodes, "ds", "key", "bits").collect()}
    for d, i, bits in rows:
        own = sorted((j, b) for e, j, b in cents if e == d)
        same = [c for c, (j, _) in enumerate(own) if key[j] == key[i]]
        sims = [tanimoto(bits, b) for _, b in own]
        assert got[i] == (same[0] if same else sims.index(max(sims)))


def kruskal(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    taken = set()
    for w, s, d in sorted({(w, min(s, d), max(s, d)) for s, d, w in edges}):
        a, b = root(s), root(d)
        if a != b:
            parent[a] = b
            taken.add((s, d, w))
    return taken


def test_spanning_forest_equals_kruskal(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60), rnd.randrange(12)) for _ in range(150)]
    edges += [(100 + i, 101 + i, 5) for i in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    lightest = {}
    for s, d, w in edges:
        k = (min(s, d), max(s, d))
        lightest[k] = min(w, lightest.get(k, w))
    got = graph.min_spanning_forest(spark.createDataFrame(edges, "src long, dst long, weight long"))
    want = kruskal([(s, d, w) for (s, d), w in lightest.items()])
    assert {tuple(r) for r in got.select("src", "dst", "weight").collect()} == want


def test_two_core(spark):
    ring = [("ring", a, b, False) for a, b in ((1, 2), (2, 3), (3, 1), (3, 4), (4, 5))]
    rings = [("two", a, b, False) for a, b in
             ((1, 2), (2, 3), (3, 1), (3, 10), (10, 11), (11, 20), (20, 21), (21, 22), (22, 20),
              (22, 30))]
    chain = [("chain", a, a + 1, False) for a in range(6)]
    carbonyl = [("ring", 2, 6, True), ("chain", 3, 9, True)]
    df = spark.createDataFrame(ring + rings + chain + carbonyl, "g string, a int, b int, k boolean")
    core = {tuple(r) for r in graph.two_core(df, "g", "a", "b").collect()}
    assert {e[1:] for e in core if e[0] == "ring"} == {(1, 2), (2, 3), (1, 3)}
    assert len([e for e in core if e[0] == "two"]) == 9
    assert not [e for e in core if e[0] == "chain"]
    kept = {tuple(r) for r in graph.two_core(df, "g", "a", "b", keep="k").collect()}
    assert kept - core == {("ring", 2, 6)}


def plain_core(rows):
    """The 2-core by definition; edges without a graph are never stripped."""
    live = {(g, min(a, b), max(a, b)) for g, a, b in rows if a is not None and b is not None and a != b}
    while True:
        ends = [(g, n) for g, a, b in live for n in (a, b)]
        tips = {e for e in ends if ends.count(e) == 1 and e[0] is not None}
        left = {(g, a, b) for g, a, b in live if (g, a) not in tips and (g, b) not in tips}
        if left == live:
            return live
        live = left


@pytest.mark.parametrize("numbers,rounds", [(None, 10), (None, 2), (5, 10), (1, 3)])
def test_two_core_equals_plain_stripping(spark, monkeypatch, numbers, rounds):
    """Chains, stars, single edges, copies, loops and nulls; also with nodes that share a number."""
    monkeypatch.setattr(graph, "MERGED_ROUNDS", rounds)
    if numbers:
        from pyspark.sql import functions as F

        monkeypatch.setattr(graph, "_node_number", lambda g, n: F.pmod(F.xxhash64(g, n), F.lit(numbers)))
    rnd = random.Random(6)
    rows = [(g, f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for g in ("x", "y", "z") for _ in range(32)]
    rows += [("tail", f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("tail", "r0", "t0")]
    rows += [("tail", f"t{i}", f"t{i + 1}") for i in range(8)]
    rows += [("chain", f"c{i}", f"c{i + 1}") for i in range(7)] + [("star", "hub", f"s{i}") for i in range(9)]
    rows += [("pair", "p", "q"), (None, "c1", "c2"), (None, "c2", "c3"), ("x", None, "n1"), ("x", "n2", None)]
    rows += [(g, b, a) for g, a, b in rows[::3]] + rows[::4]
    got = [tuple(r) for r in graph.two_core(spark.createDataFrame(rows, "g string, a string, b string"), "g", "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_core(rows)


def test_two_core_of_no_edges(spark):
    for rows in ([], [("x", "n", "n")], [(None, "a", "b")]):
        got = graph.two_core(spark.createDataFrame(rows, "g string, a string, b string"), "g", "a", "b")
        assert {tuple(r) for r in got.collect()} == plain_core(rows)


def test_rounds_of_two_core_write_only_what_changes(spark, monkeypatch):
    """A ring of 500 atoms with a tail of 12: a round touches one atom, not the ring."""
    written = []

    def counted(df, *more):
        out = materialise(df, *more)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialise", counted)
    rows = [("m", i, (i + 1) % 500) for i in range(500)] + [("m", 499 + i, 500 + i) for i in range(12)]
    got = graph.two_core(spark.createDataFrame(rows, "g string, a long, b long"), "g", "a", "b")
    assert got.count() == 500
    assert sum(written) < 4 * len(rows)


def test_forest_labels_are_sorted_once_and_not_kept(spark, monkeypatch, tmp_path):
    """Positions are those of the sorted labels, over several ranges; of what was written only places are left."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(graph, "RANGE_BYTES", 300)
    names, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: names.append((name, df.columns)) or write(df, name))
    rng = random.Random(31)
    signed = {i: [rng.choice([0, 1, 2**31 - 2, 2**32 - 1, 2**33]) for _ in range(8)] if i % 9 else [] for i in range(80)}
    df = spark.createDataFrame([*signed.items(), (200, signed[1])], "id long, sig array<bigint>")
    got = {(r.tree, r.position): r.id for r in graph.lsh_forest(df, "id", "sig", 4).collect()}
    want = {}
    for t in range(4):
        labels = sorted((s[2 * t : 2 * t + 2], i) for i, s in [*signed.items(), (200, signed[1])] if s)
        want |= {(t, n): i for n, (_, i) in enumerate(labels, 1)}
    assert got == want
    assert names == [("labels", ["id", "_l"]), ("places", ["tree", "id", "_at"])]
    with pytest.raises(Exception, match="no multiple of 3 trees"):
        graph.lsh_forest(df, "id", "sig", 3).collect()


def test_forest_candidates_find_copies_without_listing_all_pairs(spark):
    from pyspark.sql import functions as F

    rows = [("d", i, {1, 2, 3, 4}) for i in range(200)]
    df = frame(spark, rows).withColumn("sig", graph.minhash_signature(F.col("bits"), 32))
    pairs = graph.forest_candidates(graph.lsh_forest(df, "id", "sig", 4), 5)
    assert pairs.count() == 5 * 200 - 15


def wide(rows, n_bits=256):
    """The same rows with bits below ``n_bits``."""
    return [(d, i, {x % n_bits for x in b}) for d, i, b in rows]


@pytest.mark.parametrize("t,first_block,budget,links", [
    (0.65, 20, 10_000, 10_000), (0.65, 20, 30, 5), (0.3, 1_000, 10_000, 10_000), (0.0, 16, 200, 200),
])
def test_leaders_by_blocks_equal_greedy(spark, monkeypatch, t, first_block, budget, links):
    monkeypatch.setattr(bit_blocks, "BLOCK_ROWS", 9)
    monkeypatch.setattr(bit_blocks, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(bit_blocks, "PAIR_LINKS", links)
    rows = wide(make_sets(3, 150)) + [("d0", 500, set()), ("d1", 501, set())]
    got = leaders.leader_cluster(frame(spark, rows), "ds", "id", "bits", t, first_block, budget, n_bits=256)
    assert {(r["ds"], r["id"]) for r in got.collect()} == greedy(rows, t)


def test_dense_group_is_settled_without_its_pairs(spark, monkeypatch):
    """A third of the rows are near copies; of 1,000 rows only a few blocks are taken."""
    rows = wide(make_sets(4, 1_000, 1))
    calls = []
    settle = leaders._settle
    monkeypatch.setattr(leaders, "_settle", lambda *a: calls.append(1) or settle(*a))
    got = leaders.leader_cluster(frame(spark, rows), "ds", "id", "bits", 0.65, 64, 3_000, n_bits=256)
    assert {(r["ds"], r["id"]) for r in got.collect()} == greedy(rows, 0.65)
    assert len(calls) <= 20


def test_products_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(leaders, "PRODUCT_BUDGET", 400)
    rows = wide(make_sets(5, 90, 1))
    got = leaders.leader_cluster(frame(spark, rows), "ds", "id", "bits", 0.65, 64, n_bits=256)
    assert {(r["ds"], r["id"]) for r in got.collect()} == greedy(rows, 0.65)


@pytest.mark.parametrize("k,block", [(1, 7), (4, 7), (10, 64), (300, 16)])
def test_nearest_by_blocks_equal_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(bit_blocks, "BLOCK_ROWS", block)
    monkeypatch.setattr(bit_blocks, "GROUP_BLOCKS", 3)
    rows = wide(make_sets(6, 90)) + [("d0", 900, set()), ("d9", 901, {1})]
    df = frame(spark, rows)
    got = {(r.ds, r.src, r["rank"]): (r.dst, r.weight) for r in bit_blocks.block_nearest(df, df, ["ds"], "id", "bits", 256, k).collect()}
    want = {}
    for d, i, a in rows:
        order = sorted((10**6 - 10**6 * len(a & b) // max(len(a | b), 1), j) for e, j, b in rows if e == d and j != i)
        want |= {(d, i, n): (j, w) for n, (w, j) in enumerate(order[:k], 1)}
    assert got == want


def test_nearest_rows_of_one_table_take_one_product_for_both_sides(spark, monkeypatch):
    """Ids are texts, many rows are alike, and each pair of blocks meets in one cell only."""
    monkeypatch.setattr(bit_blocks, "BLOCK_ROWS", 6)
    monkeypatch.setattr(bit_blocks, "TILE_ROWS", 4)
    monkeypatch.setattr(bit_blocks, "CELLS_PER_CORE", 1)
    grids, grid = [], bit_blocks._grid
    monkeypatch.setattr(bit_blocks, "_grid", lambda *a, **kw: grids.append(grid(*a, **kw)) or grids[-1])
    rows = [(d, "x" * (i % 3) + str(i), b) for d, i, b in wide(make_sets(21, 70, 1))] + [("d0", "y", set()), ("d0", "z", set())]
    rows += [("d0", f"same{i}", {1, 2, 3}) for i in range(20)]
    df = spark.createDataFrame([(d, i, sorted(b)) for d, i, b in rows], "ds string, id string, bits array<int>")
    got = {(r.src, r["rank"]): (r.dst, r.weight, r.similarity) for r in bit_blocks.block_nearest(df, df, ["ds"], "id", "bits", 256, 4).collect()}
    want = {}
    for _, i, a in rows:
        order = sorted((10**6 - 10**6 * len(a & b) // max(len(a | b), 1), j, tanimoto(a, b)) for _, j, b in rows if j != i)
        want |= {(i, n): (j, w, s) for n, (w, j, s) in enumerate(order[:4], 1)}
    assert got == want
    cells = {}
    for r in grids[0].select("g_a", "g_b", "side", "cls", "sub").collect():
        cells.setdefault((r.g_a, r.g_b), ([], []))[r.side].append((r.cls, r["sub"]))
    met = [frozenset((a, b)) for left, right in cells.values() for a in left for b in right if a != b]
    twice = [p for p in set(met) if met.count(p) > 1]
    inside = [frozenset((a, b)) for (x, y), (left, _) in cells.items() if x == y for a in left for b in left if a < b]
    assert len(cells) > 1 and set(twice) <= set(inside)


def test_best_block_partner_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bit_blocks, "BLOCK_ROWS", 8)
    monkeypatch.setattr(bit_blocks, "GROUP_BLOCKS", 2)
    left, right = wide(make_sets(7, 80)), wide(make_sets(8, 60))
    got = {(r.ds, r.id_a): r.id_b for r in bit_blocks.block_best(frame(spark, left), frame(spark, right), ["ds"], "id", "bits", 256).collect()}
    want = {}
    for d, i, a in left:
        best = min(((-tanimoto(a, b), j) for e, j, b in right if e == d and a & b), default=None)
        if best:
            want[d, i] = best[1]
    assert got == want


def test_signatures_equal_the_formula():
    rng = random.Random(10)
    sets = [sorted(rng.sample(range(2**31 - 1), rng.choice([0, 1, 5, 90]))) for _ in range(30)] + [list(range(70_000)), [2**31 - 2, 0]]
    got = graph.signatures([np.array(s, np.uint64) for s in sets], 1024)
    for s, row in zip(sets, got):
        for k in (0, 1, 7, 500, 1023) if s else ():
            assert row[k] == min(((k * 7919 + 13) * x + k * 104729) % (2**31 - 1) for x in s)
        assert len(row) == (1024 if s else 0)


@pytest.mark.parametrize("n_bits", [None, 256])
def test_adding_libraries_equals_clustering_in_order(spark, n_bits, tmp_path):
    from compscope.sources.leader_store import leader_record, load_leaders, save_leaders

    first, second = wide(make_sets(11, 100)), [(d, i + 1_000, b) for d, i, b in wide(make_sets(12, 80))]
    path = str(tmp_path / "leaders")
    for rows in (first, second):
        before = load_leaders(spark, path) if rows is second else None
        now = leaders.add_library(before, frame(spark, rows), "ds", "id", "bits", 0.5, n_bits)
        save_leaders(spark, now, path, "q-grams", 0.5)
    got = {(r["ds"], r["id"]) for r in load_leaders(spark, path).collect()}
    assert got == greedy(first + second, 0.5)
    assert {(r["ds"], r["id"]) for r in load_leaders(spark, path, 0).collect()} == greedy(first, 0.5)
    assert leader_record(spark, path)["version"] == 1
    # A version without its record was not finished.
    load_leaders(spark, path, 0).write.parquet(f"{path}/version-2/leaders")
    assert leader_record(spark, path)["version"] == 1
    with pytest.raises(ValueError, match="q-grams"):
        save_leaders(spark, load_leaders(spark, path), path, "paths", 0.5)
    with pytest.raises(FileNotFoundError):
        load_leaders(spark, path, 7)


def test_a_block_is_sent_once_for_a_cell_not_for_each_block_it_meets(spark, monkeypatch):
    monkeypatch.setattr(bit_blocks, "BLOCK_ROWS", 4)
    monkeypatch.setattr(bit_blocks, "GROUP_BLOCKS", 50)
    rows = [("d", i, {*range(20), 20 + i % 40}) for i in range(160)]
    sides = [bit_blocks._prepared(frame(spark, rows), ["ds"], "id", "bits", 256, s) for s in "ab"]
    blocks = sides[0].count()
    assert blocks >= 30
    monkeypatch.setattr(bit_blocks, "CELLS_PER_CORE", 1 / spark.sparkContext.defaultParallelism)
    grid = bit_blocks._grid(*sides, ["ds"], similarity.as_fraction(0.0))
    assert grid.count() == 2 * blocks
    assert {r.side for r in grid.select("side").collect()} == {0, 1}


@pytest.mark.parametrize("t", [0.2, 0.65])
def test_join_of_fixed_width_equals_brute_force(spark, monkeypatch, t):
    monkeypatch.setattr(bit_blocks, "BLOCK_ROWS", 16)
    left, right = wide(make_sets(13, 80)), wide(make_sets(14, 50))
    found = similarity.similarity_join(frame(spark, left), frame(spark, right), ["ds"], "id", "bits", t, n_bits=256)
    want = {
        (d, i, j, len(a & b), len(a), len(b)) for d, i, a in left for e, j, b in right
        if d == e and a & b and tanimoto(a, b) >= t
    }
    assert {(r.ds, r.id_a, r.id_b, r.n_shared, r.n_a, r.n_b) for r in found.collect()} == want


def test_forest_pairs_are_counted_in_cells(spark, monkeypatch):
    """The sets go to stretches of the forest, once each, instead of to every pair."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(graph, "CELL_ROWS", 16)
    rows = [("d", i, b) for i, (_, _, b) in enumerate(make_sets(15, 90, 1)) if b]
    rows += [("d", 3, rows[3][2])]  # an id that comes twice
    df = frame(spark, rows).withColumn("sig", graph.minhash_signature(F.col("bits"), 32))
    forest = graph.lsh_forest(df, "id", "sig", 4)
    pairs = graph.forest_candidates(forest, 5)
    place = sorted((r.tree, r.position, r.id) for r in forest.collect())
    near = {
        (min(x[2], y[2]), max(x[2], y[2])) for n, x in enumerate(place) for y in place[n + 1 : n + 6] if x[0] == y[0]
    }
    assert sorted((r.id_a, r.id_b) for r in pairs.collect()) == sorted(near)
    monkeypatch.setattr(graph, "verify", None)
    got = graph._overlaps(pairs, df, "id", "bits").collect()
    want = similarity.verify(pairs, df, df, [], "id", "bits").drop("cell").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_word_grams_hashed_at_once_equal_the_expression(spark, monkeypatch):
    """Long words, foreign letters, all blanks of Java, texts of few words, and none."""
    from pyspark.sql import functions as F

    from compscope.functions import fingerprints as fp

    monkeypatch.setattr(fp, "TEXT_BYTES", 40)
    monkeypatch.setattr(fp, "TILE_GRAMS", 3)
    texts = [None, "", " \t", "a", "a b", " a b  c", "x\x0by\x0cz\r\nw \x85\x1c v", "é ü 語 😀 q", "w" * 53 + " a b c", "w" * 200 + " a b c d", "a b c " * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1024, 2**31 - 1):
        rows = df.select(fp.qgram_fingerprint(F.col("t"), q=3, n_bits=n, unit="word").alias("a"), fp.word_gram_bits(F.col("t"), 3, n).alias("b"))
        assert all(r.a == r.b for r in rows.collect())


def test_signatures_come_in_bounded_batches(spark):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    sizes = F.pandas_udf(lambda x: x.map(lambda _: len(x)), "int")
    signed = spark.range(0, 3_000, 1, 1).select(graph.minhash_signature(F.array(F.col("id").cast("int")), 8).alias("s"), "id")
    assert signed.select(F.max(sizes("id"))).first()[0] <= 512
    assert signed.schema["s"].dataType.simpleString() == "array<bigint>"


def test_a_null_in_a_set_keeps_its_signature():
    odd, usual = np.array([2**63], np.uint64), np.array([5, 9], np.uint64)
    got = graph.signatures([usual, odd], 16)
    for s, row in ((usual, got[0]), (odd, got[1])):
        assert row.tolist() == [int(graph._permuted(s, k).min()) for k in range(16)]


def test_tokens_in_one_set_are_not_listed_and_prefixes_that_share_little_are_not_compared(spark, monkeypatch):
    """Ten rows that share one rare token each with the next and nothing else, and two that are alike."""
    rows = [("d", i, {1000 * i + k for k in range(100)} | {500_000 + i, 500_001 + i}) for i in range(10)]
    rows += [("d", 20, set(range(90_000, 90_100))), ("d", 21, set(range(90_005, 90_105)))]
    df = frame(spark, rows)
    order = similarity.token_order([df], "bits")
    listed = similarity.shared_postings(df, ["ds"], "id", "bits", order, 0.65)
    assert listed.count() < 120 and listed.where("_c < 2").isEmpty()
    compared = []
    plain = similarity.verify

    def spy(pairs, *rest):
        compared.extend((r["id_a"], r["id_b"]) for r in pairs.collect())
        return plain(pairs, *rest)

    monkeypatch.setattr(similarity, "verify", spy)
    found = similarity.similarity_join(df, None, ["ds"], "id", "bits", 0.65, postings=listed).collect()
    assert [(r["id_a"], r["id_b"], r["n_shared"]) for r in found] == [(20, 21, 95)]
    assert compared == [(20, 21)]


def test_tokens_are_counted_once_for_a_clustering(spark, monkeypatch):
    calls = []
    plain = leaders.token_order
    monkeypatch.setattr(leaders, "token_order", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(similarity, "token_order", lambda *a: calls.append(1) or plain(*a))
    rows = make_sets(7, 60, 2)
    got = leaders.leader_cluster(frame(spark, rows), "ds", "id", "bits", 0.65, 40, 10**9)
    assert {(r["ds"], r["id"]) for r in got.collect()} == greedy(rows, 0.65)
    assert len(calls) == 1


def test_digests_stand_for_keys_in_exact_assignment(spark):
    rows = spark.createDataFrame([("d", "k", 1), (None, "k", 2), ("d", None, 3), ("e", "k", 4)], "ds string, key string, id int")
    nodes = spark.createDataFrame([("d", "k", 7), ("d", "k", 6), ("d", None, 5), (None, "k", 4)], "ds string, key string, cluster_ID int")
    joined = similarity.assign_exact(rows, nodes, "ds", "key")
    assert [tuple(r) for r in joined.collect()] == [("d", "k", 1, 6)]
    assert joined.columns == ["ds", "key", "id", "cluster_ID"]
