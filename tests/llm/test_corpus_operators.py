"""Line dedup, whitening and phrases against brute force on small tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from compscope.llm import line_dedup as lines, phrases, whitening
from compscope.llm.cuckoo import CuckooFilter, filled
from compscope.llm.line_dedup import LineIndex, drop_common_lines
from compscope.llm.phrases import mine_phrases
from compscope.llm.whitening import bit_planes, scatter_counts, whiten

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string"


def digests(rng, n):
    return tuple(rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64) for _ in "ab")


def test_cuckoo_filter_never_misses_and_forgets():
    rng = np.random.default_rng(1)
    h1, h2 = digests(rng, 20_000)
    f = filled(h1, h2)
    assert len(f) == 20_000 and f.contains(h1, h2).all()
    assert f.contains(*digests(rng, 100_000)).mean() < 0.001
    f = CuckooFilter.from_bytes(f.to_bytes())
    f.remove(h1[:15_000], h2[:15_000])
    assert len(f) == 5_000 and f.contains(h1[15_000:], h2[15_000:]).all()
    assert f.contains(h1[:15_000], h2[:15_000]).mean() < 0.01
    assert f.insert(h1[:15_000], h2[:15_000]) and f.contains(h1, h2).all()
    with pytest.raises(KeyError):
        CuckooFilter.sized(4).remove(h1[:1], h2[:1])
    small = CuckooFilter.sized(4)
    assert not small.insert(h1[:100], h2[:100])  # full: to be built again


def brute_lines(texts, counted, least, chars=1):
    blank = " \t\n\v\f\r"

    def key(line):
        return re.sub("[A-Z]", lambda m: m.group().lower(), line).strip(blank)

    n = Counter(k for t in counted for k in {key(x) for x in (t or "").split("\n")} if len(k) >= chars)
    out = []
    for t in texts:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < chars or n[key(x)] < least]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["Home", " home\t", "HOME", "É", "é", "x", "", " ", "terms of use", "terms of use ", "\x85n", " wide"]
    words += [f"line {i}" for i in range(40)]
    texts = ["\n".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(n)]
    return texts + ["", None, "\n\n\n", "home\nhome\nhome", "a\r\nhome\r\nb", "z" * 300_000 + "\nhome"]


@pytest.mark.parametrize("chars", [1, 5])
def test_lines_equal_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(lines, "SHARD_KEYS", 4)  # several shards, several tasks to a shard
    monkeypatch.setattr(lines, "PROBE_ROWS", 50)
    monkeypatch.setattr(lines, "WINDOW_KEYS", 30)
    texts = some_texts(1, 300) + ["home\nonly"] * 200  # a group of copies with a third of the rows
    rows = [(None if i % 7 == 0 else i % 50, t, "x") for i, t in enumerate(texts)]  # null and repeated keys
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string").withColumn("_at", F.monotonically_increasing_id())
    got = drop_common_lines(df, min_docs=10, min_chars=chars).orderBy("_at")
    assert got.columns == ["doc_id", "text", "kept", "_at", "n_lines", "n_dropped", "kept_"]
    assert [tuple(r) for r in got.select("n_lines", "n_dropped", "kept_").collect()] == brute_lines(texts, texts, 10, chars)
    assert drop_common_lines(df.limit(0)).count() == 0


def test_line_index_is_reversible(spark):
    def table(texts):
        return spark.createDataFrame([(t,) for t in texts], "text string")

    def state(index):
        filters = {r["shard"]: CuckooFilter.from_bytes(bytes(r["filter"])) for r in index.shards.collect()}
        force = [(r["h1"], r["h2"]) for r in index.in_force().collect()]
        h1, h2 = (np.array([k[i] for k in force], np.int64) for i in (0, 1))
        held = sum(len(f) for f in filters.values())
        assert held == len(force)  # the filters hold the keys in force and nothing else
        for s, f in filters.items():
            mine = (h1 & (index.n_shards - 1)) == s
            assert f.contains(h1[mine], h2[mine]).all()
        return sorted(tuple(r) for r in index.counts.collect())

    a, b, c = some_texts(1, 80), some_texts(2, 80), some_texts(3, 40)
    first = LineIndex.empty(spark, min_docs=10).add(table(a))
    both = first.add(table(b))
    back = both.remove(table(b))
    assert state(back) == state(first) != state(both)
    assert state(both.remove(table(a))) == state(LineIndex.empty(spark, min_docs=10).add(table(b)))
    assert state(back.remove(table(a))) == []
    got = back.add(table(c)).apply(table(c)).select("n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute_lines(c, a + c, 10))
    with pytest.raises(Exception, match="was not added"):
        first.remove(table(["never seen"]))


def whitened(x, components):
    n = len(x)
    centred = x - x.sum(axis=0) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return values, centred @ vectors[:, :components] / np.sqrt(values[:components])


def test_whitening_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 600)
    rng = np.random.default_rng(4)
    c = rng.normal(size=(700, 9)) @ rng.normal(size=(9, 9))
    c[200:450] = c[0]  # a third of the rows is one vector
    rows = [(i, v) for i, v in enumerate(c.tolist())]
    bad = [(800, None), (801, []), (802, [None] * 9), (803, [float("nan")] * 9), (804, [float("inf")] * 9)]
    df = spark.createDataFrame([(*r, 5) for r in rows + bad], "vec_id bigint, embedding array<double>, component int")
    got = whiten(df.repartition(5), components=6).toPandas()
    x = np.floor(64 * c).astype(int) + 1_000_000
    values, want = whitened(x, 6)
    p = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((p * want).sum(axis=0))
    assert np.allclose(p * signs, want, atol=1e-8)
    n = len(x)
    assert (got.groupby("vec_id").deviation.first().to_numpy() == ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)).all()
    assert set(got.n) == {n} and got.identity_error.max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), values[:6] / values.sum())


def test_whitening_edges(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert len(one) == 4 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in one} == {(None, None, 0, None)}
    flat = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in flat) == [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)]
    big = whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.5, 0.25])], schema)).collect()
    assert all(r.deviation is None for r in big if r.vec_id < 3) and max(r.identity_error for r in big) < 1e-4
    with pytest.raises(ValueError, match="components"):
        whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


def test_bit_slices_give_exact_products():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 1 << 40, (333, 4))
    counts = np.zeros((4, 5, 79), np.int64)
    scatter_counts(bit_planes(y.view(np.uint64), 40), counts)
    want = [[sum(int(p) * int(q) for p, q in zip(y[:, a], y[:, b])) for b in range(4)] for a in range(4)]
    assert all(sum(int(v) << s for s, v in enumerate(counts[a, b])) == want[a][b] for a in range(4) for b in range(a, 4))
    assert [sum(int(v) << s for s, v in enumerate(counts[a, 4])) for a in range(4)] == y.sum(axis=0).tolist()


def brute_phrases(rows, least, top, pct=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(zip(*[w[i:] for i in range(k)]))
    out = []
    for lang, c in f.items():
        over = defaultdict(int)
        for g, a in c.items():
            for q in (g[:2], g[1:]) if len(g) == 3 and a >= least else ():
                over[q] = max(over[q], a)
        found = []
        for g, a in c.items():
            if len(g) > 1 and a >= least and not (over[g] and 100 * over[g] >= pct * a):
                score, k = min((10**6 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i, g.decode(), -a, l, r, n[lang], -s) for i, (s, a, g, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_phrases_equal_brute_force(spark, monkeypatch):
    for name, value in (("WINDOW_GRAMS", 500), ("SEGMENT", 3), ("BATCH_ROWS", 64), ("SECTION", 2_000), ("PARTITION_BYTES", 10_000)):
        monkeypatch.setattr(phrases, name, value)
    rng = random.Random(6)
    words = ["the", "The", "of", "a", "New", "york", "city", "É", "é", "\x01odd", "b\x02", "|", "word"] + [f"w{i}" for i in range(30)]
    passage = " ".join(f"p{i}" for i in range(25))  # a long unary path
    ring = "r1 r2 r3 r4 " * 12  # a ring of unary nodes
    rows = []
    for i in range(400):
        text = rng.choice([" ", "  ", "\t"]).join(rng.choices(words, k=rng.randint(0, 30)))
        text = re.sub(" w7 ", rng.choice([". ", "\n", "!? ", " w7 "]), text)
        rows.append((i % 300, rng.choice(["", passage + ". ", "of the of the "]) + text, rng.choice(["en", "de", None, "und"])))
    rows += [(None, ring, "xx"), (1, None, "en"), (2, "", None), (3, " .,;", "yy"), (4, "one", "zz")]
    rows += [(5, "hot pair " + rng.choice(words), "en")] * 200
    rows += [(6, "long text of " * 3_000 + ". " + "hot pair " * 500, "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"{DOCS}, n string")
    for least, top in ((10, 2_000), (3, 7), (1, 50)):
        got = sorted(tuple(r) for r in mine_phrases(df.repartition(4), min_count=least, top=top).collect())
        assert got == brute_phrases([(r[2], r[1]) for r in rows], least, top)
    assert mine_phrases(df.limit(0)).count() == 0
    assert mine_phrases(df.where("doc_id = 3")).count() == 0


def test_score_is_exact_beyond_64_bits(spark):
    n = 3 * 10**12
    df = spark.createDataFrame([(n, n + 7, n + 11)], "a bigint, f_first bigint, l_rest bigint")
    got = df.select(phrases.cut_score("f_first", "l_rest").alias("s")).first().s
    assert got == 10**6 * n * n // ((n + 7) * (n + 11))


def test_line_query_digest(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in lines.line_dedup(df, min_docs=1).collect()}
    empty = sha256(b"").hexdigest()
    assert got == {1: (2, 2, empty), 2: (1, 0, empty)}


def test_phrases_of_languages_with_line_ends_and_backslashes(spark):
    """Such names keep apart, and come back as they were."""
    langs = ["a", "a\nb", "a\\nb", "a\\b", "\\", "\n", "x\n", ""]
    df = spark.createDataFrame([("one two\nb three", lang) for lang in langs for _ in range(10 + len(lang))], "text string, lang string")
    got = {}
    for r in phrases.mine_phrases(df).collect():
        got.setdefault(r["lang"], []).append((r["phrase"], r["a"], r["n"]))
    assert got == {x: [("b three", 10 + len(x), 4 * (10 + len(x))), ("one two", 10 + len(x), 4 * (10 + len(x)))] for x in langs}
