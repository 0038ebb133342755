"""Token counts, SentencePiece, HTML, language and secrets against libraries and brute force."""

from __future__ import annotations

import json
import random
import re
import time
from hashlib import sha256
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from compscope.llm import language_id, secret_scan as secrets, sentencepiece_codec, token_counts as counts_module  # noqa: E402
from compscope.llm.html_text import Cell, align, extract_text, lay_out, visible_text  # noqa: E402
from compscope.llm.language_id import gram_counts, held_out, identify_languages  # noqa: E402
from compscope.llm.sentencepiece_codec import Codec, codec, decode_ids, encode_texts  # noqa: E402
from compscope.llm.token_counts import ByteBpe, byte_bpe, token_counts  # noqa: E402

ODD = [
    "", " ", "  ", "\n", "a  b", " lead", "trail ", "x\n\ty", "don't we'll 's", "a 　b", "\x1c a\x1c b",
    "<|endoftext|>", "x <|endoftext|> y<|endoftext|><|endoftext|>", "日本語テキスト 漢字🙂", "a\u0000b", "1234 56.78",
    "word.\nNext*** a&&&b", "é" * 50, "▁x", "ththththththhehehe" * 9, "é ​ x", "“q” — ‘r’",
]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Texts with a null, repeated rows, a null key and columns whose names an operator may use."""
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(100, None, "x", 1), (101, "same", "x", 1)] * 2
    rows.append((None, "no key", "x", 1))
    return spark.createDataFrame(rows, "doc_id bigint, text string, _text string, n_tokens int")


def test_token_counts_equal_the_library(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), byte_bpe(path)
    points = [chr(c) for c in [*range(0x3100), *range(0x3100, 0x110000, 997)] if not 0xD800 <= c < 0xE000]
    for t in ODD + texts + [f"a{c} {c}b1{c}  {c} x" for c in points]:
        assert own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_merging_by_rules_equals_the_fast_merger(texts):
    slow = ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), fast=False)
    fast = byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(slow.whole) == len(fast.whole) > 40_000
    for t in ODD + texts[:40]:
        assert slow.encode_bytes(t) == fast.encode_bytes(t)


def test_token_counts_rows(spark, odd_rows):
    got = token_counts(odd_rows, limit=3)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    rows = got.collect()
    assert len(rows) == odd_rows.count()
    assert [tuple(r) for r in rows if r.doc_id == 100] == [(100, 0, 0, False)] * 2
    assert [tuple(r)[1:] for r in rows if r.doc_id is None] == [(6, 2, False)]
    assert token_counts(odd_rows.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000)], "doc_id bigint, text string")
    assert token_counts(long).first().n_tokens == 200_001


def sp_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_sentencepiece_equals_the_library(texts):
    library, own = sp_model(), codec(public_tokenizers.path("piece_bpe_32k.model"))
    for t in ODD + texts[:80]:
        ids = library.encode(t)
        assert own.encode(t) == ids, repr(t)
        assert own.decode(ids) == library.decode(ids), repr(t)


def test_streaming_search_commits_early_and_without_cuts(texts):
    own = codec(public_tokenizers.path("piece_bpe_32k.model"))
    text = own.normalise(" ".join(texts[:3]))
    runs = list(own.search(text))
    assert len(runs) > 10 and "".join(p for run in runs for p in run) == text
    assert [i for run in runs for p in run for i in own._ids(p)] == sp_model().encode(" ".join(texts[:3]))


def test_unigram_reading_has_the_best_score(texts):
    """The same pieces read as a unigram model: the streaming search must reach the best total."""
    own = Codec(sp_model(), unigram=True)

    def best_total(text):
        best = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - own.longest), end):
                piece = text[start:end]
                gain = own.score.get(piece, own.floor if end - start == 1 else -np.inf)
                best[end] = max(best[end], best[start] + gain)
        return best[-1]

    for t in ["hello there world", "thththing", *[x[:300] for x in texts[:20]]]:
        whole = own.normalise(t)
        pieces = [p for run in own.search(whole) for p in run]
        assert "".join(pieces) == whole
        assert sum(own.score.get(p, own.floor) for p in pieces) == pytest.approx(best_total(whole))


def test_sentencepiece_rows(spark, odd_rows):
    rows = encode_texts(odd_rows).collect()
    assert len(rows) == odd_rows.count()
    assert [(list(r.ids), r.n_ids, r.round_trip) for r in rows if r.doc_id == 100] == [([], 0, True)] * 2
    back = decode_ids(encode_texts(odd_rows.where("doc_id < 18")), "doc_id", "ids").collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate(ODD[:18]))
    assert encode_texts(odd_rows.limit(0)).count() == 0


PAGES = [
    ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
    ("<ul><li>a<li>b<ol start=3><li>c<li><p>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
    ("<head><title>t</title><style>s</style></head><h1>x</h1><script>y</script>z", "x\n\nz"),
    ("<div hidden>a</div><p style='display: none'>b</p><span style='visibility:hidden'>c</span>d", "d"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>12<tr><td colspan=2>all of it</table>",
     "Name   Qty\napple  12\nall of it"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
    ("<pre>\n  keep\n   this</pre>", "  keep\n   this"), ("<p>a<table><tr><td><p>b</table>c", "a\n\nb\n\nc"),
    ("a &lt; b &amp;amp; <i>c</i> d", "a < b &amp; c d"), ("x<!-- no -->y<!-- open", "xy"), ("</p></b>x</div>", "x"),
    ("<a title='it\"s'>k</a>", "k"), ("<blockquote>q<p>r</blockquote>s", "    q\n\n    r\n\ns"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_visible_text(html, text):
    assert visible_text(html) == text.strip("\n")


def test_html_is_robust_and_keeps_rows(spark):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    rows = [(1, None), (2, ""), (3, "<p>x"), (3, "<p>x"), (None, "y"), (4, deep), (5, "<" * 1000)]
    df = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id bigint, html string, text string, n_chars int")
    got = [tuple(r) for r in extract_text(df).select("page_id", "text", "n_chars", "n_lines").collect()]
    assert sorted(got[:6], key=str) == sorted(
        [(1, "", 0, 0), (2, "", 0, 0), (3, "x", 1, 1), (3, "x", 1, 1), (None, "y", 1, 1), (4, "deep", 4, 1)], key=str
    )
    assert extract_text(df.limit(0)).count() == 0
    assert align([[("a\nb", 1), ("c", 1)], [("long", 1), ("d", 1)]]) == "a     c\nb\nlong  d"


def test_all_visible_words_of_pages_are_there(spark):
    """Words of the paragraphs, by a crude cut, all occur in the extracted text, in order."""
    for page in spark.read.parquet(f"{SF}/pages.parquet").limit(30).collect():
        body = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", page.html)
        words = [w for w in re.sub(r"<[^>]*>", " ", body).split() if "&" not in w]
        found = iter(re.sub(r"(?m)^ *(-|\d+\.) ", "", visible_text(page.html)).split())
        assert all(any(w == f for f in found) for w in words)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_languages(docs, sample_rows=100).join(docs, "doc_id")
    row = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert row[0] > 0.98 and row[1] > 150
    assert got.where("score < 0 OR score > 1").isEmpty()


def test_language_edge_rows(spark):
    assert identify_languages(
        spark.createDataFrame([], "doc_id bigint, text string, lang string")
    ).collect() == []
    rows = [(i, "der die das und nicht", "de", "z", 0.5) for i in range(20)]
    rows += [(50, None, "de", "z", 0.5), (51, "123 !!", None, "z", 0.5), (51, "123 !!", None, "z", 0.5), (None, "und", None, "z", 0.5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string, score double")
    got = identify_languages(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[50] == ("und", 0.0) and by[51] == ("und", 0.0) and by[0][0] == "de" and by[None][0] == "de"
    unlabelled = identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    import zlib

    flags = {r.doc_id: r.h for r in df.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (k is not None and zlib.crc32(str(k).encode()) % 4 == 2) for k, h in flags.items())


def test_long_texts_count_like_short_ones():
    text = "Ab cd, éf! " * 40_000
    got = gram_counts([text, "", "12 34"])
    assert got[0].sum() == pytest.approx(40_000 * got_grams("Ab cd, éf! "), rel=1e-3)
    assert not got[1:].any()


def got_grams(unit: str) -> float:
    return float(gram_counts([unit * 11])[0].sum() - gram_counts([unit * 10])[0].sum())


def brute_base(text: str) -> list[tuple[int, int, int]]:
    """The base patterns, position by position."""
    found = []
    names, value = ("password", "passwd", "secret", "token", "api_key", "apikey"), re.compile(r"[A-Za-z0-9+/_.=-]+")
    at = 0
    while at < len(text):
        end = None
        for name in sorted(names, key=len):
            if text[at : at + len(name)].lower() == name and text[at : at + len(name)].isascii():
                i = at + len(name)
                i += text[i : i + 1] in ('"', "'") and bool(text[i : i + 1])
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] in (":", "=") and text[i : i + 1]:
                    i += 1
                    while text[i : i + 1] == " ":
                        i += 1
                    i += text[i : i + 1] in ('"', "'") and bool(text[i : i + 1])
                    m = value.match(text, i)
                    if m:
                        end = m.end()
                        if m.end() - m.start() >= 6:
                            found.append((at, 0, end))
                        break
        at = end if end else at + 1
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(found)


SECRETS = [
    'password = "hunter22" token:abc secret=abcdefg', "PassWd : 'x.y/z+w=1-_' API_KEY=123456apikey=7654321",
    "AKIA" + "A1" * 8 + " AKIA" + "B" * 15, "x" + "0a" * 12 + "g " + "f" * 23, "token=secret=abcdef", "paſsword=abcdefg",
    "é token: 0123456789abcdef0123456789abcdef", "", "secret", "token = ", "tokentoken=aaaaaa", "api__key=abcdefgh",
]


@pytest.mark.parametrize("text", SECRETS)
def test_base_spans(text):
    got = sorted(s[:3] for s in secrets.base_spans(text, text.lower()))
    assert got == brute_base(text)


def test_secret_rows_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, "")] + [(-3 - i, t) for i, t in enumerate(SECRETS)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(extra).withColumn("spans", F.lit("clash"))
    text = {r.doc_id: r.text or "" for r in both.collect()}
    rows = secrets.scan_secrets(both).collect()
    assert len(rows) == len(text)
    for r in rows:
        base = brute_base(text[r.doc_id])
        listed = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == sha256(listed.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    assert secrets.scan_secrets(both.limit(0)).count() == 0


def test_guess_costs_are_ordered():
    cost = secrets.guess_cost
    weak = ["password", "Password1", "qwertyuiop", "aaaaaaaaaa", "20200131", "abcabcabc", "changeme"]
    assert max(map(cost, weak)) < 6 < secrets.MIN_GUESSES < cost("xK9#mQ2$vL7p")
    assert cost("") == 0 and cost("zzzz") < cost("zqxj") and cost("p@ssword") < 3
    assert cost("a" * 5_000) < 10 < cost("kq7Zw" * 3 + "x9")
    # Never dearer than pure brute force.
    for v in ["monkey12", "tr0ub4dor", "1q2w3e4r", "é9Ü_x"]:
        assert cost(v) <= len(v) * secrets._alphabet(v) + secrets.JOINT


def test_guess_spans_and_masks():
    text = 'pwd: xK9#mQ2$vL7p and pass: monkey, Authorization: Bearer q8Zr-77Tkw02LmNx. the key: algorithm'
    spans = secrets.scan(text)[0]
    assert [text[s:e] for s, k, e, _ in spans if k == 3] == ["xK9#mQ2$vL7p", "q8Zr-77Tkw02LmNx"]
    assert secrets.mask("a password = 'hunter22' b") == f"a password = '{secrets.MASK}' b"
    assert secrets.mask("clean text") == "clean text"


@pytest.mark.parametrize("text, value", [
    ("pwd=hGtRfKqLmZxWvBnC", "hGtRfKqLmZxWvBnC"),  # letters only
    ("passphrase: xK!mQz#vRtYwPl", "xK!mQz#vRtYwPl"),  # no digit
    ("password: xK!mQz#vRtYwPl", "xK!mQz#vRtYwPl"),
    ("pin_code pwd: 830174659201", "830174659201"),  # digits only
    ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYz", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYz"),
    ("MYSQL_PWD=Zk9vR2mQ8xLt", "Zk9vR2mQ8xLt"),
    ("user_password: q#8Zr77Tkw02", "q#8Zr77Tkw02"),
    ("dbPwd = wq#Zr!Tkwxv", "wq#Zr!Tkwxv"),
    ("x_postgres://me:kQzmWvXbRt@host", "kQzmWvXbRt"),
])
def test_only_the_cost_decides_on_credential_values(text, value):
    assert [text[s:e] for s, k, e, _ in secrets.scan(text)[0] if k == 3] == [value]
    assert value not in secrets.mask(text)


@pytest.mark.parametrize("text", [
    "auth: northwestern lights", "pass: requirements, all", "pwd: Tomorrow", "the credentials: university", "pwd=qwertyuiop",
])
def test_words_of_prose_cost_little(text):
    assert secrets.scan(text)[0] == [] and secrets.scan(text)[1] < secrets.MIN_GUESSES


@pytest.mark.parametrize("html, text", [
    ("<p>so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>tex</annotation></math> is</p>", "so x= 1 2 is"),
    ("a <svg><title>t</title><desc>d</desc><defs/><path d='M0'/><g>no<text x=1>Jan</text><text>Fe<tspan>b</tspan></text></g></svg> z", "a Jan Feb z"),
    ("<p>pick <select><optgroup label='Big'><option>one<option selected>two</optgroup></select> now", "pick\nBig\none\ntwo\nnow"),
    ("<textarea>\n two &lt; three\n  lines</textarea>", " two < three\n  lines"),
    ("<div style='visibility:hidden'>a<hr><p>b <b style='visibility: visible'>c</b></p></div>d", "c\n\nd"),
    ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b <q>c</q></ul>", "- b \"c\""),
    ("<div style='display:none'><p style='visibility:visible'>a</p></div>b", "b"),
])
def test_forms_formulas_drawings_and_visibility(html, text):
    assert visible_text(html) == text


def brute_cost(value):
    """The cheapest of all segmentations into the documented segments, tried one by one."""
    words, per_char, low = secrets.dictionary(), secrets._alphabet(value), value.lower()
    walks = secrets._walks(low)

    def costs(i, j):
        part, lowered = value[i:j], low[i:j]
        for form, extra in ((lowered, 0.0), (lowered.translate(secrets.LEET), log10(2))):
            if form in words.cost and len(form) >= 3:
                big = sum(c.isupper() for c in part)
                yield words.cost[form] + extra + (0 if not big else log10(2) if big in (1, j - i) else 0.3 * big)
        for p in range(1, 5):
            times = (j - i) // p
            goes_on = value[j : j + p] == part[:p]
            if (j - i) % p == 0 and times > 1 and j - i >= 3 and part == part[:p] * times and not goes_on:
                yield p * per_char + log10(times)
        if (found := secrets.DATE.fullmatch(lowered)) and any(m.span() == (i, j) for m in secrets.DATE.finditer(low)):
            yield secrets.DATE_COST[found.end() > 4]
        for a, b, turns in walks:
            if a <= i and j <= b and j - i >= 3 and (i == a or j == b):
                steps = [(secrets.PLACE[y][0] - secrets.PLACE[x][0], secrets.PLACE[y][1] - secrets.PLACE[x][1]) for x, y in zip(lowered, lowered[1:])]
                turned = 1 + sum(x != y for x, y in zip(steps, steps[1:]))
                yield secrets.WALK_COST + turned * secrets.TURN_COST + log10(j - i)

    n = len(value)
    best = {(0, False): 0.0}  # by position and whether the last segment is brute force
    for i in range(n):
        for was in (False, True):
            if (i, was) in best:
                here, joint = best[i, was], secrets.JOINT if i else 0.0
                steps = [((i + 1, True), per_char + (0.0 if was else joint))]
                steps += [((j, False), c + joint) for j in range(i + 2, n + 1) for c in costs(i, j)]
                for to, c in steps:
                    best[to] = min(best.get(to, float("inf")), here + c)
    return min(best.get((n, w), float("inf")) for w in (False, True))


def test_guess_cost_equals_enumeration():
    rng = random.Random(8)
    parts = ["password", "P4ssw0rd", "qwer", "asdfgh", "zaq1", "2021", "01.02.2020", "20200101", "aaa", "abab", "x7", "Q", "sunshine", "ß", "xyzxyz", "-"]
    for _ in range(150):
        value = "".join(rng.choices(parts, k=rng.randint(1, 4)))[:24]
        assert secrets.guess_cost(value) == pytest.approx(brute_cost(value)), value


@pytest.mark.parametrize("unit", ["a", "qw", "passw0rd", "20200101", "Zk9vR2mQ8xLtP", "asdfgfds"])
def test_guess_cost_of_a_long_value_is_linear(unit):
    start = time.perf_counter()
    secrets.guess_cost(unit * (300_000 // len(unit)))
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize("text", [
    "<password>Zk9vR2mQ8xLt</password>", "password:\nZk9vR2mQ8xLt", "access_token\t=\tZk9vR2mQ8xLt", "the password is Zk9vR2mQ8xLt",
    "<td>Secret</td>\n<td>Zk9vR2mQ8xLt</td>", "<b>Token:</b> Zk9vR2mQ8xLt", "token =     \"Zk9vR2mQ8xLt\"",
])
def test_secret_contexts(text):
    assert "Zk9vR2mQ8xLt" not in secrets.mask(text)


def test_no_language_is_lost(spark):
    one, other = "das haus und der garten sind nicht gross", "le chat est dans la maison avec des amis"
    rows = [(8, one, "zz")] * 900 + [(11, other, "yy")] * 900  # ids that are not held out
    rows += [(i, f"the cat sat on the mat with a hat {i}", "en") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in identify_languages(df, sample_rows=40).where("doc_id IN (8, 11)").collect()}
    assert {p for k, p in got if k == 8} <= {"zz", "en"} and identify_languages(df, sample_rows=40).where("lang_pred = 'zz'").count() >= 900
    many = spark.createDataFrame([(4 * i, "text", f"l{i}") for i in range(300)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        identify_languages(many).count()


def test_svm_is_the_best_separator():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    penalty = 0.1
    w, b = language_id.train_svm(x, y, penalty, steps=4_000)
    v = np.append(w, b)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def loss(v):
        return penalty / 2 * v @ v + (weight * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum()

    # The loss is convex: no step in any direction lowers it.
    least = loss(v)
    assert all(loss(v + step * d) > least - 1e-9 for d in np.vstack([np.eye(6), rng.normal(size=(50, 6))]) for step in (1e-3, -1e-3))


def test_long_text_without_blanks_is_linear():
    sp = sentencepiece_codec.codec(public_tokenizers.path("piece_bpe_32k.model"))
    start = time.perf_counter()
    assert len(sp.encode("".join(chr(0x4E00 + i % 3_000) for i in range(300_000)))) >= 300_000
    assert time.perf_counter() - start < 10


def test_id_width_follows_the_vocabulary(tmp_path):
    for n, want in ((100, "<u2"), (65_536, "<u2"), (65_537, "<u4")):
        file = tmp_path / f"{n}.json"
        file.write_text(json.dumps({"model": {"vocab": {f"t{i}": i for i in range(n)}}, "added_tokens": []}))
        assert counts_module.id_type(str(file)) == want


@pytest.mark.parametrize("html, want", [
    ("<table><tr><td rowspan=2>Alpha<td>B<tr><td>C</table>", "Alpha  B\n       C"),
    ("<table><tr><td colspan=2>A very wide spanning cell<td>X<tr><td>a<td>b<td>Y</table>",
     "A very wide spanning cell  X\na             b            Y"),
    ("<table><tr><td>a<td rowspan=2>one<br>two<br>three<tr><td>b<tr><td>c<td>d</table>", "a  one\nb  two\n   three\nc  d"),
    ("<form>Go <input type=submit value=Send><input type=text value=typed><input type=reset value=Clear></form>", "Go Send Clear"),
    ("<details><summary>More</summary><p>inner</details><details open><summary>S</summary>seen</details>", "More\nS\nseen"),
    ("<style>.x, p#no {color:red; display:none} @media print {.y{display:none}} b{display:none} b{display:inline}</style>"
     "<p class='a x'>gone<p id=no>gone<p class=y>here<p><b>bold</b>", "here\n\nbold"),
    ("<table><tr><td>k<td><table><tr><td>a<td>b<tr><td>cc<td>d</table></table>", "k  a   b\n   cc  d"),
    ("<ul><li><table><tr><td>a<td>b<tr><td>c<td>d</table></ul>", "- a  b\n  c  d"),
])
def test_html_layout(html, want):
    assert visible_text(html) == want


def test_table_cells_never_overlap_and_stand_in_their_columns():
    rng = random.Random(9)
    for _ in range(200):
        rows = [[Cell([f"{r}.{i}x" * rng.randint(1, 3)] * rng.randint(1, 3), rng.randint(1, 3), rng.randint(1, 3))
                 for i in range(rng.randint(0, 4))] for r in range(rng.randint(1, 5))]
        cells = [c for row in rows for c in row]
        texts = [list(c.lines) for c in cells]
        out = lay_out(rows)
        at = {}
        for c, lines in zip(cells, texts):
            spots = {(r, k) for r in range(c.row, c.row + c.high) for k in range(c.col, c.col + c.wide)}
            assert c.row + c.high <= len(rows) and (c.row, c.col) in spots
            at[c] = lines
        for c, lines in at.items():  # every line of a cell is there
            assert all(any(line in row for row in out) for line in lines)


def test_nested_tables_are_linear():
    start = time.perf_counter()
    assert visible_text("<table><tr><td>" * 20_000 + "deep" + "</table>" * 20_000) == "deep"
    rows = visible_text("<table><tr><td>x<tr><td>" * 5_000 + "deep").split("\n")
    assert [r for r in rows if r] == ["x"] * 5_000 + ["deep"]
    assert time.perf_counter() - start < 20
