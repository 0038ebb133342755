"""Secrets in texts: fixed patterns, and credential-context values that are hard to guess.

How hard a value is to guess is the cheapest way to put it together from dictionary words, dates,
repeats, keyboard walks and brute-force characters, found by dynamic programming over its
positions (the idea of low-budget password strength estimation). Every value of six or more
characters that stands where a credential is expected is put to it, and the cost alone decides
whether it is reported in addition to the pattern matches.
"""

from __future__ import annotations

import re
from base64 import b64decode
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256
from itertools import accumulate
from json import load as load_json
from math import log10

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded_batches, give_back
from .token_counts import vocabulary

KINDS = ("assign", "access", "hex", "guess")
# Decimal logarithm of the guesses from which a value in a credential context is reported.
MIN_GUESSES = 10.0
MASK = "[REDACTED]"

# The pattern matches.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 or more: a longer match cannot start elsewhere
MIN_ASSIGN, MIN_ACCESS = 6, 20

# Where a credential is expected: a name and a sign before the value, or the user part of a URL. The
# name may be the end of a longer one (MYSQL_PWD, user_password, clientSecret). The sign is an
# operator, a tag that ends (or several), or the word "is"; white space, line ends and tags may follow.
_TAGS = r"(?:<[^<>]{1,200}>\s*)"
CONTEXT = re.compile(
    r"(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|secret)[_-]?key"
    r"|auth|authorization|credentials?)[\"']?"
    rf"(?:\s*(?::=|=>|->|[:=])\s*{_TAGS}*|\s*{_TAGS}+|>\s*|\s+is\s+)(?:bearer\s+)?[\"']?"
    r"|(?<![a-z0-9])bearer\s+|(?<![a-z0-9])[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:)([^\s\"'<>]{6,})",
    re.IGNORECASE | re.ASCII,
)
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "://")

# Words that people put into passwords, the most used ones first.
COMMON = (
    "password pass admin welcome login letmein monkey dragon master qwerty iloveyou princess football "
    "baseball shadow sunshine superman batman trustno hello freedom whatever secret summer winter spring "
    "autumn flower jordan michael jennifer thomas robert daniel charlie andrew joshua george hunter ginger "
    "pepper cookie banana orange apple silver golden purple yellow cheese chicken computer internet server "
    "system default changeme guest user root test demo example sample private public access account manager "
    "office company service support january february march april june july august september october november "
    "december monday tuesday wednesday thursday friday saturday sunday your here placeholder token key value"
).split()
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d"
)
DATE_COST = {True: log10(365 * 120), False: log10(120)}
# Guesses for choosing one more segment.
JOINT = 1.0


def _neighbours() -> dict[str, str]:
    """Keys that touch. Places are in half keys: each row stands a little to the right of the one
    above it."""
    where = {c: (r, 2 * i + shift) for r, (row, shift) in enumerate(zip(ROWS, (0, 3, 4, 5))) for i, c in enumerate(row)}
    return {
        a: "".join(b for b, (s, j) in where.items() if (abs(r - s), abs(x - j)) in ((0, 2), (1, 1)))
        for a, (r, x) in where.items()
    }


NEAR = _neighbours()


# Words of prose and parts of compounds: what is one token of these vocabularies and has four letters or
# more, with or without a blank in front, the most used ones first. The second one is of many languages.
PROSE = ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")


def word_list() -> list[str]:
    """The words of the dictionary, the most used ones first: common ones, then those of the
    vocabularies in turn. It is made once, by the driver, and sent to the tasks."""
    with open(vocabulary(PROSE[0]), encoding="utf-8") as f:
        ids = load_json(f)["model"]["vocab"]
    one = [t.removeprefix("Ġ") for t in sorted(ids, key=ids.get) if t.isascii() or t.startswith("Ġ")]
    with open(vocabulary(PROSE[1]), "rb") as f:
        two = [b64decode(line.split()[0]).decode("utf-8", "replace").removeprefix(" ") for line in f]
    parts = [[t.lower() for t in part if len(t) >= 4 and t.isalpha()] for part in (one, two)]
    # The first one stands for other letters than ASCII by signs of its own.
    parts[0] = [t for t in parts[0] if t.isascii()]
    mixed = [w for k in range(max(map(len, parts))) for part in parts for w in part[k : k + 1]]
    return list(dict.fromkeys([*COMMON, *mixed]))


@dataclass
class Dictionary:
    """``cost``: decimal logarithm of each word's rank; ``reach``: the longest word by its first three
    letters."""

    cost: dict[str, float]
    reach: dict[str, int]

    @classmethod
    def of(cls, words: list[str]) -> Dictionary:
        reach: dict[str, int] = {}
        for w in words:
            reach[w[:3]] = max(reach.get(w[:3], 0), len(w))
        return cls({w: log10(i + 2) for i, w in enumerate(words)}, reach)


@cache
def dictionary() -> Dictionary:
    """The dictionary of this process, read from the vocabulary files."""
    return Dictionary.of(word_list())


_SENT: list[Dictionary] = []


def _sent(words) -> Dictionary:
    """The dictionary of the broadcast word list, built once in a worker; the list is always the same."""
    if not _SENT:
        _SENT.append(Dictionary.of(words.value))
    return _SENT[0]


def _alphabet(value: str) -> float:
    """Decimal logarithm of the number of characters that a brute-force attack has to try."""
    size = 0
    for found, n in (
        (any("a" <= c <= "z" for c in value), 26),
        (any("A" <= c <= "Z" for c in value), 26),
        (any(c.isdigit() for c in value), 10),
        (any(not c.isalnum() for c in value), 33),
        (any(ord(c) > 127 for c in value), 100),
    ):
        size += n * found
    return log10(max(size, 2))


PLACE = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
WALK_COST, TURN_COST = log10(47), log10(5)


def _walks(low: str) -> list[tuple[int, int, list[int]]]:
    """Maximal walks over neighbouring keys of three or more: start, end and, for every step, the
    number of changes of direction up to it."""
    out, start, turns, step = [], 0, [], None
    for i in range(1, len(low) + 1):
        if i < len(low) and low[i] in NEAR.get(low[i - 1], ""):
            (r, a), (t, b) = PLACE[low[i - 1]], PLACE[low[i]]
            new = (t - r, b - a)
            turns.append(turns[-1] + (new != step) if turns else 0)
            step = new
            continue
        if i - start >= 3:
            out.append((start, i, turns))
        start, turns, step = i, [], None
    return out


def guess_cost(value: str, words: Dictionary | None = None) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` needs.

    Segments: a word of the dictionary (upper-case letters and digits for letters cost extra); a date or
    year; a repeat of one to four characters, from any place as often as they go on there (the cost of
    one, times the count); a walk of three keys or more that starts where a maximal walk over
    neighbouring keys starts, or ends where it ends; and single brute-force characters. Each segment
    but a brute-force character after another adds ``JOINT``. An empty value costs nothing. Time grows
    in proportion to the length.
    """
    n = len(value)
    words = words or dictionary()
    cost_of, reach = words.cost, words.reach
    low = value.lower()
    low = low if len(low) == n else value  # a few letters change their number when lowered
    plain = low.translate(LEET)
    per_char = _alphabet(value)
    inf = float("inf")
    # best[i]: cheapest cost of the first i characters, by whether the last segment is brute force.
    brute, other = [inf] * (n + 1), [inf] * (n + 1)
    other[0] = 0.0
    dates: dict[int, list[tuple[int, float]]] = {}
    for m in DATE.finditer(low):
        dates.setdefault(m.start(), []).append((m.end(), DATE_COST[m.end() - m.start() > 4]))
    # runs[p][i]: how many characters from i on equal the one p places later.
    runs = []
    for p in range(1, 5):
        run, count = [0] * (n + 1), 0
        for i in range(n - p - 1, -1, -1):
            count = count + 1 if value[i] == value[i + p] else 0
            run[i] = count
        runs.append(run)
    walks = _walks(low)
    walk = 0
    upper = list(accumulate((c.isupper() for c in value), initial=0)) if value != low else None
    forms = ((low, 0.0), (plain, log10(2))) if plain != low else ((low, 0.0),)
    for i in range(n):
        here = min(brute[i], other[i])
        joint = JOINT if i else 0.0
        brute[i + 1] = min(brute[i], other[i] + joint) + per_char
        base = here + joint
        for j, cost in dates.get(i, ()):
            other[j] = min(other[j], base + cost)
        for text, extra in forms:
            longest = reach.get(text[i : i + 3], 0)
            for j in range(i + 3, min(n, i + longest) + 1):
                cost = cost_of.get(text[i:j])
                if cost is not None:
                    big = upper[j] - upper[i] if upper else 0
                    shift = 0.0 if not big else log10(2) if big in (1, j - i) else 0.3 * big
                    other[j] = min(other[j], base + cost + shift + extra)
        for p, run in enumerate(runs, start=1):
            times = 1 + run[i] // p
            if times > 1 and times * p >= 3:
                j = i + times * p
                other[j] = min(other[j], base + p * per_char + log10(times))
        while walk < len(walks) and walks[walk][1] - 3 < i:
            walk += 1
        if walk < len(walks) and walks[walk][0] <= i:
            start, end, turns = walks[walk]
            for j in range(i + 3, end + 1) if i == start else (end,):
                # The first step counts as a turn too.
                turned = 1 + turns[j - 2 - start] - turns[i - start]
                other[j] = min(other[j], base + WALK_COST + turned * TURN_COST + log10(j - i))
    return min(brute[n], other[n])


def base_spans(text: str, low: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret part) of the pattern matches."""
    found = []
    if "passw" in low or "secret" in low or "token" in low or "apikey" in low or "api_key" in low:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                found.append((m.start(), 0, m.end(), m.start(2)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                found.append((m.start(), 1, m.end(), m.start()))
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end(), m.start()))
    return found


def scan(text: str, words: Dictionary | None = None) -> tuple[list[tuple[int, int, int, int]], float | None]:
    """All spans as (start, kind, end, start of the secret part), sorted, and the largest guess
    cost among the credential-context values (null without one)."""
    low = text.lower()
    spans = base_spans(text, low)
    costs = [guess_cost(text[s:end], words) for _, kind, end, s in spans if kind == 0]
    if any(h in low for h in HINTS):
        base = sorted((s, e) for s, _, e, _ in spans)
        starts, ends = [s for s, _ in base], list(accumulate((e for _, e in base), max))
        for m in CONTEXT.finditer(text):
            value = m.group(1)
            if "://" in text[m.start() : m.start(1)]:
                value = value.split("@")[0] if "@" in value else ""
            value = value.rstrip(".,;:!?)]}`*|&%#$") if not value.isalnum() else value
            if len(value) < 6:
                continue
            start, end = m.start(1), m.start(1) + len(value)
            cost = guess_cost(value, words)
            costs.append(cost)
            before = bisect_right(starts, start)
            if cost >= MIN_GUESSES and not (before and ends[before - 1] >= end):
                spans.append((start, 3, end, start))
    return sorted(spans), max(costs, default=None)


def listed(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``<key>, n_assign, n_access, n_hex, base_sha256, spans, n_guess, max_guess_log10``.

    Values where a credential is expected are spans of kind ``guess`` if they are of 6 characters
    or more and cost 10^``MIN_GUESSES`` guesses or more, whatever characters they are of. ``spans`` lists all spans as kind:start:end in code points, end exclusive, by start and kind;
    ``base_sha256`` is the SHA-256 of the same list of the pattern matches alone. A null text is
    empty: no spans, the hash of the empty string. Rows are kept one to one, whatever their key;
    an empty table gives no rows; other columns are not read. One pass without a shuffle.
    """
    bounded_batches(df.sparkSession)
    words = df.sparkSession.sparkContext.broadcast(word_list())  # some 50,000 words, whatever the data
    fields = (
        "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
        "n_guess bigint, max_guess_log10 double"
    )

    @F.pandas_udf(fields)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                spans, cost = scan(t, _sent(words))
                kinds = [s[1] for s in spans]
                base = listed([s for s in spans if s[1] < 3])
                rows.append(
                    (kinds.count(0), kinds.count(1), kinds.count(2), sha256(base.encode()).hexdigest(),
                     listed(spans), kinds.count(3), cost)
                )
            names = [f.split()[0] for f in fields.split(", ")]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"max_guess_log10": "float64"})
        give_back()

    out = df.select(df[key], scanned(F.coalesce(df[text].cast("string"), F.lit(""))).alias("_s"))
    return out.select(key, "_s.*")


def redact(spark: SparkSession, text: Column) -> Column:
    """The text with every secret part masked: the value of an assignment, the whole of the other
    spans; overlapping parts are masked together. Texts without spans and nulls stay as they are."""

    words = spark.sparkContext.broadcast(word_list())

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([t if t is None else mask(t, _sent(words)) for t in texts], dtype=object)
        give_back()

    return masked(text)


def mask(text: str, words: Dictionary | None = None) -> str:
    parts = sorted((secret, end) for _, _, end, secret in scan(text, words)[0])
    out, at = [], 0
    for start, end in parts:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text
