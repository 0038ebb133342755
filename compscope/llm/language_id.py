"""Language identification in two levels: the language family first, then, within the family,
one-versus-one linear support vector machines tell closely related languages apart.

Features are counts of letter 1- to 3-grams in hashed classes, scaled to unit length. All machines
of both levels are trained in one Spark job, a task for each pair, on a sample whose size per class
is a parameter; prediction reads whole texts in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_batches, give_back

# Language families by ISO 639-1 code. A language that is not here is its own family.
FAMILIES = {
    "germanic": "af da de en is nl no sv",
    "romance": "ca es fr gl it pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "semitic": "ar he mt",
    "turkic": "az kk tr uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

DIM = 4_096
# Most labelled rows per language that the machines learn from.
SAMPLE_ROWS = 400
# Most languages that are learned: their machines are pairs, and the driver holds their weights.
MAX_LANGUAGES = 200
# Characters whose features are counted at once.
CHARS = 1 << 18
# Texts whose features are counted, and predicted, at once.
TEXTS = 128
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of letter 1-, 2- and 3-grams in ``DIM`` hashed classes, a row per text. Letters are
    lower-cased; everything between them counts as one blank. Without letters, the row is zero."""
    out = np.zeros((len(texts), DIM), np.float32)
    batch: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), CHARS) if text else ():
            # A long text is counted in parts that share two characters, whose own grams were counted.
            batch.append((i, text[max(0, at - 2) : at + CHARS] if at else text[:CHARS]))
            size += len(batch[-1][1])
            if size >= CHARS or len(batch) >= TEXTS:
                _count(batch, out)
                batch, size = [], 0
    _count(batch, out)
    return out


def _count(batch: list[tuple[int, str]], out: np.ndarray) -> None:
    if not batch:
        return
    low = [t.lower() for _, t in batch]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(batch)), [len(t) + 1 for t in low])[: len(codes)]
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of the blanks after a letter
    codes, row, letter = np.where(letter, codes, 32)[keep], row[keep], letter[keep]
    if not letter.any():
        return
    local = np.zeros(len(batch) * DIM, np.int64)
    mixed = np.zeros(len(codes), np.int64)
    for n in (1, 2, 3):
        mixed = mixed[: len(codes) - n + 1] * 1_000_003 + codes[n - 1 :]
        same = row[: len(mixed)] == row[n - 1 :]
        if n == 1:
            same &= letter
        spread = (mixed[same].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        local += np.bincount(row[: len(mixed)][same] * DIM + spread.astype(np.int64), minlength=len(local))
    for (i, _), counts in zip(batch, local.reshape(-1, DIM)):
        out[i] += counts


def unit(counts: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(counts, axis=1, keepdims=True)
    return counts / np.where(length > 0, length, 1)


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss on labels -1, 1, classes weighted alike, by accelerated
    gradient descent; the last weight is the bias."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1.0 / (2 * ((np.square(x).sum(axis=1) + 1) * weight).sum() + penalty)
    w = ahead = np.zeros(x.shape[1] + 1)
    for t in range(steps):
        slack = weight * y * np.maximum(0, 1 - y * (x @ ahead[:-1].astype(x.dtype) + ahead[-1]))
        pull = np.append(slack.astype(x.dtype) @ x, slack.sum())
        new = ahead - step * (penalty * ahead - 2 * pull)
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


@dataclass
class LanguageModel:
    """``machines[(level, a, b)]``: weights and bias; positive for ``a``."""

    families: dict[str, list[str]]
    machines: dict[tuple[str, str, str], tuple[np.ndarray, float]]

    def _choose(self, level: str, names: list[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the index of the name with most duels won (then by margins, then by name) and
        its smallest margin."""
        if len(names) == 1:
            return np.zeros(len(x), int), np.full(len(x), np.inf)
        wins, least = np.zeros((len(x), len(names))), np.full((len(x), len(names)), np.inf)
        total = np.zeros_like(wins)
        for i, j in combinations(range(len(names)), 2):
            w, b = self.machines[(level, names[i], names[j])]
            margin = x @ w + b
            for k, m in ((i, margin), (j, -margin)):
                wins[:, k] += m > 0
                total[:, k] += m
                least[:, k] = np.minimum(least[:, k], m)
        best = np.argmax(wins * 1e6 + np.clip(total, -1e5, 1e5), axis=1)
        return best, least[np.arange(len(x)), best]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.families:
            return langs, scores
        x = unit(gram_counts(texts))
        known = np.flatnonzero(x.any(axis=1))
        names = sorted(self.families)
        family, sure = self._choose("family", names, x[known])
        for f, name in enumerate(names):
            rows = known[family == f]
            if not len(rows):
                continue
            members = self.families[name]
            lang, own = self._choose("language", members, x[rows])
            score = _sure(sure[family == f]) * _sure(own)
            for r, i, s in zip(rows, lang, score):
                langs[r], scores[r] = members[i], float(s)
        return langs, scores


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-2.0 * np.clip(margin, -30, 30)))


def train(
    df: DataFrame, key: str, text: str, lang: str, usable: Column, sample_rows: int = SAMPLE_ROWS
) -> LanguageModel:
    """Learn from at most ``sample_rows`` usable rows per language with a non-null text.

    Rows are taken by a hash of key and text: the share of each language that is expected to hold a
    little more than the bound, and in any case the row with the smallest hash, so that no language
    is lost; of these the first ones by hash. Families have as many rows as their languages together.
    The texts of the sample are dealt to one task per pair. More than ``MAX_LANGUAGES`` languages are
    an error.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(
        df[key].alias("_key"), df[text].cast("string").alias("_text"), df[lang].cast("string").alias("_lang"),
        usable.alias("_use"),
    ).where("_use AND _text IS NOT NULL AND _lang IS NOT NULL AND _key IS NOT NULL")
    rows = rows.withColumn("_h", F.xxhash64("_key", "_text"))
    found = rows.groupBy("_lang").agg(F.count("*").alias("n"), F.min("_h").alias("h")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"the column {lang!r} has more than {MAX_LANGUAGES} languages")
    counts = {r["_lang"]: r["n"] for r in found}
    if not counts:
        return LanguageModel({}, {})
    share = F.create_map(*[F.lit(v) for n, c in counts.items() for v in (n, min(1.0, (1.5 * sample_rows + 50) / c))])
    least = F.create_map(*[F.lit(v) for r in found for v in (r["_lang"], r["h"])])
    name, part = F.col("_lang"), F.pmod(F.col("_h"), F.lit(1_000_000)) / 1e6
    first = Window.partitionBy("_lang").orderBy("_h", "_key", "_text")
    sample = (
        rows.where((part < share[name]) | (F.col("_h") == least[name]))
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= sample_rows)
        .select("_lang", "_text")
    )
    families: dict[str, list[str]] = {}
    for name in sorted(counts):
        families.setdefault(FAMILY_OF.get(name, name), []).append(name)
    duels = [("family", a, b, x, s) for a, b in combinations(sorted(families), 2)
             for s, f in ((1, a), (-1, b)) for x in families[f]]
    duels += [("language", a, b, x, s) for f in families.values() for a, b in combinations(f, 2)
              for s, x in ((1, a), (-1, b))]
    if not duels:
        return LanguageModel(families, {})
    wanted = spark.createDataFrame(duels, "level string, a string, b string, _lang string, side int")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        w, b = train_svm(unit(gram_counts(rows["_text"].tolist())), rows["side"].to_numpy(np.float64))
        head = rows[["level", "a", "b"]].iloc[:1]
        return head.assign(weights=[w.astype("<f8").tobytes()], bias=[b])

    schema = "level string, a string, b string, weights binary, bias double"
    fitted = sample.join(F.broadcast(wanted), "_lang").groupBy("level", "a", "b").applyInPandas(fit, schema)
    machines = {(r.level, r.a, r.b): (np.frombuffer(r.weights, "<f8"), r.bias) for r in fitted.collect()}
    missing = {d[:3] for d in duels} - set(machines)
    if missing:
        raise RuntimeError(f"no rows to learn from for {sorted(missing)}")
    return LanguageModel(families, machines)


def predictions(model: LanguageModel, text: Column) -> Column:
    """``struct<lang_pred, score>`` of whole texts; ``und`` and 0 for null or without letters."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            whole = [t or "" for t in texts]
            langs, scores = [], []
            for at in range(0, len(whole), TEXTS):
                found = model.predict(whole[at : at + TEXTS])
                langs += found[0]
                scores += found[1]
            yield pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float)})
        give_back()

    return predict(text)


def held_out(key: Column) -> Column:
    """True for the quarter of the keys that no machine learns from; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(
    df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Per row ``<key>, held_out, lang_pred, score``.

    Machines learn only from the texts and non-null languages of rows that are not held out; no
    language, source or key is an input of a prediction. A text that is null or has no letter is
    ``und`` with score 0, as is every text if nothing could be learned; with one learned language
    every text with letters has it. Rows are kept one to one (repeated rows and null keys too; a
    null key is never learned from); an empty table gives no rows; other columns are not read.
    """
    model = train(df, key, text, lang, ~held_out(df[key]), sample_rows)
    return df.select(
        df[key], held_out(df[key]).alias("held_out"), predictions(model, df[text].cast("string")).alias("_p")
    ).select(key, "held_out", "_p.lang_pred", "_p.score")
