"""Binary hashed fingerprints of structure strings, as sorted arrays of set bits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .scalars import bind, hash_to_int

# Bytes of texts whose grams are hashed at once, and grams that are in one step.
TEXT_BYTES, TILE_GRAMS = 1 << 20, 1 << 15
# md5 (RFC 1321): constants and rotations of the rounds; a message up to this length is one block.
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
ONE_BLOCK = 55


def tokens(structure: Column, unit: str = "char", class_map: tuple[str, str] | None = None) -> Column:
    """Split into characters, or into words; ``class_map`` first folds characters to classes."""
    if class_map:
        structure = F.translate(structure, *class_map)
    if unit == "char":
        return F.when(structure == "", F.array().cast("array<string>")).otherwise(
            F.split(structure, "")
        )
    if unit == "word":
        return F.filter(F.split(structure, r"\s+"), lambda t: t != "")
    raise ValueError(f"unknown unit {unit!r}")


def qgram_fingerprint(
    structure: Column,
    q: int = 4,
    n_bits: int = 1024,
    unit: str = "char",
    class_map: tuple[str, str] | None = None,
    hashes_per_feature: int = 1,
) -> Column:
    """q-gram fingerprint (LINGO, Vidal et al. 2005): every window of ``q`` tokens sets bits.

    A string shorter than ``q`` tokens is one feature. The hash is md5, so any engine can repeat
    it. Linear in the text: tokens are split once and windows are array slices.
    """
    if not 1 <= hashes_per_feature <= 4:
        raise ValueError("md5 gives up to four 32-bit hashes per feature")
    joint = "" if unit == "char" else " "

    def grams(toks: Column) -> Column:
        return F.when(F.size(toks) == 0, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(toks) - (q - 1), F.lit(1))),
                lambda i: F.md5(F.array_join(F.slice(toks, i, q), joint)),
            )
        )

    def positions(hashed: Column, start: int) -> Column:
        return F.transform(hashed, lambda h: (hash_to_int(h, start) % F.lit(n_bits)).cast("int"))

    def bits(hashed: Column) -> Column:
        parts = [positions(hashed, 1 + 8 * k) for k in range(hashes_per_feature)]
        return F.sort_array(F.array_distinct(parts[0] if len(parts) == 1 else F.concat(*parts)))

    return bind(tokens(structure, unit, class_map), lambda t: bind(grams(t), bits))


def word_gram_bits(text: Column, q: int, n_bits: int) -> Column:
    """The same as ``qgram_fingerprint`` of words, for long texts: in Arrow batches, the grams of many texts
    hashed at once. A null text has one bit that is null."""

    @F.pandas_udf("array<int>")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([b for part in _parts(texts) for b in word_grams(part, q, n_bits)], dtype=object)

    return bits(text)


def _parts(texts: Sequence[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= TEXT_BYTES:
            yield part
            part, size = [], 0
    yield part


def word_grams(texts: list[str | None], q: int, n_bits: int) -> list:
    """Sorted bits of the word q-grams of every text."""
    # The blanks of bytes are those of Java's \s; with one blank between words, a gram is a piece of the text.
    words = [(t or "").encode().split() for t in texts]
    whole = b" ".join(w for ws in words for w in ws)
    sizes = np.fromiter((len(w) for ws in words for w in ws), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = np.array([len(ws) for ws in words], np.int64)
    grams = np.where(n, np.maximum(n - q + 1, 1), 0)
    owner = np.repeat(np.arange(len(words)), grams)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
    first = (np.cumsum(n) - n)[owner] + nth
    last = first + np.minimum(n[owner], q) - 1
    keys = owner << 32 | md5_heads(whole, starts[first], ends[last] - starts[first]).astype(np.int64) % n_bits
    keys = np.sort(keys)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    cuts = np.searchsorted(keys >> 32, np.arange(1, len(words)))
    found = np.split((keys & 0xFFFFFFFF).astype(np.int32), cuts) if words else []
    return [[None] if t is None else f for t, f in zip(texts, found)]


def md5_heads(whole: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of pieces of ``whole``, as ``uint32``: the rounds are done for many pieces
    at once; longer pieces than one block are hashed one by one."""
    out = np.empty(len(starts), np.uint32)
    padded = np.frombuffer(whole + bytes(64), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(padded, 64)
    # What stays of a block and what is put behind it, for each size: a bit, and the size in bits at the end.
    size, place = np.arange(ONE_BLOCK + 1)[:, None], np.arange(64)[None, :]
    kept = np.where(place < size, 255, 0).astype(np.uint8).view(np.uint64)
    ends = np.select([place == size, place == 56, place == 57], [0x80, size * 8 & 255, size * 8 >> 8], 0)
    ends = ends.astype(np.uint8).view(np.uint64)
    short = np.flatnonzero(sizes <= ONE_BLOCK)
    for at in range(0, len(short), TILE_GRAMS):
        some = short[at : at + TILE_GRAMS]
        size = sizes[some]
        block = windows[starts[some]].view(np.uint64) & kept[size] | ends[size]
        out[some] = _md5_rounds(np.ascontiguousarray(block.view("<u4").T)).byteswap()
    for i in np.flatnonzero(sizes > ONE_BLOCK):
        out[i] = int.from_bytes(md5(whole[starts[i] : starts[i] + sizes[i]]).digest()[:4], "big")
    return out


def _md5_rounds(block: np.ndarray) -> np.ndarray:
    """The first word of the md5 of messages of one block: ``block`` has a row per word, a column per message."""
    start = 0x67452301
    a, b, c, d = (np.full(block.shape[1], x, np.uint32) for x in (start, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, high = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        kind = i // 16
        if kind < 2:  # d ^ (b & (c ^ d)), c ^ (d & (b ^ c))
            x, y, z = (b, c, d) if kind == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = (i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16
        np.add(f, a, out=f)
        np.add(f, block[word], out=f)
        np.add(f, np.uint32(_SINES[i]), out=f)
        turn = _TURNS[kind][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=high)
        np.left_shift(f, np.uint32(turn), out=f)
        np.bitwise_or(f, high, out=f)
        np.add(f, b, out=a)  # a is free now and becomes the new b
        a, b, c, d = d, a, b, c
    return a + np.uint32(start)


def bits_from_array(vector: Column) -> Column:
    """Positions of the non-zero entries of a 0/1 row."""
    return F.filter(
        F.transform(vector, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull()
    )


def sign_bits(vector: Column) -> Column:
    """Positions of the positive entries of a numeric vector."""
    return F.filter(F.transform(vector, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def string_descriptors(structure: Column) -> Column:
    """Dense numeric descriptors of a string.

    Order: length, letters, upper-case letters, digits, whitespace, other characters, words,
    mean word length.
    """

    def count(pattern: str) -> Column:
        return F.length(structure) - F.length(F.regexp_replace(structure, pattern, ""))

    words = F.size(tokens(structure, "word"))
    spaces = count(r"\s")
    letters = count("[A-Za-z]")
    digits = count("[0-9]")
    length = F.length(structure)
    values = [
        length,
        letters,
        count("[A-Z]"),
        digits,
        spaces,
        length - letters - digits - spaces,
        words,
        F.when(words > 0, (length - spaces) / words),
    ]
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


def smiles_normalised(structure: Column) -> Column:
    return F.trim(structure)


def smiles_well_formed(structure: Column) -> Column:
    """Lexical check of a SMILES string: known tokens, balanced branches, paired ring labels.

    Not a chemistry check (valence, aromaticity); a toolkit can be plugged in as the ``valid``
    expression of ``validate_key``.
    """
    # The token alphabet of the SMILES notation.
    token = (
        r"\[[^\[\]]+\]|Br|Cl|B|C|N|O|P|S|F|I|b|c|n|o|p|s|\*"
        r"|\(|\)|\.|=|#|-|\+|\$|:|/|\\|~|@|%[0-9]{2}|[0-9]"
    )
    bare = F.regexp_replace(structure, r"\[[^\[\]]*\]", "*")
    rings = F.regexp_extract_all(bare, F.lit(r"(%[0-9]{2}|[0-9])"), F.lit(1))
    depths = F.aggregate(
        F.filter(F.split(bare, ""), lambda c: c.isin("(", ")")),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")),
        lambda acc, c: bind(
            acc["depth"] + F.when(c == "(", 1).otherwise(-1),
            lambda d: F.struct(d.alias("depth"), F.least(acc["lowest"], d).alias("lowest")),
        ),
    )
    return F.coalesce(
        (F.length(structure) > 0)
        & (F.regexp_replace(structure, token, "") == "")
        & bind(depths, lambda d: (d["depth"] == 0) & (d["lowest"] == 0))
        & bind(
            rings,
            lambda r: F.forall(
                F.array_distinct(r), lambda k: F.size(F.filter(r, lambda x: x == k)) % 2 == 0
            ),
        ),
        F.lit(False),
    )
