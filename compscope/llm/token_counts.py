"""Token counts of whole texts under a byte-level BPE vocabulary, by the whole-token shortcut.

Offline, every vocabulary string is put through the merge rules on its own: those that come back
as one token are *whole*. A pre-token that is a whole string is counted (or encoded) by one lookup;
only the other pre-tokens are merged. The proof covers the whole vocabulary and is made once per
worker process from the tokenizer's own file.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, give_back, text_of

# The pre-token pattern of byte-level BPE, as the vocabulary's licence page gives it.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Memo entries a worker keeps for stretches of text between spaces (some 150 bytes each); full, the
# memo starts anew.
MEMO = 1_000_000
# Longer stretches are not kept.
MEMO_CHARS = 64


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 on, in byte order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


class ByteBpe:
    """Encoder for one tokenizer file; ids equal those of the tokenizer library without added
    tokens, special strings inside a text being its special ids."""

    def __init__(self, path: str, fast: bool = True) -> None:
        """``fast=False`` always follows the merge rules themselves."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without prefix space is needed")
        if spec["normalizer"] or model["dropout"] or model["ignore_merges"]:
            raise ValueError("normalizers, dropout and ignored merges are not handled")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = byte_alphabet()
        self.pretoken = regex.compile(PRETOKEN)
        # A space is followed by a character that is not white space: a pre-token starts there.
        self.odd_space = re.compile(r" (?=\s|\Z)")
        self.memo: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.whole: dict[str, int] = {}
        self.merge_bytes = self._by_rules
        self._prove_whole(fast)

    def _prove_whole(self, fast: bool) -> None:
        """Find the vocabulary strings, as text, that the merge rules alone turn into one token.

        If that holds for all of them, and ids follow the order of the rules, then joining
        whatever neighbours form a vocabulary string, lowest id first, is the same as following
        the rules: when such neighbours meet, the stretch they cover has been merged as it is
        alone, where only its own rule is left. The faster merger that works so is then taken.
        """
        back = {c: b for b, c in enumerate(self.letters)}
        proven = 0
        for piece, i in self.vocab.items():
            if self._merge(piece) != [i]:
                continue
            proven += 1
            try:
                self.whole[bytes(back[c] for c in piece).decode("utf-8")] = i
            except UnicodeDecodeError:
                continue  # part of a character: no pre-token is equal to it
        self.marks = {
            c: array("I", (self.whole[c],)).tobytes() for c in punctuation if c in self.whole
        }
        ordered = [self.vocab["".join(p)] for p in self.rank]
        if fast and proven == len(self.vocab) and ordered == sorted(ordered):
            ranks = {bytes(back[c] for c in p): i for p, i in self.vocab.items()}
            merger = tiktoken.Encoding(
                "pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}
            )
            self.merge_bytes = merger.encode_ordinary
            self.rank, self.vocab = {}, {}  # not needed any more

    def _by_rules(self, piece: str) -> list[int]:
        letters = self.letters
        return self._merge("".join([letters[b] for b in piece.encode("utf-8")]))

    def _merge(self, piece: str) -> list[int]:
        """Apply the merge rules to one pre-token in byte letters, lowest rank first."""
        parts, rank = list(piece), self.rank
        while len(parts) > 1:
            ranks = [rank.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 30:
                break
            out, i, n = [], 0, len(parts)
            while i < n:
                if i < n - 1 and ranks[i] == low:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        vocab = self.vocab
        return [vocab[p] for p in parts]

    def _stretch(self, text: str) -> bytes:
        """Ids of a stretch that starts and ends at pre-token boundaries, as uint32 bytes."""
        ids: list[int] = []
        for piece in self.pretoken.findall(text):
            i = self.whole.get(piece)
            if i is not None:
                ids.append(i)
            else:
                ids.extend(self.merge_bytes(piece))
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a space and the word after it, up to the next space."""
        if word.isalpha():
            piece = " " + word  # letters alone are one pre-token
            i = self.whole.get(piece)
            ids = array("I", self.merge_bytes(piece) if i is None else (i,)).tobytes()
        else:
            end, head = self.marks.get(word[-1:]), word[:-1]
            if end is not None and head.isalpha():  # and a mark behind them is another
                return (self.memo.get(head) or self._word(head)) + end
            ids = self._stretch(" " + word)
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if self.odd_space.search(text):
            return self._stretch(text)
        first, *rest = text.split(" ")
        known, word = self.memo.get, self._word
        return self._stretch(first) + b"".join([known(w) or word(w) for w in rest])

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian uint32."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            elif part:
                out.append(self._plain(part))
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")

    def count(self, text: str) -> int:
        return len(self.encode_bytes(text)) // 4


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def id_type(path: str) -> str:
    """The narrowest unsigned type, of two or four bytes, that holds all ids of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]])
    return "<u2" if most < 1 << 16 else "<u4"


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file on this machine; every executor has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 512,
) -> DataFrame:
    """Per row ``<key>, n_bytes, n_tokens, over_limit`` for whole texts.

    A null text counts as empty (0 bytes, 0 tokens). Rows are kept one to one: repeated rows and
    null keys give a row each, an empty table gives none. Other columns are not read, so their
    names cannot clash. One pass without a shuffle; a worker holds one bounded batch of texts.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("bigint")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = byte_bpe(vocabulary(tokenizer))
        for texts in batches:
            yield pd.Series([bpe.count(t) for t in texts], dtype="int64")
        give_back()

    counted = text_of(df, key, text).select(
        F.col("_key").alias(key),
        F.octet_length("_text").cast("bigint").alias("n_bytes"),
        n_tokens("_text").alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
