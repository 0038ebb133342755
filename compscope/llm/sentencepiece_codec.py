"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search goes over the normalised text once. It keeps, for each position of a window, the best
last piece and where that piece began; only positions within the longest piece's reach can still be
extended. Whenever the backpointer paths of all of them run through one boundary, the ids before it
are final: they are given out and forgotten. In a unigram model the best path has the largest sum of
scores; in a BPE model a path survives if every two neighbouring pieces are what the merge rules
leave of their two strings, which exactly one path does, and it is the encoding. Where no piece of
the vocabulary holds two characters in a row, all paths meet between them; texts are cut there
first, and the encodings of recent stretches are kept.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, give_back, text_of
from .token_counts import vocabulary

# Stretches whose ids a worker keeps (some 200 bytes each); full, the memo starts anew.
MEMO = 1_000_000
# Pairs of pieces whose answer it keeps.
PAIRS = 300_000
MEMO_CHARS = 64
SPACE = "▁"
# A character without a piece of its own costs this much more than the rarest piece.
UNKNOWN_PENALTY = 10.0


class Codec:
    """Encoder and decoder of one model; ``unigram`` says how its scores are meant."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, unigram: bool) -> None:
        self.unigram = unigram
        self.normalise = model.normalize
        size = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in size]
        self.bytes = {i: int(self.pieces[i][3:-1], 16) for i in size if model.is_byte(i)}
        self.of_byte = {b: i for i, b in self.bytes.items()}
        self.control = {i for i in size if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.unknown = model.unk_id()
        # What an id stands for, where it is a text of its own: a byte from 128 on is part of a character.
        self.apart = np.zeros(len(size), bool)
        self.apart[[i for i, b in self.bytes.items() if b > 127]] = True
        self.shown = ["" if i in self.control else chr(self.bytes[i]) if i in self.bytes else self.pieces[i] for i in size]
        plain = [i for i in size if i not in self.bytes and i not in self.control]
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        self.longest = max(map(len, self.score))
        self.floor = min(self.score.values()) - UNKNOWN_PENALTY
        inner = self.inner = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        # All paths meet in front of a space mark behind another character if no piece spans that.
        meets = all(pair[0] == SPACE for pair in inner if pair[1] == SPACE)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if meets else r"(?s:.+)")
        self.memo: dict[str, bytes] = {}  # ids as uint32
        self.pairs: dict[tuple[str, str], bool] = {}
        self.stable = {p for p in self.score if unigram or self.merge(p) == [p]}
        # The longest piece of three characters or more by its last three.
        self.back: dict[str, int] = {}
        for p in self.stable:
            if len(p) > 2:
                self.back[p[-3:]] = max(self.back.get(p[-3:], 0), len(p))

    def merge(self, text: str) -> list[str]:
        """What the merge rules leave of a string: the best-scored neighbours are joined first, the
        leftmost ones of equal score."""
        parts, score, none = list(text), self.score.get, -math.inf
        joined = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while joined:
            best = max(joined)
            if best == none:
                break
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i:
                joined[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(joined):
                joined[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def neighbours(self, a: str, b: str) -> bool:
        """Whether the merge rules leave these two pieces of their two strings."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[(a, b)] = self.merge(a + b) == [a, b]
        return known

    def search(self, text: str) -> Iterator[list[str]]:
        """Pieces of ``text`` in runs, each given out as soon as it is final."""
        # From the last boundary given out on: score, start and piece of the best path to a position.
        stable, score, reach, unigram, back = self.stable, self.score, self.longest, self.unigram, self.back
        done = 0
        best: dict[int, tuple[float, int, str]] = {0: (0.0, 0, "")}
        for end in range(1, len(text) + 1):
            chosen = None
            far = end - back.get(text[end - 3 : end], 2) if end > 2 else 0
            for start in range(far if far > done else done, end):
                before = best.get(start)
                if before is None:
                    continue
                piece = text[start:end]
                if piece not in stable and end - start > 1:
                    continue
                if unigram:
                    total = before[0] + score.get(piece, self.floor)
                    if chosen is None or total > chosen[0]:
                        chosen = (total, start, piece)
                elif not before[2] or self.neighbours(before[2], piece):
                    chosen = (0.0, start, piece)
                    break  # only one path survives
            if chosen is not None:
                best[end] = chosen
            if end - done >= 2 * reach or end == len(text):
                boundary = end if end == len(text) else self._meeting(best, end, done)
                if boundary > done:
                    run, at = [], boundary
                    while at > done:
                        run.append(best[at][2])
                        at = best[at][1]
                    run.reverse()
                    best = {p: kept for p, kept in best.items() if p >= boundary}
                    done = boundary
                    yield run

    def _within_window(self, text: str) -> list[str]:
        """The same search in a BPE model for a text that is no longer than the window: nothing is
        given out before its end."""
        stable, back, pairs, neighbours = self.stable, self.back, self.pairs, self.neighbours
        starts, lasts = [0], [""]  # of the path to each position; -1: no path
        for end in range(1, len(text) + 1):
            far = end - back.get(text[end - 3 : end], 2) if end > 2 else 0
            for start in range(far if far > 0 else 0, end):
                if starts[start] < 0:
                    continue
                piece = text[start:end]
                if piece in stable or end - start == 1:
                    if start:
                        known = pairs.get((lasts[start], piece))
                        if not (neighbours(lasts[start], piece) if known is None else known):
                            continue
                    starts.append(start)
                    lasts.append(piece)
                    break
            else:
                starts.append(-1)
                lasts.append("")
        run, at = [], len(text)
        while at:
            run.append(lasts[at])
            at = starts[at]
        run.reverse()
        return run

    def _meeting(self, best: dict[int, tuple[float, int, str]], end: int, done: int) -> int:
        """The last boundary that the paths of all positions which can be extended run through."""
        fronts = {p for p in range(end - self.longest + 1, end + 1) if p in best}
        while len(fronts) > 1:
            last = max(fronts)
            fronts.remove(last)
            fronts.add(best[last][1] if last > done else done)
        return max(fronts.pop(), done) if fronts else done

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian uint32."""
        known, stretch = self.memo.get, self._stretch
        return b"".join([known(part) or stretch(part) for part in self.cut.findall(self.normalise(text))])

    def _stretch(self, part: str) -> bytes:
        """Ids of a stretch; all paths meet wherever no piece holds two neighbouring characters."""
        inner = self.inner
        cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in inner]
        if cuts:
            ids = b"".join([
                self.memo.get(part[a:b]) or self._found(part[a:b]) for a, b in zip([0, *cuts], [*cuts, len(part)])
            ])
            self._keep(part, ids)
            return ids
        return self._found(part)

    def _found(self, part: str) -> bytes:
        """Ids of a stretch that is not cut further, by the search."""
        if len(part) == 1:
            ids = self._ids(part)
        elif len(part) <= self.longest and not self.unigram:
            get = self.id.get
            ids = []
            for piece in self._within_window(part):
                i = get(piece)
                if i is None:
                    ids += self._ids(piece)
                else:
                    ids.append(i)
        else:
            ids = [i for run in self.search(part) for piece in run for i in self._ids(piece)]
        packed = array("I", ids).tobytes()
        self._keep(part, packed)
        return packed

    def _keep(self, part: str, ids: bytes) -> None:
        if len(part) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[part] = ids

    def _ids(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        if i is not None:
            return [i]
        if self.of_byte:
            return [self.of_byte[b] for b in piece.encode("utf-8")]
        return [self.unknown]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of ids: byte pieces are joined to characters (invalid ones become U+FFFD), control
        ids are left out, and the space mark that encoding puts in front is taken off."""
        ids = np.asarray(ids, dtype=np.int64)
        whole = not self.apart[ids].any()
        ids = ids.tolist()
        if whole:
            return "".join(map(self.shown.__getitem__, ids)).removeprefix(SPACE).replace(SPACE, " ")
        out, raw = [], bytearray()
        for i in ids:
            b = self.bytes.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.control:
                out.append(self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).removeprefix(SPACE).replace(SPACE, " ")


@lru_cache(maxsize=2)
def codec(path: str, unigram: bool = False) -> Codec:
    return Codec(sentencepiece.SentencePieceProcessor(model_file=path), unigram)


def encode_texts(
    df: DataFrame, key: str = "doc_id", text: str = "text", model: str = "piece_bpe_32k.model", unigram: bool = False
) -> DataFrame:
    """Per row ``<key>, ids array<int>, n_ids, ids_crc32, round_trip``: the ids of the whole text,
    the CRC of them as little-endian uint32, and whether decoding gives the text back.

    A null text is empty and has no ids. Rows are kept one to one, whatever their key; an empty
    table gives no rows; other columns are not read. One pass without a shuffle. ``round_trip`` is
    false where normalisation changed the text (or the text itself has the space mark U+2581).
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("ids array<int>, ids_crc32 bigint, round_trip boolean")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sp = codec(vocabulary(model), unigram)
        for texts in batches:
            packed = [sp.encode_bytes(t) for t in texts]
            ids = [np.frombuffer(i, "<u4") for i in packed]
            yield pd.DataFrame(
                {
                    "ids": [i.view("<i4") for i in ids],
                    "ids_crc32": [zlib.crc32(i) for i in packed],
                    "round_trip": [sp.decode(i) == t for i, t in zip(ids, texts)],
                }
            )
        give_back()

    out = text_of(df, key, text).select(F.col("_key").alias(key), encoded("_text").alias("_e"))
    return out.select(key, "_e.ids", F.size("_e.ids").alias("n_ids"), "_e.ids_crc32", "_e.round_trip")


def decode_ids(df: DataFrame, key: str, ids: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Per row ``<key>, text``; null ids give a null text, no ids the empty text."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = codec(vocabulary(model))
        for rows in batches:
            yield pd.Series([None if r is None else sp.decode(list(r)) for r in rows], dtype=object)
        give_back()

    return df.select(df[key], decoded(df[ids]).alias("text"))
