"""Problem 9: pieces of oversized documents, cut at natural boundaries, with overlap.

Method: a recursive hierarchy of separators.  A text is split into sections (at
empty lines and headings), what is still too large into paragraphs (lines), then sentences
(the chain model of problem 3), words and at last characters; the leaves are
packed greedily up to the limit, and each further piece starts with a trailing
part of the one before.

Sizes are tokens of a public tokenizer.  A text is encoded once; the places of
its tokens give the size between any two places, and every piece made is
encoded again and shortened if it should not fit (tokens can differ where a
text is cut).  A document is one task's work, its text is never cut short.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseloom.session import spread

from . import codepoints as C
from . import sentences as S
from . import tokens as K
from .batches import slices

LEVELS = ("section", "paragraph", "sentence", "word", "character")
#: Sections end at empty lines and before headings (marked with #, numbered as parts or chapters, or by Roman numbers).
_SECTION = re.compile(r"\n[^\S\n]*\n\s*|\n(?=#{1,6}\s|第[一二三四五六七八九十百零〇\d]+[章节節编編部]|[IVX]+\.\s)")
_LINE = re.compile(r"\n\s*")
#: Words end at blanks, behind punctuation and, in Japanese, where kana give way to ideographs.
_WORD = re.compile(r"\s+|(?<=[^\w\s])(?=\w)|(?<=[\u3041-\u30ff])(?=[\u4e00-\u9fff])", re.UNICODE)


class _Sized:
    """A text with the number of tokens up to each character."""

    def __init__(self, text: str, tokens: list[int], encode, byte_length: np.ndarray) -> None:
        ids = np.asarray(tokens, np.int64)
        ends = np.cumsum(byte_length[ids]) if len(ids) else np.zeros(0, np.int64)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        start = np.concatenate(([0], np.cumsum(width)))
        self.text, self.encode = text, encode
        #: Tokens that end at or before each place, and those that begin before it.
        self.done = np.searchsorted(ends, start, side="right").tolist()
        self.begun = np.searchsorted(np.concatenate(([0], ends[:-1])) if len(ends) else ends, start, side="left").tolist()
        self.total = len(ids)

    def between(self, a: int, b: int) -> int:
        """Tokens that touch the characters from a to b (an upper estimate of what the piece alone takes)."""
        return self.begun[b] - self.done[a]

    def exact(self, a: int, b: int) -> int:
        return len(self.encode(self.text[a:b]))


def _sentence_places(text: str, a: int, b: int, model: S.Model) -> list[int]:
    cp, off = C.from_arrow(pa.array([text[a:b]], pa.string()))
    _, start, _ = S.units(cp, off, model)
    return [a + int(x) for x in start]


def _cuts(text: str, a: int, b: int, level: int, model: S.Model) -> list[int]:
    """Inner places of [a, b) where a separator of the level ends (the next part begins there)."""
    if level == 0:
        places = [m.end() for m in _SECTION.finditer(text, a, b)]
    elif level == 1:
        places = [m.end() for m in _LINE.finditer(text, a, b)]
    elif level == 2:
        places = _sentence_places(text, a, b, model)
    elif level == 3:
        places = [m.end() for m in _WORD.finditer(text, a, b)]
    else:
        places = list(range(a + 1, b))
    return [x for x in dict.fromkeys(places) if a < x < b]


def leaves(sized: _Sized, room: int, model: S.Model) -> tuple[list[int], list[int]]:
    """(places, levels): ends of the leaves, each leaf of at most ``room`` tokens, and the level of the separator at each end."""
    places: list[int] = []
    levels: list[int] = []

    def split(a: int, b: int, level: int, outer: int) -> None:
        if b <= a:
            return
        if sized.between(a, b) <= room or level == len(LEVELS) or b - a == 1:
            places.append(b)
            levels.append(outer)
            return
        if level == len(LEVELS) - 1:
            # Characters: as many as fit, found by bisection instead of one leaf a character.
            while a < b:
                low, high = a + 1, b
                while low < high:
                    middle = (low + high + 1) // 2
                    low, high = (middle, high) if sized.between(a, middle) <= room else (low, middle - 1)
                places.append(low)
                levels.append(level if low < b else outer)
                a = low
            return
        edges = _cuts(sized.text, a, b, level, model)
        for x, y in zip([a, *edges], [*edges, b]):
            split(x, y, level + 1, level if y < b else outer)

    split(0, len(sized.text), 0, 0)
    return places, levels


def pieces(text: str, limit: int, overlap: int, path: str, model: S.Model, encoded: list[int] | None = None) -> list[tuple[int, int, int, int, str]]:
    """(start, end, tokens, shared characters with the piece before, level of the cut at the end) of every piece.

    Pieces cover the text; a text within the limit is one piece.  ``encoded``
    are the text's tokens where they are known already.
    """
    encode = K.encoding(path).encode_ordinary
    sized = _Sized(text, encode(text) if encoded is None else encoded, encode, _byte_lengths(path))
    n = len(text)
    if sized.total <= limit:
        return [(0, n, sized.total, 0, "end")] if n else []
    ends, levels = leaves(sized, max(1, limit - overlap - 8), model)
    of = dict(zip(ends, levels))
    out = []
    covered, last = 0, 0
    while covered < n:
        start = covered
        if covered and overlap > 0:
            # The earliest leaf, else word, else character that keeps the overlap within its bound.
            low = bisect_left(ends, last + 1)
            inner = [x for x in ends[low : bisect_left(ends, covered)] if sized.between(x, covered) <= overlap]
            if not inner:
                back = max(last + 1, covered - 8 * overlap)
                inner = [x for x in _cuts(sized.text, back, covered, 3, model) if sized.between(x, covered) <= overlap]
            if not inner:
                inner = [x for x in range(max(last + 1, covered - overlap), covered) if sized.between(x, covered) <= overlap]
            start = inner[0] if inner else covered
        # Greedy: the farthest leaf end that still fits.
        first = bisect_right(ends, covered)
        low, high = first, len(ends) - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sized.between(start, ends[middle]) <= limit else (low, middle - 1)
        end = ends[low]
        size = sized.exact(start, end)
        while size > limit:
            if low > first:
                low -= 1
                end = ends[low]
            elif start < covered:
                start = covered
            else:  # a leaf alone that grew when cut off
                end = start + max(1, (end - start) * limit // (size + 1))
            size = sized.exact(start, end)
        out.append((start, end, size, covered - start, "end" if end == n else LEVELS[of.get(end, 4)]))
        last, covered = start, end
    return out


_BYTES: dict[str, np.ndarray] = {}


def _byte_lengths(path: str) -> np.ndarray:
    """Bytes of every token."""
    if path not in _BYTES:
        ranks = K.encoding(path)._mergeable_ranks
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _BYTES[path] = sizes
    return _BYTES[path]


def oversized(df: DataFrame, key: str, text: str, limit: int = 1500, tokenizer: str = K.DEFAULT) -> DataFrame:
    """(key, n_tokens) of the documents of more than ``limit`` tokens."""
    return K.with_token_counts(df.select(key, text), text, tokenizer=tokenizer).where(f"n_tokens > {int(limit)}")


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 1500, overlap: int = 100, tokenizer: str = K.DEFAULT, model: S.Model | None = None) -> DataFrame:
    """One row for each piece of each document of more than ``limit`` tokens.

    (key, piece_no from 1, start_pos, end_pos, n_tokens, overlap_chars, cut_at, piece).
    Null, empty and small texts give no piece.
    """
    if overlap < 0 or overlap * 2 > limit:
        raise ValueError("the overlap may be at most half the limit")
    path = K.path_of(tokenizer)
    model = model or S.listed_model()
    kind = df.schema[key].dataType.simpleString()
    names = [key, "piece_no", "start_pos", "end_pos", "n_tokens", "overlap_chars", "cut_at", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = K.encoding(path).encode_ordinary
        for whole in batches:
            for batch in slices(whole, text):
                rows, at = [], []
                for i, x in enumerate(batch.column(text).to_pylist()):
                    encoded = encode(x) if x and len(x.encode()) > limit else []
                    if len(encoded) > limit:
                        made = pieces(x, limit, overlap, path, model, encoded)
                        rows += [(k, a, b, size, o, cut, x[a:b]) for k, (a, b, size, o, cut) in enumerate(made, 1)]
                        at += [i] * len(made)
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), *columns], names=names)

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, piece_no int, start_pos bigint, end_pos bigint, n_tokens bigint, overlap_chars bigint, cut_at string, piece string")
