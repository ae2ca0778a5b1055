"""Problem 3: sentence units of every text, with their places in the stored text.

Method: a linear-chain model tags every candidate character as boundary or
inside and Viterbi decoding picks the best tagging of the whole text.
Candidates are the closing marks, points, closing quotes, line breaks and, in
Thai, blanks; all other characters can only be inside and need no step.
A candidate's emission is the sum of learned weights of its features (context
class, neighbours, the word before it and the one behind it, for Thai the
characters and the length of the chunk before the blank); learned 2x2
transitions join neighbouring candidates, and a boundary without ink since the
last one is forbidden, so that of a run of marks the last one closes the unit.
Word lists only choose the context class, whose weight is learned like any
other; an untrained model knows nothing but the sign that class suggests
(``HINT``).  Fixed are the definitions: line breaks end units, marks inside
brackets and quotation marks don't.

Training (``train``) needs no tagged text.  It takes a bounded sample and
strips its line breaks: a place where a line ended is known to be a boundary,
any other boundary lost no break, so a candidate keeps its line end with
probability ``c x P(boundary)``, where c is measured on closing marks that
always end a unit.  Points before a small letter, comma or digit are known to
be inside.  Weights maximise that likelihood under a Gaussian prior; a word
that stands before a point time and again but never at a line end thereby
becomes an abbreviation, and Thai, which has no marks at all, is trained on
nothing but stripped line ends.  Transitions are what the line ends behind
either tag of the candidate before add to that.

Everything runs on code-point arrays of many texts at once; the decoder steps
through the candidates of all texts side by side.  Invisible characters are
looked through, offsets are those of the stored text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseloom.session import spread

from . import codepoints as C
from .batches import slices
from . import regular as R
from .regular import INVISIBLE
from .shingles import mix

# ---- fixed values -----------------------------------------------------------
#: Abbreviations that stand before what they belong to and close no unit.
LEADING = """Mr Mrs Ms Dr Prof St Rev Hon Gen Col Sgt Capt Lt No Nos vol vols p pp para paras art arts sec ch fig approx ca v vs cf see e.g i.e viz
Hr Fr Nr Abs Art Bd S vgl z.B z d.h u.a ggf bzw Ziff Rn Az Str
M MM Mme Mlle Me al env t n pp éd
г гг ст п пп ул д т л см р с стр тел им пр гл т.е напр руб тыс млн млрд обл гр
सं पृ रु डॉ श्री प्रो कृ""".split()
#: Abbreviations that can close a unit if a new sentence starts behind them.
TRAILING = "etc usw usf Inc Co Ltd Corp Jr Sr a.m p.m т.д т.п др проч коп bzgl ff et.al".split()
#: Month names that follow a German ordinal day.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()
#: Words before a German ordinal.
BEFORE_ORDINAL = "am vom zum den dem der des die im seit bis ab".split()
#: Thai titles before a person's name, and a word that ends like one.
THAI_TITLES = "นาย นาง นางสาว เด็กชาย เด็กหญิง ด.ช. ด.ญ. น.ส. ดร.".split()
THAI_NO_TITLES = "ทนาย ขุนนาง".split()
CLOSING = "!?。！？｡؟۔।॥‼⁇⁈⁉።"
POINTS = ".．"
OPEN_BRACKETS, CLOSE_BRACKETS = "(（[［【〔〈《", ")）]］】〕〉》"
OPEN_QUOTES, CLOSE_QUOTES = "«「『‹", "»」』›”"
COMMAS, COLONS, DASHES = ",，、،", ":：", "-–—―"
#: Particles and conjunctions with which a sentence goes on behind a quotation (Japanese, Chinese).
PARTICLES = "とってのはがをにも的"
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
#: Context classes of candidates, and what each suggests before any training: a closing sign closes unless the text
#: visibly goes on behind it.  Listed words, ordinals and what Thai blanks touch suggest nothing; their weights are learned.
HINT = {"mark": 1, "point": 1, "number": -1, "leading": 1, "trailing_new": 1, "trailing": -1, "small": -1, "ordinal": 1, "quote": 1, "quote_on": -1, "blank": 1, "blank_joined": 1, "break": 1}
#: Classes that are known to be inside.
KNOWN = ("number", "small", "trailing", "quote_on")
# -----------------------------------------------------------------------------

OTHER, BLANK, BREAK, DIGIT, UPPER, LOWER, HAN, THAI, LETTER, POINT, MARK, SEMI, OPENB, CLOSEB, OPENQ, CLOSEQ, LOWQ, LEFTQ, STRAIGHT, COMMA, COLON, DASH, HIDDEN = range(23)
CLASSES = list(HINT)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The class of every code point."""
    k = np.zeros(C.TABLE, np.uint8)
    for low, high in ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x1_1000), (0x1_D400, 0x1_D800)):
        for c in range(low, high):
            ch = chr(c)
            kind = unicodedata.category(ch)
            if kind == "Zs":
                k[c] = BLANK
            elif kind[0] == "N":
                k[c] = DIGIT if kind == "Nd" else OTHER
            elif kind in ("Lu", "Lt"):
                k[c] = UPPER
            elif kind == "Ll":
                k[c] = LOWER
            elif kind[0] in "LM":
                k[c] = THAI if 0xE00 <= c < 0xE80 else HAN if 0x3040 <= c < 0x3100 or 0xF900 <= c < 0xFB00 or 0xFF66 <= c < 0xFFA0 else LETTER
    for low, high in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0x2_0000, 0x3_2000), (0x2E80, 0x2FE0), (0x3005, 0x3008)):
        k[low:high] = HAN
    k[0xAC00:0xD7A4] = LETTER
    for text, kind in ((LINE_BREAKS, BREAK), ("\t\x1f", BLANK), (CLOSING, MARK), (POINTS, POINT), ("；", SEMI), (OPEN_BRACKETS, OPENB), (CLOSE_BRACKETS, CLOSEB), (OPEN_QUOTES, OPENQ), (CLOSE_QUOTES, CLOSEQ), ("„", LOWQ), ("“", LEFTQ), ('"＂', STRAIGHT), (COMMAS, COMMA), (COLONS, COLON), (DASHES, DASH)):
        for ch in text:
            k[ord(ch)] = kind
    for low, high in INVISIBLE:
        k[low : high + 1] = HIDDEN
    return k


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Every code point in the one form in which words are looked up: plain width, look-alikes as Latin."""
    t = R.tables()
    fold = np.arange(C.TABLE, dtype=np.uint32)
    one = t.mapped & (t.size == 1)
    fold[one] = t.flat[t.start[one]]
    twin = t.to[R.LATIN][fold]
    return np.where(twin > 0, twin, fold).astype(np.uint32)


_REACH = 12
_BASE = np.uint64(1_000_003)


def _word_hash(word: str) -> int:
    h = 0
    fold = folded()
    for ch in word:
        h = (h * 1_000_003 + int(fold[ord(ch)])) & 0xFFFFFFFFFFFFFFFF
    return h


@lru_cache(maxsize=8)
def _hashes_of(words: tuple[str, ...]) -> np.ndarray:
    return np.array(sorted({_word_hash(w) for w in words}), np.uint64)


def _hashes(words: list[str]) -> np.ndarray:
    return _hashes_of(tuple(words))


def _is_in(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[at] == h


#: Features of a candidate, weights in all, and how many of them are the classes' own.
COLUMNS, BUCKETS, OWN = 6, 1 << 16, 32
#: Weight of a line break, which always ends a unit.
SURE = 12.0


def _hints() -> np.ndarray:
    w = np.zeros(BUCKETS, np.float32)
    w[: len(CLASSES)] = list(HINT.values())
    w[CLASSES.index("break")] = SURE
    return w


@dataclass
class Model:
    """Weights of hashed features (log odds of a boundary) and of transitions (from inside or boundary, to inside or boundary)."""

    weights: np.ndarray = field(default_factory=_hints)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))


def _bucket(column: int, *values: np.ndarray) -> np.ndarray:
    """Feature numbers of combined values."""
    h = np.full(len(values[0]), column + 1, np.uint64)
    for v in values:
        h = mix(h * _BASE + v.astype(np.uint64))
    return (np.uint64(OWN) + h % np.uint64(BUCKETS - OWN)).astype(np.int32)


class _Text:
    """Arrays of a batch of texts, invisible characters taken out."""

    def __init__(self, cp: np.ndarray, off: np.ndarray) -> None:
        kind = kinds()[cp]
        shown = kind != HIDDEN
        self.raw_off = off
        self.place = np.flatnonzero(shown)
        self.cp, self.off = C.keep(cp, off, shown)
        self.kind = kind[shown]
        self.word = folded()[self.cp]
        n = len(self.cp)
        self.row = C.rows_of(self.off)
        self.first = np.zeros(n + 1, bool)
        self.first[self.off[:-1]] = True
        self.first[n] = True
        # Nearest character that is no blank, before and after, within the row and line (BREAK counts, -1 at row ends).
        ink = self.kind != BLANK
        at = np.where(ink, np.arange(n), -1)
        self.last_ink = np.maximum.accumulate(at) if n else at
        back = np.where(ink, np.arange(n), n)
        self.next_ink = np.minimum.accumulate(back[::-1])[::-1] if n else back

    def before(self, i: np.ndarray) -> np.ndarray:
        """Class of the last inked character before i; BREAK at the start of a row."""
        j = np.where(i > 0, self.last_ink[np.maximum(i - 1, 0)], -1)
        ok = (j >= 0) & (j >= self.off[:-1][self.row[i]])
        return np.where(ok, self.kind[np.maximum(j, 0)], BREAK)

    def before_at(self, i: np.ndarray) -> np.ndarray:
        return np.where(i > 0, self.last_ink[np.maximum(i - 1, 0)], -1)

    def after_at(self, i: np.ndarray) -> np.ndarray:
        """Place of the next inked character after i, or -1 at the end of the row."""
        n = len(self.cp)
        j = np.where(i + 1 < n, self.next_ink[np.minimum(i + 1, n - 1)], n)
        return np.where(j < self.off[1:][self.row[i]], j, -1)

    def after(self, i: np.ndarray) -> np.ndarray:
        j = self.after_at(i)
        return np.where(j >= 0, self.kind[np.maximum(j, 0)], BREAK)

    def beside(self, i: np.ndarray, step: int) -> np.ndarray:
        """Class of the character right beside i; BREAK beyond the row."""
        j = i + step
        ok = (j >= self.off[:-1][self.row[i]]) & (j < self.off[1:][self.row[i]])
        return np.where(ok, self.kind[np.clip(j, 0, len(self.cp) - 1)], BREAK)

    def word_before(self, i: np.ndarray, dotted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(hash, length) of the letters right before i, with single points between them if dotted ('p.m', 'т. д' as 'т.д')."""
        h = np.zeros(len(i), np.uint64)
        size = np.zeros(len(i), np.int64)
        if not len(i):
            return h, size
        chars = np.zeros((len(i), _REACH), np.uint64)
        j = i - 1
        low = self.off[:-1][self.row[i]]
        live = np.ones(len(i), bool)
        for s in range(_REACH):
            ok = live & (j >= low)
            k = np.where(ok, self.kind[np.maximum(j, 0)], BREAK)
            letter = ok & ((k == UPPER) | (k == LOWER) | (k == LETTER) | (k == THAI))
            if dotted and s:
                # One blank after an inner point is looked over.
                skip = ok & (k == BLANK) & (np.where(j > low, self.kind[np.maximum(j - 1, 0)], BREAK) == POINT) & (size == 1)
                j = np.where(skip, j - 1, j)
                k = np.where(skip, POINT, k)
                point = ok & (k == POINT) & (size == 1)
                letter |= point
            live = letter
            chars[live, s] = self.word[np.maximum(j, 0)][live]
            size += live
            j = j - 1
        longest = size.max() if len(size) else 0
        for s in range(int(longest) - 1, -1, -1):
            on = size > s
            h[on] = h[on] * _BASE + np.where(chars[on, s] == 0xFF0E, np.uint64(0x2E), chars[on, s])
        h[(size == _REACH)] = 0
        return h, size

    def word_after(self, i: np.ndarray) -> np.ndarray:
        """Hash of the letters of the word that starts at i (-1: none)."""
        h = np.zeros(len(i), np.uint64)
        live = i >= 0
        high = np.where(live, self.off[1:][self.row[np.maximum(i, 0)]], 0)
        for s in range(_REACH):
            j = i + s
            live = live & (j < high)
            k = np.where(live, self.kind[np.clip(j, 0, len(self.cp) - 1)], BREAK)
            live = live & ((k == UPPER) | (k == LOWER) | (k == LETTER))
            h[live] = h[live] * _BASE + self.word[np.clip(j, 0, len(self.cp) - 1)][live].astype(np.uint64)
        return h


def _inside(t: _Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask of characters within brackets or quotes, opening places, closing places of quotes).

    Pairs never cross a line break.  A mark without its partner counts as no mark.
    """
    n = len(t.cp)
    k = t.kind
    line = np.cumsum((k == BREAK) | t.first[:n])
    depth = np.zeros(n + 1, np.int32)
    opened, closed = [], []

    def pair(a: np.ndarray, b: np.ndarray, quote: bool) -> None:
        np.add.at(depth, a, 1)
        np.add.at(depth, b, -1)
        if quote:
            opened.append(a)
            closed.append(b)

    at = np.flatnonzero((k == OPENB) | (k == CLOSEB))
    if len(at) > 1:
        ok = (k[at[:-1]] == OPENB) & (k[at[1:]] == CLOSEB) & (line[at[:-1]] == line[at[1:]])
        pair(at[:-1][ok], at[1:][ok], False)
    at = np.flatnonzero((k == OPENQ) | (k == CLOSEQ) | (k == LOWQ) | (k == LEFTQ))
    if len(at) > 1:
        kk = k[at]
        before = np.concatenate(([OTHER], kk[:-1]))
        same = np.concatenate(([False], line[at[1:]] == line[at[:-1]]))
        closes = (kk == CLOSEQ) | ((kk == LEFTQ) & (before == LOWQ) & same)
        ok = ~closes[:-1] & closes[1:] & same[1:]
        pair(at[:-1][ok], at[1:][ok], True)
    at = np.flatnonzero(k == STRAIGHT)
    if len(at) > 1:
        new = np.concatenate(([True], line[at[1:]] != line[at[:-1]]))
        number = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        ok = (number[:-1] % 2 == 0) & (number[1:] == number[:-1] + 1)
        pair(at[:-1][ok], at[1:][ok], True)
    inside = np.cumsum(depth)[:n] > 0
    if opened:
        o, c = np.concatenate(opened), np.concatenate(closed)
        return inside, o, c
    return inside, np.zeros(0, np.int64), np.zeros(0, np.int64)


def _points(t: _Text, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context class, feature numbers) of each point."""
    left, right = t.beside(at, -1), t.beside(at, 1)
    nxt = t.after(at)
    word, size = t.word_before(at)
    plain, plain_size = t.word_before(at, dotted=False)
    leading = (_is_in(word, _hashes(LEADING)) | _is_in(plain, _hashes(LEADING))) & (size > 0)
    trailing = _is_in(word, _hashes(TRAILING)) | _is_in(plain, _hashes(TRAILING))
    # A lone capital is an initial (J. R. Smith); letter.letter is an acronym.
    initial = (plain_size == 1) & (left == UPPER) & (nxt == UPPER)
    small = nxt == LOWER
    on = small | (nxt == COMMA) | (nxt == COLON)
    ends = nxt == BREAK
    index = CLASSES.index
    out = np.full(len(at), index("point"))
    # German ordinals: a bare number of one or two digits before a month, or after a word that calls for one.
    number = left == DIGIT
    d2 = t.beside(at, -2)
    d3 = t.beside(at, -3)
    short = number & ((d2 == BLANK) | ((d2 == DIGIT) & (d3 == BLANK)) | (d2 == BREAK) | ((d2 == DIGIT) & (d3 == BREAK)))
    behind = t.word_after(t.after_at(at))
    month = _is_in(behind, _hashes(MONTHS))
    start = at - np.where(d2 == DIGIT, 2, 1)
    gap = t.before_at(np.maximum(start, 0)) + 1
    called = np.zeros(len(at), bool)
    pick = np.flatnonzero(short & (gap > 0) & (t.row[np.minimum(np.maximum(gap, 0), len(t.cp) - 1)] == t.row[at]))
    if len(pick):
        h, _ = t.word_before(np.minimum(gap[pick], len(t.cp) - 1), dotted=False)
        called[pick] = _is_in(h, _hashes(BEFORE_ORDINAL))
    ordinal = short & (nxt == UPPER) & (month | called)
    out[small] = index("small")
    out[on & ~small] = index("trailing")
    out[trailing & ~small] = index("trailing_new")
    out[trailing & on] = index("trailing")
    out[leading & ~trailing & ~ends] = index("leading")
    out[initial] = index("leading")
    out[ordinal] = index("ordinal")
    out[(left == DIGIT) & (right == DIGIT)] = index("number")
    out[right == LOWER] = index("small")
    out[(left == POINT) & (right == POINT)] = index("small")
    out[ends] = index("mark")
    out[(t.kind[at - 1] == BLANK) & (right == DIGIT) & (at > 0)] = index("number")
    long = np.minimum(size, 6)
    none = size == 0
    features = np.stack((out.astype(np.int32), _bucket(1, np.full(len(at), POINT), left, nxt), _bucket(2, word), _bucket(3, word, nxt), _bucket(4, behind), _bucket(5, long, left, nxt)), axis=1)
    features[none, 2:4] = NOTHING
    features[behind == 0, 4] = NOTHING
    return out, features


def _thai(t: _Text) -> tuple[np.ndarray, np.ndarray]:
    """(places of blanks that may close a Thai unit, whether each joins what stands beside it)."""
    rows = len(t.off) - 1
    thai = np.bincount(t.row[t.kind == THAI], minlength=rows)
    letters = np.bincount(t.row[(t.kind >= UPPER) & (t.kind <= LETTER)], minlength=rows)
    is_thai = 2 * thai > letters
    at = np.flatnonzero((t.kind == BLANK) & is_thai[t.row])
    if not len(at):
        return at, np.zeros(0, bool)
    # A run of blanks stands at its first place.
    at = at[t.beside(at, -1) != BLANK]
    left, right = t.before(at), t.after(at)
    joined = np.isin(left, (DIGIT, UPPER, LOWER, POINT)) | np.isin(right, (DIGIT, UPPER, LOWER))
    # An abbreviation behind the blank: one to three Thai letters and a point.
    nxt = np.maximum(t.after_at(at), 0)
    for size in (1, 2, 3):
        j = nxt + size
        ok = (j < t.off[1:][t.row[at]])
        k = np.where(ok, t.kind[np.minimum(j, len(t.cp) - 1)], BREAK)
        thai_run = np.ones(len(at), bool)
        for s in range(size):
            thai_run &= t.kind[np.minimum(nxt + s, len(t.cp) - 1)] == THAI
        joined |= ok & thai_run & (k == POINT)
    # The first blank after a title parts a person's names.
    titled = np.zeros(len(at), bool)
    n = len(t.cp)
    for title in THAI_TITLES:
        code = np.array([ord(x) for x in title], np.uint32)
        hit = t.cp[: max(0, n - len(code) + 1)] == code[0]
        for s in range(1, len(code)):
            hit = hit & (t.cp[s : len(hit) + s] == code[s])
        where = np.flatnonzero(hit)
        for no in THAI_NO_TITLES:
            if no.endswith(title):
                extra = len(no) - len(title)
                head = np.array([ord(x) for x in no[:extra]], np.uint32)
                same = np.ones(len(where), bool)
                for s in range(extra):
                    same &= t.cp[np.maximum(where - extra + s, 0)] == head[s]
                where = where[~(same & (where >= extra))]
        end = where + len(code)
        # A blank right behind the title belongs to it; the one after that parts the names.
        first = np.searchsorted(at, end)
        ok = first < len(at)
        first, end = first[ok], end[ok]
        direct = at[first] == end
        for f in (first, np.minimum(first[direct] + 1, len(at) - 1)):
            good = t.row[at[f]] == t.row[np.minimum(end if len(f) == len(end) else end[direct], n - 1)]
            titled[f[good]] = True
    return at, joined | titled


#: The feature that stands for none; its weight is zero.
NOTHING = OWN - 1
#: Bias of the examples that show training a word alone.
WORD_ONLY = OWN - 2


def _blank_features(t: _Text, at: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Feature numbers of Thai blanks: neighbours by one and two characters, the beginning and the length of the chunk before."""
    n = len(t.cp)
    b, a = np.maximum(t.before_at(at), 0), np.maximum(t.after_at(at), 0)
    low = t.off[:-1][t.row[at]]
    gap = np.where((t.kind == BLANK) | (t.kind == BREAK), np.arange(n), -1)
    gap = np.maximum.accumulate(gap)
    begin = np.maximum(gap[b] + 1, low)
    three = [t.cp[np.minimum(begin + k, n - 1)] for k in range(3)]
    size = np.minimum(np.log2(np.maximum(b - begin + 1, 1)), 9).astype(np.int64)
    return np.stack((cls.astype(np.int32), _bucket(6, t.kind[b], t.kind[a]), _bucket(7, t.cp[np.maximum(b - 1, 0)], t.cp[b]), _bucket(8, t.cp[a], t.cp[np.minimum(a + 1, n - 1)]), _bucket(9, *three), _bucket(10, size, t.kind[a])), axis=1)


def candidates(t: _Text) -> tuple[np.ndarray, np.ndarray]:
    """(places, feature numbers) of all candidates in order; the first feature is the context class."""
    index = CLASSES.index
    inside, opened, closed = _inside(t)
    places, found = [], []

    def add(at: np.ndarray, cls, features: np.ndarray | None = None) -> None:
        if features is None:
            cls = np.broadcast_to(cls, at.shape).astype(np.int32)
            features = np.full((len(at), COLUMNS), NOTHING, np.int32)
            features[:, 0] = cls
            if len(at):
                features[:, 1] = _bucket(11, cls, t.kind[at], t.after(at))
        places.append(at)
        found.append(features)

    thai_rows = np.zeros(len(t.off) - 1, bool)
    blank_at, joined = _thai(t)
    thai_rows[t.row[blank_at]] = True
    add(np.flatnonzero(t.kind == BREAK), index("break"))
    add(np.flatnonzero(((t.kind == MARK) | (t.kind == SEMI)) & ~inside), index("mark"))
    points = np.flatnonzero((t.kind == POINT) & ~inside & ~thai_rows[t.row])
    if len(points):
        add(points, *_points(t, points))
    if len(closed):
        own = np.isin(t.before(closed), (MARK, POINT))
        lead = np.isin(t.before(opened), (COLON, COMMA))
        nxt = t.after(closed)
        follow = np.maximum(t.after_at(closed), 0)
        particle = np.isin(t.cp[follow], np.array([ord(x) for x in PARTICLES])) & (t.after_at(closed) >= 0)
        on = np.isin(nxt, (COMMA, DASH, LOWER, COLON, MARK, POINT, SEMI)) | particle
        outer = ~inside[np.minimum(closed, len(inside) - 1)] | (closed + 1 >= len(inside))
        good = own & lead & outer
        add(closed[good], np.where(on[good], index("quote_on"), index("quote")))
    if len(blank_at):
        outside = ~inside[blank_at]
        at, joined = blank_at[outside], joined[outside]
        cls = np.where(joined, index("blank_joined"), index("blank"))
        add(at, cls, _blank_features(t, at, cls))
    place, features = np.concatenate(places), np.concatenate(found)
    order = np.argsort(place, kind="stable")
    return place[order], features[order]


def emissions(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds of a boundary right after each candidate."""
    return weights[features].sum(axis=1, dtype=np.float64)


#: Cost of each candidate passed over behind a boundary without ink, which makes the last mark of a run the boundary.
LATE = 1e-3


def viterbi(odds: np.ndarray, row: np.ndarray, rows: int, bare: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
    """The best boundary tags of all candidates.

    States are inside, boundary and closed (a boundary lies behind, with no ink
    since).  ``bare`` marks candidates with no ink between them and the
    candidate before: there boundary and closed lead to closed only.  ``moves``
    are the weights of going from inside or boundary to inside or boundary.

    A candidate whose odds outweigh whatever both transitions can add has its
    tag whatever stands beside it, so chains are cut there; what is left of
    all texts, mostly runs of marks, is decoded side by side.
    """
    moves = np.zeros((2, 2)) if moves is None else moves
    tags = odds > 0
    if not len(odds):
        return tags
    reach = 2 * (moves.max() - moves.min())
    follows = np.concatenate((bare[1:], [False]))
    rest = np.flatnonzero(bare | follows | (np.abs(odds) <= reach))
    if not len(rest):
        return tags
    same = np.concatenate(([False], row[1:] == row[:-1]))
    first = np.ones(len(rest), bool)
    first[1:] = (np.diff(rest) > 1) | ~same[rest[1:]]
    head = rest[first]
    count = np.diff(np.concatenate((np.flatnonzero(first), [len(rest)])))
    # What the settled neighbours of a chain add to its ends.
    before = np.where(same[head], tags[np.maximum(head - 1, 0)].astype(np.int64), -1)
    tail = head + count - 1
    after = np.where((tail + 1 < len(odds)) & np.concatenate((same[1:], [False]))[tail], tags[np.minimum(tail + 1, len(odds) - 1)].astype(np.int64), -1)
    enter = np.where(before[:, None] >= 0, moves[np.maximum(before, 0)], 0.0)
    leave = np.where(after[:, None] >= 0, moves[:, np.maximum(after, 0)].T, 0.0)
    order = np.argsort(-count, kind="stable")
    head, count, enter, leave = head[order], count[order], enter[order], leave[order]
    steps, n = int(count[0]), len(head)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    live = np.searchsorted(-count, -np.arange(1, steps + 1), side="right")
    inside, boundary, closed = np.zeros(n), np.full(n, -np.inf), np.full(n, -np.inf)
    came = np.zeros((steps, n), np.uint8)  # where the best ways to inside and boundary come from (0, 1, 2, the latter times 8), plus 4 if that to closed comes from closed
    for s in range(steps):
        m = live[s]
        at = head[:m] + s
        i, b, c, tight = inside[:m], boundary[:m], closed[:m], bare[at] & (s > 0)
        best, source = [], np.zeros(m, np.uint8)
        for to in (0, 1):
            far = moves[1, to] if s else 0.0
            top, way = i + (moves[0, to] if s else enter[:m, to]), np.zeros(m, np.uint8)
            for state, score in ((1, b), (2, c)):
                better = ~tight & (score + far > top)
                top[better], way[better] = score[better] + far, state
            best.append(top)
            source += way << (3 * to)
        shut = np.maximum(b, c) - LATE
        came[s, :m] = source + 4 * (c > b)
        inside[:m], boundary[:m] = best[0] + no[at], best[1] + yes[at]
        closed[:m] = np.where(tight, shut + no[at], -np.inf)
    inside, boundary, closed = inside + leave[:, 0], boundary + leave[:, 1], closed + leave[:, 1]
    state = np.zeros(n, np.uint8)
    for s in range(steps - 1, -1, -1):
        m = live[s]
        newly = slice(live[s + 1] if s + 1 < steps else 0, m)
        state[newly] = np.argmax(np.stack((inside[newly], boundary[newly], closed[newly])), axis=0)
        now, back = state[:m], came[s, :m]
        tags[head[:m] + s] = now == 1
        state[:m] = np.where(now == 2, np.where(back & 4, 2, 1), np.where(now == 1, back >> 3, back & 3))
    return tags


def _bare(t: _Text, place: np.ndarray, ink: np.ndarray) -> np.ndarray:
    """Whether no ink stands between each candidate and the one before."""
    bare = np.zeros(len(place), bool)
    if len(place) > 1:
        inked = np.concatenate(([0], np.cumsum(ink)))
        bare[1:] = (inked[place[1:]] == inked[place[:-1] + 1]) & (t.row[place[1:]] == t.row[place[:-1]])
    return bare


def units(cp: np.ndarray, off: np.ndarray, model: Model | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every unit of a batch in order, offsets into the stored texts.

    Blanks and line breaks around a unit are left out; a text without ink has none.
    """
    none = np.zeros(0, np.int64)
    t = _Text(cp, off)
    n = len(t.cp)
    if n == 0:
        return none, none, none
    model = model or listed_model()
    place, features = candidates(t)
    ink = (t.kind != BLANK) & (t.kind != BREAK)
    tags = viterbi(emissions(features, model.weights), t.row[place], len(off) - 1, _bare(t, place, ink), model.moves)
    cut = t.first.copy()
    cut[place[tags] + 1] = True
    segment = np.cumsum(cut[:n]) - 1
    at = np.flatnonzero(ink)
    if not len(at):
        return none, none, none
    s = segment[at]
    first, last = at[np.searchsorted(s, np.unique(s), "left")], at[np.searchsorted(s, np.unique(s), "right") - 1]
    row = t.row[first]
    base, top = off[:-1][row], off[1:][row]
    # Invisible characters go to the unit that follows them, or at its end to the one before.
    begin = np.where(first > t.off[:-1][row], t.place[np.maximum(first - 1, 0)] + 1, base)
    more = last + 1 < t.off[1:][row]
    nxt = np.minimum(last + 1, n - 1)
    end = np.where(more, np.where(ink[nxt], t.place[last] + 1, t.place[nxt]), top)
    return row, begin - base, end - base


#: Variance of the classes' weights and of all others under the prior.
WIDE, NARROW = 9.0, 4.0
#: Deviance from what the class foretells that a feature must show to be learned (odds of chance about 1 in 100,000).
DEVIANCE = 20.0
STEPS = 300


def examples(texts: list[str | None]) -> tuple[_Text, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text with its line breaks stripped, candidates, features, line ends, known insides).

    Candidates at the end of a text are left out: they tell nothing.
    """
    cp, off = C.from_arrow(pa.array(texts, pa.string()))
    lines = _Text(cp, off)
    flat = cp.copy()
    flat[kinds()[cp] == BREAK] = 0x20
    t = _Text(flat, off)
    place, features = candidates(t)
    keep = t.after_at(place) >= 0
    place, features = place[keep], features[keep]
    ended = (lines.after(place) == BREAK) | (lines.kind[place] == BREAK)
    cls = features[:, 0]
    known = np.isin(cls, [CLASSES.index(c) for c in KNOWN])
    return t, place, features, ended, known & ~ended


def _fit(features: np.ndarray, ended: np.ndarray, inside: np.ndarray, kept: float, mean: np.ndarray, narrow: np.ndarray) -> np.ndarray:
    """The weights that make the line ends likeliest, by damped diagonal Newton steps."""
    rows, times = np.unique(np.column_stack((features, ended, inside)), axis=0, return_counts=True)
    features, ended, inside = rows[:, :COLUMNS], rows[:, COLUMNS] > 0, rows[:, COLUMNS + 1] > 0
    used, local = np.unique(features, return_inverse=True)
    local = local.reshape(features.shape)
    w, mean = mean[used].astype(np.float64), mean[used].astype(np.float64)
    inverse = 1 / np.where(narrow[used], NARROW, WIDE)
    fixed = used == NOTHING
    flat = local.ravel()
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(w[local].sum(axis=1), -30, 30)))
        q = kept * p
        slope = np.where(ended, 1 - p, np.where(inside, -p, -q * (1 - p) / (1 - q)))
        bend = np.where(ended | inside, p * (1 - p), q * (1 - p)) + 1e-6
        up = np.bincount(flat, np.repeat(slope * times, COLUMNS), len(used)) - (w - mean) * inverse
        down = np.bincount(flat, np.repeat(bend * times, COLUMNS), len(used)) * COLUMNS + inverse
        step = np.clip(up / down, -0.5, 0.5)
        step[fixed] = 0
        w += step
        if np.abs(step).max() < 1e-3:
            break
    out = _hints()
    out[used] = w
    return out


def _deviance(seen: np.ndarray, expected: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Twice the log likelihood ratio of ``seen`` of ``n`` against ``expected`` of ``n``."""

    def part(k: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9)), 0.0)

    return 2 * (part(seen, expected) + part(n - seen, n - expected))


def _telling(features: np.ndarray, weight: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Which features stand with ``seen`` far more or less often than ``expected`` by more than chance."""
    flat, wide = features.ravel(), features.shape[1]
    n, k, e = (np.bincount(flat, np.repeat(x, wide), BUCKETS) for x in (weight, seen * weight, expected * weight))
    out = _deviance(k, e, n) > DEVIANCE
    out[NOTHING] = False
    return out


def listed_model() -> Model:
    """A model for texts that tell nothing (no line breaks to learn from): the lists are taken at their word."""
    model = Model()
    model.weights[[CLASSES.index(c) for c in ("leading", "ordinal", "blank_joined")]] = -1
    return model


#: Line ends that a sample must hold to train a model.
LEAST_ENDS = 15


def train(texts: list[str | None]) -> Model:
    """A model from a bounded sample of texts; with fewer than LEAST_ENDS line ends in it, the listed model."""
    model = Model()
    t, place, features, ended, inside = examples(texts)
    if ended.sum() < LEAST_ENDS:
        return listed_model()
    sure = features[:, 0] == CLASSES.index("mark")
    if (sure & ended).sum() < LEAST_ENDS:
        sure = (emissions(features, model.weights) > 0) & ~inside
    kept = float(np.clip((ended & sure).sum() / max(sure.sum(), 1), 0.01, 0.9))
    narrow = np.ones(BUCKETS, bool)
    narrow[:OWN] = False
    # Classes first; then whatever differs from its class by more than chance.
    only = np.full_like(features, NOTHING)
    only[:, 0] = features[:, 0]
    first = _fit(only, ended, inside, kept, model.weights, narrow)
    p = 1 / (1 + np.exp(-emissions(only, first)))
    telling = _telling(features[:, 1:], (~inside).astype(float), ended.astype(float), kept * p)
    # The words of known points, alone: what surrounds them explains their tag away otherwise.
    words = np.flatnonzero((ended | inside) & (t.kind[place] == POINT) & (features[:, 2] != NOTHING))
    if len(words):
        telling |= _telling(features[words, 2:3], np.ones(len(words)), ended[words].astype(float), np.full(len(words), ended[words].mean()))
    features = np.where(telling[features] | (np.arange(COLUMNS) == 0), features, NOTHING)
    alone = np.full((len(words), COLUMNS), NOTHING, np.int32)
    alone[:, 0], alone[:, 2] = WORD_ONLY, features[words, 2]
    model.weights = _fit(np.concatenate((features, alone)), np.concatenate((ended, ended[words])), np.concatenate((inside, inside[words])), kept, model.weights, narrow)
    model.weights[[NOTHING, WORD_ONLY]] = 0
    model.weights[CLASSES.index("break")] = SURE
    # Transitions: line ends behind each tag of the candidate before, against what the weights alone foretell there.
    ink = (t.kind != BLANK) & (t.kind != BREAK)
    bare, row, odds = _bare(t, place, ink), t.row[place], emissions(features, model.weights)
    before = viterbi(odds, row, len(t.off) - 1, bare)[:-1].astype(np.int64)
    free = (row[1:] == row[:-1]) & ~bare[1:]
    seen = np.bincount(before[free], ended[1:][free], 2) + 5
    expected = np.bincount(before[free], (kept / (1 + np.exp(-odds[1:])))[free], 2) + 5
    model.moves = np.stack((np.zeros(2), np.log(seen / expected)), axis=1)
    return model


#: Rows that ``sample`` takes for training, and the most characters of one of them.
SAMPLE_ROWS, SAMPLE_CHARACTERS = 4000, 20_000


def sample(df: DataFrame, key: str, text: str, rows: int = SAMPLE_ROWS) -> list[str | None]:
    """A bounded sample of whole texts, the same in every run: those whose keys hash lowest, texts beyond SAMPLE_CHARACTERS left out.

    Rows are first drawn by hash at the rate that leaves about one and a half
    times as many as wanted, so partitions send few rows however many they are.
    """
    from pyspark.sql import functions as F

    n = df.count()
    place = F.shiftrightunsigned(F.xxhash64(key), 11).cast("double") / float(1 << 53)
    drawn = df.where(F.col(text).isNotNull() & (F.char_length(text) <= SAMPLE_CHARACTERS) & (place < min(1.0, 1.5 * rows / max(n, 1))))
    return [r[0] for r in drawn.orderBy(place, key).select(text).limit(rows).collect()]


def sentence_units(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """(key, start_pos, end_pos) of every sentence unit; null, empty and blank texts have none.

    Offsets are 0-based, half-open and count code points of the stored text.
    """
    model = model or listed_model()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                row, begin, end = units(*C.from_arrow(batch.column(text)), model)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), pa.array(begin), pa.array(end)], names=[key, "start_pos", "end_pos"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, start_pos bigint, end_pos bigint")
