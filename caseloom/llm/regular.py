"""Problem 1: one consistent form for text that looks the same.

Text arrives as code-point arrays (``codepoints``).  Every step is a table
gather, an offset expansion or a mask over the whole batch; there is no call
for a single row's string.

The regular form:

* letters, digits and ideographs in a wide, narrow, ligature, radical or
  compatibility form become their plain character;
* letters with separate marks become the composed (NFC) character;
* invisible characters are dropped, every space character becomes U+0020;
* letters that imitate the script of the word they stand in (Greek or Cyrillic
  in a Latin word and the like, kana among ideographs, doubled Thai vowels)
  become letters of that script;
* punctuation, symbols, line breaks and runs of U+0020 stay as they are.

Rows without any character that could change are passed through untouched.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from . import codepoints as C

# ---- fixed values -----------------------------------------------------------
#: Invisible characters (inclusive ranges).
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF))
#: Letters of one script that look like letters of Latin.
CYRILLIC_AS_LATIN = dict(zip("аеорсухіѕјһԁԛԝӏАВЕКМНОРСТУХІЅЈԚԜҮӀёЁїЇ", "aeopcyxisjhdqwlABEKMHOPCTYXISJQWYIëËïÏ"))
GREEK_AS_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιραυκϲϳ", "ABEZHIKMNOPTYXovipaukcj"))
#: Letters of Latin and Greek that look like letters of Cyrillic.
LATIN_AS_CYRILLIC = dict(zip("aeopcyxisjhkABEKMHOPCTYXISJëËïÏ", "аеорсухіѕјһкАВЕКМНОРСТУХІЅЈёЁїЇ"))
GREEK_AS_CYRILLIC = dict(zip("ΑΒΕΗΙΚΜΟΡΤΥΧΓΠΦορακ", "АВЕНІКМОРТУХГПФорак"))
LATIN_AS_GREEK = dict(zip("ABEZHIKMNOPTYXovipauk", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιραυκ"))
CYRILLIC_AS_GREEK = dict(zip("АВЕНІКМОРТУХГПФорак", "ΑΒΕΗΙΚΜΟΡΤΥΧΓΠΦορακ"))
#: Kana that look like ideographs, and kana of the other syllabary.
KANA_AS_HAN = dict(zip("ロカタニハエトチミオヌー", "口力夕二八工卜千三才又一"))
HIRAGANA_AS_KATAKANA = dict(zip("へべぺり", "ヘベペリ"))
#: Letter sequences that look like one letter.
SEQUENCES = {"เเ": "แ", "ํา": "ำ", "ໍາ": "ຳ"}
#: Compatibility forms that are the regular spelling (Thai and Lao AM, HO NO, HO MO).
REGULAR_ANYWAY = "ำຳໜໝ"
# -----------------------------------------------------------------------------

LATIN, CYRILLIC, GREEK, HAN, KATAKANA, HIRAGANA = 1, 2, 3, 4, 5, 6
_HANGUL_L, _HANGUL_V, _HANGUL_T, _HANGUL_S = 0x1100, 0x1161, 0x11A7, 0xAC00


def _assigned():
    """Code points worth asking unicodedata about (not the large uniform blocks)."""
    for low, high in ((0xA0, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x1_1A00), (0x1_6A00, 0x1_BD00), (0x1_D000, 0x1_F200), (0x2_F800, 0x2_FA20)):
        yield from range(low, high)


class _Tables:
    """Lookup tables, built once a process from unicodedata and the fixed values."""

    def __init__(self) -> None:
        n = C.TABLE
        self.size = np.ones(n, np.uint8)
        self.start = np.zeros(n, np.int32)
        self.ccc = np.zeros(n, np.uint8)
        self.script = np.zeros(n, np.uint8)
        self.mark = np.zeros(n, bool)
        self.second = np.zeros(n, bool)  # may compose with what stands before it
        self.mapped = np.zeros(n, bool)  # changes or vanishes by itself
        self.nfd_size = np.ones(n, np.uint8)
        self.nfd_start = np.zeros(n, np.int32)
        flat: list[int] = []
        nfd: list[int] = []
        pairs: dict[int, int] = {}
        for low, high in ((0x41, 0x5B), (0x61, 0x7B)):
            self.script[low:high] = LATIN
        for c in _assigned():
            ch = chr(c)
            kind = unicodedata.category(ch)
            if kind == "Cn":
                continue
            if kind[0] == "M":
                self.mark[c] = True
                self.ccc[c] = unicodedata.combining(ch)
            full = unicodedata.normalize("NFD", ch)
            if full != ch:
                self.nfd_size[c], self.nfd_start[c] = len(full), len(nfd)
                nfd += map(ord, full)
                one = unicodedata.decomposition(ch).split()
                if len(one) == 2 and one[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
                    pairs[int(one[0], 16) << 21 | int(one[1], 16)] = c
                    self.second[int(one[1], 16)] = True
            radical = 0x2E80 <= c < 0x2FE0
            if (kind[0] in "LMN" or radical) and ch not in REGULAR_ANYWAY:
                form = unicodedata.normalize("NFKC", ch) if kind[0] != "M" or unicodedata.normalize("NFC", ch) != ch else ch
                if form != ch and (radical or kind[0] == "M" or all(unicodedata.category(x)[0] in "LMN" for x in form)):
                    self.mapped[c] = True
                    self.size[c], self.start[c] = len(form), len(flat)
                    flat += map(ord, form)
            elif kind == "Zs":
                self.mapped[c] = True
                self.start[c] = len(flat)
                flat.append(0x20)
            if kind[0] == "L":
                name = unicodedata.name(ch, "")
                for code, script in ((LATIN, "LATIN"), (CYRILLIC, "CYRILLIC"), (GREEK, "GREEK"), (KATAKANA, "KATAKANA"), (HIRAGANA, "HIRAGANA")):
                    if name.startswith(script):
                        self.script[c] = code
        for low, high in INVISIBLE:
            self.size[low : high + 1] = 0
            self.mapped[low : high + 1] = True
        for low, high in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x2_0000, 0x3_2000)):
            self.script[low:high] = HAN
        self.script[[0x3005, 0x3007]] = HAN
        self.script[0x30FC] = KATAKANA
        self.flat = np.array(flat, np.uint32)
        self.nfd = np.array(nfd, np.uint32)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_key, self.pair_to = keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)
        self.second[_HANGUL_V : _HANGUL_V + 21] = True
        self.second[_HANGUL_T + 1 : _HANGUL_T + 28] = True
        self.to = {}
        for target, maps in ((LATIN, (CYRILLIC_AS_LATIN, GREEK_AS_LATIN)), (CYRILLIC, (LATIN_AS_CYRILLIC, GREEK_AS_CYRILLIC)), (GREEK, (LATIN_AS_GREEK, CYRILLIC_AS_GREEK))):
            table = np.zeros(n, np.uint32)
            for one in maps:
                for a, b in one.items():
                    table[ord(a)] = ord(b)
            self.to[target] = table
        self.kana_han = np.zeros(n, np.uint32)
        self.han_kana = np.zeros(n, np.uint32)
        for a, b in KANA_AS_HAN.items():
            self.kana_han[ord(a)] = ord(b)
            self.han_kana[ord(b)] = ord(a)
        self.hira_kata = np.zeros(n, np.uint32)
        self.kata_hira = np.zeros(n, np.uint32)
        for a, b in HIRAGANA_AS_KATAKANA.items():
            self.hira_kata[ord(a)] = ord(b)
            self.kata_hira[ord(b)] = ord(a)
        #: Alone decides that a row needs a closer look.
        self.look = self.mapped | self.second
        self.look |= (self.script == CYRILLIC) | (self.script == GREEK) | (self.kana_han > 0)
        self.look[[ord(x) for x in HIRAGANA_AS_KATAKANA]] = True
        for pair in SEQUENCES:
            self.look[ord(pair[1])] = True
        self.blank = np.zeros(n, bool)
        self.blank[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]] = True


@lru_cache(maxsize=1)
def tables() -> _Tables:
    return _Tables()


def _compose(t: _Tables, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The composed character of each pair, 0 where there is none."""
    key = a.astype(np.int64) << 21 | b.astype(np.int64)
    at = np.minimum(np.searchsorted(t.pair_key, key), len(t.pair_key) - 1)
    out = np.where(t.pair_key[at] == key, t.pair_to[at], 0).astype(np.uint32)
    ai, bi = a.astype(np.int64), b.astype(np.int64)
    lv = (ai >= _HANGUL_L) & (ai < _HANGUL_L + 19) & (bi >= _HANGUL_V) & (bi < _HANGUL_V + 21)
    out = np.where(lv, _HANGUL_S + ((ai - _HANGUL_L) * 21 + bi - _HANGUL_V) * 28, out)
    lvt = (ai >= _HANGUL_S) & (ai < _HANGUL_S + 11172) & ((ai - _HANGUL_S) % 28 == 0) & (bi > _HANGUL_T) & (bi < _HANGUL_T + 28)
    return np.where(lvt, ai + bi - _HANGUL_T, out).astype(np.uint32)


def _nfc(t: _Tables, cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical composition of a whole batch."""
    ccc = t.ccc[cp]
    join = (ccc > 0) | t.second[cp]
    if not join.any():
        return cp, off
    if t.second[cp].any() or ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:])).any():
        # Bases that carry marks are taken apart first, so that marks can be put in order.
        base = np.zeros(len(cp), bool)
        base[:-1] = join[1:]
        base |= join
        size = np.where(base, t.nfd_size[cp], 1).astype(np.int64)
        if (size > 1).any():
            flat = np.concatenate((t.nfd, cp))
            start = np.where(size > 1, t.nfd_start[cp], np.arange(len(cp)) + len(t.nfd))
            cp, off, _ = C.expand(cp, off, size, start, flat)
            ccc = t.ccc[cp]
    row = C.rows_of(off)
    if ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (row[1:] == row[:-1])).any():
        starter = np.cumsum((ccc == 0) | np.concatenate(([True], row[1:] != row[:-1])))
        moved = np.flatnonzero(ccc > 0)
        order = np.lexsort((ccc[moved], starter[moved]))
        cp = cp.copy()
        cp[moved] = cp[moved[order]]
        ccc = t.ccc[cp]
    first = np.zeros(len(cp), bool)
    first[off[:-1][off[:-1] < len(cp)]] = True
    # Runs: a starter and the marks after it; the k-th mark of all runs is tried at once.
    starter = (ccc == 0) | first
    run = np.cumsum(starter) - 1
    head = np.flatnonzero(starter)
    depth = np.arange(len(cp)) - head[run]
    cp = cp.copy()
    gone = np.zeros(len(cp), bool)
    last = np.zeros(len(head), np.int16)
    marks = np.flatnonzero(depth > 0)
    if len(marks):
        marks = marks[np.argsort(depth[marks], kind="stable")]
        bounds = np.searchsorted(depth[marks], np.arange(1, depth[marks[-1]] + 2))
        for low, high in zip(bounds[:-1], bounds[1:]):
            at = marks[low:high]
            r = run[at]
            made = _compose(t, cp[head[r]], cp[at])
            free = (made > 0) & (last[r] < ccc[at]) & (ccc[head[r]] == 0)
            cp[head[r[free]]] = made[free]
            gone[at[free]] = True
            last[r[~free]] = ccc[at[~free]]
    cp, off = C.keep(cp, off, ~gone)
    for _ in range(2):  # starters that compose with the starter right before them
        second = t.second[cp] & (t.ccc[cp] == 0)
        second[off[:-1][off[:-1] < len(cp)]] = False
        at = np.flatnonzero(second)
        if not len(at):
            break
        made = _compose(t, cp[at - 1], cp[at])
        made[np.concatenate(([False], (np.diff(at) == 1) & (made[:-1] > 0)))] = 0
        at, made = at[made > 0], made[made > 0]
        if not len(at):
            break
        cp = cp.copy()
        cp[at - 1] = made
        wanted = np.ones(len(cp), bool)
        wanted[at] = False
        cp, off = C.keep(cp, off, wanted)
    return cp, off


def _alphabets(t: _Tables, cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Letters that imitate the script of their word, for Latin, Cyrillic and Greek."""
    script = t.script[cp]
    letter = (script >= LATIN) & (script <= GREEK)
    if not ((script == CYRILLIC) | (script == GREEK)).any():
        return cp
    row = C.rows_of(off)
    inside = letter | t.mark[cp]
    new = inside.copy()
    new[1:] &= ~(inside[:-1] & (row[1:] == row[:-1]))
    word = np.cumsum(new) - 1
    at = np.flatnonzero(letter)
    w, s, c = word[at], script[at], cp[at]
    n = int(word[-1]) + 1 if len(word) else 0
    own = np.stack([np.bincount(w[s == k], minlength=n) for k in (LATIN, CYRILLIC, GREEK)])
    mixed = (own > 0).sum(0) > 1
    if not mixed.any():
        return cp
    pick = mixed[w]
    at, w, s, c = at[pick], w[pick], s[pick], c[pick]
    odd = np.stack([np.bincount(w[(s != k) & (t.to[k][c] == 0)], minlength=n) for k in (LATIN, CYRILLIC, GREEK)])
    # Fewest letters without a twin, then most letters of its own, then the script of the row.
    rows = len(off) - 1
    total = np.stack([np.bincount(row[letter & (script == k)], minlength=rows) for k in (LATIN, CYRILLIC, GREEK)])
    word_row = np.zeros(n, np.int64)
    word_row[word[new]] = row[new]
    rank = np.argsort(np.argsort(-total, axis=0, kind="stable"), axis=0, kind="stable")[:, word_row]
    target = np.argmin(odd * 10_000_000 - own * 10 + rank, axis=0) + 1
    cp = cp.copy()
    for k in (LATIN, CYRILLIC, GREEK):
        to = t.to[k][c]
        change = (target[w] == k) & (s != k) & (to > 0)
        cp[at[change]] = to[change]
    return cp


def _kana(t: _Tables, cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Kana among ideographs and the reverse.

    A kana that looks like an ideograph becomes one only where it stands alone:
    with another kana beside it, it is a word of its own script (a name such as
    トニ or ハタ), whatever else the row holds.
    """
    twin = (t.kana_han[cp] > 0) | (t.han_kana[cp] > 0) | (t.hira_kata[cp] > 0) | (t.kata_hira[cp] > 0)
    if not twin.any():
        return cp
    script = t.script[cp]
    row = C.rows_of(off)
    kana = (script == KATAKANA) | (script == HIRAGANA)
    rows = len(off) - 1
    sure = np.bincount(row[kana & (t.kana_han[cp] == 0)], minlength=rows) > 0
    han = np.bincount(row[script == HAN], minlength=rows) > 0
    before = np.zeros(len(cp), np.uint8)
    after = np.zeros(len(cp), np.uint8)
    same = row[1:] == row[:-1]
    before[1:] = np.where(same, script[:-1], 0)
    after[:-1] = np.where(same, script[1:], 0)
    near_kata = (before == KATAKANA) | (after == KATAKANA)
    near_han = (before == HAN) | (after == HAN)
    cp = cp.copy()
    to_han = (t.kana_han[cp] > 0) & ~near_kata & np.where(sure[row], near_han & ~((cp == 0x30FC) & (before == HIRAGANA)), han[row])
    to_kata = (t.han_kana[cp] > 0) & (before == KATAKANA) & (after == KATAKANA) & sure[row]
    katakana = (t.hira_kata[cp] > 0) & (before == KATAKANA) & (after == KATAKANA)
    hiragana = (t.kata_hira[cp] > 0) & (before == HIRAGANA) & (after == HIRAGANA)
    for change, table in ((to_han, t.kana_han), (to_kata, t.han_kana), (katakana, t.hira_kata), (hiragana, t.kata_hira)):
        cp[change] = table[cp[change]]
    return cp


def _sequences(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for pair, one in SEQUENCES.items():
        hit = (cp[:-1] == ord(pair[0])) & (cp[1:] == ord(pair[1]))
        if len(off) > 2:
            inner = off[1:-1]
            hit[inner[(inner > 0) & (inner < len(cp))] - 1] = False
        at = np.flatnonzero(hit)
        if len(at) > 1 and pair[0] == pair[1]:
            # In a longer run every other place starts a pair.
            group = np.cumsum(np.concatenate(([True], np.diff(at) > 1)))
            at = at[(at - at[np.searchsorted(group, group)]) % 2 == 0]
        if len(at):
            cp = cp.copy()
            cp[at] = ord(one)
            wanted = np.ones(len(cp), bool)
            wanted[at + 1] = False
            cp, off = C.keep(cp, off, wanted)
    return cp, off


def regular(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, offsets, changed rows) of the batch in regular form."""
    t = tables()
    n = len(off) - 1
    changed = np.zeros(n, bool)
    if not len(cp):
        return cp, off, changed
    look = t.look[cp]
    ccc = t.ccc[cp]
    look[1:] |= (ccc[1:] > 0) & (ccc[:-1] > ccc[1:])
    rows = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(look)))[off]) > 0)
    if not len(rows):
        return cp, off, changed
    part, at = C.take_rows(cp, off, rows)
    old, old_at = part, at
    if t.mapped[part].any():
        size = t.size[part].astype(np.int64)
        flat = np.concatenate((t.flat, part))
        start = np.where(t.mapped[part], t.start[part], np.arange(len(part)) + len(t.flat))
        part, at, _ = C.expand(part, at, size, start, flat)
    part = _alphabets(t, part, at)  # before composition: a look-alike base takes the marks of its twin
    part, at = _nfc(t, part, at)
    part, at = _sequences(part, at)
    part = _kana(t, part, at)
    longer = np.diff(at) != np.diff(old_at)
    differs = longer.copy()
    rest = np.flatnonzero(~longer)
    if len(rest):
        a, a_at = C.take_rows(part, at, rest)
        b, _ = C.take_rows(old, old_at, rest)
        bad = np.concatenate(([0], np.cumsum(a != b)))
        differs[rest] = np.diff(bad[a_at]) > 0
    changed[rows] = differs
    if not differs.any():
        return cp, off, changed
    # Put the changed rows back among the others.
    size = np.diff(off)
    size[rows] = np.diff(at)
    new = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=new[1:])
    start = off[:-1].copy()
    start[rows] = len(cp) + at[:-1]
    source = np.arange(new[-1], dtype=np.int64) + np.repeat(start - new[:-1], size)
    return np.concatenate((cp, part))[source], new, changed


def without_blanks(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The batch without blanks and line breaks."""
    return C.keep(cp, off, ~tables().blank[cp])
