import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm import codepoints as C
from caseloom.llm import forms
from caseloom.llm import regular as R


def form(*texts):
    cp, off = C.from_arrow(pa.array(texts, pa.string()))
    a, b, changed = R.regular(cp, off)
    return C.to_arrow(a, b).to_pylist(), changed.tolist()


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_round_trip(texts):
    cp, off = C.from_arrow(pa.array(texts, pa.string()))
    assert C.to_arrow(cp, off).to_pylist() == texts


POOL = [chr(c) for r in ((0x41, 0x5B), (0xC0, 0x180), (0x300, 0x330), (0x391, 0x3CA), (0x410, 0x450), (0x905, 0x940), (0x1E00, 0x1EF9), (0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3), (0x3046, 0x3070)) for c in range(*r) if unicodedata.category(chr(c)) != "Cn"] + ["\u0323", "\u0301", "\u0308", "\u3099", "\u093c"]


@given(st.lists(st.text(st.sampled_from(POOL), max_size=12), max_size=6))
@settings(max_examples=150, deadline=None)
def test_composition_is_nfc(texts):
    # Canonical one-to-one changes come from the mapping step; composition is compared on text without them.
    texts = ["".join(x for x in t if unicodedata.normalize("NFC", x) == x) for t in texts]
    cp, off = C.from_arrow(pa.array(texts, pa.string()))
    got = C.to_arrow(*R._nfc(R.tables(), cp, off)).to_pylist()
    assert got == [unicodedata.normalize("NFC", t) for t in texts]


@pytest.mark.parametrize(
    "bad, good",
    [
        ("Ｌenmor １２", "Lenmor 12"), ("oﬀ", "off"), ("⼯地", "工地"), ("金", "金"), ("ﾀｲﾔ ｶﾞ", "タイヤ ガ"),
        ("é", "é"), ("が", "が"), ("a​b­c﻿", "abc"), ("a b　c d", "a b c d"), ("Tonrіm", "Tonrim"), ("GΒМ", "GBM"),
        ("Грaч", "Грач"), ("船エ赵", "船工赵"), ("路ロ的", "路口的"), ("ニ、证", "二、证"), ("第ニ、三项", "第二、三项"),
        ("เเป", "แป"), ("Talpе́rin", "Talpérin"),
    ],
)
def test_regular_forms(bad, good):
    out, changed = form(bad)
    assert out == [good] and changed == [True]


@pytest.mark.parametrize("text", ["", "   ", "（甲），：！？；", "№ 7 ℃ §", "a  b ", "a\nb\r\n", "Дом house", "РСТ-1", "菱本ニカハ、タイヤ46個", "น้ำ", "菱崎ナミは", "バッテリー", "梶谷トニ", "榊原ハタ", "鷹尾ニカ", "被告人梶谷トニ、榊原ハタ"])
def test_regular_already(text):
    assert form(text) == ([text], [False])


def test_rows_do_not_touch():
    # A mark, a vowel or a letter at the start of a row has nothing before it.
    texts = ["e", "\u0301a", "\u0e40", "\u0e40", "Ab", "\u0441"]
    assert form(*texts)[0] == texts


def test_frames(spark):
    rows = spark.createDataFrame([(1, "Ａ", None, "x"), (2, None, "a​b", "y"), (3, "", " ", "z"), (4, "plain", "　", "q"), (1, "Ａ", "ok", "x")], "ref_no bigint, facts string, target_person string, field string")
    found = forms.irregular_values(rows, "ref_no", ["facts", "target_person"])
    assert sorted(map(tuple, found.collect())) == [(1, "facts"), (1, "facts"), (2, "target_person")]
    out = {(r.ref_no, r.field): (r.facts, r.target_person) for r in forms.regular_columns(rows, ["facts", "target_person"]).collect()}
    assert out[(1, "x")][0] == "A" and out[(2, "y")] == (None, "ab") and out[(3, "z")] == ("", " ")
    assert forms.irregular_values(rows.limit(0), "ref_no", ["facts", "target_person"]).count() == 0


def test_long_text():
    text = "\uff41" * 300_000
    out, changed = form(text, "b")
    assert out == ["a" * 300_000, "b"] and changed == [True, False]
    assert np.array_equal(C.take_rows(*C.from_arrow(pa.array(["ab", "", "c"])), np.array([2, 0]))[1], [0, 1, 3])
