import os
import random

import numpy as np
import pyarrow as pa
import pytest

from caseloom.llm import codepoints as C
from caseloom.llm import sentences as S


TRAINED = None


def trained():
    """A model that knows the units below by nothing but the line ends of some of them."""
    global TRAINED
    if TRAINED is None:
        rng = random.Random(1)
        texts = []
        for units in [*CASES, THAI]:
            glue = "" if any("\u3000" < ch for ch in units[0]) else " "
            texts += ["".join(x for _ in range(9) for x in (rng.choice(units), rng.choice(("\n", glue, glue, glue)))) for _ in range(250)]
        TRAINED = S.train(texts)
    return TRAINED


def split(text, model=None):
    model = model or trained()
    cp, off = C.from_arrow(pa.array([text], pa.string()))
    _, a, b = S.units(cp, off, model)
    return [text[x:y] for x, y in zip(a, b)]


CASES = [
    ["One ended at 4:53 a.m.", "Exhibit No. 13 (see vol. 4, p. 8.) weighs 3.25 kg."],
    ["Mr. Hale of Fenn told me, \"I left at 3:43. I never saw Osk!\"", "J. R. Smith v. Doe paid Haulage Inc. twice."],
    ['"Who took the tyres?" Faylor asked the keeper.', "It was approx. 25.3 miles, i.e. far."],
    ["Am 13. November ging Dr. Hal um 18.09 Uhr, z. B. mit Akkus usw.", "Gegen 4.10 Uhr kam ca. einer.", "„Wer war es?“, fragte er den Käufer höflich.", "Der Wächter sagte: „Ich ging um 2.03 Uhr. Rau war nicht da!“", "Halt!"],
    ["Selon l'art. 28 al. 5 il doit 7,5 euros.", "Savait-il que XK-1 manquait ?", "M. Nor a dit : « Je suis parti à 0 h 57. Je n'ai pas vu Fau ! »", "On a trouvé 4 bidons, etc.", "Le Dr Gué a lu 3,5."],
    ["26 мая 2021 г. Зор взял CVK-9 и т. д.", "Предмет № 3 (см. т. 7, л. д. 4.) найден у ул. Реки, д. 8, т. е. в 2,5 км.", "13 мая он сказал: «Я ушёл в 7:29. Там был Бор!»", "«Кто взял?» — спросил Сит."],
    ["经查，数量为3.5千克。", "他称：“那天我在。我没碰过！你们去问。”", "“是谁？”邻居问，没有作答。", "听见有人喊“站住！别跑！”，随后走了；", "No.8号收条（详见第4卷。）在此！？"],
    ["「誰が出したのか？」と彼は尋ねた。", "彼は「出た。見ていない！」と述べた；", "証拠は1.5kgで、見つかった。"],
    ["गवाह ने कहा, \"मैं गया। वह नहीं था!\"", "डॉ. काता को रु. 500 मिले।", "वस्तु सं. 6 (पृ. 3 देखें।) मिली।"],
]


THAI = ["นายสมชาย ใจดีเห็น 3 คนตั้งแต่เวลา 12.51 น. จนถึง 20.13 น. ของวันนั้น", "เมื่อวันที่ 4 มีนาคม พ.ศ. 2559 ผู้ต้องหาขายรหัส KFD-1 แล้วหนี", "ทนายยืมเงินไป"]


@pytest.mark.parametrize("units", CASES)
def test_units(units):
    cjk = any("　" < ch for ch in units[0])
    for glue in ("" if cjk else " ", "\n", "  "):
        assert split(glue.join(units)) == units


def test_thai():
    assert split(" ".join(THAI)) == THAI
    # What a blank touches and which one follows a title is learned from stripped line ends alone.
    assert len(split(" ".join(THAI), S.Model())) > 8


def test_places_and_blanks():
    text = "  Title\n\n​One​. 　Two?!​\n \n"
    cp, off = C.from_arrow(pa.array([None, text, "", " \n ", "x"], pa.string()))
    row, a, b = S.units(cp, off)
    assert row.tolist() == [1, 1, 1, 4]
    assert [text[x:y] for x, y in zip(a[:3], b[:3])] == ["Title", "​One​.", "Two?!​"]


def test_nothing_is_lost_in_long_text():
    text = "Wort ohne Ende " * 20_000 + "Schluss." + "“" * 5000
    assert "".join(split(text)) == text


def test_unclosed_quote_hides_nothing():
    assert split("He said \"go. Then he left. \nDone.") == ["He said \"go.", "Then he left.", "Done."]


def first(bare, j):
    """The candidate that the bare run of j began with."""
    while j > 0 and bare[j]:
        j -= 1
    return j


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        odds, bare = rng.normal(0, 3, n), rng.random(n) < 0.4
        bare[0] = False
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        moves = rng.normal(0, rng.choice((0.1, 2)), (2, 2))
        best, want = -np.inf, None
        for bits in range(1 << n):
            tag = [(bits >> i) & 1 for i in range(n)]
            shut, late, bad = bool(tag[0]), 0, False
            for i in range(1, n):
                shut = shut and bool(bare[i])
                late, bad = late + shut, bad or (shut and tag[i])
                shut = shut or bool(tag[i])
            if bad:
                continue
            score = sum(yes[i] if tag[i] else no[i] for i in range(n)) - S.LATE * late
            shut = False
            for i in range(1, n):
                shut = bool(bare[i]) and (shut or bool(tag[i - 1]))
                if not shut:  # a candidate behind a bare run comes from the tag the run began with
                    j = i - 1
                    while j > 0 and bare[j] and not tag[j] and any(tag[k] for k in range(first(bare, j), j)):
                        j -= 1
                    score += moves[tag[j], tag[i]]
            if score > best:
                best, want = score, tag
        got = S.viterbi(odds, np.zeros(n, np.int64), 1, bare, moves)
        assert got.tolist() == [bool(x) for x in want]


def test_training_decides():
    # An abbreviation that no list holds, learned from its places before small letters; the untrained model cuts behind it.
    texts = ["Er kam bspw. heute und ging. Er blieb lange.\nDas Ende kam. Es war spät."] * 60 + ["Das Ende.\nUnd der Anfang. Er ging."] * 60
    model = S.train(texts)
    assert split("Er kam bspw. Heute ging er.", S.Model()) == ["Er kam bspw.", "Heute ging er."]
    assert split("Er kam bspw. Heute ging er.", model) == ["Er kam bspw. Heute ging er."]
    # One that always stands before a capital, never at a line end.
    rng = random.Random(2)
    parts = ["Der Zeuge Hptm. Alt kam.", "Der Zeuge Hptm. Bern lief.", "Er ging.", "Sie blieb.", "Dann war Ruhe.", "Es wurde Nacht."]
    texts = ["".join(rng.choice(parts) + rng.choice(("\n", " ", " ", " ", " ")) for _ in range(8)) for _ in range(150)]
    model = S.train(texts)
    assert split("Auch Hptm. Dorn kam. Er ging.", S.Model()) == ["Auch Hptm.", "Dorn kam.", "Er ging."]
    assert split("Auch Hptm. Dorn kam. Er ging.", model) == ["Auch Hptm. Dorn kam.", "Er ging."]


def test_without_line_ends_lists_decide():
    model = S.train(["Mr. Hale left. He ran."] * 500)
    assert split("Mr. Hale left. He ran.", model) == ["Mr. Hale left.", "He ran."] and split("Mr. Hale", S.Model()) == ["Mr.", "Hale"]
    assert np.array_equal(S.train([]).weights, S.listed_model().weights)


DATA = "/root/testdata/sf0.01/train_references.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_held_out_line_ends():
    # Trained on one half of the records: stripped line ends of the other half are boundaries, points known to be inside aren't.
    import pyarrow.parquet as pq

    texts = pq.read_table(DATA, columns=["facts"])["facts"].to_pylist()
    model = S.train(texts[::2])
    t, place, features, ended, inside = S.examples(texts[1::2])
    assert ended.sum() > 500 and inside.sum() > 1000
    odds = S.emissions(features, model.weights)
    assert (odds[ended] > 0).mean() > 0.995 and (odds[inside] < 0).mean() > 0.999
    assert (S.emissions(features, S.Model().weights) > 0).sum() > 1.3 * (odds > 0).sum()


def test_frame(spark):
    rows = spark.createDataFrame([(1, "A b. C d.", 9), (2, None, 9), (3, " ", 9)], "ref_no bigint, facts string, start_pos int")
    assert sorted(map(tuple, S.sentence_units(rows, "ref_no", "facts").collect())) == [(1, 0, 4), (1, 5, 9)]
    assert S.sample(rows, "ref_no", "facts", 10) and S.sentence_units(rows.limit(0), "ref_no", "facts").count() == 0
