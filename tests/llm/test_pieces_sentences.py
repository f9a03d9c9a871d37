import random

import pytest

from inkwell.llm.pieces import Boundaries, cut, split_texts
from inkwell.llm.sentences import SentenceAutomaton, split_sentences


def test_range_maximum_against_brute_force():
    rnd = random.Random(1)
    text = "".join(rnd.choice(["a", "b ", "c. ", "d\n\n", "e"]) for _ in range(400))
    marks = Boundaries(text)
    strength = {p: marks.strongest(p, p)[1] for p in marks.at}
    for _ in range(300):
        low, high = sorted((rnd.randrange(len(text)), rnd.randrange(len(text))))
        inside = [(s, p) for p, s in strength.items() if low <= p <= high]
        want = max(inside, default=None)
        assert marks.strongest(low, high) == (want and (want[1], want[0]))


@pytest.mark.parametrize("text", ["", "x", "word " * 900, "a" * 9000, "Long sentence here. " * 400, ("para one.\n\n" + "p" * 1700 + "\r\n\r\n") * 4, "汉字。" * 2000, "\n" * 5000])
def test_pieces_reassemble(text):
    pieces = cut(Boundaries(text), 2000, 200)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= 2000 for a, b, _ in pieces)
    assert all(a2 == b - 200 for (_, b, _), (a2, _, _) in zip(pieces, pieces[1:]))
    assert text[: pieces[0][1]] + "".join(text[b - 0 : d] for (_, b, _), (_, d, _) in zip(pieces, pieces[1:])) == text


def test_stretches_change_nothing(monkeypatch):
    rnd = random.Random(6)
    text = "".join(rnd.choice(["word ", "End. ", "para\n\n", "x" * 30]) for _ in range(9000))
    whole = cut(Boundaries(text), 100, 10)
    monkeypatch.setattr("inkwell.llm.pieces.STRETCH", 7)
    assert cut(Boundaries(text), 100, 10) == whole and len(whole) > 500


def test_cuts_prefer_strong_boundaries():
    text = "First one. " * 100 + "\n\n" + "Second one. " * 100
    assert cut(Boundaries(text), 2000, 200)[0][1:] == (1102, 3)
    assert {s for _, _, s in cut(Boundaries("word " * 2000), 2000, 200)[:-1]} == {1} and {s for _, _, s in cut(Boundaries("x" * 5000), 2000, 200)[:-1]} == {0}


def test_paragraphs():
    text = " \t\n  a b \r\n c \r\n\r\n\xa0\n\rd\r\re\nf"
    assert [text[a:b] for a, b in Boundaries(text).paragraphs()] == ["a b \r\n c", "d", "e\nf"]
    assert list(Boundaries("").paragraphs()) == [] == list(Boundaries(" \n\xa0\n").paragraphs())


def test_oversized_paragraphs_come_from_the_boundaries(monkeypatch):
    rnd = random.Random(8)
    for _ in range(40):
        text = "".join(rnd.choice(["word ", "End. ", "\n\n", "\r\n \xa0\n", "x" * 30, "\n"]) for _ in range(300))
        marks = Boundaries(text)
        assert marks.oversized(60) == [n for n, (a, b) in enumerate(marks.paragraphs(), 1) if b - a > 60]
    monkeypatch.setattr(Boundaries, "strongest", lambda self, low, high: (high, 3))
    assert Boundaries("x" * 5000).oversized(2000) == []


def test_piece_frame(spark):
    df = spark.createDataFrame([(1, "s\n\n" + "y" * 2001 + "\n\n" + "z" * 2000, 0), (2, None, 0), (3, "", 0)], "key bigint, text string, piece int")
    rows = split_texts(df).collect()
    assert [r.oversized for r in rows if r.key == 1 and r.piece_no == 1] == [[2]] and {r.key for r in rows} == {1, 3}
    assert all(r.piece is None for r in split_texts(df, with_text=False).collect())
    with pytest.raises(ValueError):
        split_texts(df, 100, 100)


@pytest.mark.parametrize("units", [
    ["He met Dr. Smith at 9 a.m. on Monday, i.e. before noon.", "It cost 3.14 million, etc. in all.", "Was it so?!", "They waited ... and left."],
    ["The last bus left at 9 p.m.", "A new one came.", "See fig. 3 and vol. 2, p. 7 of it.", "No. 5 was here.", "It measured 2.5 by 3.5 m.", "Its end."],
    ['"The grain is gone!" cried Tom.', 'He noted: "It was dry."', 'The clerk asked, "Is it closed?" and left.', "(The old one was sold.)", "Next (cf. sec. 5) came."],
    ["M. Dupont a vu 2,5 m, soit 3 % de plus que Mme. Petit.", "« Le mur est sombre ! » dit Jean en partant.", "Il attendit... puis rien.", "Au IIe s. av. J.-C. par Paul."],
    ["Am 25. Mai 1825 wurde z. B. das Tor von Dr. Maier bemalt.", "„Das war alt!“, rief Karl laut.", "Es stieg um 5 Mio. Taler, d. h. um ca. 4 Prozent.", "Salz, Wolle usw.", "Nach dem Brand."],
    ["El Sr. Gil y la Dra. Paz vieron la pág. 29 del tomo.", "«¡Qué modesto!», dijo al salir.", "¿Fue vendido?"],
    ["В 1976 г. порт был обновлён, т. е. почти на 5 м.", "«Где рынок?» — спросил он и ушёл.", "См. рис. 5 и стр. 7."],
    ["यह पुराना पुल है।", '"पुल कहाँ है?" उसने पूछा।', "डॉ. Rao ने मापा।"], ["هل كان مغلقا؟", "«أين السوق؟» سأل الحارس ثم مضى.", "زار د. Ali السوق."],
])
def test_units(units):
    for glue in (" ", "\n"):
        text = glue.join(units)
        ends = SentenceAutomaton().ends(text)
        found, begin = [], 0
        for end in ends:
            found.append(text[begin:end].strip())
            begin = end
        assert found == units


@pytest.mark.parametrize("units", [
    ["他们等了很久……终于到了。", "“果园已经测量了。”守门人说。", "书中写道：“集市很古老。”", "高26.32米！", "真的吗？"],
    ["彼は「果樹園を見たか？」と尋ねた。", "「もう売れた。」と述べた。", "高さは3.5メートル。"],
])
def test_scripts_without_spaces(units):
    text = "".join(units)
    begin, found = 0, []
    for end in SentenceAutomaton().ends(text):
        found.append(text[begin:end])
        begin = end
    assert found == units


def test_thai_blank_lines_and_edges():
    ends = lambda t: [t[:e].split("|")[-1] for e in SentenceAutomaton().ends(t)]
    text = "สะพานหินในปี พ.ศ. 1811 สะพานสูง40.97เมตร ตลาด"
    assert [text[:e] for e in SentenceAutomaton().ends(text)] == ["สะพานหินในปี พ.ศ. 1811", "สะพานหินในปี พ.ศ. 1811 สะพานสูง40.97เมตร", text]
    assert SentenceAutomaton().ends("Head\n \nA b\nc. D \r\n\r\ncut off wh") == [4, 13, 15, 30]
    assert SentenceAutomaton().ends("") == [] == SentenceAutomaton().ends(" \n\n ") and ends("no stop at all") == ["no stop at all"]
    assert SentenceAutomaton().ends('He said "never closed. A b.\n\nNext one. Last') == [22, 27, 38, 43]
    assert len(SentenceAutomaton().ends("Red cat. " * 20_000)) == 20_000


@pytest.mark.parametrize("units", [
    ["He left (as usual.", "It rained.", "Then he slept.", "The end."],
    ['The board is 5" wide.', "It is old.", "“Never closed.", "So it goes (on and on."],
    ["It was (so he said (twice. Or more.) to me.", "Then he went.", 'The "best" was 6" long.', '"All of it. Now!" he cried.'],
    ["„Das ist (so. Ja.) klar“, sagte er.", "Er ging.", "Man sah 「nichts.", "Ende."],
])
def test_unclosed_marks_swallow_nothing(units):
    text, begin, found = " ".join(units), 0, []
    for end in SentenceAutomaton().ends(text):
        found.append(text[begin:end].strip())
        begin = end
    assert found == units


def test_list_levels():
    text = "We need:\n1. red apples. Ripe ones.\n  1. two kilos\n  2. or three.\n2. pears.\n\n3. plums\n\nIn\n1976. That was it. It was in\n3. So."
    begin, found = 0, []
    for end in SentenceAutomaton().ends(text):
        found.append(text[begin:end].strip())
        begin = end
    assert found == ["We need:\n1. red apples.", "Ripe ones.", "1. two kilos\n  2. or three.", "2. pears.", "3. plums", "In\n1976.", "That was it.", "It was in\n3.", "So."]


def test_long_tokens_and_many_marks_take_linear_time():
    assert SentenceAutomaton().ends("a." * 200_000 + " B c.") == [400_005] or SentenceAutomaton().ends("a." * 200_000 + " B c.")[-1] == 400_005
    assert SentenceAutomaton().ends("(" * 100_000 + " x. Y z.")[-1] == 100_008


def test_sentence_frame(spark):
    df = spark.createDataFrame([(1, " An ox. So do! ", 1), (2, None, 1), (3, "", 1), (1, " An ox. So do! ", 1)], "doc_id bigint, text string, sent_no int")
    rows = sorted(tuple(r) for r in split_sentences(df).collect())
    assert rows == sorted(2 * [(1, 1, 2, 7, "An ox."), (1, 2, 9, 14, "So do!")])
    assert split_sentences(df.limit(0)).count() == 0
