import pytest

from inkwell.llm.markup import KINDS, clean, inherit, judge, kinds_of, read_blocks, regions, shape, strip_markup
from inkwell.llm.quality import STATES, label_lines, read_lines, statistics, text_quality

PROSE = "The old mill stands by the river, and it was built in 1850. Nobody in the town knew who had owned it before the war."


@pytest.mark.parametrize("text, kinds", [
    ("plain text with a < b and c > d, 5 * 6 * 7, R&D, C#, [sic], (a, b) or [a, b], a == b or a != b.", []),
    ("The folder D:\\maps\\towns, column the_old_id, item #5 sold for $44 rather than $7, -- or so.", []),
    ("* one\n- two\n1. three\n\na | b | c\n1 | 2 | 3", []),
    ("a<br/>b", ["html"]), ("x <div class=\"note\"", ["html"]), ("a &amp; b", ["html"]), ("a&#8211;b", ["html"]), ("<!-- x", ["html"]),
    ("[[a|b]]", ["wiki"]), ("see [[a", ["wiki"]), ("{{cite}}", ["wiki"]), ("''a'' b", ["wiki"]), ("== A ==\ntext", ["wiki"]), ("__NOTOC__", ["wiki"]), ("[https://a.test b]", ["wiki"]),
    ("{| class=\"x\"\n|-\n| 1 || 2\n|}", ["wiki"]),
    ("**a** b", ["markdown"]), ("[a](https://b.test/c)", ["markdown"]), ("![a](b.png)", ["markdown"]), ("end.[^3]", ["markdown"]), ("# Head\n\ntext", ["markdown"]),
    ("Head\n====\n\ntext", ["markdown"]), ("a `b` c", ["markdown"]), ("~~a~~ b", ["markdown"]), ("| a | b |\n|---|:--:|\n| 1 | 2 |", ["markdown"]), ("```\nx\n```", ["markdown"]),
    ("text.\n==== A ====\nmore", ["wiki"]), ("Head\n===\n\ntext", ["markdown"]), ("==== Long\nhead ====\n\ntext", ["wiki"]), ("==== <b\nid='x'>A</b>\n====", ["html"]),
    ("A test such as a ==\nb or a != b was made.", []), ("a\n== b or a != b was made. A test such as a == b", []),
    ("$a_1 + b^2 = \\alpha$ holds", ["latex"]), ("\\emph{a", ["latex"]), ("see~\\cite{a1}", ["latex"]), ("\\(x \\leq 2\\)", ["latex"]), ("\\begin{equation}\nx\n\\end{equation}", ["latex"]),
    ("<b>[[a]]</b> **c** \\textbf{d}", ["html", "wiki", "markdown", "latex"]), ("", []),
])
def test_kinds(text, kinds):
    assert kinds_of(text) == kinds
    assert kinds_of(text.replace("\n", "\r\n")) == kinds


def test_clean_keeps_structure():
    text = "== Old ==\n\n'''Big''' [[Lake|lake]] &amp; <b>sea</b>.<!-- x --> {{cite}} See [map](http://a.test/b)~\\cite{k1}.\n\n<ul><li>one</li><li>two</li></ul>\n\n{| class=\"w\"\n! a !! b\n|-\n| 1 || 2\n|}\n\n```\nlet x = [[1]]\n```\n\nHere $a_1 = \\alpha$ holds.\n\n[[Category:Lakes]]"
    got = clean(text)
    for kept in ("## Old", "Big lake & sea.", "See map.", "- one\n- two", "| a | b", "| 1 | 2", "let x = [[1]]", "$a_1 = \\alpha$"):
        assert kept in got
    for gone in ("'''", "Category", "cite", "<", "wikitable"):
        assert gone not in got
    assert clean("") == "" and clean(PROSE) == PROSE


def test_two_passes():
    assert judge(PROSE + PROSE, 0.0) == "good" and judge("word " * 40, 0.0) == "bad" and judge("Short", 0.0) == "" and judge(PROSE, 0.9) == "bad" and judge("Слово за словом в этом городе." * 3, 0.0) == "good" and judge("这座桥很古老。" * 20, 0.0) == ""
    assert inherit(["", "good", "", "", "bad", ""]) == ["good", "good", "good", "bad", "bad", "bad"]
    assert inherit(["good", "", "bad"]) == ["good", "good", "bad"] and inherit(["", ""]) == ["good", "good"] and inherit([]) == []


def test_markup_frame(spark):
    df = spark.createDataFrame([(1, "# A\n\n" + PROSE, "x"), (2, None, "y"), (3, "", "z"), (1, "# A\n\n" + PROSE, "x")], "key bigint, text string, kinds string")
    rows = strip_markup(df).collect()
    assert sorted(r.key for r in rows) == [1, 1, 3]
    one = next(r for r in rows if r.key == 1)
    assert [b.kind for b in one.blocks] == ["heading", "prose"] and one.kinds == ["markdown"]
    assert strip_markup(df.limit(0)).count() == 0


NAVIGATION = [
    "[[Old mill|Mill]] [[River]] [[Town hall]] and [https://a.test/x the map of it]", "<a href='/a'>The mill and the river</a> or <a href='/b'>the hall in the town</a>",
    "[Mill](http://a.test/m) · [River](http://a.test/r) · [Town](http://a.test/t)", "* [[Mill]]\n* [[River]]", "https://a.test/mill https://a.test/river",
]


@pytest.mark.parametrize("block", NAVIGATION)
def test_link_block_inside_prose_is_bad(spark, block):
    text = f"{PROSE} {PROSE}\n\n{block}\n\n{PROSE} See the [[mill]]. {PROSE}"
    (row,) = strip_markup(spark.createDataFrame([(1, text)], "key bigint, text string")).collect()
    assert [b.label for b in row.blocks] == ["good", "bad", "good"] and row.clean == clean(text) == f"{PROSE} {PROSE}\n\n{PROSE} See the mill. {PROSE}"
    assert row.kinds == [k for k in KINDS if any(k in b.kinds for b in row.blocks)]
    assert not {"\x04", "\x05"} & set(row.clean)


def test_prose_among_many_links_stays_good(spark):
    text = "\n\n".join([NAVIGATION[0]] * 5 + [PROSE + " " + PROSE] + [NAVIGATION[1]] * 5)
    (row,) = strip_markup(spark.createDataFrame([(1, text)], "key bigint, text string")).collect()
    assert [b.label for b in row.blocks] == ["bad"] * 5 + ["good"] + ["bad"] * 5


@pytest.mark.parametrize("size", [1, 6_000, 60_000, 1_000_000])
def test_nothing_depends_on_size(size):
    """Scripts, references, code and formulas of any length are treated alike."""
    many = "let a = 1;\n\n" * max(1, size // 12)
    got = clean(f"{PROSE} {PROSE}\n\n<script>{many}</script>\n\n{PROSE}<ref>{'x ' * size}</ref> {PROSE}")
    assert got == f"{PROSE} {PROSE}\n\n{PROSE} {PROSE}"
    assert clean(f"<pre>**{many}</pre>") == "**" + many.strip("\n") == clean(f"```js\n**{many}```")
    formula = "$a_1 " + "+ b " * size + "$"
    assert clean(f"Here {formula} holds.") == f"Here {formula} holds." and kinds_of(formula) == ["latex"]
    assert kinds_of("== " + "word " * size + "==") == ["wiki"] and clean("{{a {{b}} " + "c\n\n" * size + "}}x") == "x"


@pytest.mark.parametrize("text", ["<!--", "<pre>", "{{", "$a", "\\(", "\\begin{align}", "==", "```", "<h1>", "`", "[[", "&lt;", "<ref>", "\n---", "''"])
def test_unclosed_marks_take_linear_time(text):
    clean(text * 30_000)


def test_inline_code_stays():
    assert clean(f"{PROSE} Write `code **x** and [[y]]` there. {PROSE}") == f"{PROSE} Write code **x** and [[y]] there. {PROSE}"


@pytest.mark.parametrize("tag", ['<div class="note"', "<div", '<div class="note" id=x', '<div\nclass="note"', "</div"])
def test_words_behind_a_broken_tag_stay(tag):
    for room in (" ", "\n"):
        assert clean(f"{PROSE} {tag}{room}{PROSE}").split() == f"{PROSE} {PROSE}".split()
    assert clean(f"{PROSE} {tag}\n<ul><li>one</li><li>two</li></ul>").split() == [*PROSE.split(), "-", "one", "-", "two"]


def test_closed_tags_go_with_all_their_attributes():
    assert clean('a <input checked disabled>b <span title="x > y" hidden lang=en/>c') == "a b c"


@pytest.mark.parametrize("text", ["<b w x=<b ", '<b w x="<b\n', '<b x=" ', "<b w=\"<b w=' ", "<div a b c x=\"y\" "])
def test_broken_attributes_take_linear_time(text):
    clean(text * 30_000)


def test_regions_are_apart_and_in_order():
    text = "{{a {{b}} <!-- c --> d}} ``` x {{ ``` <ref name=q/> <ref>r</ref> $$ y $$ {{ <!-- z"
    found = regions(text)
    assert [(text[a:b][:6], what) for a, b, what, _, _ in found] == [("{{a {{", "drop"), ("``` x ", "code"), ("<ref>r", "drop"), ("$$ y $", "formula"), ("<!-- z", "drop")]
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_kinds_and_clean_text_come_from_the_blocks(monkeypatch):
    text = f"{PROSE} {PROSE}\n\n{NAVIGATION[0]}\n\n<b>{PROSE}</b> {PROSE}"
    kinds, whole, blocks = read_blocks(text)
    assert kinds == ["html", "wiki"] and [b[2] for b in blocks] == [[], ["wiki"], ["html"]] and whole == "\n\n".join(b[3] for b in blocks if b[1] == "good")
    monkeypatch.setattr("inkwell.llm.markup.split_raw", lambda text: [])
    assert read_blocks(text) == ([], "", [])


@pytest.mark.parametrize("block, kind", [("a    b    c\n1    2    3", "table"), ("a,b,c\n1,2,3", "table"), ("one two, three, four, five six, seven, eight,", "list"), ("# Head", "heading"), ("$a_1$", "formula"), ("f();\ng();", "code")])
def test_shapes(block, kind):
    assert shape(block) == kind


LONG = " ".join(f"The mill number {i} stands by the river, and it was built in {1800 + i} for a guild of {'abcdefghij'[i % 10] * 4}ers." for i in range(20))
LIST = "\n".join(f"* word{i} thing" for i in range(20))
TABLE = "\n".join(f"a{i} | {i}.5 | x{i} | -" for i in range(20))
JUNK = "\n".join(c * 40 for c in "!^@+.?" * 3)


@pytest.mark.parametrize("text, state", [(LIST, "list"), (TABLE, "table"), (JUNK, "junk"), (LONG, "prose"), ("What survives tod\n" * 20, "junk"), ("cat dog " * 60, "junk"),
                                         ("\n\n".join(f"Name{i} (18{i}-19{i})" for i in range(10, 25)), "list"), (TABLE.replace(" | ", "\t"), "table"), (TABLE.replace(" | ", ","), "table")])
def test_labels(text, state):
    shares = dict(zip(STATES, statistics(text)[5:9]))
    assert max(shares, key=shares.get) == state and shares[state] > 0.9
    assert statistics(text)[9] == (state == "prose")


def test_markup_between_sentences_and_wraps_stay_prose():
    wrapped = PROSE.replace(" ", "\n", 40)
    assert statistics(f"{PROSE}\n\n```\nlet x = 1\nf()\n```\n\n<b>{PROSE}</b>\n\n== Head ==\n\n{PROSE} [[Category:A]]")[9]
    assert statistics(PROSE[:60] + "\n" + PROSE[60:])[9] and statistics(wrapped)[0] == statistics(PROSE)[0]
    assert not statistics(PROSE + "\n\n" + LIST)[9] and statistics(LONG + "\n\n" + LIST)[9]


def test_lists_in_one_line_and_numbers_that_go_on():
    inline = "; ".join(f"({c}) dry mill{c}, 18{i:02}" for i, c in enumerate("abcdefghij"))
    assert statistics(inline)[6] == 1.0 and not statistics(PROSE[:60] + "\n\n" + inline)[9]
    assert statistics("The mill (cf. sec.\n85) stands by the river, and it was built in\n27. It was the first of its kind, and the best of them.")[9]
    assert not statistics("The list:\n1. the mill of it\n2. the river\n3. the town of old\n4. the bridge and the hall")[9]


def test_prose_of_other_languages():
    for text in (
        "Le vieux moulin se trouve sur la rive, et il a été construit en 1850 par les moines. Personne ne sait qui était dans la ville avant la guerre. Les gens de la ville ont peur de lui.",
        "Die alte Mühle steht an dem Fluss, und sie wurde 1850 von den Mönchen gebaut. Niemand in der Stadt weiß, wer sie vor dem Krieg hatte. Das ist nicht gut für die Leute.",
        "El viejo molino está en la orilla del río, y fue construido por los monjes en 1850. Nadie en la ciudad sabe de quién era antes de la guerra. Los de la ciudad no lo quieren.",
    ):
        assert statistics(text)[9] and statistics(text)[5] == 1.0


def test_statistics_values():
    words, mean, symbols, ended, common, *_ = statistics("The cat is big.\nred, dog")
    assert (words, round(mean, 2), round(ended, 2), round(common, 2)) == (6, 2.83, 0.5, 0.33) and round(symbols, 3) == round(2 / 19, 3)
    assert statistics("")[0] == 0 and statistics(" \n ")[9] and label_lines(read_lines("")) == []


def test_quality_frame(spark):
    df = spark.createDataFrame([(1, PROSE, 9), (2, None, 9), (3, LIST, 9), (3, LIST, 9), (4, "x" * 300_000, 9)], "key bigint, text string, words int")
    assert sorted((r.key, r.prose) for r in text_quality(df).collect()) == [(1, True), (3, False), (3, False), (4, False)]
