"""Markup residue to clean text with its structure.

A scanner with a stack finds the pieces that hang together across lines (comments, scripts, references, templates, code,
formulas) in one walk over the text; outside of them blank lines part it into blocks. In each block the residue of HTML,
wiki, Markdown and LaTeX, whole or broken, is named and taken off; the converter marks where link texts begin and end, so
each block has a link density of its own. The blocks are then judged in two passes: stop-word density, length and link
density decide the clear ones; short or middling ones take the label of the nearest decided neighbours. What a text holds
is what its blocks hold, and its clean text is the blocks judged good.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from inkwell.functions.arrow import flat_map

KINDS = ("html", "wiki", "markdown", "latex")

# Element names of HTML and of wiki extensions; frequent small words of English.
TAGS = (
    "a abbr b blockquote body br big caption center cite code col colgroup dd del div dl dt em embed font footer form frame h1 h2 h3 h4 h5 h6 "
    "head header hr html i iframe img input ins kbd li link main math meta nav nowiki object ol option p pre ref references s samp script section "
    "select small source span strike strong style sub sup svg table tbody td textarea tfoot th thead title tr tt u ul var video gallery"
).split()
STOP_WORDS = frozenset(
    "a about after all also an and are as at be because been before being between but by can could did do each either for from had has have he her "
    "his how if in into is it its like many may more most near neither no nor not of on once one only or other over rather same several she since so "
    "some such than that the their them then there these they this those though through to under until up upon very was we were what when where which "
    "while who whose will with without would you your".split()
)
# The same of other languages in Latin and Cyrillic script.
OTHER_STOP_WORDS = frozenset(
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais même ne nous on ou où par pas pour qu que qui sa sans "
    "se ses son sont sous sur un une vous était aber als am auf aus bei das dass dem den der die ein eine einem einen einer er es für hat ich ihr im ist "
    "mit nach nicht noch oder sich sie sind über um und vom von vor war wie wird wurde zu zum zur al como con del el ella entre era ese esta fue ha las "
    "lo los más me muy o otro para pero por que se ser si sin sobre su sus también y ya ao com da das dos em foi mais na não nas no nos os uma che di "
    "gli i non per più una и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по ее мне было вот от о из ему был до или это "
    "был была были для при их".split()
) - STOP_WORDS

_NL = r"(?>\r\n|\r|\n)"
_RULES = {
    "html": rf"<!--|-->|<!(?i:doctype)|</?(?i:{'|'.join(TAGS)})(?![\w.:-])|&(?:[A-Za-z][A-Za-z0-9]{{1,31}}|#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}});|&(?:lt|gt|amp|nbsp|quot)(?![A-Za-z0-9=])|&#[0-9]{{2,6}}",
    "latex": r"(?<![\w:\\])\\[A-Za-z]+|\\[A-Za-z]+\{|\\[()\[\]]|\$\$",
    "markdown": rf"(?m:^[ \t]*#{{1,6}}[ \t]+(?=\S))|```|~~~|`[^`\r\n]+`|!\[[^\]\r\n]*\]\(|\[[^\[\]\r\n]+\]\((?=[^)\s]*[/.#])|\[\^[\w-]+\]|\*\*(?=\S)|(?<=\S)\*\*(?!\*)|~~(?=\S)"
    rf"|(?m:^[ \t]*\|?[ \t]*:?-{{2,}}:?[ \t]*(?:\|[ \t]*:?-{{2,}}:?[ \t]*)+\|?)|(?<=\S){_NL}[ \t]*(?:={{7,}}(?!=)|-{{5,}}(?![\w-]))",
    "wiki": r"\[\[|\]\]|\{\{|(?m:^[ \t]*\}\})|\{\||(?m:^[ \t]*\|[}-](?=\s|$))|'{2,5}(?=\S)|(?<=\S)'{2,5}|(?m:^[ \t]*(={2,6})[ \t]*[^=\s][^=]*?\s*\1(?!=))|__[A-Z]{4,}__|\[(?:https?:)?//[^\s\]]+(?:\s[^\]\r\n]*)?\]|(?m:^[ \t]*\*?[ \t]*#REDIRECT\b)",
}
_SCAN = {k: re.compile(v) for k, v in _RULES.items()}
#: Without any of these characters a text has no markup at all.
_SIGNS = re.compile(r"[<>&\\$#`!\[\]*~|={}'_-]")


def kinds_of(text: str) -> list[str]:
    """The kinds of markup in the blocks of text, in the order of KINDS."""
    found = {k for a, b, _ in split_raw(lines_of(text)) for k in block_kinds(lines_of(text)[a:b])}
    return [k for k in KINDS if k in found]


def lines_of(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def block_kinds(block: str) -> list[str]:
    """The kinds of markup in one block, in the order of KINDS."""
    if not _SIGNS.search(block):
        return []
    return [k for k in KINDS if _SCAN[k].search(block) or k == "markdown" and underlined(block) or k == "latex" and formulas(block)]


_UNDERLINE = re.compile(r"(?<=\S)\n[ \t]*(={3,6}|-{3,4})[ \t\xa0]*(?=\n|\Z)")


def underlined(block: str) -> bool:
    """Is a line of the block marked as a heading by a short line below it, which is not the end of a wrapped wiki heading?"""
    opened: dict[str, int] = {}
    for m in _UNDERLINE.finditer(block):
        sign = m.group(1)
        if sign not in opened:
            first = re.search(rf"^[ \t]*{sign}(?!=)", block, re.M)
            opened[sign] = first.start() if first else len(block)
        if opened[sign] >= m.start():
            return True
    return False


def formulas(block: str) -> list[tuple[int, int]]:
    """(start, end) of the formulas between single dollar signs: the first line of one has a sign of mathematics."""
    found, at = [], block.find("$")
    while at >= 0:
        end = block.find("$", at + 1)
        if end < 0:
            break
        if block[at + 1].isalpha() and block[at + 1].isascii() or block[at + 1] in "\\{(":
            line = block.find("\n", at, end)
            if _MATHS.search(block, at + 1, end if line < 0 else line):
                found.append((at, end + 1))
                end = block.find("$", end + 1)
        at = end
    return found


_MATHS = re.compile(r"[\\^_]")
_OPENER = re.compile(
    r"(?P<comment><!--)|<(?P<tag>script|style|pre|ref)\b[^<>]*(?<!/)>|(?P<fence>```|~~~)|(?P<dollars>\$\$)|(?P<display>\\\[)|(?P<inline>\\\()"
    r"|\\begin\{(?P<env>(?:equation|align|math|displaymath|verbatim|lstlisting)\*?)\}|(?P<open>\{\{)|(?P<shut>\}\})", re.I
)
_CODE_ENV = ("verbatim", "lstlisting")


def regions(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, what, inner start, inner end) of the pieces that hang together across lines, in order, none inside another.

    what: drop (comments, scripts, styles, references, templates), code or formula. One walk: openers without closer are
    no piece, but for fences and comments, which then reach to the end; templates nest, on a stack.
    """
    found: list[tuple[int, int, str, int, int]] = []
    stack: list[int] = []
    missing: set[str] = set()  # closers that don't occur any more
    at = 0
    while m := _OPENER.search(text, at):
        at, kind = m.end(), m.lastgroup
        if kind == "open":
            stack.append(m.start())
            continue
        if kind == "shut":
            if stack and not (begin := stack.pop(), stack)[1]:
                while found and found[-1][0] > begin:
                    found.pop()
                found.append((begin, at, "drop", at, at))
            continue
        name = (m.group("tag") or m.group("env") or "").lower()
        closer = {"comment": "-->", "fence": m.group(), "dollars": "$$", "display": "\\]", "inline": "\\)", "tag": f"</{name}>", "env": f"\\end{{{name}}}"}[kind]
        end = -1
        if closer not in missing:
            hit = re.compile(re.escape(closer), re.I).search(text, at)
            end = hit.start() if hit else -1
            if end < 0:
                missing.add(closer)
        if end < 0:
            if kind not in ("comment", "fence"):
                continue
            end, after = len(text), len(text)
        else:
            after = end + len(closer)
        if kind == "comment" or name in ("script", "style", "ref"):
            found.append((m.start(), after, "drop", at, at))
        elif kind == "fence":
            line = text.find("\n", at, end)  # what stands behind the opening fence names the language
            found.append((m.start(), after, "code", line + 1 if line >= 0 else at, end))
        elif name == "pre" or name.rstrip("*") in _CODE_ENV:
            found.append((m.start(), after, "code", at, end))
        else:
            found.append((m.start(), after, "formula", m.start(), after))
        at = after
    return found


def split_raw(text: str) -> list[tuple[int, int, list[tuple[int, int, str, int, int]]]]:
    """(start, end, the regions inside) of the blocks of text between blank lines that lie in no region."""
    pieces = regions(text)
    blocks, first, at = [], 0, 0
    for end, after in [*(m.span() for m in _ROOM.finditer(text)), (len(text), len(text))]:
        last = first
        while last < len(pieces) and pieces[last][1] <= end:
            last += 1
        if last < len(pieces) and pieces[last][0] < end:
            continue  # the blank line lies in a region
        if end > at:
            blocks.append((at, end, pieces[first:last]))
        first, at = last, after
    return blocks


#: Stand around link texts while markup is taken off.
_OPEN, _SHUT = "\x04", "\x05"
_STEPS = tuple(
    (re.compile(p, f), r)
    for p, f, r in (
        # wiki
        (r"\[\[(?:category|file|image):[^\[\]]*\]\]", re.I, ""),
        (r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", 0, rf"{_OPEN}\1{_SHUT}"),
        (r"\[\[([^\[\]|]*)\]\]", 0, rf"{_OPEN}\1{_SHUT}"),
        (r"\{\{[^{}]*\}\}", 0, ""),
        (r"^[ \t]*\{\|.*$", re.M, ""),
        (r"^[ \t]*\|\}.*$", re.M, ""),
        (r"^[ \t]*\|-.*$", re.M, ""),
        (r"^[ \t]*!(?!\[)[ \t]*(.+)$", re.M, lambda m: "| " + re.sub(r"\s*!!\s*", " | ", m.group(1))),
        (r"^([ \t]*\|.*\|\|.*)$", re.M, lambda m: re.sub(r"\s*\|\|\s*", " | ", m.group(1))),
        (r"^[ \t]*(={2,6})[ \t]*([^=\s][^=\n]*?)[ \t]*\1(?!=)", re.M, lambda m: "#" * min(6, len(m.group(1))) + " " + m.group(2)),
        (r"(?<!')'{2,5}(?!')", 0, ""),
        (r"__[A-Z]{4,}__", 0, ""),
        (r"\[(?:https?:)?//[^\s\]]+(?:\s+([^\]\n]*))?\]", 0, lambda m: _OPEN + m.group(1) + _SHUT if m.group(1) else ""),
        # Markdown
        (r"!\[([^\]\n]*)\]\([^)\s]*\)", 0, rf"{_OPEN}\1{_SHUT}"),
        (r"\[([^\[\]\n]+)\]\([^)\s]*[/.#][^)\s]*\)", 0, rf"{_OPEN}\1{_SHUT}"),
        (r"\[\^[\w-]+\]:?", 0, ""),
        (r"^(\S.*)\n[ \t]*(?:={3,}[ \t ]*$|={7,})", re.M, r"# \1"),
        (r"^(\S.*)\n[ \t]*(?:-{3,}[ \t ]*$|-{5,})", re.M, r"## \1"),
        (r"^[ \t]*+\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", re.M, ""),
        (r"\*\*(?=\S)|(?<=\S)\*\*(?!\*)|~~(?=\S)|(?<=\S)~~", 0, ""),
        # LaTeX
        (r"~?\\(?:cite|ref|label|footnote)\w*\{[^{}]*\}", 0, ""),
        (r"\\(?:sub)*section\*?\{([^{}\n]*)\}", 0, r"\n# \1\n"),
        (r"\\item\b[ \t]*", 0, "- "),
        (r"\\(?:begin|end)\{[^{}\n]*\}", 0, ""),
        (r"\\[A-Za-z]+\{([^{}]*)\}", 0, r"\1"),
        (r"(?<![\w:\\])\\[A-Za-z]+\{?", 0, ""),
        # what is left broken
        (r"\[\[|\]\]|\{\{|^[ \t]*\}\}", re.M, ""),
    )
)
#: The value of an attribute, as it should be and however broken.
_WHOLE_VALUE = r"(?:\"[^\"\n]*\"|'[^'\n]*'|[^\s<>\"'][^\s<>]*)"
_VALUE = r"(?:\"[^\"\n]*\"?|'[^'\n]*'?|[^\s>]+)"
_HTML_STEPS = tuple(
    (re.compile(p, re.I | re.S), r)
    for p, r in (
        (r"-->", ""),
        (r"<ref\b[^<>]*/>", ""),
        (r"<h([1-6])\b[^<>]*>\s*", lambda m: "\n" + "#" * int(m.group(1)) + " "),
        (r"</h[1-6]>", "\n"),
        (r"<li[^<>]*>\s*", "\n- "),
        (r"</t[dh]>\s*<t[dh][^<>]*>", " | "),
        (r"<t[dh][^<>]*>", "| "),
        (r"</t[dh]>", " |"),
        (r"</?(?:tr|br|p|div|ul|ol|table|tbody|blockquote|hr)\b[^<>\n]*>", "\n"),
        (r"(?=<a(?![\w.:-]))", _OPEN),
        (r"(?=</a(?![\w.:-]))", _SHUT),
        # of a tag that is never closed only attributes with values are taken: words without may be the text behind it
        (rf"</?(?:{'|'.join(TAGS)})(?![\w.:-])(?:(?>\s+[\w-]+(?:\s*=\s*{_WHOLE_VALUE})?)*+\s*+/?>|(?>\s+[\w-]+\s*=\s*{_VALUE})*+(?:\s*+/?>)?)", ""),
    )
)
_MARKS = re.compile(f"[{_OPEN}{_SHUT}]")
_URL = re.compile(r"https?://\S+", re.I)
_SIGNIFICANT = re.compile(r"[^\W_]+")
_ROOM = re.compile(r"\n[ \t\xa0]*(?:\n[ \t\xa0]*)+")
_HEADING = re.compile(r"^#{1,6} .*$", re.M)


_INLINE_CODE = re.compile(r"`([^`\n]+)`")
_KEPT = re.compile("\x02(\\d+)\x03")


def clean(text: str) -> str:
    """text without markup. Headings start with #, list entries with -, table cells stand between |; code and formulas stay."""
    return read_blocks(text)[1]


def convert(text: str, pieces: list[tuple[int, int, str, int, int]], shift: int = 0) -> tuple[str, list[tuple[int, int]], bool]:
    """A block without markup, the (start, end) of the link texts in it, and whether it is nothing but code.

    pieces: the regions inside, shift: where the block begins in the text that they count from.
    """
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\x02{len(kept) - 1}\x03"

    parts, at, codes = [], 0, 0
    for start, end, what, inner, inner_end in pieces:
        parts.append(_take_formulas(text[at : start - shift].translate(_NO_MARKS), keep))
        if what != "drop":
            codes += what == "code"
            parts.append(keep(text[inner - shift : inner_end - shift].strip("\n")))
        at = end - shift
    parts.append(_take_formulas(text[at:].translate(_NO_MARKS), keep))
    text = "".join(parts)
    only_code = codes > 0 and not _KEPT.sub("", text).strip()
    text = _INLINE_CODE.sub(lambda m: keep(m.group(1)), text)
    if "&" in text:  # first, as tags may be written with character references
        text = html.unescape(text)
    if "<" in text or "-->" in text:
        for rule, to in _HTML_STEPS:
            text = rule.sub(to, text)
        text = text.replace(_OPEN + _SHUT, "")
    for rule, to in _STEPS:
        text = rule.sub(to, text)
    for _ in range(2 if kept else 0):  # code may itself hold a formula that was kept
        text = _KEPT.sub(lambda m: kept[int(m.group(1))] if int(m.group(1)) < len(kept) else "", text)
    return (*take_marks(text), only_code)


_NO_MARKS = dict.fromkeys((2, 3, 4, 5))


def _take_formulas(text: str, keep) -> str:
    if "$" not in text:
        return text
    parts, at = [], 0
    for start, end in formulas(text):
        parts += text[at:start], keep(text[start:end])
        at = end
    return "".join((*parts, text[at:]))


def take_marks(text: str) -> tuple[str, list[tuple[int, int]]]:
    """text without the marks of links, and the (start, end) of what stood between an opening and the next closing one."""
    parts, spans, opened, at, length = [], [], [], 0, 0
    for m in _MARKS.finditer(text):
        parts.append(text[at : m.start()])
        length += m.start() - at
        at = m.end()
        if m.group() == _OPEN:
            opened.append(length)
        elif opened:
            spans.append((opened.pop(), length))
    return "".join((*parts, text[at:])), spans


def split_blocks(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, float]]:
    """The blocks of text between blank lines, headings apart, each with the share of its letters and digits in links (spans, bare addresses)."""
    links: list[list[int]] = []
    for start, end in sorted([*spans, *(m.span() for m in _URL.finditer(text))]):
        if links and start <= links[-1][1]:
            links[-1][1] = max(links[-1][1], end)
        else:
            links.append([start, end])
    cuts = [m.span() for m in _ROOM.finditer(text)]
    for m in _HEADING.finditer(text):
        cuts += (m.start() - 1, m.start()), (m.end(), m.end() + 1)
    blocks, first, at = [], 0, 0
    for end, after in [*sorted(cuts), (len(text), len(text))]:
        if end < at:
            at = max(at, after)
        elif block := text[at:end].strip():
            while first < len(links) and links[first][1] <= at:
                first += 1
            linked, k = 0, first
            while k < len(links) and links[k][0] < end:
                linked += _weight(text[max(at, links[k][0]) : min(end, links[k][1])])
                k += 1
            blocks.append((block, linked / (_weight(block) or 1) if linked else 0.0))
        at = max(at, after)
    return blocks


def _weight(text: str) -> int:
    return sum(map(len, _SIGNIFICANT.findall(text)))


_BULLET = re.compile(r"(?:[-*•+]|\d{1,3}[.)])\s")
_TERM = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-zÀ-ɏЀ-ӿ]")
_WIDE = re.compile(r"\S {3,}\S")
_STOP = re.compile(r"[.!?][\"'”’»)\]]*\Z")
_FORMULA = re.compile(r"\$[^$]+\$|\$\$.*\$\$|\\\[.*\\\]|\\\(.*\\\)|\\begin.*", re.S)


def shape(block: str) -> str:
    """heading, list, table, code, formula or prose."""
    lines = block.split("\n")
    if block.startswith("#") and len(lines) == 1:
        return "heading"
    if _FORMULA.fullmatch(block) or "$" in block and 2 * sum(b - a for a, b in formulas(block)) > len(block):
        return "formula"
    if all(_BULLET.match(x.strip()) for x in lines):
        return "list"
    if all("|" in x or "\t" in x for x in lines) or len(lines) > 1 and all(_WIDE.search(x) for x in lines):
        return "table"
    commas = block.count(",")
    if len(lines) > 1 and commas >= 2 * len(lines) and ", " not in block and all("," in x and " " not in x.strip() for x in lines):
        return "table"
    if commas >= 5 and len(block.split()) <= 3 * commas and not _STOP.search(block):
        return "list"
    if re.match(r"let \w+ =|\w+\(\)|[{};]", block) or sum(x.endswith((";", "{", "}", "()")) for x in lines) * 2 > len(lines):
        return "code"
    return "prose"


#: A block with a greater share of its letters and digits in links is no running text.
MOST_LINKS = 0.5


def judge(block: str, links: float) -> str:
    """First pass: good, bad, or '' if the block is too short or middling to tell, or of a script without known stop words."""
    if links > MOST_LINKS:
        return "bad"
    if len(block) < 70:
        return ""
    words = _TERM.findall(block.lower())
    if words and 2 * len(_LATIN.findall(block)) < sum(map(len, words)):
        return ""
    density = sum(w in STOP_WORDS or w in OTHER_STOP_WORDS for w in words) / len(words) if words else 0.0
    if density >= 0.25:
        return "good" if len(block) >= 140 or _STOP.search(block) else ""
    return "bad" if density < 0.12 else ""


def first_label(kind: str, block: str, links: float) -> str:
    """First pass over blocks of every shape: lists and tables are decided by their links, code and formulas are good, headings follow their neighbours."""
    if kind == "prose":
        return judge(block, links)
    if kind in ("list", "table"):
        return "bad" if links > MOST_LINKS else "good"
    return "" if kind == "heading" else "good"


def inherit(labels: list[str]) -> list[str]:
    """Second pass: each undecided block takes the nearest decided label, of two equally near ones the good; good if none is decided."""
    decided = [i for i, x in enumerate(labels) if x]
    result, j = list(labels), 0
    for i, label in enumerate(labels):
        if label:
            continue
        while j + 1 < len(decided) and decided[j + 1] <= i:
            j += 1
        near = sorted({abs(i - decided[k]): labels[decided[k]] for k in (j, j + 1) if k < len(decided)}.items()) if decided else []
        ties = [labels[decided[k]] for k in (j, j + 1) if k < len(decided) and near and abs(i - decided[k]) == near[0][0]]
        result[i] = "good" if not near or "good" in ties else near[0][1]
    return result


def read_blocks(text: str) -> tuple[list[str], str, list[tuple[str, str, list[str], str]]]:
    """The kinds of markup in text, its clean text, and its blocks: (shape, label, kinds of markup it held, text)."""
    text = lines_of(text)
    rows: list[tuple[str, str, float, list[str]]] = []  # shape, text, link density, kinds
    held: set[str] = set()  # of blocks of which nothing is left, too
    for start, end, pieces in split_raw(text):
        raw = text[start:end]
        kinds = block_kinds(raw)
        held.update(kinds)
        plain, links, code = convert(raw, pieces, start) if kinds else (raw, [], False)
        if code:
            rows.append(("code", plain.strip("\n"), 0.0, kinds))
        else:
            rows.extend((shape(block), block, linked, kinds) for block, linked in split_blocks(plain, links))
    labels = inherit([first_label(kind, block, linked) for kind, block, linked, _ in rows])
    blocks = [(kind, label, kinds, block) for (kind, block, _, kinds), label in zip(rows, labels)]
    return [k for k in KINDS if k in held], "\n\n".join(block for _, label, _, block in blocks if label == "good"), blocks


BLOCKS = "array<struct<kind: string, label: string, kinds: array<string>, text: string>>"
RESULT = f"key bigint, kinds array<string>, clean string, blocks {BLOCKS}"


def strip_markup(texts: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """key, kinds, clean, blocks of each row of texts(key, text), and the columns named in also as they are.

    kinds: what markup the blocks of text hold, whole or broken; bullets, numbers and plain separators are none. blocks:
    all of them without it, with their shape, the kinds each held, and whether they belong to the text (good) or are
    boilerplate or junk (bad). clean: the good ones. Texts are read whole, and nothing depends on their length. Null
    texts give no row, empty ones no kinds and no blocks; repeated rows come out repeatedly; other columns are ignored.
    """
    kept = "".join(f", {name} {texts.schema[name].dataType.simpleString()}" for name in also)

    def start():
        def work(key: int | None, text: str | None, *others: object) -> Iterable[tuple]:
            if text is not None:
                kinds, whole, blocks = read_blocks(text)
                yield key, kinds, whole, [dict(zip(("kind", "label", "kinds", "text"), block)) for block in blocks], *others

        return work

    return flat_map(texts, ["key", "text", *also], start, RESULT + kept)
