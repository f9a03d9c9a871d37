"""Statistics of texts, and whether they are prose, by a hidden Markov model over their lines.

Each line is reduced to one observation from its words, signs and repetition. The states are prose, list, table and
junk; the most likely sequence of states (Viterbi) labels the lines, so that an odd line inside a run of others takes
their label. The shares of characters by label tell what a text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from math import log

from pyspark.sql import DataFrame

from inkwell.functions.arrow import flat_map
from inkwell.llm.markup import OTHER_STOP_WORDS, STOP_WORDS, TAGS

STATES = ("prose", "list", "table", "junk")
#: Common words of all languages with a list; single letters of other languages are labels of list entries as well.
SMALL_WORDS = STOP_WORDS | {w for w in OTHER_STOP_WORDS if len(w) > 1}

# The model. Rows are states in the order of STATES.
#: What a line looks like.
(SENTENCE, FRAGMENT, WRAPPED, BULLET, CELLS, TITLE, LONE_TITLE, SIGNS, GIBBERISH, REPEATED, NUMBERS, MARKUP) = range(12)
EMIT = (
    # sentence, fragment, wrapped, bullet, cells, title, lone title, signs, gibberish, repeated, numbers, markup
    (0.60, 0.12, 0.12, 0.003, 0.003, 0.02, 0.05, 0.001, 0.001, 0.002, 0.005, 0.07),
    (0.005, 0.02, 0.01, 0.36, 0.02, 0.28, 0.20, 0.005, 0.02, 0.01, 0.02, 0.03),
    (0.005, 0.01, 0.02, 0.02, 0.75, 0.06, 0.01, 0.005, 0.01, 0.01, 0.08, 0.02),
    (0.01, 0.03, 0.02, 0.01, 0.01, 0.05, 0.01, 0.26, 0.30, 0.22, 0.06, 0.01),
)
#: Lines after which a sentence may go on.
RUNNING = (SENTENCE, FRAGMENT, WRAPPED)
START = (0.7, 0.1, 0.1, 0.1)
#: To each state, from one line to the next and across a blank line.
STAY, STAY_ACROSS = 0.94, 0.70

_NL = re.compile(r"\r\n|\r|\n")
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|</?(?i:{'|'.join(TAGS)})(?![\w.:-])[^<>]*>?")
_MARK = re.compile(
    r"\{\{[^{}]*\}?\}?|\[\[(?:[Cc]ategory|[Ff]ile|[Ii]mage):[^\]]*\]?\]?|!\[[^\]]*\]\([^)]*\)?|\[\^\w+\]|\]\([^)\s]*\)|\[(?:https?:)?//[^\s\]]+|__[A-Z]{4,}__"
    r"|~?\\(?:cite|ref|label)\{[^{}]*\}?|\$\$?[^$]{0,200}[\\^_][^$]{0,200}\$\$?|\\\(.*?\\\)|\\\[.*?\\\]|(?<![\w:\\])\\(?:begin|end)\{[^{}]*\}?|(?<![\w:\\])\\[A-Za-z]+\{?|&#?\w{2,8};"
)
_HEADING = re.compile(r"(?:#{1,6}\s+\S|(={2,6})[^=]+\1|={3,}\s*$|-{3,}\s*$|\\(?:sub)*section\b)")
_UNDERLINE = re.compile(r"(?:={3,}|-{3,})(?!\S)")
_BULLET = re.compile(r"(?:[-*•+‣▪·]|\(?\d{1,4}[.)]|[a-z]\))\s+\S")
_NUMBERED = re.compile(r"\(?\d{1,4}[.)]\s+")
#: The label of an entry in a list that runs on in one line.
_INLINE = re.compile(r"(?:^|[;,]\s+)\(?(?:[a-z]{1,2}|\d{1,3})[.)]\s")
_LIST_TAG = re.compile(r"\s*</?(?:ul|ol|li)\b", re.I)
_ROW_TAG = re.compile(r"\s*</?(?:table|tbody|tr|td|th)\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"\S {3,}\S")
_DIGITS = re.compile(r"\d+")
#: Tokens of letters and digits both.
_MIXED = re.compile(r"(?<!\S)(?=\S*\d)(?=\S*[^\W\d_])\S+")
_END = re.compile(r"[.!?…:;\"”'’)»\]]\s*$")
_ODD = re.compile("[ÃÂâ�][\x80-¿™œžŸ€]|�|Ã.|â€")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_ENV = re.compile(r"\s*\\(begin|end)\{(?:equation|align|math|displaymath|verbatim|lstlisting)\*?\}")


def observe(line: str, bare: str, lone: bool, seen: int) -> int:
    """The observation of a line. bare: it without inline markup; lone: blank lines around it; seen: times it came before."""
    if not bare:
        return MARKUP
    if _ROW_TAG.match(line):
        return CELLS
    if _LIST_TAG.match(line):
        return BULLET
    words = _WORD.findall(bare.lower())
    letters = sum(map(len, words))
    digits = sum(map(len, _DIGITS.findall(bare)))
    signs = len(bare) - letters - digits - bare.count(" ") - bare.count("\t")
    small = sum(map(SMALL_WORDS.__contains__, words))
    density = small / len(words) if words else 0.0
    if bare[0] == "|" and (bare.count("|") >= 2) or bare[:2] in ("{|", "|}", "|-") or bare[0] == "!" and "!!" in bare:
        return CELLS
    if seen and len(bare) > 8 and density < 1:
        return REPEATED
    if letters + digits == 0 or signs > 0.6 * len(bare):
        return SIGNS
    bars = max(bare.count("|"), bare.count("\t"))
    if bars >= 2 and len(bare) < 30 * bars or " " not in bare and bare.count(",") >= 2:
        return CELLS
    if density < 0.2:
        if bare.count("|") >= 1 and small == 0 or bare.count("\t") >= 1 or _WIDE.search(line):
            return CELLS
        if small == 0 and bare.count(",") >= 1 and not re.search(r",\s", bare) and len(bare.split()) <= bare.count(",") + 2:
            return CELLS
        if bare.count(";") >= 2 and small == 0:
            return CELLS
    if _BULLET.match(bare) or len(_INLINE.findall(bare)) >= 3:
        return BULLET
    if digits > letters and letters < 0.3 * len(bare) and len(bare) > 20:
        return NUMBERS
    tokens = bare.split()
    longest = max(map(len, tokens))
    if not bare.isascii() and len(_ODD.findall(bare)) * 12 > len(tokens) * 2 + 10:
        return GIBBERISH
    mixed = len(_MIXED.findall(bare)) if digits else 0
    if longest > 60 and longest > 0.4 * len(bare) or mixed * 2 > len(tokens) and len(tokens) > 3:
        return GIBBERISH
    if len(tokens) >= 12 and len(set(tokens)) * 5 < len(tokens) and len(set(tokens)) < 40:
        return GIBBERISH
    if density < 0.06 and len(words) >= 12:
        return GIBBERISH
    if density >= 0.12 and small >= 2 or density >= 0.3:
        return SENTENCE if len(words) >= 4 and (len(bare) > 120 or _END.search(bare)) else WRAPPED if len(bare) >= 50 else FRAGMENT
    if small and len(words) <= 8 and _ENDED.search(bare):
        return FRAGMENT
    if len(bare) <= 60:
        return LONE_TITLE if lone else TITLE
    return FRAGMENT


def read_lines(text: str) -> list[tuple[str, int, bool]]:
    """(line, observation, whether a blank line stands before it) of the lines that aren't blank."""
    raw = [x.strip() for x in _NL.split(text)]
    rows: list[tuple[str, int, bool]] = []
    seen: dict[str, int] = {}
    fenced = template = False
    formula = False
    for i, line in enumerate(raw):
        if not line:
            continue
        before, after = i == 0 or not raw[i - 1], i + 1 == len(raw) or not raw[i + 1]
        if _FENCE.match(line):
            fenced = not fenced
            what = MARKUP
        elif m := _ENV.match(line):
            formula = m.group(1) == "begin"
            what = MARKUP
        elif template or line.startswith("{{") and "}}" not in line:
            template = "}}" not in line and not after
            what = MARKUP
        elif fenced or formula or _HEADING.match(line) or not after and _UNDERLINE.match(raw[i + 1]):
            what = MARKUP
        else:
            bare = _MARK.sub(" ", _TAG.sub(" ", line)).strip().strip("*~'`").strip() if _SOME.search(line) else line
            what = observe(line, bare, before and after, seen.get(line, 0))
            if what == BULLET and not before and rows[-1][1] in RUNNING and (number := _NUMBERED.match(bare)) and number.group().strip("(). \t") not in ("0", "1"):
                what = observe(line, bare[number.end() :] or bare, False, 0)  # a sentence goes on with a number
            seen[line] = seen.get(line, 0) + 1
        rows.append((line, what, before))
    repeated = {k for k, n in seen.items() if n > 2}
    return [(x, REPEATED if x in repeated and w in (SENTENCE, FRAGMENT, WRAPPED, TITLE, LONE_TITLE) and len(x) > 8 else w, b) for x, w, b in rows]


_ENDED = re.compile(r"[.!?…。！？।؟][\"'”’»)\]]*\Z")
_SOME = re.compile(r"[<{\[\]\\$&_*~'`]")
_LOG_EMIT = tuple(tuple(map(log, row)) for row in EMIT)


def _moves(stay: float) -> tuple[tuple[float, ...], ...]:
    return tuple(tuple(log(stay if i == j else (1 - stay) / (len(STATES) - 1)) for j in range(len(STATES))) for i in range(len(STATES)))


_NEXT, _ACROSS = _moves(STAY), _moves(STAY_ACROSS)


def label_lines(rows: list[tuple[str, int, bool]]) -> list[int]:
    """The most likely states of the lines."""
    if not rows:
        return []
    states = range(len(STATES))
    score = [log(START[s]) + _LOG_EMIT[s][rows[0][1]] for s in states]
    back: list[list[int]] = []
    for line, what, blank in rows[1:]:
        moves = _ACROSS if blank else _NEXT
        come = [max(states, key=lambda f: score[f] + moves[f][s]) for s in states]
        weight = 1 + min(4, len(line) // 150)  # a long line is seen as several of its kind
        score = [score[come[s]] + moves[come[s]][s] + weight * _LOG_EMIT[s][what] for s in states]
        back.append(come)
    state = max(states, key=lambda s: score[s])
    path = [state]
    for come in reversed(back):
        state = come[state]
        path.append(state)
    return path[::-1]


STATS = (
    "key bigint, words bigint, mean_word double, symbol_share double, ended_share double, common_share double, "
    "prose_share double, list_share double, table_share double, junk_share double, prose boolean"
)


def statistics(text: str) -> tuple:
    """The values of STATS after key."""
    words = _WORD.findall(text.lower())
    rows = read_lines(text)
    sums = [0] * len(STATES)
    for (line, what, _), state in zip(rows, label_lines(rows)):
        sums[0 if what == MARKUP and state != 2 else state] += len(line)
    total, n, letters = sum(sums), len(words), sum(map(len, words))
    solid = sum(map(len, text.split()))
    return (
        n,
        letters / n if n else 0.0,
        max(0, solid - letters - sum(map(len, _DIGITS.findall(text)))) / solid if solid else 0.0,
        sum(bool(_ENDED.search(x)) for x, _, _ in rows) / len(rows) if rows else 0.0,
        sum(map(SMALL_WORDS.__contains__, words)) / n if n else 0.0,
        *((s / total if total else 0.0) for s in sums),
        2 * sums[0] >= total,
    )


def text_quality(texts: DataFrame) -> DataFrame:
    """STATS of each row of texts(key, text).

    words: runs of letters; symbol_share of the characters that aren't white space; ended_share: lines that end with a
    sentence's stop; common_share: words that are SMALL_WORDS; the four shares of characters by label; prose: not more
    than half of the characters are lists, tables or junk. Null texts give no row, empty and blank ones zeros and prose;
    repeated rows come out repeatedly; other columns are ignored. Texts of any length are read whole.
    """

    def start():
        def work(key: int | None, text: str | None) -> Iterable[tuple]:
            if text is not None:
                yield (key, *statistics(text))

        return work

    return flat_map(texts, ["key", "text"], start, STATS)
