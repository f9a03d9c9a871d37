"""Sentence units of texts in many languages and scripts.

A pushdown automaton reads the terminators, quotes, brackets, list entries, blank lines and spaces between Thai letters
of a text. Its stack holds the list levels it is in and the open quotes and brackets: no unit ends inside one of these,
and the stop behind an entry's number ends none. Only marks that are closed before the next blank line open anything, so
one that is never closed, or a sign for inches, swallows no text. A full stop is looked up, backwards, in a trie of
abbreviations; each kind of abbreviation says what must follow for the stop to end a unit all the same. Positions are
those of the text as it stands, counted in code points from 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from inkwell.functions.arrow import flat_map

# Abbreviations by language, without the last stop; case counts only for one letter.
#: A name or a word always follows.
TITLES = (
    "dr mr mrs ms prof sgt st gen col capt lt rev hon gov sen rep messrs mt ft vs approx cf i.e e.g viz "
    "mme mlle mm mgr me p.ex ex av apr sr sra srta dra dña d ca vgl bzw z z.b b d.h h u u.a a s evtl ggf inkl sog v v.chr n.chr mio mrd hr fr "
    "см т е т.е т.к т.д напр им ул проф डॉ श्री श्रीमती द د أ م"
).split()
#: A number, or more lower-case words, follow; before a capital the unit ends.
NUMBERED = (
    "fig figs vol vols p pp sec secs ch chap no nos nr art bd abb kap aufl pág págs núm núms cap tom рис стр гл п "
    "jan feb mar apr jun jul aug sep sept oct nov dec"
).split()
#: May stand at the end of a unit: it is one if a capital follows.
FINAL = "etc a.m p.m co ltd inc corp jr bros al usw usf ff f m km cm kg g min std г гг в вв др пр j.-c av.j.-c u.s u.k bzgl".split()
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
#: Words of Thai dates.
THAI_DATES = (
    "พ.ศ. ค.ศ. ร.ศ. จ.ศ. มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม"
).split()

PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》"}
CLOSERS = frozenset("”»›」』)]）】》")
QUOTES = frozenset('"“„«‹「『')

_EVENT = re.compile(
    r"(?P<entry>(?:(?<=[\r\n])|\A)[ \t]*(?:\d{1,3}[.)]|[-*•+])(?=[ \t]+\S))"
    r"|(?P<stop>[.!?…。！？｡।॥؟۔]+)"
    r"|(?P<mark>[\"“”„«»‹›「」『』()\[\]（）【】《》])"
    r"|(?P<blank>(?>\r\n|\r|\n)[^\S\r\n]*(?>\r\n|\r|\n)\s*)"
    r"|(?P<thai>(?<=[฀-๿]) +(?=\S)|(?<=[0-9.]) +(?=[฀-๿0-9]))"
)
_ENTRY = re.compile(r"[ \t]*(?:\d{1,3}[.)]|[-*•+])[ \t]+\S")
_DATES = tuple(THAI_DATES)
_SPACE = re.compile(r"\s*")
_NEXT = re.compile(r"[^\W\d_]+")
_FULL_WIDTH = frozenset("。！？｡")
_LEAD = "\"'“”„«»‹›「」『』()[]（）{}*_"

GO_ON, NUMBER, CAPITAL = 1, 2, 3


def _trie() -> dict:
    root: dict = {}
    for kind, words in ((GO_ON, TITLES), (NUMBER, NUMBERED), (CAPITAL, FINAL)):
        for word in words:
            node = root
            for c in reversed(word):
                node = node.setdefault(c, {})
            node[""] = kind
    return root


class SentenceAutomaton:
    """ends(text): the end of each unit."""

    def __init__(self) -> None:
        self.trie = _trie()

    def abbreviation(self, token: str) -> int:
        """What the abbreviation token (without its stop) wants to follow, 0 if it is none."""
        if len(token) == 1:
            if token.isupper():
                return GO_ON  # an initial
            if token.isdigit():
                return 0
        elif "." in token and len(token) >= 3 and all(len(x) == 1 and x.isupper() for x in token.split(".")):
            return CAPITAL
        elif token == "me":  # a title only with a capital
            return 0
        node = self.trie
        for c in reversed(token.lower()):
            node = node.get(c)
            if node is None:
                return 0
        return node.get("", 0)

    def stop_ends(self, text: str, start: int, at: int, unit: int) -> bool:
        """Does the full stop at text[start], followed at text[at] by white space or the end, end the unit begun at unit?"""
        after = _SPACE.match(text, at).end()
        if after >= len(text):
            return True
        left = start
        while left > unit and not text[left - 1].isspace():
            left -= 1
        token = text[left:start].lstrip(_LEAD)
        follow = text[after]
        if not token:
            return True
        if token.isdigit():
            if left <= unit:
                return False  # the number of a list entry
            word = _NEXT.match(text, after)
            return not (len(token) <= 2 and word and word.group().lower() in MONTHS)
        if "฀" <= token[-1] <= "๿":
            return False
        kind = self.abbreviation(token)
        if not kind:
            return True
        if kind == GO_ON:
            return False
        if kind == NUMBER and token.lower() == "no" and not follow.isdigit():
            return True
        return self.opens(text, after)

    @staticmethod
    def opens(text: str, at: int) -> bool:
        """Can a new unit begin with text[at]? Small letters, digits and most signs can't."""
        c = text[at]
        while c in "\"'“„«‹「『([（¿¡" and at + 1 < len(text):
            at += 1
            c = text[at]
            if c.isspace():
                continue
        return c.isalpha() and not c.islower() or c.isspace()

    @staticmethod
    def pairs(text: str, events: list[re.Match]) -> dict[int, int]:
        """Where the quotes and brackets open that are closed in the same paragraph, and where each of them closes."""
        found: dict[int, int] = {}
        stack: list[tuple[str, int]] = []  # closing mark, place of the opening one
        for m in events:
            if m.lastgroup == "blank":
                stack.clear()
            elif m.lastgroup == "mark":
                mark, at = m.group(), m.start()
                if any(mark == close for close, _ in stack):
                    while stack:
                        close, opened = stack.pop()
                        if close == mark:
                            found[opened] = at
                            break
                elif mark not in CLOSERS and not (mark == '"' and at and text[at - 1].isalnum()):
                    stack.append(('"' if mark == '"' else PAIRS.get(mark, "”"), at))
        return found

    @staticmethod
    def enters(entry: re.Match, levels: list[list[int]]) -> bool:
        """Does entry begin an entry of a list? Then levels, (indent, number) from the outermost, say where it stands."""
        sign = entry.group()
        indent = len(sign) - len(sign.lstrip())
        while levels and levels[-1][0] > indent:
            levels.pop()
        number = int(sign.strip()[:-1]) if sign[-1] in ".)" else -1
        if levels and levels[-1][0] == indent and (number < 0 or number == levels[-1][1] + 1):
            levels[-1][1] = number
            return True
        if number > 1:
            return False
        if levels and levels[-1][0] == indent:
            levels.pop()
        levels.append([indent, number])
        return True

    def ends(self, text: str) -> list[int]:
        found: list[int] = []
        events = list(_EVENT.finditer(text))
        closing = self.pairs(text, events) if any(m.lastgroup == "mark" for m in events) else {}
        levels: list[list[int]] = []  # the lower part of the stack: list levels
        stack: list[tuple[int, bool]] = []  # the upper part: where a quote or bracket closes, whether a colon stands before it
        unit = _SPACE.match(text).end()
        inner = -1  # where the last stop inside a quote or bracket ended

        def close(end: int) -> None:
            nonlocal unit, inner
            found.append(end)
            unit, inner = _SPACE.match(text, end).end(), -1

        for m in events:
            at, end = m.span()
            kind = m.lastgroup
            if kind == "entry":
                if self.enters(m, levels) or m.group()[-1] != ".":
                    continue
                at, kind = end - 1, "stop"  # a number at the beginning of a line and its stop
            if at < unit and kind != "blank":
                continue  # white space already passed
            if kind == "blank":
                stack.clear()
                if levels and not _ENTRY.match(text, end):
                    levels.clear()
                last = at
                while last > unit and text[last - 1].isspace():
                    last -= 1
                if last > unit:
                    close(last)
                unit, inner = max(unit, end), -1
            elif kind == "stop":
                if stack:
                    inner = end
                    continue
                if self.ends_here(text, at, end, unit):
                    close(end)
            elif kind == "mark":
                if stack and at == stack[-1][0]:
                    _, colon = stack.pop()
                    touching = inner >= 0 and not text[inner:at].strip()
                    inner = -1
                    if touching and not stack and self.quote_ends(text, end, m.group(), colon):
                        close(end)
                    elif touching and stack:
                        inner = end
                elif at in closing:
                    before = at
                    while before > unit and text[before - 1].isspace():
                        before -= 1
                    stack.append((closing[at], text[before - 1 : before] in (":", "：") and before > unit))
                    inner = -1
            elif not stack and self.thai_space(text, at, end):
                close(at)
        last = len(text.rstrip())
        if last > unit:
            found.append(last)
        return found

    def ends_here(self, text: str, at: int, end: int, unit: int) -> bool:
        """Does the run of stops text[at:end], outside of quotes, end the unit?"""
        run = text[at:end]
        if run[-1] in _FULL_WIDTH or run[-1] in "।॥":
            return True
        if end < len(text) and not text[end].isspace():
            return False
        if run[-1] == "…" or len(run) > 1 and run.strip(".") == "":
            after = _SPACE.match(text, end).end()
            return after >= len(text) or text[after].isupper() or text[after] in "\"“„«¿¡("
        if run == ".":
            return self.stop_ends(text, at, end, unit)
        return True

    def quote_ends(self, text: str, end: int, mark: str, colon: bool) -> bool:
        """Does a quote or bracket that itself ends with a stop, closed at end, also end the unit?"""
        after = _SPACE.match(text, end).end()
        if after >= len(text):
            return True
        c = text[after]
        if c in ",;:.!?…、，；：—–-。！？":
            return False
        if c.islower():
            return False
        if c.isupper() or c.isdigit() and mark not in "”」』":
            return after > end
        if c in QUOTES or c in "(（¿¡[":
            return True
        if mark in ")）]】":
            return True
        return colon  # scripts without capitals: only a quote announced by a colon closes its sentence

    @staticmethod
    def thai_space(text: str, at: int, end: int) -> bool:
        """Does the space text[at:end] next to a Thai letter end a unit? Not inside a date."""
        after = text[end : end + 1]
        if text.startswith(_DATES, end):
            return False
        if after.isdigit() and text.endswith((*_DATES, "วันที่", "ปี"), 0, at):
            return False
        if text[at - 1].isdigit() or text[at - 1] == ".":
            return "฀" <= after <= "๿" and text[at - 1] != "."
        return True


UNITS = "doc_id bigint, sent_no bigint, sent_start bigint, sent_end bigint, sentence string"


def split_sentences(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, sent_no, sent_start, sent_end, sentence of each unit of documents(doc_id, text).

    A unit runs from its first to its last character that is not white space, closing quotes and brackets included;
    both positions count from 1 in code points. A blank line always ends a unit, a single line break never does. Null,
    empty and blank texts have no units; a text without any terminator is one; repeated rows come out repeatedly; other
    columns are ignored. with_text=False leaves sentence null.
    """

    def start():
        automaton = SentenceAutomaton()

        def work(doc_id: int | None, text: str | None) -> Iterable[tuple]:
            begin = 0
            for n, end in enumerate(automaton.ends(text) if text else (), 1):
                first = _SPACE.match(text, begin).end()
                yield doc_id, n, first + 1, end, text[first:end] if with_text else None
                begin = end

        return work

    return flat_map(documents, ["doc_id", "text"], start, UNITS)
