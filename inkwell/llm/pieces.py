"""Cutting oversized texts into overlapping pieces at the strongest boundaries.

A text's boundaries (ends of paragraphs, sentences and words) are kept in order with their strengths; a sparse table
over them gives the strongest in any range, the rightmost of equals, in constant time. Each piece ends at the strongest
boundary of its permissible window, the next one starts the overlap before that end.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from inkwell.functions.arrow import flat_map

#: Boundaries that are indexed at a time.
STRETCH = 1 << 18
#: Boundary strengths.
WORD_END, SENTENCE_END, PARAGRAPH_END = 1, 2, 3
_LINE = r"(?>\r\n|\r|\n)"  # atomic: no \r\n is two line ends
_BLANK = r"[ \t ]"
_PARAGRAPH = re.compile(rf"{_LINE}(?:{_BLANK}*{_LINE})+")
_SENTENCE = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*\s+|[。！？।॥؟]+[\"'”’»」』）)\]]*\s*)")
_WORD = re.compile(r"\s+")
_EDGE = " \t \r\n"

PIECES = "key bigint, piece_no bigint, piece_start bigint, piece_end bigint, strength int, piece string, oversized array<bigint>"


class Boundaries:
    """Positions at which a text may be cut, with a range-maximum index over their strengths.

    Paragraph boundaries are where the next paragraph begins, so they part the text into paragraphs as well. The index
    is a sparse table; of long texts it is built over one stretch of boundaries at a time, as cutting moves on.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        ends = [np.fromiter((m.end() for m in rule.finditer(text)), dtype=np.int64) for rule in (_WORD, _SENTENCE, _PARAGRAPH)]
        at = np.concatenate(ends)
        strength = np.repeat(np.array([WORD_END, SENTENCE_END, PARAGRAPH_END], dtype=np.int8), [len(x) for x in ends])
        order = np.lexsort((strength, at))
        at, strength = at[order], strength[order]
        last = np.append(at[1:] != at[:-1], True)[: len(at)] & (at < len(text))  # the strongest of each position
        self.at, self.strength = at[last], strength[last]
        self.first, self.table = 0, []
        self.build(0)

    def build(self, first: int) -> None:
        """The sparse table over the STRETCH boundaries from the one numbered first."""
        part = self.strength[first : first + STRETCH].astype(np.int64)
        # the place breaks ties, so that the maximum is unique and the rightmost
        self.first, self.table, width = first, [part * STRETCH + np.arange(len(part))], 1
        while 2 * width <= len(part):
            below = self.table[-1]
            self.table.append(np.maximum(below[:-width], below[width:]))
            width *= 2

    def strongest(self, low: int, high: int) -> tuple[int, int] | None:
        """(position, strength) of the strongest boundary in [low, high], the last of equals; None if there is none."""
        i, j = int(self.at.searchsorted(low)), int(self.at.searchsorted(high, "right"))
        if i >= j:
            return None
        best = (0, 0)
        for a in range(i, j, STRETCH):  # more than one stretch only for windows of more than STRETCH boundaries
            b = min(j, a + STRETCH)
            if a < self.first or b > self.first + len(self.table[0]):
                self.build(a)
            k = (b - a).bit_length() - 1
            here = max(int(self.table[k][a - self.first]), int(self.table[k][b - self.first - (1 << k)]))
            value, place = divmod(here, STRETCH)
            if value >= best[1]:
                best = (int(self.at[self.first + place]), value)
        return best

    def paragraphs(self) -> Iterable[tuple[int, int]]:
        """(start, end) of each run of lines that aren't blank, from its first to its last character that isn't blank."""
        start = 0
        for end in [*self.at[self.strength == PARAGRAPH_END].tolist(), len(self.text)]:
            part = self.text[start:end]
            left = len(part) - len(part.lstrip(_EDGE))
            body = part.strip(_EDGE)
            if body:
                yield start + left, start + left + len(body)
            start = end

    def oversized(self, limit: int) -> list[int]:
        """The numbers, from 1, of the paragraphs longer than limit: no window from their start holds a paragraph boundary."""
        long = []
        for n, (a, b) in enumerate(self.paragraphs(), 1):
            best = self.strongest(a + 1, a + limit)
            if (best is None or best[1] < PARAGRAPH_END) and b - a > limit:  # the last paragraph has no boundary behind it
                long.append(n)
        return long


def cut(marks: Boundaries, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at the end) of the pieces; 0 where no boundary was in reach.

    The window of a cut is the second half of the piece at first, then, if it has no boundary, all that still leads on.
    """
    size, start, found = len(marks.text), 0, []
    while size - start > limit:
        best = marks.strongest(start + max(overlap + 1, limit // 2), start + limit) or marks.strongest(start + overlap + 1, start + limit) or (start + limit, 0)
        found.append((start, *best))
        start = best[0] - overlap
    found.append((start, size, PARAGRAPH_END))
    return found


def split_texts(texts: DataFrame, limit: int = 2_000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """The pieces of texts(key, text): at most limit code points each, consecutive ones sharing exactly overlap.

    piece_no counts from 1; piece_start and piece_end are offsets from 0; strength tells where the piece was cut
    (3 paragraph, 2 sentence, 1 word, 0 nowhere); oversized, on the first piece, numbers from 1 the paragraphs that
    are longer than limit themselves and so had to be cut inside. Texts within the limit are one piece, empty texts one
    empty piece, null texts none; repeated rows come out repeatedly; other columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")

    def start():
        def work(key: int | None, text: str | None) -> Iterable[tuple]:
            if text is None:
                return
            if len(text) <= limit:
                yield key, 1, 0, len(text), PARAGRAPH_END, text if with_text else None, []
                return
            marks = Boundaries(text)
            long = marks.oversized(limit)
            for n, (a, b, strength) in enumerate(cut(marks, limit, overlap), 1):
                yield key, n, a, b, strength, text[a:b] if with_text else None, long if n == 1 else None

        return work

    return flat_map(texts, ["key", "text"], start, PIECES)
