"""Evaluation passages inside training texts, whole or in part, by Wu-Manber search over words.

The alphabet of the search is the words of the passages, so a pattern is a run of PATTERN words and a block a pair of
words. A shift table says how far the window may move after a block that no pattern ends with; a window whose last block
ends patterns looks into the bucket of that suffix, and a comparison of the whole run confirms. Patterns are all runs of
that length of all passages (of short passages, shorter ones): a stretch of n words with every tenth changed or left out keeps one of five words or more
whole, so each leaked stretch is hit at least once. A hit is then confirmed by aligning the passage with the text around it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.arrow import flat_map

#: Words of a pattern, and of a block. Half of a shorter passage may have fewer words: its patterns are that long.
PATTERN, BLOCK = 4, 2
#: Words of passages in the tables of one search; more are searched for in several passes over the documents.
SEARCHED = 500_000
#: Penalty in an alignment of a word changed, left out or put in, against 1 for a word that agrees.
MISS = 2

#: A run of letters and digits, or one sign of a script that puts no spaces between words.
_SIGN = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_SIGN}]|[^\W_{_SIGN}]+")
_PLAIN = re.compile(r"[a-z0-9]+")
_INVISIBLE = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]")


def fold_words(text: str) -> list[str]:
    """The words of text without regard to case, forms of characters, accents' encoding and invisible characters."""
    if text.isascii():
        return _PLAIN.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold())




class PassageSearch:
    """Wu-Manber tables over passages: {item_id: words}, a set of tables for each length of patterns."""

    def __init__(self, passages: dict[int, list[str]], share: float = 0.5) -> None:
        self.codes: dict[str, int] = {}
        self.coded = {k: [self.codes.setdefault(w, len(self.codes)) for w in words] for k, words in passages.items() if words}
        #: by length of the patterns: the shift table, and by suffix block the patterns with their (item, place)
        self.tables: dict[int, tuple[dict, dict]] = {}
        for item, words in self.coded.items():
            size = self.pattern_of(len(words), share)
            shift, bucket = self.tables.setdefault(size, ({}, {}))
            width = min(BLOCK, size)
            for at in range(len(words) - size + 1):
                run = tuple(words[at : at + size])
                for end in range(width, size + 1):
                    block = run[end - width : end]
                    shift[block] = min(shift.get(block, size), size - end)
                bucket.setdefault(run[-width:], {}).setdefault(run, []).append((item, at))

    @staticmethod
    def pattern_of(words: int, share: float) -> int:
        """PATTERN, but no more than the fewest words of a passage that must be held."""
        return max(1, min(PATTERN, ceil(share * words)))

    def hits(self, words: list[int]) -> dict[int, list[tuple[int, int]]]:
        """By item the (place in the text, place in the passage) of each pattern found in the coded text."""
        found: dict[int, list[tuple[int, int]]] = {}
        for pattern, (shift, bucket) in self.tables.items():
            width = min(BLOCK, pattern)
            at, size, far, back = pattern - 1, len(words), pattern - width + 1, pattern - 1
            while at < size:
                block = (words[at - 1], words[at]) if width == 2 else (words[at],)
                step = shift.get(block)
                if step is None:
                    at += far
                elif step:
                    at += step
                else:
                    for item, place in bucket[block].get(tuple(words[at - back : at + 1]), ()):
                        found.setdefault(item, []).append((at - back, place))
                    at += 1
        return found

    def search(self, text: str, share: float, edits: float) -> list[tuple[int, int, int]]:
        """(item, words of the passage in the stretch, of these found) of each passage that the text holds."""
        get = self.codes.get
        words = [get(w, -1) for w in fold_words(text)]
        held = []
        for item, places in self.hits(words).items():
            passage = self.coded[item]
            need = share * len(passage)
            # a stretch of m words has m - PATTERN + 1 patterns, and each word changed spoils at most PATTERN of them
            least = need - PATTERN + 1 - PATTERN * (edits * need + 1)
            if len({p for _, p in places}) < least:
                continue
            best = self.align(passage, words, places, edits)
            # one word more may differ, as shares of words round, but not in a stretch that is shorter than a pattern
            spare = 1 if len(passage) >= 2 * PATTERN else 0
            if best and best[0] >= need and best[1] + spare >= (1 - edits) * best[0]:
                held.append((item, *best))
        return held

    @staticmethod
    def align(passage: list[int], words: list[int], places: list[tuple[int, int]], edits: float) -> tuple[int, int] | None:
        """The best stretch: (words of the passage from its first to its last, of these found).

        A local alignment over the parts of the text around the hits; each cell carries the score, the places in the
        passage and in the text where its stretch begins, and the words found so far. Its ends are then extended.
        """
        size, best = len(passage), None
        ranges: list[list[int]] = []
        for at, place in sorted(places):
            low, high = at - place - size // 4 - 2, at + (size - place) + size // 4 + 2
            if ranges and low <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], high)
            else:
                ranges.append([low, high])
        for low, high in ranges:
            low = max(0, low)
            # score, begin in the passage, begin in the text, found; column 0 is the empty stretch
            above = [(0, j, low, 0) for j in range(size + 1)]
            for t, word in enumerate(words[low : max(0, high)], low):
                left = (0, 0, t + 1, 0)
                row = [left]
                for j in range(1, size + 1):
                    diagonal = above[j - 1]
                    if passage[j - 1] == word:
                        left = (diagonal[0] + 1, diagonal[1], diagonal[2], diagonal[3] + 1) if diagonal[0] else (1, j - 1, t, 1)
                        if best is None or (left[0], left[3]) > best[0]:
                            best = ((left[0], left[3]), left[1], j, left[2], t + 1)
                    else:
                        left = max(diagonal, above[j], left, key=_score)
                        left = (left[0] - MISS, left[1], left[2], left[3]) if left[0] > MISS else (0, j, t + 1, 0)
                    row.append(left)
                above = row
        if best is None:
            return None
        (_, found), begin, end, first, last = best
        after = _extension(passage[end:], words[last : last + size], end - begin, found, edits)
        before = _extension(passage[:begin][::-1], words[max(0, first - size) : first][::-1], end - begin + after[0], found + after[1], edits)
        return end - begin + after[0] + before[0], found + after[1] + before[1]


def _extension(passage: list[int], words: list[int], held: int, found: int, edits: float) -> tuple[int, int]:
    """(words of the passage, of these found) by which a stretch goes on over single words changed, left out or put in.

    held, found: what the stretch has so far. It goes on as long as no more than edits of its words differ.
    """
    i = j = more = 0
    while True:
        while i < len(passage) and j < len(words) and passage[i] == words[j]:
            i, j, more = i + 1, j + 1, more + 1
        for di, dj in ((1, 1), (1, 0), (0, 1)):
            a, b = i + di, j + dj
            # the words from there on that agree
            run = 0
            while a + run < len(passage) and b + run < len(words) and passage[a + run] == words[b + run]:
                run += 1
            if run and found + more + run >= (1 - edits) * (held + a + run):
                i, j, more = a + run, b + run, more + run
                break
        else:
            return i, more


def _score(cell: tuple[int, int, int]) -> int:
    return cell[0]


def find_leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, edits: float = 0.1) -> DataFrame:
    """doc_id, item_id, stretch, found: the documents(doc_id, text) that hold passages of items(item_id, text).

    Held is a stretch of at least share of the passage's words, in order and in one piece, in which up to edits of the
    words may be changed or left out. Texts are searched whole. In scripts without spaces each sign is a word. Null and
    empty texts, and those without words, give no rows. The passages travel to every task, about SEARCHED words of them
    at a time; with more, the documents are read once for each such block of passages. Repeated documents come out
    repeatedly, repeated items once; other columns are ignored.
    """
    asked = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    size = asked.agg(F.sum(F.length("text") / 4)).head()[0] or 0
    blocks = max(1, ceil(size / SEARCHED))
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        here = _search(documents, {r.item_id: fold_words(r.text) for r in rows}, share, edits)
        found = here if found is None else found.unionByName(here)
    return found


def _search(documents: DataFrame, passages: dict[int, list[str]], share: float, edits: float) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(passages)

    def start():
        search = PassageSearch(held.value, share)

        def work(doc_id: int | None, text: str | None) -> Iterable[tuple]:
            return ((doc_id, *found) for found in search.search(text, share, edits)) if text else ()

        return work

    return flat_map(documents, ["doc_id", "text"], start, "doc_id bigint, item_id bigint, stretch int, found int")
