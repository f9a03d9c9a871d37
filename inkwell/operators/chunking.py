"""Texts to chunks within a model's budget: paragraphs, lines, then halves of the words, then halves of the characters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.arrow import flat_map

CHUNKS = "doc_id bigint, chunk_no bigint, text_idx int, text_len int"


def _parts(text: str, start: int, end: int, sign: str) -> Iterator[tuple[int, int]]:
    """The spans between signs that aren't empty."""
    while start <= end:
        at = text.find(sign, start, end)
        stop = end if at < 0 else at
        if stop > start:
            yield start, stop
        if at < 0:
            return
        start = at + len(sign)


def _halve(text: str, start: int, end: int, fits: Callable[[str], bool]) -> Iterator[tuple[int, int]]:
    """Halves of the words between single spaces until each fits; a lone word goes on in halves of its characters."""
    pending = [(start, end)]
    while pending:
        a, b = pending.pop()
        if a >= b:
            continue
        if fits(text[a:b]) or b - a == 1:
            yield a, b
            continue
        gaps = [i for i in range(a, b) if text[i] == " "]
        if gaps:
            cut = gaps[(len(gaps) + 1) // 2 - 1]
            pending += [(cut + 1, b), (a, cut)]
        else:
            middle = a + (b - a) // 2
            pending += [(middle, b), (a, middle)]


def chunk_spans(text: str, fits: Callable[[str], bool]) -> Iterator[tuple[int, int]]:
    """(start, end) of each chunk, in order. Offsets are those of the chunk itself, also where its words occur earlier."""
    for a, b in _parts(text, 0, len(text), "\n\n"):
        if fits(text[a:b]):
            yield a, b
            continue
        for c, d in _parts(text, a, b, "\n"):
            if fits(text[c:d]):
                yield c, d
            else:
                yield from _halve(text, c, d, fits)


def chunk_texts(docs: DataFrame, budget: int) -> DataFrame:
    """CHUNKS of docs(doc_id, text); budget is the number of white-space separated words a chunk may have.

    Null and empty texts have no chunks. A single word longer than eight characters per word of the budget is cut.
    """

    def fits(part: str) -> bool:
        return len(part.split()) <= budget and len(part) <= 8 * budget

    def start():
        def work(doc_id: int | None, text: str | None) -> Iterable[tuple]:
            return ((doc_id, n, a, b - a) for n, (a, b) in enumerate(chunk_spans(text, fits))) if text else ()

        return work

    return flat_map(docs, ["doc_id", "text"], start, CHUNKS)


def paragraph_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_no, text_idx, text_len of the lines of docs that aren't empty, in the JVM alone."""
    lines = F.split("text", "\n")
    spans = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text_idx:int,text_len:int>>").alias("found")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x) + 1).alias("at"),
            F.concat(s["found"], F.array(F.struct(s["at"].alias("text_idx"), F.length(x).alias("text_len")))).alias("found"),
        ),
    )["found"]
    kept = F.filter(spans, lambda p: p["text_len"] > 0)
    return docs.select("doc_id", F.posexplode(kept).alias("chunk_no", "c")).select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "c.text_idx", "c.text_len")
