"""Nested JSON records to flat tables by Dewey labels.

Every object of a record gets the ordinal path from the top as its label, e.g. 1.3.2. The label says all: cutting it
from the right gives the labels of the objects around, and the nearest of them that belongs to a table of its own is the
parent row. Objects are grouped into tables by the keys of their schema path, so wrappers may differ between records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.arrow import flat_map
from inkwell.session import cut_lineage

#: Keys under which the objects of each table hang (the last key of the schema path).
TABLES = {
    "page": ("page", "pages"),
    "revision": ("revision", "revisions"),
    "section": ("sections", "children"),
    "note": ("note", "notes"),
}
SCHEMA = (
    "record_id bigint, kind string, label string, parent_kind string, parent_label string, id bigint, parent_id bigint, "
    "page_label string, revision_label string, title string, redirect string, sha1 string, heading string, text string"
)


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?", re.A)
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def parse(text: str) -> object:
    """What json.loads() gives, for values nested to any depth; ValueError if damaged."""
    holders: list[object] = []  # the arrays and objects still open
    keys: list[str] = []  # the key under which each open object waits for a value
    at = _SPACE.match(text).end()
    while True:
        sign = text[at : at + 1]
        closed = False
        if sign == '"':
            value, at = scanstring(text, at + 1)
            closed = True
        elif sign in ("{", "["):
            value = {} if sign == "{" else []
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if sign == "{" else "]"):
                at, closed = at + 1, True
            else:
                holders.append(value)
                if sign == "{":
                    at = _key(text, at, keys)
                continue
        elif (m := _NUMBER.match(text, at)) and m.group():
            value = float(m.group()) if m.group(2) or m.group(3) else int(m.group())
            at, closed = m.end(), True
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError(f"no value at {at}")
            value, at, closed = _WORDS[word], at + len(word), True
        while closed:
            at = _SPACE.match(text, at).end()
            if not holders:
                if at < len(text):
                    raise ValueError(f"more than one value at {at}")
                return value
            holder, sign = holders[-1], text[at : at + 1]
            if isinstance(holder, dict):
                holder[keys.pop()] = value
            else:
                holder.append(value)
            if sign == ",":
                at = _SPACE.match(text, at + 1).end()
                if isinstance(holder, dict):
                    at = _key(text, at, keys)
                closed = False
            elif sign == ("}" if isinstance(holder, dict) else "]"):
                value, at = holders.pop(), at + 1
            else:
                raise ValueError(f"neither a comma nor an end at {at}")


def _key(text: str, at: int, keys: list[str]) -> int:
    """Reads a key and its colon; where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    keys.append(key)
    return _SPACE.match(text, at + 1).end()


def decode(payload: str | None) -> object:
    """The value of payload, however deep, and however often it was encoded again as a string; None if damaged."""
    value: object = payload
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except RecursionError:
            try:
                value = parse(value)
            except ValueError:
                return None
        except ValueError:
            return None
    return value


class Label:
    """A Dewey label: the label around it, which is what truncation gives, and its own ordinal there.

    Labels share their beginnings, so those of a chain of any depth take space in proportion to it. A label of an object
    that is a row of a table knows its kind and object; above holds the nearest such labels around by kind, parent the
    nearest of all.
    """

    __slots__ = ("above", "around", "item", "kind", "ordinal", "parent")

    def __init__(self, around: Label | None, ordinal: int) -> None:
        self.around, self.ordinal, self.kind, self.item = around, ordinal, None, None
        self.above: dict[str, Label] = {}
        self.parent: Label | None = None
        if around is not None:
            self.above, self.parent = around.above, around.parent
            if around.kind:
                self.above, self.parent = {**around.above, around.kind: around}, around

    def __str__(self) -> str:
        parts, at = [], self
        while at is not None:
            parts.append(str(at.ordinal))
            at = at.around
        return ".".join(reversed(parts))


_KIND = {key: kind for kind, keys in TABLES.items() for key in keys}


def label_rows(value: object) -> Iterator[Label]:
    """The label of every object that is a row of a table, in document order, without recursion.

    An array's elements take a level of their own in the label, so no two objects of a record share one.
    """
    stack: list[tuple[Label | None, int, str | None, object]] = [(None, 1, None, value)]
    while stack:
        around, ordinal, key, item = stack.pop()
        label = Label(around, ordinal)
        if isinstance(item, list):
            stack.extend((label, n, key, item[n - 1]) for n in range(len(item), 0, -1) if isinstance(item[n - 1], (dict, list)))
        elif isinstance(item, dict):
            label.kind, label.item = _KIND.get(key), item
            if label.kind:
                yield label
            stack.extend((label, n, k, v) for n, (k, v) in reversed(list(enumerate(item.items(), 1))) if isinstance(v, (dict, list)))


_LONE = re.compile("[\ud800-\udfff]")
_WHOLE = re.compile(r"\s*-?[0-9]{1,19}\s*")


def _text(value: object) -> str | None:
    """A text or that of the object standing in for it; halves of surrogate pairs, which no text can hold, as U+FFFD."""
    if isinstance(value, dict):
        value = next((value[k] for k in ("value", "title", "#text") if isinstance(value.get(k), str)), None)
    if not isinstance(value, str):
        return None
    return value if value.isascii() else _LONE.sub("\ufffd", value)


def _number(value: object) -> int | None:
    """A whole number of 64 bits, however written; None for all else."""
    if isinstance(value, bool):
        return None
    if isinstance(value, float) and value.is_integer() or isinstance(value, str) and _WHOLE.fullmatch(value):
        value = int(value)
    return value if isinstance(value, int) and -(2**63) <= value < 2**63 else None


def _section_or_item(label: Label) -> int | None:
    """The number of the section around a section, or of the object around a note; 0 if there is none."""
    outer = label.above.get("section") if label.kind == "section" else label.parent
    return _number(outer.item.get("id")) if outer else 0


def _sha1(label: Label) -> str | None:
    revision = label if label.kind == "revision" else label.above.get("revision")
    sha1 = _text(revision.item.get("sha1")) if revision else None
    return "".join(sha1.split()) if sha1 is not None else None


def _dotted(label: Label | None) -> str | None:
    return str(label) if label else None


#: What each column of SCHEMA says of a label, besides record_id.
VALUES = {
    "kind": lambda x: x.kind,
    "label": _dotted,
    "parent_kind": lambda x: x.parent.kind if x.parent else None,
    "parent_label": lambda x: _dotted(x.parent),
    "id": lambda x: _number(x.item.get("id")),
    "parent_id": lambda x: _section_or_item(x) if x.kind in ("section", "note") else None,
    "page_label": lambda x: _dotted(x if x.kind == "page" else x.above.get("page")),
    "revision_label": lambda x: _dotted(x if x.kind == "revision" else x.above.get("revision")),
    "title": lambda x: _text(x.item.get("title")),
    "redirect": lambda x: _text(x.item.get("redirect")),
    "sha1": _sha1,
    "heading": lambda x: _text(x.item.get("heading" if x.kind != "note" else "label")),
    "text": lambda x: _text(x.item.get("text")),
}


def flatten_record(record_id: int | None, payload: str | None, columns: list[str] | None = None, kinds: tuple[str, ...] = tuple(TABLES)) -> Iterable[tuple]:
    """The rows of one record; none if it is null or damaged. Only the wanted columns are worked out."""
    values = [(lambda _: record_id) if c == "record_id" else VALUES[c] for c in columns or ["record_id", *VALUES]]
    for label in label_rows(decode(payload)):
        if label.kind in kinds:
            yield tuple(value(label) for value in values)


def flatten_records(records: DataFrame, columns: list[str] | None = None, kinds: tuple[str, ...] = tuple(TABLES)) -> DataFrame:
    """One row per page, revision, section and note of records(record_id, payload).

    kind names the table, label is the key within the record, parent_label that of the row above (null at the top);
    id, parent_id are the objects' own numbers (parent_id 0 for a section without one around it). Null, damaged and
    empty payloads give no rows; payloads nested to any depth are read, and decoded as often as they were encoded again
    as strings; repeated deliveries repeat their rows until tables_of() removes them; other columns of records are
    ignored. columns, kinds: those of SCHEMA and TABLES that are wanted, so that no others leave Python.
    """
    types = dict(x.split() for x in SCHEMA.split(", "))
    wanted = columns or list(types)

    def start():
        return lambda record_id, payload: flatten_record(record_id, payload, wanted, kinds)

    return flat_map(records, ["record_id", "payload"], start, ", ".join(f"{c} {types[c]}" for c in wanted))


#: What each flat table holds besides its keys.
COLUMNS = {
    "page": ["title", "redirect"],
    "revision": ["sha1", "text"],
    "section": ["id", "parent_id", "sha1", "heading", "text", "page_label", "revision_label"],
    "note": ["id", "parent_id", "heading"],
}
KEYS = ["record_id", "label", "parent_kind", "parent_label"]


def table_of(records: DataFrame, kind: str) -> DataFrame:
    """The flat table of one kind, each object once, keyed by (record_id, label) with parent_label as foreign key."""
    return flatten_records(records, [*KEYS, *COLUMNS[kind]], (kind,)).distinct()


def tables_of(records: DataFrame) -> dict[str, DataFrame]:
    """All flat tables by kind, as table_of() gives them, from one reading of the payloads."""
    rows = cut_lineage(flatten_records(records).distinct())
    return {kind: rows.where(F.col("kind") == kind).select(*KEYS, *COLUMNS[kind]) for kind in TABLES}
