"""Tables written as JSON, or as lines with bars or tabs, read to one shape."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column

from veritally.functions.markup import by_arrow

# Keys of a serialised table whose values are notes.
NOTE_KEYS = ("annotation", "annotations", "auxiliary", "auxiliary_text", "footnote", "footnotes", "legend", "legends", "note", "notes", "source", "source_text")

TABLES = "array<struct<caption:string,columns:array<string>,rows:array<array<string>>,notes:array<string>>>"

#: caption, columns, rows, notes
Table = tuple[str, list[str], list[list[str]], list[str]]


def _said(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _cut(row: list[str], width: int) -> list[str]:
    return row if len(row) == width else (row + [""] * width)[:width]


def _remarks(value: object) -> list[str]:
    """The texts of a note: members of lists apart, entries of objects after their key."""
    if isinstance(value, dict):
        return [f"{key}: {line}" for key, member in value.items() for line in _remarks(member) or [_said(member)]]
    if isinstance(value, list):
        return [line for member in value for line in _remarks(member)]
    text = _said(value).strip()
    return [text] if text else []


def _notes(item: dict, more: tuple = ()) -> list[str]:
    return [line for key, value in item.items() if (name := key.casefold().replace("-", "_").replace(" ", "_")) in NOTE_KEYS or name in more for line in _remarks(value)]


def _title(item: dict) -> str:
    return _said(item.get("caption", item.get("title", ""))).strip()


def lined(text: str, caption: str = "") -> Table | None:
    """The table of lines with bars, or else with tabs.

    With bars the first such line is the header, a line of dashes after it is passed over, and lines without a bar are
    notes, but for the first one above the header: it is the caption where none is given.
    """
    lines = [x for x in text.splitlines() if x.strip()]
    parts = lambda x: [c.strip() for c in x.strip().removeprefix("|").removesuffix("|").split("|")]
    barred = [i for i, x in enumerate(lines) if "|" in x]
    if len(barred) >= 2:
        ruled = all(re.fullmatch(":?-{3,}:?", c) for c in parts(lines[barred[1]]))
        head, body = parts(lines[barred[0]]), barred[1 + ruled :]
        if body:
            notes = [x.strip() for x in lines if "|" not in x]
            if not caption and "|" not in lines[0]:
                caption, *notes = notes
            return caption, head, [_cut(parts(lines[i]), len(head)) for i in body], notes
    tabbed = [x.split("\t") for x in lines]
    if len(tabbed) >= 2 and len(tabbed[0]) >= 2:
        return caption, tabbed[0], [_cut(r, len(tabbed[0])) for r in tabbed[1:]], []
    return None


def mapped(item: dict) -> Table | None:
    """The table of an object: caption or title; columns, headers or header; rows, each a list or an object.

    Without rows, an object ``table`` is looked into (its caption gives way to the outer one, and is a note then), or else
    ``text`` is read as lines.
    """
    caption, rows = _title(item), item.get("rows")
    if rows is None and isinstance(item.get("table"), dict):
        inner = mapped(item["table"])
        own = [inner[0]] if inner and caption and inner[0] and caption != inner[0] else []
        return inner and (caption or inner[0], inner[1], inner[2], _notes(item) + inner[3] + own)
    if rows is None:
        inner = lined(_said(item["text"]), caption) if item.get("text") is not None else None
        return inner and (*inner[:3], _notes(item) + inner[3])
    if not isinstance(rows, list):
        return None
    declared = item.get("columns", item.get("headers", item.get("header")))
    columns = [_said(c) for c in declared] if isinstance(declared, list) else []
    out = []
    for row in rows:
        if isinstance(row, dict):
            columns = columns or list(row)
            out.append([_said(row.get(c, "")) for c in columns])
        elif isinstance(row, list):
            columns = columns or [f"column_{i + 1}" for i in range(len(row))]
            out.append([_said(c) for c in row])
        else:
            out.append([_said(row)])
    return (caption, columns, [_cut(r, len(columns)) for r in out], _notes(item, ("text",))) if columns else None


def _tables(value: object) -> list[Table]:
    if isinstance(value, str):
        try:
            return _tables(json.loads(value))
        except (ValueError, RecursionError):
            return [t] if (t := lined(value)) else []
    if isinstance(value, dict) and isinstance(value.get("tables"), list | str):
        title, notes = _title(value), _notes(value)
        return [(c or title, head, rows, notes + [title] * (title not in ("", c)) + own) for c, head, rows, own in _tables(value["tables"])]
    if isinstance(value, dict):
        return [t] if (t := mapped(value)) else []
    if isinstance(value, list):
        found = [mapped(x) if isinstance(x, dict) else lined(x) if isinstance(x, str) else None for x in value]
        return [t for t in found if t]
    return []


def serialised_tables(text: Column | str) -> Column:
    """The tables (see TABLES) of a text: JSON of one table, of a list of them, or of an object with ``tables``, whose
    caption and notes each of them gets; else lines with bars or tabs. What is no table is left out; null has none.
    """
    return by_arrow(_tables, TABLES)(text)
