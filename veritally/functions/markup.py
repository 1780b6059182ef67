"""Marked-up articles: one parse to a nested value, from which sections and tables are columns."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

# What headings are normalised to, elements that tell funding outside of sections.
HEADINGS = {
    "methods": (r"^(materials?\s+and\s+)?methods?$", r"^methodology$", r"^patients?\s+and\s+methods?$", r"^subjects?\s+and\s+methods?$", r"^study\s+design"),
    "results": (r"^results?$", r"^findings?$", r"^results?\s+and\s+discussion$"),
    "discussion": (r"^discussion$", r"^conclusions?$"),
    "limitations": (r"^(study\s+)?limitations?$", r"^strengths?\s+and\s+limitations", r"^limitations?\s+(and|of)\b"),
    "funding": (r"^funding$", r"^financial support", r"^funding sources?$", r"^acknowledge?ments?$", r"^conflicts? of interest", r"^declarations? of (competing|conflicting) interest", r"^competing interests?$", r"^disclosures?$", r"^role of the funding source"),
}
FUNDING_ELEMENTS = ("funding-group", "funding-statement", "ack", "conflict", "author-notes")
# What tells a table of included studies, in its caption or by SIGNS of its headers.
CAPTION_SIGNALS = ("included", "characteristics", "summary of stud", "summary of find", "trial characteristics", "study characteristics", "eligible stud", "overview of stud", "description of stud", "quality assessment", "risk of bias", "certainty of evidence", "grade")
HEADER_SIGNALS = ("author", "year", "sample", "dose", "duration", "population", "intervention", "participants", "patient", "trial", "stud", "reference", "design", "country", "follow", "comparator", "control", "outcome", "treatment", "arm", "group", "age", "sex", "n =", "no.", "citation")
SIGNS = 3
#: Most columns and rows that one cell is taken to span, as browsers have it.
ACROSS, DOWN = 1000, 65534
#: What parts the texts of a column's header rows.
JOINT = " — "

_GRID = "array<array<string>>"
ARTICLE = f"struct<abstract:string,sections:array<struct<title:string,text:string>>,funding:array<string>,tables:array<struct<label:string,caption:string,flat:{_GRID},head:{_GRID},body:{_GRID}>>>"
TABLES = f"array<struct<label:string,caption:string,head:{_GRID},body:{_GRID}>>"

_WHOLE = re.compile(r"[+-]?[0-9]{1,18}")


def _words(node: ElementTree.Element | None) -> str | None:
    """All text below a node, white space collapsed."""
    if node is None:
        return None
    return " ".join(("".join(node.itertext()) if len(node) else node.text or "").split())


def _span(cell: ElementTree.Element, name: str, most: int) -> int:
    if not (value := cell.get(name)):
        return 1
    value = value.strip()
    return min(max(1, int(value)), most) if _WHOLE.fullmatch(value) else 1


def filled(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """The grid of ``rows`` of cells (text, columns across, rows down): a cell's text stands at each place it covers.

    A cell goes to the first column that no cell from above covers. Lines without any text are left out.
    """
    below: dict[int, tuple[str, int]] = {}
    grid = []
    for row in rows:
        if not below and all(across == down == 1 for _, across, down in row):
            if row:
                grid.append([text for text, _, _ in row])
            continue
        line: list[str] = []
        waiting = deque(row)
        while waiting or len(line) in below:
            at = len(line)
            if at in below:
                text, left = below.pop(at)
                if left > 1:
                    below[at] = (text, left - 1)
                line.append(text)
                continue
            text, across, down = waiting.popleft()
            if down > 1:
                below |= {c: (text, down - 1) for c in range(at, at + across)}
            line += [text] * across
        if line:
            grid.append(line)
    return grid


def _rows(wrap: ElementTree.Element) -> list[tuple[bool, list[tuple[str, int, int]]]]:
    """Whether a row stands in a head, and its cells (text, columns across, rows down)."""
    heads = {id(tr) for head in wrap.iter("thead") for tr in head.iter("tr")}
    cells = lambda tr: [(_words(c), _span(c, "colspan", ACROSS), _span(c, "rowspan", DOWN)) if c.keys() else (_words(c), 1, 1) for c in tr if c.tag in ("td", "th")]
    return [(id(tr) in heads, cells(tr)) for tr in wrap.iter("tr")]


def _grids(wrap: ElementTree.Element, flat: bool) -> tuple | None:
    """label, caption, with ``flat`` the cells as they stand, head and body of a table; None without a cell."""
    rows = _rows(wrap)
    if not any(cells for _, cells in rows):
        return None
    stand = [[[text for text, _, _ in cells] for _, cells in rows if cells]] if flat else []
    head, body = ([cells for in_head, cells in rows if in_head is which] for which in (True, False))
    return _words(wrap.find("label")), _words(wrap.find("caption")), *stand, filled(head), filled(body)


def _root(xml: str | None) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(xml) if xml else None
    except ElementTree.ParseError:
        return None


def _tables(root: ElementTree.Element, flat: bool) -> list[tuple]:
    return [t for wrap in root.iter("table-wrap") if (t := _grids(wrap, flat))]


def _tables_alone(xml: str | None) -> list[tuple] | None:
    root = _root(xml)
    return None if root is None else _tables(root, False)


def _article(xml: str | None) -> tuple | None:
    root = _root(xml)
    if root is None:
        return None
    sections = [(_words(title), _words(sec)) for sec in root.iter("sec") if (title := sec.find("title")) is not None]
    funding = [text for name in FUNDING_ELEMENTS for el in root.iter(name) if (text := _words(el))]
    return _words(root.find(".//abstract")), sections, list(dict.fromkeys(funding)), _tables(root, True)


def by_arrow(f: Callable, kind: str) -> Callable:
    """A UDF of one text from ``f``, whose nested values Arrow takes over without a walk through them in Python."""
    arrow = to_arrow_type(DataType.fromDDL(kind))

    def each(texts: pa.Array) -> pa.Array:
        return pa.array([f(text) for text in texts.to_pylist()], arrow)

    return F.arrow_udf(each, kind)


def article(xml: Column | str) -> Column:
    """The parse of an article in XML (see ARTICLE); null for null, empty and malformed ones. Texts are read whole.

    Select it as a column of its own before the functions below are applied to it.
    """
    return by_arrow(_article, ARTICLE)(xml)


def tables(xml: Column | str) -> Column:
    """The tables alone of the same parse (see TABLES), without their cells as they stand; null for null, empty and malformed ones.

    Explode it as outer: an inner explode infers a filter on the parse, which parses every article a second time.
    """
    return by_arrow(_tables_alone, TABLES)(xml)


def section_of(title: Column) -> Column:
    """The section that a heading begins: the first of HEADINGS that fits it, else null."""
    key = F.trim(F.regexp_replace(F.lower(title), r"[^a-z\s]", ""))
    names = lambda k: F.coalesce(*(F.when(k.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in HEADINGS.items()))
    return F.transform(F.array(key), names)[0]  # the key is made once


def section_texts(parsed: Column) -> Column:
    """map of section -> text of an article; its sections of one name parted by an empty line, in order.

    Elements of funding follow the sections of that name, unless they repeat one. What isn't found has no entry.
    """
    named = F.transform(parsed["sections"], lambda s: F.struct(section_of(s["title"]).alias("name"), s["text"].alias("text")))

    def entry(name: str, named: Column) -> Column:
        texts = F.transform(F.filter(named, lambda s: s["name"] == name), lambda s: s["text"])
        if name == "funding":
            texts = F.concat(texts, F.array_except(parsed["funding"], texts))
        return F.struct(F.lit(name).alias("key"), F.array_join(texts, "\n\n").alias("value"))

    entries = lambda n: F.array(*(entry(name, n) for name in HEADINGS))
    return F.map_from_entries(F.filter(F.transform(F.array(named), entries)[0], lambda e: e["value"] != ""))  # sections are named once


def has_grid(table: Column) -> Column:
    """Whether a table has a header and a row, so that :func:`structured` is not null."""
    heads, rows = F.size(table["head"]), F.size(table["body"])
    return F.when(heads == 0, rows > 1).otherwise(rows > 0)


def structured(table: Column) -> Column:
    """struct(columns, rows) of a table with its spans filled in; null where it has no header or no row.

    Header rows are those of its head, else its first row; the texts of a column in them are joined, each once. Rows are
    as wide as the widest.
    """
    headless = F.size(table["head"]) == 0
    head = F.when(headless, F.slice(table["body"], 1, 1)).otherwise(table["head"])
    body = F.when(headless, F.slice(table["body"], F.lit(2), F.greatest(F.size(table["body"]) - 1, F.lit(0)))).otherwise(table["body"])
    def made(grid: Column) -> Column:
        """The width is taken once, not for each row."""
        width, head, body = grid["width"], grid["head"], grid["body"]
        name = lambda c: F.array_join(F.array_distinct(F.filter(F.transform(head, lambda r: F.coalesce(F.get(r, c), F.lit(""))), lambda x: x != "")), JOINT)
        columns = F.transform(F.sequence(F.lit(0), width - 1), name)
        return F.struct(columns.alias("columns"), F.transform(body, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))).alias("rows"))

    grid = F.struct(head.alias("head"), body.alias("body"), F.array_max(F.transform(F.concat(head, body), F.size)).alias("width"))
    return F.when((F.size(head) > 0) & (F.size(body) > 0), F.transform(F.array(grid), made)[0])


def looks_included(table: Column) -> Column:
    """Whether a table (label, caption, flat) may list included studies: by its caption, or by SIGNS signs of its first two rows."""
    caption = F.lower(F.concat_ws(" ", table["caption"], table["label"]))
    header = F.lower(F.array_join(F.flatten(F.slice(table["flat"], 1, 2)), " "))
    signs = lambda h: reduce(lambda a, b: a + b, (F.contains(h, F.lit(s)).cast("int") for s in HEADER_SIGNALS))
    told = lambda c: reduce(lambda a, b: a | b, (F.contains(c, F.lit(s)) for s in CAPTION_SIGNALS))
    return F.exists(F.array(caption), told) | (F.transform(F.array(header), signs)[0] >= SIGNS)  # each text is made once
