"""Edits of WordprocessingML texts that SQL cannot express: nested matches, first-only and n-th replacements.

All functions are pure, take and return strings, and leave every byte outside the edit as it was. An
element runs from its opening tag to the first closing tag of the same name; self-closing ones end
at once. Column versions at the end run batch-wise over Arrow.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions.markup import MANAGED_SECTION, SECTION_ORDER


class Element(NamedTuple):
    """Offsets of an element: of the whole, and of its content (equal if self-closing)."""

    start: int
    stop: int
    content_start: int
    content_stop: int

    @property
    def empty(self) -> bool:
        return self.content_start == self.stop


@lru_cache(maxsize=512)
def _opening(tag: str) -> re.Pattern:
    return re.compile(rf"<{re.escape(tag)}(?=[\s/>])[^>]*>")


def find(xml: str, tag: str, start: int = 0, end: int | None = None, where: Callable[[str], bool] | None = None) -> Element | None:
    """The first element of that name whose opening tag satisfies ``where``; None if it is never closed."""
    end = len(xml) if end is None else end
    for opened in _opening(tag).finditer(xml, start, end):
        if where and not where(opened[0]):
            continue
        if opened[0].endswith("/>"):
            return Element(opened.start(), opened.end(), opened.end(), opened.end())
        close = xml.find(f"</{tag}>", opened.end(), end)
        if close >= 0:
            return Element(opened.start(), close + len(tag) + 3, opened.end(), close)
    return None


def find_all(xml: str, tag: str, start: int = 0, end: int | None = None) -> list[Element]:
    out = []
    while got := find(xml, tag, start, end):
        out.append(got)
        start = got.stop
    return out


def outer(xml: str, at: Element) -> str:
    return xml[at.start : at.stop]


def inner(xml: str, at: Element) -> str:
    return "" if at.empty else xml[at.content_start : at.content_stop]


def put(xml: str, at: Element, text: str) -> str:
    return xml[: at.start] + text + xml[at.stop :]


def put_nth(xml: str, tag: str, n: int, text: str) -> str:
    """The ``n``-th element (from 0) replaced; unchanged if there is none."""
    found = find_all(xml, tag)
    return put(xml, found[n], text) if 0 <= n < len(found) else xml


def without(xml: str, *tags: str) -> str:
    """All elements of these names removed."""
    for tag in tags:
        for at in reversed(find_all(xml, tag)):
            xml = put(xml, at, "")
    return xml


def attr(opening: str, name: str) -> str | None:
    got = re.search(rf'\s{re.escape(name)}\s*=\s*"([^"]*)"', opening)
    return got[1] if got else None


def opening_tag(xml: str, at: Element) -> str:
    return xml[at.start : xml.index(">", at.start) + 1]


def before_close(xml: str, tag: str, text: str) -> str | None:
    """``text`` put before the last closing tag of that name; None if there is none."""
    at = xml.rfind(f"</{tag}>")
    return None if at < 0 else xml[:at] + text + xml[at:]


def with_style(paragraph: str, style_id: str) -> str:
    """The paragraph with that style; section-break paragraphs stay as they are."""
    if "<w:sectPr" in paragraph:
        return paragraph
    mark = f'<w:pStyle w:val="{style_id}"/>'
    if have := find(paragraph, "w:pStyle"):
        tag = opening_tag(paragraph, have)
        return put(paragraph, Element(have.start, have.start + len(tag), 0, 0), re.sub(r'(w:val\s*=\s*")[^"]*', lambda m: m[1] + style_id, tag, count=1))
    if props := find(paragraph, "w:pPr"):
        if props.empty:
            return put(paragraph, props, f"<w:pPr>{mark}</w:pPr>")
        return paragraph[: props.content_start] + mark + paragraph[props.content_start :]
    opened = _opening("w:p").search(paragraph)
    if not opened:
        return paragraph
    return paragraph[: opened.end()] + f"<w:pPr>{mark}</w:pPr>" + paragraph[opened.end() :]


def without_run_fonts(paragraph: str) -> str:
    """Fonts and sizes removed from the first properties of each run, emptied properties too."""
    if "<w:sectPr" in paragraph:
        return paragraph
    for run in reversed(find_all(paragraph, "w:r")):
        props = find(paragraph, "w:rPr", run.content_start, run.content_stop)
        if props and not props.empty:
            kept = without(inner(paragraph, props), "w:rFonts", "w:sz", "w:szCs")
            whole = paragraph[props.start : props.content_start] + kept + "</w:rPr>" if kept.strip() else ""
            paragraph = put(paragraph, props, whole)
    return paragraph


def without_direct_layout(paragraph: str) -> str:
    """Alignment, indents, spacing and numbering removed from the first paragraph properties only."""
    if "<w:sectPr" in paragraph:
        return paragraph
    props = find(paragraph, "w:pPr")
    if not props or props.empty:
        return paragraph
    kept = without(inner(paragraph, props), "w:jc", "w:ind", "w:spacing", "w:numPr")
    return paragraph[: props.content_start] + kept + paragraph[props.content_stop :]


def restyle(paragraph: str, style_id: str, has_layout: bool) -> str:
    """A paragraph under its new style: direct layout goes if the style brings its own, run fonts always."""
    return with_style(without_run_fonts(without_direct_layout(paragraph) if has_layout else paragraph), style_id)


_CHILD = re.compile(r"<w:([A-Za-z0-9]+)(?=[\s/>])[^>]*>")


def children(content: str) -> list[tuple[str, str]]:
    """(local name, markup) of the elements of a content, in order."""
    out, at = [], 0
    while opened := _CHILD.search(content, at):
        got = find(content, f"w:{opened[1]}", opened.start())
        if not got or got.start != opened.start():
            at = opened.end()
            continue
        out.append((opened[1], outer(content, got)))
        at = got.stop
    return out


def insert_child(held: list[tuple[str, str]], name: str, xml: str, order: list[str]) -> None:
    """Put a child before the first one of a higher rank; names outside ``order`` rank last."""
    rank = {tag: i for i, tag in enumerate(order)}
    mine = rank.get(name, 10_000)
    at = next((i for i, (tag, _) in enumerate(held) if rank.get(tag, 10_000) > mine), len(held))
    held.insert(at, (name, xml))


def merge_section(target: str, source: str) -> str:
    """Section properties with the managed children of ``source`` and the other children of ``target``."""
    whole = find(target, "w:sectPr")
    if not whole or whole.empty or (whole.start, whole.stop) != (0, len(target)):
        return target
    held = children(without(inner(target, whole), *(f"w:{t}" for t in MANAGED_SECTION)))
    for tag in MANAGED_SECTION:
        if got := find(source, f"w:{tag}"):
            insert_child(held, tag, outer(source, got), SECTION_ORDER)
    return opening_tag(target, whole) + "".join(x for _, x in held) + "</w:sectPr>"


def visible_text_nodes(paragraph: str) -> list[Element]:
    return [n for n in find_all(paragraph, "w:t") if not n.empty]


def replace_visible(paragraph: str, old: str, new: str, escape: Callable[[str], str], unescape: Callable[[str], str]) -> str:
    """The first occurrence of a visible text, which may span text nodes, replaced; the new text goes into the first node."""
    nodes = visible_text_nodes(paragraph)
    texts = [unescape(inner(paragraph, n)) for n in nodes]
    at = "".join(texts).find(old)
    if at < 0 or not old:
        return paragraph
    begin, stop, offset, first = at, at + len(old), 0, True
    edited = []
    for text in texts:
        a, b = max(begin - offset, 0), min(stop - offset, len(text))
        offset += len(text)
        if a >= b:
            edited.append(None)
            continue
        edited.append(text[:a] + (new if first else "") + text[b:])
        first = False
    for node, text in reversed(list(zip(nodes, edited, strict=True))):
        if text is not None:
            paragraph = paragraph[: node.content_start] + escape(text) + paragraph[node.content_stop :]
    return paragraph


def _per_row(function: Callable[..., str]):
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([None if row[0] is None else function(*row) for row in zip(*columns, strict=True)], dtype=object)

    return run


def column(function: Callable[..., str], n_args: int = 1):
    """A column version of an edit; a null text stays null."""
    run = _per_row(function)
    if n_args == 1:

        @F.pandas_udf(T.StringType())
        def edit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from run((b,) for b in batches)

    elif n_args == 2:

        @F.pandas_udf(T.StringType())
        def edit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            yield from run(batches)

    else:

        @F.pandas_udf(T.StringType())
        def edit(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            yield from run(batches)

    return edit
