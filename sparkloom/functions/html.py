"""HTML as Markdown, plain text, or segments, by the standard library's parser in Arrow batches.

Broken markup follows this parser: an element that is never closed ends with its parent, and a block element ends an open
paragraph.
"""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"address", "article", "blockquote", "details", "div", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "ol", "p", "pre", "section", "table", "ul"}
SILENT = {"script", "style", "noscript", "svg", "video", "audio"}
#: Words in the first row of a table that tells about its document.
META_HEADS = {"owner", "status", "version", "published", "changed by", "comment"}


class Node:
    """An element, or a text if it has no name. Texts keep their entities."""

    __slots__ = ("attributes", "children", "name", "text")

    def __init__(self, name: str = "", attributes: dict[str, str] | None = None, text: str = ""):
        self.name, self.attributes, self.text = name, attributes or {}, text
        self.children: list[Node] = []

    def walk(self) -> Iterator[Node]:
        for child in self.children:
            yield child
            yield from child.walk()

    def elements(self, *names: str) -> list[Node]:
        return [c for c in self.children if c.name in names]

    def inner(self) -> str:
        return self.text if not self.name else "".join(c.inner() for c in self.children)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.root = Node("#document")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._close("p", "ul", "ol", "table")
        if tag == "li":
            self._close("li", "ul", "ol")
        if tag in ("td", "th"):
            self._close("td", "tr", "table") or self._close("th", "tr", "table")
        if tag == "tr":
            self._close("tr", "table")
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def _close(self, tag: str, *within: str) -> bool:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return True
            if self.open[i].name in within:
                return False
        return False

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(Node(text=data))

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


def parse(page: str | None) -> Node:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def _pruned(node: Node) -> Node:
    """Without what carries no text: scripts, media, macros, and images that nothing describes."""
    node.children = [_pruned(c) for c in node.children if not (c.name in SILENT or c.name.startswith("ac:") or (c.name == "img" and "alt" not in c.attributes))]
    return node


def is_meta_table(table: Node) -> bool:
    rows = [n for n in table.walk() if n.name == "tr"]
    return bool(rows) and not META_HEADS.isdisjoint(html.unescape(c.inner()).strip().lower() for c in rows[0].elements("th", "td"))


class Renderer:
    """Text of the block elements it knows; text outside of them is left out, and entities are decoded at the end."""

    def __init__(self, markdown: bool = True, meta_tables: bool = True):
        self.markdown, self.meta_tables = markdown, meta_tables
        self.rules: dict[str, Callable[[Node, str, int], None]] = {f"h{i}": self.heading for i in range(1, 7)}
        self.rules |= {"p": self.paragraph, "ul": self.items, "ol": self.items, "blockquote": self.quote, "table": self.table, "pre": self.code, "hr": self.rule, "details": self.details}

    def render(self, page: str | None) -> str:
        self.lines: list[str] = []
        self.blocks(_pruned(parse(page)), 0)
        return html.unescape("\n".join(self.lines).strip())

    def blocks(self, node: Node, depth: int) -> None:
        for child in node.children:
            self.block(child, depth)

    def block(self, node: Node, depth: int) -> None:
        if rule := self.rules.get(node.name):
            rule(node, "  " * depth, depth)
        elif node.name == "li":
            self.lines.append(f"{'  ' * depth}- {self.inline(node).strip()}")
        else:
            self.blocks(node, depth)

    def heading(self, node: Node, indent: str, depth: int) -> None:
        before = "#" * int(node.name[1]) + " " if self.markdown else indent
        self.lines += [before + self.inline(node).strip(), ""]

    def paragraph(self, node: Node, indent: str, depth: int) -> None:
        self.lines += [indent + self.inline(node).strip(), ""]

    def quote(self, node: Node, indent: str, depth: int) -> None:
        self.lines += [f"{indent}> {self.inline(node).strip()}", ""]

    def items(self, node: Node, indent: str, depth: int) -> None:
        for i, item in enumerate(node.elements("li"), 1):
            self.lines.append(f"{indent}  {f'{i}.' if node.name == 'ol' else '-'} {self.inline(item).strip()}")

    def table(self, node: Node, indent: str, depth: int) -> None:
        if not self.meta_tables and is_meta_table(node):
            return
        ruled = not self.markdown
        for row in (n for n in node.walk() if n.name == "tr"):
            cells = [self.inline(c).strip() for c in [*row.elements("th"), *row.elements("td")]]
            self.lines.append(f"{indent}| {' | '.join(cells)} |")
            if not ruled and row.elements("th"):
                self.lines.append(f"{indent}| {' | '.join(['---'] * len(cells))} |")
                ruled = True
        self.lines.append("")

    def code(self, node: Node, indent: str, depth: int) -> None:
        self.lines += ["```", node.inner().strip(), "```", ""]

    def rule(self, node: Node, indent: str, depth: int) -> None:
        self.lines += ["---" if self.markdown else "-" * 20, ""]

    def details(self, node: Node, indent: str, depth: int) -> None:
        self.lines += [f"{indent}--- Expandable Section ---", ""]
        self.blocks(node, depth + 1)

    def inline(self, node: Node) -> str:
        if not node.name:
            return node.text
        if node.name == "img":
            alt = node.attributes.get("alt", "").strip()
            return "" if not alt else f"![{alt}]" if self.markdown else f"[Image: {alt}]"
        inner = "".join(map(self.inline, node.children))
        if node.name == "code":
            return f"`{inner.strip()}`"
        if node.name == "a" and "href" in node.attributes:
            href, inner = node.attributes["href"].strip(), inner.strip()
            return f"[{inner}]({href})" if self.markdown else f"{inner} ({href})" if inner else href
        return inner


def sections(page: str | None) -> list[tuple[str, str]]:
    """Segments under the path of h1 to h3 headings: every element's text is a line of its own, so nested elements
    repeat; list items are numbered, and the count starts anew at an ordered list only."""
    path: list[str] = []
    out: list[tuple[str, list[str]]] = []
    number = 0
    for node in _pruned(parse(page)).walk():
        if not node.name:
            continue
        text = html.unescape(node.inner()).strip()
        if node.name in ("h1", "h2", "h3"):
            path = [*path[: int(node.name[1]) - 1], text]
            out.append((" > ".join(path), []))
            continue
        if node.name == "ol":
            number = 0
        if not text or not out:
            continue
        if node.name == "li":
            number += 1
            text = f"{number}. {text}"
        out[-1][1].append(text)
    return [(k, "\n".join(lines)) for k, lines in out if lines]


def _series(f: Callable[[str | None], object], texts: pd.Series) -> pd.Series:
    return texts.map(f, na_action=None)


def to_markdown(page: Column, meta_tables: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return _series(Renderer(True, meta_tables).render, texts)

    return run(page)


def to_text(page: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return _series(Renderer(False).render, texts)

    return run(page)


def to_sections(page: Column) -> Column:
    @F.pandas_udf("array<struct<key:string,content:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return _series(lambda t: [{"key": k, "content": c} for k, c in sections(t)], texts)

    return run(page)
